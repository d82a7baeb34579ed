"""Every query with SQL gives the rows of its SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline")


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool | str):
        return value
    number = float(value)
    return int(number) if number.is_integer() else round(number, 9)


def rows(names, found):
    return sorted((tuple(plain(r[c]) for c in names) for r in found), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, data, sql, name):
    df = entry.queries()[name](spark, data)
    ours = [r.asDict() for r in df.collect()]
    table = sql.execute(entry.oracle_sql()[name]).to_arrow_table()
    assert sorted(df.columns) == sorted(table.column_names)
    names = sorted(df.columns)
    assert rows(names, ours) == rows(names, table.to_pylist())
    assert ours or name == "empty"


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql_of_the_same_name():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_other_queries_stand_where_the_operators_cannot_be_imported():
    """A library of the training-data operators that is missing takes only their queries with it."""
    import subprocess
    import sys

    code = "import sys; sys.modules['xxhash'] = sys.modules['regex'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q), set(e.oracle_sql()) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=entry.ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 90 and out[1:] == ["False", "True"]
