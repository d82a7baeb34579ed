"""What grows with the pages of a search goes through shuffles, not through the driver, however small Spark takes it for."""

import re

from test_runs import stores  # noqa: F401
from test_runs import start

from lotwise.operators import search_pages as W
from lotwise.plans import page_queries
from lotwise.runs import Run, Stores


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def broadcasts(plan):
    return re.findall(r"(?:BroadcastHashJoin|BroadcastNestedLoopJoin)[^\n]*", plan)


def test_parts_are_joined_to_pages_by_a_shuffle(spark, data):
    """The parts were sent to the driver for each of the two readings of the listings, and only rows a supplier, nation, region or group may."""
    plan = planned(page_queries.result_pages(spark, data))
    assert len(re.findall(r"ShuffledHashJoin \[l_partkey", plan)) == 2
    assert not [b for b in broadcasts(plan) if "l_partkey" in b]


def test_listings_are_shuffled_before_they_are_cards(spark, data):
    """A card says most of a listing twice; cards were put in pages through a shuffle, and spilled before it."""
    plan = planned(page_queries.result_pages(spark, data))
    by_page = [m.start() for m in re.finditer(r"Exchange hashpartitioning\(grp#\w+, order_key#", plan)]
    assert len(by_page) == 1 and 0 < plan.index("kevel") < by_page[0] and "kevel" not in plan[by_page[0] :]


def test_totals_of_a_scan_join_pages_by_a_shuffle(spark, tmp_path):
    spark.createDataFrame([("N", 1, True, 2, [1]), ("N", 2, True, 2, [1])], "grp string, page bigint, found boolean, total bigint, cards array<int>").write.parquet(f"{tmp_path}/parsed")
    parsed = spark.read.parquet(f"{tmp_path}/parsed")
    targets = W.page_targets(spark.createDataFrame([("N", 3, 0)], "grp string, total bigint, most bigint"))
    got = W.fetched_targets(targets, parsed, parsed["found"])
    assert not broadcasts(planned(got))
    assert W.scan_totals(got).first().asDict() == {"pages_total": 3, "pages_scanned": 2, "total_pages": 3, "truncated": False}


def test_records_and_pages_of_a_run_are_joined_by_shuffles(stores, monkeypatch):  # noqa: F811
    """The texts of all project pages were sent to the driver where parts, of which they are made, are few MB."""
    plans, stored, put = {}, Run.stored, Stores.put

    def kept(self, df, name, *metrics):
        plans[name] = planned(df)
        return stored(self, df, name, *metrics)

    def written(self, name, rows):
        plans[name] = planned(rows)
        return put(self, name, rows)

    monkeypatch.setattr(Run, "stored", kept)
    monkeypatch.setattr(Stores, "put", written)
    assert start(stores).run() == "succeeded"
    assert {name: broadcasts(plans[name]) for name in ("missing", "fresh", "records", "photos")} == dict.fromkeys(("missing", "fresh", "records", "photos"), [])
    assert [re.search(r"\[(\w+)#", b).group(1) for b in broadcasts(plans["result"])] == ["grp"]  # the filters, a row a group
