"""Searches over pages, records, forms, streams and writes."""

import pytest
from pyspark.sql import functions as F

from lotwise.functions import dimensions as D
from lotwise.functions import scalars as X
from lotwise.operators import forms as M
from lotwise.operators import search_pages as G
from lotwise.operators import stores as S
from lotwise.operators import transcripts as T
from lotwise.sources import pages as P
from lotwise.sources import sinks
from lotwise.sources.tables import PageSource, site
from lotwise.streaming.acts import TurnMapper
from lotwise.streaming.windows import counts_by_window


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def page(total, *cards):
    import json

    data = {"listingsData": [{"listingData": {"id": i, "price": {"value": p}, "property": {"id": 9}}} for i, p in cards], "paginationData": {"totalPages": total}}
    return f'<script id="__NEXT_DATA__" type="application/json">{json.dumps({"props": {"pageProps": {"pageData": {"data": data}}}})}</script>'


WANTED = [("N", 3, 1), ("H", 0, 2)]
FETCHED = [("N", 1, page(5, (1, 10), (2, 20))), ("N", 2, page(5, (2, 99), (3, 30))), ("H", 1, page("x", (3, 77), (4, 40))), ("H", 2, page(0, (5, 50)))]


def scan(spark, fetched):
    return G.search_scan(spark.createDataFrame(WANTED, "grp string, most bigint, place int"), spark.createDataFrame(fetched, "grp string, page int, html string"))


def test_a_search_over_groups_and_pages(spark):
    """First occurrences by group, page and place; a missing third page is skipped; an unknown total reads the first page only."""
    rows, totals = scan(spark, FETCHED)
    assert sorted((r.listing_id, r.price, r.grp, r.page) for r in rows.collect()) == [(1, 10, "N", 1), (2, 20, "N", 1), (3, 30, "N", 2), (4, 40, "H", 1)]
    assert totals.first().asDict() == {"pages_total": 4, "pages_scanned": 3, "total_pages": 5, "truncated": True}


@pytest.mark.parametrize("fetched, why", [(FETCHED[1:], "no first page"), ([("N", 1, page(5)), *FETCHED[1:]], "no listings though there are pages"), ([("N", 1, ""), *FETCHED[1:]], "no first page")])
def test_an_unusable_first_page_is_an_error(spark, fetched, why):
    with pytest.raises(Exception, match=why):
        scan(spark, fetched)[0].collect()


def test_an_empty_search_is_none(spark):
    rows, totals = scan(spark, [("N", 1, page(0)), ("H", 1, page(0))])
    assert rows.count() == 0 and totals.first().truncated is False


def test_last_pages(spark):
    cases = {(0, 0): 1, (7, 0): 7, (7, 3): 3, (2, 3): 2, (0, 3): 3, (None, 2): 2}
    for (total, most), last in cases.items():
        assert one(spark, G.last_page(F.lit(total).cast("bigint"), F.lit(most).cast("bigint"))) == last


@pytest.mark.parametrize("text, number", [("12345678901234567890123 units", None), ("9223372036854775807", 9223372036854775807), ("-99,999,999,999,999,999,999", None), ("1.5", 2)])
def test_numbers_beyond_64_bits_are_none(spark, text, number):
    got = one(spark, X.to_integer(F.lit(text)))
    assert got == number or number is not None and got is None and number > 2**62  # a double can't hold the last one


def test_character_references_of_all_kinds(spark):
    cells = ["Caf&eacute; &#x27;N&#39; &euro;", " <b>a</b> &amp;lt; ", "&nosuch; &copy;&nbsp;", None]
    got = spark.createDataFrame([(cells,)], "c array<string>").select(P.plain_texts(F.col("c")).alias("x")).first().x
    assert got == ["Café 'N' €", "a &lt;", "&nosuch; ©", None]


def test_prose_between_fragments_of_reasoning_does_not_break_them(spark):
    events = spark.createDataFrame([("s", k, kind, c) for k, (kind, c) in enumerate([("reasoning", "a"), ("message", "m"), ("status", ""), ("reasoning", "b"), ("tool", "t"), ("reasoning", "c"), ("error", "e")])], "session string, seq int, kind string, content string")
    assert [(r.kind, r.content) for r in T.merged_runs(events, F.col("kind")).orderBy("step").collect()] == [("reasoning", "ab"), ("tool", "t"), ("reasoning", "c"), ("error", "e")]


def test_mapper_of_raw_events():
    m = TurnMapper()
    assert m.feed("text_full", None, " whole ", False) == [("text", "whole")]
    assert m.feed("text_delta", None, "", False) == [] and m.feed("text_full", None, "x", False) == [("text", "x")]
    assert m.feed("text_delta", None, "a", False) == [("text", "a")] and m.feed("text_full", None, "x", False) == []
    assert m.feed("tool", "1", "t" * 400, False) == [("tool", "t" * 300)] and m.feed("tool", "1", "t", False) == []
    assert m.feed("result", None, "", False) == [("status", "complete")] and m.feed("result", None, " why ", True) == [("error", "why")] and m.feed("other", None, "x", False) == []


def test_windows_over_a_stream(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e")
    q = counts_by_window(stream).writeStream.format("memory").queryName("by_window").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.start, r.event_type): r.n for r in spark.table("by_window").collect()}
    want = {(r.start, r.event_type): r.n for r in events.groupBy(F.date_trunc("hour", "ts").alias("start"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_a_table_may_be_made_of_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.current(spark, path, "id bigint").count() == 0
    sinks.overwrite(spark.range(5), path)
    seen = sinks.current(spark, path)
    sinks.overwrite(seen.filter("id > 2"), path)
    assert sorted(r.id for r in sinks.current(spark, path).collect()) == [3, 4]
    assert seen.count() == 5  # who read the version before still can
    sinks.overwrite(sinks.current(spark, path).filter("id > 3"), path)
    assert [r.id for r in sinks.current(spark, path).collect()] == [4] and len(list((tmp_path / "t").glob("v-*"))) == 2


def test_a_table_whose_write_is_cut_off_stays(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    sinks.overwrite(spark.range(3), path)
    monkeypatch.setattr(sinks, "_move_over", lambda *_: (_ for _ in ()).throw(OSError("cut off")))
    with pytest.raises(OSError):
        sinks.overwrite(spark.range(9), path)
    monkeypatch.undo()
    assert sinks.current(spark, path).count() == 3
    sinks.overwrite(spark.range(4), path)
    assert sinks.current(spark, path).count() == 4 and len(list((tmp_path / "t").glob("v-*"))) == 2


def test_batches_are_appended_once(spark, tmp_path):
    path, rows = str(tmp_path / "t"), spark.createDataFrame([("s", 1, "b"), ("s", 1, "a"), ("s", 2, "b")], "session string, turn int, content string")
    write = sinks.turn_sink(path, order=("content",))
    rows.limit(1).write.parquet(f"{path}/batch=0")  # an attempt that was cut off before its marker
    assert sinks.read_ledger(spark, path, rows.schema).count() == 0
    for k in (0, 0, 1):
        write(rows, k)
    write(spark.createDataFrame([("s", 2, "again"), ("s", 3, "c")], rows.schema), 2)
    assert sinks.ledger(spark, path) == [0, 1, 2]
    assert sorted((r.batch, r.turn, r.content) for r in sinks.read_ledger(spark, path, rows.schema).collect()) == [(0, 1, "a"), (0, 2, "b"), (1, 1, "a"), (1, 2, "b"), (2, 2, "again"), (2, 3, "c")]
    once = sinks.read_ledger(spark, path, rows.schema, ("session", "turn"), ("content",)).collect()
    assert sorted((r.turn, r.content) for r in once) == [(1, "a"), (2, "b"), (3, "c")]


def test_a_batch_does_not_read_the_table(spark, tmp_path):
    """A table whose other batches can't be read any more takes a new one."""
    path, rows = str(tmp_path / "t"), spark.createDataFrame([("s", 1, "a")], "session string, turn int, content string")
    assert sinks.append_batch(rows, path, 0, ["session"], ["turn"])
    for f in (tmp_path / "t" / "batch=0").glob("*.parquet"):
        f.write_text("broken")
    assert sinks.append_batch(rows, path, 1, ["session"], ["turn"]) and not sinks.append_batch(rows, path, 1, ["session"], ["turn"])


def test_fields_are_replaced_in_place(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k int, name string, created_at int")
    new = spark.createDataFrame([(2, None, 99), (3, "c", 99)], old.schema)
    assert sorted(tuple(r) for r in S.replace_fields(old, new, "k", ["name"]).collect()) == [(1, "a", 10), (2, None, 20)]
    assert sorted(tuple(r) for r in S.stamped(old, new, "k", "created_at", 7).collect()) == [(1, "a", 10), (2, "b", 7)]


def test_a_label_of_two_groups_is_the_later_code(spark):
    assert one(spark, D.type_code(F.lit(" Cluster House "))) == "LCLUS" and one(spark, D.type_code(F.lit("CLUS"))) == "CLUS"
    assert one(spark, D.group_of(F.lit("X"), F.lit("4 standard"))) == "H" and one(spark, D.group_of(F.lit(None).cast("string"), F.lit("?"))) == "N"
    assert len(D.ALL_TYPES) == sum(map(len, D.TYPES.values())) and len(D.DISTRICTS) == 28 and sorted(n for r in D.REGIONS.values() for n in r) == list(range(1, 29))


def test_land_only(spark):
    for group, types, want in (("L", ["RLAND"], True), ("L", ["RLAND", "SEMI"], False), ("L", [], False), ("N", ["RLAND"], False)):
        assert one(spark, M.is_land_only(F.lit(group), F.array(*map(F.lit, types)).cast("array<string>"))) is want


def test_sites_keep_their_contract():
    assert site() is site("islands")
    assert all(callable(getattr(site(), n)) for n in vars(PageSource) if not n.startswith("_") and n != "marker") and site().marker
    with pytest.raises(ValueError):
        site("other")


@pytest.mark.parametrize("typed, shown", [("1200000", "1,200,000"), ("S$ 1.2.5", "1.25"), ("1234.", "1,234."), (".5", ".5"), ("abc", "")])
def test_typed_digits(spark, typed, shown):
    assert one(spark, X.grouped_digits(X.digits_and_point(F.lit(typed)))) == shown
