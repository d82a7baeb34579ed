"""Rules about missing values, rounding, order and time that are easy to get wrong."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lotwise.functions import scalars as X
from lotwise.operators import listings as L
from lotwise.operators import stores as S
from lotwise.operators import transcripts as T
from lotwise.operators import views as V
from lotwise.sources import pages as P
from lotwise.sources.tables import json_store, source
from lotwise.streaming.acts import ActionSplitter

LISTING = "listing_id bigint, property_id string, name string, address string, price bigint, bedrooms bigint, floor_area bigint, psf bigint, district string, tenure_code string, property_type string, developer string, grp string, listed_at bigint"


def listing(i, **more):
    base = dict(listing_id=i, property_id="p", name="n", address="", price=100, bedrooms=1, floor_area=10, psf=10, district="D01", tenure_code="F", property_type="CONDO", developer="d", grp="N", listed_at=i)
    return tuple((base | more)[c.split()[0]] for c in LISTING.split(", "))


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)]).select(column.alias("x")).first().x


@pytest.mark.parametrize("text, number", [("1,238 units", 1238), ("2.5", 2), ("3.5", 4), ("-7", -7), ("none", None), ("", None), ("S$ 1,161.55 psf", 1162)])
def test_to_integer(spark, text, number):
    assert one(spark, X.to_integer(F.col("t")), t=text) == number


def test_missing_values_pass_tolerant_checks_and_fail_strict_ones(spark):
    df = spark.createDataFrame([(None,), (5,), (50,)], "v int")
    low, high = F.lit(1), F.lit(10)
    assert [r.v for r in df.filter(X.in_range_tolerant(F.col("v"), low, high)).collect()] == [None, 5]
    assert [r.v for r in df.filter(X.in_range_strict(F.col("v"), 1, 10)).collect()] == [5]
    assert df.filter(X.in_range_strict(F.col("v"), None, None)).count() == 3


def test_missing_and_zero_bedrooms_are_one_type_and_zero_is_ignored(spark):
    rows = spark.createDataFrame([listing(1, bedrooms=None, floor_area=0), listing(2, bedrooms=0, floor_area=30, price=0), listing(3, bedrooms=0, floor_area=41)], LISTING)
    got = L.unit_types(rows).collect()
    assert len(got) == 1 and got[0].unit_count == 3 and got[0].sqft_min == 30 and got[0].typical_sqft == 36 and got[0].price_min == 100
    assert got[0].label == "Studio or unlisted"


def test_first_arrival_wins(spark):
    rows = spark.createDataFrame([listing(7, listed_at=3, name="late"), listing(7, listed_at=1, name="early")], LISTING)
    assert [r.name for r in L.first_by_arrival(rows, ["listing_id"], ["listed_at"]).collect()] == ["early"]


def test_listings_without_a_property_stand_alone_and_go_by_address(spark):
    rows = spark.createDataFrame([listing(1, property_id="", address="1 Road"), listing(2, property_id=""), listing(3, property_id="", name="")], LISTING)
    got = {r.property_key: r.name for r in L.properties(rows, ["listed_at"]).collect()}
    assert got == {"listing:1": "1 Road", "listing:2": "n", "listing:3": "Unknown property"}


def test_a_group_without_filters_passes_whole(spark):
    rows = spark.createDataFrame([listing(1, grp="X", price=9), listing(2, price=9), listing(3, price=None), listing(4, district=None)], LISTING)
    filters = spark.createDataFrame([("N", 50, None, None, None, None, None, ["D01"])], "grp string, min_price bigint, max_price bigint, min_size bigint, max_size bigint, min_psf bigint, max_psf bigint, districts array<string>")
    assert sorted(r.listing_id for r in L.recheck(rows, filters).collect()) == [1, 3, 4]


def test_property_with_all_units_hidden_stays(spark):
    units = spark.createDataFrame([("a", 1, 5), ("b", 2, 5), ("c", 3, 50)], "property_key string, listing_id bigint, price bigint")
    hidden = spark.createDataFrame([(1,)], "listing_id bigint")
    got = L.two_level(units, F.lit(True), F.col("price") > 10, hidden)
    assert sorted(r.property_key for r in got.collect()) == ["a", "c"]


def test_map_keeps_rows_without_a_point_and_box_is_closed(spark):
    points = spark.createDataFrame([("a", None, None, None), ("b", None, 1.0, 1.0), ("c", "D01", 2.0, 2.0), ("d", "D02", 2.0, 2.0)], "k string, district string, x double, y double")
    assert sorted(r.k for r in V.map_filter(points, ("D01",)).collect()) == ["a", "c"]
    assert sorted(r.k for r in V.map_filter(points, viewport=(2.0, 2.0, 3.0, 3.0)).collect()) == ["a", "c", "d"]
    assert V.map_filter(points).count() == 4


def test_tombstone_erases_a_good_record_and_ttl_is_strict(spark):
    old = spark.createDataFrame([("a", 1, 90, None), ("b", 1, 80, None)], "k string, schema_version int, updated_at bigint, failed_at bigint")
    records, failed = spark.createDataFrame([("b", 2)], "k string, schema_version int"), spark.createDataFrame([("a",)], "k string")
    got = {r.k: (r.schema_version, r.updated_at, r.failed_at) for r in S.upsert_with_tombstones(old, records, failed, "k", 100).collect()}
    assert got == {"a": (None, None, 100), "b": (2, 100, None)}
    assert old.filter(S.fresh(100, 10)).count() == 0 and old.filter(S.fresh(100, 11)).count() == 1


def test_capped_upsert_replaces_known_keys_when_full(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c"), (4, "d")], "k int, v string")
    assert {r.k: r.v for r in S.capped_upsert(old, new, "k", 4).collect()} == {1: "a", 2: "B", 3: "c", 4: "d"}
    for cap, fit, left in ((3, {1: "a", 2: "B", 3: "c"}, [4]), (2, {1: "a", 2: "B"}, [3, 4])):
        full = S.capped_upsert(old, new, "k", cap)  # nothing runs before it is read
        for read in (full.collect, full.count):
            with pytest.raises(Exception, match="the store is full: .* and [34] is new"):
                read()
        assert {r.k: r.v for r in S.capped_upsert(old, new, "k", cap, refuse=False).collect()} == fit
        assert sorted(r.k for r in S.refused(old, new, "k", cap).collect()) == left
    with pytest.raises(Exception, match="the store is full: 0 keys"):
        S.capped_upsert(old.limit(0), new, "k", 0).count()


def test_first_terminal_state_wins_and_null_patches_count(spark):
    jobs = spark.createDataFrame([(1, 1, "queued"), (1, 2, "cancelled"), (1, 3, "succeeded"), (2, 1, "queued"), (2, 2, "scraping")], "job int, seq int, status string")
    assert {r.job: r.status for r in S.fold_states(jobs, "job", ["seq"], ("succeeded", "failed", "cancelled")).collect()} == {1: "cancelled", 2: "scraping"}
    patches = spark.createDataFrame([(1, 1, "x", ["note"]), (1, 2, None, ["note"]), (1, 3, "z", [])], "job int, seq int, note string, set_fields array<string>")
    assert S.fold_patches(patches, "job", ["seq"], ["note"]).first().note is None


def test_runs_and_separators(spark):
    events = spark.createDataFrame([("s", 1, "reasoning", "a"), ("s", 2, "tool", "t"), ("s", 3, "reasoning", "b"), ("s", 4, "reasoning", "c")], "session string, seq int, kind string, content string")
    got = [(r.kind, r.content) for r in T.merged_runs(events, F.col("kind")).orderBy("step").collect()]
    assert got == [("reasoning", "a"), ("tool", "t"), ("reasoning", "bc")]
    prose = spark.createDataFrame([("s", 1, "message", "a"), ("s", 2, "status", ""), ("s", 3, "message", "b"), ("s", 4, "tool", ""), ("s", 5, "message", "c")], "session string, seq int, kind string, content string")
    assert [r.piece for r in T.separated(prose).orderBy("seq").collect()] == ["a", "b", "\n\nc"]


ACTS = "Hi <b>x</b> a < b and more <ACT>{1}</act> then <act>{2}</Act> <unknowntag> end <ac"


@pytest.mark.parametrize("cut", range(0, len(ACTS), 3))
def test_splitting_does_not_depend_on_chunks(cut):
    splitter = ActionSplitter()
    pieces = splitter.feed(ACTS[:cut]) + splitter.feed(ACTS[cut:]) + splitter.drain()
    assert "".join(c for k, c in pieces if k == "message") == "Hi <b>x</b> a < b and more  then  <unknowntag> end <ac"
    assert [c for k, c in pieces if k == "action"] == ["{1}", "{2}"]


def test_batch_splitting_equals_the_state_machine(spark):
    chunks = [ACTS[i : i + 7] for i in range(0, len(ACTS), 7)]
    events = spark.createDataFrame([("s", i, "text", c) for i, c in enumerate(chunks)] + [("s", 99, "tool", "t"), ("s", 100, "text", "open <act>half")], "session string, seq int, kind string, content string")
    got = T.split_actions(events).orderBy("run", "piece").collect()
    assert "".join(r.content for r in got if r.kind == "message") == "Hi <b>x</b> a < b and more  then  <unknowntag> end <acopen "
    assert [r.content for r in got if r.kind == "action"] == ["{1}", "{2}", "half"]


def test_search_pages_with_broken_or_missing_data(spark):
    good = '<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"pageData":{"data":{"listingsData":[{"listingData":{"id":5,"price":{"value":"1,250,000"},"floorArea":100,"products":{"isPromotedListing":true},"mediaCarousel":{"previewMedia":{"images":{"items":[{"src":"a"},{"caption":"x"}]}}}},"segment":null},{"kevel":"k","listingData":{"id":6}},{"listingData":{"id":7,"price":{"value":0}}}],"paginationData":{"totalPages":"12"}}}}}}</script>'
    pages = spark.createDataFrame([(1, good), (2, "<html></html>"), (3, '<script id="__NEXT_DATA__" type="application/json">{bad</script>'), (4, None)], "page_id int, html string")
    got = P.listings(pages).collect()
    assert [(r.page_id, r.listing_id, r.price, r.psf, r.photos, r.property_id) for r in got] == [(1, 5, 1250000, 12500, ["a"], "")]
    assert [r.n for r in pages.select(P.total_pages(F.col("html")).alias("n")).collect()] == [12, 0, 0, 0]


def test_a_value_of_another_type_costs_itself_only(spark):
    """Neither its page nor the cards beside it are lost; a missing key and a null are both none."""
    import json

    base = {"price": {"value": "1,250"}, "floorArea": 100, "bedrooms": 2}
    card = lambda i, **more: {"listingData": base | {"id": i} | more}
    odd = [
        card(6, property="x"), card(7, agent=5, postedOn=[1]), card(8, products={"isPromoted": "no"}), card(9, mediaCarousel={"previewMedia": {"images": {"items": {"src": "a"}}}}), card(10) | {"segment": "s"}, card(11, bedrooms=None),
        "card", 5, None, {"listingData": "x"}, [], card(12, price=77),
    ]
    page = lambda cards, **more: '<script id="__NEXT_DATA__" type="application/json">' + json.dumps({"props": {"pageProps": {"pageData": {"data": {"listingsData": cards, "paginationData": {"totalPages": 12}} | more}}}}) + "</script>"
    rows = [(k, page([card(1), x, card(99)])) for k, x in enumerate(odd)] + [(50, page([card(1)], paginationData="x")), (51, page({"a": 1})), (52, page(None)), (53, page([*odd, card(99)]))]
    pages = spark.createDataFrame(rows, "page_id int, html string")
    got: dict = {}
    for r in P.listings(pages).collect():
        got.setdefault(r.page_id, []).append((r.listing_id, r.bedrooms))
    for k in range(len(odd)):
        own = [(6 + k, None if k == 5 else 2)] if k < 6 else []
        assert got[k] == [(1, 2), *own, (99, 2)], odd[k]
    assert got[50] == [(1, 2)] and 51 not in got and 52 not in got and [i for i, _ in got[53]] == [6, 7, 8, 9, 10, 11, 99]
    totals = {r.page_id: r.n for r in pages.select("page_id", P.total_pages(F.col("html")).alias("n")).collect()}
    assert totals[0] == totals[6] == totals[53] == 12 and totals[50] == 0
    assert {(r.page_id, r.total, len(r.cards)) for r in P.parsed_pages(pages.filter("page_id in (6, 53)"), ("page_id",)).collect()} == {(6, 12, 2), (53, 12, 7)}


def test_project_page_facts(spark):
    row = '<tr class="property-attr"><td class="label-block">{}</td><td class="value-block">{}</td></tr>'
    html = row.format("Completion Year", "N/A") + row.format("<h4>Total Units</h4>", "1,238") + row.format("Tenure", "a &amp; b") + row.format("Tenure", "c")
    html += '<meta property="place:location:latitude" content="1.3"><div id="map-canvas" x data-latitude="9.9" data-longitude="103.8">'
    got = P.projects(spark.createDataFrame([("p", html), ("q", None)], "property_id string, html string")).orderBy("property_id").collect()
    assert (got[0].top_year, got[0].total_units, got[0].tenure, got[0].latitude, got[0].photos) == (None, 1238, "c", None, [])
    assert (got[1].top_year, got[1].tenure, got[1].photos) == (None, "", [])


def test_missing_store_is_empty_and_broken_lines_go(spark, tmp_path):
    from pyspark.sql import types as T_

    schema = T_.StructType().add("k", "string").add("n", "long")
    assert json_store(spark, str(tmp_path / "none"), schema).count() == 0
    (tmp_path / "s.json").write_text('{"k":"a","n":1}\n{broken\n')
    assert [tuple(r) for r in json_store(spark, str(tmp_path / "s.json"), schema).collect()] == [("a", 1)]


def test_sources_by_name():
    assert source() is source("parquet")
    with pytest.raises(ValueError):
        source("other")


def test_empty_tables(spark):
    rows = spark.createDataFrame([], LISTING)
    assert L.unit_types(rows).count() == 0 and L.properties(rows, ["listed_at"]).count() == 0
    assert V.facet_values(rows, {"t": F.col("tenure_code")}).count() == 0


def test_requests_are_checked():
    from lotwise.functions.requests import checked_filters, checked_searches, whole_number

    assert whole_number(12.9) == 12 and whole_number("7") == 7 and whole_number(None) is None
    for bad in (True, -1, float("inf"), "12.7"):
        with pytest.raises(ValueError):
            whole_number(bad)
    assert checked_filters({"minPrice": 0, "bedrooms": [3], "isVerified": True, "sort": "price", "keyword": " a\n b "}) == {"minPrice": 0, "bedrooms": ["3"], "isVerified": True, "sort": "price", "order": "desc", "keyword": "a b"}
    for bad in ({"minPrice": 2, "maxPrice": 1}, {"bedrooms": ["x"] * 31}, {"sort": "other"}, {"districtCode": ["D 1"]}, {"bedrooms": [True]}, {"bedrooms": "3"}, {"bedrooms": ["_"]}, {"keyword": "x" * 101}, {"distanceToMrt": "2"}, {"isVerified": 1}, {"sort": 5}, []):
        with pytest.raises(ValueError):
            checked_filters(bad)
    assert checked_filters({"propertyTypeCode": ["APT"]}, "N")["propertyTypeCode"] == ["APT"]
    with pytest.raises(ValueError):
        checked_filters({"propertyTypeCode": ["APT"]}, "L")
    order = {"sort": "date", "order": "desc"}
    assert checked_searches({"maxPages": 0, "filters": {"minPsf": 5}}) == [{"propertyTypeGroup": "N", "maxPages": 0, "filters": {"minPsf": 5} | order}]
    assert [s["maxPages"] for s in checked_searches({"searches": [{"propertyTypeGroup": "H"}, {"propertyTypeGroup": "L", "maxPages": 25}]})] == [1, 10]
    for bad in ({"searches": []}, {"searches": [{"propertyTypeGroup": "H"}, {"propertyTypeGroup": "H"}]}, {"searches": [{"propertyTypeGroup": "Z"}]}):
        with pytest.raises(ValueError):
            checked_searches(bad)
