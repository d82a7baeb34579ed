"""A search from its request to its published result: ends of all kinds, what stays after each, counters, and cancelling between and inside stages."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from lotwise import runs
from lotwise.operators import stores as S
from lotwise.runs import RECORD, Run, Stores

NOW = 1_000_000_000


def page(total, *cards):
    data = {"listingsData": [{"listingData": {"id": i, "price": {"value": p}, "property": {"id": k}, "floorArea": 50, "bedrooms": b, "mediaCarousel": {"previewMedia": {"images": {"items": [{"src": f"{i}.jpg"}] * (i % 2)}}}}} for i, p, k, b in cards], "paginationData": {"totalPages": total}}
    return f'<script id="__NEXT_DATA__" type="application/json">{json.dumps({"props": {"pageProps": {"pageData": {"data": data}}}})}</script>'


def project(year):
    return f'<tr class="property-attr"><td class="label-block">Completion Year</td><td class="value-block">{year}</td></tr>'


REQUEST = {"searches": [{"propertyTypeGroup": "N", "maxPages": 2, "filters": {"minPrice": 15, "maxTop": 2010}}, {"propertyTypeGroup": "H"}]}
FETCHED = [("N", 1, page(3, (1, 10, 7, 1), (2, 20, 7, 2), (3, 30, 8, 1))), ("N", 2, page(3, (4, 40, 9, 1), (2, 99, 7, 1))), ("N", 3, page(3, (6, 60, 7, 1))), ("H", 1, page(1, (5, 50, 5, 3), (3, 31, 8, 1)))]
PROJECTS = [("7", project(2000)), ("8", project(2015)), ("5", ""), ("66", project(1))]


@pytest.fixture
def stores(spark, tmp_path):
    s = Stores(spark, str(tmp_path / "home"))
    s.put("records", spark.createDataFrame([("9", 2, 1999, "F", None, None, NOW - 10, None), ("5", 1, None, None, None, None, NOW - 10, None)], RECORD))
    s.put("saved", spark.createDataFrame([("a", 1), ("b", 2)], runs.SAVED))
    return s


def start(stores, job="j", request=REQUEST, fetched=FETCHED, **more):
    spark = stores.spark
    return Run(stores, job, request, spark.createDataFrame(fetched, "grp string, page int, html string"), spark.createDataFrame(PROJECTS, "property_id string, html string"), NOW, "a", **more)


def records(stores):
    return {r.property_id: (r.schema_version, r.top_year, r.updated_at, r.failed_at) for r in stores.table("records", RECORD).collect()}


def saved(stores):
    return {r.saved_search_id: r.last_run_at for r in stores.table("saved", runs.SAVED).collect()}


def test_a_run_that_succeeds(stores):
    run = start(stores)
    assert run.run() == "succeeded"
    result = {r.property_key: r for r in stores.result("j").collect()}
    # 8 is too new for its group; 5 has no page, so it is there without facts
    assert {k: (r.grp, r.unit_count, r.top_year, r.enrichment) for k, r in result.items()} == {"7": ("N", 1, 2000, "ok"), "9": ("N", 1, 1999, "ok"), "5": ("H", 1, None, "unavailable")}
    (job,) = stores.jobs().collect()
    assert (job.status, job.pages_fetched, job.pages_total, job.pages_scanned, job.total_pages, job.truncated, job.listing_count) == ("succeeded", 3, 3, 3, 4, True, 4)
    assert (job.details_fetched, job.details_total, job.property_count, job.unit_count) == (2, 3, 3, 3)
    assert records(stores) == {"9": (2, 1999, NOW - 10, None), "7": (2, 2000, NOW, None), "8": (2, 2015, NOW, None), "5": (None, None, None, NOW)}
    assert saved(stores) == {"a": NOW, "b": 2}
    assert sorted((r.listing_id, r.photos) for r in stores.table("photos", runs.PHOTO).collect()) == [(3, ["3.jpg"]), (5, ["5.jpg"])]
    assert result["5"].unit_types[0].units[0].photo_count == 1


def test_counts_during_a_run_are_those_after_it(stores):
    run = start(stores)
    run.run()
    assert run.observed["pages"] == {"pages": 4, "cards": 8} and run.observed["listings"] == {"listings": 4} and run.observed["missing"]["missing"] == 3
    assert run.observed["result"] == {"properties": stores.result("j").count(), "units": 3}
    events = stores.events()
    folded = {r.job_id: r for r in S.fold_progress(events.withColumn("phase", F.lit("detail")), "job_id", "phase", "details_fetched", "details_total").collect()}
    assert (folded["j"].details_fetched, folded["j"].details_total) == (2, 3)


def test_a_second_run_is_warm_and_jobs_stay_apart(stores):
    start(stores).run()
    assert start(stores, "k").run() == "succeeded"
    jobs = {r.job_id: r for r in stores.jobs().collect()}
    assert jobs["k"].details_total == 0 and jobs["k"].property_count == jobs["j"].property_count
    assert stores.result("k").count() == 3 and stores.result("j").count() == 3


@pytest.mark.parametrize("request_, why", [({"searches": [{"propertyTypeGroup": "Z"}]}, "propertyTypeGroup"), ({"searches": [{"propertyTypeGroup": "N", "filters": {"minPrice": 2, "maxPrice": 1}}]}, "minPrice: range")])
def test_a_bad_request_fails_before_anything_is_read(stores, request_, why):
    assert start(stores, request=request_).run() == "failed"
    (job,) = stores.jobs().collect()
    assert why in job.error and job.pages_total is None and records(stores)["5"][0] == 1 and saved(stores)["a"] == 1


def test_a_missing_first_page_fails_and_publishes_nothing(stores):
    assert start(stores, fetched=FETCHED[1:]).run() == "failed"
    (job,) = stores.jobs().collect()
    assert "no first page" in job.error and saved(stores)["a"] == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        stores.result("j")


@pytest.mark.parametrize("after", range(4))
def test_cancelled_between_stages(stores, after):
    """A job that is cancelled while it waits reads nothing; later the records that it has paid for stay. Nothing is published."""
    asked = []

    def stop():
        asked.append(1)
        return len(asked) > after

    assert start(stores, should_stop=stop).run() == "cancelled"
    (job,) = stores.jobs().collect()
    assert job.status == "cancelled" and (job.pages_total is None) == (after == 0) and (job.details_total is None) == (after < 2)
    assert ("7" in records(stores)) == (after >= 2) and saved(stores)["a"] == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        stores.result("j")


def test_cancelled_inside_a_stage(stores):
    """Jobs of Spark that are under way end by their tag; other jobs of the session don't."""
    flag, ended = threading.Event(), []
    slow = stores.spark.range(0, 8, 1, 4).select(F.lit("N").alias("grp"), F.col("id").cast("int").alias("page"), F.expr("java_method('java.lang.Thread', 'sleep', 3000L)").alias("html"))
    run = start(stores, should_stop=flag.is_set)
    run.fetched = slow
    thread = threading.Thread(target=lambda: ended.append(run.run()))
    thread.start()
    until = time.time() + 60
    while not flag.is_set() and time.time() < until:
        time.sleep(0.5)
        if stores.spark.sparkContext.statusTracker().getActiveJobsIds() and len(stores.events().collect()) == 1:
            flag.set()
            while thread.is_alive() and time.time() < until:
                run.stop()
                thread.join(0.3)
    thread.join(60)
    assert ended == ["cancelled"] and stores.jobs().first().status == "cancelled" and stores.spark.range(3).count() == 3
