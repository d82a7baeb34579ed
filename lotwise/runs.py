"""A search from its request to its published result, as one run over captured pages.

A run checks the request, plans pages, scans them, drops repeats, re-checks filters, enriches properties from records and project pages, splits
photos off, groups, and publishes. Each stage stores what later stages share, writes events of its job, and asks whether the job was cancelled.
What a run has paid for stays: records of a cancelled or failed run are in the cache; its result is not published.

Stores below ``home``: ``jobs`` (events in a ledger), ``records`` (the cache of project records), ``photos``, ``saved`` (saved searches) and ``results``
(a folder a job).
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .functions.request_rules import FILTERS, check_request
from .operators import listings as L
from .operators import stores as S
from .operators.search_pages import scan_parsed
from .sources import sinks
from .sources.tables import dealt, shuffled, site

#: Times to live in seconds (records, failures, photos), and the version of records.
DAY = 86_400
RECORD_TTL, FAILURE_TTL, PHOTO_TTL, RECORD_VERSION = 30 * DAY, DAY, DAY, 2

COUNTERS = ("pages_fetched", "pages_total", "details_fetched", "details_total", "listing_count", "property_count", "unit_count", "pages_scanned", "total_pages")
EVENT = "job_id string, seq bigint, at bigint, status string, " + ", ".join(f"{c} bigint" for c in COUNTERS) + ", truncated boolean, error string, set_fields array<string>"
RECORD = "property_id string, schema_version int, top_year bigint, tenure string, latitude double, longitude double, updated_at bigint, failed_at bigint"
PHOTO = "listing_id bigint, photos array<string>, captured_at bigint"
SAVED = "saved_search_id string, last_run_at bigint"
FACTS = ["top_year", "tenure", "latitude", "longitude"]
ARRIVAL = ["place", "page", "pos"]
ENDED = ("succeeded", "failed", "cancelled")


class Cancelled(Exception):
    """The job was asked to stop."""


@dataclass
class Stores:
    """The stores of all runs below one folder."""

    spark: SparkSession
    home: str

    def table(self, name: str, schema: str) -> DataFrame:
        return sinks.current(self.spark, f"{self.home}/{name}", _schema(schema))

    def put(self, name: str, rows: DataFrame) -> None:
        sinks.overwrite(rows, f"{self.home}/{name}")

    def events(self) -> DataFrame:
        return sinks.read_ledger(self.spark, f"{self.home}/jobs", _schema(EVENT)).drop("batch")

    def jobs(self) -> DataFrame:
        """The job rows: the state by the first end or else the latest event, every field by the latest event that sets it."""
        events, order = self.events(), ["at", "seq"]
        states = S.fold_states(events.filter("status is not null"), "job_id", order, ENDED).select("job_id", "status")
        return states.join(S.fold_patches(events, "job_id", order, [*COUNTERS, "truncated", "error"]), "job_id")

    def result(self, job: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.home}/results/job_id={job}")


def _schema(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


def filter_rows(spark: SparkSession, searches: list[dict]) -> DataFrame:
    """The filters of a request as one row a group, as ``recheck`` and ``top_year_recheck`` take them."""
    names = {"min_price": "minPrice", "max_price": "maxPrice", "min_size": "minSize", "max_size": "maxSize", "min_psf": "minPsf", "max_psf": "maxPsf", "min_top": "minTop", "max_top": "maxTop"}
    assert set(names.values()) <= set(FILTERS)
    rows = [(s["grp"], *(s["filters"].get(n) for n in names.values()), s["filters"].get("districtCode")) for s in searches]
    return spark.createDataFrame(rows, "grp string, " + ", ".join(f"{c} bigint" for c in names) + ", districts array<string>")


class Run:
    """One job. ``fetched`` has the result pages (``grp``, ``page``, ``html``), ``projects`` the project pages (``property_id``, ``html``); ``now`` is in epoch
    seconds. ``should_stop`` is asked between the stages; all Spark jobs of a run have the tag ``run-<job>``, so ``stop`` ends a stage that runs."""

    def __init__(self, stores: Stores, job: str, request: dict, fetched: DataFrame, projects: DataFrame, now: int | None = None, saved_search: str | None = None, should_stop: Callable[[], bool] = lambda: False, source: str = "", record_ttl: int = RECORD_TTL, failure_ttl: int = FAILURE_TTL):
        self.stores, self.spark, self.job, self.request = stores, stores.spark, job, request
        self.fetched, self.projects, self.saved_search, self.should_stop = fetched, projects, saved_search, should_stop
        self.site, self.clock, self.now = site(source), now is None, int(time.time()) if now is None else now
        self.limits = (self.now, record_ttl, failure_ttl, RECORD_VERSION)
        self.seq, self.first_batch = 0, zlib.crc32(job.encode()) << 20  # numbers of a job's events in the ledger of all jobs
        self.kept: list[str] = []
        self.observed: dict[str, dict] = {}

    @property
    def tag(self) -> str:
        return f"run-{self.job}"

    def event(self, status: str | None = None, **fields) -> None:
        """Write an event of the job: a new status, or fields that are set, or both."""
        schema, path = _schema(EVENT), f"{self.stores.home}/jobs"
        while sinks.committed(self.spark, path, self.first_batch + self.seq):
            self.seq += 1  # of a run of the same job before
        row = {"job_id": self.job, "seq": self.seq, "at": int(time.time()) if self.clock else self.now, "status": status, "set_fields": list(fields)} | fields
        one = self.spark.createDataFrame([tuple(row.get(f.name) for f in schema)], schema)
        sinks.append_batch(one, path, self.first_batch + self.seq, ["job_id", "seq"], ["at"])
        self.seq += 1

    def check(self) -> None:
        if self.should_stop():
            raise Cancelled

    def stored(self, df: DataFrame, name: str, *metrics) -> DataFrame:
        """``df`` materialised once for all later stages; ``metrics`` are counted while it is written."""
        path = f"{sinks.scratch(self.spark)}/{name}"
        self.kept.append(path)
        if metrics:
            seen = Observation(f"{self.tag}-{name}")
            df.observe(seen, *metrics).write.parquet(path)
            self.observed[name] = seen.get
        else:
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def scan(self, searches: list[dict]) -> tuple[DataFrame, dict]:
        wanted = self.spark.createDataFrame([(s["grp"], s["most"], k) for k, s in enumerate(searches)], "grp string, most bigint, place int")
        parsed = self.stored(self.site.parsed(self.fetched.join(F.broadcast(wanted.select("grp")), "grp", "left_semi"), ("grp", "page")), "pages", F.count_if("found").alias("pages"), F.sum(F.size("cards")).alias("cards"))
        found, totals = scan_parsed(wanted, parsed)
        total = totals.first().asDict()
        self.event(pages_fetched=total["pages_scanned"], pages_total=total["pages_total"])
        listings = self.stored(L.recheck(found, filter_rows(self.spark, searches)), "listings", F.count(F.lit(1)).alias("listings"))
        return listings, total

    def enrich(self, listings: DataFrame) -> DataFrame:
        """Current records of the listings' properties; records that are missing come from project pages, and those and the failures go to the cache."""
        wanted = listings.filter("property_id <> ''").select("property_id").distinct()
        cache = shuffled(self.stores.table("records", RECORD))
        missing = self.stored(S.to_fetch(wanted, cache, "property_id", *self.limits), "missing", F.count(F.lit(1)).alias("missing"))
        total = self.observed["missing"]["missing"]
        self.event(details_fetched=0, details_total=total)
        if total:
            asked = shuffled(dealt(missing, "property_id"), "shuffle_hash")  # keys are looked up, so no page is sorted
            pages = self.site.projects(asked.join(self.projects.filter("html <> ''"), "property_id"), keep=("property_id",))
            fresh = shuffled(self.stored(pages.select("property_id", F.lit(RECORD_VERSION).alias("schema_version"), *FACTS), "fresh", F.count(F.lit(1)).alias("fresh")))
            failed = missing.join(fresh.select("property_id"), "property_id", "left_anti")
            self.stores.put("records", S.upsert_with_tombstones(cache, fresh, failed, "property_id", self.now))
            self.event(details_fetched=self.observed["fresh"]["fresh"], details_total=total)
        known, _ = S.cache_lookup(wanted, shuffled(self.stores.table("records", RECORD)), "property_id", *self.limits)
        return shuffled(known.select("property_id", *FACTS, F.lit(True).alias("found")))

    def keep_photos(self, listings: DataFrame) -> DataFrame:
        slim, photos = L.split_photos(listings)
        new = photos.withColumn("captured_at", F.lit(self.now).cast("bigint"))
        self.stores.put("photos", S.upsert(shuffled(self.stores.table("photos", PHOTO)).filter(S.fresh(self.now, PHOTO_TTL, "captured_at")), new, "listing_id"))
        return slim

    def tree(self, listings: DataFrame, records: DataFrame, searches: list[dict]) -> DataFrame:
        """The result: a row a property with its record's facts and its unit types, without the properties whose year doesn't match."""
        grouped = L.nested_properties(listings, ARRIVAL).drop("tenure")
        return L.top_year_recheck(L.enrich(grouped, records), filter_rows(self.spark, searches))

    def run(self) -> str:
        """Run all stages and return how the job ended; an error of a stage ends it as failed and isn't raised."""
        try:
            self.spark.addTag(self.tag)
            self.check()
            searches, problems = check_request(self.request)
            if problems:
                raise ValueError(problems[0])
            self.event("scraping")
            listings, total = self.scan(searches)
            self.check()
            self.event("enriching", listing_count=self.observed["listings"]["listings"])
            records = self.enrich(listings)
            self.check()
            slim = self.keep_photos(listings)
            result = self.stored(self.tree(slim, records, searches), "result", F.count(F.lit(1)).alias("properties"), F.sum("unit_count").alias("units"))
            self.check()
            sinks.write_results(result.withColumn("job_id", F.lit(self.job)), f"{self.stores.home}/results")
            done = self.observed["result"]
            self.event("succeeded", property_count=done["properties"], unit_count=done["units"] or 0, pages_scanned=total["pages_scanned"], total_pages=total["total_pages"], truncated=total["truncated"])
            if self.saved_search:
                saved = self.stores.table("saved", SAVED)
                key = self.spark.createDataFrame([(self.saved_search,)], "saved_search_id string")
                self.stores.put("saved", S.stamped(saved, key, "saved_search_id", "last_run_at", self.now))
            return "succeeded"
        except Cancelled:
            return self.end("cancelled")
        except Exception as e:  # every failure is the job's end
            if self.should_stop() or "cancelled" in str(e).lower():
                return self.end("cancelled")
            return self.end("failed", error=str(e)[-4000:])
        finally:
            self.spark.removeTag(self.tag)
            for path in self.kept:
                sinks.delete(self.spark, path)

    def end(self, status: str, **fields) -> str:
        self.spark.removeTag(self.tag)  # so that the event of a stopped run can be written
        self.event(status, **fields)
        return status

    def stop(self) -> None:
        """End the Spark jobs of the run that are under way, from another thread. With ``should_stop`` it ends as cancelled."""
        self.spark.interruptTag(self.tag)
