"""Keyed tables: upserts, deletes, expiry, and folds of event logs. All are joins or aggregations of whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The old rows without the new keys, and the new rows."""
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new)


def upsert_with_tombstones(old: DataFrame, records: DataFrame, failed: DataFrame, key: str, now: int) -> DataFrame:
    """Records replace rows; a failure replaces a row by one that has only the time it failed."""
    good = records.withColumn("updated_at", F.lit(now).cast("bigint")).withColumn("failed_at", F.lit(None).cast("bigint"))
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in records.schema if f.name != key]
    bad = failed.select(key, *nothing, F.lit(None).cast("bigint").alias("updated_at"), F.lit(now).cast("bigint").alias("failed_at"))
    new = good.join(failed.select(key), key, "left_anti").select(*old.columns).unionByName(bad.select(*old.columns))
    return upsert(old, new, key)


def refused(old: DataFrame, new: DataFrame, key: str, cap: int) -> DataFrame:
    """Rows of ``new`` that a store of at most ``cap`` keys can't take: new keys, the greatest first, that have no room."""
    return new.join(capped_upsert(old, new, key, cap, refuse=False).select(key), key, "left_anti").select(*new.columns)


def capped_upsert(old: DataFrame, new: DataFrame, key: str, cap: int, refuse: bool = True) -> DataFrame:
    """Rows of known keys are replaced; new keys come in, least key first, while fewer than ``cap`` keys are there.

    A key for which there is no room is an error when the result is read, so nothing that was to be kept vanishes; with ``refuse`` false such rows
    are left out, and ``refused`` has them."""
    room = old.agg(F.greatest(F.lit(cap) - F.count("*"), F.lit(0)).alias("room"))
    known = new.join(old.select(key), key, "left_semi").select(*old.columns)
    unknown = new.join(old.select(key), key, "left_anti").select(*old.columns)
    fits = unknown.orderBy(key).limit(cap).withColumn("__n", F.row_number().over(Window.orderBy(key))).crossJoin(F.broadcast(room)).filter("__n <= room").select(*old.columns)  # at most cap rows
    stored = upsert(old, known.unionByName(fits), key)
    if not refuse:
        return stored
    # the plan fails by itself when it is read, so nothing runs before; one row says whether a key has no room
    left = unknown.join(fits.select(key), key, "left_anti").agg(F.min(key).alias("__key"))
    full = F.raise_error(F.concat(F.lit(f"the store is full: {cap} keys are there, and "), F.col("__key").cast("string"), F.lit(" is new")))
    refusal = left.filter(F.when(F.col("__key").isNotNull(), full).cast("boolean"))  # no row, or the error
    return stored.unionByName(refusal.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in old.schema)))


def replace_fields(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """The old rows, with ``fields`` from the new row of the same key; other columns (such as the time of creation) stay, and
    new rows of unknown keys are ignored."""
    spare = [f"__new_{f}" for f in fields]
    got = old.join(new.select(key, *(F.col(f).alias(s) for f, s in zip(fields, spare, strict=True)), F.lit(True).alias("__there")), key, "left")
    new_of = dict(zip(fields, spare, strict=True))
    return got.select(*(F.when(F.col("__there"), F.col(new_of[c])).otherwise(F.col(c)).alias(c) if c in new_of else F.col(c) for c in old.columns))


def stamped(old: DataFrame, keys: DataFrame, key: str, field: str, now: int) -> DataFrame:
    """The old rows, with ``now`` in ``field`` where the key is among ``keys``."""
    return replace_fields(old, keys.select(key).distinct().withColumn(field, F.lit(now).cast("bigint")), key, [field])


def stamped_by_jobs(saved: DataFrame, jobs: DataFrame, key: str, field: str, now: int, job_key: str = "saved_search_id", status: str = "status") -> DataFrame:
    """Saved searches, stamped where a job of theirs has succeeded; failed and cancelled jobs leave the stamp."""
    done = jobs.filter((F.col(status) == "succeeded") & F.col(job_key).isNotNull()).select(F.col(job_key).alias(key))
    return stamped(saved, done, key, field, now)


def newest_first(rows: DataFrame, key: str, created: str = "created_at", lists: Sequence[str] = ()) -> DataFrame:
    """Rows by their time of creation, newest first and those without one last; missing lists are empty."""
    filled = rows.select(*(F.coalesce(F.col(c), F.array()).alias(c) if c in lists else F.col(c) for c in rows.columns))
    return filled.orderBy(F.coalesce(F.col(created), F.lit(0)).desc(), key)


def stored_photos(wanted: DataFrame, photos: DataFrame, key: str, now: int, ttl: int, at: str = "captured_at") -> DataFrame:
    """The wanted keys with their photos, none where they are missing or too old."""
    current = photos.filter(fresh(now, ttl, at)).select(key, "photos")
    return wanted.join(current, key, "left").withColumn("photos", F.coalesce("photos", F.array().cast("array<string>")))


def delete(old: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of other keys; keys that aren't there don't matter."""
    return old.join(keys.select(key), key, "left_anti").select(*old.columns)


def fresh(now: int, ttl: int, at: str = "updated_at") -> Column:
    return F.coalesce(F.lit(now) - F.col(at) < F.lit(ttl), F.lit(False))


def is_current(now: int, ttl: int, schema_version: int) -> Column:
    return fresh(now, ttl) & F.coalesce(F.col("schema_version") >= schema_version, F.lit(False))


def cache_lookup(wanted: DataFrame, cache: DataFrame, key: str, now: int, ttl: int, failure_ttl: int, schema_version: int) -> tuple[DataFrame, DataFrame]:
    """Current records among the wanted keys, and keys that failed not long ago."""
    asked = cache.join(wanted.select(key).distinct(), key, "left_semi")
    return asked.filter(is_current(now, ttl, schema_version)), asked.filter(fresh(now, failure_ttl, "failed_at")).select(key)


def to_fetch(wanted: DataFrame, cache: DataFrame, key: str, now: int, ttl: int, failure_ttl: int, schema_version: int) -> DataFrame:
    """The wanted rows whose key has neither a current record nor a failure not long ago: one join with the cache."""
    known = cache.filter(is_current(now, ttl, schema_version) | fresh(now, failure_ttl, "failed_at")).select(key)
    return wanted.join(known, key, "left_anti")


def swept_results(results: DataFrame, jobs: DataFrame, key: str, now: int, ttl: int, created: str = "created_at") -> DataFrame:
    """Results of jobs that are there and not older than their time to live."""
    return results.join(swept(jobs, now, ttl, created).select(key), key, "left_semi")


def job_views(jobs: DataFrame, results: DataFrame, key: str, counters: Sequence[str], status: str = "status", n: str = "n") -> DataFrame:
    """Jobs with their counters (0 where missing) and the number of their results: only succeeded jobs show it, and one whose
    result is gone has expired."""
    done = F.col(status) == "succeeded"
    got = jobs.join(results.select(key, n), key, "left")
    return got.select(key, status, *(F.coalesce(c, F.lit(0)).alias(c) for c in counters), F.when(done, F.coalesce(n, F.lit(0))).otherwise(0).cast("bigint").alias("listings"), (done & F.col(n).isNull()).alias("expired"))


def fold_progress(events: DataFrame, key: str, phase: str, done: str, total: str) -> DataFrame:
    """The farthest that each phase of a job got: counters never go back, whatever the order of the events."""
    return events.groupBy(key, phase).agg(F.max(done).alias(done), F.max(total).alias(total))


def swept(jobs: DataFrame, now: int, ttl: int, created: str = "created_at") -> DataFrame:
    """Rows that aren't older than their time to live."""
    return jobs.filter(F.lit(now) - F.coalesce(F.col(created), F.lit(0)) < ttl)


def fold_patches(events: DataFrame, key: str, order: Sequence[str], fields: Sequence[str], marker: str = "set_fields") -> DataFrame:
    """The latest value of each field that an event says it sets; a field may be set to null on purpose."""
    at = F.struct(*order)
    latest = [F.max_by(F.struct(F.col(f)), F.when(F.array_contains(marker, f), at)).getField(f).alias(f) for f in fields]
    return events.groupBy(key).agg(*latest)


def fold_states(events: DataFrame, key: str, order: Sequence[str], terminal: Sequence[str], state: str = "status") -> DataFrame:
    """A job's state: its first terminal one, or else its latest; and how many events it has."""
    at = F.struct(*order)
    ended = F.col(state).isin(*terminal)
    return events.groupBy(key).agg(
        F.coalesce(F.min_by(F.col(state), F.when(ended, at)), F.max_by(F.col(state), at)).alias(state), F.max(ended).alias("ended"), F.count("*").alias("events")
    )


def first_appearance(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def newest_names(entries: DataFrame, key: str, order: Sequence[str], name: str) -> DataFrame:
    """Entries by property: the newest one names it; least price, number, and newest time."""
    return entries.groupBy(key).agg(
        F.max_by(F.col(name), F.struct(*order)).alias(name),
        F.coalesce(F.min(F.nullif(F.col("price"), F.lit(0))), F.lit(0)).cast("bigint").alias("price_min"),
        F.count("*").alias("unit_count"),
        F.max("created_at").alias("shortlisted_at"),
    )
