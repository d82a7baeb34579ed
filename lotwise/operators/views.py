"""Views of a result set: facets, map filters and pins, hidden and bookmarked entries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import SECONDS_PER_DAY, entity_key, projected

#: The choices of "posted within so many days".
DAY_CHOICES = (3, 7, 14, 31)


def facet_values(rows: DataFrame, facets: dict[str, Column], by: str | None = "grp") -> DataFrame:
    """One row a facet value: all facets in one pass over the rows, with how many rows have the value."""
    keys = [by] if by else []
    entries = F.array(*(F.struct(F.lit(name).alias("facet"), c.cast("string").alias("value")) for name, c in facets.items()))
    return rows.select(*keys, F.inline(entries)).filter("value is not null").groupBy(*keys, "facet", "value").agg(F.count("*").alias("n"))


def facet_bounds(rows: DataFrame, columns: Sequence[str], groups: DataFrame, by: str = "grp") -> DataFrame:
    """Least and greatest finite values of each group; groups without rows are there too."""
    stats = [f(F.when(~F.isnan(F.col(c).cast("double")), F.col(c))).alias(f"{c}_{n}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    return groups.select(by).join(rows.groupBy(by).agg(*stats), by, "left")


def posted_buckets(rows: DataFrame, now: int, choices: Sequence[int] = DAY_CHOICES) -> DataFrame:
    """How many rows each choice of days takes in: a row is in all choices from its own age up."""
    age = F.filter(F.lit(list(choices)), lambda d: F.col("listed_at") >= F.lit(now) - d * SECONDS_PER_DAY)
    return rows.select(F.explode(age).alias("days")).groupBy("days").agg(F.count("*").alias("n"))


def placed(rows: DataFrame, anchors: DataFrame, min_lng: float, max_lat: float, scale: float) -> DataFrame:
    """Points: a row's own coordinates, else its district's anchor (``approximate``), else none."""
    x, y = projected(F.col("longitude"), F.col("latitude"), min_lng, max_lat, scale)
    finite = F.col("longitude").isNotNull() & F.col("latitude").isNotNull() & ~F.isnan("longitude") & ~F.isnan("latitude")
    got = rows.join(anchors.select("district", "anchor_x", "anchor_y"), "district", "left")
    return got.select(
        *rows.columns,
        F.when(finite, x).otherwise(F.col("anchor_x")).alias("x"),
        F.when(finite, y).otherwise(F.col("anchor_y")).alias("y"),
        (~finite & F.col("anchor_x").isNotNull()).alias("approximate"),
    )


def map_filter(points: DataFrame, selected: Sequence[str] = (), viewport: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Rows that the map shows. A row without a point is never dropped; the selection and the box (closed) both count,
    each only if it is set."""
    ok = F.lit(True)
    if selected:
        ok = ok & F.coalesce(F.col("district").isin(*selected), F.lit(False))
    if viewport:
        ok = ok & F.col("x").between(viewport[0], viewport[2]) & F.col("y").between(viewport[1], viewport[3])
    return points.filter(F.col("x").isNull() | ok)


def pin_clusters(points: DataFrame, dimmed: Column) -> DataFrame:
    """Pins at small scale: one a district at the mean of its points, dimmed if all are; rows without a district stay alone."""
    seen = points.filter("x is not null").withColumn("dimmed", dimmed)
    means = seen.filter("district is not null").groupBy("district").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"), F.bool_and("dimmed").alias("dimmed"))
    loose = seen.filter("district is null").select("district", "x", "y", F.lit(1).cast("bigint").alias("n"), "dimmed")
    return means.unionByName(loose)


def hidden_entities(here: DataFrame, always: DataFrame) -> DataFrame:
    """Entries hidden in this search or for good, each once."""
    return here.select("scope", "id").union(always.select("scope", "id")).distinct()


def without_hidden(props: DataFrame, hidden: DataFrame) -> DataFrame:
    ids = hidden.filter("scope = 'property'").select(F.col("id").alias("property_key"))
    return props.join(ids, "property_key", "left_anti")


def entries_in_results(entries: DataFrame, units: DataFrame) -> DataFrame:
    """Entries that the results still have, matched by their keys."""
    keys = units.select(F.explode(F.array(entity_key(F.lit("property"), F.col("property_key")), entity_key(F.lit("unit"), F.col("listing_id").cast("string")))).alias("entity_key")).distinct()
    return entries.withColumn("entity_key", entity_key(F.col("scope"), F.col("id"))).join(keys, "entity_key", "left_semi")


def bookmarked_first(props: DataFrame, bookmarks: DataFrame, order: Sequence[str]) -> DataFrame:
    """Bookmarked properties first, each half in the order it had; sorted across the cluster."""
    marks = bookmarks.select(F.col("id").alias("property_key")).distinct().withColumn("__mark", F.lit(True))
    got = props.join(marks, "property_key", "left").withColumn("bookmarked", F.coalesce("__mark", F.lit(False))).drop("__mark")
    return got.orderBy(F.desc("bookmarked"), *order)


def new_first(units: DataFrame, new: Column, arrival: Sequence[str]) -> DataFrame:
    """Places within the property: new rows first, each half by price with missing prices last."""
    w = Window.partitionBy("property_key").orderBy(F.desc("is_new"), F.nullif(F.col("price"), F.lit(0)).asc_nulls_last(), *arrival)
    return units.withColumn("is_new", new).withColumn("place", F.row_number().over(w))


def markers(points: DataFrame, key: str = "property_key") -> DataFrame:
    """What a map draws: key, point, whether it stands at its district's anchor only, and the district; rows without a point go."""
    return points.filter("x is not null").select(F.col(key).alias("id"), "x", "y", F.col("approximate").alias("dimmed"), "district")


def facet_sets(rows: DataFrame, facets: dict[str, Column], groups: DataFrame, districts: Column, by: str = "grp") -> DataFrame:
    """Per group of ``groups``: the sorted values of each facet (none for a group without rows), and the districts of all groups
    together. A facet has as many values as its list of choices, so the sets are small."""
    lists = rows.groupBy(by).agg(*(F.array_sort(F.collect_set(c.cast("string"))).alias(n) for n, c in facets.items()), F.lit(True).alias("present"))
    shared = rows.agg(F.array_sort(F.collect_set(districts)).alias("districts"))
    empty = F.array().cast("array<string>")
    got = groups.select(by).join(lists, by, "left").crossJoin(F.broadcast(shared))  # one row
    return got.select(by, *(F.coalesce(n, empty).alias(n) for n in facets), "districts", F.coalesce("present", F.lit(False)).alias("present"))


def active_filters(forms: DataFrame, key: str, set_fields: Column, on: Column, districts: Column) -> DataFrame:
    """Filters in use of each result view: the set fields of groups that are on, one if any group is off, one if districts are
    chosen. ``forms`` has a row a group that the results have."""
    return forms.groupBy(key).agg((F.sum(F.when(on, set_fields).otherwise(0)) + F.max((~on).cast("int")) + F.max((districts > 0).cast("int"))).cast("bigint").alias("active"))
