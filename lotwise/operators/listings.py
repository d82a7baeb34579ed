"""Listings: first-arrival deduplication, filters, grouping into properties and unit types, and ordering.

Spark has no arrival order, so the operators take it as a list of columns; it must be a total order for a fixed result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bathroom_chip, bedroom_chip, bedroom_label, first_of, half_even, in_range_strict, in_range_tolerant, posted_within, tenure_code, truthy

UNKNOWN = "Unknown property"


def first_by_arrival(rows: DataFrame, key: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """The first row of each key. The window is cut to one row a key before its shuffle, so a hot key costs no more."""
    w = Window.partitionBy(*key).orderBy(*arrival)
    return rows.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")


def usable(rows: DataFrame) -> DataFrame:
    """Rows with an id and a price; a price of 0 is none."""
    return rows.filter(F.coalesce(F.col("listing_id"), F.lit(0)) != 0).filter(F.coalesce(F.col("price"), F.lit(0)) != 0)


def property_key(property_id: Column, listing_id: Column) -> Column:
    return F.when(F.coalesce(property_id, F.lit("")) == "", F.concat(F.lit("listing:"), listing_id.cast("string"))).otherwise(property_id)


def property_name(key: Column, name: Column, address: Column) -> Column:
    """Listings without a property go by their address first."""
    own = F.when(key.startswith("listing:"), first_of(address, name)).otherwise(first_of(name))
    return first_of(own, F.lit(UNKNOWN))


def recheck(rows: DataFrame, filters: DataFrame, group: str = "grp") -> DataFrame:
    """Rows that nothing stated contradicts: each row is held against its own group's bounds and districts; a missing
    value passes, and a group without filters passes whole. ``filters`` has one row a group, which goes to all tasks."""
    got = rows.join(F.broadcast(filters.withColumnRenamed(group, "__group")), F.col(group) == F.col("__group"), "left")
    ok = F.lit(True)
    for value, low, high in (("price", "min_price", "max_price"), ("floor_area", "min_size", "max_size"), ("psf", "min_psf", "max_psf")):
        ok = ok & in_range_tolerant(F.col(value), F.col(low), F.col(high))
    open_district = F.coalesce(F.size("districts"), F.lit(0)) <= 0
    ok = ok & (open_district | (F.coalesce(F.col("district"), F.lit("")) == "") | F.array_contains("districts", F.col("district")))
    return got.filter(F.coalesce(ok, F.lit(True))).select(*rows.columns)


def top_year_recheck(rows: DataFrame, filters: DataFrame, group: str = "grp") -> DataFrame:
    """The same for a property's completion year."""
    got = rows.join(F.broadcast(filters.select(F.col(group).alias("__group"), "min_top", "max_top")), F.col(group) == F.col("__group"), "left")
    return got.filter(in_range_tolerant(F.col("top_year"), F.col("min_top"), F.col("max_top"))).select(*rows.columns)


#: What a property takes from its first listing, besides its name.
OF_FIRST = ("district", "tenure_code", "property_type", "developer", "grp")


def properties(rows: DataFrame, arrival: Sequence[str], said: Sequence[str] = OF_FIRST) -> DataFrame:
    """One row a property: facts of the first listing (its name, and those of ``said``), least price (0: none stated), number of units."""
    keyed = rows.withColumn("property_key", property_key(F.col("property_id"), F.col("listing_id")))
    grouped = keyed.groupBy("property_key").agg(*(c.alias(n) for n, c in property_sums(arrival, said).items()))
    return grouped.select("property_key", *property_facts(said))


def property_sums(arrival: Sequence[str], said: Sequence[str] = OF_FIRST) -> dict[str, Column]:
    """What ``property_facts`` needs of a property's units, for a grouping or for a window over them."""
    return {"first": F.min_by(F.struct("name", "address", *said), F.struct(*arrival)), "price_min": F.min(truthy(F.col("price"))), "unit_count": F.count("*")}


def property_facts(said: Sequence[str] = OF_FIRST) -> list[Column]:
    name = property_name(F.col("property_key"), F.col("first.name"), F.col("first.address"))
    return [name.alias("name"), *(F.col(f"first.{c}").alias(c) for c in said), F.coalesce("price_min", F.lit(0)).cast("bigint").alias("price_min"), "unit_count"]


def unit_types(rows: DataFrame) -> DataFrame:
    """One row a property and number of bedrooms (missing counts as 0), with the overview; 0 is ignored in all of it."""
    keyed = rows.withColumn("property_key", property_key(F.col("property_id"), F.col("listing_id"))).withColumn("bedrooms", F.coalesce("bedrooms", F.lit(0)).cast("bigint"))
    return keyed.groupBy("property_key", "bedrooms").agg(*_overview()).withColumn("label", bedroom_label(F.col("bedrooms")))


def _overview() -> list[Column]:
    """What a type says of its units; a 0 is ignored in all of it."""
    area, price, psf = (truthy(F.col(c)) for c in ("floor_area", "price", "psf"))
    return [
        F.min(area).alias("sqft_min"),
        F.max(area).alias("sqft_max"),
        half_even(F.expr("percentile(nullif(floor_area, 0), 0.5)")).alias("typical_sqft"),
        F.count("*").alias("unit_count"),
        F.min(price).alias("price_min"),
        F.max(price).alias("price_max"),
        F.min(psf).alias("psf_min"),
        F.max(psf).alias("psf_max"),
    ]


def unit_order(rows: DataFrame, arrival: Sequence[str]) -> DataFrame:
    """Places of units: ``unit_place`` within their type (no price first), ``flat_place`` within the property (no price last)."""
    keyed = rows.withColumn("property_key", property_key(F.col("property_id"), F.col("listing_id")))
    units = Window.partitionBy("property_key", F.coalesce("bedrooms", F.lit(0))).orderBy(*within_type(arrival))
    flat = Window.partitionBy("property_key").orderBy(*within_property(arrival))
    return keyed.withColumn("unit_place", F.row_number().over(units)).withColumn("flat_place", F.row_number().over(flat))


def within_type(arrival: Sequence[str]) -> list:
    """The order of units of one type: by price, no price first."""
    return [F.coalesce("price", F.lit(0)), *arrival]


def within_property(arrival: Sequence[str]) -> list:
    """The order of units of one property: by price, no price last."""
    return [truthy(F.col("price")).asc_nulls_last(), *arrival]


def top_units(rows: DataFrame, arrival: Sequence[str], n: int = 10, sums: dict[str, Column] | None = None) -> DataFrame:
    """The n cheapest units of each property with their place, and how many more there are; and ``sums`` over all units of the property."""
    keyed = rows.withColumn("property_key", property_key(F.col("property_id"), F.col("listing_id")))
    flat = Window.partitionBy("property_key").orderBy(truthy(F.col("price")).asc_nulls_last(), *arrival)
    # one shuffle and one sort: the count is a window over the same rows
    ranked = keyed.withColumn("place", F.row_number().over(flat)).withColumn("remainder", F.greatest(F.count("*").over(Window.partitionBy("property_key")) - n, F.lit(0)))
    ranked = ranked.withColumns({name: c.over(Window.partitionBy("property_key")) for name, c in (sums or {}).items()})
    return ranked.filter(F.col("place") <= n)


UNIT = ("listing_id", "price", "bathrooms", "floor_area", "psf", "url", "listed_at", "listed_label", "agent_name", "agency_name", "floorplans", "photos")


def unit_struct(columns: Sequence[str]) -> Column:
    """A unit as it hangs in the result tree: its own fields, of those that ``columns`` has, and the number of its photos."""
    photos = [F.coalesce("photo_count" if "photo_count" in columns else F.lit(None).cast("int"), F.size("photos") if "photos" in columns else F.lit(None), F.lit(0)).cast("int").alias("photo_count")]
    return F.struct(*(c for c in UNIT if c in columns), *photos)


def nested_properties(rows: DataFrame, arrival: Sequence[str]) -> DataFrame:
    """The result tree at the edge of the library: a property with an array of its unit types, each with an array of its units.

    One pass over the rows: types are grouped first, and properties from them. A property's tree is one row, so this is for
    results of a search, not for a corpus whose properties have no bound."""
    keyed = rows.withColumn("property_key", property_key(F.col("property_id"), F.col("listing_id"))).withColumn("bedrooms", F.coalesce("bedrooms", F.lit(0)).cast("bigint"))
    first_price, order = F.struct(F.coalesce("price", F.lit(0)).alias("p"), F.struct(*arrival).alias("a")), F.struct(*arrival)
    facts = F.struct(order.alias("order"), F.struct("name", "address", "district", "tenure_code", "property_type", "developer", "grp").alias("facts"))
    types = keyed.groupBy("property_key", "bedrooms").agg(*_overview(), F.array_sort(F.collect_list(F.struct(first_price.alias("o"), unit_struct(rows.columns).alias("u")))).alias("sorted"), F.min(facts).alias("first"))
    inner = F.struct("bedrooms", bedroom_label(F.col("bedrooms")).alias("label"), "unit_count", "sqft_min", "sqft_max", "typical_sqft", "price_min", "price_max", "psf_min", "psf_max", F.transform("sorted", lambda x: x["u"]).alias("units"))
    grouped = types.groupBy("property_key").agg(F.min("first").alias("first"), F.coalesce(F.min("price_min"), F.lit(0)).cast("bigint").alias("price_min"), F.sum("unit_count").alias("unit_count"), F.array_sort(F.collect_list(inner)).alias("unit_types"))
    return grouped.select("property_key", property_name(F.col("property_key"), F.col("first.facts.name"), F.col("first.facts.address")).alias("name"), *(F.col(f"first.facts.{c}").alias(c) for c in ("district", "tenure_code", "property_type", "developer", "grp")), "price_min", "unit_count", "unit_types")


def tree_units(tree: DataFrame) -> DataFrame:
    """The tree opened again: one row a unit, with its property's key and its type."""
    types = tree.select("property_key", F.inline("unit_types")).select("property_key", "bedrooms", "label", "units")
    return types.select("property_key", "bedrooms", "label", F.inline("units"))


def without_units(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Units without those of ``gone``; types and properties that are left without any are gone in every grouping of it."""
    return rows.join(gone.select("listing_id").distinct(), "listing_id", "left_anti")


def enrich(props: DataFrame, records: DataFrame) -> DataFrame:
    """Properties with the facts of their project records; those without a record stay, marked unavailable."""
    got = props.join(records.withColumnRenamed("property_id", "property_key"), "property_key", "left")
    return got.withColumn("enrichment", F.when(F.col("found").isNotNull(), "ok").otherwise("unavailable")).drop("found")


def matches_property(types: Sequence[str] = (), tenures: Sequence[str] = (), min_top=None, max_top=None) -> Column:
    """Strict filter of properties: what isn't stated fails any condition on it."""
    ok = F.lit(True)
    if types:
        ok = ok & F.coalesce(F.col("property_type").isin(*types), F.lit(False))
    if tenures:
        ok = ok & F.coalesce(tenure_code(F.col("tenure")).isin(*tenures), F.lit(False))
    return ok & in_range_strict(F.col("top_year"), min_top, max_top)


def matches_unit(price=(None, None), size=(None, None), psf=(None, None), bedrooms: Sequence[int] = (), bathrooms: Sequence[int] = (), days: int | None = None, now: int = 0, floorplans: bool = False) -> Column:
    """Strict filter of units."""
    ok = in_range_strict(F.col("price"), *price) & in_range_strict(F.col("floor_area"), *size) & in_range_strict(F.col("psf"), *psf)
    if bedrooms:
        ok = ok & F.coalesce(bedroom_chip(F.col("bedrooms")).isin(*bedrooms), F.lit(False))
    if bathrooms:
        ok = ok & F.coalesce(bathroom_chip(F.col("bathrooms")).isin(*bathrooms), F.lit(False))
    if days is not None:
        ok = ok & posted_within(F.col("listed_at"), F.lit(days), now)
    return ok & has_floorplans(F.col("floorplans")) if floorplans else ok


def has_floorplans(plans: Column) -> Column:
    return F.coalesce(F.size(plans), F.lit(0)) > 0


def two_level(units: DataFrame, property_ok: Column, unit_ok: Column, hidden: DataFrame) -> DataFrame:
    """Per property that passes: units shown, hidden and filtered out. A property whose shown units all fail goes; one whose
    units are all hidden stays."""
    seen = units.filter(property_ok).join(hidden.select("listing_id").distinct().withColumn("__hidden", F.lit(True)), "listing_id", "left")
    is_hidden = F.coalesce("__hidden", F.lit(False))
    counts = seen.groupBy("property_key").agg(
        F.count_if(~is_hidden & unit_ok).alias("shown"), F.count_if(is_hidden).alias("hidden"), F.count_if(~is_hidden & ~unit_ok).alias("filtered")
    )
    return counts.filter("shown > 0 or filtered = 0")


def filtered_units(units: DataFrame, property_ok: Column, unit_ok: Column, hidden: DataFrame) -> DataFrame:
    """Ids of units that a filter takes out of properties that stay."""
    seen = units.filter(property_ok).join(hidden.select("listing_id").distinct().withColumn("__hidden", F.lit(True)), "listing_id", "left")
    out = ~F.coalesce("__hidden", F.lit(False)) & ~unit_ok
    shown = F.count_if(~F.coalesce("__hidden", F.lit(False)) & unit_ok).over(Window.partitionBy("property_key"))
    return seen.select("property_key", "listing_id", out.alias("__out"), shown.alias("__shown")).filter("__out and __shown > 0").select("property_key", "listing_id")


#: What results can be ordered by.
SORT_COLUMNS = {"date": "listed_at", "price": "price", "psf": "psf", "size": "floor_area"}


def ordered_by(rows: DataFrame, sort: str = "date", order: str = "desc", tie: Sequence[str] = ("listing_id",)) -> DataFrame:
    """Rows in one of the orders of a source, the newest first by default; missing values come last."""
    return rows.orderBy(*order_of(sort, order, tie))


def order_of(sort: str = "date", order: str = "desc", tie: Sequence[str] = ("listing_id",)) -> list:
    column = F.col(SORT_COLUMNS[sort])
    return [column.asc_nulls_last() if order == "asc" else column.desc_nulls_last(), *tie]


def split_photos(rows: DataFrame, key: str = "listing_id", photos: str = "photos") -> tuple[DataFrame, DataFrame]:
    """Rows with the number of their photos instead of them, and the photos of rows that have any, in a table of their own."""
    slim = rows.withColumn("photo_count", F.coalesce(F.size(photos), F.lit(0))).drop(photos)
    return slim, rows.filter(F.size(photos) > 0).select(key, photos)


def with_stored_photos(rows: DataFrame, stored: DataFrame, key: str, own: str = "photos") -> DataFrame:
    """Rows without photos of their own get those that are stored for their key."""
    got = rows.join(stored.select(key, F.col(own).alias("__stored")), key, "left")
    return got.withColumn(own, F.when(F.size(own) > 0, F.col(own)).otherwise(F.coalesce("__stored", F.array().cast("array<string>")))).drop("__stored")
