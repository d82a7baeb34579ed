"""Deduplication, filters, grouping and enrichment of listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import first_of, tenure_label
from ..operators import listings as L
from ..operators.spread import medians, ranked, ranked_within
from ..operators import search_pages as G
from ..operators import stores as S
from . import hosts as H
from .registry import query

FLAT = ["listing_id", "property_id", "name", "price", "bedrooms", "bathrooms", "floor_area", "psf", "listed_at", "district", "grp", "tenure_code"]


@query("unit_type_overview", f"""WITH {H.UNITS}
SELECT property_key, coalesce(bedrooms, 0) AS bedrooms, min(nullif(floor_area, 0)) AS sqft_min, max(nullif(floor_area, 0)) AS sqft_max,
  CAST(round_even(median(nullif(floor_area, 0)), 0) AS BIGINT) AS typical_sqft, count(*) AS unit_count, min(nullif(price, 0)) AS price_min, max(nullif(price, 0)) AS price_max,
  min(nullif(psf, 0)) AS psf_min, max(nullif(psf, 0)) AS psf_max,
  CASE WHEN coalesce(bedrooms, 0) = 0 THEN 'Studio or unlisted' ELSE coalesce(bedrooms, 0) || ' bedroom' END AS label
FROM unit GROUP BY property_key, coalesce(bedrooms, 0)""")
def unit_type_overview(spark, sf_dir):
    """The flagship: listings to unit types of properties."""
    return L.unit_types(H.units(spark, sf_dir))


@query("listing_dedup_first", f"WITH {H.UNITS} SELECT listing_id, property_key, price, listed_at, raw_price FROM unit")
def listing_dedup_first(spark, sf_dir):
    return H.units(spark, sf_dir).select("listing_id", "property_key", "price", "listed_at", "raw_price")


@query("listing_flatten_psf", f"WITH {H.LISTING} SELECT {', '.join(FLAT)} FROM rated WHERE coalesce(price, 0) <> 0")
def listing_flatten_psf(spark, sf_dir):
    return L.usable(H.listings(spark, sf_dir)).select(*FLAT)


PROPERTY = H.UNITS + f""",
 lead AS (SELECT * FROM unit QUALIFY row_number() OVER (PARTITION BY property_key ORDER BY {H.ORDER}) = 1),
 sums AS (SELECT property_key, CAST(coalesce(min(nullif(price, 0)), 0) AS BIGINT) AS price_min, count(*) AS unit_count FROM unit GROUP BY property_key),
 property AS (SELECT property_key, coalesce(nullif(CASE WHEN starts_with(property_key, 'listing:') THEN coalesce(nullif(address, ''), nullif(name, ''), '') ELSE coalesce(nullif(name, ''), '') END, ''), 'Unknown property') AS name,
  district, tenure_code, property_type, developer, grp, price_min, unit_count FROM lead JOIN sums USING (property_key))"""


@query("property_group", f"WITH {PROPERTY} SELECT * FROM property")
def property_group(spark, sf_dir):
    return L.properties(H.units(spark, sf_dir), H.ARRIVAL).orderBy("price_min", "name", "property_key")


UNIT_ORDER = f"""WITH {H.UNITS} SELECT listing_id, property_key,
  CAST(row_number() OVER (PARTITION BY property_key, coalesce(bedrooms, 0) ORDER BY coalesce(price, 0), {H.ORDER}) AS INTEGER) AS unit_place,
  CAST(row_number() OVER (PARTITION BY property_key ORDER BY nullif(price, 0) NULLS LAST, {H.ORDER}) AS INTEGER) AS flat_place FROM unit"""


@query("unit_order", UNIT_ORDER)
def unit_order(spark, sf_dir):
    return L.unit_order(H.units(spark, sf_dir), H.ARRIVAL).select("listing_id", "property_key", "unit_place", "flat_place")


@query("unit_order_spread", UNIT_ORDER)
def unit_order_spread(spark, sf_dir):
    """The same places with a property of any size spread over many tasks. All units have a price, so both orders are one."""
    units = H.units(spark, sf_dir).withColumn("rooms", F.coalesce("bedrooms", F.lit(0)))
    slim = units.select("property_key", "rooms", "price", *H.ARRIVAL)
    return ranked_within(slim, ["property_key"], "rooms", L.within_property(H.ARRIVAL), ("flat_place", "unit_place")).select("listing_id", "property_key", "unit_place", "flat_place")


@query("median_sizes_spread", f"""WITH {H.UNITS} SELECT district, grp, CAST(round_even(median(nullif(floor_area, 0)), 0) AS BIGINT) AS typical_sqft FROM unit GROUP BY district, grp""")
def median_sizes_spread(spark, sf_dir):
    """Exact medians of large groups: a district and group has a share of all units."""
    return medians(H.units(spark, sf_dir), ["district", "grp"], F.nullif("floor_area", F.lit(0)), "typical_sqft")



@query("top10_units_with_remainder", f"""WITH {H.UNITS},
 ranked AS (SELECT property_key, listing_id, price, CAST(row_number() OVER (PARTITION BY property_key ORDER BY nullif(price, 0) NULLS LAST, {H.ORDER}) AS INTEGER) AS place, count(*) OVER (PARTITION BY property_key) AS n FROM unit)
SELECT property_key, listing_id, price, place, greatest(n - 10, 0) AS remainder FROM ranked WHERE place <= 10""")
def top10_units_with_remainder(spark, sf_dir):
    return L.top_units(H.units(spark, sf_dir), H.ARRIVAL).select("property_key", "listing_id", "price", "place", "remainder")


ENRICHED = PROPERTY + ", " + H.PROJECT + """,
 enriched AS (SELECT p.*, r.top_year, r.latitude, r.longitude,
  coalesce(nullif(r.tenure, ''), nullif(CASE tenure_code WHEN 'L99' THEN '99-year leasehold' WHEN 'L999' THEN '999-year leasehold' WHEN 'F' THEN 'Freehold' ELSE tenure_code END, ''), '') AS tenure,
  CASE WHEN r.property_id IS NULL THEN 'unavailable' ELSE 'ok' END AS enrichment FROM property p LEFT JOIN project r ON p.property_key = r.property_id)"""
ENRICHED_COLUMNS = ["property_key", "name", "district", "property_type", "grp", "price_min", "unit_count", "top_year", "latitude", "longitude", "tenure", "enrichment"]


def enriched(spark, sf_dir):
    props = L.properties(H.units(spark, sf_dir), H.ARRIVAL)
    got = L.enrich(props, H.project_records(spark, sf_dir).withColumnRenamed("tenure", "stated"))
    return got.withColumn("tenure", first_of(F.col("stated"), tenure_label(F.col("tenure_code"))))


@query("enrich_left_join", f"WITH {ENRICHED} SELECT {', '.join(ENRICHED_COLUMNS)} FROM enriched")
def enrich_left_join(spark, sf_dir):
    return enriched(spark, sf_dir).select(*ENRICHED_COLUMNS)


FRESH = f"coalesce({H.CACHE_NOW} - updated_at < {H.CACHE_TTL}, false) AND schema_version >= 2"
FAILED = f"coalesce({H.CACHE_NOW} - failed_at < {H.FAILURE_TTL}, false)"


@query("cache_semi_ttl", f"WITH {H.UNITS}, {H.CACHE} SELECT property_id, updated_at FROM cache WHERE {FRESH} AND property_id IN (SELECT property_key FROM unit)")
def cache_semi_ttl(spark, sf_dir):
    wanted = H.units(spark, sf_dir).select(F.col("property_key").alias("property_id"))
    hits, _ = S.cache_lookup(wanted, H.cache(spark, sf_dir), "property_id", H.CACHE_NOW, H.CACHE_TTL, H.FAILURE_TTL, 2)
    return hits.select("property_id", "updated_at")


@query("enrich_targets_anti", f"""WITH {H.UNITS}, {H.CACHE},
 lead AS (SELECT property_id, listing_id, name FROM unit WHERE property_id <> '' QUALIFY row_number() OVER (PARTITION BY property_id ORDER BY {H.ORDER}) = 1)
SELECT property_id, listing_id, '/project/' || trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') || '-' || property_id AS path FROM lead
WHERE name <> '' AND property_id NOT IN (SELECT property_id FROM cache WHERE {FRESH}) AND property_id NOT IN (SELECT property_id FROM cache WHERE {FAILED})""")
def enrich_targets_anti(spark, sf_dir):
    from ..functions.scalars import project_path

    rows = H.units(spark, sf_dir).filter("property_id <> ''")
    lead = L.first_by_arrival(rows, ["property_id"], H.ARRIVAL).select("property_id", "listing_id", project_path(F.col("name"), F.col("property_id")).alias("path")).filter("path <> ''")
    return S.to_fetch(lead, H.cache(spark, sf_dir), "property_id", H.CACHE_NOW, H.CACHE_TTL, H.FAILURE_TTL, 2)


FILTERS = [("N", 20000, 60000, None, 1600, None, None, ["D01", "D02", "D05", "D09"], 1970, None), ("H", None, 50000, 200, None, 10, 90, [], None, 1990)]
FILTER_SCHEMA = "grp string, min_price bigint, max_price bigint, min_size bigint, max_size bigint, min_psf bigint, max_psf bigint, districts array<string>, min_top bigint, max_top bigint"


@query("recheck_null_tolerant", f"""WITH {H.UNITS} SELECT listing_id, grp, price, floor_area, psf, district FROM unit WHERE
 CASE grp WHEN 'N' THEN (price IS NULL OR price BETWEEN 20000 AND 60000) AND (floor_area IS NULL OR floor_area <= 1600) AND (coalesce(district, '') = '' OR district IN ('D01', 'D02', 'D05', 'D09'))
 WHEN 'H' THEN (price IS NULL OR price <= 50000) AND (floor_area IS NULL OR floor_area >= 200) AND (psf IS NULL OR psf BETWEEN 10 AND 90) ELSE true END""")
def recheck_null_tolerant(spark, sf_dir):
    filters = spark.createDataFrame(FILTERS, FILTER_SCHEMA)
    return L.recheck(H.units(spark, sf_dir), filters).select("listing_id", "grp", "price", "floor_area", "psf", "district")


@query("top_year_filter", f"WITH {ENRICHED} SELECT property_key, grp, top_year FROM enriched WHERE top_year IS NULL OR CASE grp WHEN 'N' THEN top_year >= 1970 WHEN 'H' THEN top_year <= 1990 ELSE true END")
def top_year_filter(spark, sf_dir):
    return L.top_year_recheck(enriched(spark, sf_dir), spark.createDataFrame(FILTERS, FILTER_SCHEMA)).select("property_key", "grp", "top_year")




@query("property_filter_strict", f"""WITH {ENRICHED} SELECT property_key, tenure, top_year FROM enriched
WHERE coalesce(CASE WHEN lower(trim(tenure)) = 'freehold' THEN 'F' WHEN regexp_matches(trim(tenure), '(?i)^(99)\\s*-?\\s*year') THEN 'L99' END IN ('F', 'L99'), false) AND coalesce(top_year >= 1970 AND top_year <= 1995, false)""")
def property_filter_strict(spark, sf_dir):
    return enriched(spark, sf_dir).filter(L.matches_property(tenures=("F", "L99"), min_top=1970, max_top=1995)).select("property_key", "tenure", "top_year")


UNIT_OK = f"coalesce(price >= 15000, false) AND coalesce(floor_area <= 1800, false) AND coalesce(CASE WHEN bedrooms >= 0 THEN least(bedrooms, 5) END IN (1, 2, 5), false) AND coalesce(CASE WHEN bathrooms >= 1 THEN least(bathrooms, 5) END IN (1, 2, 3, 5), false) AND coalesce(listed_at >= {H.NOW} - 2000 * 86400, false)"


def unit_ok():
    return L.matches_unit(price=(15000, None), size=(None, 1800), bedrooms=(1, 2, 5), bathrooms=(1, 2, 3, 5), days=2000, now=H.NOW)


@query("unit_filter_strict", f"WITH {H.UNITS} SELECT listing_id, price, floor_area, bedrooms, bathrooms FROM unit WHERE {UNIT_OK}")
def unit_filter_strict(spark, sf_dir):
    return H.units(spark, sf_dir).filter(unit_ok()).select("listing_id", "price", "floor_area", "bedrooms", "bathrooms")


TWO_LEVEL = f"""{H.UNITS}, {H.PROJECT}, {H.HIDDEN},
 gone AS (SELECT DISTINCT CAST(id AS BIGINT) AS listing_id FROM entity WHERE event_type = 'error' AND scope = 'unit'),
 seen AS (SELECT u.property_key, u.listing_id, g.listing_id IS NOT NULL AS hid, ({UNIT_OK.replace('listed_at', 'u.listed_at')}) AS ok FROM unit u LEFT JOIN project r ON u.property_key = r.property_id LEFT JOIN gone g ON u.listing_id = g.listing_id
  WHERE coalesce(r.top_year >= 1970 AND r.top_year <= 1999, false)),
 level AS (SELECT property_key, count(*) FILTER (NOT hid AND ok) AS shown, count(*) FILTER (hid) AS hidden, count(*) FILTER (NOT hid AND NOT ok) AS filtered FROM seen GROUP BY property_key HAVING shown > 0 OR filtered = 0)"""


def _two_level_inputs(spark, sf_dir):
    records = H.project_records(spark, sf_dir).select(F.col("property_id").alias("property_key"), "top_year")
    units = H.units(spark, sf_dir).join(records, "property_key", "left")
    gone = H.hidden(spark, sf_dir).filter("scope = 'unit'").select(F.col("id").cast("bigint").alias("listing_id"))
    return units, L.matches_property(min_top=1970, max_top=1999), unit_ok(), gone


@query("two_level_filter", f"WITH {TWO_LEVEL} SELECT * FROM level")
def two_level_filter(spark, sf_dir):
    return L.two_level(*_two_level_inputs(spark, sf_dir))


@query("filtered_unit_ids", f"WITH {TWO_LEVEL} SELECT property_key, listing_id FROM seen WHERE NOT hid AND NOT ok AND property_key IN (SELECT property_key FROM level)")
def filtered_unit_ids(spark, sf_dir):
    return L.filtered_units(*_two_level_inputs(spark, sf_dir))


WANTED = [("N", 3, 1), ("H", 10, 2), ("L", 0, 3), ("X", 2, 4), ("Y", 0, 5)]
FANOUT = H.LISTING + """, wanted(grp, most) AS (VALUES ('N', 3), ('H', 10), ('L', 0), ('X', 2), ('Y', 0)),
 lasts AS (SELECT w.grp, most, coalesce(max(page), 0) AS total FROM wanted w LEFT JOIN rated r ON r.grp = w.grp GROUP BY w.grp, most),
 bounded AS (SELECT grp, total, CASE WHEN most = 0 AND total = 0 THEN 1 WHEN most = 0 THEN total WHEN total = 0 THEN most WHEN total < most THEN total ELSE most END AS last FROM lasts)"""


def _wanted(spark, sf_dir):
    groups = spark.createDataFrame(WANTED, "grp string, most bigint, place int")
    totals = H.listings(spark, sf_dir).groupBy("grp").agg(F.max("page").alias("total"))
    return groups.join(totals, "grp", "left").withColumn("total", F.coalesce("total", F.lit(0)))


@query("page_fanout", f"""WITH {FANOUT} SELECT grp, page, last, total, total > 0 AND total > last AS truncated FROM bounded, unnest(generate_series(1, last)) AS t(page)""")
def page_fanout(spark, sf_dir):
    """Pages to read of each group: its first, and the others up to the group's bound (0: all of them); of a group without a
    known total all that are wanted, or the first."""
    return G.page_targets(_wanted(spark, sf_dir))


@query("page_scan_totals", f"""WITH {FANOUT}, target AS (SELECT grp, page, last, total FROM bounded, unnest(generate_series(1, last)) AS t(page)), scanned AS (SELECT count(*) AS n FROM target WHERE page <> 2 AND page <= total)
SELECT CAST((SELECT sum(last) FROM bounded) AS BIGINT) AS pages_total, (SELECT n FROM scanned) AS pages_scanned, CAST((SELECT sum(total) FROM bounded) AS BIGINT) AS total_pages, (SELECT bool_or(total > 0 AND total > last) FROM bounded) AS truncated""")
def page_scan_totals(spark, sf_dir):
    """The join of targets with fetched pages: the second page of each group never came and is skipped; sums over the groups."""
    fetched = H.listings(spark, sf_dir).filter("page <> 2").select("grp", "page").distinct()
    return G.scan_totals(G.fetched_targets(G.page_targets(_wanted(spark, sf_dir)), fetched, F.lit(True)))


@query("first_page_problems", f"""WITH {FANOUT} SELECT grp, CASE WHEN total = 0 THEN 'no first page' WHEN grp = 'H' THEN 'no listings though there are pages' END AS problem FROM bounded WHERE total = 0 OR grp = 'H'""")
def first_page_problems(spark, sf_dir):
    """Groups whose first page can't be used: it never came, or nothing was read from it though there are pages."""
    first = _wanted(spark, sf_dir).withColumn("found", F.col("total") > 0).withColumn("n", F.when(F.col("grp") != "H", 5))
    return first.select("grp", G.page_problem(F.col("found"), F.col("total"), F.col("n")).alias("problem")).filter("problem is not null")


@query("photo_split", f"""WITH {H.UNITS}, p AS (SELECT listing_id, CASE WHEN listing_id % 4 = 0 THEN [] ELSE list_transform(generate_series(1, listing_id % 4), lambda i: listing_id || '-' || i || '.jpg') END AS photos FROM unit)
SELECT listing_id, len(photos) AS photo_count, unnest(CASE WHEN len(photos) = 0 THEN [NULL] ELSE photos END) AS photo FROM p""")
def photo_split(spark, sf_dir):
    """Photos go to a table of their own; the listing keeps their number."""
    n = F.col("listing_id") % 4
    photos = F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1).cast("bigint"), F.greatest(n, F.lit(1))), lambda i: F.concat(F.col("listing_id").cast("string"), F.lit("-"), i.cast("string"), F.lit(".jpg"))))
    slim, side = L.split_photos(H.units(spark, sf_dir).select("listing_id", photos.alias("photos")))
    return slim.join(side, "listing_id", "left").select("listing_id", F.col("photo_count").cast("bigint").alias("photo_count"), F.explode_outer("photos").alias("photo"))


@query("source_order", f"WITH {H.UNITS} SELECT listing_id, psf, CAST(row_number() OVER (ORDER BY psf DESC NULLS LAST, listing_id) AS BIGINT) AS place FROM unit")
def source_order(spark, sf_dir):
    """All units by rate, the highest first, with their places: one group of all rows, spread over all tasks."""
    units = H.units(spark, sf_dir).select("listing_id", "psf", F.lit(1).alias("all"))
    return ranked(units, ["all"], L.order_of("psf"), "place").drop("all")

