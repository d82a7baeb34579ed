"""The test tables read as listings, projects, caches and events, each as a DataFrame and as the same view in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import epoch_seconds, half_even, per_area
from ..sources.tables import shuffled, table

#: "Now" of the listings (2001-11-05) and of the events (2024-01-31), in epoch seconds.
NOW, EVENTS_NOW = 1_004_918_400, 1_706_659_200
ARRIVAL = ["listed_at", "part_key", "supp_key", "raw_price", "listing_id", "line"]
DAY = 86_400


def listings(spark: SparkSession, sf_dir: str, parts_shuffled: bool = False) -> DataFrame:
    """``parts_shuffled``: parts are joined by a shuffle at any size, for queries that read the listings more than once."""
    li, part, supplier, nation, region = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier", "nation", "region"))
    rows = li.join(shuffled(part, "shuffle_hash") if parts_shuffled else part, li.l_partkey == part.p_partkey).join(supplier, li.l_suppkey == supplier.s_suppkey).join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    price = F.when((F.col("l_linenumber") == 7) & (F.col("l_quantity") == 1), F.lit(0).cast("bigint")).otherwise(half_even(F.col("l_extendedprice")))
    area = F.nullif(F.col("l_quantity") * 40, F.lit(400)).cast("bigint")
    district = F.when(F.col("s_nationkey") != 7, F.concat(F.lit("D"), F.lpad((1 + F.col("s_nationkey") % 28).cast("string"), 2, "0")))
    return rows.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("listing_id"),
        F.when(F.col("l_partkey") % 17 == 0, "").otherwise(F.col("l_partkey").cast("string")).alias("property_id"),
        F.col("p_name").alias("name"),
        F.coalesce(F.concat(district, F.lit(" "), "r_name"), F.lit("")).alias("address"),
        F.col("p_brand").alias("developer"),
        F.col("p_type").alias("property_type"),
        price.alias("price"),
        F.nullif(F.col("l_linenumber") - 1, F.lit(3)).cast("bigint").alias("bedrooms"),
        (F.col("l_suppkey") % 7).alias("bathrooms"),
        area.alias("floor_area"),
        per_area(price, area).alias("psf"),
        epoch_seconds(F.col("l_shipdate")).alias("listed_at"),
        district.alias("district"),
        F.col("r_name").alias("region"),
        F.when(F.col("n_regionkey") % 3 == 0, "N").when(F.col("n_regionkey") % 3 == 1, "H").otherwise("L").alias("grp"),
        F.when(F.col("l_returnflag") == "A", "L99").when(F.col("l_returnflag") == "N", "F").otherwise("L103").alias("tenure_code"),
        (F.col("l_orderkey") % 12 + 1).alias("page"),
        F.col("l_partkey").alias("part_key"),
        F.col("l_suppkey").alias("supp_key"),
        F.col("l_extendedprice").alias("raw_price"),
        F.col("l_linenumber").alias("line"),
    )


LISTING = """listing AS (
  SELECT l_orderkey * 10 + l_linenumber AS listing_id,
    CASE WHEN l_partkey % 17 = 0 THEN '' ELSE CAST(l_partkey AS VARCHAR) END AS property_id,
    p_name AS name,
    coalesce((CASE WHEN s_nationkey <> 7 THEN 'D' || lpad(CAST(1 + s_nationkey % 28 AS VARCHAR), 2, '0') END) || ' ' || r_name, '') AS address,
    p_brand AS developer, p_type AS property_type,
    CASE WHEN l_linenumber = 7 AND l_quantity = 1 THEN 0 ELSE CAST(round_even(l_extendedprice, 0) AS BIGINT) END AS price,
    CAST(nullif(l_linenumber - 1, 3) AS BIGINT) AS bedrooms, l_suppkey % 7 AS bathrooms,
    CAST(nullif(l_quantity * 40, 400) AS BIGINT) AS floor_area,
    CAST(epoch(l_shipdate) AS BIGINT) AS listed_at,
    CASE WHEN s_nationkey <> 7 THEN 'D' || lpad(CAST(1 + s_nationkey % 28 AS VARCHAR), 2, '0') END AS district,
    r_name AS region, CASE n_regionkey % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'H' ELSE 'L' END AS grp,
    CASE l_returnflag WHEN 'A' THEN 'L99' WHEN 'N' THEN 'F' ELSE 'L103' END AS tenure_code,
    l_orderkey % 12 + 1 AS page, l_partkey AS part_key, l_suppkey AS supp_key, l_extendedprice AS raw_price, l_linenumber AS line
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
 rated AS (SELECT *, CAST(round_even(nullif(price, 0) / CAST(nullif(floor_area, 0) AS DOUBLE), 0) AS BIGINT) AS psf FROM listing)"""
ORDER = "listed_at, part_key, supp_key, raw_price, listing_id, line"
#: Usable listings, the first of each id, and their property's key.
UNITS = LISTING + f""",
 first AS (SELECT * FROM rated WHERE coalesce(listing_id, 0) <> 0 AND coalesce(price, 0) <> 0 QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY {ORDER}) = 1),
 unit AS (SELECT *, CASE WHEN property_id = '' THEN 'listing:' || listing_id ELSE property_id END AS property_key FROM first)"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.listings import first_by_arrival, property_key, usable

    return first_by_arrival(usable(listings(spark, sf_dir)), ["listing_id"], ARRIVAL).withColumn("property_key", property_key(F.col("property_id"), F.col("listing_id")))


def project_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for most parts; some without a year, a tenure or a place."""
    part = table(spark, sf_dir, "part").filter("p_partkey % 13 <> 0")
    key, place = F.col("p_partkey"), F.col("p_partkey") % 11 != 0
    return part.select(
        key.cast("string").alias("property_id"),
        F.when(F.col("p_size") % 5 != 0, 1960 + F.col("p_size")).cast("bigint").alias("top_year"),
        F.when(key % 3 == 0, "99-year Leasehold").when(key % 3 == 1, "Freehold").otherwise("").alias("tenure"),
        F.when(place, 1.15 + (key % 35) * 0.01).alias("latitude"),
        F.when(place, 103.55 + (key % 55) * 0.01).alias("longitude"),
        F.lit(True).alias("found"),
    )


PROJECT = """project AS (
  SELECT CAST(p_partkey AS VARCHAR) AS property_id, CAST(CASE WHEN p_size % 5 <> 0 THEN 1960 + p_size END AS BIGINT) AS top_year,
    CASE p_partkey % 3 WHEN 0 THEN '99-year Leasehold' WHEN 1 THEN 'Freehold' ELSE '' END AS tenure,
    CASE WHEN p_partkey % 11 <> 0 THEN CAST(1.15 AS DOUBLE) + (p_partkey % 35) * CAST(0.01 AS DOUBLE) END AS latitude,
    CASE WHEN p_partkey % 11 <> 0 THEN CAST(103.55 AS DOUBLE) + (p_partkey % 55) * CAST(0.01 AS DOUBLE) END AS longitude
  FROM part WHERE p_partkey % 13 <> 0)"""


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest order of each customer as a cache entry of the property with that number."""
    at = epoch_seconds(F.col("o_orderdate"))
    latest = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("property_id")).agg(F.max_by(F.struct(at.alias("at"), F.col("o_orderstatus").alias("state"), F.col("o_orderkey").alias("k")), F.struct("o_orderdate", "o_orderkey")).alias("e"))
    return latest.select("property_id", (1 + F.col("e.k") % 2).cast("int").alias("schema_version"), F.when(F.col("e.state") != "F", F.col("e.at")).alias("updated_at"), F.when(F.col("e.state") == "F", F.col("e.at")).alias("failed_at"))


CACHE = """cache AS (
  SELECT CAST(o_custkey AS VARCHAR) AS property_id, CAST(1 + o_orderkey % 2 AS INTEGER) AS schema_version,
    CASE WHEN o_orderstatus <> 'F' THEN CAST(epoch(o_orderdate) AS BIGINT) END AS updated_at,
    CASE WHEN o_orderstatus = 'F' THEN CAST(epoch(o_orderdate) AS BIGINT) END AS failed_at
  FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)"""
#: The cache is looked up on this day, with these times to live.
CACHE_NOW, CACHE_TTL, FAILURE_TTL = NOW, 900 * DAY, 400 * DAY


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as what users did to an entity."""
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", r'"k":\s*(\d+)', 1)
    return e.select("event_id", epoch_seconds(F.col("ts")).alias("at_s"), "user_id", "event_type", "value", k.alias("k"), F.when(F.col("event_id") % 2 == 0, "property").otherwise("unit").alias("scope"))


ACTION = """action AS (
  SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS at_s, user_id, event_type, value, regexp_extract(props, '"k":\\s*(\\d+)', 1) AS k,
    CASE WHEN event_id % 2 = 0 THEN 'property' ELSE 'unit' END AS scope FROM events)"""


def hidden(spark: SparkSession, sf_dir: str, kind: str = "error") -> DataFrame:
    a = actions(spark, sf_dir).filter(F.col("event_type") == kind)
    units_key = (F.col("k").cast("bigint") * 10 + 1 + F.col("event_id") % 7).cast("string")
    return a.select("scope", F.when(F.col("scope") == "property", F.col("k")).otherwise(units_key).alias("id"), "at_s")


HIDDEN = ACTION + """,
 entity AS (SELECT event_type, scope, CASE WHEN scope = 'property' THEN k ELSE CAST(CAST(k AS BIGINT) * 10 + 1 + event_id % 7 AS VARCHAR) END AS id, at_s, event_id, value FROM action)"""
