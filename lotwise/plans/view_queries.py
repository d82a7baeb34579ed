"""Facets, map views, hidden and bookmarked entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dimensions as D
from ..functions.scalars import bathroom_chip, bedroom_chip, is_new, tenure_code
from ..operators import reports
from ..operators import stores as S
from ..operators import views as V
from ..operators.listings import matches_unit
from ..sources.tables import table
from ..operators.polygons import points_in_polygons
from . import hosts as H
from .listing_queries import ENRICHED, PROPERTY, enriched
from .registry import query

#: The map: least longitude, greatest latitude, units a degree.
MAP = (103.55, 1.50, 1000.0)


def anchors(spark, sf_dir):
    n = table(spark, sf_dir, "nation").filter("n_nationkey <> 7 and n_nationkey < 20")
    return n.select(F.concat(F.lit("D"), F.lpad((1 + F.col("n_nationkey") % 28).cast("string"), 2, "0")).alias("district"), (F.col("n_nationkey") * 20.0).alias("anchor_x"), (F.col("n_regionkey") * 50.0).alias("anchor_y"))


POINT = ENRICHED + """,
 anchor AS (SELECT 'D' || lpad(CAST(1 + n_nationkey % 28 AS VARCHAR), 2, '0') AS district, n_nationkey * CAST(20 AS DOUBLE) AS ax, n_regionkey * CAST(50 AS DOUBLE) AS ay FROM nation WHERE n_nationkey <> 7 AND n_nationkey < 20),
 point AS (SELECT e.*, CASE WHEN latitude IS NOT NULL THEN (longitude - CAST(103.55 AS DOUBLE)) * CAST(1000 AS DOUBLE) ELSE ax END AS x, CASE WHEN latitude IS NOT NULL THEN (CAST(1.5 AS DOUBLE) - latitude) * CAST(1000 AS DOUBLE) ELSE ay END AS y,
  latitude IS NULL AND ax IS NOT NULL AS approximate FROM enriched e LEFT JOIN anchor a ON e.district = a.district)"""


def points(spark, sf_dir):
    return V.placed(enriched(spark, sf_dir), anchors(spark, sf_dir), *MAP)


@query("map_filter_district", f"WITH {POINT} SELECT property_key, district, approximate FROM point WHERE x IS NULL OR coalesce(district IN ('D01', 'D03', 'D12'), false)")
def map_filter_district(spark, sf_dir):
    return V.map_filter(points(spark, sf_dir), ("D01", "D03", "D12")).select("property_key", "district", "approximate")


@query("map_filter_viewport", f"WITH {POINT} SELECT property_key, round(x, 6) AS x, round(y, 6) AS y FROM point WHERE x IS NULL OR (x BETWEEN 100.5 AND 300.5 AND y BETWEEN 20.5 AND 250.5)")
def map_filter_viewport(spark, sf_dir):
    return V.map_filter(points(spark, sf_dir), viewport=(100.5, 20.5, 300.5, 250.5)).select("property_key", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("unpositioned_counts", f"WITH {POINT} SELECT count(*) FILTER (x IS NULL) AS unpositioned, count(*) FILTER (approximate) AS approximate, count(*) AS n FROM point")
def unpositioned_counts(spark, sf_dir):
    return points(spark, sf_dir).agg(F.count_if(F.col("x").isNull()).alias("unpositioned"), F.count_if("approximate").alias("approximate"), F.count("*").alias("n"))


@query("pin_clusters", f"""WITH {POINT} SELECT district, round(avg(x), 4) AS x, round(avg(y), 4) AS y, count(*) AS n, bool_and(price_min > 20000) AS dimmed FROM point WHERE x IS NOT NULL AND district IS NOT NULL GROUP BY district
UNION ALL SELECT district, round(x, 4), round(y, 4), 1, price_min > 20000 FROM point WHERE x IS NOT NULL AND district IS NULL""")
def pin_clusters(spark, sf_dir):
    pins = V.pin_clusters(points(spark, sf_dir), F.col("price_min") > 20000)
    return pins.select("district", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "n", "dimmed")


@query("map_markers", f"WITH {POINT} SELECT property_key AS id, round(x, 6) AS x, round(y, 6) AS y, approximate AS dimmed, district FROM point WHERE x IS NOT NULL")
def map_markers(spark, sf_dir):
    return V.markers(points(spark, sf_dir)).withColumn("x", F.round("x", 6)).withColumn("y", F.round("y", 6))


CHIPS = """bedrooms AS b, CAST(CASE WHEN bedrooms >= 0 THEN least(bedrooms, 5) END AS VARCHAR) AS bedroom, CAST(CASE WHEN bathrooms >= 1 THEN least(bathrooms, 5) END AS VARCHAR) AS bathroom, tenure_code AS tenure, property_type AS type"""


def facet_columns():
    return {"bedroom": bedroom_chip(F.col("bedrooms")), "bathroom": bathroom_chip(F.col("bathrooms")), "tenure": F.col("tenure_code"), "type": F.col("property_type")}


@query("facets_by_group", f"""WITH {H.UNITS}, c AS (SELECT grp, {CHIPS} FROM unit), v AS (
 SELECT grp, 'bedroom' AS facet, bedroom AS value FROM c UNION ALL SELECT grp, 'bathroom', bathroom FROM c UNION ALL SELECT grp, 'tenure', tenure FROM c UNION ALL SELECT grp, 'type', type FROM c)
SELECT grp, facet, value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY grp, facet, value""")
def facets_by_group(spark, sf_dir):
    return V.facet_values(H.units(spark, sf_dir), facet_columns())


@query("facets_districts", f"WITH {PROPERTY} SELECT 'district' AS facet, district AS value, count(*) AS n FROM property WHERE district IS NOT NULL GROUP BY district")
def facets_districts(spark, sf_dir):
    from ..operators.listings import properties

    return V.facet_values(properties(H.units(spark, sf_dir), H.ARRIVAL), {"district": F.col("district")}, by=None)


@query("facet_bounds", f"""WITH {H.UNITS} SELECT g.grp, min(price) AS price_min, max(price) AS price_max, min(floor_area) AS floor_area_min, max(floor_area) AS floor_area_max, min(psf) AS psf_min, max(psf) AS psf_max
FROM (VALUES ('N'), ('H'), ('L'), ('X')) g(grp) LEFT JOIN unit u ON u.grp = g.grp GROUP BY g.grp""")
def facet_bounds(spark, sf_dir):
    groups = spark.createDataFrame([("N",), ("H",), ("L",), ("X",)], "grp string")
    return V.facet_bounds(H.units(spark, sf_dir), ["price", "floor_area", "psf"], groups)


@query("grouping_sets_facets", f"WITH {H.UNITS} SELECT grp, district, count(*) AS n, min(price) AS price_min FROM unit GROUP BY GROUPING SETS ((grp), (grp, district), ())")
def grouping_sets_facets(spark, sf_dir):
    rows = H.units(spark, sf_dir).select("grp", "district", "price")
    return rows.groupingSets([[F.col("grp")], [F.col("grp"), F.col("district")], []], "grp", "district").agg(F.count("*").alias("n"), F.min("price").alias("price_min"))


@query("posted_buckets", f"WITH {H.UNITS} SELECT d AS days, count(*) AS n FROM unit, (VALUES (3), (7), (14), (31)) t(d) WHERE listed_at >= {H.NOW} - d * 86400 GROUP BY d")
def posted_buckets(spark, sf_dir):
    return V.posted_buckets(H.units(spark, sf_dir), H.NOW)


HIDE = H.HIDDEN + ", here AS (SELECT scope, id FROM entity WHERE event_type = 'error'), always AS (SELECT scope, id FROM entity WHERE event_type = 'signup' AND value > 20), gone AS (SELECT scope, id FROM here UNION SELECT scope, id FROM always)"


def all_hidden(spark, sf_dir):
    always = H.actions(spark, sf_dir).filter("event_type = 'signup' and value > 20")
    unit = (F.col("k").cast("bigint") * 10 + 1 + F.col("event_id") % 7).cast("string")
    return V.hidden_entities(H.hidden(spark, sf_dir), always.select("scope", F.when(F.col("scope") == "property", F.col("k")).otherwise(unit).alias("id")))


@query("hidden_union", f"WITH {HIDE} SELECT scope, id FROM gone")
def hidden_union(spark, sf_dir):
    return all_hidden(spark, sf_dir)


@query("hidden_anti", f"WITH {PROPERTY}, {HIDE} SELECT property_key, price_min FROM property WHERE property_key NOT IN (SELECT id FROM gone WHERE scope = 'property')")
def hidden_anti(spark, sf_dir):
    from ..operators.listings import properties

    return V.without_hidden(properties(H.units(spark, sf_dir), H.ARRIVAL), all_hidden(spark, sf_dir)).select("property_key", "price_min")


@query("hidden_in_results", f"WITH {H.UNITS}, {HIDE}, keys AS (SELECT 'property#' || property_key AS entity_key FROM unit UNION SELECT 'unit#' || listing_id FROM unit) SELECT entity_key, scope, id FROM (SELECT scope || '#' || id AS entity_key, scope, id FROM gone) WHERE entity_key IN (SELECT entity_key FROM keys)")
def hidden_in_results(spark, sf_dir):
    return V.entries_in_results(all_hidden(spark, sf_dir), H.units(spark, sf_dir)).select("entity_key", "scope", "id")


@query("bookmark_partition", f"WITH {PROPERTY}, {H.HIDDEN}, mark AS (SELECT DISTINCT id FROM entity WHERE event_type = 'click' AND scope = 'property') SELECT property_key, name, price_min, property_key IN (SELECT id FROM mark) AS bookmarked FROM property")
def bookmark_partition(spark, sf_dir):
    from ..operators.listings import properties

    marks = H.hidden(spark, sf_dir, "click").filter("scope = 'property'")
    props = properties(H.units(spark, sf_dir), H.ARRIVAL)
    return V.bookmarked_first(props, marks, ["price_min", "name", "property_key"]).select("property_key", "name", "price_min", "bookmarked")


SINCE = H.NOW - 400 * 86400


@query("new_since_sort", f"""WITH {H.UNITS}, n AS (SELECT *, coalesce(nullif(listed_at, 0) > {SINCE}, false) AS is_new FROM unit)
SELECT listing_id, property_key, is_new, CAST(row_number() OVER (PARTITION BY property_key ORDER BY is_new DESC, nullif(price, 0) NULLS LAST, {H.ORDER}) AS INTEGER) AS place FROM n""")
def new_since_sort(spark, sf_dir):
    return V.new_first(H.units(spark, sf_dir), is_new(F.col("listed_at"), SINCE), H.ARRIVAL).select("listing_id", "property_key", "is_new", "place")


@query("shortlist_regroup", f"""WITH {H.ACTION}, s AS (SELECT k AS property_id, 'name ' || event_id AS name, CAST(round_even(value, 0) AS BIGINT) AS price, at_s AS created_at, event_id FROM action WHERE event_type = 'purchase')
SELECT property_id, arg_max(name, created_at * 1000000 + event_id) AS name, CAST(coalesce(min(nullif(price, 0)), 0) AS BIGINT) AS price_min, count(*) AS unit_count, max(created_at) AS shortlisted_at FROM s GROUP BY property_id""")
def shortlist_regroup(spark, sf_dir):
    a = H.actions(spark, sf_dir).filter("event_type = 'purchase'")
    entries = a.select(F.col("k").alias("property_id"), F.concat(F.lit("name "), F.col("event_id").cast("string")).alias("name"), F.bround("value").cast("bigint").alias("price"), F.col("at_s").alias("created_at"), "event_id")
    return S.newest_names(entries, "property_id", ["created_at", "event_id"], "name").orderBy(F.desc("shortlisted_at"), "property_id")


@query("tenure_codes", f"WITH {H.PROJECT} SELECT property_id, CASE WHEN lower(tenure) = 'freehold' THEN 'F' WHEN tenure LIKE '99-year%' THEN 'L99' END AS code FROM project")
def tenure_codes(spark, sf_dir):
    return H.project_records(spark, sf_dir).select("property_id", tenure_code(F.col("tenure")).alias("code"))


@query("facet_sets", f"""WITH {H.UNITS}, g(grp) AS (VALUES ('N'), ('H'), ('L'), ('X')), d AS (SELECT string_agg(DISTINCT district, ',' ORDER BY district) AS districts FROM unit)
SELECT g.grp, coalesce(string_agg(DISTINCT CAST(CASE WHEN bedrooms >= 0 THEN least(bedrooms, 5) END AS VARCHAR), ',' ORDER BY CAST(CASE WHEN bedrooms >= 0 THEN least(bedrooms, 5) END AS VARCHAR)), '') AS bedroom,
 coalesce(string_agg(DISTINCT tenure_code, ',' ORDER BY tenure_code), '') AS tenure, CASE WHEN count(*) FILTER (line % 2 = 0) > 0 THEN 'withFloorplans' ELSE '' END AS feature, (SELECT districts FROM d) AS districts, count(u.listing_id) > 0 AS present
FROM g LEFT JOIN unit u ON u.grp = g.grp GROUP BY g.grp""")
def facet_sets(spark, sf_dir):
    """Choices of each group as sets, empty for a group without rows; districts are those of all groups."""
    groups = spark.createDataFrame([("N",), ("H",), ("L",), ("X",)], "grp string")
    facets = {"bedroom": bedroom_chip(F.col("bedrooms")), "tenure": F.col("tenure_code"), "feature": F.when(F.col("line") % 2 == 0, "withFloorplans")}
    got = V.facet_sets(H.units(spark, sf_dir), facets, groups, F.col("district"))
    return got.select("grp", *(F.array_join(c, ",").alias(c) for c in ("bedroom", "tenure", "feature", "districts")), "present")


@query("hidden_table", f"WITH {HIDE} SELECT scope, id, 'This search' AS hidden_in FROM here UNION ALL SELECT scope, id, 'Every search' FROM always")
def hidden_table(spark, sf_dir):
    """Both lists of hidden entries with where each hides."""
    always = H.actions(spark, sf_dir).filter("event_type = 'signup' and value > 20")
    unit = (F.col("k").cast("bigint") * 10 + 1 + F.col("event_id") % 7).cast("string")
    return reports.hidden_table(H.hidden(spark, sf_dir).select("scope", "id"), always.select("scope", F.when(F.col("scope") == "property", F.col("k")).otherwise(unit).alias("id")))


@query("type_codes_and_groups", """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'CONDO' WHEN 1 THEN 'SEMI' WHEN 2 THEN 'LCLUS' WHEN 3 THEN NULL WHEN 4 THEN '4STD' ELSE NULL END AS code,
 CASE WHEN c_custkey % 5 = 0 THEN 'H' ELSE CASE c_custkey % 6 WHEN 1 THEN 'L' WHEN 2 THEN 'L' WHEN 4 THEN 'H' ELSE 'N' END END AS grp FROM customer""")
def type_codes_and_groups(spark, sf_dir):
    """Stated types, as codes or labels, to codes; and the group of a property that doesn't state it."""
    k = F.col("c_custkey")
    stated = F.element_at(F.array(*map(F.lit, ("CONDO", " Semi-Detached House", "cluster house", "Palace", "4 Standard", None))), (k % 6 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", D.type_code(stated).alias("code"), D.group_of(F.when(k % 5 == 0, "H").otherwise("?"), stated).alias("grp"))


@query("active_result_filters", """WITH f AS (SELECT c_custkey // 3 AS view, CAST(c_custkey % 2 = 0 AS INTEGER) + CAST(c_nationkey > 10 AS INTEGER) AS n, c_custkey % 5 <> 0 AS is_on, c_custkey // 3 % 4 AS d FROM customer)
SELECT view, CAST(sum(CASE WHEN is_on THEN n ELSE 0 END) + max(CAST(NOT is_on AS INTEGER)) + max(CAST(d > 0 AS INTEGER)) AS BIGINT) AS active FROM f GROUP BY view""")
def active_result_filters(spark, sf_dir):
    """Filters in use: set fields of the groups that are on, one if a type is off, one if districts are chosen."""
    k = F.col("c_custkey")
    forms = table(spark, sf_dir, "customer").select(F.floor(k / 3).alias("view"), ((k % 2 == 0).cast("int") + (F.col("c_nationkey") > 10).cast("int")).alias("n"), (k % 5 != 0).alias("is_on"), (F.floor(k / 3) % 4).alias("d"))
    return V.active_filters(forms, "view", F.col("n"), F.col("is_on"), F.col("d"))


@query("unit_filter_floorplans", f"WITH {H.UNITS} SELECT listing_id FROM unit WHERE coalesce(price >= 15000, false) AND line % 2 = 0")
def unit_filter_floorplans(spark, sf_dir):
    rows = H.units(spark, sf_dir).withColumn("floorplans", F.when(F.col("line") % 2 == 0, F.array(F.lit("plan"))).when(F.col("line") % 3 == 0, F.array().cast("array<string>")))
    return rows.filter(matches_unit(price=(15000, None), floorplans=True)).select("listing_id")


#: The corners of a nation's area, from its middle, in degrees: fixed, uneven and not convex.
CORNERS = [(0.05, 0.0), (0.02, 0.02), (0.0, 0.035), (-0.04, 0.01), (-0.03, -0.03), (0.01, -0.01)]


@query("points_in_areas", f"""WITH {H.PROJECT}, corner(k, dx, dy) AS (VALUES {", ".join(f"({k}, CAST({dx} AS DOUBLE), CAST({dy} AS DOUBLE))" for k, (dx, dy) in enumerate(CORNERS))}),
 spot AS (SELECT n_nationkey, k, CAST(103.6 AS DOUBLE) + (n_nationkey % 5) * CAST(0.11 AS DOUBLE) + dx AS x, CAST(1.18 AS DOUBLE) + (n_nationkey // 5) * CAST(0.07 AS DOUBLE) + dy AS y FROM nation, corner),
 edge AS (SELECT n_nationkey, x AS x1, y AS y1, lead(x, 1, first) OVER w AS x2, lead(y, 1, first_y) OVER w AS y2 FROM (SELECT *, first_value(x) OVER (PARTITION BY n_nationkey ORDER BY k) AS first, first_value(y) OVER (PARTITION BY n_nationkey ORDER BY k) AS first_y FROM spot) WINDOW w AS (PARTITION BY n_nationkey ORDER BY k))
SELECT property_id, n_nationkey FROM project, edge WHERE longitude IS NOT NULL AND (y1 > latitude) <> (y2 > latitude) AND longitude < (x2 - x1) * (latitude - y1) / (y2 - y1) + x1 GROUP BY property_id, n_nationkey HAVING count(*) % 2 = 1""")
def points_in_areas(spark, sf_dir):
    """Which area every project's place lies in: a join by grid cells."""
    k = F.col("n_nationkey")
    x, y = F.lit(103.6) + (k % 5) * F.lit(0.11), F.lit(1.18) + F.floor(k / 5) * F.lit(0.07)
    ring = F.array(*(F.struct((x + F.lit(dx)).alias("x"), (y + F.lit(dy)).alias("y")) for dx, dy in CORNERS))
    areas = table(spark, sf_dir, "nation").select("n_nationkey", ring.alias("ring"))
    places = H.project_records(spark, sf_dir).select("property_id", F.col("longitude").alias("x"), F.col("latitude").alias("y"))
    return points_in_polygons(places, areas, "n_nationkey", 0.02).select("property_id", "n_nationkey")
