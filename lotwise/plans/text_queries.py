"""Labels, summaries, reports, set operations and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import area_label, bedroom_label, changed, day_label, entity_key, half_up, money, money_per_area, placeholder, selection_state, tail, squeezed, tenure_label, toggled_group, toggled_region
from ..operators import listings as L
from ..operators import text as X
from ..sources.tables import table
from . import hosts as H
from .listing_queries import PROPERTY
from .registry import query


@query("labels_formats", f"""WITH {H.LISTING}, d AS (SELECT *, ({H.NOW} - listed_at) // 86400 AS days FROM rated)
SELECT listing_id, raw_price, CASE WHEN coalesce(bedrooms, 0) = 0 THEN 'Studio or unlisted' ELSE bedrooms || ' bedroom' END AS bedroom_label,
 CASE tenure_code WHEN 'L99' THEN '99-year leasehold' WHEN 'F' THEN 'Freehold' ELSE tenure_code END AS tenure_label, 'S$ ' || format('{{:,}}', price) AS price_label, CASE WHEN psf IS NULL THEN 'Not available' ELSE 'S$ ' || format('{{:,}}', psf) || ' psf' END AS psf_label, CASE WHEN floor_area IS NULL THEN 'Not available' ELSE format('{{:,}}', floor_area) || ' sqft' END AS area_label,
 CASE WHEN days <= 0 THEN 'today' WHEN days = 1 THEN 'yesterday' WHEN days < 7 THEN days || ' days ago' ELSE strftime(to_timestamp(listed_at), '%-d %b %Y') END AS listed_label FROM d""")
def labels_formats(spark, sf_dir):
    rows = H.listings(spark, sf_dir)
    return rows.select("listing_id", "raw_price", bedroom_label(F.col("bedrooms")).alias("bedroom_label"), tenure_label(F.col("tenure_code")).alias("tenure_label"), money(F.col("price")).alias("price_label"), money_per_area(F.col("psf")).alias("psf_label"), area_label(F.col("floor_area")).alias("area_label"), day_label(F.col("listed_at"), H.NOW).alias("listed_label"))


@query("placeholder_half_up", f"WITH {H.LISTING} SELECT listing_id, raw_price, CAST(floor(raw_price / 8 + 0.5) AS BIGINT) AS eighth, 'Min ' || format('{{:,}}', CAST(floor(raw_price / 8 + 0.5) AS BIGINT)) AS shown FROM rated")
def placeholder_half_up(spark, sf_dir):
    return H.listings(spark, sf_dir).select("listing_id", "raw_price", half_up(F.col("raw_price") / 8).alias("eighth"), placeholder("Min", F.col("raw_price") / 8).alias("shown"))


@query("suggested_name", """WITH t AS (SELECT c_custkey, c_name || ', ' || c_mktsegment || ', nation number ' || c_nationkey || ', balance ' || (c_custkey % 1000) || ' and some more' AS long FROM customer)
SELECT c_custkey, CASE WHEN length(long) <= 60 THEN long ELSE coalesce(nullif(regexp_extract(substr(long, 1, 60), '^(.+), ', 1), ''), rtrim(substr(long, 1, 60))) END AS name FROM t""")
def suggested_name(spark, sf_dir):
    long = F.concat("c_name", F.lit(", "), "c_mktsegment", F.lit(", nation number "), F.col("c_nationkey").cast("string"), F.lit(", balance "), (F.col("c_custkey") % 1000).cast("string"), F.lit(" and some more"))
    return table(spark, sf_dir, "customer").select("c_custkey", X.shortened(long).alias("name"))


LINE = "name || ' | ' || 'from ' || CASE WHEN price_min = 0 THEN 'Not available' ELSE 'S$ ' || format('{:,}', price_min) END || ' | ' || unit_count || CASE WHEN unit_count = 1 THEN ' unit' ELSE ' units' END || coalesce(' | ' || district, '')"


@query("context_lines", f"WITH {PROPERTY} SELECT property_key, {LINE} AS line FROM property")
def context_lines(spark, sf_dir):
    props = L.properties(H.units(spark, sf_dir), H.ARRIVAL)
    return props.select("property_key", X.property_line(F.col("name"), F.col("price_min"), F.col("unit_count"), F.col("district")).alias("line"))


@query("saved_search_summary", f"""WITH {H.HIDDEN}, c AS (SELECT scope, id, count(*) FILTER (event_type = 'error') AS h, count(*) FILTER (event_type = 'click') AS b FROM entity GROUP BY scope, id)
SELECT scope, id, concat_ws(', ', CASE WHEN h > 0 THEN h || ' items hidden' END, CASE WHEN b > 0 THEN b || ' bookmarked' END) AS summary FROM c""")
def saved_search_summary(spark, sf_dir):
    a = H.actions(spark, sf_dir)
    unit = (F.col("k").cast("bigint") * 10 + 1 + F.col("event_id") % 7).cast("string")
    c = a.select("event_type", "scope", F.when(F.col("scope") == "property", F.col("k")).otherwise(unit).alias("id")).groupBy("scope", "id").agg(F.count_if(F.col("event_type") == "error").alias("h"), F.count_if(F.col("event_type") == "click").alias("b"))
    return c.select("scope", "id", X.count_phrases((F.col("h"), "items hidden"), (F.col("b"), "bookmarked")).alias("summary"))


@query("set_ops_except", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 40")
def set_ops_except(spark, sf_dir):
    part, returned = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_quantity >= 40")
    return part.join(returned, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey").distinct()


@query("set_ops_intersect", "SELECT c_mktsegment, c_nationkey FROM customer WHERE c_custkey % 2 = 0 INTERSECT SELECT c_mktsegment, c_nationkey FROM customer WHERE c_custkey % 2 = 1")
def set_ops_intersect(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.filter("c_custkey % 2 = 0").select("c_mktsegment", "c_nationkey").intersect(c.filter("c_custkey % 2 = 1").select("c_mktsegment", "c_nationkey"))


@query("region_toggle", """WITH r AS (SELECT r_regionkey, list_sort(list(n_name)) AS names FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey),
 s AS (SELECT *, CASE WHEN r_regionkey % 2 = 0 THEN names ELSE list_filter(names, lambda x: x < 'J') END AS selected FROM r),
 t AS (SELECT r_regionkey, CASE WHEN len(selected) = len(names) THEN [] ELSE names END AS after, len(selected) AS n, len(names) AS total FROM s)
SELECT r_regionkey, array_to_string(after, ',') AS after, CASE WHEN n = 0 THEN 'none' WHEN n = total THEN 'all' ELSE 'some' END AS state FROM t""")
def region_toggle(spark, sf_dir):
    names = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    s = names.withColumn("selected", F.when(F.col("r_regionkey") % 2 == 0, F.col("names")).otherwise(F.filter("names", lambda x: x < "J")))
    state = selection_state(F.col("selected"), F.col("names"))
    return s.select("r_regionkey", F.array_join(toggled_region(F.col("selected"), F.col("names")), ",").alias("after"), state.alias("state"))


@query("group_toggle", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'N,H' WHEN 1 THEN 'N' WHEN 2 THEN 'N,H,L' ELSE 'N,L' END AS groups FROM customer")
def group_toggle(spark, sf_dir):
    k = F.col("c_custkey") % 4
    selected = F.when(k == 0, F.array(F.lit("N"))).when(k == 1, F.array(F.lit("N"))).when(k == 2, F.array(F.lit("L"), F.lit("N"))).otherwise(F.array(F.lit("L"), F.lit("N"), F.lit("H")))
    group = F.when(k == 1, F.lit("N")).otherwise(F.lit("H"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(toggled_group(selected, group), ",").alias("groups"))


@query("active_filter_count", """SELECT c_custkey, CAST((c_custkey % 2 = 0) AS BIGINT) + CAST((c_custkey % 3 = 0) AS BIGINT) + CAST((c_nationkey > 10) AS BIGINT) + CAST((c_mktsegment = 'BUILDING') AS BIGINT) AS active FROM customer""")
def active_filter_count(spark, sf_dir):
    """Set fields of a filter form, unpivoted."""
    c = table(spark, sf_dir, "customer")
    form = c.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "1").alias("min_price"), F.when(F.col("c_custkey") % 3 == 0, "2").alias("max_price"), F.when(F.col("c_nationkey") > 10, "3").alias("min_size"), F.when(F.col("c_mktsegment") == "BUILDING", "4").alias("types"))
    return form.unpivot("c_custkey", ["min_price", "max_price", "min_size", "types"], "field", "value").groupBy("c_custkey").agg(F.count_if(F.coalesce(F.col("value") != "", F.lit(False))).alias("active"))


@query("entity_validation_rejects", """WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'property' WHEN 1 THEN 'unit' WHEN 2 THEN 'other' END AS scope, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'a b' ELSE 'id_' || event_id END AS id FROM events)
SELECT event_id, coalesce(scope, '') || '#' || id AS entity_key, concat_ws(',', CASE WHEN NOT coalesce(scope IN ('property', 'unit'), false) THEN 'scope' END, CASE WHEN NOT regexp_matches(id, '^[A-Za-z0-9_-]+$') THEN 'id' END) AS reasons
FROM e WHERE NOT coalesce(scope IN ('property', 'unit'), false) OR NOT regexp_matches(id, '^[A-Za-z0-9_-]+$')""")
def entity_validation_rejects(spark, sf_dir):
    n = F.col("event_id")
    scope = F.when(n % 4 == 0, "property").when(n % 4 == 1, "unit").when(n % 4 == 2, "other")
    key = F.when(n % 5 == 0, "").when(n % 5 == 1, "a b").otherwise(F.concat(F.lit("id_"), n.cast("string")))
    rows = table(spark, sf_dir, "events").select("event_id", scope.alias("scope"), key.alias("id"))
    bad = X.rejected(rows, {"scope": F.col("scope").isin("property", "unit"), "id": F.col("id").rlike(r"^[\p{L}\p{N}_-]{1,100}$")})
    return bad.select("event_id", entity_key(F.coalesce("scope", F.lit("")), F.col("id")).alias("entity_key"), F.array_join("reasons", ",").alias("reasons"))


@query("request_change_detection", "SELECT c_custkey, c_custkey % 3 = 0 OR c_nationkey = 5 AS changed FROM customer")
def request_change_detection(spark, sf_dir):
    """Requests compared in their canonical text, where a missing field and a null one are the same."""
    request = lambda low, high: F.struct(low.alias("min"), high.alias("max"), F.col("c_mktsegment").alias("type"))
    old = request(F.col("c_custkey"), F.lit(None).cast("int"))
    new = request(F.when(F.col("c_custkey") % 3 == 0, F.lit(-1)).otherwise(F.col("c_custkey")), F.when(F.col("c_nationkey") == 5, F.lit(9)))
    return table(spark, sf_dir, "customer").select("c_custkey", changed(old, new).alias("changed"))


@query("text_hygiene", "SELECT doc_id, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS n FROM documents")
def text_hygiene(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.length(squeezed(F.col("text"))).cast("bigint").alias("n"))


@query("error_tails", "SELECT doc_id, right(text, 4000) AS detail FROM documents")
def error_tails(spark, sf_dir):
    """The end of long details."""
    return table(spark, sf_dir, "documents").select("doc_id", tail(F.col("text")).alias("detail"))


@query("page_context", """SELECT c_custkey, '**Current date and time**: now' || chr(10) || chr(10) || '**Current page**: ' || c_name || chr(10) || chr(10) || '**Page description**:' || chr(10) || 'Title: t' || chr(10) || 'Purpose: p' || chr(10) || 'Layout: l' || chr(10) || '- one' || chr(10) || '- two' || chr(10) || 'Notes: n' || chr(10) || chr(10) || 'details ' || c_custkey
 || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || chr(10) || '**Available actions**:' || chr(10) || '- hide: Hides it' || chr(10) || '  - id: the id' || chr(10) || '  Example: {}' ELSE '' END AS context FROM customer""")
def page_context(spark, sf_dir):
    action = F.struct(F.lit("hide").alias("name"), F.lit("Hides it").alias("description"), F.create_map(F.lit("id"), F.lit("the id")).alias("parameters"), F.lit("{}").alias("example"))
    actions = F.filter(F.array(action), lambda a: F.col("c_custkey") % 2 == 0)
    text = X.page_context(F.lit("now"), F.col("c_name"), F.lit("t"), F.lit("p"), F.lit("l"), F.array(F.lit("one"), F.lit("two")), F.lit("n"), F.concat(F.lit("details "), F.col("c_custkey").cast("string")), actions)
    return table(spark, sf_dir, "customer").select("c_custkey", text.alias("context"))
