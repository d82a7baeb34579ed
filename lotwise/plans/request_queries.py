"""Requests, links, small labels, job views and framed events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dimensions as D
from ..functions import requests as R
from ..functions import scalars as X
from ..operators import listings as L
from ..operators import stores as S
from ..operators import transcripts as T
from ..sources.tables import table
from . import hosts as H
from .registry import query


@query("sse_roundtrip", "SELECT event_id, event_type AS kind, props AS content FROM events WHERE event_id % 5 <> 0")
def sse_roundtrip(spark, sf_dir):
    """Events framed as server-sent lines and read again; broken frames are skipped."""
    frame = T.framed(F.col("event_type"), F.col("props"))
    broken = F.when(F.col("event_id") % 10 == 0, F.lit("data: {broken\n\n")).otherwise(F.lit(": comment\n\n"))
    return T.unframed(table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, broken).otherwise(frame).alias("frame")), "frame", "event_id")


@query("search_query_string", """SELECT c_custkey, concat_ws('&', 'minPrice=' || c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'keyword=a+b%26' || c_nationkey END, 'district=D01', CASE WHEN c_custkey % 3 = 0 THEN 'district=D02' END, CASE WHEN c_custkey % 5 = 0 THEN 'isVerified=true' END) AS query FROM customer""")
def search_query_string(spark, sf_dir):
    k = F.col("c_custkey")
    scalars = {"minPrice": k, "maxPrice": F.lit(None).cast("int"), "keyword": F.when(k % 2 == 0, F.concat(F.lit("a b&"), F.col("c_nationkey").cast("string")))}
    lists = {"district": F.when(k % 3 == 0, F.array(F.lit("D01"), F.lit("D02"))).otherwise(F.array(F.lit("D01"))), "tenure": F.lit(None).cast("array<string>")}
    return table(spark, sf_dir, "customer").select("c_custkey", R.query_string(scalars, lists, {"isVerified": k % 5 == 0, "withStream": F.lit(None).cast("boolean")}).alias("query"))


PLACE = "CASE WHEN p_partkey % 3 = 0 THEN p_size || ',' || (p_size + 100) WHEN p_partkey % 3 = 1 THEN trim(p_type) || ', Singapore' END"


@query("map_links", f"""SELECT p_partkey, {PLACE} AS place, 'https://www.google.com/maps/search/?api=1&query=' || replace(replace({PLACE}, ',', '%2C'), ' ', '%20') AS link, 'https://www.google.com/maps?q=' || replace(replace({PLACE}, ',', '%2C'), ' ', '%20') || '&z=17&output=embed' AS embed FROM part""")
def map_links(spark, sf_dir):
    """What a map is asked for: coordinates, else the address in its country, else nothing; and the links."""
    k, size = F.col("p_partkey"), F.col("p_size")
    place = X.map_query(F.when(k % 3 == 0, size), F.when(k % 3 == 0, size + 100), F.when(k % 3 == 1, F.concat(F.lit(" "), "p_type")))
    return table(spark, sf_dir, "part").select("p_partkey", place.alias("place"), X.map_link(place).alias("link"), X.map_embed(place).alias("embed"))


@query("digits_grouped", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '.5' ELSE format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) || CASE o_orderkey % 3 WHEN 1 THEN '.05' ELSE '.' END END AS shown FROM orders""")
def digits_grouped(spark, sf_dir):
    """Typed text to digits with one point, thousands grouped, the fraction as typed."""
    whole, k = F.floor("o_totalprice").cast("bigint").cast("string"), F.col("o_orderkey") % 3
    typed = F.when(k == 0, F.lit("S$ .5")).otherwise(F.concat(F.lit("S$ "), whole, F.when(k == 1, ".0.5 x").otherwise(".")))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.grouped_digits(X.digits_and_point(typed)).alias("shown"))


@query("photo_names", "SELECT p_partkey, 'img-' || p_partkey || '-' || lpad(CAST(1 + p_partkey % 9 AS VARCHAR), 2, '0') || CASE WHEN p_partkey % 2 = 0 THEN '.webp' ELSE '.jpg' END AS name FROM part")
def photo_names(spark, sf_dir):
    """File names from the link, the place in the carousel and the type that was served."""
    k = F.col("p_partkey")
    url = F.concat(F.lit("https://x.example/a/img-"), k.cast("string"), F.lit(".png?w=3"))
    return table(spark, sf_dir, "part").select("p_partkey", X.photo_file(url, 1 + k % 9, F.when(k % 2 == 0, "image/webp").otherwise("image/jpeg")).alias("name"))


@query("progress_text", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'cached' WHEN 1 THEN 'page ' || (o_orderkey % 7) || ' of 7' WHEN 2 THEN (o_orderkey % 5) || ' of 7' ELSE '' END AS detail FROM orders")
def progress_text(spark, sf_dir):
    k = F.col("o_orderkey")
    phase = F.when(k % 4 == 1, "search").when(k % 4 == 3, "queued").otherwise("detail")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.progress_detail(phase, F.when(k % 4 == 1, k % 7).otherwise(k % 5), F.when(k % 4 == 0, 0).otherwise(7)).alias("detail"))


@query("job_view", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'scraping' ELSE 'failed' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 9 END AS pages_fetched, 0 AS details_fetched,
 CASE WHEN o_orderstatus = 'F' AND n > 0 THEN n ELSE 0 END AS listings, o_orderstatus = 'F' AND n IS NULL AS expired
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linenumber > 2 GROUP BY l_orderkey) ON l_orderkey = o_orderkey""")
def job_view(spark, sf_dir):
    """Jobs with their result: only succeeded ones show it, and one whose result is gone has expired."""
    results = table(spark, sf_dir, "lineitem").filter("l_linenumber > 2").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "scraping").otherwise("failed")
    pages = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 9)
    jobs = table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"), pages.alias("pages_fetched"), F.lit(None).cast("bigint").alias("details_fetched"))
    return S.job_views(jobs, results, "o_orderkey", ["pages_fetched", "details_fetched"])


@query("shortlist_photos", f"""WITH {H.ACTION}, s AS (SELECT event_id, k FROM action WHERE event_type = 'purchase'), p AS (SELECT CAST(p_partkey AS VARCHAR) AS k, '/p' || p_partkey || '.jpg' AS photo FROM part WHERE p_partkey % 2 = 0)
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '/own.jpg' ELSE coalesce(photo, '') END AS photos FROM s LEFT JOIN p USING (k)""")
def shortlist_photos(spark, sf_dir):
    """Entries without photos of their own get those that are stored."""
    entries = H.actions(spark, sf_dir).filter("event_type = 'purchase'").select("event_id", "k", F.when(F.col("event_id") % 4 == 0, F.array(F.lit("/own.jpg"))).otherwise(F.array().cast("array<string>")).alias("photos"))
    stored = table(spark, sf_dir, "part").filter("p_partkey % 2 = 0").select(F.col("p_partkey").cast("string").alias("k"), F.array(F.concat(F.lit("/p"), F.col("p_partkey").cast("string"), F.lit(".jpg"))).alias("photos"))
    return L.with_stored_photos(entries, stored, "k").select("event_id", F.array_join("photos", ",").alias("photos"))


@query("hero_photo_first", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'a,b' WHEN p_partkey % 3 = 1 THEN 'a,b' ELSE 'hero,a,b' END AS photos FROM part")
def hero_photo_first(spark, sf_dir):
    """The cover goes first unless the photos have it or there is none."""
    k = F.col("p_partkey")
    cover = F.when(k % 3 == 0, "b").when(k % 3 == 2, "hero")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.cover_first(F.array(F.lit("a"), F.lit("b")), cover), ",").alias("photos"))


@query("tree_roundtrip", f"""WITH {H.UNITS} SELECT property_key, coalesce(bedrooms, 0) AS bedrooms, CASE WHEN coalesce(bedrooms, 0) = 0 THEN 'Studio or unlisted' ELSE bedrooms || ' bedroom' END AS label, listing_id, price, bathrooms, floor_area, psf, listed_at, CAST(0 AS INTEGER) AS photo_count FROM unit""")
def tree_roundtrip(spark, sf_dir):
    """The nested result opened again: one row a unit, with what it has of its own and its type."""
    return L.tree_units(L.nested_properties(H.units(spark, sf_dir), H.ARRIVAL))


@query("unit_removal", f"""WITH {H.UNITS}, kept AS (SELECT * FROM unit WHERE listing_id % 3 <> 0) SELECT property_key, count(DISTINCT coalesce(bedrooms, 0)) AS unit_types, count(*) AS units FROM kept GROUP BY property_key""")
def unit_removal(spark, sf_dir):
    """Units taken out: types and properties that are left without any go as well."""
    units = H.units(spark, sf_dir)
    kept = L.without_units(units, units.filter("listing_id % 3 = 0"))
    return L.unit_types(kept).groupBy("property_key").agg(F.count("*").alias("unit_types"), F.sum("unit_count").alias("units"))


@query("district_codes", "SELECT CASE WHEN n_regionkey < 2 THEN 'D' || lpad(CAST(n_regionkey + 1 AS VARCHAR), 2, '0') ELSE 'D' || lpad(CAST(n_regionkey + 19 AS VARCHAR), 2, '0') END AS code, count(*) AS nations, CASE n_regionkey WHEN 0 THEN 'City & South West' WHEN 1 THEN 'City & South West' WHEN 2 THEN 'Newton / Bt. Timah' ELSE 'West' END AS region FROM nation GROUP BY n_regionkey")
def district_codes(spark, sf_dir):
    """Codes from the place in a list, with their region, joined to rows that have them."""
    rows = table(spark, sf_dir, "nation").select(F.when(F.col("n_regionkey") < 2, F.col("n_regionkey") + 1).otherwise(F.col("n_regionkey") + 19).alias("n"))
    coded = rows.select(F.concat(F.lit("D"), F.lpad(F.col("n").cast("string"), 2, "0")).alias("code"))
    return coded.join(D.districts(spark), "code").groupBy("code", "region").agg(F.count("*").alias("nations")).select("code", "nations", "region")


@query("tool_calls", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'plain' ELSE 'find_' || event_type END AS tool, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'k' || event_id % 9 END AS args, CASE WHEN event_id % 3 <> 0 AND event_id % 2 = 0 THEN 'ok' ELSE '' END AS result FROM events")
def tool_calls(spark, sf_dir):
    """Tool steps: the bare name is what follows the last double underscore; then arguments and result."""
    n = F.col("event_id")
    text = F.concat(F.lit("mcp__page__find_"), "event_type", F.lit("(k"), (n % 9).cast("string"), F.lit(")"), F.when(n % 2 == 0, " → ok").otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", X.tool_call(F.when(n % 3 == 0, "plain").otherwise(text)).alias("c")).select("event_id", "c.*")


@query("tool_steps", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'WebSearch(q' || event_id || ')' WHEN 1 THEN 'look(1' || event_type || ')' WHEN 2 THEN 'look' ELSE 'WebSearch' END AS step FROM events""")
def tool_steps(spark, sf_dir):
    """Steps from a tool's input: some tools have arguments that say what they do, others show their first short one."""
    n = F.col("event_id")
    name = F.when(n % 4 == 0, "x__WebSearch").when(n % 4 == 3, "WebSearch").otherwise("a__b__look")
    keys = F.when(n % 4 == 0, F.array(F.lit("n"), F.lit("query"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    values = F.when(n % 4 == 0, F.array(F.lit("9"), F.concat(F.lit("q"), n.cast("string")))).when(n % 4 == 1, F.array(F.repeat(F.lit("y"), 121), F.concat(F.lit("1"), "event_type"))).otherwise(F.array(F.repeat(F.lit("y"), 121), F.repeat(F.lit("z"), 200)))
    return table(spark, sf_dir, "events").select("event_id", X.tool_step(name, keys, values).alias("step"))


@query("prompt_history", "SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS history, count(*) AS turns FROM conversations GROUP BY conv_id")
def prompt_history(spark, sf_dir):
    """Whole turns as a transcript."""
    return T.history(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


@query("prompt_envelope", """WITH h AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS history FROM conversations GROUP BY conv_id)
SELECT conv_id, '<page_context>' || chr(10) || 'page ' || conv_id || chr(10) || '</page_context>' || chr(10) || chr(10) || '<page_actions>' || chr(10) || '### hide' || chr(10) || 'Hides it' || chr(10) || CASE WHEN conv_id % 2 = 0 THEN 'Parameters:' || chr(10) || '  - id: the id' || chr(10) ELSE '' END || 'Example: <act>{}</act>' || chr(10) || chr(10) || '</page_actions>' || chr(10) || chr(10)
 || CASE WHEN conv_id % 3 = 0 THEN '' ELSE '<conversation_so_far>' || chr(10) || history || chr(10) || '</conversation_so_far>' || chr(10) || chr(10) END || '<user_message>' || chr(10) || 'go' || chr(10) || '</user_message>' || chr(10) || chr(10) AS prompt FROM h""")
def prompt_envelope(spark, sf_dir):
    """Page, actions, conversation and message as one prompt."""
    k, none = F.col("conv_id"), F.array().cast("array<string>")
    action = T.action_text(F.lit("hide"), F.lit("Hides it"), F.when(k % 2 == 0, F.array(F.lit("id"))).otherwise(none), F.when(k % 2 == 0, F.array(F.lit("the id"))).otherwise(none), F.lit("{}"))
    h = T.history(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return h.select("conv_id", T.prompt_text(F.concat(F.lit("page "), k.cast("string")), action, F.when(k % 3 != 0, F.col("history")), F.lit("go")).alias("prompt"))


@query("poll_gives_up", f"""WITH {H.ACTION}, e AS (SELECT user_id, event_id, event_type = 'error' AS bad FROM action), s AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM e),
 r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) AS nth FROM s WHERE bad) SELECT user_id, min(event_id) AS gave_up FROM r WHERE nth >= 2 GROUP BY user_id""")
def poll_gives_up(spark, sf_dir):
    """The event at which a poller stops: the second error in a row."""
    return T.gave_up(H.actions(spark, sf_dir), F.col("event_type") == "error", "user_id", "event_id", 2)


@query("clean_links", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE url || ',https://b.example/x' END AS links, 'a_' || page_id AS session, CASE WHEN page_id % 2 = 0 THEN CAST(page_id AS VARCHAR) END AS ref FROM pages")
def clean_links(spark, sf_dir):
    p = F.col("page_id")
    links = F.array(F.concat(F.lit(" "), "url", F.lit("\n")), F.when(p % 3 == 0, F.lit("javascript:alert(1)")).otherwise(F.lit("https://b.exa mple/x")))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(R.clean_links(links), ",").alias("links"), R.plain_session(F.concat(F.lit("a_ /."), p.cast("string"))).alias("session"), R.optional_id(F.when(p % 2 == 0, F.concat(F.lit(" "), p.cast("string"))).otherwise(F.lit("  "))).alias("ref"))


VIEW = "(SELECT p_partkey, 1 + p_size % 5 AS z, least(0.0, greatest((1 - (1 + p_size % 5)) * 100.0, -(p_partkey % 300))) AS x, least(0.0, greatest((1 - (1 + p_size % 5)) * 50.0, -(p_partkey % 70))) AS y FROM part)"


@query("viewport_of_view", f"SELECT p_partkey, CASE WHEN z > 1 THEN round(-x / z, 6) END AS min_x, CASE WHEN z > 1 THEN round(-y / z, 6) END AS min_y, CASE WHEN z > 1 THEN round((100 - x) / z, 6) END AS max_x, CASE WHEN z > 1 THEN round((50 - y) / z, 6) END AS max_y FROM {VIEW}")
def viewport_of_view(spark, sf_dir):
    """The part of the map that a zoomed and moved view shows; nothing while it is at rest."""
    zoom = (1 + F.col("p_size") % 5).cast("double")
    box = X.viewport(zoom, -(F.col("p_partkey") % 300).cast("double"), -(F.col("p_partkey") % 70).cast("double"), 100.0, 50.0)
    return table(spark, sf_dir, "part").select("p_partkey", box.alias("b")).select("p_partkey", *(F.round(f"b.{c}", 6).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")))


@query("groups_in_both", f"WITH {H.UNITS} SELECT grp, string_agg(DISTINCT district, ',' ORDER BY district) AS districts FROM unit WHERE grp IN ('H', 'L') AND district IN ('D02', 'D04', 'D09', 'D11', 'D20') GROUP BY grp")
def groups_in_both(spark, sf_dir):
    """Groups and districts that both the results and the filter have."""
    chosen = F.array(*(F.lit(d) for d in ("D02", "D04", "D09", "D11", "D20", "D28")))
    rows = H.units(spark, sf_dir).filter(F.col("grp").isin("H", "L") & F.array_contains(chosen, F.col("district")))
    return rows.groupBy("grp").agg(F.array_join(F.array_sort(F.array_intersect(F.collect_set("district"), chosen)), ",").alias("districts"))


@query("number_rejects", "SELECT c_custkey, CASE c_custkey % 5 WHEN 1 THEN 'negative' WHEN 2 THEN 'number' WHEN 3 THEN 'range' END AS reason FROM customer WHERE c_custkey % 5 IN (1, 2, 3)")
def number_rejects(spark, sf_dir):
    """Requests in a table: those whose bounds can't be read or cross, with the reason."""
    k = F.col("c_custkey") % 5
    low, high = F.when(k == 1, "-4").when(k == 2, "12.7").when(k == 3, "90").otherwise("10"), F.when(k == 4, F.lit(None).cast("string")).otherwise("50")
    return table(spark, sf_dir, "customer").select("c_custkey", R.number_problem(low, high).alias("reason")).filter("reason is not null")
