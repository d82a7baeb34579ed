"""Filter forms, their requests and descriptions, and records that come in from outside."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dimensions as D
from ..operators import forms as M
from ..operators import records as C
from ..sources.tables import table
from . import hosts as H
from .registry import query

#: A form a customer: a condition on the key ``k`` and what the field holds where it is true.
TEXTS = {
    "minPrice": ("k % 2 = 0", "CAST(k AS VARCHAR(20))"), "maxPrice": ("k % 4 = 0", "CAST(k + 500 AS VARCHAR(20))"), "minSize": ("k % 5 = 0", "'10'"), "maxSize": ("false", "''"), "minSizeLand": ("k % 7 = 0", "' 200 '"), "maxSizeLand": ("k % 7 = 1", "'x'"), "minPsf": ("false", "''"),
    "maxPsf": ("k % 6 = 0", "'9'"), "minTop": ("k % 8 = 0", "'1990'"), "maxTop": ("false", "''"), "lastPosted": ("k % 9 = 0", "'7'"), "distanceToMrt": ("k % 10 = 0", "'0.5'"), "keyword": ("k % 11 = 0", "' sea view '"),
}
LISTS = {
    "bedrooms": ("k % 2 = 0", ["0", "5"]), "bathrooms": ("k % 3 = 0", ["2"]), "propertyTypeCode": ("k % 3 = 0", ["APT", "CONDO"]), "districtCode": ("k % 5 = 0", ["D09", "D99"]), "tenureCode": ("k % 7 = 0", ["F", "L99"]), "floorLevel": ("k % 4 = 0", ["LOW"]),
    "furnishing": ("k % 5 = 1", ["FULL"]), "unitFeatures": ("k % 6 = 0", ["BAL", "TERR"]), "projectFeatures": ("k % 8 = 0", ["GYM"]), "listingFeatures": ("k % 2 = 1", ["isVerified", "withStream"]),
}
GROUP = "CASE k % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'H' ELSE 'L' END"
PAGES = "CASE WHEN k % 3 = 0 THEN '0' ELSE '2' END"
#: The same in SQL, lists as texts joined by commas; land is searched for where the types are land only.
FORM = f"""form AS (SELECT k, {GROUP} AS grp, {PAGES} AS pages, k % 6 = 2 AS land, {', '.join(f"CASE WHEN {c} THEN {v} ELSE '' END AS {n}" for n, (c, v) in TEXTS.items())},
 {', '.join(f"CASE WHEN {c} THEN '{','.join(v)}' ELSE '' END AS {n}" for n, (c, v) in LISTS.items() if n != 'propertyTypeCode')},
 CASE WHEN k % 3 = 0 THEN 'APT,CONDO' WHEN k % 6 = 2 THEN 'RLAND' WHEN k % 6 = 5 THEN 'RLAND,SEMI' ELSE '' END AS propertyTypeCode FROM (SELECT c_custkey AS k FROM customer))"""


def forms(spark, sf_dir):
    k = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    array = lambda values: F.array(*map(F.lit, values))
    empty = F.array().cast("array<string>")
    columns = {n: F.expr(f"CASE WHEN {c} THEN {v.replace('VARCHAR(20)', 'STRING')} ELSE '' END") for n, (c, v) in TEXTS.items()}
    columns |= {n: F.when(F.expr(c), array(v)).otherwise(empty) for n, (c, v) in LISTS.items()}
    columns["propertyTypeCode"] = F.when(F.expr("k % 3 = 0"), array(["APT", "CONDO"])).when(F.expr("k % 6 = 2"), array(["RLAND"])).when(F.expr("k % 6 = 5"), array(["RLAND", "SEMI"])).otherwise(empty)
    return k.select("k", F.expr(GROUP).alias("grp"), F.expr(PAGES).alias("maxPages"), *(c.alias(n) for n, c in columns.items()))


_number = lambda n: f"CAST(nullif(trim({n}), '') AS DOUBLE) AS {n}"
_unless_land = lambda n: f"CASE WHEN NOT land THEN nullif({n}, '') END AS {n}"
REQUEST = f"""request AS (SELECT k, grp, {_number('minPrice')}, {_number('maxPrice')}, CASE WHEN NOT land AND minSize <> '' THEN CAST(minSize AS DOUBLE) END AS minSize, CASE WHEN grp = 'L' AND minSizeLand <> '' THEN CAST(trim(minSizeLand) AS DOUBLE) END AS minSizeLand,
 CAST(NULL AS DOUBLE) AS maxSizeLand, {_number('maxPsf')}, CASE WHEN NOT land AND minTop <> '' THEN CAST(minTop AS DOUBLE) END AS minTop, {_number('lastPosted')}, {', '.join(map(_unless_land, ('bedrooms', 'bathrooms', 'furnishing', 'unitFeatures', 'projectFeatures')))},
 nullif(propertyTypeCode, '') AS propertyTypeCode, nullif(districtCode, '') AS districtCode, nullif(tenureCode, '') AS tenureCode, CASE WHEN grp <> 'L' THEN nullif(floorLevel, '') END AS floorLevel, nullif(trim(keyword), '') AS keyword, nullif(distanceToMrt, '') AS distanceToMrt, listingFeatures <> '' AS flags FROM form)"""
_SHOWN_NUMBERS = ("minPrice", "maxPrice", "minSize", "minSizeLand", "maxSizeLand", "maxPsf", "minTop", "lastPosted")
_SHOWN_LISTS = ("bedrooms", "bathrooms", "furnishing", "unitFeatures", "projectFeatures", "propertyTypeCode", "districtCode", "tenureCode", "floorLevel")


@query("request_by_group", f"WITH {FORM}, {REQUEST} SELECT * FROM request")
def request_by_group(spark, sf_dir):
    """Forms to requests: land size is for one group only, floor level for the others, and a search for land has no units."""
    r = forms(spark, sf_dir).select("k", "grp", M.request_filters(F.col("grp")).alias("f"))
    return r.select("k", "grp", *(F.col(f"f.{n}").alias(n) for n in _SHOWN_NUMBERS), *(F.array_join(f"f.{n}", ",").alias(n) for n in _SHOWN_LISTS), "f.keyword", "f.distanceToMrt", F.coalesce(F.col("f.isVerified") & F.col("f.withStream") & F.col("f.withFloorplans").isNull(), F.lit(False)).alias("flags"))


@query("form_of_request", f"""WITH {FORM}, {REQUEST} SELECT k, {', '.join(f"coalesce(CAST(CAST({n} AS BIGINT) AS VARCHAR), '') AS {n}" for n in _SHOWN_NUMBERS)}, {', '.join(f"coalesce({n}, '') AS {n}" for n in _SHOWN_LISTS)}, coalesce(keyword, '') AS keyword, CASE WHEN flags THEN 'isVerified,withStream' ELSE '' END AS listingFeatures FROM request""")
def form_of_request(spark, sf_dir):
    """Requests back to forms: every field is written; and the old form of a request is one search of the first group."""
    rows = forms(spark, sf_dir).select("k", M.request_filters(F.col("grp")).alias("f"))
    none = F.array().cast("array<struct<propertyTypeGroup:string,maxPages:int,filters:" + rows.schema["f"].dataType.simpleString() + ">>")
    old = rows.select("k", F.element_at(M.searches_of(none, F.lit(None).cast("int"), F.col("f")), 1).alias("s")).filter("s.propertyTypeGroup = 'N' and s.maxPages = 1")
    form = old.select("k", *M.form_fields(F.col("s.filters")))
    return form.select("k", *_SHOWN_NUMBERS, *(F.array_join(n, ",").alias(n) for n in _SHOWN_LISTS), "keyword", F.array_join("listingFeatures", ",").alias("listingFeatures"))


def _named(field: str, options: dict[str, str]) -> str:
    """SQL that replaces each code of a comma-joined text by its label."""
    cases = " ".join(f"WHEN '{c}' THEN '{label}'" for c, label in options.items())
    return f"array_to_string(list_transform(string_split({field}, ','), lambda c: CASE c {cases} ELSE c END), ', ')"


def _between(what: str, low: str, high: str, unit: str = "") -> str:
    return f"CASE WHEN {low} <> '' OR {high} <> '' THEN '{what} ' || coalesce(nullif({low}, ''), 'any') || ' to ' || coalesce(nullif({high}, ''), 'any') || '{unit}' END"


_MANY = {"bedrooms": ("bedrooms", D.BEDROOMS), "bathrooms": ("bathrooms", D.BATHROOMS), "property types": ("propertyTypeCode", D.ALL_TYPES), "districts": ("districtCode", {"D09": "D09 Orchard / River Valley"}), "tenure": ("tenureCode", D.TENURES), "floor level": ("floorLevel", D.FLOOR_LEVELS), "furnishing": ("furnishing", D.FURNISHINGS), "unit features": ("unitFeatures", D.UNIT_FEATURES), "facilities": ("projectFeatures", D.PROJECT_FEATURES)}
DESCRIBED = f"""described AS (SELECT *, coalesce(nullif(concat_ws(', ', {_between('price', 'minPrice', 'maxPrice')}, {_between('floor area', 'minSize', 'maxSize', ' sqft')}, {_between('land size', 'minSizeLand', 'maxSizeLand', ' sqft')}, {_between('psf', 'minPsf', 'maxPsf')}, {_between('TOP year', 'minTop', 'maxTop')},
 {', '.join(f"CASE WHEN {f} <> '' THEN '{what} ' || {_named(f, o)} END" for what, (f, o) in _MANY.items())}, CASE WHEN listingFeatures <> '' THEN 'verified listings, with video or virtual tour' END, CASE WHEN distanceToMrt <> '' THEN 'an MRT or LRT under 500 m away' END,
 CASE WHEN trim(keyword) <> '' THEN 'keyword "' || trim(keyword) || '"' END, CASE WHEN lastPosted <> '' THEN 'listed within 1 week' END, CASE WHEN pages <> '0' THEN pages || ' pages scanned' END), ''), 'no filters set') AS text,
 {' + '.join(f"CAST(trim({n}) <> '' AS BIGINT)" for n in (*TEXTS, *LISTS))} AS n FROM form)"""


@query("filter_summary", f"WITH {FORM}, {DESCRIBED} SELECT k, text AS summary, n FROM described")
def filter_summary(spark, sf_dir):
    """A form as one sentence, and the number of its fields that are set."""
    return forms(spark, sf_dir).select("k", M.description().alias("summary"), M.count_set().alias("n"))


_LABEL = "CASE grp WHEN 'N' THEN 'Condo' WHEN 'H' THEN 'HDB' ELSE 'Landed' END"


@query("search_summaries", f"""WITH {FORM}, {DESCRIBED}, s AS (SELECT *, CASE WHEN k % 10 = 1 THEN 100000 + k ELSE k // 3 END AS search, {_LABEL} AS label, CASE grp WHEN 'N' THEN 1 WHEN 'H' THEN 2 ELSE 3 END AS place FROM described)
SELECT search, string_agg(label || ' (' || text || ')', ', ' ORDER BY place) AS full, CASE WHEN count(*) = 1 THEN any_value(label || ', ' || text) ELSE string_agg(label || ' (' || CASE n WHEN 0 THEN 'no filters' WHEN 1 THEN '1 filter' ELSE n || ' filters' END || ')', ', ' ORDER BY place) END AS summary FROM s GROUP BY search""")
def search_summaries(spark, sf_dir):
    """Searches of several groups in full, and as one line of a list."""
    rows = forms(spark, sf_dir).withColumn("search", F.when(F.col("k") % 10 == 1, 100_000 + F.col("k")).otherwise(F.floor(F.col("k") / 3)))
    return M.search_lines(rows, "search", ["k"])


@query("more_filters_count", f"""WITH {FORM} SELECT k, {' + '.join(f"CAST({n} <> '' AS BIGINT)" for n in ('minPsf', 'maxPsf', 'districtCode', 'listingFeatures', 'lastPosted', 'distanceToMrt', 'keyword'))} + CASE WHEN grp <> 'L' AND floorLevel <> '' THEN 1 ELSE 0 END
 + CASE WHEN land THEN 0 ELSE {' + '.join(f"CAST({n} <> '' AS BIGINT)" for n in ('bedrooms', 'bathrooms', 'furnishing', 'unitFeatures', 'projectFeatures'))} END AS more, land FROM form""")
def more_filters_count(spark, sf_dir):
    """Set fields behind "more filters" that the group shows, and whether a search is for land alone."""
    return forms(spark, sf_dir).select("k", M.count_more(F.col("grp")).alias("more"), M.is_land_only(F.col("grp"), F.col("propertyTypeCode")).alias("land"))


@query("lent_districts", f"WITH {FORM} SELECT k, CASE WHEN grp = 'H' THEN 'D01,D02' ELSE districtCode END AS lent, CASE WHEN grp = 'H' THEN 'D01,D02' ELSE '' END AS taken FROM form")
def lent_districts(spark, sf_dir):
    """The list of districts that all groups share, lent to the active group's form and taken back from it."""
    lent = M.lend_districts(forms(spark, sf_dir), F.array(F.lit("D01"), F.lit("D02")), F.lit("H"))
    taken = M.take_districts(lent.withColumn("lent", F.array_join("districtCode", ",")), F.lit("H"))
    return taken.select("k", "lent", F.array_join("shared", ",").alias("taken"))


@query("replaced_group_form", "SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'new' ELSE 'n' END AS n, CASE c_custkey % 3 WHEN 1 THEN 'new' ELSE 'h' END AS h, CASE c_custkey % 3 WHEN 2 THEN 'new' END AS l FROM customer")
def replaced_group_form(spark, sf_dir):
    """One group's form replaced, the others as they were."""
    old = F.create_map(F.lit("N"), F.lit("n"), F.lit("H"), F.lit("h"))
    new = M.with_group_form(old, F.expr("CASE c_custkey % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'H' ELSE 'L' END"), F.lit("new"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), new.alias("m")).select("k", *(F.try_element_at("m", F.lit(g)).alias(g.lower()) for g in "NHL"))


# records ---------------------------------------------------------------------------------------------------------------


@query("shortlist_entries", """SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE 'l-' || p_partkey END AS listingId, 'a b' AS propertyName, CASE WHEN p_partkey % 4 = 0 THEN 'ftp://x' ELSE 'https://x.example/' || p_partkey END AS url, 1 AS photos, CASE WHEN p_partkey % 5 = 0 THEN 'maybe' WHEN p_partkey % 5 = 1 THEN 'ok' ELSE 'unavailable' END AS enrichment,
 concat_ws(',', CASE WHEN p_partkey % 9 = 0 THEN 'listingId is required' END, CASE WHEN p_partkey % 7 = 0 THEN 'propertyId is required' END, CASE WHEN p_partkey % 6 = 0 THEN 'price is negative' END, CASE WHEN p_partkey % 4 = 0 THEN 'url is no web address' END, CASE WHEN p_partkey % 5 = 0 THEN 'enrichment is unknown' END) AS reasons FROM part""")
def shortlist_entries(spark, sf_dir):
    """Shortlisted units rebuilt field by field, with what is wrong with them."""
    k = F.col("p_partkey")
    none, text = F.lit(None).cast("bigint"), F.lit(None).cast("string")
    urls = F.array(F.lit(" "), F.lit("https://p.example/ 1"))
    info = {**dict.fromkeys(C.INFO_TEXTS, text), **dict.fromkeys(C.INFO_NUMBERS, none), "projectUrl": text, "imageUrl": F.lit("http://i.example"), "photos": urls, "enrichment": F.when(k % 5 == 0, "maybe").when(k % 5 == 1, "ok"), "latitude": F.lit(1.3)}
    entry = {
        "listingId": F.when(k % 9 != 0, F.concat(F.lit(" l-"), k.cast("string"))), "propertyId": F.when(k % 7 == 0, F.lit(" ")).otherwise(k.cast("string")), "propertyName": F.lit(" a \n b "), "listedLabel": text, "agentName": text, "agencyName": text,
        **dict.fromkeys(C.ENTRY_NUMBERS, none), "price": F.when(k % 6 == 0, -1).otherwise(5).cast("bigint"), "url": F.when(k % 4 == 0, "ftp://x").otherwise(F.concat(F.lit("https://x.example/"), k.cast("string"), F.lit("\n"))),
        "floorplans": F.lit(None).cast("array<string>"), "photos": urls, "info": F.struct(*(v.alias(n) for n, v in info.items())),
    }
    got = C.shortlist_entries(table(spark, sf_dir, "part").select("p_partkey", *(v.alias(n) for n, v in entry.items())), "p_partkey")
    return got.select("p_partkey", "listingId", "propertyName", "url", F.size("photos").alias("photos"), F.col("info.enrichment").alias("enrichment"), F.array_join("reasons", ",").alias("reasons"))


@query("always_hidden_entries", f"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'property' WHEN 1 THEN 'unit' WHEN 2 THEN 'other' END AS scope, CASE event_id % 5 WHEN 0 THEN '' ELSE 'id ' || event_id END AS id, 200 AS label_length, CASE WHEN event_id % 3 = 0 THEN event_id ELSE {H.EVENTS_NOW} END AS created_at,
 concat_ws(',', CASE WHEN event_id % 4 >= 2 THEN 'scope must be property or unit' END, CASE WHEN event_id % 5 = 0 THEN 'id is required' END) AS reasons FROM events""")
def always_hidden_entries(spark, sf_dir):
    n = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.when(n % 4 == 0, "property").when(n % 4 == 1, "unit").when(n % 4 == 2, "other").alias("scope"), F.when(n % 5 == 0, " ").otherwise(F.concat(F.lit(" id "), n.cast("string"))).alias("id"), F.repeat(F.lit("ab"), 150).alias("label"), F.when(n % 3 == 0, n).alias("createdAt"))
    got = C.always_hidden(rows, H.EVENTS_NOW, "event_id")
    return got.select("event_id", "scope", "id", F.length("label").alias("label_length"), F.col("createdAt").alias("created_at"), F.array_join("reasons", ",").alias("reasons"))


@query("bookmark_entries", """SELECT event_id, 'property#' || event_id AS entity_key, CASE WHEN event_id % 3 = 1 THEN 'bookmarks are properties only' ELSE '' END AS reasons FROM events""")
def bookmark_entries(spark, sf_dir):
    n = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.when(n % 3 == 0, "property").when(n % 3 == 1, "unit").alias("scope"), n.alias("id"), F.lit(None).cast("string").alias("label"))
    return C.bookmarks(rows, "event_id").select("event_id", F.col("entityKey").alias("entity_key"), F.array_join("reasons", ",").alias("reasons"))


@query("list_updates", """WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 2 = 0 THEN 'property' ELSE 'unit' END || '#' || event_id % 5 AS key, event_id % 3 AS created FROM events WHERE event_type = 'click'),
 f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id, key ORDER BY event_id) = 1), n AS (SELECT user_id, count(*) AS n FROM e GROUP BY user_id)
SELECT f.user_id, string_agg(key, ',' ORDER BY created DESC, event_id) AS keys, CASE WHEN any_value(n) > 12 THEN 'items has too many values' ELSE '' END AS reasons FROM f JOIN n ON n.user_id = f.user_id GROUP BY f.user_id""")
def list_updates(spark, sf_dir):
    """Lists of entries as they are stored: each key once, where it came first, newest first; too long ones are refused."""
    e = table(spark, sf_dir, "events").filter("event_type = 'click'")
    item = F.struct("event_id", F.when(F.col("event_id") % 2 == 0, "property").otherwise("unit").alias("scope"), F.concat(F.lit(" "), (F.col("event_id") % 5).cast("string")).alias("id"), F.lit("l").alias("label"), (F.col("event_id") % 3).alias("createdAt"))
    lists = e.groupBy("user_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    got = C.list_updates(lists, "items", 12, "user_id")
    return got.select("user_id", F.array_join(F.transform("items", lambda x: x["entityKey"]), ",").alias("keys"), F.array_join("reasons", ",").alias("reasons"))


@query("action_definitions", """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'do it' END AS name, 'x y' AS p, CASE WHEN c_custkey % 3 = 0 THEN 501 ELSE 3 END AS q_length, concat_ws(',', CASE WHEN c_custkey % 4 = 0 THEN 'name is required' END, CASE WHEN c_custkey % 3 = 0 THEN 'a parameter is too long' END) AS reasons FROM customer""")
def action_definitions(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 4 == 0, " ").otherwise(" do  it").alias("name"), F.lit("d").alias("description"), F.lit(None).cast("string").alias("example"), F.create_map(F.lit("p"), F.lit("x \n y"), F.lit("q"), F.when(k % 3 == 0, F.repeat(F.lit("z"), 501)).otherwise("abc")).alias("parameters"), F.lit("no").alias("callback"))
    got = C.actions(rows, "c_custkey")
    return got.select("c_custkey", "name", F.col("parameters")["p"].alias("p"), F.length(F.col("parameters")["q"]).alias("q_length"), F.array_join("reasons", ",").alias("reasons"))


@query("chat_requests", """SELECT conv_id, turn, length(trim(text, ' ' || chr(10))) AS prompt_length, concat_ws(',', CASE WHEN trim(text, ' ' || chr(10)) = '' THEN 'prompt is required' END, CASE WHEN length(text) > 20000 THEN 'prompt is too long' END, CASE WHEN turn = 1 THEN 'sessionId is required' END, CASE WHEN turn % 4 = 2 THEN 'an action''s name is required' END, CASE WHEN turn % 4 = 3 AND length(role) * 100 > 500 THEN 'an action''s example is too long' END) AS reasons,
 CASE WHEN turn % 3 = 0 THEN '' ELSE CASE WHEN turn % 4 = 2 THEN '' ELSE 'act of ' || role END || '|' || turn || '|second|' END AS actions FROM conversations WHERE text IS NOT NULL""".replace("turn % 4 = 2 THEN 'an", "turn % 3 <> 0 AND turn % 4 = 2 THEN 'an").replace("turn % 4 = 3 AND length", "turn % 3 <> 0 AND turn % 4 = 3 AND length"))
def chat_requests(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").filter("text is not null").select("conv_id", "turn", F.col("text").alias("prompt"), F.when(F.col("turn") != 1, F.col("conv_id").cast("string")).alias("sessionId"), F.lit(None).cast("string").alias("pageContext"), _turn_actions().alias("actions"))
    shown = F.array_join(F.flatten(F.transform("actions", lambda a: F.array(a["name"], F.coalesce(F.try_element_at(a["parameters"], F.lit("p")), F.lit(""))))), "|")
    return C.chat_requests(rows, "conv_id", "turn").select("conv_id", "turn", F.length("prompt").cast("bigint").alias("prompt_length"), F.array_join("reasons", ",").alias("reasons"), shown.alias("actions"))


def _turn_actions():
    """No actions, or two: the first with or without a name and with an example that may be too long."""
    text = lambda c: c.cast("string")
    turn = F.col("turn")
    example = F.when(turn % 4 == 3, F.repeat("role", 100)).otherwise(F.lit(" x "))
    first = F.struct(F.when(turn % 4 == 2, F.lit(" ")).otherwise(F.concat(F.lit(" act  of "), "role")).alias("name"), F.lit("what it does").alias("description"), F.create_map(F.lit("p"), F.concat(F.lit(" "), text(turn))).alias("parameters"), example.alias("example"))
    second = F.struct(F.lit("second").alias("name"), text(F.lit(None)).alias("description"), F.lit(None).cast("map<string,string>").alias("parameters"), text(F.lit(None)).alias("example"))
    return F.when(turn % 3 != 0, F.array(first, second))


@query("saved_search_names", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'my search ' || c_custkey END AS name, CASE WHEN c_custkey % 3 = 0 THEN 'name is required' ELSE '' END AS reasons FROM customer")
def saved_search_names(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 3 == 0, "\t").otherwise(F.concat(F.lit(" my \n search "), k.cast("string"))).alias("name"))
    return C.saved_searches(rows, "c_custkey").select("c_custkey", "name", F.array_join("reasons", ",").alias("reasons"))
