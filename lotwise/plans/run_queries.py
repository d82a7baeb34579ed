"""A whole search over the test tables, and all requests of all customers against the rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import request_rules as R
from ..runs import RECORD, RECORD_VERSION, Run, Stores
from ..sources.sinks import scratch
from ..sources.tables import dealt, table
from . import hosts as H
from .page_queries import NO_AD, ON_PAGE, project_pages, result_pages
from .registry import query

REQUEST = {
    "searches": [
        {"propertyTypeGroup": "H", "maxPages": 0, "filters": {"minSize": 400, "maxSize": "1800", "minTop": 1965, "maxTop": 2004, "districtCode": ["D01", "D02", "D03", "D05", "D09", "D13", "D17", "D21"]}},
        {"propertyTypeGroup": "N", "maxPages": 0, "filters": {"minPrice": 5000, "maxPrice": 60000, "minPsf": 10, "sort": "price"}},
        {"propertyTypeGroup": "L", "maxPages": 10, "filters": {}},
    ]
}
JOB, SAVED_SEARCH = "job-1", "saved-1"
#: What a row of the result says; a property has the first part, the job the second.
OF_PROPERTY = ["name", "grp", "price_min", "unit_count", "unit_types", "dearest_unit", "top_year", "tenure", "enrichment"]
OF_JOB = ["status", "pages_total", "pages_scanned", "total_pages", "truncated", "listing_count", "details_total", "details_fetched", "property_count", "units", "good_records", "failed_records", "saved_at"]


def _records(spark, sf_dir):
    """The cache before the run: entries of the host cache, with facts where they aren't failures."""
    k = F.col("property_id").cast("bigint")
    good = F.col("failed_at").isNull()
    return H.cache(spark, sf_dir).select("property_id", "schema_version", F.when(good, 1950 + k % 70).alias("top_year"), F.when(good, "cached").alias("tenure"), F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"), "updated_at", "failed_at")


@query("search_end_to_end", f"""WITH {H.LISTING}, {H.CACHE},
 wanted(grp, place, most) AS (VALUES ('H', 0, 0), ('N', 1, 0), ('L', 2, 10)),
 organic AS (SELECT * FROM rated WHERE {NO_AD} AND coalesce(price, 0) <> 0),
 bounds AS (SELECT grp, min(listing_id // 10) AS first FROM organic GROUP BY grp),
 totals AS (SELECT grp, max(listing_id // 10) - min(first) + 1 AS total FROM rated JOIN bounds USING (grp) GROUP BY grp),
 plan AS (SELECT *, CASE WHEN most = 0 THEN total ELSE least(most, total) END AS last FROM wanted JOIN totals USING (grp) JOIN bounds USING (grp)),
 scanned AS (SELECT DISTINCT grp, listing_id // 10 - first + 1 AS page FROM rated JOIN plan USING (grp) WHERE listing_id // 10 - first + 1 BETWEEN 1 AND last),
 seen AS (SELECT o.*, place, listing_id // 10 - first + 1 AS at_page FROM organic o JOIN plan USING (grp) WHERE listing_id // 10 - first + 1 BETWEEN 1 AND last),
 once AS (SELECT * FROM seen QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY place, at_page, {", ".join(ON_PAGE)}) = 1),
 unit AS (SELECT *, CASE WHEN property_id = '' THEN 'listing:' || listing_id ELSE property_id END AS property_key FROM once WHERE CASE grp
   WHEN 'H' THEN coalesce(floor_area BETWEEN 400 AND 1800, true) AND coalesce(district IN ('D01', 'D02', 'D03', 'D05', 'D09', 'D13', 'D17', 'D21'), true)
   WHEN 'N' THEN price BETWEEN 5000 AND 60000 AND coalesce(psf >= 10, true) ELSE true END),
 asked AS (SELECT DISTINCT property_id FROM unit WHERE property_id <> ''),
 current AS (SELECT property_id, 1950 + CAST(property_id AS BIGINT) % 70 AS top_year FROM cache WHERE updated_at IS NOT NULL AND {H.CACHE_NOW} - updated_at < {H.CACHE_TTL} AND schema_version >= {RECORD_VERSION}),
 lately AS (SELECT property_id FROM cache WHERE failed_at IS NOT NULL AND {H.CACHE_NOW} - failed_at < {H.FAILURE_TTL}),
 missing AS (SELECT property_id FROM asked ANTI JOIN current USING (property_id) ANTI JOIN lately USING (property_id)),
 got AS (SELECT property_id, CAST(CASE WHEN p_size % 5 <> 0 THEN 1960 + p_size END AS BIGINT) AS top_year FROM missing JOIN part ON CAST(p_partkey AS VARCHAR) = property_id WHERE p_partkey % 13 <> 0),
 known AS (SELECT property_id AS property_key, top_year, 'cached' AS tenure FROM current UNION ALL SELECT property_id, top_year, '99-year Leasehold' FROM got),
 property AS (SELECT property_key, first(name ORDER BY place, at_page, {", ".join(ON_PAGE)}) AS name, first(grp ORDER BY place, at_page, {", ".join(ON_PAGE)}) AS grp, min(price) AS price_min, count(*) AS unit_count, count(DISTINCT coalesce(bedrooms, 0)) AS unit_types, max(price) AS dearest_unit FROM unit GROUP BY property_key),
 result AS (SELECT p.*, k.top_year, k.tenure, CASE WHEN k.property_key IS NULL THEN 'unavailable' ELSE 'ok' END AS enrichment FROM property p LEFT JOIN known k USING (property_key) WHERE grp <> 'H' OR coalesce(k.top_year BETWEEN 1965 AND 2004, true)),
 store AS (SELECT property_id, updated_at IS NOT NULL AS good FROM cache ANTI JOIN missing USING (property_id) UNION ALL SELECT property_id, property_id IN (SELECT property_id FROM got) FROM missing)
SELECT 'property' AS kind, property_key AS key, name, grp, price_min, unit_count, unit_types, dearest_unit, top_year, tenure, enrichment, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS BIGINT) AS pages_total, CAST(NULL AS BIGINT) AS pages_scanned, CAST(NULL AS BIGINT) AS total_pages, CAST(NULL AS BOOLEAN) AS truncated, CAST(NULL AS BIGINT) AS listing_count,
  CAST(NULL AS BIGINT) AS details_total, CAST(NULL AS BIGINT) AS details_fetched, CAST(NULL AS BIGINT) AS property_count, CAST(NULL AS BIGINT) AS units, CAST(NULL AS BIGINT) AS good_records, CAST(NULL AS BIGINT) AS failed_records, CAST(NULL AS BIGINT) AS saved_at FROM result
UNION ALL SELECT 'job', '{JOB}', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'succeeded', (SELECT CAST(sum(last) AS BIGINT) FROM plan), (SELECT count(*) FROM scanned), (SELECT CAST(sum(total) AS BIGINT) FROM plan), (SELECT bool_or(total > last) FROM plan), (SELECT count(*) FROM unit), (SELECT count(*) FROM missing), (SELECT count(*) FROM got),
  (SELECT count(*) FROM result), (SELECT CAST(sum(unit_count) AS BIGINT) FROM result), (SELECT count(*) FROM store WHERE good), (SELECT count(*) FROM store WHERE NOT good), {H.CACHE_NOW}""")
def search_end_to_end(spark, sf_dir):
    """A request over three groups to its published tree and its job row: the rows of the result, opened, and one row of the job with what its stores
    hold afterwards."""
    stores = Stores(spark, scratch(spark))
    stores.put("records", _records(spark, sf_dir))
    stores.put("saved", spark.createDataFrame([(SAVED_SEARCH, 1), ("another", 2)], "saved_search_id string, last_run_at bigint"))
    projects = project_pages(spark, sf_dir).filter("property_id % 13 <> 0")
    Run(stores, JOB, REQUEST, result_pages(spark, sf_dir), projects, H.CACHE_NOW, SAVED_SEARCH, record_ttl=H.CACHE_TTL, failure_ttl=H.FAILURE_TTL).run()
    result = stores.result(JOB)
    dearest = F.array_max(F.flatten(F.transform("unit_types", lambda t: F.transform(t["units"], lambda u: u["price"]))))
    properties = result.select(F.lit("property").alias("kind"), F.col("property_key").alias("key"), "name", "grp", "price_min", "unit_count", F.size("unit_types").cast("bigint").alias("unit_types"), dearest.alias("dearest_unit"), "top_year", "tenure", "enrichment")
    records = stores.table("records", RECORD).agg(F.count("updated_at").alias("good_records"), F.count("failed_at").alias("failed_records"))
    saved = stores.table("saved", "saved_search_id string, last_run_at bigint").filter(F.col("saved_search_id") == SAVED_SEARCH).select(F.col("last_run_at").alias("saved_at"))
    job = stores.jobs().withColumn("kind", F.lit("job")).withColumnRenamed("job_id", "key").withColumnRenamed("unit_count", "units")
    job = job.join(records, how="full").join(saved, how="full")  # three tables of one row each
    return properties.unionByName(job.select("kind", "key", *OF_JOB), allowMissingColumns=True)


#: Parts of requests: every customer whose key leaves the remainder has the part. Some are sound, most break a rule.
_OWN = [
    (2, 0, '"minPrice": 500'), (6, 1, '"minPrice": -5'), (12, 9, '"minPrice": "1_0x"'), (3, 0, '"maxPrice": "400"'), (7, 2, '"minTop": 1999.5'), (7, 3, '"minTop": true'), (5, 0, '"maxTop": 1990'), (11, 4, '"lastPosted": [7]'),
    (4, 0, '"bedrooms": [1, "2"]'), (4, 1, '"bedrooms": "3"'), (8, 2, '"bedrooms": ["a-b"]'), (9, 5, '"districtCode": ["D01", 1.5]'), (13, 0, '"tenureCode": ["F", "__"]'), (3, 1, '"propertyTypeCode": ["APT"]'), (5, 3, '"isVerified": 1'), (5, 4, '"withStream": false'),
    (6, 0, '"keyword": "  by the   park "'), (6, 1, '"keyword": 3'), (9, 1, '"distanceToMrt": "2"'), (9, 2, '"distanceToMrt": " 0.5 "'), (8, 0, '"sort": "worst"'), (8, 1, '"sort": "price"'), (12, 5, '"order": ""'), (12, 7, '"order": {}'),
]
_LONG = (17, 3, '"unitFeatures": [', '"x_1"', 31)  # a list of too many entries
_WHOLE = [(19, 4, '{"searches": []}'), (23, 5, '{"searches": "N"}'), (29, 6, '[1, 2]'), (31, 7, '{"searches": [{"propertyTypeGroup": "N"'), (37, 8, '{"searches": [3]}'), (41, 9, '{"filters": {"minPsf": 9, "maxPsf": 8}}')]


def request_bodies(spark, sf_dir):
    """A request a customer: searches of one or two groups, the second of which may be the first again, with parts by the key."""
    k = F.col("c_custkey")
    m, r, head, entry, n = _LONG
    parts = F.concat_ws(", ", *(F.when(k % mod == rest, F.lit(part)) for mod, rest, part in _OWN), F.when(k % m == r, F.lit(f"{head}{', '.join([entry] * n)}]")))
    group = F.element_at(F.array(*map(F.lit, ("N", "H", "L", "X"))), (k % 4 + 1).cast("int"))
    pages = F.when(k % 5 == 1, F.lit('"maxPages": -1, ')).when(k % 5 == 2, F.lit('"maxPages": 25, ')).otherwise(F.lit(""))
    second = F.when(k % 3 == 2, F.concat(F.lit(', {"propertyTypeGroup": "'), F.when(k % 2 == 0, F.lit("N")).otherwise(group), F.lit('"}'))).otherwise(F.lit(""))
    body = F.concat(F.lit('{"searches": [{"propertyTypeGroup": "'), group, F.lit('", '), pages, F.lit('"filters": {'), parts, F.lit("}}"), second, F.lit("]}"))
    for mod, rest, whole in _WHOLE:
        body = F.when(k % mod == rest, F.lit(whole)).otherwise(body)
    return table(spark, sf_dir, "customer").select("c_custkey", body.alias("body"))


def _body_sql():
    m, r, head, entry, n = _LONG
    parts = ", ".join([f"CASE WHEN c_custkey % {mod} = {rest} THEN '{part}' END" for mod, rest, part in _OWN] + [f"CASE WHEN c_custkey % {m} = {r} THEN '{head}{', '.join([entry] * n)}]' END"])
    group = "CASE c_custkey % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'H' WHEN 2 THEN 'L' ELSE 'X' END"
    pages = "CASE c_custkey % 5 WHEN 1 THEN '\"maxPages\": -1, ' WHEN 2 THEN '\"maxPages\": 25, ' ELSE '' END"
    second = f"CASE WHEN c_custkey % 3 = 2 THEN ', {{\"propertyTypeGroup\": \"' || CASE WHEN c_custkey % 2 = 0 THEN 'N' ELSE {group} END || '\"}}' ELSE '' END"
    own = f"'{{\"searches\": [{{\"propertyTypeGroup\": \"' || {group} || '\", ' || {pages} || '\"filters\": {{' || concat_ws(', ', {parts}) || '}}}}' || {second} || ']}}'"
    whole = " ".join(f"WHEN c_custkey % {mod} = {rest} THEN '{text}'" for mod, rest, text in reversed(_WHOLE))
    return f"SELECT c_custkey, CASE {whole} ELSE {own} END AS body FROM customer"


_KINDS = ", ".join(f"('{name}', '{shape.kind}')" for name, shape in R.FILTERS.items())
_CHOICES = " ".join(f"WHEN '{name}' THEN trim(t) IN ({', '.join(repr(x) for x in shape.of)}) OR {shape.blank} AND trim(t) = ''" for name, shape in R.FILTERS.items() if shape.kind == "choice")
_CODES = ", ".join(f"('{g}', '{c}')" for g, of in R.BY_GROUP["propertyTypeCode"].items() for c in of)
_PAIRS = ", ".join(f"('{low}', '{high}')" for low, high in R.RANGES)
#: Why a number can't be used: of a JSON value ``v``, its type ``ty`` and its text ``t``.
_NUMBER = """CASE WHEN ty IN ('UBIGINT', 'BIGINT', 'HUGEINT') THEN CASE WHEN t LIKE '-%' THEN 'negative' END WHEN ty = 'DOUBLE' THEN CASE WHEN CAST(t AS DOUBLE) <= -1 THEN 'negative' END
   WHEN ty = 'VARCHAR' AND regexp_full_match(trim(t), '[+-]?[0-9]+(_[0-9]+)*') THEN CASE WHEN trim(t) LIKE '-%' THEN 'negative' END ELSE 'number' END"""
_VALUE = "TRY_CAST(trunc(TRY_CAST(replace(json_extract_string(s, '$.filters.' || {}), '_', '') AS DOUBLE)) AS HUGEINT)"


@query("request_rejects", f"""WITH request AS ({_body_sql()}),
 typed AS (SELECT c_custkey, body, json_valid(body) AS ok, CASE WHEN json_valid(body) THEN json_type(body) END AS ty, CASE WHEN json_valid(body) THEN json_type(body, '$.searches') END AS st FROM request),
 whole AS (SELECT c_custkey, 0 AS place, CASE WHEN ty IS NULL OR ty <> 'OBJECT' THEN 'request' ELSE 'searches' END AS field, CASE WHEN ty IS NULL OR ty <> 'OBJECT' THEN 'object' WHEN st = 'ARRAY' THEN 'empty' ELSE 'type' END AS reason
   FROM typed WHERE ty IS NULL OR ty <> 'OBJECT' OR (st IS NOT NULL AND st NOT IN ('ARRAY', 'NULL')) OR (st = 'ARRAY' AND json_array_length(body, '$.searches') = 0)),
 search AS (SELECT c_custkey, CAST(place AS INTEGER) AS place, json_extract(body, '$.searches[' || place || ']') AS s FROM (SELECT c_custkey, body, unnest(range(CAST(json_array_length(body, '$.searches') AS BIGINT))) AS place FROM typed WHERE ok AND ty = 'OBJECT' AND st = 'ARRAY')
   UNION ALL SELECT c_custkey, 0, json_merge_patch(body, '{{"propertyTypeGroup": "N"}}') FROM typed WHERE ok AND ty = 'OBJECT' AND (st IS NULL OR st = 'NULL')),
 good AS (SELECT *, trim(json_extract_string(s, '$.propertyTypeGroup')) AS grp FROM search WHERE json_type(s) = 'OBJECT'),
 value AS (SELECT c_custkey, place, grp, name, kind, json_extract(s, '$.filters.' || name) AS v, json_type(s, '$.filters.' || name) AS ty, json_extract_string(s, '$.filters.' || name) AS t FROM good, (VALUES {_KINDS}) AS f(name, kind)
   WHERE json_type(s, '$.filters.' || name) NOT IN ('NULL') AND NOT (json_type(s, '$.filters.' || name) = 'VARCHAR' AND json_extract_string(s, '$.filters.' || name) = '')),
 entry AS (SELECT c_custkey, place, grp, name, unnest(json_extract(v, '$[*]')) AS e FROM value WHERE kind = 'list' AND ty = 'ARRAY'),
 bad_list AS (SELECT c_custkey, place, name FROM entry GROUP BY ALL HAVING count(*) > 30 OR bool_or(NOT (json_type(e) IN ('VARCHAR', 'UBIGINT', 'BIGINT') AND regexp_full_match(trim(json_extract_string(e, '$')), '_*[A-Za-z0-9][A-Za-z0-9_]*')))),
 own AS (SELECT c_custkey, place, name AS field, CASE kind WHEN 'number' THEN {_NUMBER}
   WHEN 'list' THEN CASE WHEN ty <> 'ARRAY' THEN 'type' WHEN json_array_length(v) > 30 THEN 'many' WHEN (c_custkey, place, name) IN (SELECT (c_custkey, place, name) FROM bad_list) THEN 'entry' END
   WHEN 'flag' THEN CASE WHEN ty <> 'BOOLEAN' THEN 'type' END WHEN 'line' THEN CASE WHEN ty <> 'VARCHAR' THEN 'type' WHEN length(regexp_replace(trim(t), '\\s+', ' ', 'g')) > 100 THEN 'long' END
   ELSE CASE WHEN ty <> 'VARCHAR' THEN 'type' WHEN NOT (CASE name {_CHOICES} END) THEN 'choice' END END AS reason FROM value),
 strange AS (SELECT DISTINCT c_custkey, place, 'propertyTypeCode' AS field, 'group' AS reason FROM entry e WHERE name = 'propertyTypeCode' AND grp IN ('N', 'H', 'L') AND (c_custkey, place, name) NOT IN (SELECT (c_custkey, place, name) FROM bad_list) AND (grp, trim(json_extract_string(e.e, '$'))) NOT IN (VALUES {_CODES})),
 crossed AS (SELECT c_custkey, place, low AS field, 'range' AS reason FROM good g, (VALUES {_PAIRS}) AS p(low, high) WHERE {_VALUE.format('low')} > {_VALUE.format('high')}
   AND NOT EXISTS (SELECT 1 FROM own o WHERE o.c_custkey = g.c_custkey AND o.place = g.place AND o.field IN (p.low, p.high) AND o.reason IS NOT NULL)),
 grouped AS (SELECT c_custkey, place, 'propertyTypeGroup' AS field, CASE WHEN grp IS NULL OR grp NOT IN ('N', 'H', 'L') THEN 'choice' WHEN row_number() OVER (PARTITION BY c_custkey, grp ORDER BY place) > 1 THEN 'repeated' END AS reason FROM good),
 paged AS (SELECT c_custkey, place, 'maxPages' AS field, {_NUMBER} AS reason FROM (SELECT c_custkey, place, json_type(s, '$.maxPages') AS ty, json_extract_string(s, '$.maxPages') AS t FROM good) WHERE ty NOT IN ('NULL') AND NOT (ty = 'VARCHAR' AND t = ''))
SELECT * FROM (SELECT * FROM whole UNION ALL SELECT c_custkey, place, 'search', 'object' FROM search WHERE json_type(s) <> 'OBJECT' UNION ALL SELECT * FROM own UNION ALL SELECT * FROM strange UNION ALL SELECT * FROM crossed UNION ALL SELECT * FROM grouped UNION ALL SELECT * FROM paged) WHERE reason IS NOT NULL""")
def request_rejects(spark, sf_dir):
    """The requests of all customers against the table of rules: every reason why one is rejected."""
    return R.split_requests(R.searches_of(dealt(request_bodies(spark, sf_dir), "c_custkey"), "c_custkey"), "c_custkey")[1]
