"""Scans of pages. The test tables hold none of the kinds that the library reads, so listings and parts are written as
such pages first; the queries show that reading gives back what was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.requests import search_url
from ..functions.scalars import page_number, path_head, slug, to_integer, to_number
from ..sources import pages as P
from ..sources.captured import captured, keep_pages
from ..sources.sinks import scratch
from ..sources.tables import dealt, table
from . import hosts as H
from .registry import query


def _cards(rows):
    """Listings as cards: some are ads, some have their facts in the second place only."""
    text = lambda c: F.col(c).cast("string")
    second = F.col("listing_id") % 4 == 0
    meta = F.struct(
        text("listing_id").alias("listingId"), text("price").alias("price"), text("floor_area").alias("floorArea"), text("bedrooms").alias("bedroom"), text("bathrooms").alias("bathroom"), F.col("name").alias("listingTitle"),
        "district", F.col("tenure_code").alias("tenure"), F.col("property_id").alias("projectId"), F.col("property_type").alias("propertyType"), F.col("grp").alias("propertyTypeGroup"),
        F.when(F.col("supp_key") % 9 == 0, "promoted").alias("adProduct"), F.struct(F.col("developer").alias("developerName")).alias("property"),
    )
    own = F.struct(
        F.when(~second, text("listing_id")).alias("id"), F.struct(F.when(~second, F.format_number("price", 0)).alias("value")).alias("price"), F.when(~second, text("bedrooms")).alias("bedrooms"),
        F.when(~second, text("floor_area")).alias("floorArea"), F.struct(text("listed_at").alias("unix")).alias("postedOn"), F.struct(F.when(~second, F.col("property_id")).alias("id")).alias("property"),
        F.struct(((F.col("line") == 2) & (F.col("part_key") % 5 == 0)).alias("isPromoted"), (F.col("line") == 3).alias("isPromotedListing")).alias("products"),
    )
    card = F.struct(F.when(F.col("listing_id") % 11 == 0, "k").alias("kevel"), own.alias("listingData"), F.struct(F.struct(F.struct(meta.alias("listingData")).alias("metaData")).alias("parameters")).alias("segment"))
    return rows.withColumn("card", card)


def _page(cards, total):
    """A page with an array of cards in its island."""
    data = F.struct(cards.alias("listingsData"), F.struct(total.cast("string").alias("totalPages")).alias("paginationData"))
    island = F.to_json(F.struct(F.struct(F.struct(F.struct(data.alias("data")).alias("pageData")).alias("pageProps")).alias("props")))
    return F.concat(F.lit('<html><body><script id="__NEXT_DATA__" type="application/json">'), island, F.lit("</script></body></html>"))


def search_pages(spark, sf_dir):
    """A page an order, a card a line."""
    cards = _cards(H.listings(spark, sf_dir)).select(F.floor(F.col("listing_id") / 10).alias("page_id"), "card").groupBy("page_id").agg(F.collect_list("card").alias("cards"))
    return cards.select("page_id", _page(F.col("cards"), F.col("page_id") % 9).alias("html"))


def result_pages(spark, sf_dir):
    """Result pages of three groups: a page an order and group, numbered by the order from the group's first one with a usable listing; orders without a
    listing of the group are pages that never came."""
    rows = H.listings(spark, sf_dir, parts_shuffled=True).withColumn("order_key", F.floor(F.col("listing_id") / 10))
    usable = F.expr(NO_AD) & (F.col("price") != 0)
    bounds = rows.groupBy("grp").agg(F.min(F.when(usable, F.col("order_key"))).alias("first"), F.max("order_key").alias("last")).filter("first is not null")
    cards = _cards(dealt(rows, "grp", "order_key"))  # listings go through the shuffle, as cards say most of them twice
    pages = cards.groupBy("grp", "order_key").agg(F.array_sort(F.collect_list(F.struct(*ON_PAGE, "card"))).alias("cards")).join(F.broadcast(bounds), "grp")  # a row a group: a shuffle by group would put all pages in three tasks
    html = _page(F.transform("cards", lambda c: c["card"]), F.col("last") - F.col("first") + 1)
    return pages.select("grp", (F.col("order_key") - F.col("first") + 1).alias("page"), html.alias("html")).filter("page >= 1")


#: The order of cards on a page.
ON_PAGE = ["listing_id", "part_key", "supp_key", "raw_price", "listed_at", "floor_area", "tenure_code"]
NO_AD = "NOT (listing_id % 11 = 0 OR (line = 2 AND part_key % 5 = 0) OR supp_key % 9 = 0)"


@query("json_island_roundtrip", f"""WITH {H.LISTING} SELECT listing_id // 10 AS page_id, listing_id, property_id, name, price, nullif(bedrooms, 0) AS bedrooms_stated, floor_area, psf, listed_at, coalesce(district, '') AS district, tenure_code, grp, developer
FROM rated WHERE {NO_AD} AND coalesce(price, 0) <> 0""")
def json_island_roundtrip(spark, sf_dir):
    got = P.listings(search_pages(spark, sf_dir))
    return got.select("page_id", "listing_id", "property_id", "name", "price", F.nullif("bedrooms", F.lit(0)).alias("bedrooms_stated"), "floor_area", "psf", "listed_at", "district", "tenure_code", "grp", "developer")


@query("page_totals", "SELECT page_id, page_id % 9 AS total FROM (SELECT DISTINCT l_orderkey + l_linenumber // 10 AS page_id FROM lineitem)")
def page_totals(spark, sf_dir):
    return search_pages(spark, sf_dir).select("page_id", P.total_pages(F.col("html")).alias("total"))


@query("ad_filter_three_markers", f"WITH {H.LISTING} SELECT listing_id, line, part_key FROM rated WHERE {NO_AD}")
def ad_filter_three_markers(spark, sf_dir):
    marker, promoted, product = F.when(F.col("listing_id") % 11 == 0, "k"), (F.col("line") == 2) & (F.col("part_key") % 5 == 0), F.when(F.col("supp_key") % 9 == 0, "promoted")
    return H.listings(spark, sf_dir).filter(~P.is_ad_flags(marker, promoted, product)).select("listing_id", "line", "part_key")


def project_pages(spark, sf_dir):
    row = lambda label, value: F.concat(F.lit(f'<tr class="property-attr x"> <td class="label-block"><h4>{label}</h4></td> <td class="value-block">'), value, F.lit("</td></tr>"))
    key, size = F.col("p_partkey"), F.col("p_size")
    lat, lng = 1.15 + (key % 50) * 0.01, 103.55 + (key % 60) * 0.01
    shown = F.when(key % 4 == 0, F.lit("")).when(key % 4 == 1, F.concat(F.lit('<meta property="place:location:latitude" content="'), lat.cast("string"), F.lit('">'))).otherwise(F.lit(""))
    shown = F.when(key % 4 == 2, F.concat(F.lit('<meta property="place:location:latitude" content="'), lat.cast("string"), F.lit('"><meta property="place:location:longitude" content="'), lng.cast("string"), F.lit('">'))).when(key % 4 == 3, F.concat(F.lit('<div id="map-canvas" data-latitude="'), lat.cast("string"), F.lit('" data-longitude="'), lng.cast("string"), F.lit('"></div>'))).otherwise(shown)
    year = F.when(size % 5 == 0, F.lit("N/A")).otherwise((1960 + size).cast("string"))
    gallery = F.concat(F.lit('<span class="gallery-item image"><img src="/placeholder.png" data-original="/a'), key.cast("string"), F.lit('.jpg"></span><span class="gallery-item image"><img src="/b.jpg"></span><span class="gallery-item image"><img src="/b.jpg"></span><span class="gallery-item image"><img src="/placeholder.png"></span>'))
    html = F.concat(F.lit('<meta property="og:image" content="/o.jpg"><table>'), row("Completion Year", F.lit("1900")), row("Completion Year", year), row("Total Units", F.format_number(key, 0)), row("Developer", F.concat(F.col("p_brand"), F.lit(" &amp; <b>Caf&eacute;</b> &#x27;&euro;&#39;"))), row("Tenure", F.lit("99-year Leasehold")), F.lit("</table>"), shown, gallery)
    part = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand"), "p_partkey")
    return part.select(key.cast("string").alias("property_id"), html.alias("html"))


@query("project_html_roundtrip", """WITH p AS (SELECT *, CAST(1.15 AS DOUBLE) + (p_partkey % 50) * CAST(0.01 AS DOUBLE) AS lat, CAST(103.55 AS DOUBLE) + (p_partkey % 60) * CAST(0.01 AS DOUBLE) AS lng FROM part),
 q AS (SELECT *, p_partkey % 4 >= 2 AND lat BETWEEN 1.15 AND 1.5 AND lng BETWEEN 103.55 AND 104.1 AS inside FROM p)
SELECT CAST(p_partkey AS VARCHAR) AS property_id, CAST(CASE WHEN p_size % 5 <> 0 THEN 1960 + p_size END AS BIGINT) AS top_year, CAST(p_partkey AS BIGINT) AS total_units, p_brand || ' & Café ''€''' AS developer, '99-year Leasehold' AS tenure, '/o.jpg' AS image_url,
 '/a' || p_partkey || '.jpg,/b.jpg' AS photos, CASE WHEN inside THEN round(lat, 4) END AS latitude, CASE WHEN inside THEN round(lng, 4) END AS longitude FROM q""")
def project_html_roundtrip(spark, sf_dir):
    got = P.projects(project_pages(spark, sf_dir))
    return got.select("property_id", "top_year", "total_units", "developer", "tenure", "image_url", F.array_join("photos", ",").alias("photos"), F.round("latitude", 4).alias("latitude"), F.round("longitude", 4).alias("longitude"))


@query("pages_extract", """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS links,
 trim(regexp_replace(lower(regexp_extract(html, '<h1>([^<]*)</h1>', 1)), '[^a-z0-9]+', '-', 'g'), '-') AS slug, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang FROM pages""")
def pages_extract(spark, sf_dir):
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(html, "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all(html, F.lit('<a href="([^"]*)"'), F.lit(1))).cast("bigint").alias("links"), slug(F.regexp_extract(html, "<h1>([^<]*)</h1>", 1)).alias("slug"), F.regexp_extract(html, '<html lang="([a-z]+)"', 1).alias("lang"))


@query("slug_url_shape", """SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug, coalesce(TRY_CAST(nullif(regexp_extract(url, '[?&]page=(\\d+)', 1), '') AS INTEGER), 1) AS page, regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]*)', 1) AS head FROM pages""")
def slug_url_shape(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", slug(url).alias("slug"), page_number(url).alias("page"), path_head(url).alias("head"))


@query("numeric_coercion", """WITH t AS (SELECT doc_id, regexp_extract(text, '-?[0-9][0-9,]*(\\.[0-9]+)?', 0) AS first FROM documents)
SELECT doc_id, TRY_CAST(round_even(TRY_CAST(nullif(replace(first, ',', ''), '') AS DOUBLE), 0) AS BIGINT) AS number FROM t""")
def numeric_coercion(spark, sf_dir):
    """The first number of every text; none, or one beyond 64 bits, is null."""
    return table(spark, sf_dir, "documents").select("doc_id", to_integer(F.col("text")).alias("number"))


@query("envelope_decode", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 200 WHEN event_id % 3 = 1 THEN 403 ELSE 0 END AS status, event_id % 3 = 1 AND event_id % 2 = 0 AS challenge, event_id % 3 = 0 AND event_id % 5 = 0 AS landed FROM events""")
def envelope_decode(spark, sf_dir):
    e = F.col("event_id")
    body = F.when(e % 5 == 0, F.lit("x __NEXT_DATA__ y")).otherwise(F.lit("nothing"))
    good = F.concat(F.lit('{"'), F.when(e % 3 == 0, F.lit('status_code":200')).otherwise(F.lit('status":"403"')), F.lit(',"headers":{"CF-Mitigated":"'), F.when(e % 2 == 0, "challenge").otherwise("no"), F.lit('"},"body":"'), body, F.lit('"}'))
    raw = F.when(e % 3 == 2, F.lit("{not json")).otherwise(good)
    got = table(spark, sf_dir, "events").select("event_id", P.envelope(raw).alias("r"))
    return got.select("event_id", F.col("r.status").alias("status"), P.is_challenge(F.col("r.status"), F.try_element_at("r.headers", F.lit("cf-mitigated"))).alias("challenge"), P.landed(F.col("r.status"), F.col("r.body"), "__NEXT_DATA__").alias("landed"))


@query("number_parse", "SELECT doc_id, TRY_CAST(CASE WHEN doc_id % 4 = 0 THEN ' ' || doc_id || '.5 ' WHEN doc_id % 4 = 1 THEN '1e3' ELSE 'x' || doc_id END AS DOUBLE) AS number FROM documents")
def number_parse(spark, sf_dir):
    d = F.col("doc_id")
    text = F.when(d % 4 == 0, F.concat(F.lit(" "), d.cast("string"), F.lit(".5 "))).when(d % 4 == 1, "1e3").otherwise(F.concat(F.lit("x"), d.cast("string")))
    return table(spark, sf_dir, "documents").select("doc_id", to_number(text).alias("number"))


@query("page_links", """SELECT c_custkey, 'https://x.example' || CASE WHEN c_custkey % 4 = 0 THEN '/property-for-sale' ELSE '/property-for-sale/' || (1 + c_custkey % 4) END || '?' || concat_ws('&', 'propertyTypeGroup=' || CASE c_custkey % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'H' ELSE 'L' END,
 'page=' || (1 + c_custkey % 4), CASE WHEN c_custkey % 2 = 0 THEN 'minPrice=' || c_custkey END, 'minTopYear=1999', 'keyword=a+b', CASE WHEN c_custkey % 3 = 0 THEN 'propertyTypeCode=APT' END, CASE WHEN c_custkey % 3 = 2 THEN 'propertyTypeCode=SEMI' END, CASE WHEN c_custkey % 5 = 0 THEN 'isVerified=true' END,
 'sort=' || CASE WHEN c_custkey % 7 = 0 THEN 'price' ELSE 'date' END, 'order=desc') AS url FROM customer""")
def page_links(spark, sf_dir):
    """Links of result pages: type codes of other groups are left out, the first page has no number in its path."""
    k = F.col("c_custkey")
    group = F.element_at(F.array(F.lit("N"), F.lit("H"), F.lit("L")), (k % 3 + 1).cast("int"))
    fields = {"minPrice": F.when(k % 2 == 0, k), "minTop": F.lit(1999), "keyword": F.lit("a b"), "propertyTypeCode": F.array(F.lit("APT"), F.lit("SEMI")), "isVerified": k % 5 == 0, "sort": F.when(k % 7 == 0, "price")}
    url = search_url("https://x.example", group, 1 + k % 4, F.struct(*(c.alias(n) for n, c in fields.items())), list(fields))
    return table(spark, sf_dir, "customer").select("c_custkey", url.alias("url"))


@query("captured_scan", "SELECT page_id, 's' || page_id % 4 AS site_dir, octet_length(encode(html)) + 1 AS bytes, html, CAST(0 AS BIGINT) AS total FROM pages WHERE length(html) > 0")
def captured_scan(spark, sf_dir):
    """Pages written as files, one a page, and read by the data source of captured pages, whose filters choose files before any is read."""
    path = scratch(spark)
    pages = dealt(table(spark, sf_dir, "pages").select(F.concat(F.lit("s"), F.col("page_id") % 4).alias("site_dir"), F.format_string("page_id=%d.html", "page_id").alias("name"), "html"), "name")
    keep_pages(pages, path)
    got = captured(spark, path, fields="site_dir,name,bytes,html,total").filter("bytes > 1 and site_dir like 's%'")
    return got.select(F.regexp_extract("name", r"page_id=(-?\d+)\.", 1).cast("bigint").alias("page_id"), "site_dir", "bytes", F.rtrim("html", F.lit("\n")).alias("html"), "total")
