"""Scans of captured pages: search pages with a JSON island, and project pages with microdata."""

from __future__ import annotations

import html as html_entities
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import first_of, per_area, to_integer, to_number, truthy

#: Where the pages keep their data.
ISLAND_START, ISLAND_END = '<script id="__NEXT_DATA__" type="application/json"', "</script>"
ATTRIBUTE_ROW = r'(?s)<tr class="property-attr[^"]*">\s*<td class="label-block"[^>]*>\s*(?:<h4[^>]*>)?(.*?)(?:</h4>)?\s*</td>\s*<td class="value-block"[^>]*>(.*?)</td>'
COVER = r'<meta property="og:image" content="([^"]+)"'
GALLERY = r'<span class="gallery-item image"[^>]*>\s*<img\b([^>]*)>'
LATITUDE = r'<meta property="place:location:latitude" content="([^"]+)"'
LONGITUDE = r'<meta property="place:location:longitude" content="([^"]+)"'
CANVAS = r'id="map-canvas"[^>]*?\bdata-latitude="([^"]*)"[^>]*?\bdata-longitude="([^"]*)"'
#: The area that coordinates must lie in: latitude, then longitude.
BOX = ((1.15, 1.50), (103.55, 104.10))

_ITEMS = "struct<items: array<struct<caption: string, src: string>>>"
_OWN = (
    "struct<id: string, price: struct<value: string>, bedrooms: string, bathrooms: string, floorArea: string, url: string, fullAddress: string, localizedTitle: string,"
    " postedOn: struct<text: string, unix: string>, agent: struct<name: string>, agency: struct<name: string>, property: struct<id: string>,"
    f" products: struct<isPromoted: boolean, isPromotedListing: boolean>, mediaCarousel: struct<previewMedia: struct<floorPlans: {_ITEMS}, images: {_ITEMS}>>>"
)
_META = (
    "struct<listingId: string, price: string, floorArea: string, bedroom: string, bathroom: string, listingTitle: string, district: string, districtName: string, regionName: string,"
    " tenure: string, projectId: string, propertyType: string, propertyTypeGroup: string, adProduct: string, property: struct<developerName: string>>"
)
CARD = f"struct<kevel: string, listingData: {_OWN}, segment: struct<parameters: struct<metaData: struct<listingData: {_META}>>>>"
_DATA = "props struct<pageProps: struct<pageData: struct<data: struct<{}>>>>"
_TOTAL = "paginationData: struct<totalPages: string>"
PAGE = _DATA.format(f"listingsData: array<{CARD}>, {_TOTAL}")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Captured pages as files, one page a file: ``path`` and ``html``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


#: From the first start to the first end after it, tried at the text's begin only; what was passed is not tried again.
_ISLAND = rf"(?s)\A(?>.*?{re.escape(ISLAND_START)})(?>[^>]*>)(.*?){re.escape(ISLAND_END)}"


def island_text(html: Column) -> Column:
    """The text of the page's data island, empty without one: found by its ends in one pass over the page that never backtracks."""
    return F.coalesce(F.regexp_extract(html, _ISLAND, 1), F.lit(""))


def _with(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` where ``of`` uses the value several times and it is to be computed once: Spark shares no expressions below lambdas and conditions."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _data(text: Column, schema: str) -> Column:
    return F.from_json(text, schema).getField("props").getField("pageProps").getField("pageData").getField("data")


def island(html: Column) -> Column:
    """The page's data; null fields where the island is missing or no JSON. A value of another type than the schema's is null by itself; where that is a whole
    card, which would take the list with it, the cards are read one by one. The island is found once and parsed once, the second time only for such a list."""
    one_by_one = lambda text: F.transform(_data(text, PAGE.replace(CARD, "string")).getField("listingsData"), lambda c: F.from_json(c, CARD))
    read = lambda text, data: F.struct(F.coalesce(data.getField("listingsData"), one_by_one(text)).alias("listingsData"), data.getField("paginationData").alias("paginationData"))
    return _with(island_text(html), lambda text: _with(_data(text, PAGE), lambda data: read(text, data)))


def island_total(data: Column) -> Column:
    return F.coalesce(to_integer(data.getField("paginationData").getField("totalPages")), F.lit(0))


def total_pages(html: Column) -> Column:
    """The number of pages that a page states; its cards are not read for it."""
    return island_total(_data(island_text(html), _DATA.format(_TOTAL)))


def organic_cards(data: Column) -> Column:
    """The cards of a page that are no ads, each with its place on the page."""
    placed = F.transform(F.coalesce(data.getField("listingsData"), F.array()), lambda card, pos: F.struct(pos.alias("pos"), card.alias("card")))
    return F.filter(placed, lambda c: ~is_ad(c["card"]))


def parsed_pages(pages: DataFrame, keep: tuple[str, ...], html_col: str = "html") -> DataFrame:
    """A row a page, without its text: the kept columns, whether there is a text (``found``), the number of pages (``total``) and the
    usable ``cards``, flat. The island is parsed once; what comes after (counts, targets, joins) reads this, so no page's text is in a shuffle."""
    html = F.col(html_col)
    rows = pages.select(*keep, F.coalesce(html != "", F.lit(False)).alias("found"), island(html).alias("data"))
    flat = F.transform(organic_cards(F.col("data")), lambda c: F.struct(c["pos"].alias("pos"), *card_fields(c["card"])))
    usable = F.filter(flat, lambda c: (F.coalesce(c["listing_id"], F.lit(0)) != 0) & (F.coalesce(c["price"], F.lit(0)) != 0))
    return rows.select(*keep, "found", island_total(F.col("data")).cast("bigint").alias("total"), usable.alias("cards"))


def card_rows(parsed: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """One row a card of parsed pages."""
    return parsed.select(*keep, F.inline("cards")).withColumn("psf", per_area(F.col("price"), F.col("floor_area")))


def is_ad(card: Column) -> Column:
    """A promoted card, by any of three markers; ``isPromotedListing`` is none of them."""
    meta = card.getField("segment").getField("parameters").getField("metaData").getField("listingData")
    return is_ad_flags(card.getField("kevel"), card.getField("listingData").getField("products").getField("isPromoted"), meta.getField("adProduct"))


def is_ad_flags(marker: Column, promoted: Column, product: Column) -> Column:
    return marker.isNotNull() | F.coalesce(promoted, F.lit(False)) | F.coalesce(product == "promoted", F.lit(False))


def card_fields(card: Column) -> list[Column]:
    """The flat listing of a card."""
    own, meta = card.getField("listingData"), card.getField("segment").getField("parameters").getField("metaData").getField("listingData")
    number = lambda c: to_integer(c)
    either = lambda a, b: F.coalesce(truthy(number(own[a])), number(meta[b]))
    price = F.coalesce(truthy(number(own["price"]["value"])), number(meta["price"]))
    sources = lambda kind: F.filter(F.transform(F.coalesce(own["mediaCarousel"]["previewMedia"][kind]["items"], F.array()), lambda x: x["src"]), lambda s: F.coalesce(s != "", F.lit(False)))
    return [
        F.coalesce(truthy(number(own["id"])), number(meta["listingId"])).alias("listing_id"),
        first_of(F.nullif(own["property"]["id"], F.lit("0")), F.nullif(meta["projectId"], F.lit("0"))).alias("property_id"),
        first_of(own["localizedTitle"], meta["listingTitle"]).alias("name"),
        price.alias("price"),
        either("bedrooms", "bedroom").alias("bedrooms"),
        either("bathrooms", "bathroom").alias("bathrooms"),
        either("floorArea", "floorArea").alias("floor_area"),
        first_of(own["url"]).alias("url"),
        first_of(own["fullAddress"]).alias("address"),
        number(own["postedOn"]["unix"]).alias("listed_at"),
        first_of(own["postedOn"]["text"]).alias("listed_label"),
        first_of(own["agent"]["name"]).alias("agent_name"),
        first_of(own["agency"]["name"]).alias("agency_name"),
        sources("floorPlans").alias("floorplans"),
        sources("images").alias("photos"),
        *(first_of(meta[a]).alias(b) for a, b in (("district", "district"), ("districtName", "district_name"), ("regionName", "region_name"), ("tenure", "tenure_code"), ("propertyType", "property_type"), ("propertyTypeGroup", "grp"))),
        first_of(meta["property"]["developerName"]).alias("developer"),
    ]


def listings(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One row a usable organic card: the kept page columns, its place ``pos`` on the page, and the flat listing."""
    cards = pages.select(*keep, F.inline(organic_cards(island(F.col(html_col))))).select(*keep, "pos", *card_fields(F.col("card")))
    return cards.filter("coalesce(listing_id, 0) <> 0 and coalesce(price, 0) <> 0").withColumn("psf", per_area(F.col("price"), F.col("floor_area")))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _decoded(cells: pd.Series) -> pd.Series:
    return cells.map(lambda xs: None if xs is None else [x if x is None or "&" not in x else html_entities.unescape(x) for x in xs])


def plain_texts(cells: Column) -> Column:
    """Table cells without tags, with character references decoded, trimmed. Spark has no function that decodes all of them,
    so these few short cells of a page go through an Arrow batch."""
    bare = F.transform(cells, lambda c: F.regexp_replace(c, "<[^>]*>", ""))
    return F.transform(_decoded(bare), lambda c: F.regexp_replace(c, r"^[\s\u00a0]+|[\s\u00a0]+$", ""))


def plain_text(cell: Column) -> Column:
    return F.element_at(plain_texts(F.array(cell)), 1)


def project_pairs(html: Column) -> Column:
    """The rows of a project page's table with a label and a value: labels in lower case, both as plain text."""
    labels, values = F.regexp_extract_all(html, F.lit(ATTRIBUTE_ROW), F.lit(1)), F.regexp_extract_all(html, F.lit(ATTRIBUTE_ROW), F.lit(2))
    pairs = F.zip_with(plain_texts(labels), plain_texts(values), lambda a, b: F.struct(F.lower(a).alias("label"), b.alias("value")))
    return F.filter(pairs, lambda p: (p["label"] != "") & (p["value"] != ""))


def project_record(html: Column, pairs: Column) -> list[Column]:
    """The eleven facts of a project page, of its text and the pairs of its table."""
    fact = lambda label: F.try_element_at(F.filter(pairs, lambda p: p["label"] == label), F.lit(-1))["value"]  # noqa: E731  the last one counts
    source = lambda a: F.when(F.regexp_extract(a, r'\bdata-original="([^"]*)"', 1) != "", F.regexp_extract(a, r'\bdata-original="([^"]*)"', 1)).otherwise(F.regexp_extract(a, r'(?<![\w-])src="([^"]*)"', 1))
    gallery = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(html, F.lit(GALLERY), F.lit(1)), source), lambda u: (u != "") & ~u.contains("placeholder")))
    lat, lng = to_number(F.regexp_extract(html, LATITUDE, 1)), to_number(F.regexp_extract(html, LONGITUDE, 1))
    both = lat.isNotNull() & lng.isNotNull()
    lat = F.when(both, lat).otherwise(to_number(F.regexp_extract(html, CANVAS, 1)))
    lng = F.when(both, lng).otherwise(to_number(F.regexp_extract(html, CANVAS, 2)))
    inside = lat.between(*BOX[0]) & lng.between(*BOX[1])
    return [
        to_integer(fact("completion year")).alias("top_year"),
        to_integer(fact("total units")).alias("total_units"),
        to_integer(fact("# of floors")).alias("floors"),
        *(F.coalesce(fact(label), F.lit("")).alias(name) for label, name in (("tenure", "tenure"), ("developer", "developer"), ("project type", "property_type"), ("psf", "psf_range"))),
        F.regexp_extract(html, COVER, 1).alias("image_url"),
        gallery.alias("photos"),
        F.when(inside, lat).alias("latitude"),
        F.when(inside, lng).alias("longitude"),
    ]


def projects(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("property_id",)) -> DataFrame:
    """One row a page: the kept columns and its facts. The table is read once, then looked up for each fact."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    read = pages.select(*keep, html.alias("__html"), project_pairs(html).alias("__pairs"))
    return read.select(*keep, *project_record(F.col("__html"), F.col("__pairs")))


def landed(status: Column, html: Column, marker: str) -> Column:
    """A fetched page that has what its reader looks for."""
    return F.coalesce((status == 200) & html.contains(marker), F.lit(False))


def envelope(raw: Column) -> Column:
    """A response envelope: status (``status_code`` or else ``status``, else 0), headers with lower-case names, body."""
    got = F.from_json(raw, "status_code string, status string, headers map<string,string>, body string")
    status = F.coalesce(truthy(got["status_code"].try_cast("int")), truthy(got["status"].try_cast("int")), F.lit(0))
    headers = F.map_from_entries(F.transform(F.map_entries(F.coalesce(got["headers"], F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]), e["value"])))
    return F.struct(status.alias("status"), headers.alias("headers"), got["body"].alias("body"))


def is_challenge(status: Column, mitigated: Column) -> Column:
    return (status == 403) & mitigated.eqNullSafe(F.lit("challenge"))


