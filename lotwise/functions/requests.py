"""Checks and forms of search requests: on the driver for one request, and as columns for many."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dimensions import TYPES
from .request_rules import FLAGS, LISTS, NUMBER, check_filters, check_request, read_field

def whole_number(value) -> int | None:
    """A number by the rules of requests, or an error."""
    number, problem = read_field(NUMBER, value)
    if problem:
        raise ValueError(problem)
    return number


def checked_filters(raw: dict, group: str | None = None) -> dict:
    """The known filters of one group, with the default order; fields that say nothing are left out. The first problem is an error."""
    checked = check_filters(raw, group)
    if checked.problems:
        raise ValueError(checked.problems[0])
    return checked.filters


def checked_searches(body: dict) -> list[dict]:
    """The searches of a request, one a group; the old form without groups is one search of the first group."""
    searches, problems = check_request(body)
    if problems:
        raise ValueError(problems[0])
    return [{"propertyTypeGroup": s["grp"], "maxPages": s["most"], "filters": s["filters"]} for s in searches]


def form_number(text: Column) -> Column:
    """A form's text as a finite number, else null."""
    number = F.nullif(F.trim(text), F.lit("")).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), number)


def number_text(number: Column) -> Column:
    return F.coalesce(number.cast("string"), F.lit(""))


def for_group(group: Column, only: Sequence[str], value: Column) -> Column:
    """A filter where the group has it, else null."""
    return F.when(group.isin(*only), value)


def query_string(scalars: dict[str, Column], lists: dict[str, Column], flags: dict[str, Column]) -> Column:
    """Parameters of a search: scalars that are set, list values one by one, flags only if true."""
    pair = lambda k, v: F.concat(F.lit(f"{k}="), F.replace(F.replace(F.url_encode(v), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A")))
    parts = [F.array(pair(k, v.cast("string"))) for k, v in scalars.items()]
    each = lambda k: lambda x: pair(k, x)
    parts += [F.transform(F.coalesce(v, F.array().cast("array<string>")), each(k)) for k, v in lists.items()]
    parts += [F.array(F.when(v, F.lit(f"{k}=true"))) for k, v in flags.items()]
    return F.array_join(F.array_compact(F.concat(*parts)), "&")


#: Names of filters in links.
SCALAR_NAMES = {
    "minPrice": "minPrice", "maxPrice": "maxPrice", "minSize": "minSize", "maxSize": "maxSize", "minSizeLand": "minSizeLand", "maxSizeLand": "maxSizeLand", "minTop": "minTopYear", "maxTop": "maxTopYear",
    "minPsf": "minPricePerArea", "maxPsf": "maxPricePerArea", "distanceToMrt": "distanceToMRT", "keyword": "keyword", "lastPosted": "lastPosted",
}


def search_url(base: str, group: Column, page: Column, filters: Column, has: Sequence[str]) -> Column:
    """The link of a result page: the first page has no number in its path. ``filters`` is a struct with the fields ``has``;
    type codes of other groups are left out; without an order of its own the newest come first."""
    field = lambda k: filters[k] if k in has else F.lit(None)
    codes = F.create_map(*(x for g, of in TYPES.items() for x in (F.lit(g), F.lit(list(of)))))
    own = lambda k: F.array_intersect(field(k), F.coalesce(F.try_element_at(codes, group), F.array().cast("array<string>"))) if k == "propertyTypeCode" and k in has else field(k).cast("array<string>")
    first = query_string({"propertyTypeGroup": group, "page": page, **{name: F.nullif(field(k).cast("string"), F.lit("")) for k, name in SCALAR_NAMES.items()}}, {k: own(k) for k in LISTS}, {k: field(k).cast("boolean") for k in FLAGS})
    order = query_string({"sort": F.coalesce(field("sort").cast("string"), F.lit("date")), "order": F.coalesce(field("order").cast("string"), F.lit("desc"))}, {}, {})
    path = F.when(page <= 1, F.lit("/property-for-sale")).otherwise(F.concat(F.lit("/property-for-sale/"), page.cast("string")))
    return F.concat(F.lit(base), path, F.lit("?"), first, F.lit("&"), order)


def number_problem(low: Column, high: Column) -> Column:
    """Why two bounds given as texts can't be used: no whole number, negative, or crossed; null where they can."""
    number = lambda c: F.trim(c).try_cast("decimal(38,0)")
    bad = lambda c: (F.coalesce(c, F.lit("")) != "") & ~F.trim(c).rlike("^[+-]?[0-9]+$")
    return F.when(bad(low) | bad(high), "number").when((number(low) < 0) | (number(high) < 0), "negative").when(number(low) > number(high), "range")


def plain_session(text: Column) -> Column:
    return F.substring(F.regexp_replace(text, "[^A-Za-z0-9_-]", ""), 1, 64)


def clean_links(links: Column) -> Column:
    """Links without white space; what doesn't start like a web address goes."""
    return F.filter(F.transform(links, lambda u: F.regexp_replace(u, r"\s", "")), lambda u: u.rlike("^https?://"))


def optional_id(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))
