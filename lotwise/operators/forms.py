"""Filter forms of a search: texts and lists of choices, as columns. A form's row has a column for each field, an empty text
or list where nothing is set, and ``grp``, the property type group that it is for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dimensions as D
from ..functions.requests import FLAGS, form_number
from .text import clauses

NUMBERS = ("minPrice", "maxPrice", "minSize", "maxSize", "minSizeLand", "maxSizeLand", "minPsf", "maxPsf", "minTop", "maxTop", "lastPosted")
LISTS = ("bedrooms", "bathrooms", "propertyTypeCode", "districtCode", "tenureCode", "floorLevel", "furnishing", "unitFeatures", "projectFeatures")
TEXTS = ("distanceToMrt", "keyword")
FIELDS = (*NUMBERS, *LISTS, *TEXTS, "listingFeatures")
#: What a plot of land has none of.
NOT_OF_LAND = ("bedrooms", "bathrooms", "minSize", "maxSize", "furnishing", "unitFeatures", "projectFeatures", "minTop", "maxTop")
#: Fields behind "more filters", and those of them that a search for land doesn't show.
MORE = ("minPsf", "maxPsf", "bedrooms", "bathrooms", "districtCode", "floorLevel", "furnishing", "unitFeatures", "projectFeatures", "listingFeatures", "lastPosted", "distanceToMrt", "keyword")
MORE_NOT_OF_LAND = ("bedrooms", "bathrooms", "furnishing", "unitFeatures", "projectFeatures")
#: The page budget that means all pages.
ALL_PAGES = "0"


def is_land_only(group: Column, types: Column) -> Column:
    """A search for plots of land alone: of the landed group, with types, all of them land."""
    return (group == "L") & (F.coalesce(F.size(types), F.lit(0)) > 0) & F.coalesce(F.forall(types, lambda c: c == D.LAND_ONLY), F.lit(False))


def request_filters(group: Column, field=F.col) -> Column:
    """A form's filters as a request has them, null where nothing is set or where the group has no such filter."""
    land = is_land_only(group, field("propertyTypeCode"))
    found = {n: form_number(field(n)) for n in NUMBERS} | {n: F.when(F.size(field(n)) > 0, field(n)) for n in LISTS}
    found |= {n: F.nullif(F.trim(field(n)), F.lit("")) for n in TEXTS} | {n: F.when(F.array_contains(field("listingFeatures"), n), F.lit(True)) for n in FLAGS}
    for n in NOT_OF_LAND:
        found[n] = F.when(~land, found[n])
    for n in ("minSizeLand", "maxSizeLand"):
        found[n] = F.when(group == "L", found[n])
    found["floorLevel"] = F.when(group != "L", found["floorLevel"])
    return F.struct(*(c.alias(n) for n, c in found.items()))


def form_fields(filters: Column) -> list[Column]:
    """The form that a request's filters fill in: every field is written, the empty text or list where there is none."""
    number = lambda n: F.coalesce(F.regexp_replace(filters[n].cast("string"), r"\.0$", ""), F.lit(""))
    empty = F.array().cast("array<string>")
    features = F.array_compact(F.array(*(F.when(filters[n], F.lit(n)) for n in FLAGS)))
    return [*(number(n).alias(n) for n in NUMBERS), *(F.coalesce(filters[n], empty).alias(n) for n in LISTS), *(F.coalesce(filters[n], F.lit("")).alias(n) for n in TEXTS), features.alias("listingFeatures")]


def searches_of(searches: Column, max_pages: Column, filters: Column) -> Column:
    """A request's searches; one without any is the old form, one search of the first group."""
    old = F.array(F.struct(F.lit("N").alias("propertyTypeGroup"), F.coalesce(max_pages, F.lit(1)).alias("maxPages"), filters.alias("filters")))
    return F.when(F.coalesce(F.size(searches), F.lit(0)) > 0, searches).otherwise(old)


def with_group_form(forms: Column, group: Column, form: Column) -> Column:
    """A map of forms by group with one of them replaced."""
    return F.map_concat(F.map_filter(forms, lambda k, v: k != group), F.map_from_arrays(F.array(group), F.array(form)))


def lend_districts(form: DataFrame, shared: Column, active: Column) -> DataFrame:
    """Rows of forms by group, where the active group's form shows the list of districts that all share."""
    return form.withColumn("districtCode", F.when(F.col("grp") == active, shared).otherwise(F.col("districtCode")))


def take_districts(form: DataFrame, active: Column) -> DataFrame:
    """The reverse: the shared list, as ``shared``, from the active group's form, and no list left in any form."""
    empty = F.array().cast("array<string>")
    out = form.withColumn("shared", F.when(F.col("grp") == active, F.col("districtCode")).otherwise(empty))
    return out.withColumn("districtCode", empty)


def is_set(field: str, lists: Sequence[str] = (*LISTS, "listingFeatures")) -> Column:
    """Whether a form's field says anything."""
    return F.coalesce(F.size(field) > 0, F.lit(False)) if field in lists else F.coalesce(F.trim(F.col(field)) != "", F.lit(False))


def count_set(fields: Sequence[str] = FIELDS) -> Column:
    """How many of a form's fields are set; the page budget is none of them."""
    return sum((is_set(f).cast("bigint") for f in fields), F.lit(0).cast("bigint"))


def count_more(group: Column) -> Column:
    """How many of the fields behind "more filters" are set, of those that the group shows."""
    land, total = is_land_only(group, F.col("propertyTypeCode")), F.lit(0).cast("bigint")
    for f in MORE:
        shown = ~land if f in MORE_NOT_OF_LAND else group != "L" if f == "floorLevel" else F.lit(True)
        total = total + (is_set(f) & shown).cast("bigint")
    return total


def _range(what: str, low: str, high: str, unit: str = "") -> Column:
    one = lambda f: F.coalesce(F.nullif(F.col(f), F.lit("")), F.lit("any"))
    set_ = (F.coalesce(F.col(low), F.lit("")) != "") | (F.coalesce(F.col(high), F.lit("")) != "")
    return F.when(set_, F.concat(F.lit(f"{what} "), one(low), F.lit(" to "), one(high), F.lit(unit)))


def _choices(what: str, field: str, options: dict[str, str]) -> Column:
    return F.when(is_set(field), F.concat(F.lit(f"{what} "), D.labels_of(options, F.col(field))))


def description(pages: str | None = "maxPages") -> Column:
    """A form's filters as one sentence of up to nineteen clauses."""
    parts = [
        _range("price", "minPrice", "maxPrice"), _range("floor area", "minSize", "maxSize", " sqft"), _range("land size", "minSizeLand", "maxSizeLand", " sqft"), _range("psf", "minPsf", "maxPsf"), _range("TOP year", "minTop", "maxTop"),
        _choices("bedrooms", "bedrooms", D.BEDROOMS), _choices("bathrooms", "bathrooms", D.BATHROOMS), _choices("property types", "propertyTypeCode", D.ALL_TYPES), _choices("districts", "districtCode", D.DISTRICT_LABELS), _choices("tenure", "tenureCode", D.TENURES),
        _choices("floor level", "floorLevel", D.FLOOR_LEVELS), _choices("furnishing", "furnishing", D.FURNISHINGS), _choices("unit features", "unitFeatures", D.UNIT_FEATURES), _choices("facilities", "projectFeatures", D.PROJECT_FEATURES),
        F.when(is_set("listingFeatures"), F.lower(D.labels_of(D.LISTING_FEATURES, F.col("listingFeatures")))),
        F.when(F.coalesce(F.col("distanceToMrt"), F.lit("")) != "", F.concat(F.lit("an MRT or LRT "), F.lower(D.label_of(D.DISTANCES, F.col("distanceToMrt"))), F.lit(" away"))),
        F.when(is_set("keyword"), F.concat(F.lit('keyword "'), F.trim("keyword"), F.lit('"'))),
        F.when(F.coalesce(F.col("lastPosted"), F.lit("")) != "", F.concat(F.lit("listed "), F.lower(D.label_of(D.POSTED, F.col("lastPosted"))))),
    ]
    if pages:
        parts.append(F.when(F.coalesce(F.col(pages), F.lit(ALL_PAGES)) != ALL_PAGES, F.concat(F.col(pages), F.lit(" pages scanned"))))
    return clauses(*parts)


def search_lines(forms: DataFrame, key: str, arrival: Sequence[str] = (), pages: str | None = "maxPages") -> DataFrame:
    """Per search (``key``, a row a form): ``full``, all forms described by group, and ``summary``, one line of a list: a single
    form in full, several with the number of their filters. Forms of one group come in the order of ``arrival``."""
    n = count_set()
    count = F.when(n == 0, F.lit("no filters")).otherwise(F.concat(n.cast("string"), F.when(n == 1, " filter").otherwise(" filters")))
    label, place = D.label_of(D.GROUP_LABELS, F.col("grp")), F.array_position(F.lit(list(D.TYPES)), F.col("grp"))
    rows = forms.select(key, F.struct(place.alias("group"), *arrival).alias("place"), label.alias("label"), description(pages).alias("text"), count.alias("count"))
    groups = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "label", "text", "count"))).alias("g"))
    bracketed = lambda what: F.array_join(F.transform("g", lambda x: F.concat(x["label"], F.lit(" ("), x[what], F.lit(")"))), ", ")
    only = F.element_at("g", 1)
    return groups.select(key, bracketed("text").alias("full"), F.when(F.size("g") == 1, F.concat(only["label"], F.lit(", "), only["text"])).otherwise(bracketed("count")).alias("summary"))
