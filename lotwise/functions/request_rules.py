"""Rules of search requests, stated once as a table and compiled twice: to a check of one request on the driver, and to
columns over the JSON of many requests, with all reasons why one is rejected.

A ``Shape`` says what a field may be. Reasons are ``field: word``; the words are in ``REASONS``.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dimensions import DISTANCES, TYPES

#: Fixed values of the request format.
GROUPS = ("N", "H", "L")
MOST_VALUES, MOST_PAGES, MOST_KEYWORD = 30, 10, 100
RANGES = (("minPrice", "maxPrice"), ("minSize", "maxSize"), ("minSizeLand", "maxSizeLand"), ("minTop", "maxTop"), ("minPsf", "maxPsf"))
LISTS = ("bedrooms", "bathrooms", "propertyTypeCode", "districtCode", "tenureCode", "floorLevel", "furnishing", "unitFeatures", "projectFeatures")
FLAGS = ("isVerified", "withFloorplans", "withStream")
SORTS = (("date", "price", "psf", "size"), ("asc", "desc"))

#: Why a field is rejected.
REASONS = ("type", "number", "negative", "many", "entry", "long", "choice", "range", "group", "repeated", "empty", "object")


@dataclass(frozen=True)
class Shape:
    """What a field may be. ``kind``: number, list, flag, line or choice. An absent field, null and the empty text say nothing."""

    kind: str
    most: int = 0  # entries of a list, characters of a line
    of: tuple[str, ...] = ()  # the values of a choice
    default: str | None = None  # of a choice
    blank: bool = False  # whether a choice of nothing but white space says nothing


NUMBER, LIST, FLAG = Shape("number"), Shape("list", MOST_VALUES), Shape("flag")
#: The table: fields of a group's filters, in order.
FILTERS: dict[str, Shape] = {
    **{name: NUMBER for pair in RANGES for name in pair},
    "lastPosted": NUMBER,
    **dict.fromkeys(LISTS, LIST),
    **dict.fromkeys(FLAGS, FLAG),
    "keyword": Shape("line", MOST_KEYWORD),
    "distanceToMrt": Shape("choice", of=tuple(DISTANCES), blank=True),
    "sort": Shape("choice", of=SORTS[0], default="date"),
    "order": Shape("choice", of=SORTS[1], default="desc"),
}
#: Fields whose values depend on the group.
BY_GROUP = {"propertyTypeCode": {g: tuple(codes) for g, codes in TYPES.items()}}
#: Digits with a sign, and codes. Both may have white space around them.
DIGITS, CODE = r"[+-]?\d+(_\d+)*", r"_*[^\W_]\w*"


# on the driver ----------------------------------------------------------------------------------------------------------


def read_field(shape: Shape, value) -> tuple[object, str | None]:
    """The value as it is used (None: says nothing) and why it can't be."""
    if value is None or value == "" and isinstance(value, str) or shape.kind == "list" and not value:
        return shape.default, None
    plain_number = isinstance(value, int | float) and not isinstance(value, bool)
    if shape.kind == "number":
        if plain_number and math.isfinite(value):
            number = int(value)
        elif isinstance(value, str) and re.fullmatch(DIGITS, value.strip()):
            number = int(value)
        else:
            return None, "number"
        return (None, "negative") if number < 0 else (number, None)
    if shape.kind == "list":
        if not isinstance(value, list | tuple):
            return None, "type"
        if len(value) > shape.most:
            return None, "many"
        codes = [str(x).strip() if isinstance(x, int | str) and not isinstance(x, bool) else "" for x in value]
        return (codes, None) if all(re.fullmatch(CODE, c) for c in codes) else (None, "entry")
    if shape.kind == "flag":
        return (True if value else None, None) if isinstance(value, bool) else (None, "type")
    if not isinstance(value, str):
        return None, "type"
    if shape.kind == "line":
        line = " ".join(value.split())
        return (None, "long") if len(line) > shape.most else (line or None, None)
    choice = value.strip()
    if not choice and shape.blank:
        return shape.default, None
    return (choice, None) if choice in shape.of else (None, "choice")


@dataclass
class Checked:
    """The filters of one search and why they can't be used."""

    filters: dict = field(default_factory=dict)
    problems: list[str] = field(default_factory=list)


def check_filters(raw, group: str | None = None) -> Checked:
    if not isinstance(raw, dict):
        return Checked(problems=["filters: object"])
    out = Checked()
    for name, shape in FILTERS.items():
        value, problem = read_field(shape, raw.get(name))
        if problem:
            out.problems.append(f"{name}: {problem}")
        elif value is not None:
            out.filters[name] = value
    for name, of in BY_GROUP.items():
        if group in of and set(out.filters.get(name, ())) - set(of[group]):
            out.problems.append(f"{name}: group")
    out.problems += [f"{low}: range" for low, high in RANGES if low in out.filters and high in out.filters and out.filters[low] > out.filters[high]]
    return out


def check_request(body) -> tuple[list[dict], list[str]]:
    """The searches of a request (``grp``, ``most`` pages, 0: all, and ``filters``) and its problems (``place.field: reason``). Without a list of
    searches it is one of the first group."""
    if not isinstance(body, dict):
        return [], ["0.request: object"]
    raw = body.get("searches")
    if raw is None:
        raw = [{"propertyTypeGroup": GROUPS[0], "maxPages": body.get("maxPages"), "filters": body.get("filters")}]
    if not isinstance(raw, list):
        return [], ["0.searches: type"]
    if not raw:
        return [], ["0.searches: empty"]
    searches, problems, seen = [], [], set()
    for place, search in enumerate(raw):
        if not isinstance(search, dict):
            problems.append(f"{place}.search: object")
            continue
        group, problem = read_field(Shape("choice", of=GROUPS), search.get("propertyTypeGroup"))
        if problem or group is None:
            problems.append(f"{place}.propertyTypeGroup: {problem or 'choice'}")
        elif group in seen:
            problems.append(f"{place}.propertyTypeGroup: repeated")
        seen.add(group)
        pages, problem = read_field(NUMBER, search.get("maxPages"))
        problems += [f"{place}.maxPages: {problem}"] if problem else []
        checked = check_filters(search.get("filters") or {}, group)
        problems += [f"{place}.{p}" for p in checked.problems]
        searches.append({"grp": group, "most": 1 if pages is None else min(pages, MOST_PAGES), "filters": checked.filters})
    return searches, problems


# as columns -------------------------------------------------------------------------------------------------------------


def _get(v: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def kind_of(v: Column) -> Column:
    """``text``, ``integer``, ``fraction``, ``flag``, ``list``, ``object``, or null for null and what isn't there."""
    name = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | (name == "VOID"), F.lit(None).cast("string"))
        .when(name == "STRING", "text").when((name == "BIGINT") | name.rlike(r"^DECIMAL\(\d+,0\)"), "integer").when((name == "DOUBLE") | name.startswith("DECIMAL"), "fraction")
        .when(name == "BOOLEAN", "flag").when(name.startswith("ARRAY"), "list").otherwise("object")
    )


def _unicode(pattern: str) -> str:
    return "(?U)^" + pattern + "$"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _number(v: Column, kind: Column) -> Column:
    """A number of up to 38 digits, its fraction dropped; longer ones and others are null."""
    d = F.try_variant_get(v, "$", "double")
    text = F.regexp_replace(_strip(F.try_variant_get(v, "$", "string")), "_", "")
    small = F.abs(d) < 1e15  # greater ones have no fraction to drop
    whole = F.when(small, F.signum(d) * F.floor(F.when(small, F.abs(d)))).otherwise(d)
    return F.when(kind == "fraction", whole.try_cast("decimal(38,0)")).otherwise(text.try_cast("decimal(38,0)"))


def field_columns(shape: Shape, v: Column) -> tuple[Column, Column]:
    """The value of a field (a decimal, an array of texts, a truth value or a text; null: says nothing) and why it can't be used."""
    kind = kind_of(v)
    text = F.try_variant_get(v, "$", "string")
    nothing = kind.isNull() | ((kind == "text") & (text == ""))
    never = F.lit(None).cast("string")
    if shape.kind == "number":
        number = _number(v, kind)
        finite = F.when(kind == "fraction", F.abs(F.try_variant_get(v, "$", "double")) < F.lit(float("inf"))).otherwise((kind == "integer") | ((kind == "text") & _strip(text).rlike(_unicode(DIGITS))))
        below = F.when(kind == "fraction", F.try_variant_get(v, "$", "double") <= -1).otherwise(_strip(text).rlike(r"^-") & ~_strip(text).rlike(r"^-[0_]*$"))
        problem = F.when(nothing, never).when(~finite, "number").when(below, "negative")
        return F.when(~nothing & problem.isNull(), F.abs(number)), problem
    if shape.kind == "list":
        entries = F.try_variant_get(v, "$", "array<variant>")
        nothing = nothing | ((kind == "list") & (F.size(entries) == 0)) | ((kind == "flag") & ~F.try_variant_get(v, "$", "boolean")) | (kind.isin("integer", "fraction") & (F.try_variant_get(v, "$", "double") == 0)) | ((kind == "object") & (F.schema_of_variant(v) == "OBJECT<>"))
        codes = F.transform(entries, lambda e: F.when(kind_of(e).isin("integer", "text"), _strip(F.try_variant_get(e, "$", "string"))))
        good = F.forall(codes, lambda c: F.coalesce(c.rlike(_unicode(CODE)), F.lit(False)))
        problem = F.when(nothing, never).when(kind != "list", "type").when(F.size(entries) > shape.most, "many").when(~good, "entry")
        return F.when(~nothing & problem.isNull(), codes), problem
    if shape.kind == "flag":
        problem = F.when(nothing, never).when(kind != "flag", "type")
        return F.when(~nothing & problem.isNull() & F.try_variant_get(v, "$", "boolean"), F.lit(True)), problem
    if shape.kind == "line":
        line = _strip(F.regexp_replace(text, r"(?U)\s+", " "))
        problem = F.when(nothing, never).when(kind != "text", "type").when(F.length(line) > shape.most, "long")
        return F.when(~nothing & problem.isNull(), F.nullif(line, F.lit(""))), problem
    choice = _strip(text)
    nothing = nothing | ((kind == "text") & (choice == "")) if shape.blank else nothing
    problem = F.when(nothing, never).when(kind != "text", "type").when(~choice.isin(*shape.of), "choice")
    value = F.when(~nothing & problem.isNull(), choice)
    return F.when(nothing, F.lit(shape.default)).otherwise(value), problem


def searches_of(requests: DataFrame, key: str, body: str = "body") -> DataFrame:
    """One row a search of a request: ``key``, ``place``, ``grp``, ``most``, ``filters`` (a struct with a column for each field of FILTERS) and ``problems``
    (an array of ``field: reason``). A request whose searches can't be told has one row, of place 0, with its problem; so has one whose JSON can't be
    read, also because a name is in an object twice."""
    v = requests.select(F.col(key).alias("key"), F.try_parse_json(body).alias("v"))
    v = v.withColumn("kind", kind_of(F.col("v"))).withColumn("raw", _get(F.col("v"), "searches"))
    v = v.withColumn("raw_kind", kind_of(F.col("raw"))).withColumn("listed", F.try_variant_get("raw", "$", "array<variant>"))
    whole = (
        F.when(~F.col("kind").eqNullSafe("object"), "request: object")
        .when(F.col("raw_kind").isNotNull() & (F.col("raw_kind") != "list"), "searches: type")
        .when((F.col("raw_kind") == "list") & (F.size("listed") == 0), "searches: empty")
    )
    rows = v.withColumn("whole", whole).withColumn("one", F.col("raw_kind").isNull())
    rows = rows.select("key", "v", "whole", "one", F.posexplode_outer(F.when(F.col("whole").isNull() & ~F.col("one"), F.col("listed"))).alias("place", "own"))
    rows = rows.withColumn("place", F.coalesce("place", F.lit(0))).withColumn("s", F.when(F.col("one"), F.col("v")).otherwise(F.col("own")))
    is_object = F.coalesce(kind_of(F.col("s")) == "object", F.lit(False))
    group_value, group_problem = field_columns(Shape("choice", of=GROUPS), _get(F.col("s"), "propertyTypeGroup"))
    group_value = F.when(F.col("one"), F.lit(GROUPS[0])).otherwise(group_value)
    group_problem = F.when(~F.col("one"), F.coalesce(group_problem, F.when(group_value.isNull(), "choice")))
    most, most_problem = field_columns(NUMBER, _get(F.col("s"), "maxPages"))
    raw = _get(F.col("s"), "filters")
    raw_kind = kind_of(raw)
    # a null, false, 0, empty text or empty list instead of filters is none
    falsy = raw_kind.isNull() | ((raw_kind == "text") & (F.try_variant_get(raw, "$", "string") == "")) | ((raw_kind == "flag") & ~F.try_variant_get(raw, "$", "boolean")) | (raw_kind.isin("integer", "fraction") & (F.try_variant_get(raw, "$", "double") == 0)) | ((raw_kind == "list") & (F.size(F.try_variant_get(raw, "$", "array<variant>")) == 0))
    rows = rows.select("key", "place", "whole", is_object.alias("is_object"), group_value.alias("grp"), group_problem.alias("grp_problem"), most.alias("most"), most_problem.alias("most_problem"), F.when(~falsy, raw).alias("f"), (~falsy & (raw_kind != "object")).alias("no_object"))
    columns = {name: field_columns(shape, _get(F.col("f"), name)) for name, shape in FILTERS.items()}
    rows = rows.select("*", *(value.alias(f"f_{n}") for n, (value, _) in columns.items()), *(problem.alias(f"p_{n}") for n, (_, problem) in columns.items()))
    said = lambda name, c: F.concat(F.lit(f"{name}: "), c)
    codes = F.create_map(*(x for g, of in BY_GROUP["propertyTypeCode"].items() for x in (F.lit(g), F.lit(list(of)))))
    # whether an earlier search has the group: one struct a search, at most a request's own searches in a window
    first = F.min(F.struct("place")).over(_by("key", "grp"))["place"]
    of_search = F.array_compact(
        F.array(
            said("propertyTypeGroup", F.coalesce(F.col("grp_problem"), F.when(F.col("grp").isNotNull() & (first < F.col("place")), "repeated"))),
            said("maxPages", F.col("most_problem")),
            F.when(F.col("no_object"), "filters: object"),
            *(said(n, F.col(f"p_{n}")) for n in FILTERS),
            said("propertyTypeCode", F.when(F.size(F.array_except("f_propertyTypeCode", F.try_element_at(codes, F.col("grp")))) > 0, "group")),
            *(said(low, F.when(F.col(f"f_{low}") > F.col(f"f_{high}"), "range")) for low, high in RANGES),
        )
    )
    problems = F.when(F.col("whole").isNotNull(), F.array("whole")).when(~F.col("is_object"), F.array(F.lit("search: object"))).otherwise(of_search)
    filters = F.struct(*(F.col(f"f_{n}").alias(n) for n in FILTERS))
    pages = F.when(F.col("most").isNull(), 1).otherwise(F.least(F.col("most"), F.lit(MOST_PAGES))).cast("bigint")
    return rows.select(F.col("key").alias(key), F.col("place").cast("int").alias("place"), "grp", pages.alias("most"), filters.alias("filters"), problems.alias("problems"))


def _by(*columns: str):
    from pyspark.sql import Window

    return Window.partitionBy(*columns)


def split_requests(searches: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Searches of requests without any problem, and the rejects: ``key``, ``place``, ``field`` and ``reason``, a row each."""
    bad = searches.select(key, "place", F.explode("problems").alias("p")).select(key, "place", F.split_part("p", F.lit(": "), F.lit(1)).alias("field"), F.split_part("p", F.lit(": "), F.lit(2)).alias("reason"))
    whole = F.max(F.size("problems")).over(_by(key)) == 0
    return searches.withColumn("__good", whole).filter("__good").drop("__good", "problems"), bad
