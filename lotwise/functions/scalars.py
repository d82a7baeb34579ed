"""Scalar expressions. All are built from Spark's own functions, so they stay inside generated code.

Two rules about missing values are kept apart by name: *tolerant* checks let a missing value pass, *strict* ones reject it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86_400
#: Chips stop at "5 or more".
MAX_CHIP, MIN_BATHROOM_CHIP = 5, 1


def truthy(c: Column) -> Column:
    """A number, or null for 0: zero means "not stated" in prices, areas and rates."""
    return F.nullif(c, F.lit(0))


def present(c: Column) -> Column:
    """A string, or null for the empty one."""
    return F.nullif(c, F.lit(""))


def first_of(*columns: Column) -> Column:
    """The first string that is neither null nor empty, else the empty string."""
    return F.coalesce(*(present(c) for c in columns), F.lit(""))


def half_even(c: Column) -> Column:
    """Rounded to an integer, halves to the even neighbour."""
    return F.bround(c).cast("bigint")


def half_up(c: Column) -> Column:
    """Rounded to an integer, halves towards plus infinity."""
    return F.floor(c + F.lit(0.5)).cast("bigint")


def per_area(price: Column, area: Column) -> Column:
    return half_even(truthy(price) / truthy(area))


def in_range_tolerant(value: Column, low: Column, high: Column) -> Column:
    return value.isNull() | ((low.isNull() | (value >= low)) & (high.isNull() | (value <= high)))


def in_range_strict(value: Column, low, high) -> Column:
    """Without bounds anything passes; with one, a missing or infinite value doesn't. ``low`` and ``high`` are numbers or None."""
    if low is None and high is None:
        return F.lit(True)
    ok = value.isNotNull()
    if low is not None:
        ok = ok & (value >= F.lit(low))
    if high is not None:
        ok = ok & (value <= F.lit(high))
    return F.coalesce(ok, F.lit(False))


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * SECONDS_PER_DAY + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def to_integer(text: Column) -> Column:
    """The first number of a text, thousands separators left out, halves to even; null without one or beyond 64 bits."""
    number = F.replace(F.regexp_extract(text, r"-?\d[\d,]*(\.\d+)?", 0), F.lit(","), F.lit("")).try_cast("double")
    return F.bround(number).try_cast("bigint")


def to_number(text: Column) -> Column:
    """A text as a finite number, else null."""
    number = F.trim(text).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), number)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def project_path(name: Column, key: Column) -> Column:
    """Path of a project page; empty unless the key is all digits and there is a name."""
    ok = F.coalesce(key.rlike("^[0-9]+$") & (name != ""), F.lit(False))
    return F.when(ok, F.concat(F.lit("/project/"), slug(name), F.lit("-"), key)).otherwise(F.lit(""))


def squeezed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def entity_key(scope: Column, key: Column) -> Column:
    return F.concat_ws("#", scope, key)


def bedroom_label(n: Column) -> Column:
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit("Studio or unlisted")).otherwise(F.concat(n.cast("string"), F.lit(" bedroom")))


def tenure_label(code: Column) -> Column:
    """The labels of known tenure codes; other codes stay."""
    return F.when(code == "L99", "99-year leasehold").when(code == "L999", "999-year leasehold").when(code == "F", "Freehold").otherwise(code)


def tenure_code(text: Column, known: tuple[str, ...] = ("F", "L99", "L103", "L110", "L999", "L9999", "NA")) -> Column:
    """The code that a stated tenure stands for; null where it has none."""
    years = F.regexp_extract(F.trim(text), r"(?i)^(\d+)\s*-?\s*year", 1)
    code = F.concat(F.lit("L"), years)
    return F.when(F.lower(F.trim(text)) == "freehold", F.lit("F")).when((years != "") & code.isin(*known), code)


def bedroom_chip(n: Column) -> Column:
    return F.when(n >= 0, F.least(n, F.lit(MAX_CHIP)))


def bathroom_chip(n: Column) -> Column:
    return F.when(n >= MIN_BATHROOM_CHIP, F.least(n, F.lit(MAX_CHIP)))


def posted_within(listed_at: Column, days: Column, now: int) -> Column:
    return F.coalesce(listed_at >= F.lit(now) - days * SECONDS_PER_DAY, F.lit(False))


def is_new(listed_at: Column, since: int | None) -> Column:
    return F.coalesce((truthy(listed_at) > F.lit(since)) & F.lit(bool(since)), F.lit(False))


def money(n: Column) -> Column:
    return F.coalesce(F.concat(F.lit("S$ "), F.format_number(n, 0)), F.lit("Not available"))


def or_missing(text: Column) -> Column:
    return F.coalesce(present(text), F.lit("Not available"))


def grouped_number(n: Column) -> Column:
    return F.coalesce(F.format_number(n, 0), F.lit("Not available"))


def money_per_area(n: Column) -> Column:
    return F.coalesce(F.concat(F.lit("S$ "), F.format_number(n, 0), F.lit(" psf")), F.lit("Not available"))


def area_label(n: Column) -> Column:
    return F.coalesce(F.concat(F.format_number(n, 0), F.lit(" sqft")), F.lit("Not available"))


def day_label(at: Column, now: int, before_date: str = "") -> Column:
    """today, yesterday, n days ago, or the date after a week (UTC), with ``before_date`` before it."""
    days = F.floor((F.lit(now) - at) / SECONDS_PER_DAY)
    date = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(at / SECONDS_PER_DAY).cast("int"))
    return F.when(days <= 0, "today").when(days == 1, "yesterday").when(days < 7, F.concat(days.cast("string"), F.lit(" days ago"))).otherwise(F.concat(F.lit(before_date), F.date_format(date, "d MMM yyyy")))


def page_number(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"[?&]page=(\d+)", 1).try_cast("int"), F.lit(1))


def path_head(url: Column) -> Column:
    """The first part of a URL's path."""
    return F.regexp_extract(url, r"^[a-z]+://[^/]+/([^/?#]*)", 1)


def toggled(items: Column, item: Column) -> Column:
    return F.when(F.array_contains(items, item), F.array_remove(items, item)).otherwise(F.array_append(items, item))


def toggled_region(selected: Column, districts: Column) -> Column:
    """All of a region's districts are taken out if all are selected, else the missing ones are put in; sorted."""
    full = F.size(F.array_except(districts, selected)) == 0
    return F.array_sort(F.when(full, F.array_except(selected, districts)).otherwise(F.array_union(selected, districts)))


def toggled_group(selected: Column, group: Column, order: tuple[str, ...] = ("N", "H", "L")) -> Column:
    """Groups in their fixed order after a toggle; the last one can't be taken out."""
    new = toggled(selected, group)
    kept = F.filter(F.lit(list(order)), lambda g: F.array_contains(new, g))
    return F.when(F.size(kept) == 0, F.filter(F.lit(list(order)), lambda g: F.array_contains(selected, g))).otherwise(kept)


def projected(lng: Column, lat: Column, min_lng: float, max_lat: float, scale: float) -> tuple[Column, Column]:
    return (lng - F.lit(min_lng)) * F.lit(scale), (F.lit(max_lat) - lat) * F.lit(scale)


def map_query(latitude: Column, longitude: Column, address: Column, country: str = "Singapore") -> Column:
    """What a map is asked for: coordinates if both are finite, else the address in its country, else null."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf")))
    plain = present(F.trim(address))
    return F.when(finite(latitude) & finite(longitude), F.concat_ws(",", latitude.cast("string"), longitude.cast("string"))).otherwise(F.concat(plain, F.lit(f", {country}")))


def url_component(text: Column) -> Column:
    """Percent-encoded like a component of a link: blanks too, and not the marks that links may hold."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, mark in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(mark))
    return out


def map_link(query: Column) -> Column:
    return F.concat(F.lit("https://www.google.com/maps/search/?api=1&query="), url_component(query))


def map_embed(query: Column) -> Column:
    return F.concat(F.lit("https://www.google.com/maps?q="), url_component(query), F.lit("&z=17&output=embed"))


def digits_and_point(typed: Column) -> Column:
    """What was typed reduced to digits and its first point."""
    kept = F.regexp_replace(typed, "[^0-9.]", "")
    head = F.substring_index(kept, ".", 1)
    rest = F.substring(kept, F.length(head) + 2, F.length(kept))
    return F.when(F.contains(kept, F.lit(".")), F.concat(head, F.lit("."), F.replace(rest, F.lit("."), F.lit("")))).otherwise(kept)


def grouped_digits(digits: Column) -> Column:
    """Thousands grouped; the fraction stays as it is, a point at the end too."""
    head = F.substring_index(digits, ".", 1)
    whole = F.when(head == "", F.lit("")).otherwise(F.format_number(head.try_cast("decimal(38,0)"), 0))
    return F.when(F.contains(digits, F.lit(".")), F.concat(whole, F.substring(digits, F.length(head) + 1, F.length(digits)))).otherwise(whole)


def photo_file(url: Column, place: Column, served: Column) -> Column:
    """A file name from a photo's link, its place and the type that was served."""
    stem = F.regexp_replace(F.substring_index(F.substring_index(url, "?", 1), "/", -1), r"\.[A-Za-z0-9]+$", "")
    end = F.when(served == "image/jpeg", "jpg").otherwise(F.substring_index(served, "/", -1))
    return F.concat_ws(".", F.concat_ws("-", stem, F.lpad(place.cast("string"), 2, "0")), end)


def progress_detail(phase: Column, done: Column, total: Column) -> Column:
    """Page n of m while searching, n of m for details, cached where there are no details to fetch, else nothing."""
    of = F.concat(done.cast("string"), F.lit(" of "), total.cast("string"))
    return F.when(phase == "cached", "cached").when((phase == "detail") & (total == 0), "cached").when(phase == "search", F.concat(F.lit("page "), of)).when(phase == "detail", of).otherwise("")


def bare_tool(name: Column) -> Column:
    """A tool's name without the prefixes before its last double underscore."""
    return F.element_at(F.split(name, "__"), -1)


def tool_call(text: Column) -> Column:
    """``name(args) → result`` as a struct of tool, args and result; a text of another form is a name."""
    part = lambda g: F.regexp_extract(text, r"(?s)^([^(]*)\(([^)]*)\)(?: → (.*))?$", g)
    whole = part(1) == ""
    return F.struct(bare_tool(F.when(whole, text).otherwise(part(1))).alias("tool"), part(2).alias("args"), F.coalesce(part(3), F.lit("")).alias("result"))


#: Arguments that say what some tools do, and the lengths of a shown argument and of a shown step.
HIGHLIGHTS = {"WebSearch": ("query",), "WebFetch": ("url",)}
MOST_ARGUMENT, MOST_STEP = 120, 300


def tool_step(name: Column, keys: Column, values: Column) -> Column:
    """A tool's step: its bare name with its telling arguments, or else its first short one, in 300 characters. ``keys`` and
    ``values``: its scalar arguments as texts, in order."""
    tool, pairs = bare_tool(name), F.arrays_zip(keys.alias("k"), values.alias("v"))
    short = F.try_element_at(F.filter(values, lambda v: F.length(v) <= MOST_ARGUMENT), F.lit(1))
    shown = short
    for known, names in HIGHLIGHTS.items():
        told = F.array_join(F.transform(F.filter(pairs, lambda p: p["k"].isin(*names)), lambda p: p["v"]), " ")  # noqa: B023
        shown = F.when(tool == known, told).otherwise(shown)
    return F.substring(F.when(F.coalesce(shown, F.lit("")) == "", tool).otherwise(F.concat(tool, F.lit("("), shown, F.lit(")"))), 1, MOST_STEP)


def viewport(zoom: Column, x: Column, y: Column, width: float, height: float) -> Column:
    """The box (least and greatest x and y) that a zoomed and moved view shows, or null while it is at rest. The move is kept
    within the picture."""
    held = lambda move, size: F.least(F.lit(0.0), F.greatest((1 - zoom) * size, move))
    left, top = held(x, width), held(y, height)
    box = F.struct((-left / zoom).alias("min_x"), (-top / zoom).alias("min_y"), ((width - left) / zoom).alias("max_x"), ((height - top) / zoom).alias("max_y"))
    return F.when(~((zoom == 1) & (left == 0) & (top == 0)), box)


def cover_first(photos: Column, cover: Column) -> Column:
    """The cover goes first unless the photos have it or there is none."""
    return F.when((F.coalesce(cover, F.lit("")) == "") | F.array_contains(photos, cover), photos).otherwise(F.array_prepend(photos, cover))


def changed(old: Column, new: Column) -> Column:
    """Whether two requests (structs) differ in their canonical texts, where a missing field and a null one are the same."""
    return ~F.to_json(old).eqNullSafe(F.to_json(new))


def selection_state(selected: Column, of: Column) -> Column:
    """none, some or all of a region's districts are selected."""
    n = F.size(F.array_intersect(selected, of))
    return F.when(n == 0, "none").when(n == F.size(of), "all").otherwise("some")


def placeholder(what: str, bound: Column) -> Column:
    """What an empty field shows, such as "Min 1,235": the bound rounded half up, empty without one."""
    return F.coalesce(F.concat(F.lit(f"{what} "), F.format_number(half_up(bound), 0)), F.lit(""))


def tail(text: Column, most: int = 4000) -> Column:
    """The end of a long text, such as an error's details."""
    return F.right(text, F.lit(most))
