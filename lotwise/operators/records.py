"""Records that come in from outside, rebuilt field by field: what a record doesn't name is dropped, texts become one line,
links lose white space, and ``reasons`` lists what is wrong with a row. Rows without reasons are fit to be stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import entity_key, squeezed

#: Greatest numbers of characters and of entries.
MOST_LABEL, MOST_ID, MOST_LISTING_ID, MOST_URL = 200, 100, 64, 500
MOST_NAME, MOST_SESSION, MOST_PROMPT, MOST_CONTEXT = 80, 100, 20_000, 200_000
MOST_HIDDEN, MOST_BOOKMARKED, MOST_FLOORPLANS, MOST_PHOTOS = 500, 200, 20, 60
MODES = ("api", "browser")
INFO_TEXTS = {"district": 40, "districtName": 100, "regionName": 100, "address": 300, "tenure": 100, "developer": 200, "propertyType": 100, "psfRange": 100}
INFO_NUMBERS = ("topYear", "totalUnits", "floors")
ENTRY_TEXTS = {"propertyName": 200, "listedLabel": 100, "agentName": 200, "agencyName": 200}
ENTRY_NUMBERS = ("bedrooms", "price", "bathrooms", "floorAreaSqft", "psf", "listedAt")


class Checked:
    """Clean columns and the rules that they broke."""

    def __init__(self):
        self.columns: dict[str, Column] = {}
        self.rules: list[Column] = []

    def rule(self, broken: Column, reason: str) -> None:
        self.rules.append(F.when(F.coalesce(broken, F.lit(False)), F.lit(reason)))

    def text(self, name: str, value: Column, most: int, needed: bool = False) -> None:
        clean = F.coalesce(squeezed(value), F.lit(""))
        self.columns[name] = clean
        self.rule(F.length(clean) > most, f"{name} is too long")
        if needed:
            self.rule(clean == "", f"{name} is required")

    def number(self, name: str, value: Column) -> None:
        self.columns[name] = value.cast("bigint")
        self.rule(value < 0, f"{name} is negative")

    def url(self, name: str, value: Column) -> None:
        clean = one_url(value)
        self.columns[name] = clean
        self.rule(bad_url(clean), f"{name} is no web address")

    def urls(self, name: str, value: Column, most: int) -> None:
        clean = url_list(value)
        self.columns[name] = clean
        self.rule(F.size(F.coalesce(value, F.array().cast("array<string>"))) > most, f"{name} has too many values")
        self.rule(F.exists(clean, bad_url), f"{name} has no web address")

    @property
    def reasons(self) -> Column:
        return F.array_compact(F.array(*self.rules)) if self.rules else F.array().cast("array<string>")


def one_url(value: Column) -> Column:
    return F.coalesce(F.regexp_replace(value, r"\s", ""), F.lit(""))


def bad_url(url: Column) -> Column:
    """A link that is set but no web address, or too long."""
    return (url != "") & (~url.rlike("^https?://") | (F.length(url) > MOST_URL))


def url_list(values: Column) -> Column:
    """Links without white space; empty ones go."""
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), one_url), lambda u: u != "")


def _rows(rows: DataFrame, checked: Checked, *keep: str) -> DataFrame:
    return rows.select(*keep, *(c.alias(n) for n, c in checked.columns.items()), checked.reasons.alias("reasons"))


def shortlist_entries(rows: DataFrame, *keep: str) -> DataFrame:
    """Shortlisted units with their property's facts (``info``): links and numbers checked, coordinates and group dropped."""
    c, info = Checked(), Checked()
    listing = F.trim(F.coalesce(F.col("listingId").cast("string"), F.lit("")))
    c.columns["listingId"] = listing
    c.rule(listing == "", "listingId is required")
    c.rule(F.length(listing) > MOST_LISTING_ID, "listingId is too long")
    c.rule((listing != "") & ~listing.rlike(r"^[\p{L}\p{N}_-]*[\p{L}\p{N}][\p{L}\p{N}_-]*$"), "listingId has an invalid character")
    c.text("propertyId", F.col("propertyId").cast("string"), MOST_ID, needed=True)
    for name, most in ENTRY_TEXTS.items():
        c.text(name, F.col(name), most)
    for name in ENTRY_NUMBERS:
        c.number(name, F.col(name))
    c.url("url", F.col("url"))
    c.urls("floorplans", F.col("floorplans"), MOST_FLOORPLANS)
    c.urls("photos", F.col("photos"), MOST_PHOTOS)
    for name, most in INFO_TEXTS.items():
        info.text(name, F.col(f"info.{name}"), most)
    for name in INFO_NUMBERS:
        info.number(name, F.col(f"info.{name}"))
    for name in ("projectUrl", "imageUrl"):
        info.url(name, F.col(f"info.{name}"))
    info.urls("photos", F.col("info.photos"), MOST_PHOTOS)
    info.columns["photoCount"] = F.size(info.columns["photos"])
    found = F.coalesce(F.nullif(F.col("info.enrichment"), F.lit("")), F.lit("unavailable"))
    info.columns["enrichment"] = found
    info.rule(~found.isin("ok", "unavailable"), "enrichment is unknown")
    c.rules += info.rules
    c.columns["info"] = F.struct(*(v.alias(n) for n, v in info.columns.items()))
    return _rows(rows, c, *keep)


def _entity(c: Checked, scope: Column, id: Column, label: Column) -> None:
    plain = F.trim(F.coalesce(id.cast("string"), F.lit("")))
    c.columns |= {"entityKey": entity_key(scope, plain), "scope": scope, "id": plain, "label": F.substring(F.coalesce(label, F.lit("")), 1, MOST_LABEL)}
    c.rule(~F.coalesce(scope.isin("property", "unit"), F.lit(False)), "scope must be property or unit")
    c.rule(plain == "", "id is required")
    c.rule(F.length(plain) > MOST_ID, "id is too long")


def always_hidden(rows: DataFrame, now: int, *keep: str) -> DataFrame:
    """Entries hidden in every search; without a time of their own they get ``now``."""
    c = Checked()
    _entity(c, F.col("scope"), F.col("id"), F.col("label"))
    c.columns["createdAt"] = F.coalesce(F.col("createdAt").cast("bigint"), F.lit(now).cast("bigint"))
    c.rule(F.col("createdAt") < 0, "createdAt is negative")
    return _rows(rows, c, *keep)


def bookmarks(rows: DataFrame, *keep: str) -> DataFrame:
    """Bookmarked properties; a scope is not needed, but a unit's is wrong."""
    c = Checked()
    _entity(c, F.lit("property"), F.col("id"), F.col("label"))
    c.rule(F.coalesce(F.col("scope"), F.lit("property")) != "property", "bookmarks are properties only")
    return _rows(rows, c, *keep)


def list_updates(rows: DataFrame, items: str, most: int = MOST_HIDDEN, *keep: str) -> DataFrame:
    """Lists of entries (``scope``, ``id``, ``label``): each key once, where it came first, newest ``createdAt`` first; lists
    that are too long or hold a bad entry are named in ``reasons``."""
    entry = F.col(items)
    plain = lambda x: F.trim(F.coalesce(x["id"], F.lit("")))
    c = Checked()
    clean = F.transform(F.coalesce(entry, F.array()), lambda x: F.struct(entity_key(x["scope"], plain(x)).alias("entityKey"), x["scope"].alias("scope"), plain(x).alias("id"), F.substring(F.coalesce(x["label"], F.lit("")), 1, MOST_LABEL).alias("label"), F.coalesce(x["createdAt"], F.lit(0)).cast("bigint").alias("createdAt")))
    keys = F.transform(clean, lambda x: x["entityKey"])
    first = F.filter(clean, lambda x, i: F.array_position(keys, x["entityKey"]) == i + 1)
    order = F.array_sort(F.transform(first, lambda x, i: F.struct((-x["createdAt"]).alias("o"), i.alias("i"), x.alias("x"))))
    c.columns[items] = F.transform(order, lambda o: o["x"])
    c.rule(F.size(entry) > most, f"{items} has too many values")
    c.rule(F.exists(clean, lambda x: ~F.coalesce(x["scope"].isin("property", "unit"), F.lit(False))), "scope must be property or unit")
    c.rule(F.exists(clean, lambda x: (x["id"] == "") | (F.length(x["id"]) > MOST_ID)), "id is required, in 100 characters")
    return _rows(rows, c, *keep)


#: Characters of the parts of an action.
MOST_OF_ACTION = {"name": 100, "description": 1000, "example": 500}


def actions(rows: DataFrame, *keep: str) -> DataFrame:
    """Action definitions, reduced to name, description, parameters (a map of texts) and example."""
    c = Checked()
    for part, most in MOST_OF_ACTION.items():
        c.text(part, F.col(part), most, needed=part == "name")
    clean = F.transform_values(F.coalesce(F.col("parameters"), F.create_map().cast("map<string,string>")), lambda k, v: F.coalesce(squeezed(v), F.lit("")))
    c.columns["parameters"] = clean
    c.rule(F.exists(F.map_values(clean), lambda v: F.length(v) > 500), "a parameter is too long")
    return _rows(rows, c, *keep)


def chat_requests(rows: DataFrame, *keep: str) -> DataFrame:
    """Turns of a conversation: a prompt, a session, the page it is about, and, where ``rows`` has them, its ``actions`` (an array of structs as ``actions``
    takes them), each reduced and checked in the same way."""
    c = Checked()
    c.columns["prompt"] = F.regexp_replace(F.coalesce(F.col("prompt"), F.lit("")), r"^\s+|\s+$", "")
    c.rule(c.columns["prompt"] == "", "prompt is required")
    c.rule(F.length("prompt") > MOST_PROMPT, "prompt is too long")
    c.text("sessionId", F.col("sessionId"), MOST_SESSION, needed=True)
    c.columns["pageContext"] = F.coalesce(F.col("pageContext"), F.lit(""))
    c.rule(F.length("pageContext") > MOST_CONTEXT, "pageContext is too large")
    if "actions" in rows.columns:
        given = F.coalesce(F.col("actions"), F.array().cast(rows.schema["actions"].dataType))
        said = lambda v: F.coalesce(squeezed(v), F.lit(""))
        clean = F.transform(given, lambda a: F.struct(said(a["name"]).alias("name"), said(a["description"]).alias("description"), F.transform_values(F.coalesce(a["parameters"], F.create_map().cast("map<string,string>")), lambda k, v: said(v)).alias("parameters"), said(a["example"]).alias("example")))
        c.columns["actions"] = clean
        c.rule(F.exists(clean, lambda a: a["name"] == ""), "an action's name is required")
        for part, most in MOST_OF_ACTION.items():
            longest = F.array_max(F.transform(clean.getField(part), F.length))
            c.rule(longest > most, f"an action's {part} is too long")
        c.rule(F.exists(clean, lambda a: F.exists(F.map_values(a["parameters"]), lambda v: F.length(v) > 500)), "an action's parameter is too long")
    return _rows(rows, c, *keep)


def saved_searches(rows: DataFrame, *keep: str) -> DataFrame:
    """Names of saved searches (their requests are checked by ``functions.requests``)."""
    c = Checked()
    c.text("name", F.col("name"), MOST_NAME, needed=True)
    return _rows(rows, c, *keep)


def known_mode(mode: Column, default: str = MODES[0]) -> Column:
    """A setting as stored; one that isn't known is the default."""
    return F.when(mode.isin(*MODES), mode).otherwise(F.lit(default))


def bad_mode(mode: Column) -> Column:
    return ~F.coalesce(mode.isin(*MODES), F.lit(False))
