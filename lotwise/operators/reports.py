"""Reports of a screen for a reader: sections of ordered lines, which are joined last. A section's lines are rows of
(``section``, ``ord``, ``text``); every section has at least one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bedroom_label, day_label, grouped_number, money, or_missing
from .listings import top_units
from .text import report

MOST_UNITS = 10


def facts(found: Column, top_year: Column, tenure: Column, total_units: Column) -> Column:
    known = F.concat(F.lit("TOP year "), or_missing(top_year.cast("string")), F.lit(", tenure "), or_missing(F.trim(tenure)), F.lit(", "), grouped_number(total_units), F.lit(" total units"))
    return F.when(found, known).otherwise(F.lit("project details could not be scraped"))


def unit_text(shortlisted: Column | None = None, listed: bool = True) -> Column:
    area = F.when(F.col("floor_area").isNotNull(), F.concat(grouped_number(F.col("floor_area")), F.lit(" sqft"))).otherwise(F.lit("Not available"))
    parts = [F.lit("listingId "), F.col("listing_id").cast("string"), F.lit(", "), bedroom_label(F.col("bedrooms")), F.lit(" at "), money(F.col("price")), F.lit(", "), area]
    if listed:
        parts += [F.lit(", "), or_missing(F.trim("listed_label"))]
    if shortlisted is not None:
        parts.append(F.when(shortlisted, F.lit(", already shortlisted")).otherwise(F.lit("")))
    return F.concat(*parts)


def property_lines(units: DataFrame, arrival: list[str], text: Column, sums: dict[str, Column] | None = None) -> DataFrame:
    """Per property: its ten cheapest units as one text with how many more there are, and their number; and ``sums`` over its units, of the same shuffle."""
    best, sums = top_units(units, arrival, MOST_UNITS, sums), sums or {}
    rows = best.withColumn("text", text).groupBy("property_key").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("t"), F.max("remainder").alias("more"), F.count("*").alias("shown"), *(F.first(c).alias(c) for c in sums))
    more = F.when(F.col("more") > 0, F.concat(F.lit(", and "), F.col("more").cast("string"), F.lit(" more rows not listed here"))).otherwise(F.lit(""))
    return rows.select("property_key", F.concat(F.array_join(F.transform("t", lambda x: x["text"]), " | "), more).alias("listed"), (F.col("shown") + F.col("more")).alias("n"), *sums)


def _numbered(rows: DataFrame, section: str, order: list, start: int) -> DataFrame:
    """Lines of a section after its heading, in one window over the section's own rows (a screen's worth)."""
    return rows.select(F.lit(section).alias("section"), (F.row_number().over(Window.orderBy(*order)) + start).alias("ord"), "text")


def keyed_report(entries: DataFrame, readers: DataFrame, key: str, title: Column, none: str, order: list) -> DataFrame:
    """One row a reader (``key``, ``text``, ``lines``): a heading (a column over ``key`` and ``n``, the number of lines) and a line an entry (``text``), in
    order, or one line that there is none. A report is as long as its reader's own entries; readers are grouped like any key."""
    numbered = entries.select(key, F.row_number().over(Window.partitionBy(key).orderBy(*order)).alias("ord"), "text")
    lines = numbered.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("t"), F.count("*").alias("n"))
    body = F.concat(title, F.lit("\n"), F.array_join(F.transform("t", lambda x: x["text"]), "\n"))
    return readers.select(key).distinct().join(lines, key, "left").select(key, F.coalesce(body, F.lit(none)).alias("text"), (F.coalesce("n", F.lit(0)) + 1).alias("lines"))


def phase_text(phase: Column, status: Column, error: Column) -> Column:
    """What a search says that has no results to show; null for one that has."""
    return (
        F.when(phase == "running", F.concat(F.lit("The scrape is running: "), F.coalesce(F.nullif(status, F.lit("")), F.lit("starting")), F.lit(".")))
        .when(phase == "failed", F.concat(F.lit("The scrape failed: "), F.coalesce(F.nullif(error, F.lit("")), F.lit("no reason was given")), F.lit(".")))
        .when(phase == "cancelled", "The user cancelled this search before it finished, so there are no results.")
        .when(phase == "expired", "These results have expired and are no longer available.")
    )


def filters_text(filters: Column) -> Column:
    return F.when(F.coalesce(filters, F.lit("")) != "", F.concat(F.lit("The filters that ran this search: "), filters)).otherwise("The filters that ran this search are not on record. Do not guess at them.")


def phase_reports(jobs: DataFrame, key: str) -> DataFrame:
    """Per job without results to show (``phase``, ``status``, ``error``, ``filters``): its two sections."""
    said = jobs.select(key, phase_text(F.col("phase"), F.col("status"), F.col("error")).alias("phase"), filters_text(F.col("filters")).alias("filters")).filter("phase is not null")
    return said.select(key, F.inline(F.array(F.struct(F.lit("1 phase").alias("section"), F.col("phase").alias("text")), F.struct(F.lit("2 filters").alias("section"), F.col("filters").alias("text")))))


def _headed(entries: DataFrame, section: str, title: str, none: str, order: list) -> DataFrame:
    """A heading and one line an entry, or one line that there is none. ``entries`` has ``text``."""
    head = entries.agg(F.count("*").alias("n")).select(F.lit(section).alias("section"), F.lit(0).alias("ord"), F.when(F.col("n") == 0, F.lit(none)).otherwise(F.concat(F.lit(title), F.lit(""))).alias("text"))
    return head.union(_numbered(entries, section, order, 0))


def entity_text(with_key: bool = True) -> Column:
    if with_key:
        return F.concat(F.lit("- "), F.col("label"), F.lit(" (entityKey "), F.concat_ws("#", "scope", "id"), F.lit(", scope "), F.col("scope"), F.lit(", id "), F.col("id"), F.lit(")"))
    return F.concat(F.lit("- "), F.col("label"), F.lit(" (propertyId "), F.col("id"), F.lit(")"))


def listed_ids(ids: DataFrame, section: str, title: str, none: str) -> DataFrame:
    """One line with the ids in order, joined by commas, or that there is none. ``ids`` has ``ord`` columns in ``order``."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("property_place", "place", "listing_id"))), lambda x: x["listing_id"].cast("string")), ", ")
    return ids.agg(joined.alias("t")).select(F.lit(section).alias("section"), F.lit(0).alias("ord"), F.when(F.col("t") == "", F.lit(none)).otherwise(F.concat(F.lit(title), F.col("t"), F.lit("."))).alias("text"))


def result_report(phase: dict, props: DataFrame, units: DataFrame, arrival: list[str], shortlisted: DataFrame, hidden: DataFrame, always: DataFrame, bookmarked: DataFrame, new_since: int | None) -> DataFrame:
    """The report of a result screen: one row a section (``section``, ``text``, ``lines``).

    ``phase``: name and filters, and for a search that isn't done its status or error. ``props`` has the screen's properties
    (``place``, ``property_key``, ``name``, ``found``, ``top_year``, ``tenure``, ``total_units``); ``units`` all their units that
    aren't hidden; the entries have ``scope``, ``id``, ``label`` and ``created_at``."""
    spark = props.sparkSession
    line = lambda section, text: spark.range(1).select(F.lit(section).alias("section"), F.lit(0).alias("ord"), F.lit(text).alias("text"))
    if phase["phase"] != "done":
        job = spark.createDataFrame([(0, phase["phase"], phase.get("status"), phase.get("error"), phase.get("filters"))], "job int, phase string, status string, error string, filters string")
        return report(phase_reports(job, "job").select("section", F.lit(0).alias("ord"), "text"))
    filters = line("2 filters", phase.get("filters")).withColumn("text", filters_text(F.col("text").cast("string")))
    saved = (
        f'These results are the saved search "{phase["name"]}", so hiding, unhiding or bookmarking anything updates it straight away.'
        if phase.get("name")
        else "These results are not saved. Saving them keeps the filters, the hidden items and the bookmarks together under a name."
    )
    counts = props.agg(F.count("*").alias("p")).crossJoin(units.agg(F.count("*").alias("u")))  # one row each
    done = counts.select(F.lit("1 phase").alias("section"), F.lit(0).alias("ord"), F.concat(F.lit("Search complete: "), F.col("p").cast("string"), F.lit(" properties and "), F.col("u").cast("string"), F.lit(" units scraped.")).alias("text"))
    screen = counts.select(F.lit("4 screen").alias("section"), F.lit(0).alias("ord"), F.concat(F.lit("Properties on screen: "), F.col("p").cast("string"), F.lit(".")).alias("text"))
    marks, listed = bookmarked.select(F.col("id").alias("property_key")).distinct().withColumn("marked", F.lit(True)), shortlisted.select("listing_id").distinct().withColumn("short", F.lit(True))
    short = units.join(listed, "listing_id", "left")
    texts = property_lines(short, arrival, unit_text(F.coalesce("short", F.lit(False))))
    rows = props.join(marks, "property_key", "left").join(texts, "property_key", "left")
    own = F.concat(
        F.lit("- "), F.col("name"), F.lit(" (propertyId "), F.col("property_key"), F.lit(")"), F.when(F.col("marked"), F.lit(", bookmarked")).otherwise(F.lit("")), F.lit(", "),
        facts(F.col("found"), F.col("top_year"), F.col("tenure"), F.col("total_units")), F.lit(". "), F.coalesce(F.col("n"), F.lit(0)).cast("string"), F.lit(" listings in one table: "), F.coalesce(F.col("listed"), F.lit("")),
    )
    property_rows = rows.select(F.lit("5 properties").alias("section"), F.col("place").cast("int").alias("ord"), own.alias("text"))
    flat = Window.partitionBy("property_key").orderBy(F.nullif("price", F.lit(0)).asc_nulls_last(), *arrival)
    placed = short.withColumn("place", F.row_number().over(flat)).join(props.select("property_key", F.col("place").alias("property_place")), "property_key")
    here = listed_ids(placed.filter("short"), "6 shortlisted", "Shortlisted on this screen: ", "None of the units on this screen are shortlisted.")
    if new_since:
        since = F.date_format((F.lit(new_since).cast("timestamp")), "d MMM yyyy")
        fresh = listed_ids(placed.filter(F.col("listed_at") > new_since), "7 new", "New on this screen: ", "Nothing on screen is new this run.")
        intro = F.concat(F.lit("New means posted since this search last ran, "), since, F.lit('. Those listings are badged "New" and sorted to the top of their property\'s table. '))
        fresh = fresh.withColumn("text", F.concat(intro, "text"))
    else:
        fresh = line("7 new", "No listing is marked new: this search has no earlier run to measure against.")
    order = [F.desc("created_at"), F.col("scope"), F.col("id")]
    entries = [
        _headed(hidden.withColumn("text", entity_text()), "8 hidden", "Hidden items in these results:", "Hidden items in these results: none.", order),
        _headed(always.withColumn("text", entity_text()), "9 always hidden", "Always hidden items in these results, left out of every search rather than only this one:", "Always hidden items in these results: none.", order),
        _headed(bookmarked.withColumn("text", entity_text(False)), "A bookmarked", "Bookmarked properties in these results, pinned to the top in this order:", "Bookmarked properties in these results: none.", order),
    ]
    return report(reduce(DataFrame.union, [done, filters, line("3 saved", saved), screen, property_rows, here, fresh, *entries]))


def _plural(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {many}"))


def last_run(at: Column, now: int) -> Column:
    """Never run, or the day of the last run."""
    return F.when(F.coalesce(at, F.lit(0)) == 0, F.lit("Never run")).otherwise(F.concat(F.lit("Last run "), day_label(at, now, "on ")))


def saved_search_report(saved: DataFrame, readers: DataFrame, key: str, now: int) -> DataFrame:
    """For each reader a line for each of their saved searches (``key``, ``search_id``, ``name``, ``full``, ``hidden``, ``bookmarked``, ``last_run_at``,
    ``created_at``), newest first."""
    text = F.concat(
        F.lit("- "), F.col("name"), F.lit(" (savedSearchId "), F.col("search_id").cast("string"), F.lit("): "), F.col("full"), F.lit(", hiding "), _plural(F.col("hidden"), "item", "items"),
        F.lit(", bookmarking "), _plural(F.col("bookmarked"), "property", "properties"), F.lit(". "), last_run(F.col("last_run_at"), now), F.lit("."),
    )
    return keyed_report(saved.withColumn("text", text), readers, key, F.lit("Saved searches:"), "Saved searches: none.", [F.desc("created_at"), F.col("search_id")])


def shortlist_lines(props: DataFrame, now: int) -> DataFrame:
    """A line for each property of a shortlist: when it was saved, its facts, and its units. ``props``: ``property_key``, ``name``,
    ``found``, ``top_year``, ``tenure``, ``total_units`` and ``shortlisted_at``, and what ``property_lines`` gives of its units."""
    saved = F.concat(F.lit("saved "), day_label(F.col("shortlisted_at"), now, "on "))
    text = F.concat(F.lit("- "), F.col("name"), F.lit(" (propertyId "), F.col("property_key"), F.lit("), "), saved, F.lit(", "), facts(F.col("found"), F.col("top_year"), F.col("tenure"), F.col("total_units")), F.lit(". "), F.col("n").cast("string"), F.lit(" shortlisted units: "), F.col("listed"))
    return props.select("property_key", "shortlisted_at", text.alias("text"))


def always_hidden_report(entities: DataFrame, readers: DataFrame, key: str) -> DataFrame:
    """For each reader the entries that they hide in every search, newest first."""
    title = F.concat(F.lit("Always hidden: "), F.col("n").cast("string"), F.lit(" items, newest first."))
    return keyed_report(entities.withColumn("text", entity_text()), readers, key, title, "Nothing is always hidden.", [F.desc("created_at"), F.col("scope"), F.col("id"), F.col("label")])


def hidden_table(here: DataFrame, always: DataFrame) -> DataFrame:
    """Rows of both lists of hidden entries, each with where it is hidden; an entry in both is there twice."""
    return here.withColumn("hidden_in", F.lit("This search")).unionByName(always.withColumn("hidden_in", F.lit("Every search")))
