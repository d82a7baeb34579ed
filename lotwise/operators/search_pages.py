"""Searches over result pages: which pages to read of each group, their join with what was fetched, and checks of the result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.pages import card_rows, parsed_pages
from ..sources.tables import shuffled
from .listings import first_by_arrival


def last_page(total: Column, most: Column) -> Column:
    """The last page to read: up to the bound (0: all of them), and at least one where the total isn't known."""
    total = F.coalesce(total, F.lit(0))
    return F.when(F.coalesce(most, F.lit(0)) == 0, F.greatest(total, F.lit(1))).when(total > 0, F.least(most, total)).otherwise(most).cast("bigint")


def truncated(total: Column, last: Column) -> Column:
    return F.coalesce((total > 0) & (total > last), F.lit(False))


def page_targets(groups: DataFrame) -> DataFrame:
    """Rows ``grp``, ``page``, ``last``, ``total``, ``truncated`` of groups with ``total`` pages there and ``most`` wanted."""
    got = groups.withColumn("last", last_page(F.col("total"), F.col("most"))).withColumn("truncated", truncated(F.col("total"), F.col("last")))
    return got.select("grp", F.explode(F.sequence(F.lit(1).cast("bigint"), "last")).alias("page"), "last", "total", "truncated")


def page_problem(found: Column, total: Column, listings_found: Column) -> Column:
    """Why a group's first page can't be used, or null: it isn't there, or it has no listings though there are pages."""
    return F.when(~F.coalesce(found, F.lit(False)), F.lit("no first page")).when((F.coalesce(listings_found, F.lit(0)) == 0) & (F.coalesce(total, F.lit(0)) > 0), F.lit("no listings though there are pages"))


def guarded(rows: DataFrame, problem: Column, what: str = "grp") -> DataFrame:
    """The rows, or an error when the first one with a problem is read: an empty result must not hide a changed page."""
    fail = F.when(problem.isNotNull(), F.raise_error(F.concat_ws(": ", F.col(what), problem)))
    return rows.filter(F.coalesce(fail.cast("boolean"), F.lit(True)))


def fetched_targets(targets: DataFrame, fetched: DataFrame, found: Column, on: Sequence[str] = ("grp", "page")) -> DataFrame:
    """Targets and whether they were fetched (``found``, of the fetched rows); those that weren't are skipped later, not an error. Nothing else of
    the fetched rows goes through the join, which is a shuffle: a row a page is too much for the driver."""
    got = targets.join(shuffled(fetched.select(*on, found.alias("__found"))), list(on), "left")
    return got.withColumn("found", F.coalesce("__found", F.lit(False))).drop("__found")


def scan_totals(targets: DataFrame) -> DataFrame:
    """One row over all groups: pages to read, pages scanned, pages there, and whether any group was cut short."""
    groups = targets.groupBy("grp").agg(F.max("last").alias("last"), F.max("total").alias("total"), F.bool_or("truncated").alias("truncated"), F.count_if("found").alias("scanned"))
    return groups.agg(F.coalesce(F.sum("last"), F.lit(0)).alias("pages_total"), F.coalesce(F.sum("scanned"), F.lit(0)).alias("pages_scanned"), F.coalesce(F.sum("total"), F.lit(0)).alias("total_pages"), F.coalesce(F.bool_or("truncated"), F.lit(False)).alias("truncated"))


def search_scan(wanted: DataFrame, fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Listings of a search and its totals.

    ``wanted``: ``grp``, ``most`` (pages; 0: all) and ``place`` (the group's turn). ``fetched``: ``grp``, ``page`` and ``html``.
    A group without its first page, or whose first page has no listings while there are pages, is an error; a later page
    that is missing is skipped. The first occurrence of a listing counts, by group, page and place on the page."""
    return scan_parsed(wanted, parsed_pages(fetched, ("grp", "page")))


def scan_parsed(wanted: DataFrame, parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same over pages that are parsed already (``parsed_pages``), stored where they are read several times."""
    first = wanted.join(parsed.filter("page = 1").select("grp", "found", "total", F.size("cards").alias("n")), "grp", "left")
    first = guarded(first, page_problem(F.col("found"), F.col("total"), F.col("n")))
    targets = fetched_targets(page_targets(first.select("grp", "most", "total")), parsed, F.col("found"))
    # the targets of a group are its pages up to the last one: a bound by group instead of a join by page; a row a group goes to all tasks,
    # as a shuffle by group would put all cards in as many tasks as there are groups
    asked = first.select(F.col("grp").alias("search"), "place", last_page(F.col("total"), F.col("most")).alias("__last"))
    cards = card_rows(parsed.filter("found").withColumnRenamed("grp", "search"), ("search", "page"))
    rows = cards.join(F.broadcast(asked), "search").filter("page <= __last and page >= 1").drop("__last")
    rows = rows.withColumn("grp", F.coalesce(F.nullif("grp", F.lit("")), "search"))
    return first_by_arrival(rows, ["listing_id"], ["place", "page", "pos"]), scan_totals(targets)
