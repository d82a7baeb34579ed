"""Text for readers: labels, summaries and reports as ordered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import money


def clauses(*parts: Column) -> Column:
    """The parts that aren't null, joined by commas; a phrase of its own for none."""
    kept = F.array_compact(F.array(*parts))
    return F.when(F.size(kept) == 0, F.lit("no filters set")).otherwise(F.array_join(kept, ", "))


def range_clause(what: str, low: Column, high: Column) -> Column:
    return F.when(low.isNotNull() & high.isNotNull(), F.concat(F.lit(f"{what} "), low.cast("string"), F.lit(" to "), high.cast("string"))).when(low.isNotNull(), F.concat(F.lit(f"{what} from "), low.cast("string"))).when(high.isNotNull(), F.concat(F.lit(f"{what} up to "), high.cast("string")))


def shortened(text: Column, most: int = 60) -> Column:
    """A name of at most ``most`` characters, cut at the last comma where it is longer."""
    head = F.substring(text, 1, most)
    return F.when(F.length(text) <= most, text).otherwise(F.coalesce(F.nullif(F.regexp_extract(head, "^(.+), ", 1), F.lit("")), F.rtrim(head)))


def property_line(name: Column, price_min: Column, unit_count: Column, district: Column) -> Column:
    return F.concat_ws(" | ", name, F.concat(F.lit("from "), money(F.nullif(price_min, F.lit(0)))), F.concat(unit_count.cast("string"), F.when(unit_count == 1, " unit").otherwise(" units")), district)


def report(lines: DataFrame, by: str = "section", order: str = "ord", text: str = "text") -> DataFrame:
    """Ordered lines of each section as one text."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n")
    return lines.groupBy(by).agg(joined.alias(text), F.count("*").alias("lines"))


def count_phrases(*counted: tuple[Column, str]) -> Column:
    """Such as "2 items hidden, 1 bookmarked"; the empty string for none."""
    return F.array_join(F.array_compact(F.array(*(F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {what}"))) for n, what in counted))), ", ")


def rejected(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows with the names of the rules that they break (``reasons``); rows that break none are left out."""
    reasons = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    return rows.withColumn("reasons", reasons).filter(F.size("reasons") > 0)


def page_context(now: Column, page: Column, title: Column, purpose: Column, layout: Column, sections: Column, notes: Column, details: Column, actions: Column) -> Column:
    """A page as an assistant reads it. ``actions``: structs of name, description, parameters (a map) and example."""
    lines = F.concat(F.array(F.concat(F.lit("Title: "), title), F.concat(F.lit("Purpose: "), purpose), F.concat(F.lit("Layout: "), layout)), F.transform(sections, lambda s: F.concat(F.lit("- "), s)), F.array(F.concat(F.lit("Notes: "), notes)))
    parameters = lambda a: F.transform(F.map_entries(a["parameters"]), lambda e: F.concat(F.lit("  - "), e["key"], F.lit(": "), e["value"]))
    action = lambda a: F.concat(F.array(F.concat(F.lit("- "), a["name"], F.lit(": "), a["description"])), parameters(a), F.array(F.concat(F.lit("  Example: "), a["example"])))
    head = F.array(F.concat(F.lit("**Current date and time**: "), now), F.lit(""), F.concat(F.lit("**Current page**: "), page), F.lit(""), F.concat(F.lit("**Page description**:\n"), F.array_join(lines, "\n")), F.lit(""), details)
    tail = F.when(F.size(actions) > 0, F.concat(F.array(F.lit(""), F.lit("**Available actions**:")), F.flatten(F.transform(actions, action)))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(head, tail), "\n")
