"""Filter interaction audit: what each filter of a set removes, after any selection and in any order of the others.

All orders of the filters form a trie whose node after a prefix depends only on the *set* of the filters in it. The trie is
walked depth first: a node's survivors are a persisted DataFrame, every filter that is left is applied to them and what it
removes is counted by part, and the child's survivors are made from the parent's. A set that another path has reached
already isn't walked again, so n filters take 2^n nodes instead of n! leaves, and only one path of survivors (n + 1
DataFrames) is persisted at any time. The counts of the edges go to a table; all reports are read from it.
"""

from __future__ import annotations

import itertools
import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, persist_table, scratch_dir

#: Words are runs of other characters than these, and filter D looks for any of the symbols.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#$%&*|]"
#: Fixed values of the filters: least words, least share of distinct words and most capitals, in hundredths.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2


def text_conditions(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a text that isn't null, by name. ``words`` in the result is an input of A and B."""
    words = F.array_remove(F.split(text, SPACE), "")
    return {
        "words": words,
        "A": F.size("words") < LEAST_WORDS,
        "B": F.size(F.array_distinct("words")) * 100 < F.size("words") * LEAST_DISTINCT,
        "C": F.length(F.regexp_replace(text, "[^A-Z]+", "")) * 100 > F.length(text) * MOST_CAPITALS,
        "D": text.rlike(SYMBOLS),
    }


def judged_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> tuple[DataFrame, str]:
    """A stored table with a row for each row of ``docs`` and its folder: ``part``, whether it fails each of ``A`` to ``E``, and
    whether the labels call it ``good`` and ``toxic``.

    A null text is empty, a null part the empty string. ``E``: another row with a smaller id has the same text; a null id is
    neither smaller nor greater than any. Of labels with one id the greatest counts; a document without labels is
    neither good nor toxic. Texts are compared by their SHA-256; one row a text comes back to the join, and large groups of
    copies are split by adaptive execution.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    conditions = text_conditions(F.col("text"))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", conditions.pop("words"))
    narrow, path = persist_table(rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *(c.alias(k) for k, c in conditions.items())))
    # a table of its own, so that both sides of the join are plain exchanges and one text's copies can be split
    several, of_copies = persist_table(narrow.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("digest", "first"))
    marks = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(n) for n, c in (("good", "quality"), ("toxic", "toxic"))))
    out = narrow.join(several, "digest", "left").join(marks, "id", "left")
    out = out.select("part", *conditions, F.coalesce(F.col("id") > F.col("first"), F.lit(False)).alias("E"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    out = persist_table(out)
    for p in (path, of_copies):
        drop_table(docs.sparkSession, p)
    return out


def walk_edges(rows: DataFrame, filters: list[str], losses: list[str], into: str, part_col: str = "part") -> list[int]:
    """Walk the trie over ``rows``, whose boolean columns ``filters`` say that a row fails one; the counts of each node go to the
    folder ``into``: ``part``, ``state`` (bits of the filters applied before), ``n`` (survivors) and for each filter that is left what it
    removes (``removed_f``) and how much of it has each of ``losses``. Returns the states in the order of the walk."""
    seen: list[int] = []

    def visit(state: int, survivors: DataFrame) -> None:
        seen.append(state)
        left = [k for k in range(len(filters)) if not state >> k & 1]
        if not left:
            return
        survivors.persist(StorageLevel.MEMORY_AND_DISK)
        counts = [F.count(F.lit(1)).alias("n")]
        for k in left:
            fails = F.col(filters[k])
            counts += [F.count_if(fails).alias(f"removed_{k}"), *(F.count_if(fails & F.col(c)).alias(f"{c}_{k}") for c in losses)]
        survivors.groupBy(part_col).agg(*counts).withColumn("state", F.lit(state)).write.mode("append").parquet(into)
        for k in left:
            if (after := state | 1 << k) not in seen:
                visit(after, survivors.filter(~F.col(filters[k])))
        survivors.unpersist()

    visit(0, rows)
    return seen


def report_orders(edges: DataFrame, filters: list[str], losses: list[str], part_col: str = "part") -> DataFrame:
    """Per part, order of the filters and step: ``kept``, ``removed``, ``redundant`` (fails the filter, removed earlier),
    ``unique_fails`` (fails no other filter), a ``<loss>_lost`` for each of ``losses``, and ``shapley``, what the filter removes summed over
    all orders. Everything is looked up in the counts of the edges; a part has at most 2^n - 1 of these."""
    n = len(filters)
    whole = (1 << n) - 1
    bits = range(n)
    names = ["removed", *losses]
    counts = F.struct(F.col("n"), *(F.array(*(F.coalesce(F.col(f"{x}_{k}"), F.lit(0)) for k in bits)).alias(x) for x in names))
    by_part = edges.groupBy(part_col).agg(F.map_from_entries(F.collect_list(F.struct("state", counts.alias("c")))).alias("at"))
    count = lambda state, x, k: F.coalesce(F.col("at")[state][x][k], F.lit(0))
    # of n! orders, as many have the set of bits before filter k as there are orders of the set times orders of the rest
    ways = lambda s: math.factorial(s.bit_count()) * math.factorial(n - 1 - s.bit_count())
    sums = [sum(count(F.lit(s), "removed", F.lit(k)) * ways(s) for s in range(whole) if not s >> k & 1) for k in bits]
    per_filter = F.array(*(F.struct(count(F.lit(0), "removed", F.lit(k)).alias("fails"), count(F.lit(whole ^ 1 << k), "removed", F.lit(k)).alias("alone"), sums[k].cast("bigint").alias("shapley")) for k in bits))
    steps = [(o, s + 1, sum(1 << k for k in o[:s]), o[s]) for o in itertools.permutations(bits) for s in bits]
    grid = F.array(*(F.struct(F.lit("".join(filters[k] for k in o)).alias("filter_order"), F.lit(s).alias("step"), F.lit(state).alias("state"), F.lit(k).alias("k")) for o, s, state, k in steps))
    wide = by_part.withColumn("own", per_filter).select("*", F.explode(grid).alias("g"))
    state, k, own = F.col("g.state"), F.col("g.k"), F.col("own")[F.col("g.k")]
    removed = count(state, "removed", k)
    return wide.select(
        F.col(part_col).alias("part"), "g.filter_order", "g.step",
        (F.coalesce(F.col("at")[state]["n"], F.lit(0)) - removed).alias("kept"), removed.alias("removed"), (own["fails"] - removed).alias("redundant"), own["alone"].alias("unique_fails"),
        *(count(state, x, k).alias(f"{x}_lost") for x in losses), own["shapley"].alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Per value of ``part_col``, order of the filters A to E and step: what the step's filter does (see ``report_orders``; zeros
    included).

    Nulls, repeated rows and ids: see ``judged_documents``; an empty text is a text like any other (it fails A only, and E if a smaller id
    has one); an empty table has no parts, hence no rows; further columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    rows, path = judged_documents(docs, labels, id_col, text_col, part_col)
    filters, losses, into = list("ABCDE"), ["good", "toxic"], scratch_dir(spark)
    walk_edges(rows, filters, losses, into)
    drop_table(spark, path)
    columns = ", ".join(f"{x}_{k} bigint" for k in range(len(filters)) for x in ["removed", *losses])
    return report_orders(spark.read.schema(f"part string, n bigint, state int, {columns}").parquet(into), filters, losses)
