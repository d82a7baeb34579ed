"""Ranks, running sums, previous values and medians of groups of any size equal those of a window, and no group is one task."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lotwise.operators import spread as P


@pytest.fixture(scope="module")
def rows(spark):
    """Half of all rows have one key, some none; values repeat and are missing."""
    rnd = random.Random(4)
    data = [(rnd.choice(("hot", "hot", "hot", None, "a", f"k{i % 40}")), rnd.choice((None, 0, 1, 1, 5, rnd.randrange(1000))), i, rnd.choice((None, "x", "y"))) for i in range(4000)]
    return spark.createDataFrame(data, "k string, v bigint, id bigint, w string").repartition(5)


def order():
    return [F.col("v").asc_nulls_last(), F.col("id")]


def same(got, want):
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


@pytest.mark.parametrize("partitions", [1, 7, 300])
def test_ranks_and_sums_are_those_of_a_window(spark, rows, partitions):
    w = Window.partitionBy("k").orderBy(*order())
    same(P.ranked(rows, ["k"], order(), "n", partitions).select("k", "id", "n"), rows.select("k", "id", F.row_number().over(w).cast("bigint").alias("n")))
    amount = F.coalesce("v", F.lit(2))
    same(P.running_sum(rows, ["k"], order(), amount, "s", partitions).select("id", "s"), rows.select("id", F.sum(amount).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s")))


@pytest.mark.parametrize("partitions", [1, 7, 300])
def test_previous_values_are_those_of_a_window(spark, rows, partitions):
    w = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    same(P.previous(rows, ["k"], ["id"], F.col("w"), "p", partitions).select("id", "p"), rows.select("id", F.last("w", True).over(w).alias("p")))


@pytest.mark.parametrize("partitions", [1, 7])
def test_medians_are_exact(spark, rows, partitions):
    want = rows.groupBy("k").agg(F.bround(F.expr("percentile(nullif(v, 0), 0.5)")).cast("bigint").alias("m"))
    same(P.medians(rows, ["k"], F.nullif("v", F.lit(0)), "m", partitions).select("k", "m"), want)
    same(P.medians(rows.withColumn("one", F.lit(1)), ["one"], F.col("v"), "m", partitions), rows.groupBy(F.lit(1).alias("one")).agg(F.bround(F.expr("percentile(v, 0.5)")).cast("bigint").alias("m")))
    none = rows.filter("id < 0")
    assert P.medians(none, ["k"], F.col("v"), "m").count() == 0 and P.ranked(none, ["k"], order(), "n").count() == 0


def test_a_hot_key_is_spread_over_all_tasks(spark, rows):
    ranged = P.in_ranges(rows, ["k"], order(), 20)
    sizes = {r["__part"]: r.n for r in ranged.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    of_hot = ranged.filter("k = 'hot'").select("__part").distinct().count()
    assert max(sizes.values()) < 4000 / 20 * 3 and of_hot >= 9


@pytest.mark.parametrize("partitions", [1, 7, 300])
def test_two_places_come_from_one_set_of_ranges(spark, rows, partitions, monkeypatch):
    made, make = [], P.in_ranges
    monkeypatch.setattr(P, "in_ranges", lambda *a: made.append(1) or make(*a))
    one, two = Window.partitionBy("k").orderBy(*order()), Window.partitionBy("k", "w").orderBy(*order())
    got = P.ranked_within(rows, ["k"], "w", order(), ("a", "b"), partitions)
    same(got.select("id", "a", "b"), rows.select("id", F.row_number().over(one).alias("a"), F.row_number().over(two).alias("b")))
    assert made == [1]
