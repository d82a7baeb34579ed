"""Ranks, running sums, previous values and medians of groups of any size, none of which is one task.

Rows are put in ranges of (key, order), so a large group lies in several ranges. Each range is summed up for each of its keys, these few sums are added up
along the ranges of a key, and every row gets what came before its range and what came before it inside. The ranges are stored, so that both passes see the
same ones. The order has to be total for a fixed result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import half_even
from ..sources.sinks import scratch

_PART, _VALUE = "__part", "__value"


def in_ranges(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], partitions: int | None = None) -> DataFrame:
    """The rows with the number of their range (``__part``), stored."""
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{scratch(spark)}/ranges"
    rows.repartitionByRange(n, *keys, *order).withColumn(_PART, F.spark_partition_id()).write.parquet(path)
    return spark.read.parquet(path)


def _with_parts(ranged: DataFrame, parts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The rows with ``value`` of their key and range; null keys are keys. Only keys that go on from an earlier range have a value: the first of a range, at
    most, as rows are put in ranges by key first. So ``parts`` goes to all tasks and the rows stay where they are."""
    parts = parts.filter(F.col(value).isNotNull())
    other = parts.select(*(F.col(k).alias(f"__of_{k}") for k in keys), F.col(_PART).alias("__of_part"), value)
    on = F.col(_PART) == F.col("__of_part")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    return ranged.join(F.broadcast(other), on, "left").drop("__of_part", *(f"__of_{k}" for k in keys))


def running_sum(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], amount: Column, name: str, partitions: int | None = None) -> DataFrame:
    """The rows with the sum of ``amount`` over the rows of their key up to them."""
    ranged = in_ranges(rows.withColumn(_VALUE, amount), keys, order, partitions)
    along, inside = Window.partitionBy(*keys).orderBy(_PART), Window.partitionBy(*keys, _PART).orderBy(*order)
    sums = ranged.groupBy(*keys, _PART).agg(F.sum(_VALUE).alias("__sum"))
    before = sums.withColumn("__part_before", F.sum("__sum").over(along.rowsBetween(Window.unboundedPreceding, -1)))
    got = _with_parts(ranged.withColumn("__part_own", F.sum(_VALUE).over(inside.rowsBetween(Window.unboundedPreceding, 0))), before, keys, "__part_before")
    return got.withColumn(name, F.coalesce("__part_before", F.lit(0)) + F.col("__part_own")).drop(_PART, _VALUE, "__part_own", "__part_before")


def ranked(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str, partitions: int | None = None) -> DataFrame:
    """The rows with their place among those of their key, from 1."""
    return running_sum(rows, keys, order, F.lit(1).cast("bigint"), name, partitions)


def ranked_within(rows: DataFrame, keys: Sequence[str], kind: str, order: Sequence[Column | str], names: tuple[str, str], partitions: int | None = None) -> DataFrame:
    """The rows with two places in one order, from 1: among those of their key, and among those of their key and ``kind``. Both come from the same ranges of
    key and order, which are made and stored once. A range goes on with the kinds of one key at most."""
    ranged = in_ranges(rows, keys, order, partitions)
    got = ranged
    for name, of in zip(names, (list(keys), [*keys, kind]), strict=True):
        got = got.withColumn(f"__{name}", F.row_number().over(Window.partitionBy(*of, _PART).orderBy(*order)))
    for name, of in zip(names, (list(keys), [*keys, kind]), strict=True):
        along = Window.partitionBy(*of).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
        before = ranged.groupBy(*of, _PART).agg(F.count("*").alias("__n")).withColumn("__before", F.sum("__n").over(along))
        got = _with_parts(got, before, of, "__before").withColumn(name, F.coalesce("__before", F.lit(0)) + F.col(f"__{name}")).drop("__before", f"__{name}")
    return got.drop(_PART)


def previous(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: Column, name: str, partitions: int | None = None) -> DataFrame:
    """The rows with the last ``value`` that isn't null among the rows of their key before them; null where there is none."""
    ranged = in_ranges(rows.withColumn(_VALUE, value), keys, order, partitions)
    inside, along = Window.partitionBy(*keys, _PART).orderBy(*order), Window.partitionBy(*keys).orderBy(_PART)
    lasts = ranged.withColumn("__at", F.row_number().over(inside)).groupBy(*keys, _PART).agg(F.max_by(_VALUE, F.when(F.col(_VALUE).isNotNull(), F.col("__at"))).alias("__last"))
    before = lasts.withColumn("__part_before", F.last("__last", True).over(along.rowsBetween(Window.unboundedPreceding, -1)))
    own = F.last(_VALUE, True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    got = _with_parts(ranged.withColumn("__part_own", own), before, keys, "__part_before")
    return got.withColumn(name, F.coalesce("__part_own", "__part_before")).drop(_PART, _VALUE, "__part_own", "__part_before")


def medians(rows: DataFrame, keys: Sequence[str], value: Column, name: str, partitions: int | None = None) -> DataFrame:
    """A row a key: the exact median of the values that aren't null, half-even between two middle ones, null without any.

    Equal values are counted first, in the map tasks, so only different ones are put in order; the middle ones are those whose running count reaches the
    middle."""
    counts = rows.select(*keys, value.alias("__v")).groupBy(*keys, "__v").agg(F.count("*").alias("__n"))
    known = counts.filter("__v is not null")
    total = known.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    upto = running_sum(known, keys, ["__v"], F.col("__n"), "__upto", partitions)
    other = total.select(*(F.col(k).alias(f"__of_{k}") for k in keys), "__total")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    placed = upto.join(other, on).drop(*(f"__of_{k}" for k in keys))
    holds = lambda at: (F.col("__upto") >= at) & (F.col("__upto") - F.col("__n") < at)
    low, high = F.floor((F.col("__total") + 1) / 2), F.floor(F.col("__total") / 2) + 1
    middle = placed.groupBy(*keys).agg(F.max(F.when(holds(low), F.col("__v"))).alias("__low"), F.max(F.when(holds(high), F.col("__v"))).alias("__high"))
    every = counts.select(*keys).distinct()
    mine = middle.select(*(F.col(k).alias(f"__of_{k}") for k in keys), half_even((F.col("__low") + F.col("__high")) / 2).alias(name))
    return every.join(mine, on, "left").drop(*(f"__of_{k}" for k in keys))
