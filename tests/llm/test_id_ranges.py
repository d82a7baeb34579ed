"""Cuts of ids into ranges: what comes to the driver is bounded, and ranges are even, also where ids and rows repeat."""

import random

import pytest

from lotwise.llm import fingerprints


@pytest.mark.parametrize("hot", [0.0, 0.4, 1.0])
def test_ranges_are_even_from_few_picked_rows(spark, monkeypatch, hot):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 2000)
    rnd = random.Random(1)
    rows = [(7 if rnd.random() < hot else rnd.randrange(10**6), rnd.getrandbits(62), "x" * 10) for _ in range(20_000)]
    keyed = spark.createDataFrame(rows, "key bigint, tie bigint, text string").repartition(4)
    bounds = fingerprints.id_ranges(keyed, "key", "tie", "text")
    assert len(bounds) == 99 and bounds == sorted(bounds)
    sizes = [r["count"] for r in fingerprints.with_range(keyed, "key", "tie", bounds).groupBy("range").count().collect()]
    assert max(sizes) < 20_000 / 100 * 2.5


def test_repeated_rows_come_counted(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 2000)
    keyed = spark.createDataFrame([(5, 1, "x" * 10)] * 5000 + [(i, i, "x" * 10) for i in range(5000)], "key bigint, tie bigint, text string")
    seen = []
    real = fingerprints.F.count
    monkeypatch.setattr(fingerprints.F, "count", lambda c: seen.append(c) or real(c))
    bounds = fingerprints.id_ranges(keyed, "key", "tie", "text")
    assert len(bounds) == 49 and bounds == sorted(bounds) and len(seen) == 2
