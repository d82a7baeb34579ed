"""Bottom-k sketches of word-shingle hashes.

A sketch is the sorted array of the k least distinct shingle hashes of a text. Sketches of parts merge into the sketch of
the whole, and two sketches estimate resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, slices, small_batches, texts_of
from .shingles import shingle_hashes

#: Hashes kept. The standard error of a resemblance J is sqrt(J (1 - J) / K), at most 0.045.
K = 128
#: Text that one task reads, and the most ranges of ids.
RANGE_BYTES, MOST_RANGES = 8 << 20, 1 << 16
#: Rows, picked by a hash, that the cuts of a range are taken from; so the driver gets at most about 1.3 million numbers, whatever the size of the table.
PICKED = 20


def bottom_k(text: str, k: int = K) -> np.ndarray:
    return np.unique(shingle_hashes(text))[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of two parts together."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimate of the shared part of the union; exact where the union has at most ``k`` shingles. Two empty texts: 1."""
    both = merge(a, b, k)
    if not len(both):
        return 1.0
    return float(np.isin(both, a, assume_unique=True).astype(bool)[np.isin(both, b, assume_unique=True)].sum()) / len(both)


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimate of the distinct shingles; exact below ``k``."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimate of the part of a's shingles that b has. An empty a: 1."""
    if not len(a):
        return 1.0
    both = merge(a, b, k)
    shared = resemblance(a, b, k) * distinct(both, k)
    return min(1.0, shared / distinct(a, k))


def written(sketch: np.ndarray) -> str:
    """Sixteen hex digits a hash, ascending; the empty string for no shingles."""
    return sketch.astype(">u8").tobytes().hex()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype(np.uint64)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Per row of ``docs``: the id, its ``fingerprint`` and ``n_shingles`` (estimate of the distinct shingles).

    Null and empty texts have the empty fingerprint; a null id stays null; repeated rows are sketched each; an empty table
    gives no rows; further columns are ignored.
    """

    def sketch(batch):
        found = [bottom_k(t, k) for t in texts_of(batch.column(1))]
        return {"id": batch.column(0), "fingerprint": [written(s) for s in found], "n_shingles": [distinct(s, k) for s in found]}

    id_type = docs.schema[id_col].dataType.simpleString()
    out = map_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), sketch, f"id {id_type}, fingerprint string, n_shingles double")
    return out.withColumnRenamed("id", id_col)


def id_ranges(docs: DataFrame, key: str, tie: str, size_col: str) -> list[int]:
    """Ascending bounds that cut the integer ``key`` into ranges of about RANGE_BYTES; a key that fills several ranges is there
    as often. They are those of PICKED rows a range, picked by a hash of ``key`` and ``tie``: cuts only balance the ranges, so nothing else
    depends on which rows are picked."""
    total, rows = docs.agg(F.coalesce(F.sum(F.octet_length(size_col)), F.lit(0)), F.count("*")).first()
    n = int(min(MOST_RANGES, -(-total // RANGE_BYTES)))
    if n < 2:
        return []
    share = -(-PICKED * n * (1 << 30) // rows)
    # repeated rows are picked together, so they come counted
    picked = docs.filter(F.pmod(F.xxhash64(key, tie), F.lit(1 << 30)) < share).groupBy(key, tie).agg(F.count("*").alias("n")).select(key, "n").toArrow()
    keys, weights = picked.column(0).to_numpy(), picked.column(1).to_numpy()
    order = np.argsort(keys, kind="stable")
    upto = np.cumsum(weights[order])
    return [int(keys[order[np.searchsorted(upto, upto[-1] * i // n, "right")]]) for i in range(1, n)] if len(keys) else []


def with_range(docs: DataFrame, key: str, tie: str, bounds: list[int]) -> DataFrame:
    """Column ``range``, ascending with ``key`` and ``tie``: how many different bounds are at most ``key``, by a search on two
    levels. The rows of a bound that is there several times are dealt over as many ranges by ``tie``, a hash of 63 bits."""
    cuts = sorted(set(bounds))
    if not cuts:
        return docs.withColumn("range", F.lit(0))
    times = Counter(bounds)
    many = [times[c] for c in cuts]
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    heads, rest = F.lit([g[0] for g in groups]), F.array(*[F.lit(g) for g in groups])
    found = docs.withColumn("range", F.size(F.filter(heads, lambda b: b <= F.col(key)))).withColumn(
        "range", F.when(F.col("range") == 0, 0).otherwise((F.col("range") - 1) * step + F.size(F.filter(F.element_at(rest, F.greatest("range", F.lit(1))), lambda b: b <= F.col(key))))
    )
    if max(many) == 1:
        return found
    first, place = [0], F.col("range") + 1
    for m in [1, *many]:
        first.append(first[-1] + m)
    n = F.element_at(F.lit([1, *many]), place)
    share = F.shiftright(F.shiftright(F.col(tie), 32) * n, 31).cast("int")  # of the rows with the bound's own key
    return found.withColumn("range", F.element_at(F.lit(first[:-1]), place) + F.when(F.col(key) == F.element_at(F.lit([cuts[0], *cuts]), place), share).otherwise(n - 1))


def with_next(docs: DataFrame, id_col: str, text_col: str, fn, schema: str) -> DataFrame:
    """``fn(ids, texts, next texts)`` over all rows by ascending integer id; the row after the last is the first.

    Equal ids are ordered by a hash of their texts, a null id comes first. Each row goes to the task of its range of ids and
    hashes; the first row of a range also goes to the range before, so that no task sees more than its range and one row.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    least = -(1 << 63)
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce("id", F.lit(least))).withColumn("tie", F.shiftrightunsigned(F.xxhash64("text"), 1))
    bounds = id_ranges(rows, "key", "tie", "text")
    keyed = with_range(rows, "key", "tie", bounds)
    firsts = sorted((r["range"], r["first"]) for r in keyed.groupBy("range").agg(F.min(F.struct("key", "tie")).alias("first")).collect())  # a row a range
    target = F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("after")))
    if firsts:
        size = len(bounds) + 1
        of = {r: (f["key"], f["tie"], firsts[i - 1][0]) for i, (r, f) in enumerate(firsts)}
        column = lambda k, none: F.element_at(F.lit([of[r][k] if r in of else none for r in range(size)]), F.col("range") + 1)
        is_first = (F.col("key") == column(0, 0)) & (F.col("tie") == column(1, 0))
        target = F.when(is_first, F.concat(target, F.array(F.struct(column(2, 0).alias("range"), F.lit(1).alias("after"))))).otherwise(target)
    dealt = (
        keyed.withColumn("to", F.explode(target))
        .select("to.range", "to.after", "key", "id", "text", "tie")
        .repartitionById(len(bounds) + 1, F.col("range"))
        .sortWithinPartitions("range", "after", "key", "tie")
        .select("range", "after", "id", "text")
    )
    arrow_schema = to_arrow_schema(StructType.fromDDL(schema))
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for the next one
        for batch in batches:
            for part in slices(batch):
                out = []
                for r, after, i, text in zip(*(part.column(c).to_pylist() for c in range(4)), strict=True):
                    if held is not None and held[0] == r:
                        out.append((held[1], held[2], text))
                    held = None if after else (r, i, text)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for f, c in zip(arrow_schema, fn(*map(list, zip(*out, strict=True))), strict=True)], schema=arrow_schema)

    return dealt.mapInArrow(run, schema)


def edited(text: str, following: str) -> str:
    """The text with its last half, rounded down, replaced by as many of the first code points of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Per row of ``docs`` (integer ids): fingerprints of the text and of its edited text, whose last half comes from the
    next document by ascending id, and the resemblance of the text to the edited and to the next one.

    Null texts are empty; a null id sorts first; rows of one id are ordered by a hash of the text; a table of one row has
    itself as the next; an empty table gives no rows; further columns are ignored.
    """

    def digest(ids, texts, following):
        edits = [edited(a, b) for a, b in zip(texts, following, strict=True)]
        own, changed = [bottom_k(t, k) for t in texts], [bottom_k(t, k) for t in edits]
        after = [*own[1:], bottom_k(following[-1], k)]
        after = [s if n == t else bottom_k(n, k) for s, n, t in zip(after, following, [*texts[1:], following[-1]], strict=True)]
        return (
            ids,
            [len(t) for t in texts],
            [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in edits],
            [written(s) for s in own],
            [written(s) for s in changed],
            [resemblance(a, b, k) for a, b in zip(own, changed, strict=True)],
            [resemblance(a, b, k) for a, b in zip(own, after, strict=True)],
        )

    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, id_col, text_col, digest, schema).withColumnRenamed("doc_id", id_col)
