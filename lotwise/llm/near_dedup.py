"""Near-duplicate classes by DartMinHash signatures of weighted word shingles.

A text is a weighted set: its five-word shingles, each with its number of occurrences. Every unit square of the plane
weight x rank of an element holds a Poisson number of darts that only the element's hash decides; the darts below the
element's weight are the text's. Each dart has one of the signature's coordinates, and the earliest dart (least rank) of
a coordinate is its value, so two texts agree there with the probability of their weighted Jaccard similarity. Bands of
coordinates are joined; each candidate pair is then checked exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, free_name, map_rows, persist_table, small_batches, texts_of
from .shingles import WIDTH, WORDS, mixed, shingle_hashes

#: Bands of ROWS coordinates: a pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8^5)^25 = 0.99995.
BANDS, ROWS = 25, 5
SIMILARITY = 0.8
#: Masks that choose the pivot of a bucket, by band; an exclusive or is one to one, so a minimum of masked ids tells the id.
MASKS = (0, 0x2A5C96B1D37E, 0x15D3E8A64B29, 0x36E9174DA8C5)
#: Members and set elements that one side of a block of the complete comparison holds on average; they bound its memory.
BLOCK, BLOCK_ELEMENTS = 1024, 2_000_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Distribution of a Poisson variable of mean 1, over 64-bit hashes.
_POISSON = np.array([int(min(1.0, math.exp(-1) * sum(1 / math.factorial(j) for j in range(n + 1))) * (2**64 - 1)) for n in range(16)], dtype=np.uint64)


def dart_signature(elements: np.ndarray, weights: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    """Signature of ``k`` 64-bit values of a weighted set (distinct hashes, positive weights); empty for an empty set."""
    if not len(elements):
        return np.zeros(0, np.uint64)
    cells = np.ceil(weights).astype(np.int64)
    owner = np.repeat(np.arange(len(elements)), cells)
    column = np.arange(len(owner)) - np.repeat(np.cumsum(cells) - cells, cells)  # the square along the weight axis
    base = mixed(elements[owner] + (column.astype(np.uint64) + np.uint64(1)) * _GOLD)
    room = weights[owner] - column  # what the weight leaves of the square: all of it but in the last one
    partial = bool((room < 1).any())
    signature, found = np.zeros(k, np.uint64), np.zeros(k, bool)
    low, high = 0, max(1, math.ceil(k * (math.log(k) + 4) / float(weights.sum())))
    while True:
        rank = np.arange(low, high, dtype=np.uint64)
        square = mixed(base[:, None] ^ mixed((rank + np.uint64(1)) * _GOLD)[None, :]).ravel()
        darts = np.searchsorted(_POISSON, square)
        which = np.repeat(np.arange(len(square)), darts)
        turn = np.arange(len(which)) - np.repeat(np.cumsum(darts) - darts, darts)
        dart = mixed(square[which] + (turn.astype(np.uint64) + np.uint64(1)) * _GOLD)
        more = mixed(dart + _GOLD)
        if partial:
            inside = (more & np.uint64(0xFFFFFFFF)) / 2.0**32 < room[which // (high - low)]
            which, dart, more = which[inside], dart[inside], more[inside]
        at = (which % (high - low) + low) + (dart >> np.uint64(11)) / 2.0**53
        coordinate = ((more >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(-at, kind="stable")  # the earliest dart of a coordinate is written last
        order = order[~found[coordinate[order]]]
        signature[coordinate[order]] = dart[order]
        found[coordinate] = True
        if found.all():
            return signature
        low, high = high, 2 * high


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One hash for each band of a signature, different between bands."""
    if not len(signature):
        return np.zeros(0, np.int64)
    h = (np.arange(bands, dtype=np.uint64) + np.uint64(1)) * _GOLD
    for row in signature.reshape(bands, -1).T:
        h = mixed(h ^ row) + _GOLD
    return mixed(h).view(np.int64)


def shingle_weights(text: str, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    elements, counts = np.unique(shingle_hashes(text, width), return_counts=True)
    return elements, counts.astype(float)


def occurrences(text: str, width: int = WIDTH) -> np.ndarray:
    """A set whose Jaccard similarity is the weighted one of the shingles: each occurrence of a shingle is an element."""
    h = np.sort(shingle_hashes(text, width))
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    turn = np.arange(len(h)) - np.repeat(first, np.diff(np.r_[first, len(h)]))
    return np.unique(mixed(h + turn.astype(np.uint64) * _GOLD).view(np.int64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if len(a) + len(b) == 0:
        return 1.0
    both = np.sort(np.concatenate([a, b]))
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def content_key(text: str) -> tuple[int, int]:
    """128 bits that equal texts share: of the words in lower case, or of the text itself where it has no word."""
    words = WORDS(text.lower())
    h = xxhash.xxh3_128_intdigest((" ".join(words) if words else "\0" + text).encode("utf-8"))
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def sketch_documents(rows: DataFrame) -> DataFrame:
    """``id``, the content key (``k1``, ``k2``) and the ``bands`` of each row of (``id``, ``text``)."""

    def sketch(batch):
        texts = texts_of(batch.column(1))
        keys = [content_key(t) for t in texts]
        bands = [band_keys(dart_signature(*shingle_weights(t))) for t in texts]
        return {"id": batch.column(0), "k1": [a for a, _ in keys], "k2": [b for _, b in keys], "bands": bands}

    return map_rows(rows, sketch, "id bigint, k1 bigint, k2 bigint, bands array<bigint>")


def stored_sets(pairs: DataFrame, rows: DataFrame) -> tuple[DataFrame, str]:
    """``id`` and ``set`` (the occurrences of its shingles) of each id of ``pairs``, as a stored table."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()

    def shingle(batch):
        return {"id": batch.column(0), "set": [occurrences(t) for t in texts_of(batch.column(1))]}

    # the ids grow with the documents, so this join must not turn into a broadcast at some sizes
    return persist_table(map_rows(rows.join(ids.hint("merge"), "id", "left_semi"), shingle, "id bigint, set array<bigint>"))


def verified_links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (``a``, ``b``) whose exact weighted Jaccard similarity is at least ``similarity``."""

    def compare(batch):
        one, two = batch.column(2), batch.column(3)
        near = [jaccard(x.values.to_numpy(), y.values.to_numpy()) >= similarity for x, y in zip(one, two, strict=True)]
        return {"a": batch.column(0).filter(near), "b": batch.column(1).filter(near)}

    left, right = sets.select(F.col("id").alias("a"), F.col("set").alias("one")), sets.select(F.col("id").alias("b"), F.col("set").alias("two"))
    return map_rows(pairs.join(left, "a").join(right, "b").select("a", "b", "one", "two"), compare, "a bigint, b bigint")


def similar_labels(rows: list[tuple[int, int, np.ndarray]], similarity: float) -> set[tuple[int, int]]:
    """Pairs of different labels (less, greater) of which some sets have at least the Jaccard ``similarity``.

    Rows are side, label and set. Rows of two sides are compared across; rows of one side with each other."""
    rows = sorted((r for r in rows if len(r[2])), key=lambda r: len(r[2]))
    if not rows:
        return set()
    sides = {r[0] for r in rows}
    left = [r for r in rows if r[0] == min(sides)]
    right = [r for r in rows if r[0] == max(sides)]
    label, size = np.array([r[1] for r in right]), np.array([len(r[2]) for r in right])
    elements, codes = np.unique(np.concatenate([r[2] for r in right]), return_inverse=True)
    starts, marked, found = np.r_[0, np.cumsum(size)], np.zeros(len(elements), bool), set()
    for k, (_, own, x) in enumerate(left):
        low = max(int(np.searchsorted(size, math.floor(similarity * len(x)))), k + 1 if len(sides) == 1 else 0)
        high = int(np.searchsorted(size, math.ceil(len(x) / similarity), "right"))  # sets of other sizes can't reach it
        if low >= high:
            continue
        at = np.minimum(np.searchsorted(elements, x), len(elements) - 1)
        at = at[elements[at] == x]
        marked[at] = True
        shared = np.add.reduceat(marked[codes[starts[low] : starts[high]]], starts[low:high] - starts[low], dtype=np.int64)
        marked[at] = False
        near = (shared / (size[low:high] + len(x) - shared) >= similarity) & (label[low:high] != own)
        found.update((min(own, other), max(own, other)) for other in np.unique(label[low:high][near]).tolist())
    return found


def unmet_links(met: DataFrame, sets: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """Pairs of labels (``a``, ``b``) that similar texts of one bucket link, over all pairs of a bucket whose labels differ.

    Up to three members have all met as pivots, and a bucket of one label is settled. Of what is left, equal buckets are
    taken once. Members are dealt into blocks by hash, and a task compares two blocks completely."""
    spark = met.sparkSession
    # all of these grow with the documents, so the joins must not turn into broadcasts at some sizes
    nodes = sets.join(labels.select(F.col("node").alias("id"), "label").hint("merge"), "id", "left").select("id", "set", F.coalesce("label", "id").alias("label"))
    many = met.filter("n > 3").select("id", "bucket").distinct()
    known = many.join(nodes.select("id", "label", F.size("set").alias("size")).hint("merge"), "id")
    same = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("ids"), F.min("id").alias("first"), F.max("id").alias("last")]
    unsettled = known.groupBy("bucket").agg(*same, F.min("label").alias("low"), F.max("label").alias("high"), F.sum("size").alias("elements")).filter("low < high")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("elements") / BLOCK_ELEMENTS)).cast("int")
    unsettled = unsettled.groupBy("n", "ids", "first", "last").agg(F.min(F.struct("bucket", blocks.alias("blocks"))).alias("one")).select("one.*")
    members = many.join(unsettled.hint("merge"), "bucket").withColumn("side", F.pmod(F.xxhash64("id", "bucket"), F.col("blocks")).cast("int"))
    members = members.select("id", "bucket", "side", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    dealt = members.join(nodes.hint("merge"), "id").select("bucket", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "label", "set")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, found = None, [], set()
        for batch in batches:
            for bucket, i, j, side, label, x in zip(*(c.to_pylist() for c in batch.columns[:5]), batch.column(5), strict=True):
                if (bucket, i, j) != key:
                    found |= compared(key, held)
                    key, held = (bucket, i, j), []
                held.append((side, label, x.values.to_numpy()))
            yield pairs_batch(found)
            found = set()
        yield pairs_batch(compared(key, held))

    def compared(key, held):
        # a block may be empty; then there is nothing across
        return similar_labels(held, similarity) if key and (key[1] == key[2] or len({r[0] for r in held}) == 2) else set()

    def pairs_batch(found):
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    small_batches(spark)
    # the work grows with the pairs, not with the bytes, so small partitions stay apart
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(compare, "a bigint, b bigint").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and the least node it is linked with (``label``), over a stored table of links (``a``, ``b``).

    Rounds of the least label among neighbours and of the label's own label; stars, which the buckets make, take two or
    three rounds, and a chain takes about the logarithm of its length."""
    spark = links.sparkSession
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a"))
    labels, path = persist_table(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("seen")), "other").groupBy("node").agg(F.min("seen").alias("seen"))
        step = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "seen").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        jump = step.join(up, "label", "left").select("node", "was", F.least("label", F.coalesce("top", "label")).alias("label"))
        new, new_path = persist_table(jump)
        done = new.filter("was <> label").isEmpty()
        drop_table(spark, path)
        labels, path = new.select("node", "label"), new_path
        if done:
            return labels


def classes_of(rows: DataFrame, sketches: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``id``, ``class_id`` (the least id of the class) and ``copies`` of ``rows`` (``id``, ``text``) with ids that are all
    different; ``sketches`` is their stored table of sketches.

    Rows with the same words in the same order are copies and share one node. Within every bucket of a band, all nodes are
    checked against two pivots, which differ between four sets of bands, and links are closed transitively. Buckets that
    still hold several classes are then compared completely, so two similar texts are in one class whenever they share a
    bucket."""
    spark = rows.sparkSession
    copies, _ = persist_table(sketches.groupBy("k1", "k2").agg(F.min("id").alias("node"), F.count("*").alias("copies")))
    buckets = sketches.join(copies.select(F.col("node").alias("id")), "id", "left_semi").select("id", F.posexplode("bands").alias("band", "bucket"))
    mask = F.element_at(F.lit(list(MASKS)), F.col("band") % len(MASKS) + 1)
    buckets = buckets.select("id", "bucket", mask.alias("mask")).withColumn("masked", F.col("id").bitwiseXOR(F.col("mask")))
    least = buckets.groupBy("bucket").agg(F.min("masked").alias("least"), F.max("masked").alias("most"), F.count("*").alias("n")).filter("least < most")
    pivots = F.array(F.col("least").bitwiseXOR(F.col("mask")), F.col("most").bitwiseXOR(F.col("mask")))
    met, met_path = persist_table(buckets.join(least, "bucket").select("id", "bucket", "n", pivots.alias("pivots")))
    apart = met.select("id", F.explode("pivots").alias("pivot")).filter("pivot <> id")
    pairs, pairs_path = persist_table(apart.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct())
    sets, sets_path = stored_sets(pairs, rows)
    links, links_path = persist_table(verified_links(pairs, sets, similarity))
    labels = components(links)
    more, more_path = persist_table(unmet_links(met, sets, labels, similarity))
    for path in (met_path, pairs_path, sets_path, links_path):
        drop_table(spark, path)
    found = sketches.select("id", "k1", "k2").join(copies, ["k1", "k2"]).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    if more.isEmpty():
        drop_table(spark, more_path)
    else:
        tops = components(more).select(F.col("node").alias("label"), F.col("label").alias("top"))
        found = found.join(tops.hint("merge"), "label", "left").withColumn("label", F.coalesce("top", "label"))
    return found.select("id", F.col("label").alias("class_id"), "copies")


def _different_ids(sketches: DataFrame) -> bool:
    return sketches.filter("id is null").isEmpty() and sketches.groupBy("id").count().filter("count > 1").isEmpty()


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Per row of ``docs``: the id, ``class_id`` (the least id of its class, null where no row of it has one) and ``copies``
    (rows with the same words in the same order).

    Two texts whose five-word shingles have at least ``similarity`` (weighted Jaccard, checked exactly) are in one class if
    they share a bucket. Work is linear in the rows for a group of copies or near copies of any size; it is quadratic in a
    bucket whose members are alike but below ``similarity``.

    Texts without any word are copies only of equal texts; null texts are empty. Rows are compared by their texts: those of
    one id, or without an id, are rows like any other, with a class each. An empty table gives no rows; further columns are
    ignored. Ids are integers.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    sketches, path = persist_table(sketch_documents(rows))
    if _different_ids(sketches):
        return classes_of(rows, sketches, similarity).withColumnRenamed("id", id_col)
    drop_table(docs.sparkSession, path)
    numbered, _ = persist_table(rows.withColumn("row", F.monotonically_increasing_id()))
    plain = numbered.select(F.col("row").alias("id"), "text")
    classes, _ = persist_table(classes_of(plain, persist_table(sketch_documents(plain))[0], similarity))
    joined = classes.join(numbered.select(F.col("row"), F.col("id").alias("own")).hint("merge"), F.col("id") == F.col("row"))
    least = joined.groupBy("class_id").agg(F.min("own").alias("least"))
    return joined.join(least.hint("merge"), "class_id").select(F.col("own").alias(id_col), F.col("least").alias("class_id"), "copies")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` of each class of near duplicates, with its columns as they are, whatever their names.

    It is the row with the least id; a row without an id stays only where no row of its class has one. Among rows of one id
    in one class, the least hash of the text, and then of the row as JSON, decides. Rows of one id whose texts differ are
    in different classes and all stay. Null and empty texts are one class; an empty table stays empty.
    """
    id_name, text_name = f"`{id_col}`", f"`{text_col}`"
    rows = docs.select(F.col(id_name).cast("bigint").alias("id"), F.col(text_name).alias("text"))
    sketches, path = persist_table(sketch_documents(rows))
    # what is joined below grows with the documents, so the joins must not turn into broadcasts at some sizes
    if _different_ids(sketches):
        gone = classes_of(rows, sketches, similarity).filter("class_id <> id").select(F.col("id").alias(free_name(docs, "gone")))
        return docs.join(gone.hint("merge"), docs[id_name].cast("bigint") == gone[gone.columns[0]], "left_anti")
    drop_table(docs.sparkSession, path)
    row = free_name(docs, "row")
    numbered, _ = persist_table(docs.withColumn(row, F.monotonically_increasing_id()))
    plain = numbered.select(F.col(row).alias("id"), F.col(text_name).alias("text"))
    classes = classes_of(plain, persist_table(sketch_documents(plain))[0], similarity).select("id", "class_id")
    own = F.col(id_name).cast("bigint")
    order = F.struct(own.isNull(), own, F.xxhash64(text_name), F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns)))), F.col(row))
    ranked = numbered.select(F.col(row).alias("number"), order.alias("order")).join(classes.hint("merge"), F.col("number") == F.col("id"))
    kept = ranked.groupBy("class_id").agg(F.min_by("number", "order").alias(f"{row}_"))
    return numbered.join(kept.hint("merge"), F.col(row) == F.col(f"{row}_"), "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
