"""Repeated byte windows by a depth-limited radix sort of suffixes.

Every byte of a text starts a suffix, and suffixes are ordered by their first WINDOW bytes only: the groups that are still equal
then are exactly the repeated windows. The most significant digit of a suffix is its *anchor*: of the runs of ANCHOR bytes inside
its window, the one with the least hash. Neighbouring suffixes mostly share one, so a run of suffixes with one anchor travels as
one piece of text (about 65 bytes for 16 suffixes) to the bucket of the anchor's hash.

1. The texts are stored as slices of about SLICE_BYTES. Of each slice the anchors' hashes, once each, go to buckets, which send
   back which anchors occur in several documents: other suffixes can't have an equal one and leave the sort.
2. The others' pieces go to the buckets, equal pieces of a slice once with the least document. A bucket sorts its suffixes by
   passes of one digit each, first the anchor and its place, then eight bytes at a time, most significant first; a pass
   sorts only groups that are not uniform, and groups of one document leave after each pass.
3. Each slice gets the answers of its pieces, and marks the bytes that windows of smaller documents cover.

An anchor of very many pieces (a line that is in a third of all texts) would fill one bucket with the different
pieces at the line's ends. Pieces of such anchors are cut into single suffixes, whose first digit is a hash of the whole
window, so equal ones come once a slice and all others are spread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import persist_table, slices, small_batches
from .shingles import mixed

#: Bytes of a window and of an anchor.
WINDOW, ANCHOR = 50, 20
#: Text of a slice; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20
#: Buckets: a power of two, one for each BUCKET_BYTES of text within these bounds.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 16 << 20, 1 << 8, 1 << 20
#: Suffixes that a bucket sorts at once.
PART_SUFFIXES = 1 << 19
#: From so many pieces (at most 255 counted a slice) an anchor's pieces are cut into single suffixes.
MANY_PIECES = 2000
#: Stands for a null id, which is smaller than no other.
NO_ID = (1 << 63) - 1
#: Stands for the anchor's place of a single suffix.
SINGLE = 255

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte of ``data`` on as numbers, the first byte most significant; the last seven places see zeros."""
    padded = np.r_[data, np.zeros(8, np.uint8)]
    return np.ndarray(len(data), ">u8", padded.data, strides=(1,))


def digits(words: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """The windows at ``at``, eight bytes at a time, most significant first."""
    for off in (*range(0, WINDOW - 8, 8), WINDOW - 8):
        yield words[at + off].astype(np.uint64)


def window_hash(words: np.ndarray, at: np.ndarray, seed: np.uint64) -> np.ndarray:
    h = np.full(len(at), seed, np.uint64)
    for d in digits(words, at):
        h = (h ^ d) * _A
        h ^= h >> np.uint64(29)
    return mixed(h)


def anchor_hash(eight: list[np.ndarray]) -> np.ndarray:
    """Of runs of ANCHOR bytes, from the eight bytes at their places 0, 8 and ANCHOR - 8."""
    h = eight[0] * _A
    for more, by in zip(eight[1:], (_B, _C), strict=True):
        h ^= h >> np.uint64(32)
        h += more
        h *= by
    return mixed(h)


#: Places of the numbers that an anchor's hash is made of.
PLACES = (0, 8, ANCHOR - 8)


class Pieces:
    """Runs of windows with one anchor: first and last window, the anchor's place and hash, by place."""

    def __init__(self, data: np.ndarray, words: np.ndarray, lengths: np.ndarray):
        n = len(data) - WINDOW + 1
        if n < 1:
            self.first = self.last = self.place = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            return
        eight = words.view("<u8")  # the order of bytes doesn't matter here
        h = anchor_hash([eight[off : off + len(data) - ANCHOR + 1] for off in PLACES])
        # by 32 bits of the hash, then by place, so that the choice depends on nothing but the window's bytes
        least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= WINDOW - ANCHOR + 1:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = WINDOW - ANCHOR + 1 - width
        place = (np.minimum(least[: len(least) - rest], least[rest:]) if rest else least) & np.uint64(0xFFFFFFFF)
        inside = np.repeat(np.cumsum(lengths), lengths)[:n] - np.arange(n) >= WINDOW
        change = np.r_[True, place[1:] != place[:-1]]
        begins = inside & (change | ~np.r_[False, inside[:-1]])
        ends = inside & (np.r_[change[1:], True] | ~np.r_[inside[1:], False])
        self.first, self.last = np.flatnonzero(begins), np.flatnonzero(ends)
        self.place = place[self.first].astype(np.int64)
        self.hash = h[self.place]


class Slice:
    """A slice's text with its documents by ascending id, and its anchors."""

    def __init__(self, ids: list, lengths: list[int], blob: bytes, bits: int):
        self.ids, self.lengths, self.bits = ids, np.array(lengths, np.int64), bits
        self.data = np.frombuffer(zstandard.decompress(blob), np.uint8)
        self.words = words_at(self.data)
        self.pieces = Pieces(self.data, self.words, self.lengths)
        self.document = np.searchsorted(np.cumsum(self.lengths), self.pieces.first, "right")
        self.id = np.array([NO_ID if i is None else i for i in ids], np.int64)
        # anchors once each, by their first 32 + bits bits: the bucket and the rest
        code = self.pieces.hash >> np.uint64(32 - bits)
        self.codes, self.code = np.unique(code, return_inverse=True)
        self.bucket = (self.codes >> np.uint64(32)).astype(np.int64)

    def anchors(self) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """Per bucket: the rest of each anchor, its pieces (up to 255) and whether they are of several documents."""
        if not len(self.codes):
            return
        count = np.minimum(np.bincount(self.code, minlength=len(self.codes)), 255).astype(np.uint8)
        low, high = np.full(len(self.codes), len(self.ids)), np.zeros(len(self.codes), np.int64)
        np.minimum.at(low, self.code, self.document)
        np.maximum.at(high, self.code, self.document)
        rest = (self.codes & np.uint64(0xFFFFFFFF)).astype("<u4")
        starts = np.flatnonzero(np.r_[True, self.bucket[1:] != self.bucket[:-1]])
        for a, b in zip(starts, [*starts[1:], len(rest)], strict=True):
            yield int(self.bucket[a]), rest[a:b].tobytes(), count[a:b].tobytes(), np.packbits(low[a:b] < high[a:b]).tobytes()

    def items(self, marks: list[dict]) -> Items:
        shared, many = np.zeros(len(self.codes), bool), np.zeros(len(self.codes), bool)
        for m in marks:
            a, b = np.searchsorted(self.bucket, [m["bucket"], m["bucket"] + 1])
            for name, into in (("shared", shared), ("many", many)):
                into[a:b] = np.unpackbits(np.frombuffer(m[name], np.uint8), count=b - a)
        return Items(self, np.flatnonzero(shared[self.code]), many)


class Items:
    """The pieces that are sorted, single suffixes for anchors of many pieces. Equal ones (by 128 bits of hashes) are one item, kept by its
    first piece (that of the least document); items are in the order of their buckets and then of their places."""

    def __init__(self, s: Slice, chosen: np.ndarray, many: np.ndarray):
        p = s.pieces
        single = many[s.code[chosen]]
        whole, cut = chosen[~single], chosen[single]
        n = p.last[cut] - p.first[cut] + 1
        at = np.repeat(p.first[cut], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        first, last = np.r_[p.first[whole], at], np.r_[p.last[whole], at]
        order = np.argsort(first, kind="stable")
        self.first, self.last = first[order], last[order]
        self.document = np.r_[s.document[whole], np.repeat(s.document[cut], n)][order]
        hashes = window_hash(s.words, self.first, _B), window_hash(s.words, self.last, _C)
        is_single = np.r_[np.zeros(len(whole), bool), np.ones(len(at), bool)][order]
        self.offset = np.where(is_single, SINGLE, np.r_[p.place[whole], at][order] - self.first)
        key = np.where(is_single, hashes[0], np.r_[p.hash[whole], np.zeros(len(at), np.uint64)][order])
        bucket = (key >> np.uint64(64 - s.bits)).astype(np.int64)
        # groups of equal pieces; the sort is stable, so each begins with its first piece
        shape = ((self.last - self.first) * 512 + self.offset).astype(np.uint64)
        both = mixed((hashes[0] * _A) ^ mixed(hashes[1] + shape * _C))
        order = np.argsort(both, kind="stable")
        new = np.ones(len(order), bool)
        if len(order):
            new[1:] = False
            for x in (both, hashes[0], hashes[1], shape, bucket):
                x = x[order]
                new[1:] |= x[1:] != x[:-1]
        kept = order[new]
        place = np.lexsort((self.first[kept], bucket[kept]))
        self.kept = kept[place]  # one piece an item
        number = np.empty(len(kept), np.int64)
        number[place] = np.arange(len(kept))
        self.item = np.empty(len(order), np.int64)  # of each piece
        self.item[order] = number[np.cumsum(new) - 1]
        self.bucket = bucket[self.kept]

    def by_bucket(self) -> Iterator[tuple[int, int, int]]:
        """Bucket and range of items."""
        starts = np.flatnonzero(np.r_[True, self.bucket[1:] != self.bucket[:-1]]) if len(self.bucket) else []
        for a, b in zip(starts, [*starts[1:], len(self.bucket)], strict=True):
            yield int(self.bucket[a]), int(a), int(b)


def packed(s: Slice, items: Items, a: int, b: int) -> bytes:
    """The items from a to b: steps between their ids, anchor places, numbers of suffixes, and texts."""
    at = items.kept[a:b]
    n = items.last[at] - items.first[at] + 1
    ids = s.id[items.document[at]]
    text = b"".join(s.data[f : f + k + WINDOW - 1].tobytes() for f, k in zip(items.first[at].tolist(), n.tolist(), strict=True))
    return zstandard.compress(np.diff(ids, prepend=0).astype("<i8").tobytes() + items.offset[at].astype(np.uint8).tobytes() + n.astype(np.uint8).tobytes() + text, 3)


def sort_suffixes(blobs: list[tuple[int, bytes]], most: int = PART_SUFFIXES) -> list[np.ndarray]:
    """For each ``(number of items, packed items)`` of a bucket: which suffixes, in order, are in a smaller document too. Suffixes of one anchor are
    sorted together, and of several anchors about ``most`` at once."""
    ids, offsets, sizes, texts = [], [], [], []
    for m, blob in blobs:
        raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
        ids.append(np.cumsum(raw[: 8 * m].view("<i8")))
        offsets.append(raw[8 * m : 9 * m])
        sizes.append(raw[9 * m : 10 * m])
        texts.append(raw[10 * m :])
    counts = [int(n.sum()) for n in sizes]
    n, ids, offset = np.concatenate(sizes).astype(np.int64), np.concatenate(ids), np.concatenate(offsets).astype(np.int64)
    words = words_at(np.concatenate(texts))
    begin = np.cumsum(n + WINDOW - 1) - (n + WINDOW - 1)
    single = offset == SINGLE
    eight, place = words.view("<u8"), begin + np.where(single, 0, offset)
    key = np.where(single, window_hash(words, begin, _B), anchor_hash([eight[place + off] for off in PLACES]))
    found, at = np.zeros(n.sum(), bool), np.cumsum(n) - n
    parts = -(-len(found) // most)
    part = (mixed(key * _C) % np.uint64(parts)).astype(np.int64)
    for k in range(parts):
        own = np.flatnonzero(part == k) if parts > 1 else np.arange(len(n))
        inner = np.arange(n[own].sum()) - np.repeat(np.cumsum(n[own]) - n[own], n[own])
        digit = np.repeat(key[own], n[own]) + (np.repeat(np.where(single, 0, offset)[own], n[own]) - inner).astype(np.uint64) * _A
        found[np.repeat(at[own], n[own]) + inner] = _sorted_part(words, np.repeat(begin[own], n[own]) + inner, np.repeat(ids[own], n[own]), digit)
    return np.split(found, np.cumsum(counts)[:-1])


def _sorted_part(words: np.ndarray, at: np.ndarray, doc: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """The passes over the suffixes at ``at``: first by the anchor and its place, then by eight bytes each."""
    found = np.zeros(len(at), bool)
    if not len(at):
        return found
    order = np.argsort(anchor, kind="stable")
    new = np.r_[True, anchor[order][1:] != anchor[order][:-1]]

    def several(order, new):
        """Suffixes in groups of several documents, and where groups begin among them."""
        starts = np.flatnonzero(new)
        d = doc[order]
        keep = (np.minimum.reduceat(d, starts) < np.maximum.reduceat(d, starts))[np.cumsum(new) - 1]
        return order[keep], new[keep]

    order, new = several(order, new)
    for off in (*range(0, WINDOW - 8, 8), WINDOW - 8):
        if not len(order):
            break
        digit = words[at[order] + off].astype(np.uint64)
        split = ~new & np.r_[False, digit[1:] != digit[:-1]]
        if not split.any():
            continue
        group = np.cumsum(new) - 1
        uneven = np.zeros(group[-1] + 1, bool)
        uneven[group[split]] = True
        part = np.flatnonzero(uneven[group])
        by_digit = part[np.lexsort((digit[part], group[part]))]
        order[part], digit[part] = order[by_digit], digit[by_digit]
        new |= np.r_[False, digit[1:] != digit[:-1]]
        order, new = several(order, new)
    if len(order):
        d = doc[order]
        found[order] = d > np.minimum.reduceat(d, np.flatnonzero(new))[np.cumsum(new) - 1]
    return found


def removed_bytes(s: Slice, items: Items, answers: list[dict]) -> np.ndarray:
    """Which bytes of a slice windows of smaller documents cover. ``answers`` has the found suffixes of the items by bucket."""
    n = items.last[items.kept] - items.first[items.kept] + 1
    begin = np.cumsum(n) - n
    found = np.zeros(int(n.sum()), bool)
    by_bucket = {b: (x, y) for b, x, y in items.by_bucket()}
    for a in answers:
        x, y = by_bucket[a["bucket"]]
        found[begin[x] : begin[y - 1] + n[y - 1]] = np.unpackbits(np.frombuffer(a["found"], np.uint8), count=int(n[x:y].sum()))
    edges = np.zeros(len(s.data) + WINDOW + 1, np.int32)
    # a piece of a greater id than its item's own is covered wholly, others as the item is
    own, item = s.id[items.document[items.kept]], items.item
    whole = s.id[items.document] > own[item]
    np.add.at(edges, items.first[whole], 1)
    np.add.at(edges, items.last[whole] + WINDOW, -1)
    rest, m = np.flatnonzero(~whole), n[item[~whole]]
    inner = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
    hit = found[np.repeat(begin[item[rest]], m) + inner]
    at = (np.repeat(items.first[rest], m) + inner)[hit]
    np.add.at(edges, at, 1)
    np.add.at(edges, at + WINDOW, -1)
    return np.cumsum(edges)[: len(s.data)] > 0


def _map(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` gives rows (tuples) for each row of ``df``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = list(fn(batch.slice(i, 1).to_pylist()[0]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for f, c in zip(arrow, zip(*rows, strict=True), strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def stored_slices(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A table of slices: ``slice``, ``ids`` (ascending, nulls last), ``lengths`` in bytes, and the compressed ``text``."""
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    small_batches(docs.sparkSession)
    arrow = pa.schema([("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("text", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def give() -> pa.RecordBatch:
            held.sort(key=lambda r: (r[0] is None, r[0] or 0))
            return pa.RecordBatch.from_arrays([pa.array([[r[0] for r in held]], arrow[0].type), pa.array([[len(r[1]) for r in held]], arrow[1].type), pa.array([zstandard.compress(b"".join(r[1] for r in held), 3)], pa.binary())], schema=arrow)

        for batch in batches:
            for part in slices(batch):
                for i, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    if held and size + len(text) > SLICE_BYTES:
                        yield give()
                        held, size = [], 0
                    held.append((i, text))
                    size += len(text)
        if held:
            yield give()

    return persist_table(rows.mapInArrow(run, "ids array<bigint>, lengths array<bigint>, text binary").withColumn("slice", F.monotonically_increasing_id()))[0]


def shared_anchors(table: DataFrame, bits: int) -> DataFrame:
    """Per slice: ``marks``, for each bucket with shared anchors of the slice which ones are in several documents (``shared``) and which
    have many pieces (``many``)."""

    def own(r):
        for bucket, rest, count, several in Slice(r["ids"], r["lengths"], r["text"], bits).anchors():
            yield bucket, r["slice"], rest, count, several

    def decide(t: pa.Table) -> pa.Table:
        rests = [np.frombuffer(x, "<u4") for x in t.column("rest").to_pylist()]
        sizes = [len(x) for x in rests]
        rest, count = np.concatenate(rests), np.concatenate([np.frombuffer(x, np.uint8) for x in t.column("count").to_pylist()]).astype(np.int64)
        several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(t.column("several").to_pylist(), sizes, strict=True)]).astype(bool)
        order = np.argsort(rest, kind="stable")
        new = np.r_[True, rest[order][1:] != rest[order][:-1]]
        starts, group = np.flatnonzero(new), np.cumsum(new) - 1
        shared, many = np.zeros(len(rest), bool), np.zeros(len(rest), bool)
        shared[order] = ((np.diff(np.r_[starts, len(rest)]) > 1) | np.logical_or.reduceat(several[order], starts))[group]
        many[order] = (np.add.reduceat(count[order], starts) >= MANY_PIECES)[group]
        cut = np.cumsum(sizes)[:-1]
        found = [(s, b, np.packbits(x).tobytes(), np.packbits(y).tobytes()) for s, b, x, y in zip(t.column("slice").to_pylist(), t.column("bucket").to_pylist(), np.split(shared, cut), np.split(many, cut), strict=True) if x.any()]
        columns = list(zip(*found, strict=True)) or [[]] * 4
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["slice", "bucket", "shared", "many"])

    anchors = _map(table, own, "bucket bigint, slice bigint, rest binary, count binary, several binary")
    marks = anchors.groupBy("bucket").applyInArrow(decide, "slice bigint, bucket bigint, shared binary, many binary")
    return marks.groupBy("slice").agg(F.collect_list(F.struct("bucket", "shared", "many")).alias("marks"))


def found_suffixes(marked: DataFrame, bits: int) -> DataFrame:
    """Per slice: ``answers``, for each bucket which suffixes of the slice's items are in a smaller document too."""

    def own(r):
        s = Slice(r["ids"], r["lengths"], r["text"], bits)
        items = s.items(r["marks"])
        for bucket, a, b in items.by_bucket():
            yield bucket, r["slice"], b - a, packed(s, items, a, b)

    def decide(t: pa.Table) -> pa.Table:
        found = sort_suffixes(list(zip(t.column("n").to_pylist(), t.column("items").to_pylist(), strict=True)), PART_SUFFIXES)
        rows = [(s, b, np.packbits(x).tobytes()) for s, b, x in zip(t.column("slice").to_pylist(), t.column("bucket").to_pylist(), found, strict=True) if x.any()]
        columns = list(zip(*rows, strict=True)) or [[]] * 3
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["slice", "bucket", "found"])

    pieces = _map(marked, own, "bucket bigint, slice bigint, n int, items binary")
    found = pieces.groupBy("bucket").applyInArrow(decide, "slice bigint, bucket bigint, found binary")
    return found.groupBy("slice").agg(F.collect_list(F.struct("bucket", "found")).alias("answers"))


def remove_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False) -> DataFrame:
    """Per row of ``docs`` (integer ids): the id, ``n_bytes``, ``n_removed``, ``n_spans``, ``spans`` (``start:end`` in bytes, comma-joined) and
    ``kept_sha256`` after removal of each byte covered by a WINDOW-byte string that also starts in a row with a smaller id; with
    ``with_kept`` also the remaining bytes (``kept``; a span may begin or end within a character).

    Null and empty texts have no bytes; texts shorter than a window stay whole; rows of one id don't remove each other's bytes; a null id
    is smaller than none, so such rows lose what any row with an id has; repeated rows are judged each; an empty table gives no rows;
    further columns are ignored.
    """
    table = stored_slices(docs, id_col, text_col)
    total = table.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda x, y: x + y))).first()[0] or 0
    buckets = LEAST_BUCKETS
    while buckets < min(MOST_BUCKETS, total / BUCKET_BYTES):
        buckets *= 2
    bits = buckets.bit_length() - 1
    marks, _ = persist_table(shared_anchors(table, bits))
    marked = table.join(marks, "slice")
    answers, _ = persist_table(found_suffixes(marked, bits))
    id_type = docs.schema[id_col].dataType.simpleString()

    def result(r):
        s = Slice(r["ids"], r["lengths"], r["text"], bits)
        gone = removed_bytes(s, s.items(r["marks"]), r["answers"] or []) if r["marks"] else np.zeros(len(s.data), bool)
        start = 0
        for i, n in zip(r["ids"], r["lengths"], strict=True):
            own, text = gone[start : start + n], s.data[start : start + n]
            edges = np.flatnonzero(np.diff(np.r_[False, own, False])).reshape(-1, 2)
            kept = text[~own].tobytes()
            spans = ",".join(f"{a}:{b}" for a, b in edges.tolist())
            yield (i, n, int(own.sum()), len(edges), spans, hashlib.sha256(kept).hexdigest(), *([kept] if with_kept else []))
            start += n

    out = _map(table.join(marks, "slice", "left").join(answers, "slice", "left"), result, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, spans string, kept_sha256 string" + ", kept binary" * with_kept)
    return out.withColumn("id", F.col("id").cast(id_type)).withColumnRenamed("id", id_col)
