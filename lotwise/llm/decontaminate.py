"""Benchmark decontamination by the q-gram lemma.

A region of n characters that differs from a benchmark passage by at most e edits shares at least n + 1 - q (e + 1) of its
q-grams with it, all on diagonals (document position minus item position) at most e apart. So shared q-grams are counted
in overlapping bands of diagonals; where a stretch of an item reaches the count that a region of that length needs, the
band is retained together with the places where such a region can start. There a banded local alignment finds whole
copies, and what it rejects or leaves is searched by banded alignments from every such place.
Texts are compared in lower case with each run of other characters than letters and digits as one space; spans are of the
text as it stands.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, free_name, map_rows, texts_of, worker_state

#: Length of the q-grams, and that for items whose budget of edits leaves them no shared q-gram of that length.
Q, SHORT_Q = 8, 4
#: The shortest region that counts as a leak, in characters (shorter items must be there whole), and its edit rate.
REGION, EDIT_RATE = 80, 0.08
#: Benchmark characters in one block; each block is one pass over the documents, and only one block is broadcast at once.
BLOCK_CHARS = 4_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 22


def _folding() -> np.ndarray:
    """For each code point its lower case, or 0x20 where it is no letter or digit."""
    table = np.full(sys.maxunicode + 1, 32, np.uint32)
    for c in range(sys.maxunicode + 1):
        if (ch := chr(c)).isalnum():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def folded(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points and the position of each in the text."""
    table = worker_state("folding", _folding)
    points = table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = np.ones(len(points), bool)
    if len(points):
        keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
        keep[0] = points[0] != 32
    at = np.flatnonzero(keep)
    return points[at], at


def gram_hashes(points: np.ndarray, q: int) -> np.ndarray:
    """A hash of each of the q-grams."""
    n = max(0, len(points) - q + 1)
    h, wide = np.zeros(n, np.uint64), points.astype(np.uint64)
    for j in range(q):
        h = h * _BASE + wide[j : j + n]
    return h ^ (h >> np.uint64(29))


def budget(length: int) -> int:
    return int(EDIT_RATE * length)


class _Tier:
    """Q-grams of items of like length, with the counts that the lemma asks of a stretch of each of them."""

    def __init__(self, numbers: list[int], points: list[np.ndarray], q: int):
        self.numbers, self.q, length = numbers, q, [len(points[k]) for k in numbers]
        # of a band; bands overlap by half, so the diagonals of any region of less than two shortest ones lie in one
        self.half = max(1, max(budget(min(n, 2 * REGION - 1)) for n in length)) + 1
        # for each number of edits: the fewest q-grams of a region, and its greatest length (short items: their own, always)
        classes = [(budget(m), m) for m in range(REGION, 2 * REGION)]
        steps = [(min(m for d, m in classes if d == e), max(m for d, m in classes if d == e), e) for e in sorted({e for e, _ in classes})]
        bound = lambda n, e: max(1, n + 1 - q * (e + 1))
        self.fewest = np.array([[bound(low, e) if n >= REGION else bound(n, budget(n)) for n in length] for low, _, e in steps])
        self.longest = np.array([[high if n >= REGION else n for n in length] for _, high, _ in steps])
        if all(n < REGION for n in length):
            self.fewest, self.longest = self.fewest[:1], self.longest[:1]
        hashes = [gram_hashes(points[k], q) for k in numbers]
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        self.item = np.repeat(np.arange(len(numbers)), [len(g) for g in hashes])[order]
        self.offset = np.concatenate([np.arange(len(g)) for g in hashes])[order]
        self.hash, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.hash >> np.uint64(64 - _FILTER_BITS)] = True

    def hits(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document positions, items (places in ``numbers``) and item offsets of the shared q-grams."""
        h = gram_hashes(points, self.q)
        at = np.flatnonzero(self.filter[h >> np.uint64(64 - _FILTER_BITS)])
        h = h[at]
        slot = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        same = self.hash[slot] == h
        at, slot = at[same], slot[same]
        many = self.count[slot]
        each = np.repeat(self.first[slot] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        return np.repeat(at, many), self.item[each], self.offset[each]

    def regions(self, points: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Retained bands: item number, first diagonal, first and last place of the item where a region can start."""
        position, item, offset = self.hits(points)
        if not len(position):
            return []
        bands = (1 << 31) // self.half + 2
        low = item * bands + (position - offset + (1 << 30)) // self.half
        key, offset = np.concatenate([low, low - 1]), np.concatenate([offset, offset])  # band b holds the diagonals from b * half to (b + 2) * half
        keys, slot, counts = np.unique(key, return_inverse=True, return_counts=True)
        enough = (counts >= self.fewest.min(0)[keys // bands])[slot]
        if not enough.any():
            return []
        both = np.unique(np.stack([key[enough], offset[enough]], 1), axis=0)  # each offset of the item once in a band
        key, offset = both[:, 0], both[:, 1]
        item, n = key // bands, len(key)
        start, stop = np.full(n, 1 << 40), np.full(n, -1)
        for fewest, longest in zip(self.fewest, self.longest, strict=True):
            last = np.arange(n) + fewest[item] - 1
            i = np.flatnonzero(last < n)
            j = last[i]
            good = (key[j] == key[i]) & (offset[j] - offset[i] <= longest[item[i]] - self.q)
            i, j = i[good], j[good]
            start[i] = np.minimum(start[i], offset[j] + self.q - longest[item[i]])
            stop[i] = offset[i]
        kept = np.flatnonzero(stop >= 0)
        if not len(kept):
            return []
        keys, first = np.unique(key[kept], return_index=True)
        begin, end = np.minimum.reduceat(start[kept], first), np.maximum.reduceat(stop[kept], first)
        return [(self.numbers[k // bands], k % bands * self.half - (1 << 30), max(0, a), b) for k, a, b in zip(keys.tolist(), begin.tolist(), end.tolist(), strict=True)]


class BenchmarkIndex:
    """One block of items, by their texts or folded: those below Q characters as whole words, the others by their q-grams."""

    def __init__(self, items: list[tuple[int, str | np.ndarray]]):
        self.ids = [i for i, _ in items]
        self.points = [folded(t)[0] if isinstance(t, str) else t for _, t in items]
        tiers: dict[tuple, list[int]] = {}
        self.words: dict[int, dict[bytes, list[int]]] = {}  # by length: items of fewer than Q characters, between spaces
        for k, p in enumerate(self.points):
            n = len(p)
            if 0 < n < Q:
                self.words.setdefault(n + 2, {}).setdefault(_padded(p).tobytes(), []).append(k)
            elif n:
                q = Q if n + 1 - Q * (budget(n) + 1) > 0 else SHORT_Q
                tiers.setdefault((q, n >= REGION), []).append(k)
        self.tiers = [_Tier(numbers, self.points, q) for (q, _), numbers in tiers.items()]
        self.word_hashes = {n: np.array(sorted({int(gram_hashes(np.frombuffer(w, np.uint32), n)[0]) for w in words}), np.uint64) for n, words in self.words.items()}

    def regions(self, points: np.ndarray) -> list[tuple[int, int, int, int]]:
        return [r for tier in self.tiers for r in tier.regions(points)]

    def found(self, points: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Item number, start, end and edits of the passages in folded ``points``."""
        for tier in self.tiers:
            regions, width = tier.regions(points), 2 * tier.half
            at = 0
            while at < len(regions):
                k, group = regions[at][0], [regions[at]]
                while at + len(group) < len(regions) and regions[at + len(group)][0] == k and regions[at + len(group)][1] <= group[-1][1] + width:
                    group.append(regions[at + len(group)])
                at += len(group)
                for start, end, edits in passages(points, self.points[k], [r[1:] for r in group], width):
                    yield k, start, end, edits
        padded = _padded(points) if self.words else points
        for n, words in self.words.items():
            for i in np.flatnonzero(np.isin(gram_hashes(padded, n), self.word_hashes[n])).tolist():
                for k in words.get(padded[i : i + n].tobytes(), ()):
                    yield k, i, i + n - 2, 0


def _padded(points: np.ndarray) -> np.ndarray:
    """With a space at both ends."""
    edge = np.full(1, 32, np.uint32)
    inner = points[: len(points) - 1] if len(points) and points[-1] == 32 else points
    return np.concatenate([edge, inner, edge])


def banded_alignment(doc: np.ndarray, item: np.ndarray, first: int, last: int, rate: float = EDIT_RATE, region: int = REGION) -> tuple[int, int, int, int, int] | None:
    """The best local alignment with diagonals from ``first`` to ``last`` (document minus item position).

    A match scores 1 and an edit -2, so an optimal alignment stops where edits get too dense. Returns document start and
    end, item start and end, and edits, where the item's part is at least ``region`` long, or the whole item if that is
    shorter, within the edit rate."""
    low = max(first, 0)
    there = doc[low : last + len(item)].tobytes().find(item.tobytes()) if len(item) else -1
    if there >= 0 and there % 4 == 0:  # the item as it stands: one diagonal without edits
        return low + there // 4, low + there // 4 + len(item), 0, len(item), 0
    n, width = len(item), last - first + 1
    need = min(n, region)
    score = np.zeros((n + 1, width + 2), np.int32)
    pad = np.full(width, 0, np.int64) + np.arange(first, last + 1)
    inner = np.arange(width, dtype=np.int32) * 2
    best, best_at = 0, (0, 0)
    for j in range(n):
        at = pad + j
        inside = (at >= 0) & (at < len(doc))
        same = inside & (doc[np.clip(at, 0, max(len(doc) - 1, 0))] == item[j]) if len(doc) else inside
        row = np.maximum(score[j, 1:-1] + np.where(same, 1, -2), score[j, 2:] - 2)  # match or change; item character left out
        row = np.maximum(np.maximum(row, 0), np.maximum.accumulate(row + inner) - inner)  # document characters between
        row[~inside] = 0
        score[j + 1, 1:-1] = row
        k = int(row.argmax())
        if row[k] > best:
            best, best_at = int(row[k]), (j + 1, k)
    j, k = best_at
    end_item, end_doc, edits = j, first + k + j, 0
    while j > 0 and score[j, k + 1] > 0:
        here, d = score[j, k + 1], first + k + j - 1
        same = 0 <= d < len(doc) and doc[d] == item[j - 1]
        if score[j - 1, k + 1] + (1 if same else -2) == here:
            edits += not same
            j -= 1
        elif score[j - 1, k + 2] - 2 == here:
            edits, j, k = edits + 1, j - 1, k + 1
        elif k > 0 and score[j, k] - 2 == here:
            edits, k = edits + 1, k - 1
        else:  # starts here
            edits += not same
            j -= 1
            break
    start_item, start_doc = j, first + k + j
    span = end_item - start_item
    missing = n - span if need == n else 0  # a short item must be there whole: what the alignment left out counts as edits
    if span + missing >= need and edits + missing <= rate * max(span, need):
        return max(start_doc, 0), end_doc, start_item, end_item, edits + missing
    return None


def clean_windows(doc: np.ndarray, item: np.ndarray, first: int, width: int, rate: float = EDIT_RATE, region: int = REGION, starts: tuple[int, int] = (0, 1 << 40)) -> list[tuple[int, int, int, int]]:
    """Item start and end, document start and end of windows of ``item`` that one band of ``doc`` holds within the edit rate.

    For every start in the item (from ``starts[0]`` to ``starts[1]``), edit distances are counted forward, from any diagonal of the band, and the longest window
    of ``region`` to less than twice as many characters is taken (or the whole item if that is shorter than ``region``).
    A longer region within the rate can be cut into such windows, and one of them is within the rate as well."""
    n, need = len(item), min(len(item), region)
    if need == 0:
        return []
    longest = n if n < region else min(n, 2 * region - 1)
    most, far, k = int(rate * longest), np.int32(1 << 29), np.arange(width)
    found = []
    stop = min(starts[1], n - need) + 1
    for low in range(max(0, starts[0]), stop, 4096):
        start = np.arange(low, min(low + 4096, stop))
        at = start[:, None] + first + k  # document position of each start and diagonal
        # edits and, in the low bits, the diagonal of the start
        cost = np.where((at >= 0) & (at <= len(doc)), k, far).astype(np.int32)
        step = np.int32(1 << int(width).bit_length())
        along = k.astype(np.int32) * step
        best = np.zeros((len(start), 3), np.int64)  # of each start the length, and the diagonals of its start and end
        for t in range(longest):
            if not (live := (start + t < n) & (cost.min(axis=1) < (most + 1) * step)).all():
                start, cost = start[live], cost[live]
                if not len(start):
                    break
            at = start[:, None] + (first + t) + k
            same = (at >= 0) & (at < len(doc)) & (doc[np.clip(at, 0, len(doc) - 1)] == item[start + t][:, None])
            new = cost + np.where(same, np.int32(0), step)
            np.minimum(new[:, :-1], cost[:, 1:] + step, out=new[:, :-1])  # item character left out
            new[(at < -1) | (at >= len(doc))] = far
            cost = np.minimum(np.minimum.accumulate(new - along, axis=1) + along, far)  # document characters between
            cost[(at < -1) | (at >= len(doc))] = far
            if t + 1 >= need:
                end = cost.argmin(axis=1)
                value = cost[np.arange(len(start)), end]
                good = value < (int(rate * (t + 1)) + 1) * step
                best[start[good] - low] = np.stack([np.full(int(good.sum()), t + 1), value[good] % step, end[good]], axis=1)
        for b in np.flatnonzero(best[:, 0]).tolist():
            length, one, two = best[b].tolist()
            b += low
            found.append((b, b + length, b + first + one, b + length + first + two))
    return found


def edit_distance(a: np.ndarray, b: np.ndarray) -> int:
    along = np.arange(len(b) + 1)
    row = along
    for n, c in enumerate(a):
        new = np.r_[n + 1, np.minimum(row[:-1] + (b != c), row[1:] + 1)]
        row = np.minimum.accumulate(new - along) + along
    return int(row[-1])


def passages(doc: np.ndarray, item: np.ndarray, bands: list[tuple[int, int, int]], width: int) -> list[tuple[int, int, int]]:
    """Document start and end and edits of the passages of ``item`` in neighbouring retained ``bands``, each given by its
    first diagonal and the first and last place of the item where a region can start.

    An item of REGION characters or more: the best local alignment is taken if it is within the budget; what it leaves of
    the item, or all if it isn't, is searched for windows within the budget. A shorter item is aligned whole. Windows that
    overlap in item and document are one passage, whose edits may be denser."""
    found, rest, n = [], [(0, len(item))], len(item)
    if n >= REGION:
        hit = banded_alignment(doc, item, bands[0][0], bands[-1][0] + width)
        if hit is not None:
            found, rest = [(hit[0], hit[1], hit[4])], [(a, b) for a, b in ((0, hit[2]), (hit[3], n)) if b - a >= REGION]
    for begin, end in rest:
        windows = set()
        for first, low, high in bands:
            starts = max(low, begin) - begin, min(high, end) - begin
            windows.update((a + begin, b + begin, c, d) for a, b, c, d in clean_windows(doc, item[begin:end], first + begin, width, starts=starts))
        spans: list[list[int]] = []
        for a, b, c, d in sorted(windows):
            for s in spans:
                if a < s[1] and c < s[3] and s[2] < d:
                    s[:] = min(a, s[0]), max(b, s[1]), min(c, s[2]), max(d, s[3])
                    break
            else:
                spans.append([a, b, c, d])
        found.extend((c, d, edit_distance(item[a:b], doc[c:d])) for a, b, c, d in spans)
    return found


def leaks(text: str, index: BenchmarkIndex) -> list[tuple[int, int, int, int]]:
    """(item id, start, end, edits) of the passages of ``text`` that come from the benchmark."""
    points, at = folded(text)
    found = {(index.ids[k], int(at[start]), int(at[end - 1]) + 1, edits) for k, start, end, edits in index.found(points) if end > start}
    return sorted(found, key=lambda x: (x[1], x[2], str(x[0])))


def has_leak(text: str, index: BenchmarkIndex) -> bool:
    return next(index.found(folded(text)[0]), None) is not None


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Folded items in blocks of at most ``block_chars``, ascending by id. A longer item is cut into parts that overlap by two
    shortest regions, so no region is lost."""
    block, size = [], 0
    rows = benchmark.select(F.col(item_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).orderBy("i", "t")
    for row in rows.toLocalIterator():
        points, shared = folded(row.t)[0], 2 * REGION
        step = max(1, block_chars - shared)
        parts = [points] if len(points) <= block_chars else [points[a : a + step + shared] for a in range(0, len(points) - shared, step)]
        for part in parts:
            if block and size + len(part) > block_chars:
                yield block
                block, size = [], 0
            block.append((row.i, part))
            size += len(part)
    if block:
        yield block


def _shared_index(spark, block):
    """A function that gives a task the index of a block; a Python worker builds it once."""
    shared, key = spark.sparkContext.broadcast(block), ("benchmark", uuid.uuid4().hex)
    return lambda: worker_state(key, lambda: BenchmarkIndex(shared.value))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each benchmark passage found in a row of ``docs``: the id, ``item_id``, ``start``, ``end`` (code points, end
    exclusive) and ``edits``.

    A leak is a region of at least REGION characters of an item with at most EDIT_RATE edits a character; a shorter item must
    be there whole within that rate (below 13 characters: without edits), one of fewer than Q characters as whole words.
    Documents are read whole, whatever their length. Null and empty texts and items match nothing; items of equal
    text and different ids are found each; repeated rows give their passages each; empty tables give no rows; further columns are ignored. The benchmark is
    the query side: it is taken in blocks of bounded size.
    """
    spark = docs.sparkSession
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"id {id_type}, item_id {item_type}, start bigint, end bigint, edits bigint"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = None
    for block in benchmark_blocks(benchmark, item_col, item_text_col):
        index_of = _shared_index(spark, block)

        def search(batch, index_of=index_of):
            index, ids = index_of(), batch.column(0).to_pylist()
            out = {"id": [], "item_id": [], "start": [], "end": [], "edits": []}
            for i, text in zip(ids, texts_of(batch.column(1)), strict=True):
                for hit in leaks(text, index):
                    for name, value in zip(out, (i, *hit), strict=True):
                        out[name].append(value)
            return out

        part = map_rows(rows, search, schema)
        found = part if found is None else found.union(part)
    return (spark.createDataFrame([], schema) if found is None else found).withColumnRenamed("id", id_col)


def drop_leaked(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without any benchmark passage, with their columns as they are, whatever their names; rows with a
    null or empty text stay, repeated rows are decided each, and an empty benchmark leaves all rows."""
    for block in benchmark_blocks(benchmark, item_col, item_text_col):
        index_of, flag = _shared_index(docs.sparkSession, block), free_name(docs, "leaked")

        def search(batch, index_of=index_of, flag=flag):
            return {flag: [has_leak(t, index_of()) for t in texts_of(batch.column(0))]}

        docs = add_columns(docs, [F.col(text_col)], search, f"{flag} boolean").filter(~F.col(flag)).drop(flag)
    return docs
