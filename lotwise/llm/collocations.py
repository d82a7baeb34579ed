"""Phrase collocations by level-wise passes over the texts.

Level 1 counts all words. Level k counts phrases of k words, but only those whose first and last k - 1 words are frequent:
the frequent phrases of the level before are broadcast as a bitmap of their hashes, whose size is bounded whatever their
number (a phrase that gets through by a shared bit is counted and then dropped by its own count, so results don't depend on the
bitmap). Each task counts in its own tables of packed word numbers and gives a row for each phrase that it has seen, so a
phrase of half of all texts comes to the shuffle once a task. Candidates are then cut after each word, and the cuts are
scored by joins with the level tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import persist_table, slices, small_batches
from .shingles import mixed

#: Least occurrences of a candidate, most words, hundredths of a phrase's count that a longer one must have to hide it, phrases a language.
LEAST, LONGEST, HIDING, MOST = 10, 3, 50, 2000
#: What a text is cut at into pieces, and its white space. Other white space is part of words.
CUTS, SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"
#: A bitmap has 32 bits a frequent phrase, rounded up to a power of two, and at most 2^MOST_BITS (64 MB).
MOST_BITS = 29
#: A task gives its counts away when it has seen so many words since, and forgets its words at so many different ones or languages.
TASK_WORDS, TASK_DISTINCT, TASK_LANGUAGES = 4_000_000, 400_000, 50
#: Rows in a batch of counts.
GIVEN_ROWS = 50_000

_PLAIN = bytes.maketrans(CUTS + SPACES, b"\n" * len(CUTS) + b" " * len(SPACES))
_EMPTY, _CUT = 0, 1
_STEP = np.uint64(0x9E3779B97F4A7C15)


def phrase_hash(parts: list[np.ndarray]) -> np.ndarray:
    """Hashes of phrases of one length from the hashes of their words, by place."""
    h = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        h = (h + p) * _STEP
    return mixed(h)


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word, seed=xxhash.xxh32_intdigest(lang.encode()))


class Words(dict):
    """Numbers of the words of one language in one task; 0 and 1 stand for none and a cut."""

    def __init__(self, lang: str):
        super().__init__({b"": _EMPTY, b"\n": _CUT})
        self.lang, self.names = lang, [b"", b""]

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self.names)
        self.names.append(word)
        return at


class Bits:
    """A set of hashes as a bitmap; hashes that share a bit are one."""

    def __init__(self, bits: int, data: np.ndarray):
        self.bits, self.data = bits, data

    @staticmethod
    def bit(h, bits: int):
        return h >> np.uint64(64 - bits)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = self.bit(hashes, self.bits)
        return (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


class Counter:
    """Counts of the phrases of ``size`` words in one language and task."""

    def __init__(self, lang: str, size: int, frequent: Bits | None, before: Bits | None):
        self.size, self.frequent, self.before = size, frequent, before
        self.seen, self.kept, self.words = 0, [], Words(lang)
        self.hashes, self.good = np.zeros(2, np.uint64), np.zeros(2, bool)  # by the number of a word

    def look_up(self) -> None:
        """Hashes of the words that are new, and whether they are frequent."""
        new = self.words.names[len(self.hashes) :]
        if new:
            hashes = np.array([word_hash(self.words.lang, w) for w in new], np.uint64)
            self.hashes, self.good = np.r_[self.hashes, hashes], np.r_[self.good, self.frequent.has(phrase_hash([hashes]))]

    def add(self, text: str) -> int:
        plain = text.encode("utf-8").lower().translate(_PLAIN).replace(b"\n", b" \n ").split(b" ")
        numbers = np.fromiter(map(self.words.__getitem__, plain), np.int64, len(plain))
        numbers = numbers[numbers != _EMPTY]
        n = int((numbers != _CUT).sum())
        self.seen += n
        if self.size == 1:
            self.kept.append(numbers[numbers != _CUT][:, None])
        elif len(numbers) >= self.size:
            self.kept.append(self.phrases(numbers))
        return n

    def phrases(self, numbers: np.ndarray) -> np.ndarray:
        """The phrases whose first and last words are frequent phrases themselves, a row each."""
        self.look_up()
        good = self.good[numbers]
        if self.size == 2:
            at = np.flatnonzero(good[:-1] & good[1:])
        else:
            shorter, m = self.size - 1, len(numbers) - self.size + 2
            whole = good[:m].copy()
            for i in range(1, shorter):
                whole &= good[i : m + i]
            start = np.flatnonzero(whole)
            frequent = np.zeros(m, bool)
            frequent[start] = self.before.has(phrase_hash([self.hashes[numbers[start + i]] for i in range(shorter)]))
            at = np.flatnonzero(frequent[:-1] & frequent[1:])
        return np.stack([numbers[at + i] for i in range(self.size)], 1)

    def counted(self) -> tuple[pa.Array, np.ndarray, int]:
        """Phrases, their counts and the number of all words since the last time."""
        rows, seen = np.concatenate(self.kept) if self.kept else np.zeros((0, self.size), np.int64), self.seen
        self.kept, self.seen = [], 0
        limit = len(self.words.names)
        if limit**self.size < 1 << 62:
            packed = rows[:, 0]
            for i in range(1, self.size):
                packed = packed * limit + rows[:, i]
            packed, counts = np.unique(packed, return_counts=True)
            columns = [packed // limit**i % limit for i in reversed(range(self.size))]
        else:
            rows, counts = np.unique(rows, axis=0, return_counts=True)
            columns = list(rows.T)
        names = pa.array(self.words.names, pa.binary())
        parts = [names.take(pa.array(c)).cast(pa.string()) for c in columns]
        phrases = pc.binary_join_element_wise(*parts, " ") if len(parts) > 1 else parts[0]
        return phrases, counts, seen


def _counts(texts: DataFrame, size: int, words_frequent, before) -> DataFrame:
    """Rows ``lang``, ``phrase`` and ``n`` from each task, several a phrase; the phrase null stands for all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[str, Counter] = {}
        since = 0

        def give() -> Iterator[pa.RecordBatch]:
            for lang, counter in counters.items():
                phrases, counts, seen = counter.counted()
                phrases, counts = pa.concat_arrays([phrases, pa.nulls(1, pa.string())]), pa.array(np.r_[counts, seen].astype(np.int64))
                for at in range(0, len(counts), GIVEN_ROWS):
                    n = min(GIVEN_ROWS, len(counts) - at)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), phrases.slice(at, n), counts.slice(at, n)], names=["lang", "phrase", "n"])

        for batch in batches:
            for part in slices(batch):
                by_lang: dict[str, list[str]] = {}
                for lang, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    by_lang.setdefault(lang, []).append(text)
                for lang, found in by_lang.items():
                    if lang not in counters:
                        counters[lang] = Counter(lang, size, words_frequent and words_frequent.value, before and before.value)
                    since += counters[lang].add("\n".join(found))
                full = len(counters) > TASK_LANGUAGES or sum(len(c.words) for c in counters.values()) > TASK_DISTINCT
                if since >= TASK_WORDS or full:
                    yield from give()
                    since = 0
                    if full:
                        counters.clear()
        yield from give()

    return texts.mapInArrow(run, "lang string, phrase string, n bigint")


def _hashed(batch: pa.RecordBatch) -> np.ndarray:
    """Hashes of the phrases of rows ``lang`` and ``phrase``, all of as many words."""
    langs, phrases = (c.to_pylist() for c in batch.columns)
    by_place = zip(*([word_hash(lang, w) for w in p.encode().split(b" ")] for lang, p in zip(langs, phrases, strict=True)), strict=True)
    return phrase_hash([np.array(h, np.uint64) for h in by_place])


def frequent_bits(level: DataFrame) -> Bits:
    """The phrases of a level table as a bitmap. Its blocks of 4 KB are made on the executors; the driver gets at most 2^MOST_BITS bits."""
    spark = level.sparkSession
    bits = int(min(MOST_BITS, max(15, np.ceil(np.log2(32 * level.count() + 1)))))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4096):
                yield pa.RecordBatch.from_arrays([pa.array(Bits.bit(_hashed(part), bits).astype(np.int64))], names=["at"])

    at = level.select("lang", "phrase").mapInArrow(places, "at bigint")
    # the functions number blocks from 1 and count places from 1
    blocks = at.groupBy(F.bitmap_bucket_number(F.col("at") + 1).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at") + 1)).alias("bits"))
    data = np.zeros(1 << bits - 3, np.uint8)
    for r in blocks.toLocalIterator():
        start = (r["block"] - 1) * 4096
        data[start : start + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return Bits(bits, data)


def level_tables(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST) -> tuple[list[DataFrame], DataFrame]:
    """A stored table ``lang, phrase, n`` of the frequent phrases for each number of words, and one of all words by language."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    levels, shared = [], []
    for size in range(1, longest + 1):
        counts = _counts(texts, size, *((shared[0], shared[-1]) if size > 1 else (None, None))).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        if size == 1:
            stored, _ = persist_table(counts.filter((F.col("n") >= least) | F.col("phrase").isNull()))
            total, stored = stored.filter(F.col("phrase").isNull()).select("lang", F.col("n").alias("total")), stored.filter(F.col("phrase").isNotNull())
        else:
            stored, _ = persist_table(counts.filter((F.col("n") >= least) & F.col("phrase").isNotNull()))
        levels.append(stored)
        if size < longest:
            shared.append(spark.sparkContext.broadcast(frequent_bits(stored)))
    for b in shared:
        b.unpersist()
    return levels, total


def scored_cuts(levels: list[DataFrame]) -> DataFrame:
    """Per candidate (a frequent phrase of two words or more): ``a``, and of its lowest-scoring cut ``l``, ``r`` and ``score``. Products are
    decimals of 38 digits, which hold counts up to 10^15."""
    words = F.split("phrase", " ")
    cuts = None
    for size, level in enumerate(levels[1:], 2):
        own = level.select("lang", "phrase", F.col("n").alias("a"), words.alias("w"), F.explode(F.array(*map(F.lit, range(1, size)))).alias("k"))
        own = own.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.lit(size) - F.col("k")), " ").alias("right"))
        cuts = own if cuts is None else cuts.unionByName(own)
    parts = levels[0]
    for level in levels[1:-1]:
        parts = parts.unionByName(level)
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(parts.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    cuts = cuts.select("lang", "phrase", "a", "k", "l", "r", (F.lit(1_000_000).cast("decimal(7,0)") * (wide("a") * wide("a"))).alias("top"), (wide("l") * wide("r")).alias("bottom")).withColumn("score", F.expr("top div bottom"))
    return cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def hidden(levels: list[DataFrame]) -> DataFrame | None:
    """``lang, phrase`` and the greatest count (``longer``) of the longer candidates that hold the phrase."""
    words, out = F.split("phrase", " "), None
    for size, level in enumerate(levels[2:], 3):
        inside = [(i, m) for m in range(2, size) for i in range(size - m + 1)]
        inner = level.select("lang", F.col("n"), words.alias("w")).select("lang", "n", F.explode(F.array(*(F.array_join(F.slice("w", i + 1, m), " ") for i, m in inside))).alias("phrase"))
        out = inner if out is None else out.unionByName(inner)
    return None if out is None else out.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))


def mine_collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, hiding: int = HIDING, most: int = MOST) -> DataFrame:
    """Per language its first ``most`` phrases by score (descending), count (descending) and phrase (bytes, ascending): ``lang``,
    ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` (words of the language) and ``score``.

    Null and empty texts have no words; a null language is ``und``; repeated rows count each; pieces, hence phrases, don't cross rows;
    an empty table, or one without frequent phrases, gives no rows; further columns are ignored, whatever their names.
    """
    levels, total = level_tables(docs, text_col, lang_col, longest, least)
    found = scored_cuts(levels)
    if (longer := hidden(levels)) is not None:
        found = found.join(longer, ["lang", "phrase"], "left").filter(F.coalesce(F.col("longer") * 100 < F.col("a") * hiding, F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return first.join(total, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
