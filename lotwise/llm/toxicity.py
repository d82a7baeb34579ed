"""Toxicity by a factorization machine over hashed terms.

A text is the set of its hashed terms: words and beginnings of words. The machine's score is a bias, a weight for each
term, and for each pair of terms the product of their factor vectors, so that two terms can say together what neither
says alone. All pairs are summed in time linear in the terms.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, texts_of, worker_state

WORDS = re.compile(r"\w+").findall
BUCKETS = 1 << 20
PREFIXES = (3, 4, 5, 6)
#: Bounds of the fit: labelled rows, and terms of the model.
MOST_ROWS, MOST_TERMS = 20_000, 8_192
#: Least |z| of the difference in a term's frequency between the labels. These three were chosen by the log-loss of a
#: cross-validation on rows outside the held-out fold only.
LEAST_Z, RANK, DECAY = 3.0, 4, 3e-4
HELD_OUT, FOLDS = 1, 3


class TermHashes(dict):
    """Bucket numbers of a word's terms."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        terms = [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]
        found = tuple(zlib.crc32(t.encode("utf-8")) % BUCKETS for t in terms)
        if len(self) > 150_000:
            self.clear()
        if len(word) < 100:
            self[word] = found
        return found


def term_buckets(text: str, hashes: TermHashes) -> np.ndarray:
    """The distinct buckets of a text."""
    return np.fromiter({b for w in set(WORDS(text.lower())) for b in hashes[w]}, np.int64)


class FactorizationMachine:
    """Second-order machine over binary terms; ``slot`` maps buckets to rows of the weights, -1 where a bucket has none."""

    def __init__(self, terms: np.ndarray, rank: int = RANK, seed: int = 11):
        rnd = np.random.default_rng(seed)
        self.terms = np.sort(terms)
        self.bias, self.weight, self.factor = 0.0, np.zeros(len(terms)), rnd.normal(0, 0.05, (len(terms), rank))

    def slots(self, buckets: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.terms, buckets)
        at[at == len(self.terms)] = 0
        return at[self.terms[at] == buckets] if len(self.terms) else at[:0]

    def logit(self, slots: np.ndarray) -> float:
        if not len(slots):
            return self.bias
        v = self.factor[slots]
        return self.bias + self.weight[slots].sum() + 0.5 * float(((v.sum(0) ** 2) - (v**2).sum(0)).sum())

    def score(self, buckets: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(self.slots(buckets)), -60, 60))))

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, epochs: int = 40, step: float = 0.05, decay: float = DECAY, batch: int = 256, seed: int = 5) -> FactorizationMachine:
        """Logistic loss with Adam over batches of rows of slots."""
        rnd = np.random.default_rng(seed)
        n, (terms, rank) = len(rows), self.factor.shape
        share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
        self.bias = float(np.log(share / (1 - share)))
        params = [np.array([self.bias]), self.weight, self.factor]
        first, second, turn = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs if n else 0):
            order = rnd.permutation(n)
            for start in range(0, n, batch):
                part = order[start : start + batch]
                length = np.array([len(rows[i]) for i in part])
                slot = np.concatenate([rows[i] for i in part])
                owner = np.repeat(np.arange(len(part)), length)
                v = self.factor[slot]
                total = np.zeros((len(part), rank))
                np.add.at(total, owner, v)
                squares = np.bincount(owner, (v**2).sum(1), len(part))
                logit = params[0][0] + np.bincount(owner, self.weight[slot], len(part)) + 0.5 * ((total**2).sum(1) - squares)
                error = (1 / (1 + np.exp(-np.clip(logit, -60, 60))) - labels[part]) / len(part)
                each = error[owner]
                grad_v = np.zeros((terms, rank))
                np.add.at(grad_v, slot, each[:, None] * (total[owner] - v))
                grads = [np.array([error.sum()]), np.bincount(slot, each, terms) + decay * self.weight, grad_v + decay * self.factor]
                turn += 1
                for p, g, a, b in zip(params, grads, first, second, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= step * (a / (1 - 0.9**turn)) / (np.sqrt(b / (1 - 0.999**turn)) + 1e-8)
        self.bias = float(params[0][0])
        return self


def held_out_rows(id_col: str, folds: int = FOLDS, held: int = HELD_OUT):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == held


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most_rows: int) -> DataFrame:
    """At most ``most_rows`` documents with a label (the first by a hash of the id) outside the held-out fold."""
    usable = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out_rows(id_col))
    chosen = usable.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label")).orderBy(F.xxhash64("id"), "id").limit(most_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.join(F.broadcast(chosen), "id")  # bounded by most_rows


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = MOST_ROWS, most_terms: int = MOST_TERMS) -> FactorizationMachine:
    """Fit on a bounded sample of labelled rows outside the held-out fold.

    Term frequencies by label are summed on the executors; the terms that tell the labels apart best stay; the sample as
    sets of these terms (at most ``most_rows`` sets) comes to the driver for the fit. Without rows or terms the machine
    has the bias only."""
    sample = labelled_sample(docs, labels, id_col, text_col, label_col, most_rows)

    def count(batch):
        hashes = worker_state("terms", TermHashes)
        seen: dict[int, list[int]] = {}
        for text, label in zip(texts_of(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            for b in term_buckets(text, hashes).tolist():
                seen.setdefault(b, [0, 0])[label > 0] += 1
        return {"bucket": list(seen), "clean": [c for c, _ in seen.values()], "toxic": [t for _, t in seen.values()]}

    size = {bool(r["toxic"]): r["n"] for r in sample.groupBy((F.col("label") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    clean, toxic = max(1, size.get(False, 0)), max(1, size.get(True, 0))
    seen = map_rows(sample.select("text", "label"), count, "bucket bigint, clean bigint, toxic bigint").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    p = (F.col("clean") + F.col("toxic")) / (clean + toxic)
    z = F.abs(F.col("toxic") / toxic - F.col("clean") / clean) / F.sqrt(p * (1 - p + 1e-9) * (1 / clean + 1 / toxic))
    best = seen.withColumn("z", z).filter(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "bucket").limit(most_terms)
    machine = FactorizationMachine(np.array([r["bucket"] for r in best.select("bucket").collect()], dtype=np.int64))
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def encode(batch):
        hashes = worker_state("terms", TermHashes)
        found = [shared.value.slots(term_buckets(t, hashes)).tolist() for t in texts_of(batch.column(0))]
        return {"slots": found, "label": batch.column(1)}

    rows = map_rows(sample.select("text", "label"), encode, "slots array<int>, label int").collect()  # at most most_rows
    return machine.fit([np.array(sorted(r["slots"]), dtype=np.int64) for r in rows], np.array([float(r["label"] > 0) for r in rows]))


def score_toxicity(docs: DataFrame, machine: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Per row of ``docs``: the id, ``held_out``, ``score`` (0 to 1, of the whole text only) and ``predicted`` (score >= threshold).

    Null and empty texts get the score of no terms; a null id stays null (its fold is that of the empty text); repeated
    rows are scored each; an empty table gives no rows; further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    id_type = docs.schema[id_col].dataType.simpleString()

    def score(batch):
        hashes = worker_state("terms", TermHashes)
        return {"id": batch.column(0), "held_out": batch.column(2), "score": [shared.value.score(term_buckets(t, hashes)) for t in texts_of(batch.column(1))]}

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out_rows(id_col).alias("held_out"))
    scored = map_rows(rows, score, f"id {id_type}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumnRenamed("id", id_col)
