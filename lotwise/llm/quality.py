"""Quality classifier by co-training two views of a document.

One view sees numbers taken from the text, the other the page's metadata (language, source, stated length). Each view has
a logistic model. In every round each model labels the share of all unlabelled documents that it is surest about, per label, and the *other*
view is fitted anew on the labelled rows and these. The features of all documents are kept as a table; the executors add up
the gradient and the curvature over it, so no document is left out and nothing that grows with them reaches the driver.
At last both views are calibrated on labelled rows kept apart, and their evidence is added up and calibrated again.
"""

from __future__ import annotations

import copy
import operator
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import add_columns, drop_table, free_name, map_rows, persist_table, small_batches, texts_of

#: Bound of the labelled rows of the fit.
MOST_LABELLED = 20_000
#: Rounds and passes over the features in each of them.
ROUNDS, PASSES = 3, 3
#: A view teaches this share of the rows that its prior gives to a label: those that it is surest of, if it calls the label likelier than not.
TAUGHT_SHARE = 0.1
#: The share is cut by a histogram of a view's logit, with so many bins between these ends; rows of one bin are taught together or not at all.
BINS, LOGIT_ENDS = 4096, 16.0
#: Weight of all labels given by the other view together, beside the labelled rows; one row weighs at most as much as a labelled one.
TAUGHT_WEIGHT = 0.1
META_BUCKETS = 128
SYMBOLS = re.compile(r"[^\w\s.,;:!?'’\"()«»¿¡-]").findall
ENDS = re.compile(r"[.!?…]").findall


def text_features(text: str) -> list[float]:
    """Shares of kinds of words, characters and lines of the whole text; all zero but the first for an empty one."""
    words = text.split()
    n = len(words)
    if not n:
        return [1.0] + [0.0] * 15
    chars, lines = len(text), [x for x in text.split("\n") if x.strip()]
    distinct = len(set(words))
    shares = [
        min(1.0, len(SYMBOLS(text)) / n),
        sum(map(str.isupper, words)) / n,
        sum(map(operator.eq, words, words[1:])) / n,
        1 - distinct / n,
        min(1.0, text.count("|") / n),
        min(1.0, text.count("!") / n),
        sum(map(str.isdigit, text)) / chars,
        1 - len(set(lines)) / len(lines),
    ]
    return [0.0, *shares, *(s**0.5 for s in shares[:5]), float(np.log(n)), min(1.0, len(ENDS(text)) / n)]


TEXT_SIZE = 16


def meta_features(values: tuple) -> list[int]:
    """Hashed terms of the metadata: each column's value, a number by its order of magnitude, and the pair of the first two."""
    terms = [f"{i}={int(np.log2(v + 1)) if isinstance(v, int | float) and 0 <= v < float('inf') else v}" for i, v in enumerate(values)]
    if len(terms) > 1:
        terms.append("&".join(terms[:2]))
    return [zlib.crc32(t.encode("utf-8", "surrogatepass")) % META_BUCKETS for t in terms]


def meta_matrix(slots: np.ndarray) -> np.ndarray:
    out = np.zeros((len(slots), META_BUCKETS))
    out[np.arange(len(slots))[:, None], slots] = 1
    return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Logistic:
    """Ridge logistic regression by Newton steps; columns may be standardized first."""

    def __init__(self, size: int, standard_of: np.ndarray | None = None, ridge: float = 1.0):
        known = standard_of is not None and len(standard_of) > 0
        self.mean, self.scale = (standard_of.mean(0), standard_of.std(0) + 1e-6) if known else (np.zeros(size), np.ones(size))
        self.w = np.zeros(size + 1)
        self.penalty = np.r_[np.full(size, ridge), 1e-6]

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones((len(x), 1))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.design(x) @ self.w

    def sums(self, x: np.ndarray, y) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and curvature of the log-likelihood over rows."""
        z = self.design(x)
        p = sigmoid(z @ self.w)
        return z.T @ (y - p), (z * (p * (1 - p))[:, None]).T @ z

    def step(self, gradient: np.ndarray, curvature: np.ndarray, most: float = 5.0) -> float:
        """A Newton step, shortened where it would change a weight by more than ``most``: labels that a sure model contradicts would throw it far."""
        move = np.linalg.solve(curvature + np.diag(self.penalty), gradient - self.penalty * self.w)
        longest = float(np.abs(move).max())
        self.w = self.w + move * min(1.0, most / max(longest, 1e-12))
        return longest

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 12) -> Logistic:
        for _ in range(steps if len(x) else 0):
            if self.step(*self.sums(x, y)) < 1e-6:
                break
        return self


def calibrated(logit: np.ndarray, y: np.ndarray) -> Logistic | None:
    """A logistic model of a logit itself; none where the rows have one label only."""
    return Logistic(1, logit[:, None]).fit(logit[:, None], y) if len(y) and y.min() < y.max() else None


def logit_bins(logit: np.ndarray) -> np.ndarray:
    return np.clip((logit / (2 * LOGIT_ENDS) + 0.5) * BINS, 0, BINS - 1).astype(np.int64)


@dataclass
class Bounds:
    """What a view teaches in a round: label 0 up to the bin ``last``, label 1 from the bin ``first`` on, and how much each label is worth."""

    last: int
    first: int
    worth: tuple[float, float]


def taught_bounds(counts: np.ndarray, prior: float) -> Bounds:
    """The surest bins of logits, until they hold TAUGHT_SHARE of the rows that the prior gives to a label, and on the label's side of even odds only.

    A label is worth what its mean probability is above the label's prior, from 0 (the view says no more than the prior does) to 1 (it is certain), so a
    view that knows little disturbs the other little."""
    middle, total = BINS // 2, counts.sum()
    low, high = np.cumsum(counts), np.cumsum(counts[::-1])
    last = min(int(np.searchsorted(low, max(1, TAUGHT_SHARE * (1 - prior) * total))), middle - 1)
    first = max(BINS - 1 - int(np.searchsorted(high, max(1, TAUGHT_SHARE * prior * total))), middle)
    p = sigmoid(((np.arange(BINS) + 0.5) / BINS - 0.5) * 2 * LOGIT_ENDS)
    worth = []
    for part, sure, share in ((slice(0, last + 1), 1 - p, 1 - prior), (slice(first, BINS), p, prior)):
        n = counts[part].sum()
        worth.append(float(np.clip(((sure[part] * counts[part]).sum() / n - share) / (1 - share), 0, 1)) if n else 0.0)
    return Bounds(last, first, (worth[0], worth[1]))


def taught_rows(teacher: np.ndarray, pupil: np.ndarray, bounds: Bounds) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are taught label 0 and which label 1, by the logits of both views: those beyond the teacher's bounds, but where the pupil itself says the
    other label and is no less sure of it."""
    bins, surer = logit_bins(teacher), np.abs(pupil) < np.abs(teacher)
    return (bins <= bounds.last) & (surer | (pupil <= 0)), (bins >= bounds.first) & (surer | (pupil >= 0))


class View:
    """A model of one view with its calibration."""

    def __init__(self, model: Logistic, held_x: np.ndarray, held_y: np.ndarray):
        self.model = model
        self.calibration = calibrated(model.logit(held_x), held_y)

    def logit(self, x: np.ndarray) -> np.ndarray:
        own = self.model.logit(x)
        return own if self.calibration is None else self.calibration.logit(own[:, None])


class CoTrained:
    """Two views that taught each other: first of the text, second of the metadata. ``labelled`` and ``held`` hold a matrix
    for each view and the labels. ``histograms(views)`` counts the unlabelled rows by each view's logit; ``taught_sums(views, bounds, pupils)`` gives for
    each pupil and label (0 and 1) the number, gradient and curvature of the unlabelled rows beyond the other view's bounds."""

    def __init__(self, labelled: tuple[np.ndarray, np.ndarray, np.ndarray], held: tuple[np.ndarray, np.ndarray, np.ndarray], histograms=None, taught_sums=None, rounds: int = ROUNDS):
        *rows, y = labelled
        self.prior = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        models = [Logistic(TEXT_SIZE, rows[0]).fit(rows[0], y), Logistic(META_BUCKETS).fit(rows[1], y)]
        self.views = [View(m, held[v], held[2]) for v, m in enumerate(models)]
        self.taught: list[tuple[int, int]] = []  # rows that each view was taught by the other, by round
        for _ in range(rounds if taught_sums is not None and len(y) else 0):
            pupils = [copy.copy(m) for m in models]
            bounds = [taught_bounds(h, self.prior) for h in histograms(self.views)]
            for _ in range(PASSES):
                found = taught_sums(self.views, bounds, pupils)
                for v, pupil in enumerate(pupils):
                    gradient, curvature = pupil.sums(rows[v], y)
                    for label, (n, g, c) in enumerate(found[v]):
                        if n:
                            share = self.prior if label else 1 - self.prior
                            weight = bounds[1 - v].worth[label] * min(1.0, TAUGHT_WEIGHT * len(y) * share / n)
                            gradient, curvature = gradient + weight * g, curvature + weight * c
                    pupil.step(gradient, curvature, 1.0)
            self.taught.append(tuple(sum(n for n, _, _ in of_view) for of_view in found))
            models = pupils
            self.views = [View(m, held[v], held[2]) for v, m in enumerate(models)]
        self.both = calibrated(self._sum(held[0], held[1]), held[2])

    def _sum(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        return self.views[0].logit(text) + self.views[1].logit(meta) - np.log(self.prior / (1 - self.prior))

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of good quality: of both views together, of the text and of the metadata."""
        both = self._sum(text, meta)
        return sigmoid(both if self.both is None else self.both.logit(both[:, None])), sigmoid(self.views[0].logit(text)), sigmoid(self.views[1].logit(meta))


def _columns(docs: DataFrame, text_col: str, meta_cols: tuple[str, ...]) -> list[Column]:
    kinds = {f.name: f.dataType.typeName() for f in docs.schema}
    number = ("byte", "short", "integer", "long", "float", "double", "decimal")
    return [F.col(f"`{text_col}`").alias("text"), *(F.col(f"`{c}`").cast("double" if kinds[c] in number else "string").alias(f"m{i}") for i, c in enumerate(meta_cols))]


def _features(batch: pa.RecordBatch, n_meta: int) -> tuple[list[list[float]], list[list[int]]]:
    texts = texts_of(batch.column(0))
    meta = list(zip(*(batch.column(1 + i).to_pylist() for i in range(n_meta)), strict=True)) if n_meta else [()] * len(texts)
    return [text_features(t) for t in texts], [meta_features(m) for m in meta]


def _matrices(batch) -> tuple[np.ndarray, np.ndarray]:
    """Both views' matrices of a batch or table whose first columns are ``text_f`` and ``meta_f``."""
    n = batch.num_rows
    flat = lambda c: np.asarray((c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).flatten())
    return flat(batch.column(0)).reshape(n, TEXT_SIZE).astype(float), meta_matrix(flat(batch.column(1)).astype(np.int64).reshape(n, -1) if n else np.zeros((0, 1), np.int64))


def labelled_sample(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", most_labelled: int = MOST_LABELLED) -> DataFrame:
    """``id`` and ``label`` of the rows of the fit: at most ``most_labelled`` ids, the first by a hash."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    return known.orderBy(F.xxhash64("id"), "id").limit(most_labelled)


def _histograms(features: DataFrame, views: list[View]) -> list[np.ndarray]:
    """The unlabelled rows by the logit of each view, in BINS bins: one aggregation."""
    spark = features.sparkSession
    shared = spark.sparkContext.broadcast(views)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * BINS, np.int64)
        for batch in batches:
            for v, x in enumerate(_matrices(batch)):
                total[v * BINS : (v + 1) * BINS] += np.bincount(logit_bins(shared.value[v].logit(x)), minlength=BINS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    small_batches(spark)
    got = features.filter("label < 0").select("text_f", "meta_f").mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 * BINS, np.int64)
    out[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return [out[:BINS], out[BINS:]]


def _taught_sums(features: DataFrame, views: list[View], bounds: list[Bounds], pupils: list[Logistic]) -> list[list[tuple]]:
    """For each pupil and label: number, gradient and curvature over all unlabelled rows beyond the other view's bounds.
    Tasks send the entries that aren't zero; their number is bounded by the size of the models."""
    spark = features.sparkSession
    shared, sizes = spark.sparkContext.broadcast((views, bounds, pupils)), [len(m.w) for m in pupils]
    parts = [1 + s + s * s for s in sizes for _ in (0, 1)]
    starts = np.cumsum([0, *parts])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views, bounds, pupils = shared.value
        total = np.zeros(starts[-1])
        for batch in batches:
            rows = _matrices(batch)
            for v, pupil in enumerate(pupils):
                for label, sure in enumerate(taught_rows(views[1 - v].logit(rows[1 - v]), views[v].logit(rows[v]), bounds[1 - v])):
                    if sure.any():
                        gradient, curvature = pupil.sums(rows[v][sure], float(label))
                        at = starts[2 * v + label]
                        total[at : at + parts[2 * v + label]] += np.r_[sure.sum(), gradient, curvature.ravel()]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int64()), "value": pa.array(total[at], pa.float64())})

    small_batches(spark)
    got = features.filter("label < 0").select("text_f", "meta_f").mapInArrow(add, "at bigint, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    total = np.zeros(starts[-1])
    total[got.column("at").to_numpy()] = got.column("value").to_numpy()
    out = []
    for v, size in enumerate(sizes):
        pieces = [total[starts[2 * v + label] : starts[2 * v + label + 1]] for label in (0, 1)]
        out.append([(int(round(x[0])), x[1 : 1 + size], x[1 + size :].reshape(size, size)) for x in pieces])
    return out


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = ("lang", "source", "n_chars"), label_col: str = "quality", most_labelled: int = MOST_LABELLED, rounds: int = ROUNDS) -> CoTrained:
    """Fit on at most ``most_labelled`` labelled documents, a fifth of which is kept for the calibration, and on all
    unlabelled ones. Of rows of one labelled id one is taken. Without labels every score is the same; so it is for an empty table. Null texts are empty, nulls
    in the metadata values of their own, rows of a null id unlabelled; repeated unlabelled rows are taught each; further columns are ignored."""
    sample, n = labelled_sample(labels, id_col, label_col, most_labelled), len(meta_cols)
    rows = docs.select(*_columns(docs, text_col, meta_cols), F.col(f"`{id_col}`").alias("id")).join(F.broadcast(sample), "id", "left")  # bounded by most_labelled
    id_type = docs.schema[id_col].dataType.simpleString()
    fold = (F.xxhash64("id", F.lit("fold")) % 5 == 0).cast("int")
    rows = rows.select("text", *(f"m{i}" for i in range(n)), F.coalesce("label", F.lit(-1)).alias("label"), fold.alias("fold"), "id")

    def featured(batch):
        text_f, meta_f = _features(batch, n)
        return {"text_f": text_f, "meta_f": meta_f} | {c: batch.column(1 + n + i) for i, c in enumerate(("label", "fold", "id"))}

    features, path = persist_table(map_rows(rows, featured, f"text_f array<float>, meta_f array<int>, label int, fold int, id {id_type}"))
    mine = features.filter("label >= 0").groupBy("id").agg(F.min(F.struct("text_f", "meta_f", "label", "fold")).alias("r"))
    known = mine.select("r.*").orderBy("label", "fold", "text_f", "meta_f").toArrow()  # at most most_labelled rows
    text, meta = _matrices(known)
    y, held = known.column("label").to_numpy().astype(float), known.column("fold").to_numpy() == 1
    model = CoTrained((text[~held], meta[~held], y[~held]), (text[held], meta[held], y[held]), lambda views: _histograms(features, views), lambda *x: _taught_sums(features, *x), rounds)
    drop_table(docs.sparkSession, path)
    return model


def score_quality(docs: DataFrame, model: CoTrained, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = ("lang", "source", "n_chars"), least: float = 0.5) -> DataFrame:
    """Per row of ``docs``: the id, ``score`` (probability of good quality by both views), ``text_score``, ``meta_score`` and
    ``keep`` (score >= least).

    Null texts count as empty, and a null in the metadata is a value of its own; an empty text is scored by its features
    like any other; a null id stays null; repeated rows are scored each; an empty table gives no rows; further columns are
    ignored, whatever their names.
    """
    n, id_type = len(meta_cols), docs.schema[id_col].dataType.simpleString()
    rows = docs.select(*_columns(docs, text_col, meta_cols), F.col(f"`{id_col}`").alias("id"))
    score = _scorer(docs, model, n)
    scored = map_rows(rows, lambda batch: {"id": batch.column(1 + n)} | score(batch), f"id {id_type}, score double, text_score double, meta_score double")
    return scored.withColumn("keep", F.col("score") >= least).withColumnRenamed("id", id_col)


def _scorer(docs: DataFrame, model: CoTrained, n: int):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batch):
        text, meta = _features(batch, n)
        both, a, b = shared.value.score(np.array(text).reshape(-1, TEXT_SIZE), meta_matrix(np.array(meta, np.int64).reshape(len(meta), -1)))
        return {"score": both.tolist(), "text_score": a.tolist(), "meta_score": b.tolist()}

    return score


def keep_good(docs: DataFrame, model: CoTrained, text_col: str = "text", meta_cols: tuple[str, ...] = ("lang", "source", "n_chars"), least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``, with their columns as they are, whatever their names. Null and empty texts, nulls in the
    metadata and in ids, and repeated rows are scored as in ``score_quality``; an empty table stays empty."""
    score, name = _scorer(docs, model, len(meta_cols)), free_name(docs, "score")
    scored = add_columns(docs, _columns(docs, text_col, meta_cols), lambda batch: {name: score(batch)["score"]}, f"{name} double")
    return scored.filter(F.col(name) >= least).select(*(F.col(f"`{c}`") for c in docs.columns))
