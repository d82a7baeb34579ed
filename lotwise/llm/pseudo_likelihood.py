"""Masked pseudo-likelihood of documents under a bidirectional window network.

The network sees the two words before and the two words after a masked one and gives a distribution over the most frequent
words and over groups of the others, in two steps: classes of outputs of like frequency, then the outputs of the class. A
word of a group has its share of the group's count in all *other* documents (so what only one document says is not made
likely by itself); these counts are a table of all words of the corpus, joined to the documents. A document's score is the
sum of the log-probabilities of all its words, each predicted from both sides.

The network is trained in numpy on every position of every document: copies from a common start are trained on shards of
the corpus and averaged, row by row, in a shuffle. Which shard a document is in, and its place there, follow from hashes
of the row and from the size of the corpus, so the network doesn't depend on how files are split or on the number of
executors.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, persist_table, slices, small_batches, texts_of

#: Outputs: the most frequent words, and groups of all others by their last two letters. The first one is the edge of a text.
WORDS, RARE = 1792, 256
VOCABULARY = WORDS + RARE
CLASSES = 32
IN_CLASS = VOCABULARY // CLASSES
RADIUS, DIM, HIDDEN = 2, 8, 16
ROUNDS, BATCH, STEP = 2, 8192, 0.25
#: Words that a task counts before it sends them on.
COUNT_MOST = 400_000
#: What is added to the count of each word of a group, seen elsewhere or not.
ADDED = 0.5
#: Text that one copy of the network is trained on in all rounds together.
SHARD_BYTES = 32 << 20
MARKS = ".,;:!?()\""
PARTS = {"embed": (VOCABULARY, DIM), "mix": (2 * RADIUS * DIM, HIDDEN), "mix_bias": (1, HIDDEN), "of_class": (CLASSES, HIDDEN), "class_bias": (CLASSES, 1), "of_word": (VOCABULARY, HIDDEN), "word_bias": (VOCABULARY, 1)}


def words_of(text: str) -> list[str]:
    """Lower-case words; the usual marks stand alone."""
    text = text.lower()
    for mark in MARKS:
        if mark in text:
            text = text.replace(mark, f" {mark} ")
    return text.split()


class Endings(dict):
    """Outputs of the groups that rarer words fall into, by their last two letters."""

    def __missing__(self, end: str) -> int:
        number = WORDS + sum(ord(c) * 31**i for i, c in enumerate(end)) % RARE
        if len(self) < 100_000:
            self[end] = number
        return number


class Vocabulary:
    """Word to output: the frequent words have one each, the others that of their ending's group."""

    def __init__(self, words: list[str]):
        self.words, self.endings = words[: WORDS - 1], Endings()
        self.number = {w: i + 1 for i, w in enumerate(self.words)}

    def numbers(self, text: str) -> np.ndarray:
        return self.split_numbers(text)[0]

    def split_numbers(self, text: str) -> tuple[np.ndarray, list[str]]:
        """Outputs of all words, and the words that are in groups, in order."""
        words = words_of(text)
        found = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        at = np.flatnonzero(found < 0)
        rare, endings = [words[i] for i in at.tolist()], self.endings
        found[at] = [endings[w[-2:]] for w in rare]
        return found, rare


def word_hashes(words: list[str]) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False).view(np.int64) if words else np.zeros(0, np.int64)


def start_network(seed: int = 3) -> dict[str, np.ndarray]:
    rnd = np.random.default_rng(seed)
    return {k: (rnd.normal(0, 0.1, shape) if "bias" not in k else np.zeros(shape)).astype(np.float32) for k, shape in PARTS.items()}


def windows(numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Contexts (positions x 2 RADIUS) and targets of all positions of some texts; beyond a text's ends stands number 0."""
    gap = np.zeros(RADIUS, np.int64)
    joined = np.concatenate([x for n in numbers for x in (n, gap)]) if numbers else gap
    padded = np.concatenate([gap, joined])
    real = np.concatenate([np.r_[np.ones(len(n), bool), np.zeros(RADIUS, bool)] for n in numbers]) if numbers else np.zeros(RADIUS, bool)
    at = np.flatnonzero(real) + RADIUS
    return np.stack([padded[at + s] for s in (*range(-RADIUS, 0), *range(1, RADIUS + 1))], 1), padded[at]


def hidden(net: dict, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.take(net["embed"], context.ravel(), axis=0).reshape(len(context), -1)
    h = x @ net["mix"]
    h += net["mix_bias"]
    return x, np.tanh(h, out=h)


def reach(net: dict) -> float:
    """The greatest absolute value that an output can have before the exponential: hidden values are below 1."""
    return max(float((np.abs(net[f"of_{k}"]).sum(1) + np.abs(net[f"{k}_bias"][:, 0])).max()) for k in ("class", "word"))


def softmax(z: np.ndarray, bounded: bool) -> np.ndarray:
    """``bounded``: no entry can overflow an exponential."""
    if not bounded:
        z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z *= 1 / (z @ np.ones((z.shape[1], 1), z.dtype))
    return z


def log_softmax_at(z: np.ndarray, column: np.ndarray, bounded: bool) -> np.ndarray:
    """Log-probability of one column a row; ``bounded``: no entry can overflow an exponential."""
    if not bounded:
        z -= z.max(1, keepdims=True)
    at = z[np.arange(len(z)), column]
    np.exp(z, out=z)
    return at - np.log(z.sum(1))


def log_probabilities(net: dict, context: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log-probability of each masked target given both sides."""
    order = np.argsort(target.astype(np.int16), kind="stable")  # so that the words of a class stand together
    context, target = context[order], target[order]
    classes, word = target // IN_CLASS, target % IN_CLASS
    mix = net["mix"].reshape(2 * RADIUS, DIM, HIDDEN)
    h = np.take(net["embed"] @ mix[0] + net["mix_bias"], context[:, 0], axis=0)  # what each place adds to the hidden layer, by word
    for place in range(1, 2 * RADIUS):
        h += np.take(net["embed"] @ mix[place], context[:, place], axis=0)
    np.tanh(h, out=h)
    bounded = reach(net) < 80
    found = log_softmax_at(h @ net["of_class"].T + net["class_bias"].T, classes, bounded)
    of_word, bias = net["of_word"].reshape(CLASSES, IN_CLASS, HIDDEN), net["word_bias"].reshape(CLASSES, IN_CLASS)
    cuts = np.searchsorted(classes, np.arange(CLASSES + 1))
    for c in range(CLASSES):
        part = slice(cuts[c], cuts[c + 1])
        if cuts[c] < cuts[c + 1]:
            found[part] += log_softmax_at(h[part] @ of_word[c].T + bias[c], word[part], bounded)
    out = np.empty(len(found))
    out[order] = found
    return out


class Trainer:
    """Adagrad on a copy of the network; ``touched`` counts how often each row of a part was trained."""

    def __init__(self, net: dict):
        self.net = {k: v.copy() for k, v in net.items()}
        self.square = {k: np.full(v.shape, 1e-3, np.float32) for k, v in net.items()}
        self.touched = {k: np.zeros(len(v)) for k, v in net.items()}

    def _apply(self, part: str, grad: np.ndarray) -> None:
        self.square[part] += grad * grad
        self.net[part] -= STEP * grad / np.sqrt(self.square[part])

    def step(self, context: np.ndarray, target: np.ndarray) -> None:
        net, n = self.net, np.float32(len(target))
        order = np.argsort(target.astype(np.int16), kind="stable")  # so that the outputs of a class stand together
        context, target, bounded = context[order], target[order], reach(net) < 80
        x, h = hidden(net, context)
        classes, word, rows = target // IN_CLASS, target % IN_CLASS, np.arange(len(target))
        error = softmax(h @ net["of_class"].T + net["class_bias"].T, bounded)
        error[rows, classes] -= 1
        back = error @ net["of_class"]
        grads = {"of_class": error.T @ h / n, "class_bias": error.sum(0)[:, None] / n, "of_word": np.zeros_like(net["of_word"]), "word_bias": np.zeros_like(net["word_bias"])}
        cuts = np.searchsorted(classes, np.arange(CLASSES + 1))
        for c in np.flatnonzero(np.diff(cuts)).tolist():
            part, mine = slice(c * IN_CLASS, (c + 1) * IN_CLASS), slice(cuts[c], cuts[c + 1])
            e = softmax(h[mine] @ net["of_word"][part].T + net["word_bias"][part].T, bounded)
            e[rows[: len(e)], word[mine]] -= 1
            back[mine] += e @ net["of_word"][part]
            grads["of_word"][part] = e.T @ h[mine] / n
            grads["word_bias"][part] = e.sum(0)[:, None] / n
        back *= 1 - h * h
        down, flat = (back @ net["mix"].T).reshape(-1, DIM) / n, context.ravel()
        grads |= {"mix": x.T @ back / n, "mix_bias": back.sum(0)[None, :] / n}
        grads["embed"] = np.stack([np.bincount(flat, down[:, d], VOCABULARY) for d in range(DIM)], 1).astype(np.float32)
        for part, grad in grads.items():
            self._apply(part, grad)
        hits = np.bincount(target, minlength=VOCABULARY)
        for part, seen in (("embed", np.bincount(flat, minlength=VOCABULARY)), ("of_word", hits), ("word_bias", hits)):
            self.touched[part] += seen
        for part in ("of_class", "class_bias", "mix", "mix_bias"):
            self.touched[part] += len(target)


def corpus_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``word``, ``n`` (its number in all texts) and ``h`` (its hash), as a stored table: counted in the tasks, summed in a shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for part in slices(batch, 256):
                for text in texts_of(part.column(0)):
                    seen.update(words_of(text))
                if len(seen) > COUNT_MOST:
                    yield counted(seen)
                    seen.clear()
        if seen:
            yield counted(seen)

    def counted(seen):
        return pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    small_batches(docs.sparkSession)
    counts = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    hashed = map_rows(counts, lambda batch: {"word": batch.column(0), "n": batch.column(1), "h": word_hashes(texts_of(batch.column(0))).tolist()}, "word string, n bigint, h bigint", slice_rows=4096)
    return persist_table(hashed)[0]


def corpus_vocabulary(words: DataFrame) -> Vocabulary:
    """The most frequent words; only they come to the driver."""
    return Vocabulary([r["word"] for r in words.orderBy(F.desc("n"), "word").limit(WORDS - 1).collect()])


def shard_count(docs: DataFrame, text_col: str, shard_bytes: int = SHARD_BYTES) -> int:
    return max(1, -(-(docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // shard_bytes))


def encoded_documents(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A stored table of the rows of ``docs``: ``row`` (a number of its own), ``id``, ``turn`` (the round that it trains), ``order``
    (a hash that gives its place in training), ``numbers`` (the outputs of its words, two bytes each), and ``h`` and ``k``: for
    each different word of a group its hash and its number in the row. Texts are split here once for training and scoring."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    own, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    rows = docs.select(text.alias("text"), own.alias("id"), F.pmod(F.xxhash64(own, F.lit(1)), F.lit(ROUNDS)).cast("int").alias("turn"), F.xxhash64(own, text).alias("order"))

    def encode(batch):
        both = [shared.value.split_numbers(t) for t in texts_of(batch.column(0))]
        at = np.repeat(np.arange(len(both)), [len(words) for _, words in both])
        h = word_hashes([w for _, words in both for w in words])
        order = np.lexsort((h, at))
        h, at = h[order], at[order]
        first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (at[1:] != at[:-1])]) if len(h) else np.zeros(0, np.int64)
        starts = pa.array(np.searchsorted(at[first], np.arange(len(both) + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(starts, pa.array(x)) for x in (h[first], np.diff(np.r_[first, len(h)]).astype(np.int32))]
        return {"id": batch.column(1), "turn": batch.column(2), "order": batch.column(3), "numbers": [n.astype(np.int16).tobytes() for n, _ in both], "h": lists[0], "k": lists[1]}

    id_type = docs.schema[id_col].dataType.simpleString()
    made = map_rows(rows, encode, f"id {id_type}, turn int, order bigint, numbers binary, h array<bigint>, k array<int>", slice_rows=256)
    return persist_table(made.withColumn("row", F.monotonically_increasing_id()))[0]


def numbers_of(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(b, np.int16).astype(np.int64) for b in column.to_pylist()]


def train_round(encoded: DataFrame, net: dict, turn: int, shards: int = 1) -> dict:
    """One round of training over the encoded documents whose hash falls into it; returns the average of the shards' networks."""
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(net)
    rows = encoded.filter(F.col("turn") == turn).select("numbers", "order")
    rows = rows.repartitionById(shards, F.pmod(F.col("order"), F.lit(shards)).cast("int")).sortWithinPartitions("order")
    starts = np.cumsum([0, *(s[0] for s in PARTS.values())])
    width = max(s[1] for s in PARTS.values())

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, rest = Trainer(shared.value), []
        waiting = 0

        def learn(all_of_it: bool) -> int:
            context = np.concatenate([c for c, _ in rest]) if rest else np.zeros((0, 2 * RADIUS), np.int64)
            target = np.concatenate([t for _, t in rest]) if rest else np.zeros(0, np.int64)
            rest.clear()
            stop = len(target) if all_of_it else len(target) - len(target) % BATCH
            for a in range(0, stop, BATCH):
                trainer.step(context[a : a + BATCH], target[a : a + BATCH])
            if stop < len(target):
                rest.append((context[stop:], target[stop:]))
            return len(target) - stop

        for batch in batches:
            for part in slices(batch, 256):
                rest.append(windows(numbers_of(part.column(0))))
                waiting += len(rest[-1][1])
                if waiting >= 4 * BATCH:
                    waiting = learn(False)
        learn(True)
        for k, (name, shape) in enumerate(PARTS.items()):
            used = np.flatnonzero(trainer.touched[name])
            if len(used):
                weight = trainer.touched[name][used]
                values = np.zeros((len(used), width))
                values[:, : shape[1]] = trainer.net[name][used] * weight[:, None]
                columns = {"row": pa.array(used + starts[k], pa.int64()), "weight": pa.array(weight, pa.float64())}
                yield pa.RecordBatch.from_pydict(columns | {f"v{i}": pa.array(values[:, i], pa.float64()) for i in range(width)})

    names = [f"v{i}" for i in range(width)]
    copies = rows.select("numbers").mapInArrow(train, "row bigint, weight double, " + ", ".join(f"{n} double" for n in names))
    sums = copies.groupBy("row").agg(F.sum("weight").alias("weight"), *(F.sum(n).alias(n) for n in names)).collect()  # a row a weight row, whatever the input
    out = {k: v.copy() for k, v in net.items()}
    parts = list(PARTS.items())
    for r in sums:
        k = int(np.searchsorted(starts, r["row"], side="right")) - 1
        name, shape = parts[k]
        out[name][r["row"] - starts[k]] = [r[f"v{i}"] / r["weight"] for i in range(shape[1])]
    return out


class Model:
    """A vocabulary, a network, and the counts of the words of all groups: ``counts`` is a stored table (``h``, ``n``)."""

    def __init__(self, vocabulary: Vocabulary, net: dict, counts: DataFrame, group_size: np.ndarray, group_words: np.ndarray):
        self.vocabulary, self.net, self.counts, self.group_size, self.group_words = vocabulary, net, counts, group_size, group_words


def group_counts(words: DataFrame, vocabulary: Vocabulary) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Counts of the words outside the vocabulary by their hash, and of each group the sum and the number of its words."""
    shared = words.sparkSession.sparkContext.broadcast(vocabulary)

    def grouped(batch):
        number, endings = shared.value.number, shared.value.endings
        found = [-1 if w in number else endings[w[-2:]] - WORDS for w in texts_of(batch.column(0))]
        return {"grp": found, "h": batch.column(1), "n": batch.column(2)}

    rare = map_rows(words.select("word", "h", "n"), grouped, "grp int, h bigint, n bigint", slice_rows=4096).filter("grp >= 0")
    sums, found = rare.groupBy("grp").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect(), np.zeros((2, RARE))  # a row a group
    for r in sums:
        found[:, r["grp"]] = r["n"], r["words"]
    return words.select("h", "n"), found[0], found[1]


def fit_encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model of all documents, and their encoded table."""
    words = corpus_words(docs, text_col)
    vocabulary = corpus_vocabulary(words)
    encoded = encoded_documents(docs, vocabulary, id_col, text_col)
    net, shards = start_network(), shard_count(docs, text_col)
    for turn in range(ROUNDS):
        net = train_round(encoded, net, turn, shards)
    return Model(vocabulary, net, *group_counts(words, vocabulary)), encoded


def fit_network(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    return fit_encoded(docs, id_col, text_col)[0]


def network_scores(encoded: DataFrame, model: Model) -> DataFrame:
    """Per encoded row: ``row``, ``id``, ``n_words``, ``outputs`` (sum of the log-probabilities of the outputs of its words) and
    ``room`` (sum over its words in groups of the log of their group's count elsewhere)."""
    shared, block = encoded.sparkSession.sparkContext.broadcast((model.net, model.group_size, model.group_words)), 1 << 16

    def score(batch):
        net, group_size, group_words = shared.value
        numbers = numbers_of(batch.column(2))
        context, target = windows(numbers)
        each = np.concatenate([log_probabilities(net, context[a : a + block], target[a : a + block]) for a in range(0, len(target), block)] or [np.zeros(0)])
        length = np.array([len(n) for n in numbers], np.int64)
        row = np.repeat(np.arange(len(numbers)), length)
        grouped = target >= WORDS
        own = np.bincount(row[grouped] * RARE + target[grouped] - WORDS, minlength=len(numbers) * RARE).reshape(-1, RARE)
        room = own * np.log(np.maximum(group_size - own, 0.0) + ADDED * (group_words + 1))
        return {"row": batch.column(0), "id": batch.column(1), "n_words": length.tolist(), "outputs": np.bincount(row, each, len(numbers)).tolist(), "room": room.sum(1).tolist()}

    id_type = encoded.schema["id"].dataType.simpleString()
    return map_rows(encoded.select("row", "id", "numbers"), score, f"row bigint, id {id_type}, n_words bigint, outputs double, room double", slice_rows=256)


def score_encoded(encoded: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """Scores of encoded rows (see ``score_documents``)."""
    # both sides grow with the documents, so this join must not turn into a broadcast at some sizes
    met = encoded.select("row", F.inline(F.arrays_zip("h", "k"))).join(model.counts.hint("shuffle_hash"), "h", "left")
    elsewhere = F.greatest(F.coalesce("n", F.lit(0)) - F.col("k"), F.lit(0)) + ADDED
    within = met.select("row", (F.col("k") * F.log(elsewhere)).cast("float").alias("x")).groupBy("row").agg(F.sum("x").alias("within"))
    both = network_scores(encoded, model).join(within.hint("merge"), "row", "left")
    out = both.select("id", "n_words", (F.col("outputs") - F.col("room") + F.coalesce("within", F.lit(0.0))).alias("log_likelihood"))
    return out.withColumn("per_word", F.col("log_likelihood") / F.nullif(F.col("n_words"), F.lit(0))).withColumnRenamed("id", id_col)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: the id, ``n_words``, ``log_likelihood`` (sum over all words of the log-probability given both
    sides) and ``per_word`` (their mean, null without words).

    ``docs`` are the documents that the model was fitted on, or others, whose words may be new. Null and empty texts have no
    words and a sum of 0; a null id stays null; repeated rows are scored each, as other documents of the same text; an empty
    table gives no rows; further columns are ignored. Texts are scored whole, in blocks of bounded size.
    """
    return score_encoded(encoded_documents(docs, model.vocabulary, id_col, text_col), model, id_col)


def fit_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The scores of documents under the model of all of them, splitting texts once for both."""
    model, encoded = fit_encoded(docs, id_col, text_col)
    return score_encoded(encoded, model, id_col)
