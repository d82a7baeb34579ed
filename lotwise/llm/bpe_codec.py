"""Byte-level BPE encoding and decoding by merge ranks, with a segment tree over byte positions.

The leaf of a position holds the rank of the pair that starts there; each inner node holds the least rank below it, and
a search that prefers the left child finds the leftmost pair of least rank. A merge changes the pairs of two live
neighbours, so it costs a logarithmic number of node updates, and a piece of n bytes costs O(n log n).
"""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_count import CACHE
from .common import map_rows, texts_of, worker_state

NO_PAIR = 1 << 60
#: Characters of the longest piece that a worker remembers; with CACHE this bounds the bytes that it keeps.
LONGEST = 64

#: The same in arrays.
NONE = np.int32(2**31 - 1)


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank of each line of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class PairTree:
    """Least pair rank over positions, leftmost first."""

    def __init__(self, ranks: list[int]):
        self.size = size = 1 << max(0, (len(ranks) - 1).bit_length())
        self.node = node = [NO_PAIR] * size + ranks + [NO_PAIR] * (size - len(ranks))
        for i in range(size - 1, 0, -1):
            a, b = node[2 * i], node[2 * i + 1]
            node[i] = a if a <= b else b

    def set(self, at: int, rank: int) -> None:
        node, i = self.node, at + self.size
        node[i] = rank
        while i > 1:
            i >>= 1
            a, b = node[2 * i], node[2 * i + 1]
            least = a if a <= b else b
            if node[i] == least:
                break
            node[i] = least

    def first_least(self) -> int:
        """The leftmost position of the least rank, or -1 where no pair is left."""
        node, i = self.node, 1
        least = node[1]
        if least == NO_PAIR:
            return -1
        while i < self.size:
            i *= 2
            if node[i] != least:
                i += 1
        return i - self.size


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match of the pattern."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # of the live part that starts at a position, also the start of the next one
    before = list(range(-1, n - 1))
    rank_of = lambda i: ranks.get(piece[i : end[end[i]]], NO_PAIR) if end[i] < n else NO_PAIR
    tree = PairTree([rank_of(i) for i in range(n)])
    while (i := tree.first_least()) >= 0:
        j = end[i]
        end[i] = k = end[j]
        if k < n:
            before[k] = i
        tree.set(j, NO_PAIR)
        tree.set(i, rank_of(i))
        if (h := before[i]) >= 0:
            tree.set(h, rank_of(h))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class PairTable:
    """Ranks of pairs of ids, for arrays: the merged bytes of a pair are a token, and its id is the rank."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.key = np.array(sorted(pairs), dtype=np.int64)
        self.rank = np.array([pairs[k] for k in self.key.tolist()], dtype=np.int32)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        want = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[at] == want, self.rank[at], NONE)


def encode_pieces(pieces: list[bytes], size: int, pair: PairTable) -> list[bytes]:
    """Ids of pieces of 2 to ``size`` bytes (a power of two), all at once: one segment tree a row, one merge a row and step."""
    rows = len(pieces)
    n = np.fromiter(map(len, pieces), np.int32, rows)
    raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(rows, size)
    width = size + 1  # the last column stands for the end
    token = np.zeros((rows, width), np.int32)
    token[:, :size] = pair.byte[raw]
    live = np.zeros((rows, width), bool)
    live[:, :size] = np.arange(size) < n[:, None]
    after = np.minimum(np.arange(1, width + 1), n[:, None]).astype(np.int32)
    before = np.broadcast_to(np.arange(-1, size, dtype=np.int32), (rows, width)).copy()
    tree = np.full((rows, 2 * size), NONE, np.int32)
    leaf = pair(token[:, : size - 1], token[:, 1:size])
    leaf[np.arange(1, size) >= n[:, None]] = NONE
    tree[:, size : 2 * size - 1] = leaf
    level = size // 2
    while level:
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        level //= 2
    token_, live_, after_, before_, tree_ = (x.reshape(-1) for x in (token, live, after, before, tree))
    row = np.arange(rows)
    while True:
        least = tree_[row * (2 * size) + 1]
        keep = least != NONE
        row, least = row[keep], least[keep]
        if not len(row):
            break
        at, flat = row * (2 * size), row * width
        node = np.ones(len(row), np.int64)
        while node[0] < size:  # all nodes are on one level
            node *= 2
            node += tree_[at + node] != least
        i = node - size
        j = after_[flat + i]
        k = after_[flat + j]
        h = before_[flat + i]
        token_[flat + i] = least
        live_[flat + j] = False
        after_[flat + i] = k
        before_[flat + k] = i
        tree_[at + size + j] = NONE
        tree_[at + size + i] = np.where(live_[flat + k], pair(least, token_[flat + k]), NONE)
        has = h >= 0
        tree_[(at + size + h)[has]] = pair(token_[(flat + h)[has]], least[has])
        nodes = [size + i, size + j, np.where(has, size + h, size + i)]
        level = size
        while level > 1:
            level //= 2
            for x in nodes:
                x >>= 1
                tree_[at + x] = np.minimum(tree_[at + 2 * x], tree_[at + 2 * x + 1])
    ends = np.cumsum(live.sum(1)) * 4
    flat_ids = token[live].astype("<u4").tobytes()
    return [flat_ids[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]


class Codec:
    """Encodes texts to little-endian 32-bit ids and decodes them. Words between single spaces are encoded once."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.pair = PairTable(ranks)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        self.known: dict[str, bytes] = {}

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Encode pieces that aren't known yet. Those of up to LONGEST characters are remembered; longer ones are returned."""
        if len(self.known) + len(pieces) > CACHE:
            self.known.clear()
        by_size: dict[int, list[str]] = {}
        long: dict[str, bytes] = {}
        for p in pieces:
            raw = p.encode("utf-8")
            keep = self.known if len(p) <= LONGEST else long
            if raw in self.ranks:
                keep[p] = struct.pack("<I", self.ranks[raw])
            elif len(raw) > 64:
                ids = encode_piece(raw, self.ranks)
                keep[p] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                by_size.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append(p)
        for size, group in by_size.items():
            for start in range(0, len(group), 4096):
                part = group[start : start + 4096]
                self.known.update(zip(part, encode_pieces([p.encode("utf-8") for p in part], size, self.pair), strict=True))
        return long

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. A single space between two other characters always starts a piece, so texts are cut there."""
        cut = [text.split(" ") for text in texts]
        new: set[str] = set()
        for words in cut:
            new.update(words[1:])
        joined: dict[str, list[str]] = {}  # words of several pieces
        pieces: set[str] = set()
        uneven = {w for w in new if not w or w[0].isspace() or w[-1].isspace()}
        for w in new - uneven:
            if w.isalpha():
                pieces.add(" " + w)
            else:
                joined[w] = self.split(" " + w)
                pieces.update(joined[w])
        whole = [len(words) == 1 or not words[0] or words[0][-1].isspace() or bool(uneven and not uneven.isdisjoint(words)) for words in cut]
        heads = [self.split(text if w else words[0]) for text, words, w in zip(texts, cut, whole, strict=True)]
        for head in heads:
            pieces.update(head)
        if len(self.known) + len(pieces) > CACHE:
            self.known.clear()
        long, known = self.learn(pieces.difference(self.known)), self.known
        ids_of = (lambda p: known[p] if p in known else long[p]) if long else known.__getitem__
        of = {w: ids_of(" " + w) for w in new - uneven if w not in joined} | {w: b"".join(map(ids_of, p)) for w, p in joined.items()}
        return [b"".join(map(ids_of, head)) + (b"" if w else b"".join(map(of.__getitem__, words[1:]))) for head, words, w in zip(heads, cut, whole, strict=True)]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, struct.unpack(f"<{len(ids) // 4}I", ids)))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Per row of ``docs``: the id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if ``keep_ids``, the ids themselves
    as ``token_ids`` (array<int>).

    The pattern must start a match at each single space between two other characters and take no white space after it,
    as the patterns of byte-level vocabularies do. Null and empty texts have no ids; a null id column stays null;
    repeated rows are encoded each; an empty table gives no rows; further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    id_type = docs.schema[id_col].dataType.simpleString()

    def encode(batch):
        codec = worker_state(("codec", ranks_path, pattern), lambda: Codec(shared.value, pattern))
        coded = codec.encode_all(texts_of(batch.column(1)))
        out = {
            "id": batch.column(0),
            "n_tokens": [len(b) // 4 for b in coded],
            "ids_sha256": [hashlib.sha256(b).hexdigest() for b in coded],
            "decoded_sha256": [hashlib.sha256(codec.decode(b)).hexdigest() for b in coded],
        }
        if keep_ids:
            out["token_ids"] = [list(struct.unpack(f"<{len(b) // 4}I", b)) for b in coded]
        return out

    schema = f"id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * keep_ids
    out = map_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), encode, schema)
    return out.withColumnRenamed("id", id_col)
