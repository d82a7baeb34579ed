"""Token counts of a byte-level BPE vocabulary by the whole-token shortcut.

Offline, every vocabulary string is merged once; those that end as one token are *proven*. A pre-token that is a proven
string counts as one token without any merging. Only the other pre-tokens are merged.
"""

from __future__ import annotations

import heapq
import json

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, texts_of, worker_state

#: Fixed value: the split of byte-level BPE vocabularies whose pre-tokenizer says use_regex.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Distinct words that a worker remembers before it starts afresh.
CACHE = 300_000

#: Rank of a pair that no merge has.
NEVER = 1 << 60


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    rest = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def merged_length(piece: bytes, ranks: dict[tuple[bytes, bytes], int]) -> int:
    """Tokens of one pre-token. Again and again the leftmost pair of least rank is merged."""
    n = len(piece)
    if n > 48:
        return _merged_length_long(piece, ranks)
    part = [piece[i : i + 1] for i in range(n)]
    rank_of = ranks.get
    rank = [rank_of(pair, NEVER) for pair in zip(part, part[1:], strict=False)]
    while rank and (least := min(rank)) != NEVER:
        i = rank.index(least)
        part[i] += part.pop(i + 1)
        del rank[i]
        if i < len(rank):
            rank[i] = rank_of((part[i], part[i + 1]), NEVER)
        if i:
            rank[i - 1] = rank_of((part[i - 1], part[i]), NEVER)
    return len(part)


def _merged_length_long(piece: bytes, ranks: dict[tuple[bytes, bytes], int]) -> int:
    """The same for long pre-tokens, with a heap of pairs so that n bytes cost O(n log n)."""
    n = len(piece)
    part: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list = []

    def push(i: int, j: int) -> None:
        if (r := ranks.get((part[i], part[j]))) is not None:
            heapq.heappush(heap, (r, i, part[i], part[j]))

    for i in range(n - 1):
        push(i, i + 1)
    left = n
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if part[i] is not None else n
        if j >= n or part[i] != a or part[j] != b:
            continue  # one of the two has been merged since
        part[i], part[j] = a + b, None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            push(i, k)
        if before[i] >= 0:
            push(before[i], i)
        left -= 1
    return left


def load_vocabulary(path: str) -> tuple[dict[tuple[bytes, bytes], int], list[bytes], list[str]]:
    """Merge ranks, vocabulary strings as bytes, and added tokens of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"]
    if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
        raise ValueError("expected byte-level BPE with the usual split, without normalizer or prefix space")
    added = spec.get("added_tokens", [])
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        raise ValueError("added tokens that take in their surroundings are not supported")
    back = {c: b for b, c in byte_alphabet().items()}
    raw = lambda s: bytes(back[c] for c in s)
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
    names = [t["content"] for t in added]
    return ranks, [raw(s) for s in model["vocab"] if s not in names], names


def proven_strings(ranks: dict[tuple[bytes, bytes], int], vocabulary: list[bytes]) -> set[str]:
    """Vocabulary strings that are whole texts and that the merges bring to exactly one token."""
    found = set()
    for piece in vocabulary:
        try:
            text = piece.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if merged_length(piece, ranks) == 1:
            found.add(text)
    return found


class Uneven(Exception):
    """A space of the text stands beside other white space, so the text can't be cut at its spaces."""


class Words(dict):
    """Token counts of words that stand after a single space and before another one or the end."""

    def __init__(self, counter):
        self.counter = counter

    def __missing__(self, word: str) -> int:
        counter = self.counter
        if word.isalpha():  # one pre-token
            n = 1 if (piece := " " + word) in counter.proven else merged_length(piece.encode("utf-8"), counter.ranks)
        elif not word or word[0].isspace() or word[-1].isspace():
            raise Uneven
        else:
            return counter.pieces(" " + word)
        if len(self) >= CACHE:
            self.clear()
        if len(word) < 100:
            self[word] = n
        return n


class TokenCounter:
    """Counts the tokens of texts. A single space between two other characters always starts a pre-token, so a text is
    cut there and each word is split into pre-tokens; the proven ones count one and the rest are merged."""

    def __init__(self, ranks: dict, proven: set[str], added: list[str]):
        self.ranks, self.proven = ranks, proven
        self.split = regex.compile(SPLIT).findall
        self.names = added
        self.added = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.words = Words(self)

    def pieces(self, text: str) -> int:
        total = 0
        for p in self.split(text):
            if p in self.proven:
                total += 1
            elif p[0] == " " and p[1:].isalpha():
                total += self.words[p[1:]]
            else:
                total += merged_length(p.encode("utf-8"), self.ranks)
        return total

    def plain(self, text: str) -> int:
        head, space, tail = text.partition(" ")
        if space and head and not head[-1].isspace():
            try:
                return self.pieces(head) + sum(map(self.words.__getitem__, tail.split(" ")))
            except Uneven:
                pass
        return self.pieces(text)

    def count(self, text: str) -> int:
        if not any(a in text for a in self.names):
            return self.plain(text) if text else 0
        parts = self.added.split(text)
        return sum(self.plain(p) for p in parts if p) + len(parts) - 1


def count_tokens(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: the id, ``n_bytes`` (UTF-8) and ``n_tokens`` of the whole text.

    Null and empty texts have 0 bytes and 0 tokens; a null id stays null; repeated rows are counted each; an empty table
    gives no rows; further columns are ignored. The vocabulary (bounded: one tokenizer file) is broadcast.
    """
    ranks, vocabulary, added = load_vocabulary(vocabulary_path)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, proven_strings(ranks, vocabulary), added))
    id_type = docs.schema[id_col].dataType.simpleString()

    def count(batch):
        counter = worker_state(("count", vocabulary_path), lambda: TokenCounter(*shared.value))
        texts = texts_of(batch.column(1))
        return {"id": batch.column(0), "n_bytes": [len(t.encode("utf-8")) for t in texts], "n_tokens": [counter.count(t) for t in texts]}

    out = map_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), count, f"id {id_type}, n_bytes bigint, n_tokens bigint")
    return out.withColumnRenamed("id", id_col)
