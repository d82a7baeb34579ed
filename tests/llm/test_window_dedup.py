"""Removal of repeated byte windows against brute force over all windows, and in edge cases."""

import hashlib
import random

import numpy as np
import pytest

from lotwise.llm import window_dedup
from lotwise.llm.window_dedup import WINDOW, remove_repeated_windows

DOCS = "doc_id bigint, text string, lang string, slice bigint, ids int, marks string"


def expected(rows):
    least = {}
    raw = [(i, (t or "").encode()) for i, t in rows]
    for i, b in raw:
        if i is not None:
            for p in range(len(b) - WINDOW + 1):
                w = b[p : p + WINDOW]
                least[w] = min(i, least.get(w, i))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - WINDOW + 1):
            m = least.get(b[p : p + WINDOW])
            if m is not None and (i is None or m < i):
                gone[p : p + WINDOW] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        edges = np.flatnonzero(np.diff(np.r_[False, gone, False])).reshape(-1, 2)
        out.append((i, len(b), int(gone.sum()), len(edges), ",".join(f"{x}:{y}" for x, y in edges), hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


def got(spark, rows, parts=3):
    docs = spark.createDataFrame([(i, t, "en", 1, 2, "x") for i, t in rows], DOCS).repartition(parts)
    found = remove_repeated_windows(docs, with_kept=True).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.spans, r.kept_sha256, bytes(r.kept)) for r in found), key=str)


def odd_rows(seed, n=60):
    rnd = random.Random(seed)
    letters = "abcdefghij klmnop éü日"
    fresh = lambda k: "".join(rnd.choices(letters, k=k))
    passages = [fresh(rnd.choice((20, 45, 49, 50, 51, 60, 120, 400))) for _ in range(12)] + ["ab" * 60, "-" * 130, "é" * 30]
    rows = []
    for i in range(n):
        text = "".join(rnd.choice((fresh(rnd.randint(0, 90)), rnd.choice(passages))) for _ in range(rnd.randint(0, 8)))
        if rows and rnd.random() < 0.15:
            text = rnd.choice(rows)[1] or ""
        if text and rnd.random() < 0.2:
            cut = rnd.randrange(len(text))
            text = text[:cut] + rnd.choice(letters) + text[cut + 1 :]
        rows.append((rnd.choice((i, i, i, i - 1, None)) if i % 7 == 0 else i, text))
    rnd.shuffle(rows)
    return [*rows, (999, None), (998, ""), (0, "x" * 49), (997, "x" * 50), (996, "x" * 51), (None, "x" * 200), (5, "z" * 300), (4, "z" * 300)]


@pytest.mark.parametrize("seed", range(3))
def test_against_all_windows(spark, seed):
    rows = odd_rows(seed)
    assert got(spark, rows) == expected(rows)


@pytest.mark.parametrize(("slice_bytes", "many", "part"), [(300, 2000, 40), (1 << 20, 2, 7), (300, 1, 1000), (1, 3, 1)])
def test_slices_and_single_suffixes_change_nothing(spark, monkeypatch, slice_bytes, many, part):
    monkeypatch.setattr(window_dedup, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(window_dedup, "MANY_PIECES", many)
    monkeypatch.setattr(window_dedup, "PART_SUFFIXES", part)
    rows = odd_rows(7)
    assert got(spark, rows) == expected(rows)


def test_a_line_in_all_texts_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(window_dedup, "MANY_PIECES", 40)
    rnd = random.Random(1)
    line = "This line is in every one of the texts and says nothing at all about what they are."
    rows = [(i, "".join(rnd.choices("abcdef ", k=60)) + line + "".join(rnd.choices("abcdef ", k=60))) for i in range(120)]
    rows += [(200 + i, "copy " * 40) for i in range(80)]
    assert got(spark, rows) == expected(rows)


def test_different_windows_of_one_digit_are_split_by_their_bytes(spark, monkeypatch):
    """With an anchor hash of two values only the passes over the bytes can tell suffixes apart."""
    monkeypatch.setattr(window_dedup, "anchor_hash", lambda eight: (eight[0] & np.uint64(1)) << np.uint64(63))
    rows = odd_rows(3, 25)
    items = []
    s = lambda i, t: window_dedup.Slice([i], [len(t.encode())], window_dedup.zstandard.compress(t.encode()), 8)
    texts = [(i, t) for i, t in rows if t and i is not None][:20]
    for i, t in texts:
        one = s(i, t)
        all_items = window_dedup.Items(one, np.arange(len(one.pieces.first)), np.zeros(len(one.codes), bool))
        if len(all_items.kept):
            items.append((one, all_items, window_dedup.packed(one, all_items, 0, len(all_items.kept))))
    found = window_dedup.sort_suffixes([(len(it.kept), blob) for _, it, blob in items])
    windows = {}
    for one, _, _ in items:
        for p in range(len(one.data) - WINDOW + 1):
            windows.setdefault(one.data[p : p + WINDOW].tobytes(), set()).add(int(one.id[0]))
    for (one, it, _), flags in zip(items, found, strict=True):
        at = np.concatenate([np.arange(it.first[k], it.last[k] + 1) for k in it.kept])
        assert [min(windows[one.data[p : p + WINDOW].tobytes()]) < one.id[0] for p in at] == flags.tolist()


def test_no_rows(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None)]) == expected([(1, None)])
