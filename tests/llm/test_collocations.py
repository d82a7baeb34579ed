"""Phrase collocations against brute force over all phrases, and in edge cases."""

import random
import re
from collections import Counter, defaultdict

import pytest

from lotwise.llm import collocations
from lotwise.llm.collocations import mine_collocations

DOCS = "doc_id bigint, text string, lang string, phrase string, n int, a int, score double, k int"


def expected(rows, longest=3, least=10, hiding=50, most=2000):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = {}
    for lang, f in counts.items():
        found = []
        big = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        for p, a in big.items():
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and 100 * b >= hiding * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in big.items())
            if not inside:
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:most], 1):
            out[lang, rank] = (p.decode(), -a, left, right, total[lang], -score)
    return out


def got(spark, rows, **settings):
    docs = spark.createDataFrame([(i, t, lang, "x", 1, 2, 0.5, 3) for i, (t, lang) in enumerate(rows)], DOCS)
    found = mine_collocations(docs, **settings).collect()
    out = {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in found}
    assert len(out) == len(found)
    return out


def texts(seed, n, words=30):
    rnd = random.Random(seed)
    pool = [f"w{i}" for i in range(words)] + ["Ä", "ä", "É", "TO", "to", "a\x1cb", "\xa0", "x\x85", "日本"]
    fixed = ["red herring", "New York City", "as it were", "to to to to", "in\tspite  of"]
    out = []
    for _ in range(n):
        parts = [rnd.choice(fixed) if rnd.random() < 0.2 else rnd.choice(pool[: rnd.choice((5, len(pool)))]) for _ in range(rnd.randint(0, 60))]
        out.append(("".join(p + rnd.choice((" ", " ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\x0b", "!?")) for p in parts), rnd.choice(("en", "de", None, "und", ""))))
    return out


@pytest.mark.parametrize("settings", [{}, {"longest": 2}, {"longest": 4, "least": 5}, {"hiding": 90, "most": 7}, {"least": 1, "longest": 3}])
def test_against_all_phrases(spark, settings):
    rows = texts(1, 250) + [(None, "en"), ("", None), ("\n \t", "fr"), ("one", "fr"), ("again and again " * 500, "en")] + [("the same line of text", "en")] * 200
    assert got(spark, rows, **settings) == expected(rows, **settings)


def test_small_tasks_tables_and_bitmaps_change_nothing(spark, monkeypatch):
    rows = texts(2, 150)
    for name, value in (("TASK_WORDS", 50), ("TASK_DISTINCT", 20), ("TASK_LANGUAGES", 1), ("GIVEN_ROWS", 3)):
        monkeypatch.setattr(collocations, name, value)
    assert got(spark, rows) == expected(rows)


def test_full_bitmap_lets_everything_through_and_the_counts_decide(spark, monkeypatch):
    rows = texts(3, 150)
    monkeypatch.setattr(collocations, "frequent_bits", lambda level: collocations.Bits(15, collocations.np.full(4096, 255, collocations.np.uint8)))
    assert got(spark, rows) == expected(rows)


def test_large_counts_are_exact(spark):
    big = 3_000_000_019
    level = lambda rows: spark.createDataFrame([("en", p, n) for p, n in rows], "lang string, phrase string, n bigint")
    (r,) = collocations.scored_cuts([level([("a", big + 7), ("b", big * 3)]), level([("a b", big)])]).collect()
    assert r.score == 1_000_000 * big * big // ((big + 7) * big * 3) and (r.a, r.l, r.r) == (big, big + 7, 3 * big)


def test_no_rows_and_no_frequent_phrase(spark):
    assert got(spark, []) == {}
    assert got(spark, [("one two three", "en"), (None, None)]) == {}
