"""The filter audit against brute force over all orders, and in edge cases."""

import itertools
import re
from collections import defaultdict

from lotwise.llm.filter_audit import audit_filters, walk_edges

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, part string, digest int, good string, words int"
LABELS = "doc_id bigint, quality int, toxic int"


def expected(rows, labels):
    """Rows (id, text, source) judged and removed one by one in every order."""
    good, toxic = defaultdict(bool), defaultdict(bool)
    for i, q, t in labels:
        good[i] |= q == 1
        toxic[i] |= t == 1
    judged = []
    for i, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows),
        }
        judged.append((part or "", {k for k, v in fails.items() if v}, i is not None and good[i], i is not None and toxic[i]))
    out, shapley = {}, defaultdict(int)
    for order in itertools.permutations("ABCDE"):
        for part in {j[0] for j in judged}:
            left = [j for j in judged if j[0] == part]
            for step, f in enumerate(order, 1):
                gone = [j for j in left if f in j[1]]
                early = [j for j in judged if j[0] == part and f in j[1] and j not in left]
                left = [j for j in left if f not in j[1]]
                alone = sum(j[0] == part and j[1] == {f} for j in judged)
                out[part, "".join(order), step] = [len(left), len(gone), len(early), alone, sum(j[2] for j in gone), sum(j[3] for j in gone)]
                shapley[part, f] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def got(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, "en", p, 1, "x", 1, "y", 2) for i, t, p in rows], DOCS)
    found = audit_filters(docs, spark.createDataFrame(labels, LABELS)).collect()
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found}
    assert len(out) == len(found)
    return out


def test_all_orders_against_brute_force(spark):
    long = " ".join(f"w{i}" for i in range(200))
    texts = [None, "", " \n", long, long + " #", long.upper(), "a " * 300, "A " * 300, long + " | A", "short", "SHORT *", "é" * 50, long + "\x0b" + "z\x1cz", long[:-5] + "\x85x"]
    rows = [(i, t, ("s", "t", None, "")[i % 4]) for i, t in enumerate(texts)]
    rows += [(20 + i, t, "s") for i, t in enumerate(texts)] + [(7, texts[3], "t"), (3, texts[3], "s"), (None, texts[3], "t"), (None, "only here " * 150, "s"), (40, long, "u")]
    labels = [(0, 1, 0), (3, 1, 1), (3, 0, 0), (6, 1, 0), (7, None, 1), (23, 1, None), (27, 0, 1), (None, 1, 1), (999, 1, 1)]
    assert got(spark, rows, labels) == expected(rows, labels)


def test_one_part_of_copies_and_no_rows(spark):
    rows = [(i, "the same text", "one") for i in range(300)]
    assert got(spark, rows, []) == expected(rows, [])
    assert got(spark, [], []) == {}


def test_each_set_of_filters_is_visited_once(spark, tmp_path):
    rows = spark.createDataFrame([("p", True, False, True)] * 3 + [("p", False, True, False)], "part string, A boolean, B boolean, C boolean")
    states = walk_edges(rows, ["A", "B", "C"], [], f"{tmp_path}/edges")
    assert states == [0, 1, 3, 7, 5, 2, 6, 4]  # depth first, each once
    edges = {r.state: r for r in spark.read.option("mergeSchema", "true").parquet(f"{tmp_path}/edges").collect()}
    assert [edges[s].n for s in (0, 1, 2, 4)] == [4, 1, 3, 1] and edges[0].removed_0 == 3 and edges[4].removed_1 == 1 and 5 in edges
    assert not spark.sparkContext._jsc.getPersistentRDDs()
