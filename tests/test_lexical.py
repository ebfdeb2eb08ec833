"""The best documents by asked terms, kept where the documents stand, against plain scoring of all pairs."""

import numpy as np
import pytest

from lumenrank.operators import lexical, ranking


def plain(texts, queries, k, without, longer):
    words = {d: t.split() for d, t in texts.items()}
    n, mean = len(words), np.mean([max(1, len(w)) for w in words.values()])
    out = set()
    for q, text in queries.items():
        scored = []
        for d, w in words.items():
            met = [x for x in text.split() if x in w]
            if met and (q, d) not in without:
                df = {x: sum(x in v for v in words.values()) for x in met}
                s = sum(np.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * w.count(x) * 1.9 / (w.count(x) + 0.9 * (0.6 + 0.4 * len(w) / mean)) for x in met)
                scored.append((-round(s, 6), -len(w) if longer else 0, d))
        out |= {(q, d, r + 1) for r, (_, _, d) in enumerate(sorted(scored)[:k])}
    return out


@pytest.mark.parametrize("block", [1024, 3])
@pytest.mark.parametrize("longer", [False, True])
def test_best(spark, monkeypatch, block, longer):
    monkeypatch.setattr(lexical, "BLOCK", block)
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(12)]
    texts = {i: " ".join(rng.choice(words, rng.integers(0, 9))) for i in range(150)}
    texts |= {i + 150: texts[i] for i in range(60)}  # equal scores
    queries = {i: " ".join(rng.choice(words, rng.integers(1, 4))) for i in range(8)} | {8: "nowhere", 9: ""}
    without = {(q, d) for q in range(0, 10, 2) for d in range(0, 210, 3)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame(list(queries.items()), "query_id long, text string")
    for left_out in (set(), without):
        pairs = spark.createDataFrame(list(left_out), "query_id long, doc_id long") if left_out else None
        found = ranking.Bm25(docs).best(asked, 7, without=pairs, longer=longer).collect()
        assert {(r.query_id, r.doc_id, r["rank"]) for r in found} == plain(texts, queries, 7, left_out, longer)


def test_struct_and_string_ids(spark):
    rows = [("b", 10, "x y"), ("b", 9, "x y"), ("a", 11, "x y"), (None, 3, "z")]
    docs = spark.createDataFrame(rows, "p string, c long, text string").selectExpr("struct(p, c) AS doc_id", "text")
    asked = spark.createDataFrame([("q", "x"), ("r", "z")], "query_id string, text string")
    found = ranking.Bm25(docs).best(asked, 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, tuple(r.doc_id)) for r in found] == [("q", ("a", 11)), ("q", ("b", 9)), ("r", (None, 3))]


def test_cuts_are_bounded():
    sizes = np.array([5, lexical.HELD * 2, 1, lexical.HELD, 3, 0, 0])
    found = list(lexical.cuts(sizes, 2))
    assert [i for a, b in found for i in range(a, b)] == list(range(7))
    assert all(b - a == 1 or sizes[a:b].sum() <= lexical.HELD for a, b in found) and all(b - a <= 2 for a, b in found)


def test_sparse_features_of_rare_terms(spark, monkeypatch):
    """Terms beyond the common ones meet their frequency by a join."""
    texts = {1: "a a b c", 2: "a d", 3: "b a e e e", 4: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(ranking, "COMMON", 2)
    words = {d: t.split() or [""] for d, t in texts.items()}
    idf = {x: np.log(1 + (4 - n + 0.5) / (n + 0.5)) for x in {x for w in words.values() for x in w} for n in [sum(x in w for w in words.values())]}
    want = {(d, x): w.count(x) * idf[x] / np.sqrt(sum((w.count(y) * idf[y]) ** 2 for y in set(w))) for d, w in words.items() for x in w}
    got = {(r.doc_id, r.term): r.weight for r in ranking.sparse_features(docs).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
