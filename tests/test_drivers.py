"""Evaluations from cached vectors in files against the operators they are made of, and a plain computation."""

import json

import numpy as np
import pytest

from lumenrank.operators import diagnostics
from lumenrank.plans import drivers


@pytest.fixture(scope="module")
def cached(spark, tmp_path_factory):
    """120 documents, 6 queries; judged ones are a query's nearest by a hidden direction. Ids sort otherwise than they are written."""
    at, rng = tmp_path_factory.mktemp("cache"), np.random.default_rng(4)
    y = rng.standard_normal((120, 8))
    x = y[[7, 20, 33, 46, 59, 72]] + 0.4 * rng.standard_normal((6, 8))
    names = [f"d{i * 37 % 120:03d}" for i in range(120)]
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]
    write = lambda name, rows: (at / name).write_text("".join(json.dumps(r) + "\n" for r in rows))
    write("docs.jsonl", [{"id": n, "embedding": list(v)} for n, v in zip(names, y, strict=True)])
    write("queries.jsonl", [{"id": f"q{i}", "embedding": list(v)} for i, v in enumerate(x)] + [{"id": "unjudged", "embedding": [1.0] * 8}])
    write("corpus.jsonl", [{"_id": n, "title": "", "text": f"{words[i % 6]} text {i}"} for i, n in enumerate(names)])
    write("asked.jsonl", [{"_id": f"q{i}", "text": words[i]} for i in range(6)])
    rel = [(f"q{i}", names[d]) for i in range(6) for d in (7 + 13 * i, 7 + 13 * i + 1)]
    (at / "test.tsv").write_text("query-id\tcorpus-id\tscore\n" + "".join(f"{q}\t{d}\t1\n" for q, d in rel) + "q0\tnowhere\t1\n")
    return at, drivers.Cached.of(spark, str(at / "queries.jsonl"), str(at / "docs.jsonl"), str(at / "test.tsv")), x, y, names, rel


def test_dense(cached):
    _, c, x, y, names, rel = cached
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(unit(x) @ unit(y).T, 6)
    gains = []
    for i in range(6):
        order = sorted(range(120), key=lambda d: (-s[i, d], names[d]))
        hits = [r for r, d in enumerate(order[:10], 1) if (f"q{i}", names[d]) in rel]
        gains.append(sum(1 / np.log2(r + 1) for r in hits) / (1 + 1 / np.log2(3)))
    told = drivers.evaluate_dense(c).first()
    assert told.queries == 6 and told.ndcg_10 == pytest.approx(np.mean(gains), abs=1e-6)


def test_hybrid(spark, cached):
    at, c, *_, names, rel = cached
    paths = str(at / "corpus.jsonl"), str(at / "asked.jsonl")
    found = c.named(drivers.hybrid_ranking(spark, c, *paths, "rrf"))
    first = {r.query_id: r.doc_id for r in found.where("rank = 1").collect()}
    assert set(first) == {f"q{i}" for i in range(6)} and set(first.values()) <= set(names)
    lexical = drivers.evaluate_hybrid(spark, c, *paths, "minmax", alpha=1.0).first()
    alone = drivers.evaluate_hybrid(spark, c, *paths, "minmax", alpha=0.0).first()
    assert alone.ndcg_10 == pytest.approx(drivers.evaluate_dense(c).first().ndcg_10) and lexical.queries == 6


def test_quantized(spark, cached, tmp_path):
    _, c, *_, names, rel = cached
    runs = [diagnostics.Run(8), diagnostics.Run(4, 110, "half"), diagnostics.Run(2, 110, "dense")]
    told = {r.method: r for r in drivers.evaluate_quantized(c, runs, per_query=str(tmp_path / "rows"), per_query_k=105).collect()}
    assert len(told) == 3 and told["compact_ip_b8"].ndcg_10_delta == pytest.approx(0, abs=0.15)
    rows = spark.read.json(str(tmp_path / "rows"))
    assert rows.count() == 3 * 6 * 105 and {r.doc_id for r in rows.select("doc_id").distinct().collect()} <= set(names)
    assert {(r.query_id, r.doc_id) for r in rows.where("rel > 0").collect()} <= set(rel)


def test_queries_without_vectors(spark, cached):
    at = cached[0]
    (at / "more.tsv").write_text("q0\td001\t1\nq77\td001\t1\n")
    with pytest.raises(ValueError, match="no vector"):
        drivers.Cached.of(spark, str(at / "queries.jsonl"), str(at / "docs.jsonl"), str(at / "more.tsv"))
