"""Blockwise rankings, packed codes, fast rotations and routing by summaries against plain forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenrank.operators import blocks, compact, diagnostics, encoder, hadamard, metrics, ranking, routing


def frame(spark, vectors, key="doc_id", name="y"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], f"{key} long, {name} array<double>").repartition(3)


def test_best_rows():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n, k = int(rng.integers(1, 300)), int(rng.integers(1, 15))
        s, ids = np.round(rng.standard_normal((n, 4)), 1), rng.permutation(n)
        want = np.lexsort((np.broadcast_to(ids[:, None], s.shape), -s), axis=0)[:k]
        best = blocks.Best(4, k)
        for at in range(0, n, 37):
            best.add(ids[at : at + 37], s[at : at + 37])
        assert np.array_equal(best.ids, ids[want]) and np.array_equal(best.scores, np.take_along_axis(s, want, 0))


@pytest.mark.parametrize("metric", ["dot", "cosine", "l2"])
def test_dense_rankings(spark, metric):
    """Several blocks of queries, ties and a zero vector."""
    rng = np.random.default_rng(2)
    y = np.round(rng.standard_normal((70, 5)), 1)
    y[3], y[40] = 0, y[41]
    x = y[:9]
    size = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)
    s = {"dot": x @ y.T, "cosine": np.divide(x @ y.T, size, out=np.zeros_like(size), where=size > 0), "l2": -np.linalg.norm(x[:, None] - y, axis=2)}[metric]
    s = np.round(s, 6) + 0.0
    got = ranking.dense_top_k(frame(spark, x, "query_id", "x"), frame(spark, y), 4, metric, digits=6, block=4)
    rows = sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in got.collect())
    want = [(q, n + 1, int(d), s[q, d]) for q in range(9) for n, d in enumerate(np.lexsort((np.arange(70), -s[q]))[:4])]
    assert rows == want
    with pytest.raises(ValueError):
        blocks.dense_scorer("manhattan")
    assert ranking.dense_top_k(frame(spark, x, "query_id", "x").limit(0), frame(spark, y), 4).count() == 0
    assert ranking.dense_top_k(frame(spark, x, "query_id", "x"), frame(spark, y).limit(0), 4).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 20, 64, 100])
def test_hadamard(spark, n):
    whole = hadamard.turn(np.eye(n), 5)
    x = np.random.default_rng(n).standard_normal((4, n))
    assert np.allclose(whole @ whole.T, np.eye(n)) and np.allclose(hadamard.turn(x, 5), x @ whole)
    assert np.allclose(hadamard.turn_back(hadamard.turn(x, 5), 5), x)
    assert not np.allclose(hadamard.turn(x, 5), hadamard.turn(x, 6)) or n < 3
    if n > 16:  # every component reaches many others
        assert ((np.abs(whole) > 1e-9).sum(axis=1) > n // 3).all()


@pytest.mark.parametrize("bits", [2, 4, 8])
@pytest.mark.parametrize("turn", ["dense", "hadamard"])
def test_packed_codes(spark, bits, turn):
    rng = np.random.default_rng(bits)
    for dim in (64, 13):
        codec, y, q = compact.Codec(dim, bits, 3, turn), rng.standard_normal((40, dim)), rng.standard_normal((6, dim))
        y[3] = 0
        held = codec.encode(y)
        assert held.shape[1] == codec.payload_bytes == -(-dim * bits // 8) + 4
        assert np.array_equal(codec.unpack(codec.pack(codec.codes(y)[0])), codec.codes(y)[0])
        assert np.allclose(codec.scores(codec.tables(q), held), codec.decode(held) @ q.T)
        stored = compact.store(frame(spark, y), codec)
        assert {len(r.payload) for r in stored.collect()} == {codec.payload_bytes}
        back = np.stack([r.y for r in compact.decoded(stored, codec).orderBy("doc_id").collect()])
        assert np.allclose(back, codec.decode(held))
        found = compact.search(frame(spark, q, "query_id", "x"), stored, 5, codec)
        assert "CartesianProduct" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()
        s = np.round(q @ back.T, 6)
        rows = sorted((r.query_id, r["rank"], r.doc_id) for r in found.collect())
        assert rows == [(i, n + 1, int(d)) for i in range(6) for n, d in enumerate(np.lexsort((np.arange(40), -s[i]))[:5])]
    with pytest.raises(ValueError):
        compact.Codec(8, 3)


def test_log_norms():
    norms = np.array([0.0, -1.0, 1e-9, 1e-3, 1.0, 7.5, 1e9])
    again = encoder.decoded_norm(encoder.coded_norm(norms))
    assert encoder.coded_norm(norms).tolist()[:3] == [0, 0, 0] and encoder.coded_norm(norms)[-1] == 255
    assert np.allclose(np.log(again[3:6]), np.log(norms[3:6]), atol=16 / 255)


def plain_routing(q, y, s, mode, router=None):
    """Chosen blocks of each query, block by block."""
    n = -(-len(y) // s.block)
    cut = [y[i * s.block : (i + 1) * s.block] for i in range(n)]
    reps = []
    for c in cut:
        chosen = [int(np.round((c * c).sum(axis=1), 12).argmax())]
        while len(chosen) < min(s.reps, len(c)):
            d = [(-1 if i in chosen else min(((c[i] - c[j]) ** 2).sum() for j in chosen), -i) for i in range(len(c))]
            chosen.append(-max(d)[1])
        reps.append(c[chosen])
    found = []
    for x in q:
        size, z = np.linalg.norm(x), []
        for c, r in zip(cut, reps, strict=True):
            mean = c.mean(axis=0)
            radius = np.linalg.norm(c - mean, axis=1).max()
            features = np.array([1, x @ mean, x @ r[0], size * radius, len(c)])
            z.append({
                "anchor": x @ c[len(c) // 2], "summary_mean": x @ mean, "summary_mean_radius": x @ mean + size * radius, "summary_maxnorm": x @ r[0],
                "summary_blend_radius": x @ (mean + s.alpha * (r[0] - mean)) + s.radius_weight * size * radius, "summary_multirep": (r @ x).max(), "summary_hier_multirep": (r @ x).max(),
                "multiprobe": (c[routing.probe_places(len(c), s.probes)] @ x).max(), "oracle_block_max": (c @ x).max(), "learned_block_linear": router.score(features) if router else 0,
            }[mode])
        allowed = range(n)
        if mode == "summary_hier_multirep":
            heads = [max((reps[b][0] for b in range(g, min(n, g + s.group))), key=lambda r: (r * r).sum()) for g in range(0, n, s.group)]
            top = np.lexsort((np.arange(len(heads)), -np.round([x @ h for h in heads], 9)))[: s.groups]
            allowed = [b for b in range(n) if b // s.group in top]
        found.append(sorted(allowed, key=lambda b: (-round(z[b], 9), b))[: s.top_blocks])
    return found


def test_routing_modes(spark):
    rng = np.random.default_rng(6)
    y, q = rng.standard_normal((75, 6)) + rng.standard_normal((75, 1)), rng.standard_normal((7, 6))
    s = routing.Settings(block=8, top_blocks=3, reps=3, probes=3, group=3, groups=2)
    keys, asked = frame(spark, y, "k"), frame(spark, q, "query_id", "x")
    held = routing.summaries(keys, s)
    router = routing.fit_router(asked, keys, held, s)
    # The same weights from all examples at once.
    best = plain_routing(q, y, s, "oracle_block_max")
    rows = []
    for i, x in enumerate(q):
        for b in range(10):
            c = y[b * 8 : b * 8 + 8]
            mean = c.mean(axis=0)
            rep = c[np.round((c * c).sum(axis=1), 12).argmax()]
            rows.append([1, x @ mean, x @ rep, np.linalg.norm(x) * np.linalg.norm(c - mean, axis=1).max(), len(c), float(b in best[i])])
    rows = np.array(rows)
    f, label = rows[:, :5], rows[:, 5]
    means, scales = f.mean(axis=0), 1 / np.sqrt(f.var(axis=0) + 1e-12)
    means[0], scales[0] = 0, 1
    z, w = (f - means) * scales, np.where(label == 1, (label == 0).sum() / (label == 1).sum(), 1.0)
    assert np.allclose(router.weights, np.linalg.solve((z * w[:, None]).T @ z + 1e-3 * len(z) * np.eye(5), z.T @ (w * label)), atol=1e-6)
    for mode in routing.MODES:
        found = routing.oracle_blocks(asked, keys, s) if mode == "oracle_block_max" else routing.route(asked, held, mode, s, router)
        rows = found.collect()
        got = [[r.block for r in sorted((r for r in rows if r.query_id == i), key=lambda r: r["rank"])] for i in range(7)]
        assert got == plain_routing(q, y, s, mode, router), mode
    told = {r.mode: r for r in routing.calibrate(asked, keys, s, 5, router=router).collect()}
    exact = [np.lexsort((np.arange(75), -np.round(y @ x, 9)))[:5] // 8 for x in q]
    for mode, r in told.items():
        share = [np.isin(e, c).mean() for e, c in zip(exact, plain_routing(q, y, s, mode, router), strict=True)]
        assert (r.recall, r.least_recall) == (pytest.approx(np.mean(share)), pytest.approx(min(share)))
    assert told["summary_mean"].route_scores == 10 and told["oracle_block_max"].route_scores == 75 and told["summary_mean"].key_scores == 24
    with pytest.raises(ValueError):
        routing.route(asked, held, "learned_block_linear", s)
    assert held.where(F.size("coarse") != 6).count() == 0


def test_runs_with_provenance(spark):
    rng = np.random.default_rng(8)
    y = rng.standard_normal((130, 12))
    docs, asked = frame(spark, y), frame(spark, y[:8] + 0.3 * rng.standard_normal((8, 12)), "query_id", "x")
    rel = spark.createDataFrame([(q, d, 1.0) for q in range(6) for d in range(q, 130, 9)] + [(6, 500, 1.0), (7, 3, 0.0)], "query_id long, doc_id long, rel double")
    runs = [diagnostics.Run(8), diagnostics.Run(2), diagnostics.Run(2, 120, "dense"), diagnostics.Run(4, 120, "reconstruct", seed=5), diagnostics.Run(4, 90, "dense"), diagnostics.Run(4, 900, "half")]
    rows = diagnostics.run_rows(runs, asked, docs, rel, per_query_k=110).cache()
    assert rows.columns == list(diagnostics.ROWS)
    many = {(r.method, r.seed): r["count"] for r in rows.groupBy("method", "seed").count().collect()}
    # Queries 6 and 7 have nothing relevant; runs that fetch too few, or more than there are, don't apply.
    assert many == {("compact_ip_b8", 1): 660, ("compact_ip_b2", 1): 660, ("compact_ip_b2_overfetch120_dense_rerank", 1): 660, ("compact_ip_b4_overfetch120_reconstruct_rerank", 5): 660}
    dense = {(r.query_id, r.doc_id): r["rank"] for r in ranking.dense_top_k(asked, docs, 110, digits=6).collect()}
    for r in rows.collect():
        assert r.dense_rank == dense.get((r.query_id, r.doc_id)) and r.rel == float(r.doc_id % 9 == r.query_id and r.doc_id >= r.query_id)
        assert r.compact_rank == r["rank"] or r.overfetch
    told = {r.method: r for r in diagnostics.evaluate_runs(rows, runs, asked, docs, rel).collect()}
    assert len(told) == 4 and told["compact_ip_b8"].vector_bytes == 130 * 16 and told["compact_ip_b2_overfetch120_dense_rerank"].sidecar_bytes == 130 * 48
    exact = metrics.summary(metrics.per_query(ranking.dense_top_k(asked, docs, 100, digits=6), rel, docs)).first()
    for r in told.values():
        assert r.queries == 6 and r.ndcg_10_delta == pytest.approx(r.ndcg_10 - exact.ndcg_10) and r.recall_100_delta == pytest.approx(r.recall_100 - exact.recall_100)
    assert told["compact_ip_b8"].compression == 3.0 and told["compact_ip_b2_overfetch120_dense_rerank"].total_compression == pytest.approx(48 / 55)
    texts = spark.createDataFrame([(i, "" if i == 3 else f" text {i // 2} ") for i in range(130)], "doc_id long, text string")
    found = diagnostics.mine_rows(rows, rel, texts, 4, bits=2, overfetch=0).collect()
    assert len(found) == 24 and all(r.doc_id % 9 != r.query_id for r in found) and {r.nth for r in found} == {1, 2, 3, 4} and {r.reason for r in found} <= {"top10", "compact", "rank_boundary"}
    with pytest.raises(ValueError, match="overfetch"):
        diagnostics.select_rows(rows, bits=2)
    changed = rel.where("not (query_id = 0 and doc_id = 9)")
    assert {(r.query_id, r.doc_id) for r in diagnostics.mismatches(rows, changed).collect()} == {(0, 9)}
    with pytest.raises(ValueError):
        diagnostics.Run(4, 0, "dense")
