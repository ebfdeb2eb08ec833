"""Model composites against a plain forward pass."""

import math

import numpy as np
from pyspark.sql import functions as F

from lumenrank.operators import encoder


def plain(tokens, mask, w, repeats):
    """The same encoder, value by value."""
    x = [list(w.embedding[t]) for t in tokens]
    mul = lambda a, b: [[sum(r[k] * b[k][j] for k in range(len(r))) for j in range(len(b[0]))] for r in a]

    def norm(r):
        m = sum(r) / len(r)
        s = math.sqrt(sum((v - m) ** 2 for v in r) / len(r) + 1e-5)
        return [(v - m) / s for v in r]

    for _ in range(repeats):
        q, k, v = (mul(x, m) for m in (w.q, w.k, w.v))
        mixed = []
        for row in q:
            s = [sum(a * b for a, b in zip(row, key, strict=True)) for key in k]
            e = [math.exp(z - max(s)) for z in s]
            mixed.append([sum(e[i] / sum(e) * v[i][j] for i in range(len(v))) for j in range(len(v[0]))])
        a = [norm([p + r for p, r in zip(o, y, strict=True)]) for o, y in zip(mul(mixed, w.o), x, strict=True)]
        up = [[0.5 * z * (1 + math.tanh(0.7978845608 * (z + 0.044715 * z**3))) for z in r] for r in mul(a, w.up)]
        x = [norm([p + r for p, r in zip(o, y, strict=True)]) for o, y in zip(mul(up, w.down), a, strict=True)]
    kept = [[v / math.sqrt(sum(z * z for z in r)) for v in r] for r, m in zip(x, mask, strict=True) if m]
    return [sum(c) / len(kept) for c in zip(*kept, strict=True)] if kept else [0.0] * len(x[0])


def test_forward():
    w = encoder.Weights.seeded(20, 6, 8)
    tokens, mask = np.array([3, 7, 7, 19]), np.array([1, 1, 0, 1])
    assert np.allclose(encoder.encode_tokens(tokens, mask, w), plain(tokens, mask, w, 2))
    assert not encoder.encode_tokens(tokens, np.zeros(4), w).any()


def test_sparse_attention_keeps_the_best_keys():
    g = np.random.default_rng(1)
    q, k, v = g.standard_normal((3, 4)), g.standard_normal((10, 4)), g.standard_normal((10, 4))
    got = encoder.attend(q, k, v, 0)
    for i in range(3):
        s = k @ q[i]
        best = np.argsort(-s)[:4]
        e = np.exp(s[best] - s[best].max())
        assert np.allclose(got[i], (e / e.sum()) @ v[best])
    assert np.allclose(encoder.attend(q, k, v, 10), encoder.attend(q, k, v))


def test_frames(spark):
    rows = spark.createDataFrame([(1, [1, 2]), (2, [])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.vector for r in encoder.embed(rows, encoder.Weights.seeded(5, 4, 8)).collect()}
    assert len(got[1]) == 4 and got[2] == [0.0] * 4
    p = spark.createDataFrame([(0, 0, i, [float(i), 1.0, -2.0, 0.5]) for i in range(8)], "n long, y long, x long, channels array<double>")
    err = [encoder.channel_codec(p, b).select(F.sum(F.abs(F.get("channels", F.lit(0)) - F.get("decoded", F.lit(0))))).first()[0] for b in (2, 8)]
    assert err[1] < err[0]
    b = spark.createDataFrame([(0, k, [float(k), 0.0]) for k in range(5)], "block long, k long, vector array<double>")
    assert [r.k for r in encoder.farthest_representatives(b, 3).orderBy("nth").collect()] == [0, 4, 2]
