"""What a task holds at once is bounded, and blocks of queries don't show in what comes out."""

import numpy as np

from lumenrank.operators import blocks, routing


def test_scorer_slices_are_bounded(spark):
    queries = spark.range(300).selectExpr("id AS query_id", "array(cast(id AS double)) AS x")
    docs = spark.range(0, 6000, 1, 1).selectExpr("id AS doc_id", "array(cast(id AS double)) AS y")
    most = blocks.SCORES // 16

    def scorer(q):
        def score(b):
            if len(b) * len(q) > most:
                raise ValueError("too many at once")
            return blocks.matrix(b.column(1)) @ q.T

        return score

    found = blocks.top_k_by_blocks(queries, docs, ["y"], 2, scorer, wide=16).where("query_id = 7").orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in found] == [(5999, 7 * 5999.0), (5998, 7 * 5998.0)]


def test_router_by_blocks_of_queries(spark, monkeypatch):
    rng = np.random.default_rng(3)
    y, q = rng.standard_normal((90, 6)), rng.standard_normal((11, 6))
    keys = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "k long, y array<double>")
    asked = spark.createDataFrame([(100 - i, v.tolist()) for i, v in enumerate(q)], "query_id long, x array<double>")
    s = routing.Settings(block=8, top_blocks=3)
    held = routing.summaries(keys, s).cache()
    whole = routing.fit_router(asked, keys, held, s)
    monkeypatch.setattr(routing, "BLOCK", 4)
    parts = routing.fit_router(asked, keys, held, s)
    assert np.allclose(whole.weights, parts.weights) and np.allclose(whole.means, parts.means)


def test_runs_judged_by_labels(spark):
    """As with all pairs written out; a label of one document has no query."""
    from pyspark.sql import functions as F

    from lumenrank.operators import diagnostics

    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(8).tolist(), None if i == 5 else 99 if i == 6 else i % 3) for i in range(160)]
    e = spark.createDataFrame(rows, "id long, y array<double>, label int").cache()
    docs, asked = e.select(F.col("id").alias("doc_id"), "y"), e.where("id < 8").select(F.col("id").alias("query_id"), F.col("y").alias("x"))
    a, b = e.where("id < 8").select(F.col("id").alias("query_id"), "label"), e.select(F.col("id").alias("doc_id"), "label")
    rel = F.when(F.col("doc_id") % 2 == 0, 2.0).otherwise(1.0)
    pairs = a.join(b, "label").where("query_id <> doc_id").select("query_id", "doc_id", rel.alias("rel"))
    runs = [diagnostics.Run(4), diagnostics.Run(4, 120, "dense"), diagnostics.Run(2, 130, "reconstruct")]
    ruled = diagnostics.Judged.by_labels(a, b, rel)
    got, want = (sorted(map(str, diagnostics.run_rows(runs, asked, docs, q).collect())) for q in (ruled, pairs))
    assert got == want and len(got) == 6 * 300
    texts = docs.select("doc_id", F.concat(F.lit("t"), (F.col("doc_id") % 50).cast("string")).alias("text"))
    rows = diagnostics.run_rows(runs[:2], asked, docs, pairs)
    got, want = (sorted(map(str, diagnostics.mine_rows(rows, q, texts, 4, overfetch=120).collect())) for q in (ruled, pairs))
    assert got == want and got


def test_products_are_scores():
    from lumenrank.operators import compact

    rng = np.random.default_rng(9)
    for bits in (2, 4, 8):
        codec = compact.Codec(24, bits, turn="dense")
        held, q = codec.encode(rng.standard_normal((30, 24))), rng.standard_normal((11, 24))
        assert np.allclose(codec.products(codec.turned(q), held), codec.scores(codec.tables(q), held))
