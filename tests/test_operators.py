"""Small cases with values worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenrank.functions import text as X
from lumenrank.functions import vectors as V
from lumenrank.operators import bpe, chunking, encoder, fusion, metrics, ranking, teacher, tensor
from lumenrank.operators import mining as M
from lumenrank.plans import gates, planners
from lumenrank.plans.pipeline import Pipeline, kernel


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def arr(*v):
    return F.array(*[F.lit(float(x)) for x in v])


def close(a, b):
    return np.allclose(a, b, atol=1e-9)


def test_vectors(spark):
    assert one(spark, V.softmax(arr(0, 0))) == [0.5, 0.5]
    assert one(spark, V.normalize(arr(0, 0))) == [0.0, 0.0]
    assert close(one(spark, V.layernorm(arr(1, 3))), np.array([-1, 1]) / math.sqrt(1 + 1e-5))
    rows = F.array(arr(2, 4), arr(6, 8))
    assert one(spark, V.mean_pool(rows, F.array(F.lit(1), F.lit(0)))) == [2.0, 4.0]
    assert one(spark, V.mean_pool(rows, F.array(F.lit(0), F.lit(0)))) == [0.0, 0.0]
    assert one(spark, V.elementwise("/", arr(1, -1, 4), arr(0, 0, 2))) == [math.inf, -math.inf, 2.0]
    assert one(spark, V.cosine(arr(0, 0), arr(1, 0))) == 0
    assert close(one(spark, V.rope(arr(1, 0), F.lit(1))), [math.cos(1), math.sin(1)])
    assert one(spark, V.fake_quantize(arr(1, -0.5), 2, F.lit(1.0))) == [1.0, -1.0]
    for x in (-2.0, -0.3, 0.0, 0.7, 2.5):
        assert abs(one(spark, V.erf(F.lit(x))) - math.erf(x)) < 2e-7
    assert abs(one(spark, V.qnorm_decode(V.qnorm_encode(F.lit(3.0)))) / 3 - 1) < 0.07


def test_top_k_ties_and_exactness(spark):
    s = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (0, 2, 2.0)], "q int, index int, score double")
    assert [r["index"] for r in tensor.top_k(s, 2, ["q"]).orderBy("rank").collect()] == [1, 2]
    with pytest.raises(Exception, match="k exceeds"):
        tensor.top_k(s, 4, ["q"], exact=True).collect()


def test_gather_out_of_range(spark):
    table = spark.createDataFrame([(0, 1.0)], "row int, v double")
    with pytest.raises(Exception, match="out of range"):
        tensor.gather(table, spark.createDataFrame([(0, 5)], "at int, row int")).collect()


def test_attention_budget(spark):
    assert one(spark, tensor.attention_budget(F.lit(10), 0)) == 4
    assert one(spark, tensor.attention_budget(F.lit(3), 9)) == 3


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, "b", 1.0, 1), (1, "a", 0.9, 2), (1, "z", 0.8, 3)], "query_id int, doc_id string, score double, rank int")
    rel = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0), (2, "q", 1.0)], "query_id int, doc_id string, rel double")
    m = {r.query_id: r for r in metrics.per_query(ranked, rel).collect()}
    assert close(m[1].ndcg_10, (1 + 2 / math.log2(3)) / (2 + 1 / math.log2(3)))
    assert m[1].precision_10 == 0.2 and m[1].mrr_10 == 1 and m[2].first_relevant_rank == 0 and m[2].map_10 == 0
    one_hit = spark.createDataFrame([(1, "a", 1.0), (1, "x", 1.0), (1, "y", 1.0)], "query_id int, doc_id string, rel double")
    top = spark.createDataFrame([(1, "a", 1.0, 1)], "query_id int, doc_id string, score double, rank int")
    assert close(metrics.per_query(top, one_hit).first().map_10, 1 / 3)


def test_pair_metrics(spark):
    same = spark.createDataFrame([(0.5, 1), (0.5, -1), (0.5, -1)], "score double, target int")
    assert metrics.roc_auc(same).first()[0] == 0.5
    t = metrics.best_threshold(same).first()
    assert t.threshold == 0.5 and close(t.accuracy, 2 / 3)
    tie = spark.createDataFrame([(1, 0.9, 1), (1, 0.9, -1)], "query_id int, score double, target int")
    assert metrics.grouped_rank(tie).first().mean_rank == 1
    d = metrics.deciles(spark.range(10).select(F.col("id").alias("v")), "v").collect()
    assert [r.value for r in sorted(d)] == list(range(1, 10))


def test_fusion(spark):
    a = spark.createDataFrame([(1, 1, 5.0, 1), (1, 2, 5.0, 2)], "query_id int, doc_id int, score double, rank int")
    b = spark.createDataFrame([(1, 2, 3.0, 1), (1, 1, 1.0, 2)], "query_id int, doc_id int, score double, rank int")
    assert [r.doc_id for r in fusion.fuse(a, b, "minmax", alpha=1.0).orderBy("rank").collect()] == [2, 1]
    assert {r.score for r in fusion.fuse(a, a, "zscore").collect()} == {0.0}
    assert {r.score for r in fusion.fuse(a, a, "minmax").collect()} == {1.0}
    with pytest.raises(ValueError):
        fusion.check(alpha=2)


def test_bm25_zero_fill(spark):
    docs = spark.createDataFrame([(1, "x"), (2, "apple"), (3, ""), (4, None)], "doc_id int, text string")
    q = spark.createDataFrame([(1, "apple")], "query_id int, text string")
    rows = ranking.Bm25(docs).top_k(q, 3).orderBy("rank").collect()
    assert [r.doc_id for r in rows] == [2, 1, 3] and rows[1].score == 0


def test_quantiser_quality_rises_with_bits():
    v = np.random.default_rng(3).standard_normal((200, 32))
    err = []
    for bits in ranking.BITS:
        codes, norms = ranking.quantize(v, bits, 7)
        again, _ = ranking.quantize(v, bits, 7)
        assert (codes == again).all()
        err.append(float(np.mean((ranking.reconstruct(codes, norms, bits, 7) - v) ** 2)))
    assert err[0] > err[1] > err[2] and err[2] < 0.001
    assert [ranking.payload_bytes(128, b) for b in ranking.BITS] == [36, 68, 132]


def test_multivector_and_rescue(spark):
    c = spark.createDataFrame([(1, 1, 10, 0.5), (1, 1, 11, 0.9), (1, 2, 12, 0.8)], "query_id int, doc_id int, child_id int, score double")
    got = {r.doc_id: r for r in ranking.multivector(c, "top2").collect()}
    assert got[1].score == 0.7 and got[1].best_child == 11 and got[2].children == 1


def brute_rescue(rows, k=100, window=20, promote=5):
    """rows (doc, compact rank, compact score) in rank order."""
    if len(rows) < k + window:
        return [r[0] for r in rows][:k]
    pool = sorted(rows[k - 1 : k + window], key=lambda r: (-r[2], r[1], -r[0]))[:promote]
    best = [r[0] for r in pool]
    top = [r[0] for r in rows[:k] if r[0] not in best]
    return (top + best + [r[0] for r in rows if r[0] not in top + best])[:k]


def test_rescue(spark):
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for q, n in enumerate((121, 140, 120, 119, 100, 30, 150, 150)):
        order = rng.permutation(n)
        mine = [(int(d), int(order[d]) + 1, float(round(rng.random(), 1))) for d in rng.permutation(n)]
        if q == 7:
            mine[99] = (mine[99][0], mine[99][1], 9.0)  # the document at the last place is the best of the pool
        rows += [(q, d, i + 1, c, s) for i, (d, c, s) in enumerate(mine)]
        want[q] = brute_rescue(mine)
    r = spark.createDataFrame(rows, "query_id int, doc_id int, rank int, compact_rank int, compact_score double")
    got = {}
    for x in ranking.rescue_boundary(r).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append(x.doc_id)
    assert got == want
    for q, docs in got.items():
        assert docs[:99] == [x[1] for x in sorted((y for y in rows if y[0] == q), key=lambda y: y[2])][:99]
    assert ranking.rescues(4, 100, 200) and not ranking.rescues(8, 100, 200)
    q = spark.createDataFrame([(1, [1.0])], "query_id int, x array<double>")
    d = spark.createDataFrame([(i, [1.0]) for i in range(4)], "doc_id int, y array<double>")
    c = spark.createDataFrame([(1, 0, 0.5, 2), (1, 1, 0.5, 1), (1, 2, 0.1, 3), (1, 3, 0.1, 3)], "query_id int, doc_id int, score double, rank int")
    again = lambda ties: [x.doc_id for x in ranking.rerank(q, d, c, 4, 4, ties).orderBy("rank").collect()]
    assert again("compact") == [1, 0, 3, 2] and again("id") == [0, 1, 2, 3]


def test_windows_and_chunks(spark):
    starts = lambda n, w, s: one(spark, X.window_starts(F.lit(n), w, s))
    assert starts(5, 3, 2) == [0, 2] and starts(6, 3, 2) == [0, 2, 3] and starts(2, 3, 2) == [0]
    assert one(spark, X.chunk_starts(F.lit(5), 3, 1)) == [0, 2]
    with pytest.raises(ValueError):
        X.chunk_starts(F.lit(5), 3, 3)


def test_bpe(spark):
    t = spark.createDataFrame([("low lower lowest", ), ("low low",)], "text string")
    m = bpe.train(t, 30)
    assert m.merges[0] in {("l", "o"), ("o", "w")} and m.tokens[:4] == list(bpe.SPECIAL)
    d = spark.createDataFrame([(1, "low lower"), (2, None), (3, "LOW?lower")], "doc_id long, text string")
    ids = {r.doc_id: r.ids for r in bpe.encode(d, m).collect()}
    assert ids[1] == ids[3] and ids[2] == [2, 3]
    assert [r.ids[-1] for r in bpe.encode(d, m, longest=3).collect()] == [3, 3, 3]
    assert {r.doc_id: r.ids for r in bpe.encode_distinct(d, m).collect()} == ids


def test_mining(spark):
    q = spark.createDataFrame([(1,), (2,)], "query_id int")
    corpus = spark.range(200).select(F.col("id").alias("doc_id"))
    lab = spark.createDataFrame([(1, i) for i in range(0, 200, 2)], "query_id int, doc_id int")
    rows = M.sampled_negatives(q, corpus, lab, 4, "s").collect()
    assert len({(r.query_id, r.doc_id) for r in rows}) == 8 and all(r.doc_id % 2 for r in rows if r.query_id == 1)
    assert len(M.sampled_negatives(q, corpus.limit(7), lab.where("doc_id < 7"), 5, "s").where("query_id = 1").collect()) <= 5
    with pytest.raises(ValueError):
        M.refuse_test_split("Test", "train")


def test_hash_started_negatives(spark):
    def fnv(raw):
        h = 14695981039346656037
        for b in raw:
            h = (h ^ b) * 1099511628211 % (1 << 64)
        return h

    texts = ["", "a", "foobar", "é\0x"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", M.fnv64a(F.col("t")).alias("h")).collect()
    assert all(int(r.h) == fnv(r.t.encode()) for r in got)
    pairs = [(1, i) for i in range(15)] + [(2, 3), (3, 0)]
    out = M.hash_started_negatives(spark.createDataFrame(pairs, "query_id long, positive_id long"), spark.range(16).select(F.col("id").alias("doc_id")), "d").collect()
    assert len(out) == len(pairs) and all(r.doc_id == 15 for r in out if r.query_id == 1)
    for r in out:
        taken, start = {p for q, p in pairs if q == r.query_id}, fnv(f"d\0{r.query_id}\0{r.positive_id}".encode()) % 16
        assert r.doc_id == next((start + i) % 16 for i in range(16) if (start + i) % 16 not in taken)


def test_order_of_many_ranges(spark, monkeypatch):
    from lumenrank.operators import ordering

    monkeypatch.setattr(ordering, "BIN_ROWS", 3)
    rows = spark.createDataFrame([(int(x), i) for i, x in enumerate(np.random.default_rng(1).integers(0, 500, 900))], "v int, k int")
    got = ordering.place(rows, F.col("v"), ["k"], "i").orderBy("i").collect()
    assert [(r.v, r.k) for r in got] == sorted((r.v, r.k) for r in got) and [r.i for r in got] == list(range(900))
    per = rows.groupBy("v").agg(F.count("*").alias("n"))
    sums = {r.v: r.n_below for r in ordering.running(per, "v", ["n"]).collect()}
    values = sorted(r.v for r in got)
    assert all(n == sum(x < v for x in values) for v, n in sums.items())


def test_numbers_as_text(spark):
    cases = {0.0: "0", 1.0: "1", -2.5: "-2.5", 100000.0: "100000", 1000000.0: "1e+06", 1234567.0: "1.234567e+06", 0.0001: "0.0001", 0.00001: "1e-05", 123.456: "123.456", -1.5e-7: "-1.5e-07", 2e100: "2e+100", 0.1: "0.1", 999999.5: "999999.5", 12.0: "12"}
    got = spark.createDataFrame([(k,) for k in cases], "v double").select("v", X.shortest_number(F.col("v")).alias("t")).collect()
    assert {r.v: r.t for r in got} == cases


def test_mined_pairs(spark):
    lines = ["first part here. second part there! third", "  another   line ", "another line", "short", "first part here. second part there! third"]
    rows = spark.createDataFrame(list(enumerate(lines)), "pos long, text string")
    got = [(r.query, r.positive) for r in chunking.mined_pairs(rows, 5).orderBy("i").collect()]
    whole = "first part here. second part there! third"
    assert got == [("first part here", "second part there"), ("second part there", "third"), (whole, "another line"), ("another line", "short"), ("short", whole)]
    assert chunking.mined_pairs(rows, 5, most=2).count() == 2
    train, held = chunking.train_and_eval(chunking.mined_pairs(rows, 5), 2)
    assert train.count() == 3 and [(r.query, r.right, r.target) for r in held.orderBy("query", F.col("target").desc()).collect()] == [
        ("first part here", "second part there", 1), ("first part here", "third", -1), ("second part there", "third", 1), ("second part there", "another line", -1),
    ]


def test_mined_eval_by_marks(spark):
    """A positive that most pairs share, lines that come twice, and the way round the end; as by a walk over all pairs."""
    lines = [(k // 2 if k > 8 else k, f"question number {k % 7}. the common answer; {'the common answer' if k % 3 else 'another answer'}") for k in range(12)]
    rows = spark.createDataFrame([*lines, (3, lines[3][1]), (20, None)], "pos long, text string")
    pairs = [tuple(r) for r in chunking.mined_pairs(rows, 5).orderBy("i").select("query", "positive").collect()]
    assert len(pairs) == len(set(pairs)) > 8
    for most in (3, len(pairs)):
        want, held = [], min(most, len(pairs) // 2)
        for i, (query, own) in enumerate(pairs[:held]):
            other = [p for k in range(1, len(pairs)) if (p := pairs[(i + k) % len(pairs)][1]) not in (own, query)]
            want += [(query, own, 1), *((query, p, -1) for p in other[:1])]
        train, judged = chunking.mined_train_and_eval(rows, most, 5)
        assert sorted(map(tuple, judged.collect())) == sorted(want)
        assert sorted((r.query, r.positive) for r in train.collect()) == sorted(pairs[held:])


def test_teacher_scores(spark):
    c = [("e1", " s ", "q", i, t) for i, t in enumerate("pab")] + [("e2", "z", "q2", i, t) for i, t in enumerate("pa")]
    cand = spark.createDataFrame(c, "example string, source string, query string, slot int, text string")
    scores = spark.createDataFrame([("s", "q", None, None, [0.9, 0.2, 0.1]), ("", "q2", "p", 0.5, None), ("z", "q2", "p", 0.7, None)], "source string, query string, text string, score double, scores array<double>")
    got = {(r.example, r.slot): r.score for r in teacher.import_scores(cand, scores).collect()}
    assert [got["e1", i] for i in range(3)] == [0.9, 0.2, 0.1] and got["e2", 0] is None
    with pytest.raises(Exception, match="without a score"):
        teacher.import_scores(cand, scores, allow_missing=False).collect()
    old = cand.withColumn("score", F.lit(0.4))
    assert {r.score for r in teacher.import_scores(old, scores, overwrite=False).collect()} == {0.4}
    assert {r.score for r in teacher.import_scores(old, scores).where("example = 'e2'").collect()} == {0.4}
    j = teacher.judged(teacher.import_scores(cand, scores), top1=True, least_margin=0.1)
    assert {r.example: (r.scored, r.passes) for r in j.collect()} == {"e1": (True, True), "e2": (False, True)}
    strict = teacher.judged(teacher.import_scores(cand, scores), least_margin=0.9)
    s = teacher.filter_summary(strict).first()
    assert (s.examples, s.missing, s.scored, s.kept, s.cleared) == (2, 1, 1, 0, 1)
    assert teacher.filter_scores(teacher.import_scores(cand, scores), strict, drop=True).count() == 2


def test_batches_and_padding(spark):
    w = encoder.Weights.seeded(20, 6, 8)
    rows = spark.createDataFrame([(1, [3, 7, 9]), (2, [4]), (3, [5, 5, 5]), (4, [])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.vector for r in encoder.embed(rows, w).collect()}
    for r in rows.collect():
        if r.ids:
            assert np.allclose(got[r.doc_id], encoder.encode_tokens(np.array(r.ids), np.ones(len(r.ids)), w))
    p = encoder.padded(rows, 2).orderBy("doc_id").collect()
    assert [(r.ids, r.mask) for r in p] == [([3, 7], [1, 1]), ([4, 0], [1, 0]), ([5, 5], [1, 1]), ([0, 0], [0, 0])]
    masked = {r.doc_id: r.vector for r in encoder.embed(encoder.padded(rows, 4), w).collect()}
    assert np.allclose(masked[2], encoder.encode_tokens(np.array([4, 0, 0, 0]), np.array([1, 0, 0, 0]), w)) and masked[4] == [0.0] * 6
    texts = spark.createDataFrame([(1, "low lower"), (2, "")], "doc_id long, text string")
    model = bpe.train(texts.select("text"), 20)
    assert encoder.embed_texts(texts, model, encoder.Weights.seeded(len(model.tokens), 6, 8)).count() == 2


def test_gates(spark):
    rules = gates.read_thresholds(spark, ["# none", "a x >= 0.5  # own", "x < 3"])
    m = spark.createDataFrame([("a", "x", 0.5), ("b", "x", 3.0)], "dataset string, metric string, value double")
    assert {(r.dataset, r.op): r.passes for r in gates.gate(m, rules).collect()} == {("a", ">="): True, ("a", "<"): True, ("b", "<"): False}
    with pytest.raises(ValueError):
        gates.read_thresholds(spark, ["x ~ 3"])
    assert [tuple(r) for r in gates.thresholds_of(spark, {"GATE_MIN_NDCG_10": "0.5", "OTHER": "1"}).collect()] == [(None, "ndcg_10", ">=", 0.5)]
    plan = spark.createDataFrame([(1 << 20,), (1 << 21,)], "packed_bytes long")
    assert [r.passes for r in planners.gate_plan(plan, most_mib=1.5).orderBy("packed_bytes").collect()] == [True, False]


def test_plans(spark):
    assert planners.payload_bytes(128, 4) == 68
    g = lambda rows: spark.createDataFrame(rows, "dataset string, seed int, ndcg double")
    assert gates.gate_scoreboard(g([("a", 1, 0.5)]), g([("a", 1, 0.6)]), ["ndcg"], 0.2).first().passes
    with pytest.raises(ValueError):
        gates.gate_scoreboard(g([("a", 1, 0.5), ("a", 1, 0.4)]), g([("a", 1, 0.6)]), ["ndcg"], 0.2)
    with pytest.raises(ValueError):
        gates.gate(g([("a", 1, 0.5)]), spark.createDataFrame([], "dataset string, metric string, op string, bound double"))
    steps = spark.createDataFrame([(1, 0.5, 0.1), (2, 0.505, 0.3), (3, 0.6, 0.0)], "step int, a double, b double")
    assert gates.best_checkpoint(steps, "a", ["b"], 0.01)["step"] == 3


def test_pipeline(spark):
    double = kernel(lambda c: c * 2)
    p = Pipeline("p", {"t": ["id"]}).let("u", lambda env: env["t"].select(double(F.col("id")).alias("id"))).returns("u")
    assert [r.id for r in p.run(t=spark.range(3))["u"].collect()] == [0, 2, 4]
    with pytest.raises(ValueError):
        Pipeline("p", {}).let("a", len).let("a", len)
    with pytest.raises(ValueError):
        p.run(t=spark.range(3).withColumnRenamed("id", "x"))
    with pytest.raises(TypeError):
        double(spark.range(1))


def test_transposed_convolution_in_groups(spark):
    import numpy as np

    from lumenrank.operators import tensor

    rng = np.random.default_rng(5)
    channels, outputs, groups, size, k, stride, pad, more = 4, 6, 2, 3, 3, 2, 1, 1
    x, w, b = rng.standard_normal((channels, size, size)), rng.standard_normal((channels, outputs // groups, k, k)), rng.standard_normal(outputs)
    end = (size - 1) * stride - 2 * pad + k + more
    want = np.zeros((outputs, end, end)) + b[:, None, None]
    for c, o, y, z, ky, kx in np.ndindex(channels, outputs // groups, size, size, k, k):
        at = y * stride - pad + ky, z * stride - pad + kx
        if 0 <= at[0] < end and 0 <= at[1] < end:
            want[(c // (channels // groups) * (outputs // groups) + o, *at)] += x[c, y, z] * w[c, o, ky, kx]
    image = spark.createDataFrame([(0, *map(int, i), float(v)) for i, v in np.ndenumerate(x) for i in [i]], "n long, c long, y long, x long, value double")
    kernel = spark.createDataFrame([(*map(int, i), float(v)) for i, v in np.ndenumerate(w)], "c long, o long, ky long, kx long, w double")
    bias = spark.createDataFrame([(i, float(v)) for i, v in enumerate(b)], "o long, bias double")
    got = np.full_like(want, np.nan)
    for r in tensor.conv2d_transpose(image, kernel, stride, pad, size, size, k, k, more, bias, groups, channels, outputs).collect():
        got[r.o, r.y, r.x] = r.value
    hit = ~np.isnan(got)  # places that no input reaches have no row
    assert np.allclose(got[hit], want[hit]) and np.allclose(want[~hit], np.broadcast_to(b[:, None, None], want.shape)[~hit])
    with pytest.raises(ValueError):
        tensor.conv2d_transpose(image, kernel, groups=3, channels=4, outputs=6)


def test_first_teacher_requests(spark):
    from lumenrank.operators import teacher

    rows = [(i, "s", f"q{i}", "p", ["n1", "n2"], [0.1, 0.2, 0.3] if i % 3 == 0 else []) for i in range(9)]
    groups = spark.createDataFrame(rows, "example long, source string, query string, positive string, negatives array<string>, teacher_scores array<double>").repartition(3)
    asked = lambda **o: sorted({r.example for r in teacher.requests(groups, **o).collect()})
    assert asked(most=4) == [0, 1, 2, 3] and asked(missing_only=True, most=3) == [1, 2, 4] and teacher.requests(groups, most=2).count() == 6
    with pytest.raises(ValueError):
        teacher.requests(groups, most=0)


def test_overlapping_runs_are_found_where_texts_stand(spark, monkeypatch):
    """As by the join of hashed runs: short texts, repeated runs, ids that come twice, words no item has, nulls."""
    rng = np.random.default_rng(12)
    text = lambda n: " ".join("abcd"[i] for i in rng.integers(0, 4, n))
    docs = [(int(i) // 2 if i < 20 else int(i), text(int(n))) for i, n in enumerate(rng.integers(0, 40, 120))] + [(None, "a b c d"), (900, None), (901, "a x b"), (902, "A, b! c? d")]
    items = [(i, text(n)) for i, n in enumerate([0, 1, 2, 3, 4, 4, 5, 6, 8, 12])] + [(50, "a b c d"), (51, "a x b"), (52, None)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "query_id long, text string")
    rows = lambda df: sorted(map(str, df.collect()))
    for words, share in ((5, 0.5), (2, 0.3), (1, 1.0)):
        found = M.overlapping(d, q, words, share)
        assert "xxhash64" not in found._jdf.queryExecution().executedPlan().toString()
        with monkeypatch.context() as m:
            m.setattr(M, "ASKED_RUNS", 3)
            joined = rows(M.overlapping(d, q, words, share))
        assert rows(found) == joined and len(joined) > 5
    assert M.overlapping(d, q.limit(0)).count() == 0 and M.overlapping(d.limit(0), q).count() == 0


def test_hash_started_negatives_pass_runs_at_once(spark):
    """One row a pair: no row for each place that is passed. Runs at both ends, a query without a free document, ids that come twice."""
    from lumenrank.operators import mining

    ids = [10 * i for i in range(40)]
    pairs = [(1, ids[i]) for i in (*range(0, 9), *range(20, 33), *range(35, 40))] + [(2, i) for i in ids] + [(3, ids[39]), (4, ids[0]), (4, 77)]
    corpus = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    for offset in (0, 7):
        out = mining.hash_started_negatives(spark.createDataFrame(pairs, "query_id long, positive_id long"), corpus, "d", offset)
        assert "explode(" not in out._jdf.queryExecution().analyzed().toString()
        got = {(r.query_id, r.positive_id): r.doc_id for r in out.collect()}
        want = {}
        for q, p in pairs:
            h = 14695981039346656037
            for b in f"d\0{q}\0{p}".encode():
                h = (h ^ b) * 1099511628211 % (1 << 64)
            free = [ids[(h % 40 + offset + i) % 40] for i in range(40) if (q, ids[(h % 40 + offset + i) % 40]) not in pairs]
            if free:
                want[q, p] = free[0]
        assert got == want and len(got) == len(pairs) - 40
    assert mining.hash_started_negatives(spark.createDataFrame(pairs, "query_id long, positive_id long"), corpus.limit(0), "d").count() == 0
