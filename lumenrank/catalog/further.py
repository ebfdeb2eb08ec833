"""Options of the operators that the other modules don't show, over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import chunking as C
from ..operators import fusion, metrics, ranking
from ..operators import teacher as S
from ..operators import tensor as T
from ..plans import gates as G
from .base import Registry, Tables, r6
from .evaluation import _ALL, _QRELS, _contrast, qrels
from .mining import _CAND, _PER, _RELABEL, candidates
from .retrieval import _BOTH, _MM, _ZS, dense, dense_sql, turned_sql

_R = Registry()
QUERIES, SQL = _R.queries, _R.sql
add = _R.add


# --- rankings ----------------------------------------------------------------------------------------------------------


@add(f"WITH {dense_sql(1 << 40)} SELECT query_id, doc_id, score, rank FROM dense")
def score_table(t: Tables):
    """Every document of every query, ranked to the end."""
    return dense(t, None)


@add(f"WITH {dense_sql(1)}, {dense_sql(1, '-list_distance(x, y)', 'lex')} SELECT count(*) AS queries, round(avg((d.doc_id = l.doc_id)::INT), 6) AS top1_agreement FROM dense d JOIN lex l USING (query_id)")
def top_one_agreement(t: Tables):
    return fusion.top_one_agreement(dense(t, 1), dense(t, 1, "l2")).select("queries", r6("top1_agreement", "top1_agreement"))


_SETTINGS = ", ".join(f"('minmax:{a:g}', (1 - {a}) * md + {a} * ml), ('zscore:{a:g}', (1 - {a}) * zd + {a} * zl)" for a in (0.25, 0.75)) + ", " + ", ".join(f"('rrf:{k}:{w:g}', coalesce(1 / ({k} + dr)::DOUBLE, 0) + coalesce({w} / ({k} + lr)::DOUBLE, 0))" for k in (10, 60) for w in (0.5, 1.0))


@add(
    f"""{_BOTH}, n AS (SELECT query_id, doc_id, dr, lr, {_MM.format(c='ds')} AS md, {_MM.format(c='ls')} AS ml, {_ZS.format(c='ds')} AS zd, {_ZS.format(c='ls')} AS zl FROM u WINDOW q AS (PARTITION BY query_id)),
g AS (SELECT n.*, s.setting, round(s.score, 6) + 0.0 AS score FROM n, LATERAL (VALUES {_SETTINGS}) s(setting, score)),
r AS (SELECT *, row_number() OVER (PARTITION BY setting, query_id ORDER BY score DESC, dr NULLS LAST, lr NULLS LAST, doc_id) AS rank FROM g QUALIFY rank <= 10),
m AS (SELECT setting, round(avg((q.label = d.label)::INT), 6) AS precision_10, round(avg(CASE WHEN rank <= 3 THEN (q.label = d.label)::INT END), 6) AS precision_3 FROM r JOIN embeddings q ON q.vec_id = query_id JOIN embeddings d ON d.vec_id = doc_id GROUP BY ALL)
SELECT *, precision_3 >= 0.2 - 0.01 AS protected, row_number() OVER (ORDER BY (precision_3 >= 0.2 - 0.01) DESC, precision_10 DESC, setting) = 1 AND precision_3 >= 0.2 - 0.01 AS picked FROM m"""
)
def fusion_settings(t: Tables):
    """All blends at once, measured by labels; the best of those that keep the precision of the first three."""
    g = fusion.grid(dense(t, 50), dense(t, 50, "l2"), [0.25, 0.75], [10, 60], [0.5, 1.0], 10)
    label = t.embeddings.select("vec_id", "label")
    g = g.join(label.select(F.col("vec_id").alias("query_id"), F.col("label").alias("a")), "query_id").join(label.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("b")), "doc_id")
    same = (F.col("a") == F.col("b")).cast("double")
    m = g.groupBy("setting").agg(r6(F.avg(same), "precision_10"), r6(F.avg(F.when(F.col("rank") <= 3, same)), "precision_3"))
    return fusion.pick(m, "precision_10", {"precision_3": 0.2}, 0.01)


@add(f"WITH {dense_sql(30)}, {_QRELS}, f AS (SELECT query_id, min(rank) AS first FROM dense JOIN qrels USING (query_id, doc_id) GROUP BY ALL), q AS (SELECT DISTINCT query_id FROM dense) SELECT CASE WHEN first IS NULL THEN 'no relevant document' WHEN first = 1 THEN 'won' ELSE 'lost' END AS reason, count(*) AS queries FROM q LEFT JOIN f USING (query_id) GROUP BY ALL")
def frontier_skip_reasons(t: Tables):
    """Why queries give no pairs of a losing ranking: none relevant, or the first one is."""
    r = dense(t, 30)
    first = r.join(qrels(t), ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("first"))
    reason = F.when(F.col("first").isNull(), "no relevant document").when(F.col("first") == 1, "won").otherwise("lost")
    return r.select("query_id").distinct().join(first, "query_id", "left").groupBy(reason.alias("reason")).agg(F.count("*").alias("queries"))


@add("SELECT event_type, count(*) AS queries, round(sum(value), 6) AS seconds, round(count(*) / sum(value), 6) AS queries_per_second FROM events GROUP BY ALL")
def throughput_rates(t: Tables):
    rows = t.events.groupBy("event_type").agg(F.count("*").alias("queries"), F.sum("value").alias("seconds"))
    m = metrics.throughput(rows, ["queries"], "seconds")
    return m.select("event_type", "queries", r6("seconds", "seconds"), r6("queries_per_second", "queries_per_second"))


# --- tensors -----------------------------------------------------------------------------------------------------------


@add("SELECT vec_id, pos - 1 AS pos, round(floor(v[pos] * 100) * 0.01, 6) + 0.0 AS value FROM (SELECT vec_id, embedding::DOUBLE[] AS v, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings)")
def tensor_dequant(t: Tables):
    codes = t.embeddings.select("vec_id", F.posexplode("embedding").alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.floor(F.col("x").cast("double") * 100).cast("int").alias("value"))
    return T.dequant(codes, scale=0.01).select("vec_id", "pos", r6("value", "value"))


@add(
    f"""WITH {turned_sql(4)}, {turned_sql(8, name='8')}, kv AS (SELECT a.vec_id AS k, a.norm * 1.0 AS kn, a.y AS ky, list_transform(range(1, 65), lambda j: b.norm * list_inner_product(b.y, list_transform(r, lambda w: w[j]))) AS v FROM coded a JOIN coded8 b USING (vec_id), rot),
s AS (SELECT q.vec_id AS q, k, v, kn * list_inner_product(list_transform(q.t, lambda z: z * q.norm), ky) AS score FROM coded q, kv WHERE q.vec_id % 25 = 0),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, k) <= ceil(sqrt(count(*) OVER (PARTITION BY q)))), e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY q)) AS e FROM b),
w AS (SELECT q, e / sum(e) OVER (PARTITION BY q) AS w, v FROM e) SELECT q, j - 1 AS j, round(sum(w * v[j]), 6) + 0.0 AS value FROM w, range(1, 65) r(j) GROUP BY ALL"""
)
def tensor_turbo_sparse_attention(t: Tables):
    """Keys in four bits, values in eight; each query uses the square root of their number."""
    rows = t.embeddings.select(F.col("vec_id").alias("k"), F.col("embedding").alias("y"))
    q = t.embeddings.where("vec_id % 25 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("x"))
    out = T.turbo_sparse_attention(q, ranking.coded_vectors(rows, 4), ranking.coded_vectors(rows, 8), 4, 8)
    return out.select("q", F.col("j").cast("long").alias("j"), r6("value", "value"))


@add(
    """WITH i AS (SELECT vec_id AS n, (pos - 1) // 16 AS c, (pos - 1) % 16 // 4 AS y, (pos - 1) % 4 AS x, v[pos] AS value FROM (SELECT vec_id, embedding::DOUBLE[] AS v, unnest(range(1, 65)) AS pos FROM embeddings)),
k AS (SELECT o, c, ky, kx, (o + c + 1) * (ky - kx) / 8.0::DOUBLE AS w FROM range(4) a(o), range(2) b(c), range(2) d(ky), range(2) e(kx))
SELECT n, o, y - ky AS y, x - kx AS x, round(sum(value * w) + max(o) / 2.0, 6) + 0.0 AS value FROM i JOIN k ON i.c = o // 2 * 2 + k.c WHERE y - ky BETWEEN 0 AND 2 AND x - kx BETWEEN 0 AND 2 GROUP BY ALL"""
)
def tensor_conv2d_groups(t: Tables):
    """Four channels and four outputs in two groups, with a bias."""
    e = t.embeddings.select(F.col("vec_id").alias("n"), F.posexplode("embedding").alias("p", "value"))
    image = e.select("n", F.floor(F.col("p") / 16).alias("c"), F.floor(F.col("p") % 16 / 4).alias("y"), (F.col("p") % 4).cast("long").alias("x"), F.col("value").cast("double").alias("value"))
    k = t.spark.range(32).select(F.floor(F.col("id") / 8).alias("o"), F.floor(F.col("id") % 8 / 4).alias("c"), F.floor(F.col("id") % 4 / 2).alias("ky"), (F.col("id") % 2).alias("kx"))
    kernel = k.withColumn("w", (F.col("o") + F.col("c") + 1) * (F.col("ky") - F.col("kx")) / 8.0)
    bias = t.spark.range(4).select(F.col("id").alias("o"), (F.col("id") / 2.0).alias("bias"))
    out = T.conv2d(image, kernel, height=4, width=4, kh=2, kw=2, groups=2, channels=4, outputs=4, bias=bias)
    return out.select("n", "o", "y", "x", r6("value", "value"))


# --- teacher scores ----------------------------------------------------------------------------------------------------


@add(f"WITH {_CAND}, {_PER}, j AS (SELECT *, rank = 1 AS top1, coalesce(margin, 0) AS m, rank = 1 AND coalesce(margin, 0) >= 0.01 AND entropy / ln(n) <= 0.999 AS ok FROM per) SELECT count(*) AS examples, sum(n)::BIGINT AS candidates, 0::BIGINT AS missing, count(*) AS scored, count(*) FILTER (ok) AS kept, count(*) FILTER (NOT ok) AS cleared, 0::BIGINT AS dropped, round(avg(top1::INT), 6) AS top1_before, round(coalesce(avg(CASE WHEN ok THEN top1::INT END), 0), 6) AS top1_after, round(avg(m), 6) + 0.0 AS margin_before, round(coalesce(avg(CASE WHEN ok THEN m END), 0), 6) AS margin_after FROM j")
def teacher_filter_summary(t: Tables):
    s = S.filter_summary(S.judged(candidates(t), True, 0.01, 0.999))
    return s.select("examples", "candidates", "missing", "scored", "kept", "cleared", "dropped", *[r6(c, c) for c in ("top1_before", "top1_after", "margin_before", "margin_after")])


@add(f"WITH {_CAND}, {_PER} SELECT c.example, slot, CASE WHEN rank = 1 AND margin >= 0.01 AND entropy / ln(n) <= 0.999 THEN score END AS score FROM c JOIN per USING (example)")
def teacher_filter_clear(t: Tables):
    c = candidates(t)
    return S.filter_scores(c, S.judged(c, True, 0.01, 0.999)).select("example", "slot", "score")


@add(f"WITH {_CAND}, v AS (SELECT example, list(score ORDER BY slot) AS scores FROM c WHERE example % 2 = 0 GROUP BY ALL), s AS (SELECT example, slot, score FROM c WHERE example % 2 = 1 AND example % 5 <> 0) SELECT c.example, c.slot, CASE WHEN c.example % 6 = 0 THEN NULL ELSE coalesce(v.scores[c.slot + 1], s.score) END AS score FROM c LEFT JOIN v USING (example) LEFT JOIN s ON s.example = c.example AND s.slot = c.slot")
def teacher_import_vectors(t: Tables):
    """Vectors for the even examples (one score short for every sixth, which then has none), single scores for others."""
    c = candidates(t)
    v = c.where("example % 2 = 0").groupBy("example", "source", "query").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "score"))), lambda z: z["score"]).alias("v"))
    short = F.when(F.col("example") % 6 == 0, F.slice("v", F.lit(1), F.size("v") - 1)).otherwise(F.col("v"))
    none = F.lit(None)
    vectors = v.select(F.concat(F.lit(" "), F.col("source")).alias("source"), "query", none.cast("string").alias("text"), none.cast("double").alias("score"), short.alias("scores"))
    single = c.where("example % 2 = 1 and example % 5 <> 0").select("source", "query", "text", "score").distinct().withColumn("scores", none.cast("array<double>"))
    return S.import_scores(c.drop("score"), vectors.unionByName(single)).select("example", "slot", "score")


@add(f"{_RELABEL}, k AS (SELECT example, list(DISTINCT text) AS own FROM l WHERE action = 'kept' GROUP BY ALL) SELECT l.example, slot, query, text AS positive, len(list_filter(coalesce(own, []), lambda x: x <> text)) AS kept, greatest(0, least(5 - len(list_filter(coalesce(own, []), lambda x: x <> text)), len(list_filter(coalesce(pool, []), lambda x: x <> text AND NOT list_contains(coalesce(own, []), x))))) + len(list_filter(coalesce(own, []), lambda x: x <> text)) AS n FROM l LEFT JOIN k USING (example) LEFT JOIN (SELECT query, list(DISTINCT text) AS pool FROM c WHERE slot > 0 AND score <= 0.02 GROUP BY ALL) USING (query) WHERE action IN ('original', 'promoted')")
def teacher_relabel_with_pool(t: Tables):
    """How many negatives each relabelled pair has of its own, and with those from its query's pool."""
    c = candidates(t)
    r = S.relabel(c, 0.1, 0.1, 0.05, 2)
    own = S.with_pool(r, S.negative_pool(c, 0.02).limit(0), 0).select("example", "slot", F.size("negatives").cast("long").alias("kept"))
    filled = S.with_pool(r, S.negative_pool(c, 0.02), 5).select("example", "slot", "query", "positive", F.size("negatives").cast("long").alias("n"))
    return filled.join(own, ["example", "slot"]).select("example", "slot", "query", "positive", "kept", "n")


@add(
    f"""WITH {_ALL}, r AS (SELECT *, d % 7 / 7.0::DOUBLE AS teacher, CASE WHEN q % 3 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS tt, (q % 4)::DOUBLE AS weight, count(*) OVER (PARTITION BY q) AS n FROM c),
e AS (SELECT *, exp((score - max(score) OVER w) / 0.05) AS m, exp((teacher - max(teacher) OVER w) / tt) AS t FROM r WHERE n >= 2 AND weight > 0 WINDOW w AS (PARTITION BY q)), p AS (SELECT q, weight, m / sum(m) OVER w AS pm, t / sum(t) OVER w AS pt FROM e WINDOW w AS (PARTITION BY q))
SELECT q, round(sum(-weight * pt * ln(greatest(pm, 1e-12))), 6) + 0.0 AS loss FROM p GROUP BY q"""
)
def loss_teacher_by_source(t: Tables):
    """Each query's source has a temperature and a weight of its own."""
    c = _contrast(t).withColumn("teacher", F.col("d") % 7 / 7.0)
    c = c.withColumn("teacher_temperature", F.when(F.col("q") % 3 == 0, 0.5).otherwise(0.0)).withColumn("weight", (F.col("q") % 4).cast("double"))
    return metrics.teacher_loss(c, "q", model_temperature=0.05).select("q", r6("loss", "loss"))


@add(
    """WITH v AS (SELECT vec_id, vec_id // 64 AS batch, vec_id // 8 AS own, vec_id % 8 AS slot, embedding::DOUBLE[] AS v FROM embeddings),
m AS (SELECT a.own AS q, c.own AS own, c.slot, list_cosine_similarity(a.v, c.v) AS score FROM v a JOIN v c ON a.batch = c.batch AND a.slot = 0 AND c.slot > 0),
e AS (SELECT *, exp((score - max(score) OVER (PARTITION BY q)) / 0.05) AS e FROM m), g AS (SELECT *, exp((score - max(score) OVER (PARTITION BY q)) / 0.05) AS e FROM m WHERE q = own),
w AS (SELECT q, -ln(greatest(sum(e) FILTER (own = q AND slot = 1) / sum(e), 1e-12)) AS l FROM e GROUP BY q), h AS (SELECT q, -ln(greatest(sum(e) FILTER (slot = 1) / sum(e), 1e-12)) AS l, count(*) AS n FROM g GROUP BY q)
SELECT round((SELECT avg(l) FROM w), 6) AS whole, round((SELECT avg(l) FROM h WHERE n >= 2), 6) AS grouped, round((SELECT avg(l) FROM w) + 0.5 * (SELECT avg(l) FROM h WHERE n >= 2), 6) AS hybrid"""
)
def loss_hard_negatives(t: Tables):
    """Groups of a query, its positive and six negatives: against all candidates of a batch, and within the groups."""
    e = t.embeddings.select(F.floor(F.col("vec_id") / 64).alias("batch"), F.floor(F.col("vec_id") / 8).alias("q"), (F.col("vec_id") % 8).alias("slot"), F.col("embedding").alias("y"))
    anchors = e.where("slot = 0").select("batch", "q", F.col("y").alias("x"))
    whole, grouped = metrics.hard_negative_scores(anchors, e.where("slot > 0").withColumn("slot", F.col("slot") - 1), ["batch"])
    h = metrics.hybrid_info_nce(whole, grouped, "q", weight=0.5, least=2)
    return h.select(r6("whole", "whole"), r6("grouped", "grouped"), r6("hybrid", "hybrid"))


@add(
    f"""WITH {turned_sql(4, 16).replace('embedding::DOUBLE[] AS e', 'embedding[1:16]::DOUBLE[] AS e')}, c AS (SELECT a.vec_id AS q, a.vec_id = b.vec_id AS is_target, list_cosine_similarity(a.y, b.y) AS score FROM coded a JOIN coded b ON a.vec_id // 64 = b.vec_id // 64),
e AS (SELECT *, exp((score - max(score) OVER (PARTITION BY q)) / 0.05) AS e FROM c) SELECT round(avg(-ln(greatest(l, 1e-12))), 6) AS loss FROM (SELECT q, sum(e) FILTER (is_target) / sum(e) AS l FROM e GROUP BY q)"""
)
def loss_quantized_prefix(t: Tables):
    """The contrastive loss on the first sixteen components in four bits."""
    rows = metrics.quantized_prefix(t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), "embedding", 16, 4)
    batch = F.floor(F.col("id") / 64).alias("batch")
    m = rows.select(F.col("id").alias("q"), F.col("embedding").alias("x"), batch).join(rows.select(F.col("id").alias("d"), F.col("embedding").alias("y"), batch), "batch")
    m = m.select("q", V.cosine(F.col("x"), F.col("y")).alias("score"), (F.col("q") == F.col("d")).alias("is_target"))
    return metrics.info_nce(m, "q").agg(r6(F.avg("loss"), "loss"))


# --- texts and series --------------------------------------------------------------------------------------------------

_G = "CASE WHEN {x} = 0 THEN '0' ELSE regexp_replace(({x})::VARCHAR, '\\.0$', '') END"


@add(
    f"""WITH s AS (SELECT vec_id AS id, 'l' || label AS label, list_transform(embedding::DOUBLE[], lambda x: round(x * 64)) AS v FROM embeddings),
w AS (SELECT id, label, start, v[start + 1 : start + 16] AS v FROM (SELECT *, unnest([0, 12, 24, 36, 48]) AS start FROM s))
SELECT id, start, 'label: ' || label || chr(10) || 'series_id: ' || id || chr(10) || 'window: start=' || start || ' end=' || (start + 16) || ' count=16' || chr(10) || 'values: ' || array_to_string(list_transform(v, lambda x: {_G.format(x='x')}), ' ') || chr(10) || 'stats: min=' || {_G.format(x='list_min(v)')} || ' max=' || {_G.format(x='list_max(v)')} || ' mean=' || {_G.format(x='list_sum(v) / 16')} || ' first=' || {_G.format(x='v[1]')} || ' last=' || {_G.format(x='v[16]')} || ' delta=' || {_G.format(x='v[16] - v[1]')} AS text FROM w"""
)
def series_rendering(t: Tables):
    s = t.embeddings.select(F.col("vec_id").alias("id"), F.concat(F.lit("l"), "label").alias("label"), F.lit("").alias("text"), F.transform("embedding", lambda x: F.round(x.cast("double") * 64) + 0.0).alias("values"))
    return C.render_series(s, C.numeric_windows(s, 16, 12))


_PARTS = "list_filter(list_transform(string_split_regex(text, '[.!?;:]'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: strlen(x) >= 8)"
_LINES = f"""l AS (SELECT doc_id AS pos, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents), p AS (SELECT pos, {_PARTS} AS s FROM l),
a AS (SELECT 0 AS kind, pos, k, s[k] AS query, s[k + 1] AS positive FROM (SELECT pos, s, unnest(range(1, len(s))) AS k FROM p)),
b AS (SELECT 1 AS kind, pos, 0 AS k, text AS query, lead(text) OVER (ORDER BY pos) AS positive FROM l), u AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE positive IS NOT NULL),
f AS (SELECT query, positive, min((kind, pos, k)) AS place FROM u WHERE strlen(query) >= 8 AND strlen(positive) >= 8 AND query <> positive GROUP BY ALL), m AS (SELECT row_number() OVER (ORDER BY place) - 1 AS i, query, positive FROM f)"""


@add(f"WITH {_LINES} SELECT i, md5(query) AS query, md5(positive) AS positive FROM m")
def mined_text_pairs(t: Tables):
    """Neighbouring parts and lines, documents standing for lines; texts as their hashes."""
    p = C.mined_pairs(t.documents.select(F.col("doc_id").alias("pos"), "text"))
    return p.select("i", F.md5(F.col("query").cast("binary")).alias("query"), F.md5(F.col("positive").cast("binary")).alias("positive"))


@add(
    f"""WITH {_LINES}, n AS (SELECT count(*) AS n FROM m), e AS (SELECT * FROM m WHERE i < (SELECT least(40, n // 2) FROM n)), x AS (SELECT e.i, e.query, m.positive AS other, (m.i - e.i - 1 + n) % n AS k FROM e JOIN m ON m.positive <> e.positive AND m.positive <> e.query, n)
SELECT md5(query) AS query, md5(positive) AS "right", 1 AS target FROM e UNION ALL SELECT md5(query), md5(min_by(other, k)), -1 FROM x GROUP BY i, query"""
)
def mined_eval_pairs(t: Tables):
    """The first forty pairs, each with its positive and the next other one."""
    _, held = C.mined_train_and_eval(t.documents.select(F.col("doc_id").alias("pos"), "text"), 40)
    return held.select(F.md5(F.col("query").cast("binary")).alias("query"), F.md5(F.col("right").cast("binary")).alias("right"), "target")


# --- gates -------------------------------------------------------------------------------------------------------------

_SIDE = "SELECT o_orderstatus AS dataset, avg(o_totalprice) AS price FROM orders WHERE o_orderkey % 2 = {half} GROUP BY ALL"


@add(f"WITH a AS ({_SIDE.format(half=0)}), b AS ({_SIDE.format(half=1)}) SELECT 'price' AS metric, round(b.price, 4) AS current, round(a.p, 4) AS anchor, round(b.price - a.p, 4) + 0.0 AS delta, b.price >= a.p - 5 - 1e-6 AS passes FROM (SELECT price FROM b WHERE dataset = 'F') b, (SELECT avg(price) AS p FROM a) a")
def scoreboard_aliases(t: Tables):
    """One side calls the metric otherwise and has a row of means, which is taken by its word."""
    side = lambda h: t.orders.where(F.col("o_orderkey") % 2 == h).groupBy(F.col("o_orderstatus").alias("dataset")).agg(F.avg("o_totalprice").alias("price")).withColumn("seed", F.lit(1))
    new = side(1).withColumnRenamed("price", "mean_price").withColumn("dataset", F.when(F.col("dataset") == "F", "macro").otherwise(F.col("dataset")))
    old = side(0)
    old = old.withColumn("dataset", F.when(F.col("dataset") == "F", "macro").otherwise(F.col("dataset")))
    means = old.agg(F.avg("price").alias("price")).select(F.lit("macro").alias("dataset"), "price", F.lit(1).alias("seed"))
    g = G.gate_scoreboard(new, old.where("dataset <> 'macro'").unionByName(means), ["price"], 5.0, aliases={"price": ["mean_price"]}, macro="macro")
    return g.select("metric", r6("current", "current", 4), r6("anchor", "anchor", 4), r6("delta", "delta", 4), "passes")


@add("WITH s AS (SELECT o_orderpriority AS metric, o_orderkey AS step, o_totalprice AS value FROM orders), m AS (SELECT metric, min_by(value, step) AS first, max_by(value, step) AS last, min(value) AS least, max(value) AS most, count(*) AS steps FROM s GROUP BY ALL) SELECT metric, round(first, 4) AS first, round(last, 4) AS last, round(least, 4) AS least, round(most, 4) AS most, steps, CASE WHEN metric IN ('1-URGENT', '2-HIGH') AND last >= first THEN 'does not fall' WHEN metric = '5-LOW' AND last < 1000000 THEN 'below its floor' END AS warning FROM m")
def training_diagnosis(t: Tables):
    s = t.orders.select(F.col("o_orderpriority").alias("metric"), F.col("o_orderkey").alias("step"), F.col("o_totalprice").cast("double").alias("value"))
    d = G.diagnose_training(s, ["1-URGENT", "2-HIGH"], {"5-LOW": 1_000_000.0})
    return d.select("metric", *[r6(c, c, 4) for c in ("first", "last", "least", "most")], "steps", "warning")
