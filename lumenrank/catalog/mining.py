"""Mining and teacher operators over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import mining as M
from ..operators import ranking
from ..operators import teacher as T
from ..tables import materialise
from .base import Registry, Tables, r6
from .evaluation import _METRICS, _QRELS, _metrics, qrels
from .retrieval import _POSITIVE, benchmark, bm25_index, bm25_sql, children, dense, dense_sql, positives

_R = Registry()
QUERIES, SQL = _R.queries, _R.sql
add = _R.add


@add("SELECT l_suppkey AS query_id, l_partkey AS doc_id, max_by(l_quantity - 25, l_orderkey * 10 + l_linenumber)::DOUBLE AS rel FROM lineitem WHERE l_quantity > 25 GROUP BY 1, 2")
def qrels_last_wins(t: Tables):
    """Rows of no relevance are passed over before the last one of a pair is taken."""
    place = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = t.lineitem.select(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("doc_id"), (F.col("l_quantity") - 25).cast("double").alias("rel"), place.alias("place"))
    return M.last_wins(rows.where("rel > 0"), ["query_id", "doc_id"], "rel", "place")


@add("SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def corpus_first_wins(t: Tables):
    return M.first_wins(t.documents, ["text"], "doc_id").select("source", "doc_id", "n_chars")


@add("WITH r AS (SELECT doc_id FROM labels WHERE toxic = 1), d AS (SELECT doc_id, n_chars, doc_id IN (SELECT doc_id FROM r) AS rel FROM documents), o AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) AS i FROM d WHERE NOT rel) SELECT doc_id, n_chars FROM d WHERE rel UNION ALL SELECT doc_id, n_chars FROM o WHERE i <= greatest(0, 300 - (SELECT count(*) FROM d WHERE rel))")
def corpus_cap(t: Tables):
    return M.corpus_cap(t.documents.select("doc_id", "n_chars"), t.labels.where("toxic = 1"), 300)


@add("SELECT count(*) FILTER (d.doc_id IS NOT NULL) AS found, count(*) FILTER (d.doc_id IS NULL) AS missing FROM (SELECT DISTINCT event_id AS q FROM events WHERE event_type = 'click' OR event_id % 7 = 0) LEFT JOIN documents d ON d.doc_id = q")
def query_scan_missing(t: Tables):
    q = t.events.where("event_type = 'click' or event_id % 7 = 0").select(F.col("event_id").alias("q")).distinct()
    d = t.documents.select("doc_id")
    m = q.join(d, q["q"] == d["doc_id"], "left")
    return m.agg(F.count("doc_id").alias("found"), F.count_if(F.col("doc_id").isNull()).alias("missing"))


@add("SELECT d.doc_id, round(v[1] / sqrt(list_inner_product(v, v)), 6) + 0.0 AS first FROM documents d JOIN (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) ON vec_id = doc_id")
def vector_cache_align(t: Tables):
    e = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.get(V.normalize(F.col("embedding")), F.lit(0)).alias("x"))
    return t.documents.select("doc_id").join(e, "doc_id").select("doc_id", r6("x", "first"))


@add(f"WITH {_QRELS} SELECT query_id, doc_id, rel, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc_id) AS nth FROM qrels WHERE doc_id IN (SELECT doc_id FROM documents WHERE length(trim(text)) > 0)")
def positives_per_query(t: Tables):
    return M.positives_per_query(qrels(t), t.documents)


@add(
    f"""WITH {bm25_sql()}, {_POSITIVE}, top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm25_s s ANTI JOIN positives p ON s.query_id = p.query_id AND s.doc_id = p.doc_id QUALIFY rank <= 50),
d AS (SELECT top.*, row_number() OVER (PARTITION BY query_id, trim(text) ORDER BY rank) AS d FROM top JOIN documents USING (doc_id) WHERE trim(text) <> '')
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM d WHERE d = 1 QUALIFY nth <= 5"""
)
def bm25_hard_negatives(t: Tables):
    p = materialise(positives(t), "positives")  # read twice
    return M.hard_negatives(bm25_index(t).top_k(benchmark(t), 50, zero_fill=False, without=p), p, t.documents, 5)


@add(
    f"""WITH {dense_sql(60)}, {_QRELS}, d AS (SELECT r.query_id, r.doc_id, r.score, r.rank, row_number() OVER (PARTITION BY r.query_id, trim(text) ORDER BY rank) AS d FROM dense r ANTI JOIN qrels q ON r.query_id = q.query_id AND r.doc_id = q.doc_id JOIN documents ON documents.doc_id = r.doc_id WHERE trim(text) <> '')
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM d WHERE d = 1 QUALIFY nth <= 5"""
)
def dense_hard_negatives(t: Tables):
    return M.hard_negatives(dense(t, 60), qrels(t), t.documents, 5)


@add(f"WITH {dense_sql(150)}, {dense_sql(200, '-list_distance(x, y)', 'lex')}, m AS (SELECT d.query_id, d.doc_id, d.rank, l.rank AS compact_rank FROM dense d JOIN lex l ON d.query_id = l.query_id AND d.doc_id = l.doc_id) SELECT query_id, doc_id, rank, compact_rank, CASE WHEN rank <= 10 THEN 'top10' WHEN compact_rank > 100 OR rank > 90 THEN 'rank_boundary' ELSE 'compact' END AS reason FROM m")
def compact_negative_reasons(t: Tables):
    c = dense(t, 200, "l2").select("query_id", "doc_id", F.col("rank").alias("compact_rank"))
    m = dense(t, 150).join(c, ["query_id", "doc_id"])
    return m.select("query_id", "doc_id", "rank", "compact_rank", M.reason(F.col("rank"), F.col("compact_rank")).alias("reason"))


_WALK = "('0x' || substr(sha256('s1:{k}:' || item_id), 1, 15))::BIGINT"


@add(
    f"""WITH {_POSITIVE}, c AS (SELECT count(*) AS n, list_filter([{', '.join(map(str, M.STEPS))}], lambda p: count(*) % p <> 0) AS steps FROM documents), d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents),
b AS (SELECT item_id, count(doc_id) AS b FROM benchmark LEFT JOIN positives ON query_id = item_id GROUP BY ALL),
a AS (SELECT item_id AS query_id, {_WALK.format(k='start')} % n AS start, steps[1 + {_WALK.format(k='step')} % len(steps)] AS step, n, unnest(range(0, least(b + 5, n))) AS k FROM b, c),
m AS (SELECT a.query_id, d.doc_id, k FROM a JOIN d ON d.i = (start + k * step) % n)
SELECT m.query_id, m.doc_id, row_number() OVER (PARTITION BY m.query_id ORDER BY k) AS nth FROM m ANTI JOIN positives p ON p.query_id = m.query_id AND p.doc_id = m.doc_id QUALIFY nth <= 5"""
)
def sampled_negatives(t: Tables):
    return M.sampled_negatives(benchmark(t), t.documents.select("doc_id"), positives(t), 5, "s1")


@add("SELECT doc_id, CASE WHEN ('0x' || substr(sha256('s:' || doc_id), 1, 8))::BIGINT / 4294967296.0 < 0.8 THEN 'train' WHEN ('0x' || substr(sha256('s:' || doc_id), 1, 8))::BIGINT / 4294967296.0 < 0.9 THEN 'dev' ELSE 'test' END AS split FROM documents")
def hash_split(t: Tables):
    return M.hash_split(t.documents.select("doc_id"), "doc_id", "s", [("train", 0.8), ("dev", 0.1), ("test", 0.1)])


@add("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY sha256('s:' || doc_id)) <= greatest(1, least(floor(0.75 * count(*) OVER ()), count(*) OVER () - 1)) THEN 'train' ELSE 'eval' END AS split FROM documents")
def ordered_hash_split(t: Tables):
    return M.ordered_split(t.documents.select("doc_id"), "doc_id", "s", 0.75)


_PAIRS = "pairs AS (SELECT source AS query, text, toxic = 0 AS good, doc_id AS pos FROM documents JOIN labels USING (doc_id))"


def _pairs(t: Tables):
    p = t.documents.select("doc_id", "source", "text").join(t.labels, "doc_id")
    return p.select(F.col("source").alias("query"), F.sha2(F.col("text").cast("binary"), 256).alias("text"), F.when(F.col("toxic") == 0, 1).otherwise(0).alias("label"), F.col("doc_id").alias("pos"))


_GROUPS = f"""WITH {_PAIRS}, p AS (SELECT query, sha256(text) AS positive, row_number() OVER (PARTITION BY query ORDER BY pos) - 1 AS i FROM pairs WHERE good),
n AS (SELECT query, list(sha256(text) ORDER BY pos) AS n FROM pairs WHERE NOT good GROUP BY query),
g AS (SELECT query, positive, list_transform(range(0, least(len(n), 2)), lambda j: n[(i + j) % len(n) + 1]) AS negatives FROM p JOIN n USING (query))"""


@add(f"{_GROUPS} SELECT query, positive, array_to_string(negatives, ',') AS negatives FROM g")
def hard_negative_groups(t: Tables):
    return M.group_hard_negatives(_pairs(t), 2).select("query", "positive", F.array_join("negatives", ",").alias("negatives"))


@add(f"{_GROUPS} SELECT query, positive AS text, 1 AS label FROM (SELECT query, positive, unnest(negatives) AS x FROM g) UNION ALL SELECT query, unnest(negatives) AS text, 0 AS label FROM g")
def hard_negative_pairs(t: Tables):
    return M.flatten_hard_negatives(M.group_hard_negatives(_pairs(t), 2))


@add(f"{_GROUPS} SELECT query, slot - 1 AS slot, CASE WHEN slot = 1 THEN 'positive' ELSE 'negative' END AS role, text FROM (SELECT query, unnest(list_concat([positive], negatives)) AS text, unnest(range(1, len(negatives) + 2)) AS slot FROM g)")
def teacher_score_requests(t: Tables):
    g = M.group_hard_negatives(_pairs(t), 2).withColumn("example", F.xxhash64("query", "positive")).withColumn("source", F.lit("s")).withColumn("teacher_scores", F.lit(None).cast("array<double>"))
    return T.requests(g, missing_only=True).select("query", F.col("slot").cast("long").alias("slot"), "role", "text")


@add(f"WITH {dense_sql(40)}, {_QRELS}, l AS (SELECT r.query_id, min_by(r.doc_id, r.rank) AS positive_id, min(r.rank) AS at FROM dense r SEMI JOIN qrels q ON r.query_id = q.query_id AND r.doc_id = q.doc_id WHERE rank > 2 AND rank <= 40 GROUP BY ALL), a AS (SELECT r.query_id, l.positive_id, r.doc_id, r.rank FROM dense r ANTI JOIN qrels q ON r.query_id = q.query_id AND r.doc_id = q.doc_id JOIN l ON l.query_id = r.query_id WHERE r.rank < l.at) SELECT query_id, positive_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY (rank <= 2)::INT, rank) AS nth FROM a QUALIFY nth <= 4")
def boundary_losses(t: Tables):
    return M.boundary_losses(dense(t, 40), qrels(t), 2, 40, 4)


@add(
    f"""WITH {_METRICS}, {dense_sql(100, '-list_distance(x, y)', 'lex')}, x AS (SELECT query_id, min(rank) AS first, sum(CASE WHEN rank <= 10 THEN rel / log2(rank + 1) ELSE 0 END) AS dcg FROM lex JOIN qrels USING (query_id, doc_id) GROUP BY ALL),
t AS (SELECT i.query_id, coalesce(dcg, 0) / ideal10 AS n, coalesce(first, 0) AS f FROM ideal i LEFT JOIN x USING (query_id))
SELECT query_id, round(n - ndcg_10, 6) AS gap, CASE WHEN first_relevant_rank = 0 THEN 1000 ELSE first_relevant_rank END - CASE WHEN f = 0 THEN 1000 ELSE f END AS improvement FROM m JOIN t USING (query_id) WHERE round(n - ndcg_10, 6) >= -0.05"""
)
def quality_frontier(t: Tables):
    from ..operators import metrics

    return M.quality_frontier(_metrics(t), metrics.per_query(dense(t, 100, "l2"), qrels(t)), -0.05)


_FRONT = """WITH r AS (SELECT o_custkey % 50 AS query_id, o_orderstatus AS positive, o_orderkey AS pos, ['n' || (o_orderkey % 7), 'n' || (o_orderkey % 5)] AS n FROM orders),
e AS (SELECT query_id, positive, pos, unnest(n) AS negative, unnest([0, 1]) AS k FROM r), f AS (SELECT query_id, positive, negative, min((pos, k)) AS seen FROM e GROUP BY ALL)
SELECT query_id, positive, array_to_string((list(negative ORDER BY seen))[1:4], ',') AS negatives FROM f GROUP BY query_id, positive"""


@add(_FRONT)
def frontier_curation(t: Tables):
    n = F.array(F.concat(F.lit("n"), F.col("o_orderkey") % 7), F.concat(F.lit("n"), F.col("o_orderkey") % 5))
    rows = t.orders.select((F.col("o_custkey") % 50).alias("query_id"), F.col("o_orderstatus").alias("positive"), F.col("o_orderkey").alias("pos"), n.alias("negatives"))
    return M.curate_frontier(rows, 4).select("query_id", "positive", F.array_join("negatives", ",").alias("negatives"))


@add("SELECT d.doc_id AS asked, u.doc_id FROM documents d LEFT JOIN (SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text) u USING (text)")
def text_resolution(t: Tables):
    """The text of every document, traced back to the first document that has it."""
    rows = t.documents.select(F.col("doc_id").alias("asked"), "text")
    return M.resolve_texts(rows, t.documents.select("doc_id", "text")).select("asked", "doc_id")


@add("WITH u AS (SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text HAVING count(*) = 1) SELECT d.doc_id AS asked, coalesce(u.doc_id, -1) AS doc_id FROM documents d LEFT JOIN u USING (text)")
def text_resolution_unambiguous(t: Tables):
    rows = t.documents.select(F.col("doc_id").alias("asked"), "text")
    return M.resolve_texts(rows, t.documents.select("doc_id", "text"), unique=True).select("asked", F.coalesce("doc_id", F.lit(-1)).alias("doc_id"))


@add("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def provenance_safe_rows(t: Tables):
    rows = M.without_leaks(t.orders.select("o_orderkey", "o_custkey"), t.customer.where("c_nationkey = 3").select(F.col("c_custkey").alias("id")), ["o_custkey"])
    return M.without_leaks(rows, t.lineitem.where("l_quantity > 49").select(F.col("l_orderkey").alias("id")), ["o_orderkey"])


# --- teacher scores: groups of eight vectors, scored by cosine with their first one -----------------------------------

_CAND = "c AS (SELECT a.vec_id // 8 AS example, 's' || (a.vec_id // 8 % 4) || ':' || (a.vec_id // 8 % 3) AS source, (a.vec_id // 8)::VARCHAR AS query, a.vec_id % 8 AS slot, (a.vec_id % 40)::VARCHAR AS text, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) * CASE WHEN a.vec_id % 8 = 0 THEN 0.15 ELSE 1 END, 6) + 0.0 AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id // 8 * 8)"


def candidates(t: Tables):
    a = t.embeddings.select("vec_id", F.col("embedding").alias("y"), F.floor(F.col("vec_id") / 8).alias("example"))
    b = t.embeddings.where("vec_id % 8 = 0").select(F.floor(F.col("vec_id") / 8).alias("example"), F.col("embedding").alias("x"))
    slot = F.col("vec_id") % 8
    score = V.cosine(F.col("x"), F.col("y")) * F.when(slot == 0, 0.15).otherwise(1.0)
    source = F.concat(F.lit("s"), F.col("example") % 4, F.lit(":"), F.col("example") % 3)
    return a.join(b, "example").select("example", source.alias("source"), F.col("example").cast("string").alias("query"), slot.alias("slot"), (F.col("vec_id") % 40).cast("string").alias("text"), r6(score, "score"))


_PER = """e AS (SELECT *, max(CASE WHEN slot = 0 THEN score END) OVER w AS pos, exp(score - max(score) OVER w) AS x FROM c WINDOW w AS (PARTITION BY example)), p AS (SELECT *, x / sum(x) OVER (PARTITION BY example) AS p FROM e),
per AS (SELECT example, source, 1 + count(*) FILTER (slot > 0 AND score > pos) AS rank, max(pos) - max(CASE WHEN slot > 0 THEN score END) AS margin, max(score) - min(score) AS range, sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) AS entropy, count(*) AS n FROM p GROUP BY ALL)"""


@add(f"WITH {_CAND}, {_PER} SELECT source, grouping(source) AS is_total, count(*) AS examples, round(avg((rank = 1)::INT), 6) AS top1_rate, round(avg(rank), 6) AS mean_rank, round(avg(margin), 6) + 0.0 AS mean_margin, round(avg(range), 6) AS mean_range, round(avg(entropy), 6) AS mean_entropy, round(avg(CASE WHEN n > 1 THEN entropy / ln(n) ELSE 0 END), 6) AS mean_entropy_share FROM per GROUP BY ROLLUP (source)")
def teacher_audit(t: Tables):
    a = T.audit(candidates(t))
    return a.select("source", "is_total", "examples", *[r6(c, c) for c in ("top1_rate", "mean_rank", "mean_margin", "mean_range", "mean_entropy", "mean_entropy_share")])


@add(f"WITH {_CAND}, {_PER} SELECT example, slot, score FROM c WHERE example IN (SELECT example FROM per WHERE rank <= 1 AND margin >= 0.01 AND entropy <= 2.079)")
def teacher_filter(t: Tables):
    return T.keep(candidates(t), True, 0.01, 2.079).select("example", "slot", "score")


for _mode, _key in (("source", "source"), ("family", "split_part(source, ':', 1)"), ("example", "example")):

    def _make(mode=_mode):
        return lambda t: T.normalize(candidates(t), mode).select("example", "slot", r6("score", "score"))

    _f = _make()
    _f.__name__ = f"teacher_normalize_{_mode}"
    add(f"WITH {_CAND} SELECT example, slot, round((score - avg(score) OVER w) / CASE WHEN var_pop(score) OVER w < 1e-12 THEN 1 ELSE stddev_pop(score) OVER w END, 6) + 0.0 AS score FROM c WINDOW w AS (PARTITION BY {_key})")(_f)


@add(f"WITH {_CAND}, s AS (SELECT CASE WHEN example % 3 = 0 THEN '' ELSE source END AS source, query, text, score FROM c WHERE example % 5 <> 0 OR slot <> 2), j AS (SELECT c.example, c.slot, coalesce(s1.score, s2.score) AS score FROM c LEFT JOIN s s1 ON s1.source = c.source AND s1.source <> '' AND s1.query = c.query AND s1.text = c.text LEFT JOIN s s2 ON s2.source = '' AND s2.query = c.query AND s2.text = c.text) SELECT example, slot, CASE WHEN count(score) OVER w = count(*) OVER w THEN score END AS score FROM j WINDOW w AS (PARTITION BY example)")
def teacher_import(t: Tables):
    c = candidates(t)
    s = c.where("example % 5 <> 0 or slot <> 2").withColumn("source", F.when(F.col("example") % 3 == 0, "").otherwise(F.col("source"))).select("source", "query", "text", "score")
    return T.import_scores(c.drop("score"), s).select("example", "slot", "score")


_RELABEL = f"WITH {_CAND}, e AS (SELECT *, max(CASE WHEN slot = 0 THEN score END) OVER (PARTITION BY example) AS pos FROM c), a AS (SELECT *, slot > 0 AND score >= 0.1 AND score >= pos - 0.1 AS able FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY example ORDER BY able DESC, score DESC, slot) AS nth FROM a), l AS (SELECT *, CASE WHEN slot = 0 THEN 'original' WHEN able AND nth <= 2 THEN 'promoted' WHEN NOT able AND score <= 0.05 THEN 'kept' ELSE 'dropped' END AS action FROM r)"


@add(f"{_RELABEL} SELECT example, slot, action FROM l")
def teacher_relabel(t: Tables):
    return T.relabel(candidates(t), 0.1, 0.1, 0.05, 2).select("example", "slot", "action")


@add(f"{_RELABEL} SELECT query, text AS positive, action AS origin FROM l WHERE action IN ('original', 'promoted') QUALIFY row_number() OVER (PARTITION BY query, text ORDER BY (action = 'promoted')::INT, example, slot) = 1")
def teacher_relabelled_pairs(t: Tables):
    return T.relabelled_pairs(T.relabel(candidates(t), 0.1, 0.1, 0.05, 2))


@add(f"WITH {_CAND}, d AS (SELECT *, row_number() OVER (PARTITION BY query, text ORDER BY example, slot) AS d FROM c WHERE slot > 0 AND score <= 0.02) SELECT query, text, score, row_number() OVER (PARTITION BY query ORDER BY score, example, slot) AS nth FROM d WHERE d = 1")
def teacher_negative_pool(t: Tables):
    return T.negative_pool(candidates(t), 0.02)


@add(f"WITH {_CAND}, two AS (SELECT example, slot, CASE WHEN slot = 0 THEN score + 0.1 ELSE score * 0.5 END AS score FROM c), m AS (SELECT example, max(CASE WHEN slot = 0 THEN score END) - max(CASE WHEN slot > 0 THEN score END) AS m FROM c GROUP BY ALL), m2 AS (SELECT example, max(CASE WHEN slot = 0 THEN score END) - max(CASE WHEN slot > 0 THEN score END) AS m FROM two GROUP BY ALL) SELECT c.example, c.slot, round((c.score + two.score) / 2, 9) + 0.0 AS score FROM c JOIN two ON c.example = two.example AND c.slot = two.slot WHERE c.example IN (SELECT example FROM m WHERE m >= -0.05) AND c.example IN (SELECT example FROM m2 WHERE m >= -0.05)")
def teacher_agreement(t: Tables):
    c = candidates(t)
    two = c.withColumn("score", F.when(F.col("slot") == 0, F.col("score") + 0.1).otherwise(F.col("score") * 0.5))
    return T.agreement([c, two], -0.05).select("example", "slot", r6("score", "score", 9))


@add("SELECT substr(source, 1, 8000) AS query, substr(text, 1, 8000) AS candidate, max(n_chars)::DOUBLE AS score FROM documents GROUP BY ALL")
def teacher_bridge_dedup(t: Tables):
    rows = t.documents.select(F.col("source").alias("query"), F.col("text").alias("candidate"), F.col("n_chars").cast("double").alias("score"))
    return T.bridge_dedup(rows)


@add(f"WITH {_CAND} SELECT example, slot, score FROM c")
def teacher_cosine_scores(t: Tables):
    return T.assert_unique(candidates(t), ["example", "slot"]).select("example", "slot", "score")


@add(f"WITH s AS (SELECT a.vec_id AS query_id, b.vec_id // 5 AS doc_id, max(round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0.0) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 25 = 0 GROUP BY ALL) SELECT * FROM s")
def teacher_child_cache_scores(t: Tables):
    return ranking.dense_multivector(*children(t), metric="cosine", child_digits=6).select("query_id", "doc_id", "score")
