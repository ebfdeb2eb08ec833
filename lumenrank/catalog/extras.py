"""Further operators: factorised entropies, prefix losses, alignment, frontier pairs, model composites."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from ..functions import vectors as V
from ..operators import chunking as C
from ..operators import encoder, hadamard, metrics, ranking
from ..operators import mining as M
from .base import Registry, Tables, r6
from .evaluation import qrels
from .retrieval import _POSITIVE, dense, dense_sql, numbers, positives, turned_sql

_R = Registry()
QUERIES, SQL = _R.queries, _R.sql
add = _R.add

_QRELS = "qrels AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, CASE WHEN a.vec_id % 10 = b.vec_id % 10 THEN 2.0::DOUBLE ELSE 1.0 END AS rel FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 25 = 0)"


@add("WITH b AS (SELECT (vec_id % 16) >> (3 - bit) & 1 AS v, embedding[bit * 2 + 1]::DOUBLE AS z0, embedding[bit * 2 + 2]::DOUBLE AS z1 FROM embeddings, range(4) r(bit)) SELECT round(sum(-log2(greatest(exp(CASE WHEN v = 1 THEN z1 ELSE z0 END - greatest(z0, z1)) / (exp(z0 - greatest(z0, z1)) + exp(z1 - greatest(z0, z1))), 1e-12))), 6) AS bits FROM b")
def loss_cross_entropy_bit_plane(t: Tables):
    """Codes of four bits, most significant first; each bit has a pair of logits."""
    bit = t.embeddings.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("bit"))
    value = F.expr("shiftright(CAST(vec_id % 16 AS INT), 3 - bit) & 1")
    pair = V.softmax(F.slice("embedding", F.col("bit") * 2 + 1, 2))
    return bit.select(F.get(pair, value).alias("p")).agg(r6(F.sum(-F.log2(F.greatest(F.col("p"), F.lit(1e-12)))), "bits"))


_ERF = "(sign({x}) * (1 - (1 / (1 + 0.3275911 * abs({x}))) * (0.254829592 + (1 / (1 + 0.3275911 * abs({x}))) * (-0.284496736 + (1 / (1 + 0.3275911 * abs({x}))) * (1.421413741 + (1 / (1 + 0.3275911 * abs({x}))) * (-1.453152027 + (1 / (1 + 0.3275911 * abs({x}))) * 1.061405429)))) * exp(-{x} * {x})))"


@add(
    f"""WITH s AS (SELECT vec_id % 256 AS sym, embedding[1]::DOUBLE * 10 AS mu, ln(1 + exp(embedding[2]::DOUBLE)) + 1e-6 AS sigma FROM embeddings),
b AS (SELECT sym, (-16 + (sym - 0.5) / 255 * 32 - mu) / sigma / sqrt(2.0) AS lo, (-16 + (sym + 0.5) / 255 * 32 - mu) / sigma / sqrt(2.0) AS hi FROM s),
p AS (SELECT CASE WHEN sym = 255 THEN 1 ELSE 0.5 * (1 + {_ERF.format(x='hi')}) END - CASE WHEN sym = 0 THEN 0 ELSE 0.5 * (1 + {_ERF.format(x='lo')}) END AS p FROM b)
SELECT round(sum(-log2(greatest(p, 1e-12))), 4) AS bits FROM p"""
)
def loss_cross_entropy_log_normal(t: Tables):
    """Coded norms under a normal law of their logarithms, with a softplus scale."""
    sym = F.col("vec_id") % 256
    mu, raw = F.get("embedding", F.lit(0)).cast("double") * 10, F.get("embedding", F.lit(1)).cast("double")
    s = t.embeddings.select(sym.alias("sym"), mu.alias("mu"), (F.ln(1 + F.exp(raw)) + 1e-6).alias("sigma"))
    cdf = lambda edge: 0.5 * (1 + V.erf((-16 + (F.col("sym") + edge) / 255 * 32 - F.col("mu")) / F.col("sigma") / 2**0.5))
    p = F.when(F.col("sym") == 255, 1.0).otherwise(cdf(0.5)) - F.when(F.col("sym") == 0, 0.0).otherwise(cdf(-0.5))
    return s.agg(r6(F.sum(-F.log2(F.greatest(p, F.lit(1e-12)))), "bits", 4))


@add(
    """WITH p AS (SELECT v[pos] AS a, v[pos + 32] AS e FROM (SELECT embedding::DOUBLE[] AS v, unnest(range(1, 33)) AS pos FROM embeddings))
SELECT round(max(abs(a - e)), 6) AS max_abs, round(avg((a - e) * (a - e)), 6) AS mse, round(sum(a * e) / (sqrt(sum(a * a)) * sqrt(sum(e * e))), 6) + 0.0 AS cosine FROM p"""
)
def tensor_difference(t: Tables):
    z = F.explode(F.arrays_zip(F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("e"))).alias("z")
    p = t.embeddings.select(z).select(F.col("z.a").cast("double").alias("a"), F.col("z.e").cast("double").alias("e"))
    d = F.col("a") - F.col("e")
    norms = F.sqrt(F.sum(F.col("a") * F.col("a"))) * F.sqrt(F.sum(F.col("e") * F.col("e")))
    return p.agg(r6(F.max(F.abs(d)), "max_abs"), r6(F.avg(d * d), "mse"), r6(F.when(norms == 0, 1.0).otherwise(F.sum(F.col("a") * F.col("e")) / F.when(norms == 0, 1.0).otherwise(norms)), "cosine"))


@add(
    """WITH d AS (SELECT * FROM (VALUES (16, 0.5::DOUBLE), (32, 0.25), (64, 1.0)) d(dims, w)),
c AS (SELECT dims, w, a.vec_id AS q, a.vec_id = b.vec_id AS is_target, list_cosine_similarity(a.embedding[1:dims]::DOUBLE[], b.embedding[1:dims]::DOUBLE[]) AS score FROM embeddings a JOIN embeddings b ON a.vec_id // 64 = b.vec_id // 64 AND a.label = b.label, d),
e AS (SELECT *, exp((score - max(score) OVER k) / 0.05) AS e FROM c WINDOW k AS (PARTITION BY dims, q)), p AS (SELECT *, e / sum(e) OVER (PARTITION BY dims, q) AS p FROM e)
SELECT dims, round(avg(-ln(greatest(p, 1e-12))) * max(w), 6) AS loss FROM p WHERE is_target GROUP BY dims"""
)
def loss_matryoshka(t: Tables):
    """The contrastive loss on prefixes of the vectors, weighted."""
    batch = F.floor(F.col("vec_id") / 64).alias("batch")
    pairs = t.embeddings.select(F.col("vec_id").alias("q"), F.col("embedding").alias("x"), "label", batch).join(t.embeddings.select(F.col("vec_id").alias("d"), F.col("embedding").alias("y"), "label", batch), ["batch", "label"])
    out = None
    for dims, weight in ((16, 0.5), (32, 0.25), (64, 1.0)):
        score = V.cosine(F.slice("x", 1, dims), F.slice("y", 1, dims))
        c = pairs.select("q", score.alias("score"), (F.col("q") == F.col("d")).alias("is_target"))
        part = metrics.info_nce(c, "q").agg(F.lit(dims).cast("long").alias("dims"), r6(F.avg("loss") * weight, "loss"))
        out = part if out is None else out.unionByName(part)
    return out


_T = "regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{Nd}}]+')"
_SPLIT = "list_filter(string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda w: w <> '')"
_ALIGN = f"""WITH w AS (SELECT doc_id, {_SPLIT} AS w FROM documents), c AS (SELECT doc_id, k, array_to_string(w[k * 64 + 1 : k * 64 + 64], ' ') AS text FROM (SELECT doc_id, w, unnest(range(0, greatest(0, ceil((len(w) - 64) / 64.0)::BIGINT) + 1)) AS k FROM w WHERE len(w) > 0)),
t AS (SELECT doc_id, k, {_T.format(t='text')} AS t FROM c), l AS (SELECT doc_id, k, len(t) AS words FROM t), s AS (SELECT count(*) AS n, avg(words) AS mean FROM l),
p AS (SELECT doc_id, k, term, count(*) AS tf FROM (SELECT doc_id, k, unnest(t) AS term FROM t) GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM p GROUP BY ALL),
q AS (SELECT DISTINCT item_id AS query_id, term FROM (SELECT item_id, unnest({_T.format(t='text')}) AS term FROM benchmark)),
x AS (SELECT query_id, doc_id, k, words, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * words / mean))), 6) AS score FROM q JOIN p USING (term) JOIN d USING (term) JOIN l USING (doc_id, k), s GROUP BY ALL)
SELECT query_id, doc_id, k AS chunk, score FROM x QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, words DESC, doc_id, k) = 1"""


@add(_ALIGN)
def chunk_alignment(t: Tables):
    """The chunk that each item's terms fit best; ties go to more words, then to the smaller id."""
    c = C.word_chunks(t.documents, 64).select("parent_id", (F.col("start") / 64).cast("long").alias("chunk"), "text")
    key = c.select(F.struct("parent_id", "chunk").alias("doc_id"), "text")
    index = ranking.Bm25(key, k1=1.2, b=0.75)
    q = t.benchmark.select(F.col("item_id").alias("query_id"), F.array_join(F.array_distinct(X.tokens(F.col("text"))), " ").alias("text"))
    s = index.best(q, 1, longer=True)
    return s.select("query_id", F.col("doc_id.parent_id").alias("doc_id"), F.col("doc_id.chunk").alias("chunk"), "score")


@add(
    f"""WITH {dense_sql(30)}, {_QRELS}, f AS (SELECT r.query_id, min_by(r.doc_id, r.rank) AS positive_id, min(rank) AS first FROM dense r JOIN qrels q USING (query_id, doc_id) GROUP BY ALL),
c AS (SELECT r.query_id, positive_id, r.doc_id, r.rank, first FROM dense r ANTI JOIN qrels q ON r.query_id = q.query_id AND r.doc_id = q.doc_id JOIN f ON f.query_id = r.query_id)
SELECT query_id, positive_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN first > 1 AND rank < first THEN 0 ELSE 1 END, rank) AS nth FROM c QUALIFY nth <= 5"""
)
def frontier_teacher_pairs(t: Tables):
    """Negatives of a losing ranking: what stands above its first relevant document, then what follows."""
    r, q = dense(t, 30), qrels(t)
    first = r.join(q, ["query_id", "doc_id"]).groupBy("query_id").agg(F.min_by("doc_id", "rank").alias("positive_id"), F.min("rank").alias("first"))
    c = r.join(q, ["query_id", "doc_id"], "left_anti").join(first, "query_id")
    order = W.partitionBy("query_id").orderBy(F.when((F.col("first") > 1) & (F.col("rank") < F.col("first")), 0).otherwise(1), "rank")
    return c.withColumn("nth", F.row_number().over(order).cast("long")).where("nth <= 5").select("query_id", "positive_id", "doc_id", "nth")


#: 64-bit FNV-1a of a string, over whole numbers wide enough for its products.
_FNV = "list_reduce(list_concat([14695981039346656037::HUGEINT], list_transform(regexp_extract_all(hex(encode({t})), '..'), lambda x: ('0x' || x)::HUGEINT)), lambda a, b: (xor(a, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"


@add(
    f"""WITH {_POSITIVE}, n AS (SELECT count(*) AS n FROM documents), d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents), b AS (SELECT query_id, count(*) AS b FROM positives GROUP BY ALL),
s AS (SELECT query_id, doc_id AS positive_id, ({_FNV.format(t="'set' || chr(0) || query_id || chr(0) || doc_id")} % n)::BIGINT AS start, n, unnest(range(0, least(b + 1, n))) AS k FROM positives JOIN b USING (query_id), n),
m AS (SELECT s.query_id, positive_id, d.doc_id, k FROM s JOIN d ON d.i = (start + k) % n)
SELECT m.query_id, positive_id, min_by(m.doc_id, k) AS doc_id FROM m ANTI JOIN positives p ON p.query_id = m.query_id AND p.doc_id = m.doc_id GROUP BY ALL"""
)
def hash_started_negatives(t: Tables):
    """For each item and document that holds it the first document from a hashed start on that doesn't."""
    return M.hash_started_negatives(positives(t).withColumnRenamed("doc_id", "positive_id"), t.documents.select("doc_id"), "set")


@add("WITH r AS (SELECT coalesce(source, '') AS source, doc_id, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY doc_id) AS i, count(*) OVER (PARTITION BY coalesce(source, '')) AS n FROM documents) SELECT source, doc_id, CASE WHEN i <= n // 4 THEN 'train' WHEN i <= n // 2 THEN 'dev' ELSE 'test' END AS split FROM r")
def split_borrowing(t: Tables):
    """Sources with a test split only: the first half of each becomes dev, and half of that train."""
    from ..operators.ordering import place

    rows = t.documents.select("doc_id", F.coalesce("source", F.lit("")).alias("source"))
    n = rows.groupBy("source").agg(F.count("*").alias("n"))  # one row per source
    i = F.col("i") + 1
    split = F.when(i <= F.floor(F.col("n") / 4), "train").when(i <= F.floor(F.col("n") / 2), "dev").otherwise("test")
    return place(rows, F.col("doc_id"), [], "i", within=["source"]).join(n, "source").select("source", "doc_id", split.alias("split"))


@add("WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, trim(regexp_replace(l[1], '\\s+', ' ', 'g')) AS query, trim(regexp_replace(array_to_string(l[2:], ' '), '\\s+', ' ', 'g')) AS positive FROM l WHERE len(l) > 1 AND trim(l[1]) <> ''")
def title_body_pairs(t: Tables):
    """The first line against what follows."""
    lines = F.split("text", "\n")
    d = t.documents.select("doc_id", lines.alias("l")).where((F.size("l") > 1) & (F.trim(F.get("l", F.lit(0))) != ""))
    return d.select("doc_id", X.collapse(F.get("l", F.lit(0))).alias("query"), X.collapse(F.array_join(F.slice("l", F.lit(2), F.size("l")), " ")).alias("positive"))


@add("SELECT o_custkey AS k, max_by(o_totalprice, o_orderkey) AS value FROM orders GROUP BY 1")
def kv_last_value(t: Tables):
    from ..streaming.state import kv_last

    return kv_last(t.orders.select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("value"), "o_orderkey"), ["k"], "value", "o_orderkey")


_IDS = f"ids AS (SELECT item_id AS doc_id, list_transform({_SPLIT}, lambda w: ('0x' || substr(sha256(w), 1, 8))::BIGINT % 500) AS ids FROM benchmark)"
_WEIGHTS = encoder.Weights.seeded(500, 32, 64)


def _ids(t: Tables):
    code = lambda w: (F.conv(F.substring(F.sha2(w.cast("binary"), 256), 1, 8), 16, 10).cast("long") % 500).cast("int")
    return t.benchmark.select(F.col("item_id").alias("doc_id"), F.transform(X.words(F.col("text")), code).alias("ids"))


def _forward_sql(sparse: bool, repeats: int = 2) -> str:
    """The encoder's forward pass over lists: one row per token, the matrices as a table of one row."""
    times = lambda x, m: f"list_transform({m}, lambda c: list_inner_product(c, {x}))"
    norm = lambda x: f"list_transform({x}, lambda z: (z - list_avg({x})) / sqrt(list_var_pop({x}) + 1e-5))"
    plus = lambda a, b: f"list_transform(list_zip({a}, {b}), lambda z: z[1] + z[2])"
    matrices = ", ".join(f"{numbers(getattr(_WEIGHTS, n).T)}::DOUBLE[][] AS w{n}" for n in ("q", "k", "v", "o", "up", "down"))
    out = f"{_IDS}, w AS (SELECT {numbers(_WEIGHTS.embedding)}::DOUBLE[][] AS we, {matrices}), x0 AS (SELECT doc_id, pos, we[id + 1] AS x FROM (SELECT doc_id, unnest(ids) AS id, unnest(range(len(ids))) AS pos FROM ids), w)"
    for r in range(repeats):
        out += f""", p{r} AS (SELECT doc_id, pos, x, {times('x', 'wq')} AS q, {times('x', 'wk')} AS k, {times('x', 'wv')} AS v FROM x{r}, w),
g{r} AS (SELECT doc_id, list(k ORDER BY pos) AS ks, list(v ORDER BY pos) AS vs FROM p{r} GROUP BY doc_id),
s{r} AS (SELECT doc_id, pos, x, vs, list_transform(ks, lambda k: list_inner_product(k, q)) AS s FROM p{r} JOIN g{r} USING (doc_id)),
"""
        if sparse:  # each query keeps its best ceil(sqrt(n)) keys, the earlier of equal ones
            out += f"c{r} AS (SELECT doc_id, pos, x, vs, s, list_sort(list_transform(range(1, len(s) + 1), lambda j: {{'a': -s[j], 'j': j}}))[ceil(sqrt(len(s)))::INT] AS last FROM s{r}), e{r} AS (SELECT doc_id, pos, x, vs, list_transform(range(1, len(s) + 1), lambda j: CASE WHEN {{'a': -s[j], 'j': j}} <= last THEN exp(s[j] - list_max(s)) ELSE 0 END) AS e FROM c{r}),"
        else:
            out += f"e{r} AS (SELECT doc_id, pos, x, vs, list_transform(s, lambda z: exp(z - list_max(s))) AS e FROM s{r}),"
        out += f"""
h{r} AS (SELECT doc_id, pos, x, list_transform(range(1, 33), lambda d: list_inner_product(e, list_transform(vs, lambda v: v[d])) / list_sum(e)) AS h FROM e{r}),
o{r} AS (SELECT doc_id, pos, {plus(times('h', 'wo'), 'x')} AS b FROM h{r}, w), a{r} AS (SELECT doc_id, pos, {norm('b')} AS a FROM o{r}),
u{r} AS (SELECT doc_id, pos, a, list_transform({times('a', 'wup')}, lambda z: 0.5 * z * (1 + (1 - 2 / (exp(2 * 0.7978845608 * (z + 0.044715 * z * z * z)) + 1)))) AS u FROM a{r}, w),
f{r} AS (SELECT doc_id, pos, {plus(times('u', 'wdown'), 'a')} AS b FROM u{r}, w), x{r + 1} AS (SELECT doc_id, pos, {norm('b')} AS x FROM f{r})"""
    unit = f"SELECT doc_id, unnest(range(1, 33)) AS d, unnest(list_transform(x, lambda z: z / sqrt(list_inner_product(x, x)))) AS z FROM x{repeats}"
    return f"WITH {out}, m AS (SELECT doc_id, d, avg(z) AS z FROM ({unit}) GROUP BY ALL), n AS (SELECT doc_id, sqrt(sum(z * z)) AS n FROM m GROUP BY ALL) SELECT item_id AS doc_id, round(coalesce(n, 0), 4) + 0.0 AS norm FROM benchmark LEFT JOIN n ON n.doc_id = item_id"


@add(_forward_sql(False))
def encoder_embeddings(t: Tables):
    """Seeded weights, whole texts; tests compare with a plain forward pass as well."""
    e = encoder.embed(_ids(t), _WEIGHTS)
    return e.select("doc_id", r6(V.norm(F.col("vector")), "norm", 4))


@add(_forward_sql(True))
def sparse_encoder_embeddings(t: Tables):
    e = encoder.embed(_ids(t), _WEIGHTS, top_k=0)
    return e.select("doc_id", r6(V.norm(F.col("vector")), "norm", 4))


@add(f"WITH {turned_sql(4)} SELECT vec_id AS n, round(norm * list_distance(t, y), 4) + 0.0 AS error FROM coded")
def channel_codec(t: Tables):
    p = t.embeddings.select(F.col("vec_id").alias("n"), F.lit(0).cast("long").alias("y"), F.lit(0).cast("long").alias("x"), V.doubles(F.col("embedding")).alias("channels"))
    c = encoder.channel_codec(p, 4)
    return c.select("n", r6(V.l2_distance(F.col("channels"), F.col("decoded")), "error", 4))


_LOW, _HIGH = encoder.LOG_NORM


@add(
    f"""WITH {turned_sql(4, rows=hadamard.turn(np.eye(64), 1).T)}, n AS (SELECT *, floor(greatest(0, least(1, (ln(norm) - {_LOW}) / {_HIGH - _LOW})) * 255 + 0.5) AS code FROM coded)
SELECT vec_id AS n, code::BIGINT AS norm_code, round(list_distance(list_transform(t, lambda x: x * norm), list_transform(y, lambda x: x * exp({_LOW} + code / 255.0 * {_HIGH - _LOW}))), 4) + 0.0 AS error FROM n"""
)
def channel_codec_hadamard(t: Tables):
    """Channels turned by butterflies, norms as codes of 8 bits."""
    p = t.embeddings.select(F.col("vec_id").alias("n"), F.lit(0).cast("long").alias("y"), F.lit(0).cast("long").alias("x"), V.doubles(F.col("embedding")).alias("channels"))
    c = encoder.channel_codec(p, 4, turn="hadamard", log_norm=True)
    share = (F.ln(V.norm(F.col("channels"))) - _LOW) / (_HIGH - _LOW)
    code = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * 255 + 0.5)
    return c.select("n", code.cast("long").alias("norm_code"), r6(V.l2_distance(F.col("channels"), F.col("decoded")), "error", 4))


@add(
    """WITH v AS (SELECT vec_id // 16 AS block, vec_id AS k, embedding::DOUBLE[] AS v FROM embeddings), a AS (SELECT block, min(k) AS k FROM v GROUP BY ALL),
d AS (SELECT x.block, x.k, x.v, list_distance(x.v, y.v) AS d FROM v x JOIN a USING (block) JOIN v y ON y.k = a.k), b AS (SELECT block, k FROM d QUALIFY row_number() OVER (PARTITION BY block ORDER BY d DESC, k) = 1),
e AS (SELECT d.block, d.k, least(d.d, list_distance(d.v, y.v)) AS d FROM d JOIN b ON b.block = d.block JOIN v y ON y.k = b.k), c AS (SELECT block, k FROM e QUALIFY row_number() OVER (PARTITION BY block ORDER BY d DESC, k) = 1), n AS (SELECT block, count(*) AS n FROM v GROUP BY ALL)
SELECT block, 0::BIGINT AS nth, k FROM a UNION ALL SELECT block, 1, b.k FROM b JOIN n USING (block) WHERE n > 1 UNION ALL SELECT block, 2, c.k FROM c JOIN n USING (block) WHERE n > 2"""
)
def block_representatives(t: Tables):
    b = t.embeddings.select(F.floor(F.col("vec_id") / 16).alias("block"), F.col("vec_id").alias("k"), V.doubles(F.col("embedding")).alias("vector"))
    return encoder.farthest_representatives(b, 3)
