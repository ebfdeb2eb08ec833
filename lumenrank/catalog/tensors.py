"""Tensor-language operators over the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import ranking
from ..operators import tensor as T
from .base import Registry, Tables, r6

_R = Registry()
QUERIES, SQL = _R.queries, _R.sql
add = _R.add

_E = "(SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)"


def _exploded(expr: str, source: str = _E, extra: str = "") -> str:
    return f"""WITH e AS (SELECT vec_id, {expr} AS v FROM {source} {extra})
SELECT vec_id, pos - 1 AS pos, round(v[pos], 6) + 0.0 AS value FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS pos FROM e)"""


def _long(df, expr):
    out = df.select("vec_id", F.posexplode(expr).alias("pos", "value"))
    return out.select("vec_id", F.col("pos").cast("long").alias("pos"), r6("value", "value"))


for _op, _name in (("+", "add"), ("-", "subtract"), ("*", "multiply"), ("/", "divide")):

    def _make(op=_op):
        def f(t: Tables):
            e = t.embeddings
            return _long(e, V.elementwise(op, F.col("embedding"), F.transform("embedding", lambda x: x.cast("double") * 2 + 3)))

        return f

    _f = _make()
    _f.__name__ = f"tensor_{_name}"
    add(_exploded(f"list_transform(v, lambda x: x {_op} (x * 2 + 3))"))(_f)


@add(_exploded("CASE WHEN list_inner_product(v, v) = 0 THEN v ELSE list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) END"))
def tensor_normalize(t: Tables):
    return _long(t.embeddings, V.normalize(F.col("embedding")))


@add(_exploded("list_transform(list_transform(v, lambda x: exp(x - list_max(v))), lambda y: y / list_sum(list_transform(v, lambda x: exp(x - list_max(v)))))"))
def tensor_softmax(t: Tables):
    return _long(t.embeddings, V.softmax(F.col("embedding")))


@add(_exploded("list_transform(v, lambda x: (x - list_avg(v)) / sqrt(list_sum(list_transform(v, lambda y: (y - list_avg(v)) * (y - list_avg(v)))) / len(v) + 1e-5))"))
def tensor_layernorm(t: Tables):
    return _long(t.embeddings, V.layernorm(F.col("embedding")))


_TANH = "(exp(2 * {z}) - 1) / (exp(2 * {z}) + 1)"


@add(_exploded("list_transform(v, lambda x: 0.5 * x * (1 + " + _TANH.format(z="(0.7978845608 * (x + 0.044715 * x * x * x))") + "))"))
def tensor_gelu(t: Tables):
    return _long(t.embeddings, F.transform("embedding", V.gelu))


@add(
    _exploded(
        """list_transform(range(0, len(v)), lambda i: CASE WHEN i % 2 = 0
  THEN v[i + 1] * cos(vec_id / pow(10000.0, i / len(v))) - v[i + 2] * sin(vec_id / pow(10000.0, i / len(v)))
  ELSE v[i] * sin(vec_id / pow(10000.0, (i - 1) / len(v))) + v[i + 1] * cos(vec_id / pow(10000.0, (i - 1) / len(v))) END)"""
    )
)
def tensor_rope(t: Tables):
    return _long(t.embeddings, V.rope(F.col("embedding"), F.col("vec_id")))


@add(
    """SELECT label, pos - 1 AS pos, round(avg(v[pos]), 6) + 0.0 AS value
FROM (SELECT label, v, unnest(range(1, len(v) + 1)) AS pos FROM (SELECT label, embedding::DOUBLE[] AS v FROM embeddings)) GROUP BY ALL"""
)
def tensor_mean_pool(t: Tables):
    e = t.embeddings.select("label", F.posexplode("embedding").alias("pos", "value"))
    return e.groupBy("label", F.col("pos").cast("long").alias("pos")).agg(r6(F.avg(F.col("value").cast("double")), "value"))


@add(
    """WITH s AS (SELECT label, pos - 1 AS pos, sum(CASE WHEN vec_id % 3 <> 0 THEN v[pos] ELSE 0 END) AS s, sum(CASE WHEN vec_id % 3 <> 0 THEN 1 ELSE 0 END) AS n
FROM (SELECT label, vec_id, v, unnest(range(1, len(v) + 1)) AS pos FROM (SELECT label, vec_id, embedding::DOUBLE[] AS v FROM embeddings)) GROUP BY ALL)
SELECT label, pos, round(CASE WHEN n = 0 THEN 0 ELSE s / n END, 6) + 0.0 AS value FROM s"""
)
def tensor_mean_pool_masked(t: Tables):
    kept = F.col("vec_id") % 3 != 0
    e = t.embeddings.select("label", kept.alias("kept"), F.posexplode("embedding").alias("pos", "value"))
    total = F.sum(F.when(F.col("kept"), F.col("value").cast("double")).otherwise(0.0))
    n = F.count_if("kept")
    return e.groupBy("label", F.col("pos").cast("long").alias("pos")).agg(r6(F.when(n == 0, 0.0).otherwise(total / F.greatest(n, F.lit(1))), "value"))


_PAIRS = """(SELECT a.vec_id AS query_id, b.vec_id AS doc_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y
FROM embeddings a JOIN embeddings b ON a.vec_id % 25 = 0)"""


def _sides(t: Tables):
    q = t.embeddings.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("x"))
    return q, t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("y"))


@add(f"SELECT query_id, doc_id, round(list_inner_product(x, y), 6) + 0.0 AS score FROM {_PAIRS}")
def tensor_dot(t: Tables):
    return ranking.dense_scores(*_sides(t), digits=6)


@add(f"SELECT query_id, doc_id, round(list_cosine_similarity(x, y), 6) + 0.0 AS score FROM {_PAIRS}")
def tensor_cosine(t: Tables):
    return ranking.dense_scores(*_sides(t), "cosine", 6)


@add(f"SELECT query_id, doc_id, round(list_distance(x, y), 6) + 0.0 AS score FROM {_PAIRS}")
def tensor_l2_distance(t: Tables):
    return ranking.dense_scores(*_sides(t), "l2", 6).select("query_id", "doc_id", (0.0 - F.col("score")).alias("score"))


@add(
    """SELECT vec_id, index, rank, score FROM (SELECT vec_id, index, score, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, index) AS rank
FROM (SELECT vec_id, pos - 1 AS index, round(v[pos], 6) + 0.0 AS score FROM (SELECT vec_id, embedding::DOUBLE[] AS v, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings))) WHERE rank <= 8"""
)
def tensor_topk(t: Tables):
    e = t.embeddings.select("vec_id", F.posexplode("embedding").alias("index", "score"))
    e = e.select("vec_id", F.col("index").cast("long").alias("index"), r6("score", "score"))
    return T.top_k(e, 8, ["vec_id"], exact=True).select("vec_id", "index", F.col("rank").cast("long").alias("rank"), "score")


@add(
    """WITH l AS (SELECT label, vec_id, pos - 1 AS pos, v[pos] AS x FROM (SELECT label, vec_id, embedding::DOUBLE[] AS v, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings)),
w AS (SELECT i, j, ((i * 7 + j * 3) % 11 - 5) / 10.0::DOUBLE AS w FROM range(64) a(i), range(8) b(j))
SELECT vec_id AS i, j, round(sum(x * w), 6) + 0.0 AS value FROM l JOIN w ON pos = w.i GROUP BY ALL"""
)
def tensor_matmul(t: Tables):
    a = T.long_form(t.embeddings, "vec_id", "embedding")
    grid = t.spark.range(64).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("j"))
    b = grid.select("i", "j", (((F.col("i") * 7 + F.col("j") * 3) % 11 - 5) / 10.0).alias("value"))
    return T.matmul(a, b).select("i", "j", r6("value", "value"))


@add(
    """WITH l AS (SELECT label AS b, pos - 1 AS p, vec_id, v[pos] AS x FROM (SELECT label, vec_id, embedding::DOUBLE[] AS v, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings))
SELECT x.b AS b, x.p AS i, y.p AS j, round(sum(x.x * y.x), 6) + 0.0 AS value FROM l x JOIN l y ON x.b = y.b AND x.vec_id = y.vec_id GROUP BY ALL"""
)
def tensor_matmul_batched(t: Tables):
    """The Gram matrix of the components, for each label."""
    e = t.embeddings.select(F.col("label").alias("b"), F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "value"))
    e = e.select("b", "i", F.col("j").cast("long").alias("j"), F.col("value").cast("double").alias("value"))
    return T.matmul(T.transpose(e), e, ["b"]).select("b", "i", "j", r6("value", "value"))


@add("SELECT pos - 1 AS i, vec_id AS j, round(v[pos], 6) + 0.0 AS value FROM (SELECT vec_id, embedding::DOUBLE[] AS v, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings)")
def tensor_transpose(t: Tables):
    return T.transpose(T.long_form(t.embeddings, "vec_id", "embedding")).select("i", "j", r6("value", "value"))


@add(
    """SELECT l_orderkey AS at_order, l_linenumber AS at_line, vec_id AS row, round(embedding[1]::DOUBLE, 6) + 0.0 AS first, label
FROM lineitem JOIN embeddings ON vec_id = l_partkey % (SELECT count(*) FROM embeddings)"""
)
def tensor_gather(t: Tables):
    index = t.lineitem.select(F.col("l_orderkey").alias("at_order"), F.col("l_linenumber").alias("at_line"), (F.col("l_partkey") % t.embeddings.count()).alias("row"))
    table = t.embeddings.select(F.col("vec_id").alias("row"), r6(F.get("embedding", F.lit(0)), "first"), "label")
    return T.gather(table, index).select("at_order", "at_line", "row", "first", "label")


@add(
    """WITH s AS (SELECT a.vec_id AS q, b.vec_id AS k, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 25 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, k) AS rank, count(*) OVER (PARTITION BY q) AS n FROM s),
w AS (SELECT q, k, exp(score - max(score) OVER (PARTITION BY q)) AS e FROM r WHERE rank <= least(n, ceil(sqrt(n)))),
z AS (SELECT q, k, e / sum(e) OVER (PARTITION BY q) AS w FROM w)
SELECT q, pos - 1 AS j, round(sum(w * v[pos]), 6) + 0.0 AS value FROM z JOIN (SELECT vec_id, embedding::DOUBLE[] AS v, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings) ON vec_id = k GROUP BY ALL"""
)
def tensor_sparse_attention(t: Tables):
    q, keys = _attended(t)
    return T.dense_attention(q, keys, keys.withColumnRenamed("y", "v")).select("q", "j", r6("value", "value"))


def _attended(t: Tables):
    q, d = _sides(t)
    return q.withColumnRenamed("query_id", "q"), d.withColumnRenamed("doc_id", "k")


@add(
    """WITH s AS (SELECT a.vec_id AS q, b.vec_id AS k, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 25 = 0),
b AS (SELECT *, k // 16 AS block, count(*) OVER (PARTITION BY q) AS n FROM s),
a AS (SELECT q, block, score AS anchor FROM b WHERE k = block * 16 + (least(block * 16 + 16, n) - block * 16) // 2),
t AS (SELECT q, block FROM a QUALIFY row_number() OVER (PARTITION BY q ORDER BY anchor DESC, block) <= 4),
r AS (SELECT b.q, b.k, b.score, row_number() OVER (PARTITION BY b.q ORDER BY score DESC, k) AS rank FROM b JOIN t ON b.q = t.q AND b.block = t.block)
SELECT q, k, rank, round(score, 6) + 0.0 AS score FROM r WHERE rank <= 8"""
)
def tensor_routed_attention_keys(t: Tables):
    best = T.routed_keys(*_attended(t), 16, 4, 8)
    return best.select("q", "k", F.col("rank").cast("long").alias("rank"), r6("score", "score"))


@add(
    """WITH i AS (SELECT vec_id AS n, 0 AS c, (pos - 1) // 8 AS y, (pos - 1) % 8 AS x, v[pos] AS value FROM (SELECT vec_id, embedding::DOUBLE[] AS v, unnest(range(1, 65)) AS pos FROM embeddings)),
k AS (SELECT o, ky, kx, (o + 1) * (ky - kx) / 4.0::DOUBLE AS w FROM range(2) a(o), range(3) b(ky), range(3) c(kx))
SELECT n, o, y + 1 - ky AS y, x + 1 - kx AS x, round(sum(value * w), 6) + 0.0 AS value FROM i, k WHERE y + 1 - ky BETWEEN 0 AND 7 AND x + 1 - kx BETWEEN 0 AND 7 GROUP BY ALL"""
)
def tensor_conv2d(t: Tables):
    image, kernel = _image(t), _kernel(t)
    return T.conv2d(image, kernel, pad=1, height=8, width=8, kh=3, kw=3).select("n", "o", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), r6("value", "value"))


def _image(t: Tables):
    e = t.embeddings.select(F.col("vec_id").alias("n"), F.posexplode("embedding").alias("p", "value"))
    return e.select("n", F.lit(0).cast("long").alias("c"), F.floor(F.col("p") / 8).alias("y"), (F.col("p") % 8).cast("long").alias("x"), F.col("value").cast("double").alias("value"))


def _kernel(t: Tables):
    k = t.spark.range(18).select((F.floor(F.col("id") / 9)).alias("o"), F.floor((F.col("id") % 9) / 3).alias("ky"), (F.col("id") % 3).alias("kx"))
    return k.select(F.lit(0).cast("long").alias("c"), "o", "ky", "kx", ((F.col("o") + 1) * (F.col("ky") - F.col("kx")) / 4.0).alias("w"))


@add(
    """WITH i AS (SELECT vec_id AS n, (pos - 1) // 8 AS y, (pos - 1) % 8 AS x, v[pos] AS value FROM (SELECT vec_id, embedding::DOUBLE[] AS v, unnest(range(1, 65)) AS pos FROM embeddings)),
k AS (SELECT o, ky, kx, (o + 1) * (ky - kx) / 4.0::DOUBLE AS w FROM range(2) a(o), range(3) b(ky), range(3) c(kx))
SELECT n, o, y * 2 + ky AS y, x * 2 + kx AS x, round(sum(value * w), 6) + 0.0 AS value FROM i, k GROUP BY ALL"""
)
def tensor_conv2d_transpose(t: Tables):
    return T.conv2d_transpose(_image(t), _kernel(t), stride=2).select("n", "o", "y", "x", r6("value", "value"))


def _channels(t: Tables):
    e = t.embeddings.select(F.col("vec_id").alias("n"), F.posexplode("embedding").alias("p", "value"))
    return e.select("n", (F.col("p") % 4).cast("long").alias("c"), F.floor(F.col("p") / 4).alias("y"), F.lit(0).cast("long").alias("x"), F.col("value").cast("double").alias("value"))


_GDN = """WITH i AS (SELECT vec_id AS n, (pos - 1) % 4 AS c, (pos - 1) // 4 AS y, v[pos] AS value FROM (SELECT vec_id, embedding::DOUBLE[] AS v, unnest(range(1, 65)) AS pos FROM embeddings)),
p AS (SELECT a.n, g.c AS c, a.y, sum(((g.c * 2 + a.c) % 3 + 1) / 10.0::DOUBLE * a.value * a.value) AS pool FROM i a, range(4) g(c) GROUP BY ALL)
SELECT i.n, i.c, i.y, round(i.value {op} sqrt(greatest((i.c + 1) / 2.0::DOUBLE + pool, 1e-12)), 6) + 0.0 AS value FROM i JOIN p ON i.n = p.n AND i.c = p.c AND i.y = p.y"""


def _gdn(t: Tables, inverse: bool):
    beta = t.spark.range(4).select(F.col("id").alias("c"), ((F.col("id") + 1) / 2.0).alias("beta"))
    gamma = t.spark.range(16).select(F.floor(F.col("id") / 4).alias("c"), (F.col("id") % 4).alias("d"))
    gamma = gamma.withColumn("g", ((F.col("c") * 2 + F.col("d")) % 3 + 1) / 10.0)
    return T.gdn(_channels(t), beta, gamma, inverse).select("n", "c", "y", r6("value", "value"))


@add(_GDN.format(op="/"))
def tensor_gdn(t: Tables):
    return _gdn(t, False)


@add(_GDN.format(op="*"))
def tensor_igdn(t: Tables):
    return _gdn(t, True)


@add(
    """WITH s AS (SELECT vec_id, list_transform(v, lambda x: exp(x - list_max(v))) AS e, vec_id % 64 AS code FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings))
SELECT round(sum(-log2(greatest(e[code + 1] / list_sum(e), 1e-12))), 6) AS bits FROM s"""
)
def loss_cross_entropy_bits(t: Tables):
    p = V.softmax(F.col("embedding"))
    return T.cross_entropy_bits(t.embeddings.select(F.get(p, (F.col("vec_id") % 64).cast("int")).alias("p"))).select(r6("bits", "bits"))


_HALVES = """WITH p AS (SELECT v[pos] AS a, v[pos + 32] AS b FROM (SELECT embedding::DOUBLE[] AS v, unnest(range(1, 33)) AS pos FROM embeddings))"""


def _halves(t: Tables):
    z = F.explode(F.arrays_zip(F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"))).alias("z")
    return t.embeddings.select(z).select(F.col("z.a").cast("double").alias("a"), F.col("z.b").cast("double").alias("b"))


@add(_HALVES + " SELECT round(avg((a - b) * (a - b)), 6) AS mse FROM p")
def loss_mse(t: Tables):
    return T.mse_loss(_halves(t)).select(r6("mse", "mse"))


@add(
    _HALVES
    + """, m AS (SELECT avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS c FROM p)
SELECT round(least(greatest(1 - (2 * ma * mb + 1e-4) * (2 * c + 9e-4) / ((ma * ma + mb * mb + 1e-4) * (va + vb + 9e-4)), 0), 1), 6) AS loss FROM m"""
)
def loss_ssim(t: Tables):
    return T.ssim_loss(_halves(t)).select(r6("loss", "loss"))


@add(_HALVES + " SELECT round(avg((a - b) * (a - b)) + 0.01 * sum(abs(a)), 6) AS loss FROM p")
def loss_rate_distortion(t: Tables):
    m = _halves(t).agg(F.avg(F.pow(F.col("a") - F.col("b"), F.lit(2.0))).alias("d"), F.sum(F.abs("a")).alias("r"))
    return m.select(r6(T.rate_distortion(F.col("d"), F.col("r"), 0.01), "loss"))


@add(
    """WITH m AS (SELECT max(list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x)))) AS m FROM embeddings)
SELECT vec_id, pos - 1 AS pos, round(round(v[pos] / (m / 7)) * (m / 7), 6) + 0.0 AS value FROM (SELECT vec_id, embedding::DOUBLE[] AS v, unnest(range(1, 65)) AS pos FROM embeddings), m"""
)
def tensor_fake_quantize(t: Tables):
    largest = t.embeddings.agg(F.max(F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))).alias("m"))
    e = t.embeddings.crossJoin(F.broadcast(largest))  # one row
    return _long(e, V.fake_quantize(F.col("embedding"), 4, F.col("m")))


@add(
    """SELECT vec_id, round((least(greatest(ln(greatest(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), exp(-16))), -16), 16) + 16) / 32 * 255)::BIGINT AS code,
round(exp(round((least(greatest(ln(greatest(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), exp(-16))), -16), 16) + 16) / 32 * 255) / 255 * 32 - 16), 6) AS decoded FROM embeddings"""
)
def tensor_qnorm(t: Tables):
    code = V.qnorm_encode(V.norm(F.col("embedding")))
    return t.embeddings.select("vec_id", code.cast("long").alias("code"), r6(V.qnorm_decode(code), "decoded"))
