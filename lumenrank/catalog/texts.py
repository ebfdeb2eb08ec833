"""Tokens, chunks, windows, rendering and text mining over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking as C
from .base import Registry, Tables, r6

_R = Registry()
QUERIES, SQL = _R.queries, _R.sql
add = _R.add

_SPLIT = "list_filter(string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda w: w <> '')"
_T = "regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}]+')"


@add(f"SELECT doc_id, len({_T}) AS n, len(list_distinct({_T})) AS different FROM documents")
def lexical_tokens(t: Tables):
    return t.documents.select("doc_id", F.size(X.tokens(F.col("text"))).cast("long").alias("n"), F.size(F.array_distinct(X.tokens(F.col("text")))).cast("long").alias("different"))


def _chunks_sql(size: int, overlap: int, least: int) -> str:
    step = size - overlap
    return f"""WITH w AS (SELECT doc_id, {_SPLIT} AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, greatest(0, ceil((len(w) - {size}) / {step}.0)::BIGINT) + 1)) AS k FROM w WHERE len(w) > 0)
SELECT doc_id AS parent_id, doc_id || '#chunk-' || lpad(k::VARCHAR, greatest(4, length(k::VARCHAR))::INT, '0') AS child_id, k * {step} AS start, array_to_string(w[k * {step} + 1 : k * {step} + {size}], ' ') AS text FROM c WHERE k = 0 OR len(w[k * {step} + 1 : k * {step} + {size}]) >= {least}"""


@add(_chunks_sql(64, 0, 1))
def word_chunks(t: Tables):
    return C.word_chunks(t.documents, 64)


@add(_chunks_sql(50, 10, 20))
def word_chunks_overlap(t: Tables):
    return C.word_chunks(t.documents, 50, 10, 20)


@add("SELECT doc_id, 'passage: ' || trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents")
def text_prefixing(t: Tables):
    return t.documents.select("doc_id", F.concat(F.lit("passage: "), X.collapse(F.col("text"))).alias("text"))


_SERIES = "s AS (SELECT user_id AS id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY user_id)"
_WINDOWS = f"WITH {_SERIES}, w AS (SELECT id, v, unnest(CASE WHEN len(v) <= 16 THEN [0] ELSE list_distinct(list_concat(range(0, len(v) - 16 + 1, 5), [len(v) - 16])) END) AS start FROM s)"


def _series(t: Tables):
    e = t.events.groupBy(F.col("user_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("e"))
    return e.select("id", F.transform("e", lambda z: z["value"]).alias("values"))


@add(f"{_WINDOWS}, x AS (SELECT id, start, v[start + 1 : start + 16] AS x FROM w) SELECT id, start, len(x) AS n, round(list_min(x), 6) AS min, round(list_max(x), 6) AS max, round(list_avg(x), 6) AS mean, round(x[1], 6) AS first, round(x[-1], 6) AS last, round(x[-1] - x[1], 6) + 0.0 AS delta FROM x")
def series_windows(t: Tables):
    w = C.window_stats(C.numeric_windows(_series(t), 16, 5))
    return w.select("id", "start", "n", *[r6(c, c) for c in ("min", "max", "mean", "first", "last", "delta")])


@add(f"WITH {_SERIES} SELECT id, len(v) AS n, CASE WHEN len(v) <= 16 THEN 1 ELSE 1 + ceil((len(v) - 16) / 5.0)::BIGINT END AS windows FROM s")
def series_window_counts(t: Tables):
    n = F.size("values")
    return _series(t).select("id", n.cast("long").alias("n"), X.window_count(n, 16, 5).alias("windows"))


_LINE = "'turn: ' || turn || chr(10) || 'role: ' || role || chr(10) || 'text: ' || trim(text)"


def _turns(t: Tables):
    line = X.render_fields({"turn": F.col("turn").cast("string"), "role": F.col("role"), "text": F.col("text")})
    return t.conversations.select(F.col("conv_id").alias("id"), F.col("turn").alias("pos"), line.alias("text"))


@add(f"SELECT conv_id AS id, turn AS pos, {_LINE} AS text FROM conversations")
def event_rendering(t: Tables):
    return _turns(t)


@add(
    f"""WITH e AS (SELECT conv_id AS id, list({_LINE} ORDER BY turn, {_LINE}) AS e FROM conversations GROUP BY ALL),
w AS (SELECT id, e, unnest(CASE WHEN len(e) <= 3 THEN [0] ELSE list_distinct(list_concat(range(0, len(e) - 3 + 1, 2), [len(e) - 3])) END) AS start FROM e)
SELECT id, start, array_to_string(e[start + 1 : start + 3], chr(10)) AS text FROM w"""
)
def trace_windows(t: Tables):
    return C.trace_windows(_turns(t), 3, 2)


@add("SELECT event_id, string_agg(key || '=' || trim(value), ' ' ORDER BY key) AS text FROM (SELECT event_id, unnest(json_keys(props)) AS key, json_extract_string(props, '$.' || unnest(json_keys(props))) AS value FROM events) WHERE trim(value) <> '' GROUP BY ALL")
def metadata_rendering(t: Tables):
    return t.events.select("event_id", X.render_map(F.from_json("props", "map<string,string>")).alias("text")).where("text <> ''")


_SEG = "list_filter(list_transform(string_split_regex(text, '[.!?;:\\n]'), lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), lambda s: strlen(s) >= {n} AND s <> '')"


@add(f"WITH s AS (SELECT {_SEG.format(n=24)} AS s FROM documents), p AS (SELECT s, unnest(range(1, len(s))) AS i FROM s) SELECT DISTINCT s[i] AS query, s[i + 1] AS positive FROM p")
def adjacent_text_pairs(t: Tables):
    return C.adjacent_pairs(t.documents, 24)


@add(f"WITH w AS (SELECT doc_id, {_SPLIT} AS w FROM documents) SELECT doc_id, array_to_string(w[1 : len(w) // 2], ' ') AS query, array_to_string(w[len(w) // 2 + 1 :], ' ') AS positive FROM w WHERE len(w) >= 40")
def half_text_pairs(t: Tables):
    return C.half_pairs(t.documents)


@add(
    f"""WITH w AS (SELECT doc_id, {_SPLIT} AS w FROM documents), p AS (SELECT doc_id, array_to_string(w[1 : len(w) // 2], ' ') AS query, array_to_string(w[len(w) // 2 + 1 :], ' ') AS positive, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM w WHERE len(w) >= 40),
a AS (SELECT doc_id, positive, k, (i + 1 + ('0x' || substr(sha256('b1:' || doc_id || ':' || k), 1, 15))::BIGINT % greatest(n - 1, 1)) % n AS j FROM p, range(4) r(k)), m AS (SELECT a.doc_id, min_by(b.positive, k) AS negative FROM a JOIN p b ON b.i = a.j AND b.positive <> a.positive GROUP BY ALL)
SELECT p.doc_id, sha256(query) AS query, sha256(p.positive) AS positive, sha256(negative) AS negative FROM p LEFT JOIN m USING (doc_id)"""
)
def half_text_negatives(t: Tables):
    """First and second halves of texts, and the second half of another one."""
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(c)
    return C.with_other_body(C.half_pairs(t.documents), "b1").select("doc_id", digest("query"), digest("positive"), digest("negative"))


@add("WITH i AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) SELECT doc_id, n_chars, i // 128 * 128 + row_number() OVER (PARTITION BY i // 128 ORDER BY n_chars, doc_id) - 1 AS position FROM i")
def batch_length_buckets(t: Tables):
    return C.batch_order(t.documents.select("doc_id", "n_chars"), "n_chars", "doc_id", 32)


@add("WITH r AS (SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 0.5) / count(*) OVER (PARTITION BY source) AS turn FROM documents) SELECT doc_id, source, row_number() OVER (ORDER BY turn, source, doc_id) - 1 AS position FROM r")
def source_round_robin(t: Tables):
    return C.round_robin(t.documents.select("doc_id", "source"), "source", "doc_id").select("doc_id", "source", "position")


@add("SELECT doc_id, length(regexp_replace(lower(text), '[^\\p{L}\\p{Nd}]', ' ', 'g')) AS n, sha256(regexp_replace(lower(text), '[^\\p{L}\\p{Nd}]', ' ', 'g')) AS digest FROM documents")
def bpe_normalized(t: Tables):
    n = X.bpe_normalize(F.col("text"))
    return t.documents.select("doc_id", F.length(n).cast("long").alias("n"), F.sha2(n.cast("binary"), 256).alias("digest"))


@add()
def bpe_token_counts(t: Tables):
    """Trains merges on all documents, then encodes each of them whole; checked against a plain encoder in the tests."""
    from ..operators import bpe

    model = bpe.train(t.documents.select("text"), vocabulary=400)
    return bpe.encode(t.documents.select("doc_id", "text"), model).select("doc_id", F.size("ids").cast("long").alias("n"), F.get("ids", F.lit(1)).cast("long").alias("second"))


@add("SELECT sha256(string_agg(url, '|' ORDER BY page_id)) AS digest, count(*) AS pages, sum(strlen(html))::BIGINT AS bytes FROM pages")
def manifest_digest(t: Tables):
    rows = t.pages.agg(F.array_sort(F.collect_list(F.struct("page_id", "url"))).alias("p"), F.count("*").alias("pages"), F.sum(F.octet_length("html")).alias("bytes"))
    joined = F.array_join(F.transform("p", lambda x: x["url"]), "|")
    return rows.select(F.sha2(joined.cast("binary"), 256).alias("digest"), "pages", F.col("bytes").cast("long").alias("bytes"))


_SPAN = """WITH tk AS (SELECT vec_id // 20 AS p, vec_id % 20 AS pos, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT p, count(*) AS n FROM tk GROUP BY ALL),
s AS (SELECT p, unnest(range(0, greatest(0, ceil((n - 8) / 4.0)::BIGINT) + 1)) AS span FROM n),
m AS (SELECT s.p, span, d, avg(v[d]) AS x FROM s JOIN (SELECT *, unnest(range(1, 65)) AS d FROM tk) t ON t.p = s.p AND pos >= span * 4 AND pos < span * 4 + 8 GROUP BY ALL),
z AS (SELECT p, span, d, x / sqrt(sum(x * x) OVER (PARTITION BY p, span)) AS x FROM m) SELECT p AS parent_id, span, d - 1 AS pos, round(x, 6) + 0.0 AS value FROM z"""


@add(_SPAN)
def token_span_children(t: Tables):
    k = t.embeddings.select(F.floor(F.col("vec_id") / 20).alias("parent_id"), (F.col("vec_id") % 20).alias("pos"), F.col("embedding").alias("vector"))
    s = C.span_children(k, 8, 4)
    return s.select("parent_id", "span", F.posexplode("vector").alias("pos", "value")).select("parent_id", "span", F.col("pos").cast("long").alias("pos"), r6("value", "value"))
