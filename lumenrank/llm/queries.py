"""The registered queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, covertree, licenses, mixing, rankbpe, sharding, simhash, suffixdedup, tiling, tokens, toxicity, turns

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", "n_words", "n_passages", "best_first", "best_last", "best_ln_e")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.removed(_table(spark, sf_dir, "documents"))


def op3_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs that leak; a document that leaks nothing has no row."""
    return tiling.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded_documents(_table(spark, sf_dir, "documents"), shards=40)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.length_histogram(tokens.token_lengths(_table(spark, sf_dir, "documents")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex_digits(out["fp"]).alias("fingerprint"), "component_id")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, folder = tokens.write_tokens(_table(spark, sf_dir, "documents"))
    return tokens.read_tokens(manifest, folder)


def op11_turn_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = turns.reassembled(_table(spark, sf_dir, "conversations"))
    digest = F.when(F.col("event") == "close", F.col("left_sha256")).otherwise(F.sha2(F.concat_ws("|", "role", "text"), 256))
    return out.select("event", digest.alias("sha256"), "conv_id", "turn", "batch", "n_missing", "n_breaks")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rankbpe.decode(rankbpe.encode(_table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("raw", 256).alias("decoded_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = [
        op1_toxicity, op2_suffix_dedup, op3_cover_tree, op4_licenses, op5_decontaminate, op6_mix_sources, op7_shard, op8_token_counts, op9_simhash, op10_token_output,
        op11_turn_reassembly, op12_byte_bpe, op13_collocations,
    ]
    return {f.__name__: f for f in found}


def _crc32(octets: str) -> str:
    """CRC-32 of a list of bytes; its table is built from the polynomial."""
    table = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)  # noqa: PLW2901
        table.append(i)
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {octets}), lambda a, b: xor(a >> 8, ({table}::BIGINT[])[xor(a & 255, b) + 1])), 4294967295::BIGINT)"


def _licenses_sql() -> str:
    words = r"regexp_extract_all(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    templates = ", ".join(f"({k}, {quote(label)}, {quote(text)})" for k, (label, text) in enumerate(licenses.TEMPLATES))
    phrases = ", ".join(f"({quote(label)}, {words.format(t=quote(p))})" for p, label in licenses.PHRASES.items())
    block, step, least = licenses.BLOCK, licenses.BLOCK // 2, licenses.THRESHOLD
    return f"""WITH t AS (SELECT id, label, list_distinct({words.format(t='text')}) AS w FROM (VALUES {templates}) v(id, label, text)), up AS (SELECT a.id, b.id AS larger FROM t a JOIN t b ON len(b.w) > len(a.w) AND list_has_all(b.w, a.w)),
d AS (SELECT row_number() OVER () AS r, doc_id, {words.format(t='text')} AS w FROM documents),
p AS (SELECT r, label, unnest(list_filter(range(len(w) - len(p) + 1), lambda i: w[i + 1:i + len(p)] = p)) AS place FROM d, (VALUES {phrases}) v(label, p)),
base AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels FROM p GROUP BY ALL),
k AS (SELECT r, start, w[start + 1:start + {block}] AS w FROM (SELECT r, w, unnest(range(0, greatest(1, len(w)), {step})) AS start FROM d)),
h AS (SELECT k.r, start, t.id, label, k.w AS block, t.w AS own, len(list_intersect(list_distinct(k.w), t.w)) / len(t.w)::DOUBLE AS share FROM k JOIN t ON list_has_any(k.w, t.w)),
f AS (SELECT * FROM h WHERE share >= {least} - 1e-9), l AS (SELECT f.r, f.start, f.id, count(g.id) AS larger FROM f LEFT JOIN up ON up.id = f.id LEFT JOIN f g ON g.r = f.r AND g.start = f.start AND g.id = up.larger GROUP BY ALL),
g AS (SELECT f.r, f.start, f.label, f.share FROM f JOIN l ON l.r = f.r AND l.start = f.start AND l.id = f.id WHERE larger = 0 OR list_min(list_transform(list_intersect(list_distinct(block), own), lambda x: len(list_filter(block, lambda y: y = x)))) > larger),
m AS (SELECT r, count(*) AS n_blocks, min(start) AS first_block, max(share) AS share, list(DISTINCT label) AS labels FROM g GROUP BY ALL)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(m.labels, [])))), ',') AS labels,
greatest(CASE WHEN n_base > 0 THEN 1 ELSE 0 END, coalesce(share, 0))::DOUBLE AS score, coalesce(n_blocks, 0) AS n_blocks, first_block FROM d LEFT JOIN base USING (r) LEFT JOIN m USING (r)"""


def _collocations_sql() -> str:
    upper, least, top, covered = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", collocations.LEAST, collocations.TOP, collocations.COVERED
    return f"""WITH p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
f AS (SELECT lang, g, count(*) AS a FROM (SELECT lang, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS g FROM p, range(1, 5) k(k)) GROUP BY ALL), n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE len(g) = 1 GROUP BY ALL),
c AS (SELECT * FROM f WHERE len(g) > 1 AND a >= {least}), cut AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM c),
s AS (SELECT cut.lang, cut.g, cut.a, l.a AS l, r.a AS r, (2000000::HUGEINT * cut.a // (l.a + r.a))::BIGINT AS score FROM cut JOIN f l ON l.lang = cut.lang AND l.g = cut.g[1:k] JOIN f r ON r.lang = cut.lang AND r.g = cut.g[k + 1:] QUALIFY row_number() OVER (PARTITION BY cut.lang, cut.g ORDER BY score, k) = 1),
o AS (SELECT lang, g[i:i + k - 1] AS g, max(a) AS longer FROM (SELECT lang, g, a, k, unnest(range(1, len(g) - k + 2)) AS i FROM c, range(2, 4) k(k) WHERE k < len(g)) GROUP BY ALL)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, array_to_string(s.g, ' ')) AS rank, array_to_string(s.g, ' ') AS phrase, a, l, r, n, score FROM s JOIN n ON n.lang = s.lang LEFT JOIN o ON o.lang = s.lang AND o.g = s.g WHERE longer IS NULL OR 100::HUGEINT * longer < {covered}::HUGEINT * a QUALIFY rank <= {top}"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query: the exact join of vectors and what its links reach, licence scans, sharding, collocations."""
    number = "('0x' || substr({m}, 1, 10))::BIGINT"
    return {
        "op4_licenses": _licenses_sql(),
        "op13_collocations": _collocations_sql(),
        "op7_shard": f"""WITH b AS (SELECT doc_id, source, coalesce('s' || source, '') AS stratum, coalesce(text, '') AS t FROM documents), r AS (SELECT *, md5('7|' || coalesce(doc_id::VARCHAR, '') || '|' || t) AS m FROM b),
k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {number.format(m='m')}, m, doc_id) - 1 AS rank, count(*) OVER (PARTITION BY stratum) AS n FROM r),
s AS (SELECT *, (rank + {number.format(m="md5('7|' || stratum)")} / 1099511627776.0::DOUBLE) / n AS share FROM k), p AS (SELECT *, row_number() OVER (ORDER BY share, stratum, rank) - 1 AS pos, count(*) OVER () AS total FROM s)
SELECT doc_id, strlen(t) + 16 AS size, {_crc32("list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: ('0x' || x)::BIGINT)")} AS text_crc32, 'rows' AS law, (pos * 40 // total)::INT AS shard, pos - (pos * 40 // total * total + 39) // 40 AS slot, NULL::INT AS grown_shard, source, pos FROM p""",
        "op3_cover_tree": """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
r AS (SELECT vec_id AS n, vec_id AS c FROM embeddings UNION SELECT e.b AS n, r.c FROM r JOIN e ON r.n = e.a),
c AS (SELECT n, min(c) AS component_id FROM r GROUP BY n), l AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON n = vec_id LEFT JOIN l ON a = vec_id""",
    }
