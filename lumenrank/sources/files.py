"""Readers and writers of the file formats: every reader gives one fixed schema, whatever spelling the file uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import text as X
from ..functions import vectors as V
from .positions import place_of_row, read_lines_at

_STRING = T.StringType()


def beir_paths(folder: str, split: str = "test") -> dict[str, str]:
    return {"corpus": f"{folder}/corpus.jsonl", "queries": f"{folder}/queries.jsonl", "qrels": f"{folder}/qrels/{split}.tsv"}


def _json(spark: SparkSession, path: str, fields: dict[str, T.DataType]) -> DataFrame:
    """JSON lines by a fixed schema; a line that is no JSON fails the read."""
    schema = T.StructType([T.StructField(k, v) for k, v in fields.items()])
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _required(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """df, failing when it is read where the condition doesn't hold."""
    return df.where(F.when(condition, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def read_texts(spark: SparkSession, path: str, ids: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """(id, text) of a corpus or query file: text is title and text; rows without id or text are left out."""
    raw = _json(spark, path, {"_id": _STRING, "id": _STRING, "title": _STRING, "text": _STRING})
    rows = raw.select(place_of_row().alias("pos"), F.coalesce(X.blank_to_null(F.col("_id")), X.blank_to_null(F.col("id"))).alias("id"), X.corpus_text(F.col("title"), F.col("text")).alias("text"))
    rows = rows.where("id is not null and text <> ''")
    if ids is not None:
        rows = rows.join(ids.select("id"), "id", "left_semi").select("pos", "id", "text")
    if limit is None:
        return rows.drop("pos")
    return rows.orderBy("pos").limit(limit).drop("pos")  # the first ones by files and lines: a top-k, not a sort


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, rel) of lines with three columns, or four as TREC has them, parted by tabs; rel > 0.

    A file's first line whose first column names a query is a header. Lines of fewer columns, or whose score is no number, fail
    the read, and so does a file without any positive row. Of the positive rows of a pair the last one wins: a row of
    no relevance says nothing, it does not take back an earlier one.
    """
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    lines = read_lines_at(spark, path).select(F.col("place").alias("pos"), F.split(strip(F.col("text")), "\t").alias("c"))
    first = lines.where("pos.block = 0").groupBy(F.col("pos.file").alias("file")).agg(F.min("pos.line").alias("line"))  # a row for each file
    at = (F.col("pos.file") == F.col("file")) & (F.col("pos.line") == F.col("line"))
    header = F.col("line").isNotNull() & (F.size("c") >= 2) & F.contains(F.lower(F.get("c", F.lit(0))), F.lit("query"))
    # Whether a line is a header stays in every condition: else a check could be made before the headers are gone.
    lines = lines.join(first, at, "left").withColumn("header", header).where(F.col("header") | (F.size("c") > 1) | (F.get("c", F.lit(0)) != ""))
    lines = _required(lines, F.col("header") | (F.size("c") >= 3), "a judgement needs three columns: query, document and score")
    column = lambda three, four: F.when(F.size("c") >= 4, F.get("c", F.lit(four))).otherwise(F.get("c", F.lit(three)))
    rel = strip(column(2, 3)).try_cast("double")
    rows = lines.select("pos", "header", strip(F.get("c", F.lit(0))).alias("query_id"), strip(column(1, 2)).alias("doc_id"), rel.alias("rel"))
    rows = _required(rows, F.col("header") | F.col("rel").isNotNull(), "a score is no number").where(F.expr("case when header then false else rel > 0 and query_id <> '' and doc_id <> '' end"))
    last = rows.groupBy("query_id", "doc_id").agg(F.max_by("rel", "pos").alias("rel"))
    if last.isEmpty():
        raise ValueError(f"no positive judgement in {path}")
    return last


def _vector() -> Column:
    filled = lambda c: F.when(F.size(F.coalesce(c, F.array().cast("array<float>"))) > 0, c)
    return F.coalesce(filled(F.col("vector")), filled(F.col("embedding")), filled(F.col("values")))


_VECTORS = {k: T.ArrayType(T.FloatType()) for k in ("vector", "embedding", "values")}


def read_vectors(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """(id, vector) at unit length; the first of equal ids; one length for all, or reading fails."""
    raw = _json(spark, path, {"_id": _STRING, "id": _STRING, **_VECTORS})
    rows = raw.select(F.coalesce(X.blank_to_null(F.col("_id")), X.blank_to_null(F.col("id"))).alias("id"), _vector().alias("v"), place_of_row().alias("pos")).where("id is not null and v is not null")
    if ids is not None:
        rows = rows.join(ids.select("id"), "id", "left_semi")
    first = rows.withColumn("n", F.row_number().over(W.partitionBy("id").orderBy("pos"))).where("n = 1")
    size = first.agg(F.min(F.size("v")).alias("lo"), F.max(F.size("v")).alias("hi"))
    checked = _required(first.join(F.broadcast(size)), F.col("lo") == F.col("hi"), "vectors differ in length")  # one row
    return checked.select("id", V.normalize(F.col("v")).alias("vector"))


def missing_vectors(ids: DataFrame, vectors: DataFrame) -> int:
    return ids.join(vectors.select("id"), "id", "left_anti").count()


def read_child_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(parent_id, child_id, vector); either id may stand in for the other."""
    raw = _json(spark, path, {"parent_id": _STRING, "child_id": _STRING, "_id": _STRING, "id": _STRING, **_VECTORS})
    own = F.coalesce(X.blank_to_null(F.col("_id")), X.blank_to_null(F.col("id")))
    parent = F.coalesce(X.blank_to_null(F.col("parent_id")), own)
    child = F.coalesce(X.blank_to_null(F.col("child_id")), own, parent)
    return raw.select(parent.alias("parent_id"), child.alias("child_id"), _vector().alias("v")).where("parent_id is not null and v is not null").select("parent_id", "child_id", V.normalize(F.col("v")).alias("vector"))


def read_text_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(source, query, right, label): a label that is absent counts as positive."""
    raw = _json(spark, path, {k: _STRING for k in ("source", "query", "left", "positive", "document", "right")} | {"label": T.DoubleType()})
    return raw.select(F.coalesce("source", F.lit("")).alias("source"), F.coalesce("query", "left").alias("query"), F.coalesce("positive", "document", "right").alias("right"), F.coalesce("label", F.lit(1.0)).alias("label"))


def read_hard_negatives(spark: SparkSession, path: str) -> DataFrame:
    """(source, query, positive, negatives, teacher_scores); scores must be none, or one for each candidate."""
    raw = _json(spark, path, {k: _STRING for k in ("source", "query", "positive", "document")} | {"negatives": T.ArrayType(_STRING), "teacher_scores": T.ArrayType(T.FloatType())})
    rows = raw.select(F.coalesce("source", F.lit("")).alias("source"), "query", F.coalesce("positive", "document").alias("positive"), F.coalesce("negatives", F.array().cast("array<string>")).alias("negatives"), F.coalesce("teacher_scores", F.array().cast("array<float>")).alias("teacher_scores"))
    return _required(rows, F.size("teacher_scores").isin(0) | (F.size("teacher_scores") == F.size("negatives") + 1), "one teacher score for each candidate")


def read_token_rows(spark: SparkSession, path: str) -> DataFrame:
    """Token-level rows of pairs, contrastive pairs or hard negatives, with their masks; fields that a file lacks are null."""
    ints, lists = T.ArrayType(T.IntegerType()), T.ArrayType(T.ArrayType(T.IntegerType()))
    names = ("left_tokens", "right_tokens", "left_mask", "right_mask", "query_tokens", "positive_tokens", "query_mask", "positive_mask")
    return _json(spark, path, {n: ints for n in names} | {"negative_tokens": lists, "negative_masks": lists, "target": T.FloatType()})


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(text): lines with white space collapsed, none blank; a file without any fails."""
    rows = spark.read.text(path).select(X.collapse(F.col("value")).alias("text")).where("text <> ''")
    if rows.isEmpty():
        raise ValueError(f"no text in {path}")
    return rows


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """(id, label, text, values); no series may be empty or hold a value that isn't finite."""
    raw = _json(spark, path, {"_id": _STRING, "id": _STRING, "label": _STRING, "text": _STRING, "values": T.ArrayType(T.DoubleType())})
    rows = raw.select(F.coalesce("_id", "id").alias("id"), "label", "text", "values")
    finite = F.forall("values", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return _required(rows, F.coalesce((F.size("values") > 0) & finite, F.lit(False)), "a series is empty or not finite")


_EVENT = "id string, type string, time string, timestamp string, role string, actor string, text string, message string, summary string, metadata map<string,string>"


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """(id, label, trace_text, pos, events, text): one row per event with its full rendering; an event is a string or an
    object, and may not be empty."""
    line = spark.read.text(path).select(F.from_json("value", "_id string, id string, label string, text string, events array<string>", {"mode": "FAILFAST"}).alias("t"))
    e = line.select(F.coalesce("t._id", "t.id").alias("id"), "t.label", F.col("t.text").alias("trace_text"), F.size("t.events").alias("events"), F.posexplode("t.events").alias("pos", "raw"))
    o = e.withColumn("o", F.when(F.trim("raw").startswith("{"), F.from_json("raw", _EVENT)))
    named = {"event_id": F.col("o.id"), "event_type": F.col("o.type"), "event_time": F.coalesce("o.time", "o.timestamp"), "role": F.col("o.role"), "actor": F.col("o.actor"), "text": F.coalesce(F.col("o.text"), F.when(F.col("o").isNull(), F.trim("raw"))), "message": F.col("o.message"), "summary": F.col("o.summary"), "metadata": X.render_map(F.col("o.metadata"))}
    own = X.render_fields(named)
    head = X.render_fields({"trace_text": F.col("trace_text"), "trace_label": F.col("label"), "trace_id": F.col("id"), "event_index": F.col("pos").cast("string")})
    rows = o.select("id", "label", "trace_text", F.col("pos").cast("long").alias("pos"), F.col("events").cast("long").alias("events"), F.concat_ws("\n", head, own).alias("text"), (own != "").alias("_some"))
    return _required(rows, F.col("_some"), "an event is empty").drop("_some")


def render_trace() -> Column:
    """The corpus text of a trace (id, label, trace_text, events)."""
    return X.render_fields({"text": F.col("trace_text"), "label": F.col("label"), "trace_id": F.col("id"), "events": F.concat(F.lit("count="), F.col("events").cast("string"))})


def read_teacher_scores(spark: SparkSession, path: str) -> DataFrame:
    """(source, query, text, score, scores) of the row shapes: one score for a candidate (under any of its names), or a
    vector for a whole example (teacher_scores, scores, or positive_score with negative_scores).

    Keys are trimmed. A row without a score, a query or a candidate, a score that isn't finite, a key that occurs twice
    and an empty file are errors.
    """
    numbers = T.ArrayType(T.DoubleType())
    names = ("candidate", "document", "text", "positive")
    raw = _json(spark, path, {k: _STRING for k in ("source", "query", *names)} | {"score": T.DoubleType(), "positive_score": T.DoubleType(), "negative_scores": numbers, "teacher_scores": numbers, "scores": numbers})
    if raw.isEmpty():
        raise ValueError(f"no teacher scores in {path}")
    filled = lambda c: F.when(F.size(F.coalesce(c, F.array().cast("array<double>"))) > 0, c)
    pair = F.when(F.col("positive_score").isNotNull(), F.concat(F.array("positive_score"), F.coalesce("negative_scores", F.array().cast("array<double>"))))
    vector = F.coalesce(filled(F.col("teacher_scores")), filled(F.col("scores")), pair)
    text = F.coalesce(*[X.blank_to_null(F.col(n)) for n in names])
    rows = raw.select(F.trim(F.coalesce("source", F.lit(""))).alias("source"), X.blank_to_null(F.col("query")).alias("query"), F.when(vector.isNull(), text).alias("text"), F.when(vector.isNull(), F.col("score")).alias("score"), vector.alias("scores"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = _required(rows, F.col("scores").isNotNull() | F.col("score").isNotNull(), "a row without any score")
    rows = _required(rows, F.col("query").isNotNull() & (F.col("scores").isNotNull() | F.col("text").isNotNull()), "a score needs a query and a candidate")
    rows = _required(rows, F.coalesce(F.forall("scores", finite), finite(F.col("score"))), "a score is not finite")
    twice = rows.groupBy("source", "query", "text", F.col("scores").isNotNull().alias("v")).count().where("count > 1").select("source", "query", "text")
    if not twice.isEmpty():
        raise ValueError(f"duplicate teacher scores in {path}: {twice.first()}")
    return rows


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_vectors(df: DataFrame, path: str) -> None:
    """(id, vector) or (parent_id, child_id, vector) as JSON lines with the field `embedding`."""
    write_jsonl(df.withColumnRenamed("vector", "embedding"), path)


def append_missing(df: DataFrame, path: str, key: str = "id") -> int:
    """Write the rows whose key is not in the Parquet table at path yet; how many. A run that was cut off is gone on with."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(key)
        df = df.join(done, key, "left_anti")
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    n = df.count()
    if n:
        df.write.mode("append").parquet(path)
    return n


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of the files under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_manifest(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """(file, status) of a manifest's files and of what lies at the path: ok, changed, missing, or extra."""
    now = manifest(spark, path).select("file", F.col("bytes").alias("_b"), F.col("sha256").alias("_h"))
    met = expected.select("file", "bytes", "sha256").join(now, "file", "full_outer")
    same = (F.col("bytes") == F.col("_b")) & (F.col("sha256") == F.col("_h"))
    return met.select("file", F.when(F.col("sha256").isNull(), "extra").when(F.col("_h").isNull(), "missing").when(same, "ok").otherwise("changed").alias("status"))


def beir_statistics(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: documents, queries and judgements of a converted set, words of its documents, judgements for each query."""
    words = F.size(X.words(F.col("text")))
    c = tables["corpus"].agg(F.count("*").alias("documents"), F.avg(words).alias("mean_words"), F.max(words).alias("most_words"))
    q = tables["queries"].agg(F.count("*").alias("queries"))
    r = tables["qrels"].agg(F.count("*").alias("judgements"), F.count_distinct("query_id").alias("judged_queries"))
    return c.crossJoin(F.broadcast(q)).crossJoin(F.broadcast(r)).withColumn("judgements_per_query", F.col("judgements") / F.greatest(F.col("judged_queries"), F.lit(1)))  # one row each


def convert_to_beir(rows: DataFrame, longest_words: int | None = None) -> dict[str, DataFrame]:
    """corpus, queries, qrels of rows (pos, query_id, query, doc_id, text, rel): the first of equal ids, the highest relevance,
    documents in the given length, judgements only of what both tables hold."""
    first = lambda k, v: rows.where(F.col(k).isNotNull() & (F.trim(v) != "")).groupBy(F.col(k).alias("id")).agg(F.min_by(v, "pos").alias("text"))
    corpus, queries = first("doc_id", "text"), first("query_id", "query")
    if longest_words is not None:
        corpus = corpus.where(F.size(X.words(F.col("text"))) <= longest_words)
    qrels = rows.groupBy("query_id", "doc_id").agg(F.max("rel").alias("rel"))
    qrels = qrels.join(corpus.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").join(queries.select(F.col("id").alias("query_id")), "query_id", "left_semi")
    return {"corpus": corpus, "queries": queries, "qrels": qrels.select("query_id", "doc_id", "rel")}
