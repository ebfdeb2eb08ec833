import json

import pytest
from pyspark.sql import functions as F

from lumenrank.sources import files
from lumenrank.streaming import state


def lines(path, rows):
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))
    return str(path)


def test_texts(spark, tmp_path):
    p = lines(tmp_path / "c.jsonl", [{"_id": "a", "title": "T", "text": "x"}, {"id": "b", "text": " y "}, {"_id": " ", "text": "z"}, {"_id": "c", "text": ""}])
    assert {r.id: r.text for r in files.read_texts(spark, p).collect()} == {"a": "T\nx", "b": "y"}
    ids = spark.createDataFrame([("b",)], "id string")
    assert [r.id for r in files.read_texts(spark, p, ids).collect()] == ["b"]
    bad = lines(tmp_path / "bad.jsonl", ["{broken"])
    with pytest.raises(Exception):  # noqa: B017
        files.read_texts(spark, bad).collect()


def test_qrels(spark, tmp_path):
    three = lines(tmp_path / "q.tsv", ["query-id\tcorpus-id\tscore", "1\ta\t1", "1\ta\t3", "1\tb\t0", "2\tc\t1"])
    assert {(r.query_id, r.doc_id): r.rel for r in files.read_qrels(spark, three).collect()} == {("1", "a"): 3.0, ("2", "c"): 1.0}
    four = lines(tmp_path / "t.tsv", ["1\t0\ta\t2", "", " 1\t0\t b \t-1 ", "1\t0\td 9\t1"])
    assert sorted((r.doc_id, r.rel) for r in files.read_qrels(spark, four).collect()) == [("a", 2.0), ("d 9", 1.0)]
    taken = lines(tmp_path / "k.tsv", ["q1\td1\t2", "q1\td1\t0", "q1\td 9\t1"])
    assert {(r.doc_id, r.rel) for r in files.read_qrels(spark, taken).collect()} == {("d1", 2.0), ("d 9", 1.0)}
    for bad in (["q1\td1\tmany"], ["q1\td1"]):
        with pytest.raises(Exception, match="score"):
            files.read_qrels(spark, lines(tmp_path / "bad.tsv", bad)).collect()
    with pytest.raises(ValueError, match="no positive"):
        files.read_qrels(spark, lines(tmp_path / "none.tsv", ["q1\td1\t0"]))


def test_vectors(spark, tmp_path):
    p = lines(tmp_path / "v.jsonl", [{"id": "a", "vector": [3, 4]}, {"_id": "b", "embedding": [0, 0]}, {"id": "a", "values": [1, 0]}])
    got = {r.id: r.vector for r in files.read_vectors(spark, p).collect()}
    assert [round(x, 9) for x in got["a"]] == [0.6, 0.8] and got["b"] == [0.0, 0.0]
    ids = spark.createDataFrame([("a",), ("z",)], "id string")
    assert files.missing_vectors(ids, files.read_vectors(spark, p, ids)) == 1
    with pytest.raises(Exception, match="differ"):
        files.read_vectors(spark, lines(tmp_path / "w.jsonl", [{"id": "a", "vector": [1]}, {"id": "b", "vector": [1, 2]}])).collect()
    c = lines(tmp_path / "c.jsonl", [{"id": "p", "embedding": [1, 0]}, {"parent_id": "q", "child_id": "k", "embedding": [1, 0]}])
    assert {(r.parent_id, r.child_id) for r in files.read_child_vectors(spark, c).collect()} == {("p", "p"), ("q", "k")}


def test_training_rows(spark, tmp_path):
    p = lines(tmp_path / "p.jsonl", [{"query": "q", "positive": "r"}, {"left": "l", "right": "r", "label": 0}])
    assert sorted(r.label for r in files.read_text_pairs(spark, p).collect()) == [0.0, 1.0]
    h = lines(tmp_path / "h.jsonl", [{"query": "q", "document": "d", "negatives": ["n"], "teacher_scores": [1, 0]}])
    groups = files.read_hard_negatives(spark, h)
    assert groups.first().positive == "d"
    with pytest.raises(Exception, match="teacher score"):
        files.read_hard_negatives(spark, lines(tmp_path / "b.jsonl", [{"query": "q", "positive": "d", "negatives": ["n"], "teacher_scores": [1]}])).collect()
    t = lines(tmp_path / "t.jsonl", [{"query": " q ", "document": "n", "score": 0.5}, {"query": "q", "scores": [0.9, 0.1]}, {"query": "r", "source": " s", "positive_score": 1, "negative_scores": [0]}])
    assert sorted(((r.source, r.query, r.text, r.score, r.scores) for r in files.read_teacher_scores(spark, t).collect()), key=str) == [("", "q", "n", 0.5, None), ("", "q", None, None, [0.9, 0.1]), ("s", "r", None, None, [1.0, 0.0])]
    for rows, why in (([{"query": "q", "candidate": "n"}], "without any"), ([{"candidate": "n", "score": 1}], "needs a query"), ([{"query": "q", "score": 1}], "needs a query")):
        with pytest.raises(Exception, match=why):
            files.read_teacher_scores(spark, lines(tmp_path / "w.jsonl", rows)).collect()
    with pytest.raises(ValueError, match="duplicate"):
        files.read_teacher_scores(spark, lines(tmp_path / "d.jsonl", [{"query": "q", "text": "n", "score": 1}, {"query": "q ", "candidate": "n", "score": 2}]))
    k = lines(tmp_path / "k.jsonl", [{"query_tokens": [1, 2], "negative_tokens": [[3]], "target": -1}])
    assert files.read_token_rows(spark, k).first().negative_tokens == [[3]]


def test_series_and_traces(spark, tmp_path):
    assert files.read_series(spark, lines(tmp_path / "s.jsonl", [{"id": "s", "values": [1, 2]}])).first()["values"] == [1.0, 2.0]
    with pytest.raises(Exception, match="series"):
        files.read_series(spark, lines(tmp_path / "e.jsonl", [{"id": "s", "values": []}])).collect()
    t = lines(tmp_path / "t.jsonl", [{"id": "t", "events": ["plain", {"type": "click", "message": "m", "metadata": {"b": "2", "a": " 1 ", "c": ""}}]}])
    assert [r.text for r in files.read_traces(spark, t).orderBy("pos").collect()] == ["trace_id: t\nevent_index: 0\ntext: plain", "trace_id: t\nevent_index: 1\nevent_type: click\nmessage: m\nmetadata: a=1 b=2"]
    full = lines(tmp_path / "f.jsonl", [{"id": "t", "label": "L", "text": "T", "events": [{"id": "e", "timestamp": "1", "role": "r", "actor": "a", "text": "x", "summary": "s"}]}])
    got = files.read_traces(spark, full)
    assert got.first().text == "trace_text: T\ntrace_label: L\ntrace_id: t\nevent_index: 0\nevent_id: e\nevent_time: 1\nrole: r\nactor: a\ntext: x\nsummary: s"
    assert got.select(files.render_trace()).first()[0] == "text: T\nlabel: L\ntrace_id: t\nevents: count=1"
    with pytest.raises(Exception, match="event"):
        files.read_traces(spark, lines(tmp_path / "x.jsonl", [{"id": "t", "events": [" "]}])).collect()
    with pytest.raises(ValueError):
        files.read_lines(spark, lines(tmp_path / "l.txt", [" "]))


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([("1", 1.0), ("2", 2.0)], "id string, v double")
    assert files.append_missing(a.where("id = '1'"), str(tmp_path / "out")) == 1
    assert files.append_missing(a, str(tmp_path / "out")) == 1 and files.append_missing(a, str(tmp_path / "out")) == 0
    files.write_tsv(a, str(tmp_path / "tsv"))
    files.write_jsonl(a, str(tmp_path / "jsonl"))
    m = files.manifest(spark, str(tmp_path / "jsonl"))
    assert m.where("length(sha256) = 64").count() >= 1
    listed = spark.createDataFrame([*((r.file, r.bytes, r.sha256) for r in m.collect()), ("gone", 1, "0" * 64)], m.schema)
    assert {r.status for r in files.verify_manifest(spark, str(tmp_path / "jsonl"), listed).collect()} == {"ok", "missing"}
    assert {r.status for r in files.verify_manifest(spark, str(tmp_path / "jsonl"), listed.limit(0)).collect()} == {"extra"}
    assert [r.id for r in files.read_texts(spark, lines(tmp_path / "three.jsonl", [{"id": k, "text": k} for k in "cab"]), limit=2).collect()] == ["c", "a"]
    rows = spark.createDataFrame([(1, "q", "Q", "d", "one two", 1.0), (2, "q", "Q2", "d", "other", 3.0), (3, "q", "Q", "e", "a b c d", 1.0)], "pos int, query_id string, query string, doc_id string, text string, rel double")
    b = files.convert_to_beir(rows, longest_words=3)
    assert [(r.doc_id, r.rel) for r in b["qrels"].collect()] == [("d", 3.0)] and b["queries"].first().text == "Q"
    assert tuple(files.beir_statistics(b).first()) == (1, 2.0, 2, 1, 1, 1, 1.0)


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 1), ("b", 5, 2), ("a", 7, 3)], "id string, value long, seq long")
    rows.write.parquet(str(tmp_path / "in"))
    assert {r.id: r.value for r in state.kv_last(rows, ["id"], "value", "seq").collect()} == {"a": 7, "b": 5}
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = state.kv_cache(stream(), "id", "value", "seq").writeStream.format("memory").queryName("kv").outputMode("update").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.id: r.value for r in spark.table("kv").collect()} == {"a": 7, "b": 5}
    for _ in range(2):
        q = state.resumable_sink(stream(), str(tmp_path / "sink"), str(tmp_path / "c2")).start()
        q.processAllAvailable()
        q.stop()
    assert spark.read.parquet(str(tmp_path / "sink")).agg(F.count("*")).first()[0] == 2
