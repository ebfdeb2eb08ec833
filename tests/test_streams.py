"""State, commits, table functions, places of lines and turn-taking orders against plain forms, and cut-off runs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lumenrank.operators import tablefunctions, turntaking
from lumenrank.sources import commitlog, positions
from lumenrank.streaming import cache

EVENT = "k string, kind string, seq long, value array<double>"


def test_cache_stream(spark, tmp_path):
    """Reads between writes in one micro-batch, over several, of keys that are absent, and of keys from a table."""
    rng = random.Random(2)
    batches, seq = [], 0
    for _ in range(4):
        rows = []
        for _ in range(25):
            seq += 1
            key = rng.choice(["a", "b", "c", "d", None])
            rows.append((key, "write", seq, [float(seq), 1.0]) if rng.random() < 0.4 else (key, "read", seq, None))
        batches.append(rows)
    batches[1].append(("a", "write", 2, [-1.0, -1.0]))  # comes late
    initial = spark.createDataFrame([("d", 0, [7.0, 7.0]), ("e", 0, [8.0, 8.0])], "k string, seq long, value array<double>")
    held, want = {"d": [7.0, 7.0], "e": [8.0, 8.0]}, []
    batches[0].append(("e", "read", 999, None))
    for rows in batches:
        for k, kind, s, v in sorted(rows, key=lambda r: r[2]):
            if kind == "read":
                want.append((k, s, held.get(k, [0.0, 0.0]), k in held))
            elif s != 2:
                held[k] = v
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        with cache.state_settings(spark):
            stream = spark.readStream.schema(EVENT).parquet(str(tmp_path / "in"))
            q = cache.cache(stream, "k", 2, initial).writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
            q = q.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
        q.awaitTermination()
        assert q.exception() is None, i
    got = [(r.k, r.seq, list(r.value), r.found) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert spark.conf.get("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", None) is None


def test_cached_reads(spark):
    rows = [("a", "read", 1, None), ("a", "write", 2, [5.0]), ("a", "read", 2, None), ("a", "read", 9, None), ("b", "read", 1, None)]
    initial = spark.createDataFrame([("b", [3.0])], "k string, value array<double>")
    got = cache.cached_reads(spark.createDataFrame(rows, EVENT), "k", 1, initial).collect()
    assert sorted((r.k, r.seq, r.value[0], r.found) for r in got) == [("a", 1, 0.0, False), ("a", 2, 5.0, True), ("a", 9, 5.0, True), ("b", 1, 3.0, True)]


def vectors(spark, n=40):
    return spark.range(n).select(F.concat(F.lit("k"), "id").alias("key"), "id")


def test_export_goes_on_after_a_failed_task(spark, tmp_path):
    path, calls = str(tmp_path / "t"), []

    def make(broken):
        def run(part):
            calls.append(1)
            bad = F.raise_error(F.lit("lost")).cast("long")
            return part.select("key", F.when(F.lit(broken and len(calls) > 3) & (F.col("id") >= 0), bad).otherwise(F.col("id") * 2).alias("v"))

        return run

    with pytest.raises(Exception, match="lost"):
        commitlog.export(vectors(spark), path, "key", make(True), 6)
    log = commitlog.CommitLog(spark, path)
    assert len(log.records()) == 3 and log.read().count() < 40
    (tmp_path / "t" / "data" / "9-half").mkdir()
    (tmp_path / "t" / "log" / "9-half.tmp").write_text("{")
    calls.clear()
    told = commitlog.export(vectors(spark), path, "key", make(False), 6)
    assert len(calls) == 3 == told["batches_made"] and told["batches_reused"] == 3 and told["rows_made"] + told["rows_reused"] == 40
    assert sorted(r.v for r in log.read().collect()) == [2 * i for i in range(40)]
    assert not (tmp_path / "t" / "data" / "9-half").exists() and not (tmp_path / "t" / "log" / "9-half.tmp").exists()
    assert commitlog.export(vectors(spark), path, "key", make(False), 6)["batches_made"] == 0
    assert not log.commit(2, vectors(spark)) and log.read().count() == 40
    with pytest.raises(ValueError, match="changed"):
        commitlog.export(vectors(spark, 41), path, "key", make(False), 6)
    with pytest.raises(ValueError, match="number of batches"):
        commitlog.export(vectors(spark), path, "key", make(False), 5)


def test_stream_into_a_log(spark, tmp_path):
    vectors(spark).write.parquet(str(tmp_path / "in"))
    start = lambda at: commitlog.sink(spark.readStream.schema("key string, id long").parquet(str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / at)).trigger(availableNow=True).start().awaitTermination()
    start("c")
    assert commitlog.CommitLog(spark, str(tmp_path / "t")).read().count() == 40
    start("another")  # the same batch again, as if the checkpoint had not been written
    assert commitlog.CommitLog(spark, str(tmp_path / "t")).read().count() == 40


def test_table_function(spark):
    rows = [(q, d, float(d * 7 % 5), f"x{d}") for q in range(6) for d in range(q * 3)] + [(None, 1, 2.0, None)]
    scored = spark.createDataFrame(rows, "query_id long, doc_id long, score double, label string").repartition(3)
    want = []
    for q in [*range(1, 6), None]:
        best = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))[:4]
        want.append((q, len(best), [(i + 1, *r[1:]) for i, r in enumerate(best)]))
    told = lambda df: sorted(((r.query_id, r.n, [tuple(c) for c in r.candidates]) for r in df.collect()), key=str)
    assert told(tablefunctions.candidate_runs(scored, 4)) == sorted(want, key=str)
    scored.createOrReplaceTempView("scored_rows")
    sql = "SELECT * FROM candidate_run(TABLE(scored_rows) PARTITION BY query_id ORDER BY (score DESC, doc_id), {})"
    assert told(spark.sql(sql.format(4))) == sorted(want, key=str)
    for bad in ("0", "NULL", "(SELECT 1)"):
        with pytest.raises(Exception):  # noqa: B017
            spark.sql(sql.format(bad)).collect()


def test_places_of_lines(spark, tmp_path):
    """Several files larger than a split: the first lines, the last wins, and limits go by files and lines."""
    lines, k = {}, 0
    for name in ("a.jsonl", "b.jsonl", "c.jsonl"):
        rows = []
        for _ in range(700):
            rows.append({"id": k % 97, "v": k})
            k += 1
        lines[name] = rows
        (tmp_path / name).write_text("\n".join(json.dumps(r) for r in rows) + "\n\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        read = positions.read_json_at(spark, "id long, v long", str(tmp_path))
        assert read.rdd.getNumPartitions() > 12 and read.select("place.file", "place.block").distinct().count() > 12
        assert [r.v for r in read.orderBy("place").collect()] == list(range(2100))
        assert [r.v for r in positions.limit_at(read, 900).collect()] == list(range(900))
        every = [r for name in sorted(lines) for r in lines[name]]
        assert {r.id: r.v for r in positions.last_of(read, ["id"]).collect()} == {r["id"]: r["v"] for r in every}
        assert {r.id: r.v for r in positions.first_of(read, ["id"]).collect()} == {r["id"]: r["v"] for r in reversed(every)}
        texts = positions.read_lines_at(spark, str(tmp_path))
        heads = texts.join(positions.first_lines(texts), (F.col("place.line") == F.col("line")) & (F.col("place.file") == F.col("file")))
        assert sorted(json.loads(r.text)["v"] for r in heads.collect()) == [0, 700, 1400]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def loop(sources, weights, batch):
    """Source-weighted turns as a loop over rows."""
    queues, out = {}, []
    for i, s in enumerate(sources):
        queues.setdefault(s, []).append(i)
    while any(queues.values()):
        room = batch
        while room and any(queues.values()):
            for s, q in queues.items():
                for _ in range(weights.get(s, 1)):
                    if room and q:
                        out.append(q.pop(0))
                        room -= 1
    return out


def test_turn_plans():
    rng = random.Random(1)
    for _ in range(300):
        names = "abcde"[: rng.randint(1, 5)]
        sources = [rng.choice(names) for _ in range(rng.randint(1, 90))]
        weights, batch = {n: rng.randint(1, 4) for n in names if rng.random() < 0.7}, rng.randint(1, 12)
        order = list(dict.fromkeys(sources))
        plan = turntaking.turn_plan([sources.count(s) for s in order], [weights.get(s, 1) for s in order], batch)
        assert len(plan) <= 2 * len(order) + 1
        rows, at = [[i for i, s in enumerate(sources) if s == o] for o in order], {}
        for p in plan:
            for g, places in enumerate(p.places):
                for j in range(len(places) * p.batches):
                    at[p.position + j // len(places) * sum(map(len, p.places)) + places[j % len(places)]] = rows[g][p.start[g] + j]
        assert [at[i] for i in range(len(sources))] == loop(sources, weights, batch)
    with pytest.raises(ValueError):
        turntaking.turn_plan([3], [0], 4)


def test_turn_taking_orders(spark):
    rng = random.Random(9)
    sources = [rng.choice(["a", "a", "a", "b", "c", None]) for _ in range(230)]
    rows = spark.createDataFrame(list(enumerate(sources)), "id long, source string").repartition(4)
    got = turntaking.source_turns(rows, "source", "id", {"a": 3, "c": 2}, 16).orderBy("position").collect()
    assert [r.id for r in got] == loop(sources, {"a": 3, "c": 2}, 16) and [r.position for r in got] == list(range(230))
    got = turntaking.spread(rows, "source", "id").orderBy("position").collect()
    assert [r.id for r in got] == loop(sources, {}, 10**6) and [r.position for r in got] == list(range(230))
    assert turntaking.spread(rows.limit(0), "source", "id").count() == 0
    assert turntaking.source_turns(rows.limit(0), "source", "id", {}, 4).count() == 0


def test_readers_over_split_files(spark, tmp_path):
    """Judgements and texts in several files that are larger than a split: headers, the last one wins, and limits."""
    from lumenrank.sources import files

    want, texts = {}, []
    (tmp_path / "q").mkdir()
    (tmp_path / "t").mkdir()
    for f in range(3):
        rows = [(f"q{i % 40}", f"d{i % 7}", f * 1000 + i) for i in range(600)]
        (tmp_path / "q" / f"{f}.tsv").write_text("query-id\tcorpus-id\tscore\n" + "".join(f"{q}\t{d}\t{s}\n" for q, d, s in rows))
        want |= {(q, d): float(s) for q, d, s in rows if s > 0}
        part = [f"{f}-{i}" for i in range(500)]
        (tmp_path / "t" / f"{f}.jsonl").write_text("".join(json.dumps({"_id": x, "text": f"text {x}"}) + "\n" for x in part))
        texts += part
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        assert {(r.query_id, r.doc_id): r.rel for r in files.read_qrels(spark, str(tmp_path / "q")).collect()} == want
        assert [r.id for r in files.read_texts(spark, str(tmp_path / "t"), limit=1200).collect()] == texts[:1200]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
