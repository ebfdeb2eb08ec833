"""Export drivers from files to committed vectors, with a run that is cut off."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenrank.operators import bpe, encoder
from lumenrank.plans import exports


def lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


@pytest.fixture(scope="module")
def model(spark):
    texts = spark.createDataFrame([("passage text of a number of words count start end min max mean 1 2 3",)], "text string")
    m = bpe.train(texts, 60)
    return m, encoder.Weights.seeded(len(m.tokens), 8, 16)


def direct(model, text, dims=None):
    """A text's vector by the encoder alone."""
    m, w = model
    ids = [m.ids["<bos>"], *[i for word in norm_words(text) for i in m.word(word)], m.ids["<eos>"]]
    v = encoder.encode_tokens(np.array(ids), np.ones(len(ids)), w)[:dims]
    return v / np.linalg.norm(v)


def norm_words(text):
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def test_texts(spark, tmp_path, model):
    path, calls = lines(tmp_path / "c.jsonl", [{"_id": f"d{i}", "title": "", "text": f"text  number {i % 5}\n words"} for i in range(30)]), []

    def embed(broken):
        def run(docs):
            calls.append(1)
            if broken and len(calls) > 2:
                raise InterruptedError
            return encoder.embed_texts(docs, *model)

        return run

    out = str(tmp_path / "out")
    with pytest.raises(InterruptedError):
        exports.export_texts(spark, path, out, embed(True), "passage: ", 4, batches=5)
    told = exports.export_texts(spark, path, out, embed(False), "passage: ", 4, batches=5)
    assert told["batches_reused"] == 2 and told["batches_made"] == 3
    got = {r.id: r.vector for r in exports.read_export(spark, out).collect()}
    assert len(got) == 30
    for i in range(30):
        assert np.allclose(got[f"d{i}"], direct(model, f"passage: text number {i % 5} words", 4))
    few = spark.createDataFrame([("d3",), ("d9",)], "id string")
    exports.export_texts(spark, path, str(tmp_path / "few"), embed(False), ids=few, batches=2)
    assert {r.id for r in exports.read_export(spark, str(tmp_path / "few")).collect()} == {"d3", "d9"}


def test_series_and_traces(spark, tmp_path, model):
    embed = lambda d: encoder.embed_texts(d, *model)
    series = lines(tmp_path / "s.jsonl", [{"id": f"s{k}", "label": "mean", "values": [float(x % 7) for x in range(k * 9 + 1)]} for k in range(3)])
    exports.export_series(spark, series, str(tmp_path / "s"), embed, 8, 4, batches=2)
    got = exports.read_export(spark, str(tmp_path / "s")).orderBy("child_id").collect()
    assert [r.child_id for r in got if r.parent_id == "s1"] == ["s1#window-0000", "s1#window-0002"] and {r.parent_id for r in got} == {"s0", "s1", "s2"}
    assert all(abs(np.linalg.norm(r.vector) - 1) < 1e-9 for r in got)
    traces = lines(tmp_path / "t.jsonl", [{"id": "t1", "label": "end", "events": ["start", {"type": "max", "text": "words"}, "number", "end"]}])
    exports.export_traces(spark, traces, str(tmp_path / "t"), embed, 3, 1, dims=5, batches=2)
    got = exports.read_export(spark, str(tmp_path / "t")).orderBy("child_id").collect()
    assert [(r.parent_id, r.child_id, len(r.vector)) for r in got] == [("t1", "t1#window-0000", 5), ("t1", "t1#window-0001", 5)]
    assert exports.read_export(spark, str(tmp_path / "none")) is None
    assert exports.read_export(spark, str(tmp_path / "t")).where(F.size("vector") != 5).count() == 0
