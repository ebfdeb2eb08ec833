import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from lumenrank.llm import queries, similar, tiling, toxicity  # noqa: E402


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels, benchmark = spark.read.parquet(f"{small}/labels.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    out = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, small)
        assert now.columns == docs.columns
        now = spark.createDataFrame(now.collect(), docs.schema)
        out[name] = now
    bad = {r.doc_id for r in toxicity.toxicity(docs, labels).where("predicted = 1").collect()}
    ids = {k: {r.doc_id for r in v.collect()} for k, v in out.items()}
    assert ids["toxicity"] == {r.doc_id for r in docs.collect()} - bad
    assert ids["near-dedup"] == {r.component_id for r in similar.similar_groups(out["toxicity"]).collect()}
    leaks = {r.doc_id for r in tiling.contaminated(out["near-dedup"], benchmark).collect()}
    assert ids["decontamination"] == ids["near-dedup"] - leaks
    last = corpus_pipeline.STAGES[-1][1](spark, now, small)
    assert last.count() == out["mix"].count()


def test_run_and_names(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 0
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{i}" for i in range(1, 11)}
