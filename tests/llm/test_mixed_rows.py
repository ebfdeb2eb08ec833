"""The mixed rows: each as often as mix() takes it, with and without rows that share an id."""

from collections import Counter

import pytest

pytest.importorskip("lumenrank.llm.common")
from lumenrank.llm import mixing  # noqa: E402


@pytest.mark.parametrize("repeats", [False, True])
def test_mixed_rows(spark, repeats):
    rows = [(None if k == 7 else k, None if k % 9 == 0 else f"s{k % 3}", f"text {k} " + "word " * (k % 11)) for k in range(60)]
    rows += [(k, f"s{k % 3}", f"copy {k} " + "word " * (k % 11)) for k in (4, 5)] * repeats
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    got = mixing.mixed_documents(docs)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("row_number" in plan) == repeats  # texts aren't ordered where no row needs a number
    want = Counter()
    for r in mixing.mix(docs).where("copies > 0").collect():
        want[r.doc_id, r.source] += r.copies
    assert Counter((r.doc_id, r.source) for r in got.select("doc_id", "source").collect()) == +want
