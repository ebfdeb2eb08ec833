"""Rows without a doc_id lose what an identified document repeats, and nothing of a neighbour's is lost for them."""

import hashlib

import numpy as np
import pytest

pytest.importorskip("lumenrank.llm.common")
from lumenrank.llm import mixing, suffixdedup  # noqa: E402


def test_suffix_dedup_of_null_ids(spark):
    line = "a line that is in very many documents, of a good sixty bytes."
    alone = " ".join(f"alone{i * 7919 % 1000}" for i in range(20))
    texts = [(5, f"first {line} end"), (9, f"{line} of another {alone[:30]}"), (None, f"without an id: {line} and more"), (None, alone), (None, None), (12, f"12 {line}")]
    got = sorted(tuple(r)[1:] for r in suffixdedup.removed(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)).collect())
    seen, want = set(), []
    for d, t in sorted(texts, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        own = [b[p : p + 50] for p in range(len(b) - 49)]
        for p, s in enumerate(own):
            if s in seen:
                gone[p : p + 50] = True
        seen |= set(own)
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        want.append((len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    assert got == sorted(want)


def test_mixing_keeps_null_ids(spark):
    rows = [(None if i % 3 == 0 else i, f"text {i} of some words " * (1 + i % 4), "a" if i % 2 else "b") for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert mixing.mixed_documents(docs).count() == sum(r.copies for r in mixing.mix(docs).collect())
    assert mixing.mixed_documents(docs).where("doc_id is null").count() > 0


def _plain(texts):
    """What is left of each text by the definition: ids in order, those without one last."""
    seen, want = set(), []
    for d, t in sorted(texts, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        own = [b[p : p + 50] for p in range(len(b) - 49)]
        for p, s in enumerate(own):
            if s in seen:
                gone[p : p + 50] = True
        seen |= set(own)
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        want.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(want, key=str)


LINE = "a shared line that stands in many of the documents, and is of some eighty bytes long"
MIXED = [
    [-9, -5, -2, None],
    [-(1 << 63), -1, 0, 7],
    [-(1 << 63), (1 << 63) - 1, (1 << 63) - 2, None],
    [3 << 61, 9223372036854775000, -3, None],
]


@pytest.mark.parametrize("ids", MIXED)
@pytest.mark.parametrize("alone", [True, False])
def test_suffix_dedup_of_any_long(spark, monkeypatch, ids, alone):
    """Negative and extreme ids, met by the receiver (one row for each batch and chunk) or by the sender."""
    own = lambda k: " ".join(f"own{k}x{i * 7919 % 1000}" for i in range(14))
    texts = [(d, f"{own(k)} {LINE} {own(k + 50)} {LINE[:70]}{k}") for k, d in enumerate(ids)]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if alone:
        monkeypatch.setattr(suffixdedup, "CHUNK", 1)
        spark.conf.set(name, "1")
    try:
        for order in (texts, texts[::-1]):
            docs = spark.createDataFrame(order, "doc_id long, text string").repartition(4 if alone else 1)
            got = sorted((tuple(r) for r in suffixdedup.removed(docs).collect()), key=str)
            assert got == _plain(texts)
            assert sum(r[2] for r in got) >= 3 * 80
    finally:
        spark.conf.set(name, before)


def test_vectors_that_share_an_id(spark):
    """Each has the links of its own vector, and nothing of the others of its id."""
    from lumenrank.llm import covertree

    rng = np.random.default_rng(3)
    base = rng.standard_normal((9, 6))
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (6, [1.0, 0.01]), (None, [0.0, 1.0])] + [(int(rng.integers(7, 15)), [float(x) for x in base[i % 9] + 0.1 * rng.standard_normal(6)]) for i in range(60)]
    unit = [np.array(v) / np.linalg.norm(v) for _, v in rows]
    link = [[j for j in range(len(rows)) if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9] for i in range(len(rows))]
    want = []
    for i, (d, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        own = min(ids) if ids else None
        want.append((d, len(link[i]), own, d == own))
    got = covertree.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert (5, 0, 5, True) not in want and (5, 1, 5, True) in want
