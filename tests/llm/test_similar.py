"""The near-dedup stage against brute-force Jaccard similarity."""

import random

import pytest

pytest.importorskip("lumenrank.llm.common")
from lumenrank.llm import similar  # noqa: E402


def brute_groups(rows):
    sets = []
    for _, text in rows:
        p = (text or "").encode().lower().split()
        sets.append({tuple(p[i : i + 5]) for i in range(max(1, len(p) - 4))} if p else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    first = {}
    for i, (d, _) in enumerate(rows):
        first[find(i)] = min(d, first.get(find(i), d))
    return {d: first[find(i)] for i, (d, _) in enumerate(rows)}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def test_similar_groups(spark, small, monkeypatch):
    rng = random.Random(3)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    for g in range(6):
        words = [f"g{g}w{rng.randrange(500)}" for _ in range(rng.randrange(60, 300))]
        rows += [(10_000 + 100 * g + i, edited(rng, words, rng.randrange(1 + len(words) // 30))) for i in range(25)]
    rows += [(20_000, None), (20_001, " "), (20_002, "two words"), (20_003, "Two  WORDS"), (20_004, "two other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_groups(rows)
    monkeypatch.setattr(similar, "HOT", 2)  # most tokens count as frequent ones
    assert {r.doc_id: r.component_id for r in similar.similar_groups(docs).collect()} == want
    assert similar.similar_groups(docs.limit(0)).count() == 0


def test_rows_of_one_id(spark):
    words = [f"w{i}" for i in range(40)]
    text = " ".join(words)
    rows = [(1, text, 1), (1, text, 1), (2, "other words here", 2), (2, text + " end", 3), (None, text, 4), (None, "alone without an id", 5), (3, None, 6), (4, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node long")
    assert sorted((r.doc_id or 0, r.node) for r in similar.one_of_each(docs).collect()) == [(0, 5), (1, 1), (2, 2), (3, 6)]
    assert similar.one_of_each(docs).columns == docs.columns


def test_shared_postings():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(5)
    rows = sorted((rng.randrange(60), -1, rng.randrange(9), 5, 1) for _ in range(120)) + [(70, 0, 3, 5, 1), (71, 2, 4, 5, 1)]
    names = ["token", "salt", "node", "n", "after"]
    kinds = [np.int64, np.int32, np.int64, np.int32, np.int32]
    want = sorted({(t, n) for t, s, n, *_ in rows if s >= 0 or len({x[2] for x in rows if x[0] == t}) > 1})
    for size in (1, 2, 3, 7, 200):
        batches = [pa.RecordBatch.from_arrays([pa.array(np.array(c, k)) for c, k in zip(zip(*rows[i : i + size], strict=True), kinds, strict=True)], names) for i in range(0, len(rows), size)]
        got = [(t, n) for b in similar._shared(iter(batches)) for t, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        assert sorted(got) == want and len(got) == len(want)


def test_near_copies_below_the_threshold_make_no_pairs():
    """A large group of texts that share a shingle, and most others, but are not similar: a pair of each was made before."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 64, 60, np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[:42], rng.integers(0, 1 << 64, 18, np.uint64)])) for _ in range(200)]
    sets += [np.append(s[1:], np.uint64(k)) for k, s in enumerate(sets[:20])]  # these differ from the first ones in one shingle
    n = len(sets)
    columns = [np.full(n, 7, np.int64), np.arange(n), np.arange(n), np.array([len(s) for s in sets], np.int32), np.full(n, 59, np.int32)]
    batch = pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([similar._sketch(s) for s in sets], pa.binary())], ["token", "component", "node", "n", "after", "sketch"])
    got = {(int(a), int(b)) for out in similar._across(4, 5)(iter([batch])) for a, b in zip(*(c.to_pylist() for c in out.columns), strict=True)}
    alike = {(i, j) for i in range(n) for j in range(i + 1, n) if 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j]))}
    assert alike <= got and len(alike) == 20 and len(got) < 200


def test_similar_groups_are_joined_without_all_their_pairs(spark, monkeypatch):
    """What the pivots leave apart is joined by the nearest texts first; pairs grow with the texts, not with their square."""
    monkeypatch.setattr(similar, "ROUNDS", 0)
    made, verified = [], similar._verified

    def counted(pairs, *more):
        made.append(pairs.count())
        return verified(pairs, *more)

    monkeypatch.setattr(similar, "_verified", counted)
    rng = random.Random(7)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, edited(rng, words, 1)) for i in range(80)] + [(100 + i, edited(rng, words, 4)) for i in range(10)]
    groups = {r.doc_id: r.component_id for r in similar.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert groups == brute_groups(rows)
    assert sum(made) <= (similar.NEAREST * similar.JOINING + 1) * len(rows)
