"""The training-data operators against brute force, and their defined results on odd input."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("lumenrank.llm.common")
from lumenrank.llm import common, covertree, licenses, mixing, scan, sharding, shingles, simhash, suffixdedup, tiling, tokens, toxicity  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, feature string, h long"
BASE = " ".join(f"word{i}" for i in range(60))
ODD = [
    (1, None, "en", None, 0, "x", 1),
    (2, "", None, "a", 0, "x", 1),
    (3, BASE, "en", "a", 0, None, None),
    (4, BASE, "en", "a", 0, "x", 1),
    (4, BASE, "en", "a", 0, "x", 1),
    (5, BASE + " tail", "de", "b", 0, "x", 1),
    (6, "É ñ <|endoftext|> \n\n  spaced   out \x1c Released under the MIT License. ", "de", "b", 0, "x", 1),
    (7, "long " * 40_000, "de", "b", 0, "x", 1),
    (None, "no id at all", "de", "", 0, "x", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def parts(edges, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == parts([e for e in edges if e[0] != e[1]], nodes)
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 ---------------------------------------------------------------------------------------------------------------


def brute_segments(scores):
    """Maximal-scoring segments by their definition: split at the best segment, again on both sides."""
    best = max(((sum(scores[i : j + 1]), i - j, -i, i, j) for i in range(len(scores)) for j in range(i, len(scores))), default=None)
    if best is None or best[0] <= 1e-12:
        return []
    i, j = best[3], best[4]
    left, right = brute_segments(scores[:i]), brute_segments(scores[j + 1 :])
    return left + [(i, j, best[0])] + [(a + j + 1, b + j + 1, s) for a, b, s in right]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(-9, 9), max_size=14))
def test_segments(values):
    found = toxicity.maximal_segments(list(range(len(values))), [v + 0.5 for v in values], 0.5)
    assert sorted(round(s, 6) for _, _, s in found) == sorted(round(s, 6) for _, _, s in brute_segments([float(v) for v in values]))


def test_toxicity(spark, odd, none):
    bad = ["vile", "rotten", "loathsome"]
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(600):
        words = [f"w{k}" for k in rng.integers(0, 300, 80)]
        toxic = i % 5 == 0
        if toxic:
            for k in rng.integers(0, 80, 4):
                words[k] = bad[k % 3] + ("ly" if k % 2 else "")
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(d, lab).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    held = [i for i in got if got[i].held_out]
    right = sum(got[i].predicted == labels[i][1] for i in held) / len(held)
    assert right > 0.97
    assert toxicity.without_toxic(d, lab).count() == sum(not r.predicted for r in got.values())
    # Each row is judged by its own text: rows that share an id, or have none, stay or go by themselves.
    pair = spark.createDataFrame([(1, rows[0][1], 7), (1, rows[1][1], 8), (None, rows[5][1], 9), (None, rows[6][1], 10)], "doc_id long, text string, h long")
    assert {r.h for r in toxicity.without_toxic(pair, lab).unionByName(pair.limit(0)).collect()} <= {7, 8, 9, 10}
    model = toxicity.train(d, lab)
    assert len(toxicity.score_documents(odd, model).collect()) == len(ODD)
    assert toxicity.score_documents(none, model).count() == 0
    empty = lab.limit(0)
    assert {r.score for r in toxicity.toxicity(odd, empty).collect()} == {0.5}


@pytest.mark.parametrize("share", [0.05, 0.5, 0.9])
def test_toxicity_at_any_share(spark, share):
    rng = np.random.default_rng(int(share * 100))
    rows, labels = [], []
    for i in range(1500):
        words = [f"w{k}" for k in rng.integers(0, 200, 40)]
        toxic = i % 20 < 20 * share
        if toxic:
            for k in rng.integers(0, 40, 4):
                words[k] = ["vile", "rotten", "loathsome"][k % 3]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(d, lab)
    got = {r.doc_id: r.score for r in toxicity.score_documents(d, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    bad, good = [got[i] for i in held if labels[i][1]], [got[i] for i in held if not labels[i][1]]
    assert np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good]) > 0.97
    assert sum((got[i] >= toxicity.THRESHOLD) == labels[i][1] for i in held) / len(held) > 0.95
    # Whole documents against the definition: every word's most telling feature, maximal segments by splitting.
    for i in list(got)[:12]:
        values = []
        for w in rows[i][1].split():
            known = [model.scores[f] for f in ["=" + w, *(w[:k] for k in range(4, 9) if k <= len(w))] if f in model.scores]
            values.append(max(known)[1] if known else 0.0)
        found = [(0, 0, s) for _, _, s in brute_segments([v - toxicity.DRIFT for v in values])]
        assert abs(toxicity.score_of(model, toxicity.evidence(len(values), found, model.lam, model.k)) - got[i]) < 1e-6


# --- 2 ---------------------------------------------------------------------------------------------------------------


def brute_removed(rows, length):
    starts = {}
    for d, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            starts[s] = min(d, starts.get(s, d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if starts[b[p : p + length]] < d:
                gone[p : p + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]) if b else b""
        out.append((d, len(b), int(gone.sum()), int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_suffix_dedup(spark, odd, none, docs, monkeypatch):
    monkeypatch.setattr(suffixdedup, "CHUNK", 30_000)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    line = "a line that is in very many documents, of a good sixty bytes."
    rows += [(10_000 + i, f"{i * 7919 % 1000} {i} {line} {i * 31} {'ab' * (i % 40)}") for i in range(60)]
    rows += [(10_030, "another text of the same id, that holds " + line), (10_031, None)]
    got = sorted(tuple(r) for r in suffixdedup.removed(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == brute_removed(rows, 50)
    kept = suffixdedup.removed(spark.createDataFrame(rows, "doc_id long, text string"), whole=True).collect()
    assert sorted(tuple(r)[:5] for r in kept) == got
    for r in kept:
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed
        assert len(r.spans) == r.n_spans and sum(s.end - s.first for s in r.spans) == r.n_removed
    few = odd.where("doc_id is not null")
    want = brute_removed([(r[0], r[1]) for r in ODD if r[0] is not None and r[0] != 7], 50)
    assert sorted(tuple(r) for r in suffixdedup.removed(few.where("doc_id <> 7")).collect()) == want
    assert suffixdedup.removed(none).count() == 0
    assert len(suffixdedup.removed(few).collect()) == len(ODD) - 1


# --- 3 ---------------------------------------------------------------------------------------------------------------


def test_cover_tree(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 16))
    v = np.concatenate([centres[rng.integers(0, 12, 300)] + 0.25 * rng.standard_normal((300, 16)), rng.standard_normal((200, 16))]).astype(np.float32)
    v[7] = v[3]
    rows = [(i, [float(x) for x in v[i]]) for i in range(len(v))]
    odd = [(600, None), (601, [0.0] * 16), (602, [float("nan")] * 16), (603, [1.0, None]), (604, [1.0, 2.0]), (605, [2.0, 4.0]), (606, [float("inf")] * 16)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("feature", F.lit(1))
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    root = parts([(int(i), int(j)) for i, j in zip(*np.nonzero(near), strict=True)] + [(604, 605)], [*range(len(v)), *range(600, 607)])
    lost = covertree.near_duplicates(spark.createDataFrame([(None, [1.0, 0.0]), (5, [1.0, 0.01]), (None, [0.0, 1.0]), (9, [3e300, -3e300]), (10, [2e-300, -2e-300])], "vec_id long, embedding array<double>"))
    assert sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in lost.collect()), key=str) == [(0, 0, None, True), (0, 1, 5, False), (10, 1, 9, False), (5, 1, 5, True), (9, 1, 9, True)]
    for tile in (4096, 64):
        got = {r.vec_id: r for r in covertree.near_duplicates(df, tile=tile).collect()}
        assert all(got[i].n_links == int(near[i].sum()) for i in range(len(v)))
        assert {i: r.component_id for i, r in got.items()} == root
        assert got[604].n_links == 1 and got[601].n_links == 0 and all(r.kept == (i == root[i]) for i, r in got.items())
    assert covertree.near_duplicates(df.limit(0)).count() == 0


# --- 4 ---------------------------------------------------------------------------------------------------------------


def test_licenses(odd, none, docs):
    import re

    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(up))
    templates = [(label, set(split(t))) for label, t in licenses.TEMPLATES]
    both = "Some parts are Licensed under CC BY 4.0 and others Licensed under CC BY-SA 4.0 here."
    more = docs.sparkSession.createDataFrame([(901, both), (902, both[42:]), (903, "x " * 500 + " ".join(t for _, t in licenses.TEMPLATES))], "doc_id long, text string")
    many = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(more)
    labels = {r.doc_id: r.labels for r in licenses.scan_licenses(more).collect()}
    assert labels[901] == "cc-by,cc-by-sa" and labels[902] == "cc-by-sa" and "zlib" in labels[903] and "isc" in labels[903]
    got = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in licenses.scan_licenses(many).collect()}
    want = set()
    for r in many.collect():
        w, places, base, score = split(r.text), [], set(), 0.0
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    places.append(k)
                    base.add(label)
                    score = 1.0
        labels = set(base)
        for k in range(0, max(1, len(w)), licenses.BLOCK // 2):
            words, block = w[k : k + licenses.BLOCK], set(w[k : k + licenses.BLOCK])
            found = [(label, t, len(block & t) / len(t)) for label, t in templates if len(block & t) / len(t) >= licenses.THRESHOLD - 1e-9]
            for label, t, share in found:
                if not any(t < u for _, u, _ in found) or min(words.count(x) for x in t & block) > sum(t < u for _, u, _ in found):
                    labels.add(label)
                    score = max(score, share)
        want.add((r.doc_id, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 9)))
    assert got == want
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "labels", "score", "n_blocks", "first_block"]
    parted = lambda limit: sorted(map(str, licenses.scan_licenses(more, limit=limit).select(*columns).collect()))
    assert parted(1 << 20) == parted(1500) == parted(2500)
    assert licenses.scan_licenses(none).count() == 0


# --- 5 ---------------------------------------------------------------------------------------------------------------


def brute_tiles(a, b, shortest):
    """Greedy string tiling by looking at every pair of places."""
    free_a, free_b, tiles = [True] * len(a), [True] * len(b), 0
    while True:
        best = 0
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and free_a[i + n] and free_b[j + n] and a[i + n] == b[j + n]:
                    n += 1
                if n > best:
                    best, at = n, (i, j)
        if best < shortest:
            return tiles
        for k in range(best):
            free_a[at[0] + k] = free_b[at[1] + k] = False
        tiles += best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=16), st.lists(st.integers(0, 3), max_size=16))
def test_tiles(a, b):
    codes = np.array([11, 222, 3333, 44444], dtype=np.uint64)
    tiles = tiling.greedy_tiles(codes[a] if a else np.zeros(0, np.uint64), codes[b] if b else np.zeros(0, np.uint64), 3)
    used = [k for i, _, n in tiles for k in range(i, i + n)]
    assert len(used) == len(set(used)) and all(a[i : i + n] == b[j : j + n] for i, j, n in tiles)
    lengths = [n for _, _, n in tiles]
    assert lengths == sorted(lengths, reverse=True)
    if len(set(a)) == len(a) and len(set(b)) == len(b):
        assert sum(lengths) == brute_tiles(a, b, 3)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=30), st.lists(st.integers(0, 5), max_size=40))
def test_greedy_tiles(a, b):
    """Repeats included: of the longest matches the leftmost in the item, then in the text."""
    codes = np.array([11, 222, 3333, 44444, 555555, 6666666], dtype=np.uint64)
    tiles = tiling.greedy_tiles(codes[a] if a else np.zeros(0, np.uint64), codes[b] if b else np.zeros(0, np.uint64), 3)
    assert sum(n for _, _, n in tiles) == brute_tiles(a, b, 3)


def test_decontamination_by_brute_force(spark, docs):
    import re

    rng = np.random.default_rng(8)
    split = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    items = [(1, " ".join(f"w{k}" for k in rng.integers(0, 6, 24))), (2, " ".join(f"w{k}" for k in rng.integers(0, 40, 30))), (None, "one two three four five six seven"), (9007199254740993, "é b c d e f g h")]
    rows = [(100 + i, " ".join(f"w{k}" for k in rng.integers(0, 6 if i % 2 else 40, 60))) for i in range(40)]
    for i in range(30):  # passages of items, moved and broken
        w = split(items[i % 4][1])
        at = int(rng.integers(1, len(w)))
        rows.append((None if i % 7 == 0 else 9007199254740993 - i, " ".join([*w[at:], "x", *w[: int(rng.integers(0, len(w)))], "y", *w[:at]])))
    rows += [(5, None), (6, ""), (7, "filler " * 3000 + items[2][1])]
    want = []
    for d, t in rows:
        for i, item in items:
            a, b = split(item), split(t)
            n = brute_tiles(a, b, 5) if len(a) >= 5 and set(zip(*(a[k:] for k in range(5)), strict=False)) & set(zip(*(b[k:] for k in range(5)), strict=False)) else 0
            if n >= 0.5 * len(a):
                want.append((d, i, len(a), n))
    d, b = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r)[:4] for r in tiling.contaminated(d, b).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(x[0] is None for x in want) and any(x[1] is None for x in want)
    bad = {(x[0]) for x in want}
    assert sorted((r.doc_id for r in tiling.decontaminated(d, b).collect()), key=str) == sorted((x[0] for x in rows if x[0] not in bad), key=str) or None in bad


@pytest.mark.parametrize("limit", [40, 200, 5000])
def test_pieces(limit):
    rng = np.random.default_rng(limit)
    text = " ".join("w" * int(k) for k in rng.integers(1, 90, 300))
    data, offsets = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])
    whole = scan.Words(data, offsets)
    seen = {}
    for base, _, words in scan.pieces(data, limit, 4):
        at, h = words.grams(5)
        for k, x in zip((at + base).tolist(), h.tolist(), strict=True):
            assert k not in seen
            seen[k] = x
    assert seen == dict(zip(*(x.tolist() for x in whole.grams(5)), strict=True))


def test_decontamination(spark, odd, none):
    item = " ".join(f"q{i}" for i in range(30))
    w = item.split()
    rows = [(1, f"before {item.upper()} after"), (2, " ".join(w[15:] + ["x"] + w[:15])), (3, " ".join(w[:10])), (4, "nothing here"), (5, None)]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(9, item), (10, None), (11, "too short")], "item_id long, text string")
    got = {r.doc_id: (r.item_id, r.tile_words, r.tiles) for r in tiling.contaminated(d, b).collect()}
    assert got == {1: (9, 30, 1), 2: (9, 30, 2)}
    assert {r.doc_id for r in tiling.contaminated(d, b, block_seeds=1).collect()} == {1, 2}
    assert {r.doc_id for r in tiling.decontaminated(d, b).collect()} == {3, 4, 5}
    same = spark.createDataFrame([(1, f"before {item} after"), (1, "a clean text of the same id"), (None, item), (None, "clean, without an id")], "doc_id long, text string")
    assert sorted(r.text for r in tiling.decontaminated(same, b).collect()) == ["a clean text of the same id", "clean, without an id"]
    assert tiling.decontaminated(odd, b).columns == odd.columns and tiling.decontaminated(odd, b.limit(0)).count() == len(ODD)
    assert tiling.contaminated(none, b).count() == 0 and tiling.contaminated(d, b.limit(0)).count() == 0
    assert tiling.contaminated(odd, b).count() == 0


# --- 6, 7 ------------------------------------------------------------------------------------------------------------


def test_targets(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 5), ("z", 0)], "source string, size long")
    got = {r.source: (r.source_size, r.target) for r in mixing.targets(sizes).collect()}
    left, active = 1515.0, {"a": 1, "b": 2, "c": 3, "z": 1, None: 2}
    want = {}
    while True:
        share = {s: left * w / sum(active.values()) for s, w in active.items()}
        over = [s for s in share if share[s] > 3 * got[s][0]]
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 3.0 * got[s][0]
            left -= want[s]
            del active[s]
    assert {s: round(t, 6) for s, (_, t) in got.items()} == {s: round(t, 6) for s, t in want.items()}


def test_mixing(spark, docs, odd, none):
    a, b = mixing.mix(docs).toPandas(), mixing.mix(docs.repartition(7)).toPandas()
    key = ["doc_id", "n"]
    assert a.sort_values(key).taken.tolist() == b.sort_values(key).taken.tolist()
    per = a.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    largest = a.groupby("source")["size"].max()
    assert (np.abs(per.taken - per.target) <= np.maximum(largest, 1)).all() and (a.taken <= 3 * a["size"]).all()
    assert (np.abs(per.taken - per.target) / per.target).median() < 0.05
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == int(a.copies.sum())
    o = mixing.mix(odd).toPandas()
    assert len(o) == len(ODD) and mixing.mixed_documents(odd).count() == int(o.copies.sum())
    assert mixing.mixed_documents(odd).columns == odd.columns
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_sharding(docs, odd, none):
    s = sharding.sharded_documents(docs, 40).toPandas()
    n = s.groupby("shard").size()
    assert n.max() - n.min() <= 1 and len(s) == docs.count()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in s.groupby("shard"))
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(zlib.crc32(text[d].encode()) == c and z == len(text[d].encode()) + 16 for d, c, z in zip(s.doc_id, s.text_crc32, s["size"], strict=True))
    wide = sharding.shard(docs, 4).toPandas()
    m = wide.groupby(["source", "shard"]).size().unstack(fill_value=0)
    assert (m.max(axis=1) - m.min(axis=1)).max() <= 1
    many = sharding.shard(docs.limit(0).sparkSession.range(1600).selectExpr("id as doc_id", "string(id) as text", "if(id < 800, 'a', string(id % 400)) as source"), 40).toPandas()
    spread = many[many.source != "a"].groupby("shard").size()
    assert len(spread) == 40 and spread.min() > 5 and spread.max() < 40
    spark = docs.sparkSession
    for total in (10**9, 10**11):
        at = [0, 1, total - 1, total // 3, 24999990, 24999999, 25000000, *(s * total // 40 + d for s in range(1, 40) for d in (-1, 0, 1))]
        rows = spark.createDataFrame([(p,) for p in at], "pos long").withColumns(sharding.cut(F.col("pos"), total, 40)).collect()
        assert all(r.shard == r.pos * 40 // total and r.slot == r.pos - -(-r.shard * total // 40) and r.slot >= 0 for r in rows)
    o = sharding.sharded_documents(odd, 40).toPandas()
    assert len(o) == len(ODD) and set(o["size"]) >= {16}
    assert sharding.sharded_documents(none).count() == 0


# --- 8, 10 -----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def plain():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "Word", " ", " ", "  ", "\n", "\n\n", "\t", "1", "'s", "é", "😀", "...", "\x1c", "\x85", "　", "<|endoftext|>", "Ġ", '"', ","]), max_size=12))
def test_encoder(plain, pieces):
    text = "".join(pieces)
    e = tokens.Encoder.of(None)
    assert np.frombuffer(e.encode(text), dtype=e.kind).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_token_files(docs, odd, none, plain):
    for d in (docs, odd):
        manifest, folder = tokens.write_tokens(d)
        got = tokens.read_tokens(manifest, folder, with_ids=True).orderBy("start").collect()
        rows = sorted(((r.doc_id, r.text or "") for r in d.collect()), key=lambda r: (r[0] is None, r[0] or 0))
        at = 0
        assert [r.doc_id for r in got] == [r[0] for r in rows]
        for r in got:
            assert r.start == at and r.n_tokens == len(r.ids) and r.ids[-1] == 2 and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
            at += r.n_tokens
        want = sorted(((i, tuple([*plain.encode(t, add_special_tokens=False).ids, 2])) for i, t in rows), key=str)
        assert sorted(((r.doc_id, tuple(r.ids)) for r in got), key=str) == want
    some = tokens.read_tokens(manifest, folder, wanted=[3, 6]).collect()
    assert {r.doc_id for r in some} == {3, 6}
    name = manifest.first()["file"]
    path = folder.replace("file://", "") + "/" + name
    raw = bytearray(open(path, "rb").read())
    raw[12] ^= 255
    open(path, "wb").write(raw)
    with pytest.raises(Exception):  # noqa: B017
        f = tokens.TokenFile(f"{folder}/{name}")
        f.read_many(np.arange(len(f.doc_ids)))
    manifest, folder = tokens.write_tokens(none)
    assert tokens.read_tokens(manifest, folder).count() == 0


def test_token_counts(docs, odd, none, plain):
    lengths = sorted(len(plain.encode(r.text, add_special_tokens=False).ids) for r in docs.collect())
    h = tokens.length_histogram(tokens.token_lengths(docs))
    rows = {r.n_tokens: r for r in h.collect()}
    assert set(rows) == set(lengths)
    for n, r in rows.items():
        assert r.n_docs == lengths.count(n) and r.docs_longer == sum(x > n for x in lengths) and r.tokens_longer == sum(x for x in lengths if x > n)
        assert r.truncated_total == sum(min(x, n) for x in lengths) and abs(r.quantile - sum(x <= n for x in lengths) / len(lengths)) < 1e-12
    for r in tokens.at_limits(h, [1, 100, 1000, 10**6]).collect():
        assert r.truncated_total == sum(min(x, r.context) for x in lengths) and r.docs_cut == sum(x > r.context for x in lengths)
    assert tokens.length_histogram(tokens.token_lengths(none)).count() == 0
    assert tokens.length_histogram(tokens.token_lengths(odd)).agg(F.sum("n_docs")).first()[0] == len(ODD)


# --- 9 ---------------------------------------------------------------------------------------------------------------


def slow_fingerprint(text):
    import xxhash

    w = text.encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark, docs, odd, none):
    for r in simhash.fingerprints(docs).join(docs, "doc_id").limit(60).collect():
        assert r.fp & (1 << 64) - 1 == slow_fingerprint(r.text)
    rows = {r.doc_id: r for r in simhash.near_duplicates(odd).collect()}
    assert rows[1].fp == 0 and rows[2].component_id == 1 and rows[4].component_id == 3
    assert simhash.near_duplicates(none).count() == 0
    assert spark.range(1).select(simhash.hex_digits(F.lit(-2))).first()[0] == "fffffffffffffffe"
    assert simhash.one_of_each(odd).columns == odd.columns
    assert sorted(r.doc_id or 0 for r in simhash.one_of_each(odd).collect()) == [0, 1, 3, 6, 7]  # 5 has a word more than 3
    same = spark.createDataFrame([(1, "p q r s"), (1, "p q r s"), (2, "other words here"), (2, "p q r s"), (None, "p q r s"), (None, "alone without an id")], "doc_id long, text string")
    assert sorted(tuple(r) for r in simhash.one_of_each(same).fillna(0).collect()) == [(0, "alone without an id"), (1, "p q r s"), (2, "other words here")]
    joined = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fp = {i: r.fp & (1 << 64) - 1 for i, r in joined.items()}
    pairs = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 3]
    assert {i: r.component_id for i, r in joined.items()} == parts(pairs, fp)


@pytest.mark.parametrize(("tile", "gather"), [(8192, 1 << 16), (16, 1 << 16), (64, 100)])
def test_links(spark, monkeypatch, tile, gather):
    monkeypatch.setattr(simhash, "GATHER", gather)
    rng = np.random.default_rng(4)
    codes = list(rng.integers(0, 1 << 63, 120, dtype=np.uint64))
    for c in codes[:40]:
        for _ in range(8):
            codes.append(c ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 6)), replace=False))))
    codes = np.unique(np.array(codes, dtype=np.uint64))
    df = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    got = {r.node: r.component for r in common.components(simhash.links(df, tile=tile)).collect()}
    pairs = [(int(a), int(b)) for k, a in enumerate(codes.view(np.int64)) for b, c in zip(codes.view(np.int64)[k + 1 :], codes[k + 1 :], strict=True) if bin(int(c ^ codes[k])).count("1") <= 3]
    assert got == parts(pairs, {x for p in pairs for x in p})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abZ é\x0b\n\t\x1c", max_size=60), max_size=5), st.integers(1, 5), st.sampled_from([7, 40, 1 << 18]))
def test_shingles(texts, words, limit):
    import xxhash

    raw = [(t * 9).encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)])
    got = []
    for _, many, h in shingles.of_batch(np.frombuffer(b"".join(raw), np.uint8), offsets, words, 42, limit):
        got += np.split(h, np.cumsum(many)[:-1])
    for r, g in zip(raw, got, strict=True):
        w = r.lower().split()
        want = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([b" ".join(w)] if w else [])
        assert g.tolist() == [xxhash.xxh64_intdigest(x, 42) for x in want]


def test_gray_rank():
    n = np.arange(200, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def test_scan_words():
    w = scan.of_texts(["Ab, cd-é", "", "ab 9"])
    assert w.row.tolist() == [0, 0, 0, 2, 2] and w.hash[0] == w.hash[3] and len(set(w.hash.tolist())) == 4
    assert scan.HashSet(w.hash[:1]).find(w.hash)[0].tolist() == [0, 3]
