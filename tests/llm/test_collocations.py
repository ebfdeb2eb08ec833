"""Phrases of each language against plain counting."""

import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("lumenrank.llm.common")
from lumenrank.llm import collocations as C  # noqa: E402


def plain(rows, least, top=2000, covered=80):
    """rows: (lang, text)."""
    found = []
    langs = {}
    for lang, text in rows:
        langs.setdefault(lang or "und", []).append(text or "")
    for lang, texts in langs.items():
        f, n = Counter(), 0
        for text in texts:
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            for piece in re.split("[.,;:!?\n-\r]", low):
                words = re.findall("[^ \t]+", piece)
                n += len(words)
                for k in (1, 2, 3, 4):
                    f.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + k] for p, a in candidates.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= covered * f[p[i : i + k]]}
        scored = []
        for p, a in candidates.items():
            if p not in gone:
                score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            found.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(found)


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


def sample():
    rng = np.random.default_rng(13)
    words = ["The", "cat", "sat", "on", "é", "Ünder", "a b", "x" * 300, *(f"w{i}" for i in range(30))]
    rows = []
    for i in range(160):
        picked = [words[min(len(words) - 1, int(x))] for x in rng.exponential(5, rng.integers(0, 60))]
        gaps = rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ;"], len(picked))
        rows.append((["en", "de", None][i % 3], "".join(w + g for w, g in zip(picked, gaps, strict=True))))
    return [*rows, *rows[:9], ("en", None), ("en", ""), (None, "alone"), ("fr", "rare words only")]


@pytest.mark.parametrize("numbered", [True, False])
@pytest.mark.parametrize("least, top, covered", [(8, 2000, 80), (3, 10, 80), (5, 2000, 0), (5, 2000, 101)])
def test_plain_counts(spark, monkeypatch, least, top, covered, numbered):
    rows = sample()
    if not numbered:
        monkeypatch.setattr(C, "NUMBERED", 3)
    docs = spark.createDataFrame([(x, t, 5, "k") for x, t in rows], "lang string, text string, f long, key string").repartition(5)
    assert rows_of(C.collocations(docs, least, top=top, covered=covered)) == plain(rows, least, top, covered)


def test_chunks_and_few_bits(spark, monkeypatch):
    """Small chunks with and without ends of pieces, and a table of bits."""
    text = b"one two three four five, six seven " * 9 + b"no end of a piece in here for a long while " * 30
    codes = C.Codes(0)
    want = [tuple(x) for x in codes.words(np.frombuffer(text, np.uint8))[3:4]][0]
    for limit in (40, 64, 1000):
        got = [c for found, shared in C.chunks(codes, np.frombuffer(text, np.uint8), limit) for c in found[3][shared:]]
        assert got == list(want)
    monkeypatch.setattr(C, "FEWEST_BITS", 64)
    monkeypatch.setattr(C, "PER_WORD", 1)
    table = C._table(spark.createDataFrame([("en", bytes(7) + bytes([i])) for i in range(3)], "lang string, key binary"), 1)
    assert len(table) == 1
    rows, every = [*sample()[:60], ("en", text.decode())], np.full(1, (1 << 64) - 1, np.uint64)
    for n in (2, 3, 4):
        cut, whole = C.GramWindow("en", n, every), C.GramWindow("en", n, every)
        for _, t in rows:
            data = np.frombuffer((t or "").encode(), np.uint8)
            whole.add(codes.words(data), 0)
            for found, shared in C.chunks(codes, data, 64):
                cut.add(found, shared)
        assert sorted(cut.flush("en").to_pylist(), key=str) == sorted(whole.flush("en").to_pylist(), key=str)


def test_tables_that_let_all_pass(spark, monkeypatch):
    """Tables of a few bits, which hold nearly everything, change nothing."""
    monkeypatch.setattr(C, "FEWEST_BITS", 64)
    monkeypatch.setattr(C, "MOST_BITS", 64)
    monkeypatch.setattr(C, "NUMBERED", 3)
    rows = sample()
    docs = spark.createDataFrame([(x, t) for x, t in rows], "lang string, text string").repartition(3)
    assert rows_of(C.collocations(docs, 5)) == plain(rows, 5)


def test_words_that_share_a_code(spark):
    """They stay apart in a window, and the table of words finds them."""
    window, data = C.WordWindow(), np.frombuffer(b"aabbaabb", np.uint8)
    window._put(np.array([7, 7, 7, 9], np.uint64), np.ones(4, np.int64), np.array([0, 2, 4, 6]), np.full(4, 2), data)
    got = Counter()
    for r in window.flush("en").to_pylist():
        got[r["id"], r["word"]] += r["f"]
    assert got == {(7, b"aa"): 2, (7, b"bb"): 1, (9, b"bb"): 1}


def test_no_rows(spark):
    assert C.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_query(spark, small):
    from lumenrank.llm import queries

    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert rows_of(queries.op13_collocations(spark, small)) == plain([(r.lang, r.text) for r in docs.collect()], 30)
