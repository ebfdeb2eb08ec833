"""Merges found in the cluster against the plain trainer."""

import random
from collections import Counter

import pytest

from lumenrank.operators import bpe


def plain(words, vocabulary):
    """The most frequent pair, the smallest of equals, counted anew for each merge."""
    tokens, merges = list(bpe.SPECIAL) + sorted({c for w in words for c in w}), []
    parts = {w: list(w) for w in words}
    while len(tokens) < vocabulary:
        pairs = Counter()
        for w, p in parts.items():
            for q in zip(p, p[1:], strict=False):
                pairs[q] += words[w]
        best = min(pairs.items(), key=lambda x: (-x[1], x[0]), default=(None, 0))
        if best[1] < bpe.LEAST_COUNT:
            break
        merges.append(best[0])
        parts = {w: bpe.merged(p, [best[0]]) for w, p in parts.items()}
        if "".join(best[0]) not in tokens:
            tokens.append("".join(best[0]))
    return tokens, merges


def test_chosen_merges_are_the_next_ones():
    rng = random.Random(4)
    for _ in range(40):
        words = {"".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))): rng.randint(1, 9) for _ in range(rng.randint(1, 50))}
        want, looked = plain(words, 60), rng.choice([1, 3, 5, 1000])
        tokens, merges, parts = list(bpe.SPECIAL) + sorted({c for w in words for c in w}), [], {w: list(w) for w in words}
        while len(tokens) < 60:
            pairs = Counter()
            for w, p in parts.items():
                for q in zip(p, p[1:], strict=False):
                    pairs[q] += words[w]
            top = sorted(((a, b, n) for (a, b), n in pairs.items() if n >= bpe.LEAST_COUNT), key=lambda x: (-x[2], x[0], x[1]))[:looked]
            if not top:
                break
            new = bpe.chosen(top, set(tokens), len(top) < looked)[: 60 - len(tokens)]
            merges += new
            tokens += [t for t in dict.fromkeys("".join(m) for m in new) if t not in tokens]
            parts = {w: bpe.merged(p, new) for w, p in parts.items()}
        assert (tokens, merges) == want


@pytest.mark.parametrize("rewritten", [2, 1000])
def test_rounds_in_the_cluster(spark, small, monkeypatch, rewritten):
    monkeypatch.setattr(bpe, "REWRITTEN", rewritten)
    texts = spark.createDataFrame([("the cat sat on the mat é 🙂🙂",), (None,), ("",), ("The cats of the rats that sat",), ("banana bandana",)], "text string")
    here, there = bpe.train(texts, 45), bpe.train(texts, 45, driver_words=0)
    assert len(here.merges) >= 8
    assert (there.tokens, there.merges) == (here.tokens, here.merges)


def test_rounds_over_all_documents(spark, small):
    texts = spark.read.parquet(f"{small}/documents.parquet").select("text")
    base = len(bpe.train(texts, 1).tokens)
    here, there = bpe.train(texts, base + 12), bpe.train(texts, base + 12, driver_words=0)
    assert len(here.merges) >= 12 and (there.tokens, there.merges) == (here.tokens, here.merges)
