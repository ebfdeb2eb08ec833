"""Texts cut at safe places against the library on whole texts; ids back to bytes."""

import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("lumenrank.llm.common")
pytest.importorskip("public_tokenizers")
from lumenrank.llm import rankbpe  # noqa: E402

SIGNS = ["a", "B", "é", "é", "日", "1", "٣", "'", "'s", "'re", "!", "...", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "​", "　", "🙂", "<|endoftext|>"]


def test_cut_texts(monkeypatch):
    encoder, rng = rankbpe.RankEncoder.of(), random.Random(12)
    monkeypatch.setattr(rankbpe, "PART", 40)
    monkeypatch.setattr(rankbpe, "RUN", 12)
    for _ in range(1500):
        text = "".join(rng.choice(SIGNS) * rng.choice([1, 1, 1, 2, 5, 20]) for _ in range(rng.randint(0, 60)))
        assert "".join(p for p, _ in rankbpe.parts(text)) == text
        ids = encoder.encode(text)
        assert ids.tolist() == encoder.library.encode_ordinary(text)
        assert encoder.decode(ids) == text.encode()
    for _ in range(200):
        piece = "".join(rng.choice(["a", "b", "er", "ch", " ", "é"]) for _ in range(rng.randint(1, 80))).encode()
        assert encoder.merged(piece) == encoder.library._encode_single_piece(piece)


def test_very_long_runs():
    encoder = rankbpe.RankEncoder.of()
    for text in (" " * 300_000 + "x", "a" * 200_000, "日本" * 50_000, "hello world " * 30_000, "abc123" * 30_000):
        assert encoder.decode(encoder.encode(text)) == text.encode()
    assert encoder.encode("hello world " * 30_000).tolist() == encoder.library.encode_ordinary("hello world " * 30_000)


def test_frames(spark):
    texts = [(1, None), (1, ""), (None, "no id"), (4, "tie"), (4, "tie"), (5, "It's 12 o'clock \n\n  now " * 4000)]
    docs = spark.createDataFrame([(*t, "x", 3) for t in texts], "doc_id long, text string, ids string, n_tokens int")
    got = sorted(((r.doc_id or 0, bytes(r.raw), r.n_tokens, bytes(r.ids)) for r in rankbpe.decode(rankbpe.encode(docs)).collect()), key=str)
    library = rankbpe.RankEncoder.of().library
    want = [(d or 0, (t or "").encode(), library.encode_ordinary(t or "")) for d, t in texts]
    assert got == sorted(((d, raw, len(ids), np.array(ids, "<u4").tobytes()) for d, raw, ids in want), key=str)
    assert rankbpe.encode(docs.limit(0)).count() == 0


def test_query(spark, small):
    from lumenrank.llm import queries

    rows = queries.op12_byte_bpe(spark, small).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    library = rankbpe.RankEncoder.of().library
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
