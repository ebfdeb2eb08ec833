"""Queries over texts take all words of each, not a beginning."""

import functools

from pyspark.sql import functions as F

from lumenrank import catalog
from lumenrank.catalog import extras
from lumenrank.catalog.base import Tables
from lumenrank.functions import text as X
from lumenrank.operators import bpe


def test_bpe_counts_whole_documents(spark, small):
    got = {r.doc_id: r.n for r in catalog.queries()["bpe_token_counts"](spark, small).collect()}
    docs = Tables(spark, small).documents
    model = bpe.train(docs.select("text"), vocabulary=400)
    word = functools.cache(lambda w: len(model.word(w)))
    want = {r.doc_id: 2 + sum(word(w) for w in r.n.split(" ") if w) for r in docs.select("doc_id", X.bpe_normalize(F.col("text")).alias("n")).collect()}
    assert got == want and max(got.values()) > 512


def test_encoder_takes_all_words(spark, small):
    t = Tables(spark, small)
    got = {r.doc_id: len(r.ids) for r in extras._ids(t).collect()}
    want = {r.item_id: r.n for r in t.benchmark.select("item_id", F.size(X.words(F.col("text"))).alias("n")).collect()}
    assert got == want and max(got.values()) > 32
