"""Operator 1: toxic passages by maximum-scoring segments over token log-odds, calibrated by extreme-value theory.

Model: for each word, and each beginning of a word of 4 to 8 letters, the documents of either label that have it are
counted. A Dirichlet prior drawn from the background (both labels together) smooths the two rates; their log-odds are
the token's score if a likelihood-ratio test finds it telling. A word takes the score of its most telling feature.

Scan: scores less a drift per word make a random walk that falls in clean text; one linear pass (with a stack of
candidate segments) finds all maximal-scoring segments. A segment of score S in n words is expected
E = K n exp(-lambda S) times by chance, where lambda solves sum p(s) exp(lambda s) = 1 over the clean documents'
scores and K is their maximum-likelihood estimate. A document's evidence is the sum of -ln E over its segments with
E < 1 and the Gumbel tail of its best one; a logistic curve turns them into a probability.

The model is fitted on a bounded sample of labelled rows (TRAIN_ROWS, chosen by a hash); its tokens are all that pass
the test on that sample, so what is broadcast does not grow with the corpus. Scores use three-fold cross-fitting: the
curve is fitted to scores that a document got from models which had not seen it.

Defined results: a null or empty text has no tokens and gets the score of no evidence; rows that repeat a doc_id are
scored each, by their own text, and so are rows without one; labels that are null, or of no doc_id, are not used;
without labelled rows of both kinds every score is the prior 0.5; an empty table gives none; extra columns are ignored
by toxicity() and kept by without_toxic().
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, prepare, scratch

TRAIN_ROWS = 20_000
#: Strength of the Dirichlet prior, in documents.
PRIOR = 20.0
#: A token is telling from a likelihood ratio (2 ln) of TELLING, and more where many tokens are tested: 2 ln(tested) - 4.
TELLING = 14.0
#: The least log-odds that are used: weaker tokens tell languages and styles apart rather than toxicity.
LEAST = 2.0
#: What every word costs a segment.
DRIFT = 0.05
FOLDS = 3
THRESHOLD = 0.7
WORDS = re.compile(r"\w+")
PREFIXES = range(4, 9)
#: Words whose score a worker remembers.
REMEMBERED = 300_000


def features(word: str) -> list[str]:
    """The word itself, marked with =, and its beginnings."""
    return ["=" + word, *(word[:k] for k in PREFIXES if k <= len(word))]


def maximal_segments(places: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score) of a walk that falls by drift at every place and rises at some.

    places: ascending; scores: what is added at each. Linear time: each candidate is pushed and popped at most once,
    and a search for a lower left total goes from candidate to candidate along stored links.
    """
    stack: list[tuple[int, int, float, float, int]] = []  # first, last, total before, total after, link
    total, at = 0.0, 0
    for p, s in zip(places, scores, strict=True):
        total -= drift * (p - at)
        at = p + 1
        gain = s - drift
        before, total = total, total + gain
        if gain <= 0:
            continue
        first, left, right = p, before, total
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append((first, p, left, right, j))
                break
            first, left = stack[j][0], stack[j][2]
            link = stack[j][4]
            del stack[j:]
            j = link
    return [(a, b, r - le) for a, b, le, r, _ in stack]


@dataclass
class Model:
    """Scores of features (with how telling they are) and the calibration."""

    scores: dict[str, tuple[float, float]] = field(default_factory=dict)
    lam: float = 1.0
    k: float = 0.01
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)


class WordScores(dict):
    """Remembers each word's score."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) > REMEMBERED:
            self.clear()
        known = self.model.scores
        best = max((known[f] for f in features(word) if f in known), default=(0.0, 0.0))
        self[word] = best[1]
        return best[1]


def segments(text: str, scores: WordScores) -> tuple[int, list[tuple[int, int, float]]]:
    """Words of a text, and its maximal-scoring segments (first word, last word, score)."""
    words = WORDS.findall(text.lower())
    hits = [(i, s) for i, s in enumerate(map(scores.__getitem__, words)) if s]
    return len(words), maximal_segments([i for i, _ in hits], [s for _, s in hits], DRIFT)


def evidence(n: int, found: list[tuple[int, int, float]], lam: float, k: float) -> tuple[float, float]:
    """The two inputs of the curve: summed -ln E of significant segments (damped), and -ln of the best one's tail."""
    if not found or not n:
        return 0.0, 0.0
    space = math.log(max(k * n, 1e-12))
    total = sum(max(0.0, lam * s - space) for _, _, s in found)
    log_e = space - lam * max(s for _, _, s in found)
    tail = -math.log(-math.expm1(-math.exp(min(log_e, 50.0)))) if log_e > -30 else -log_e
    return math.log1p(total), min(tail, 60.0) / 10


def score_of(model: Model, x: tuple[float, float]) -> float:
    b, w1, w2 = model.weights
    return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, b + w1 * x[0] + w2 * x[1]))))


def labelled(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, text, toxic and fold of a hashed sample of about `rows` labelled documents that are not held out."""
    open_ = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    open_ = open_.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    total = open_.count()
    ring = 1 << 20
    share = ring if total <= rows else int(ring * rows / total)
    picked = open_.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(ring)) < share)
    picked = picked.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(FOLDS)).cast("int"))
    # Bounded by `rows` labels of 16 bytes, whatever the corpus: that side is broadcast.
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        keys = list(counts)
        cols = [pa.array([k[i] for k in keys]) for i in (0,)] + [pa.array([k[i] for k in keys], pa.int32()) for i in (1, 2)]
        out = pa.RecordBatch.from_arrays([*cols, pa.array([counts[k] for k in keys], pa.int64())], ["feature", "fold", "toxic", "n"])
        counts.clear()
        return out

    for b in batches:
        for text, toxic, fold in zip(*(b.column(c).to_pylist() for c in ("text", "toxic", "fold")), strict=True):
            found = set()
            for w in set(WORDS.findall(text.lower())):
                found.update(features(w))
            counts.update((f, fold, toxic) for f in found)
        if len(counts) > 200_000:
            yield flush()
    if counts:
        yield flush()


def _select(names: np.ndarray, y1: np.ndarray, y0: np.ndarray, n1: float, n0: float, telling: float) -> dict[str, tuple[float, float]]:
    """Feature -> (how telling, log-odds)."""
    if not n1 or not n0:
        return {}
    both = y1 + y0
    with np.errstate(divide="ignore", invalid="ignore"):
        term = lambda y, m: np.where(y > 0, y * np.log(np.maximum(y, 1e-9) / np.maximum(m, 1e-9)), 0.0)
        a, b = both * n1 / (n1 + n0), both * n0 / (n1 + n0)
        g = 2 * (term(y1, a) + term(y0, b) + term(n1 - y1, n1 - a) + term(n0 - y0, n0 - b))
        prior = PRIOR * both / (n1 + n0)
        odds = np.log((y1 + prior) / (n1 + PRIOR - y1 - prior)) - np.log((y0 + prior) / (n0 + PRIOR - y0 - prior))
    keep = (g >= telling) & (np.abs(odds) >= LEAST) & (both > 0) & ((odds < 0) | (y1 >= 3))
    return {f: (float(x), float(o)) for f, x, o in zip(names[keep], g[keep], odds[keep], strict=True)}


def _likely(y1, y0, n1: float, n0: float, telling: float):
    """Whether _select() can keep a feature, as a column: half of what it asks, as its folds see other counts."""
    both, n = y1 + y0, n1 + n0
    prior = both * (PRIOR / n)
    odds = F.log((y1 + prior) / (n1 + PRIOR - y1 - prior)) - F.log((y0 + prior) / (n0 + PRIOR - y0 - prior))
    part = lambda y, m: F.when(y > 0, y * F.log(y / m)).otherwise(0.0)
    a, b = both * (n1 / n), both * (n0 / n)
    ratio = 2 * (part(y1, a) + part(y0, b) + part(n1 - y1, n1 - a) + part(n0 - y0, n0 - b))
    return (ratio >= telling / 2) & (F.abs(odds) >= LEAST / 2)


def _lambda(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum p(s) exp(lambda s) = 1, for scores of negative mean with the given counts."""
    total = weights.sum()
    if total <= 0 or values.max() <= 0 or (values * weights).sum() >= 0:
        return 1.0
    f = lambda x: float((np.exp(np.clip(x * values, -700, 700)) * weights).sum() / total) - 1
    lo, hi = 1e-6, 1.0
    while f(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return min(max(lo, 0.2), 5.0)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[float, float, float]:
    """Weights of a logistic curve (bias, and two that are not negative): Newton steps, each halved until it helps."""
    design = np.column_stack([np.ones(len(x)), x])
    penalty = np.array([1e-6, ridge, ridge])

    def loss(w: np.ndarray) -> float:
        z = design @ w
        return float(np.sum(np.logaddexp(0, z) - y * z) + 0.5 * np.sum(penalty * w * w))

    w = np.array([math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), 0.0, 0.0])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -500, 500)))
        grad = design.T @ (p - y) + penalty * w
        hess = (design * (p * (1 - p))[:, None]).T @ design + np.diag(penalty)
        step, size, now = np.linalg.solve(hess, grad), 1.0, loss(w)
        while size > 1e-6:
            nxt = w - size * step
            nxt[1:] = np.maximum(nxt[1:], 0)
            if loss(nxt) < now - 1e-10:
                break
            size /= 2
        else:
            break
        w = nxt
    return float(w[0]), float(w[1]), float(w[2])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """The model from a bounded sample; what comes to the driver is the telling features and two numbers for each document of the sample."""
    spark = prepare(docs.sparkSession)
    with scratch(spark):
        return _train(spark, materialise(labelled(docs, labels, rows), "sample"))


def _train(spark, sample: DataFrame) -> Model:
    sizes = {(r[0], r[1]): r[2] for r in sample.groupBy("fold", "toxic").count().collect()}
    n = np.array([[sizes.get((f, t), 0) for t in (0, 1)] for f in range(FOLDS)], dtype=float)
    if not n[:, 0].sum() or not n[:, 1].sum():
        return Model()
    sums = [F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == t), F.col("n")).otherwise(0)).alias(f"y{f}{t}") for f in range(FOLDS) for t in (0, 1)]
    y1, y0 = (sum(F.col(f"y{f}{t}") for f in range(FOLDS)) for t in (1, 0))
    counts = sample.mapInArrow(_count, "feature string, fold int, toxic int, n long").groupBy("feature").agg(*sums)
    counts = materialise(counts.where(y1 + y0 >= 3), "counts")
    telling = max(TELLING, 2 * math.log(max(1, counts.count())) - 4)
    # Only what can be telling comes to the driver; the sample bounds how much that is.
    table = counts.where(_likely(y1, y0, float(n[:, 1].sum()), float(n[:, 0].sum()), telling)).orderBy("feature").toPandas()
    names = table["feature"].to_numpy()
    y = np.stack([[table[f"y{f}{t}"].to_numpy(dtype=float) for t in (0, 1)] for f in range(FOLDS)])
    fit = lambda f: _select(names, *(y.sum(0)[t] - (y[f][t] if f is not None else 0) for t in (1, 0)), *(n.sum(0)[t] - (n[f][t] if f is not None else 0) for t in (1, 0)), telling)
    fold_models = [Model(fit(f)) for f in range(FOLDS)]
    shared = spark.sparkContext.broadcast(fold_models)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = [WordScores(m) for m in shared.value]
        for b in batches:
            out = []
            for text, toxic, f in zip(*(b.column(c).to_pylist() for c in ("text", "toxic", "fold")), strict=True):
                words, found = segments(text, scores[f])
                hits = [scores[f][w] for w in WORDS.findall(text.lower()) if scores[f][w]] if not toxic else []
                out.append((toxic, words, [s for _, _, s in found], hits))
            cols = zip(*out, strict=True)
            kinds = [pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["toxic", "words", "found", "hits"])

    got = materialise(sample.mapInArrow(scan, "toxic int, words long, found array<double>, hits array<double>"), "scanned")
    clean = got.where("toxic = 0")
    model = Model(fit(None))
    # The distribution of the clean documents' scores: what was hit, and the drift alone for all other words. There
    # are no more different scores than features.
    hits = clean.select(F.explode("hits").alias("h")).groupBy(F.round(F.col("h") - DRIFT, 3).alias("h")).count().orderBy("h").toPandas()
    silent = max(0, int(clean.agg(F.sum("words")).first()[0] or 0) - int(hits["count"].sum()))
    values, weights = hits["h"].to_numpy(dtype=float), np.append(hits["count"].to_numpy(dtype=float), silent)
    model.lam = _lambda(np.append(values, -DRIFT), weights)
    best = F.coalesce(F.array_max("found"), F.lit(0.0))
    exposure = float(clean.agg(F.sum((F.col("words") * F.exp(best * -model.lam)).cast("decimal(38,9)"))).first()[0] or 0)
    model.k = min(1.0, max(1e-6, float(n[:, 0].sum()) / max(exposure, 1e-9)))
    lam, k = model.lam, model.k

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [evidence(w, [(0, 0, s) for s in f], lam, k) for w, f in zip(b.column("words").to_pylist(), b.column("found").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), *(pa.array([e[i] for e in x], pa.float64()) for i in (0, 1))], ["toxic", "a", "b"])

    weighed = got.mapInArrow(weigh, "toxic int, a double, b double").toPandas().sort_values(["toxic", "a", "b"])
    model.weights = _logistic(weighed[["a", "b"]].to_numpy(), weighed.toxic.to_numpy(dtype=float))
    shared.unpersist()
    return model


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_words, n_passages (with E < 1) and the best passage: its words (best_first, best_last) and ln E."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scores = WordScores(model)
        kinds = [pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                n, found = segments(text or "", scores)
                score = score_of(model, evidence(n, found, model.lam, model.k))
                best = max(found, key=lambda x: x[2], default=None)
                space = math.log(max(model.k * n, 1e-12))
                many = sum(space - model.lam * s < 0 for _, _, s in found)
                out.append((score, n, many, *((best[0], best[1], space - model.lam * best[2]) if best else (None, None, None))))
            cols = zip(*out, strict=True)
            arrays = [b.column(0), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "score", "n_words", "n_passages", "best_first", "best_last", "best_ln_e"])

    schema = "doc_id long, score double, n_words long, n_passages long, best_first long, best_last long, best_ln_e double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, schema)


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """score_documents() with held_out and predicted."""
    scored = score_documents(docs, train(docs, labels, rows))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return scored.withColumn("held_out", F.coalesce(held, F.lit(False))).withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic; columns stay as they are. Each row is judged by its own text, and none is moved."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(train(docs, labels))
    text = "_lr_text"

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scores = WordScores(model)
        for b in batches:
            fine = []
            for t in b.column(b.num_columns - 1).to_pylist():
                n, found = segments(t or "", scores)
                fine.append(score_of(model, evidence(n, found, model.lam, model.k)) < THRESHOLD)
            yield b.select(range(b.num_columns - 1)).filter(pa.array(fine, pa.bool_()))

    return docs.withColumn(text, F.col("text").cast("string")).mapInArrow(keep, docs.schema)
