"""Chunks and windows of texts, series and traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from ..tables import materialise
from .ordering import place, spread


def word_chunks(docs: DataFrame, size: int, overlap: int = 0, least: int = 1) -> DataFrame:
    """(parent_id, child_id, start, text): windows of words; a last chunk of fewer than `least` words goes unless it is the only one."""
    w = spread(docs.select("doc_id", "text")).select(F.col("doc_id").alias("parent_id"), X.words(F.col("text")).alias("w")).where(F.size("w") > 0)
    c = w.select("parent_id", "w", F.posexplode(X.chunk_starts(F.size("w"), size, overlap)).alias("k", "start"))
    c = c.select("parent_id", "k", "start", F.slice("w", F.col("start") + 1, size).alias("part")).where((F.col("k") == 0) | (F.size("part") >= least))
    child = F.concat(F.col("parent_id").cast("string"), F.lit("#chunk-"), chunk_number(F.col("k")))
    return c.select("parent_id", child.alias("child_id"), F.col("start").cast("long").alias("start"), F.array_join("part", " ").alias("text"))


def chunk_number(k: Column) -> Column:
    """At least four digits; a number that needs more has them."""
    return F.lpad(k.cast("string"), F.greatest(F.lit(4), F.length(k.cast("string"))), F.lit("0"))


def numeric_windows(series: DataFrame, width: int, stride: int) -> DataFrame:
    """(id, start, values) of series (id, values), the tail covered by a last window."""
    starts = X.window_starts(F.size("values"), width, stride)
    return series.where(F.size("values") > 0).select("id", F.explode(starts).alias("start"), "values").select("id", F.col("start").cast("long").alias("start"), F.slice("values", F.col("start") + 1, width).alias("values"))


def window_stats(windows: DataFrame) -> DataFrame:
    """min, max, mean, first, last and delta of each window."""
    v = F.col("values")
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    first, last = F.get(v, F.lit(0)), F.element_at(v, -1)
    return windows.select("id", "start", F.size(v).cast("long").alias("n"), F.array_min(v).alias("min"), F.array_max(v).alias("max"), mean.alias("mean"), first.alias("first"), last.alias("last"), (last - first).alias("delta"))


_STATS = ("min", "max", "mean", "first", "last", "delta")


def render_window(prefix: Column | None = None) -> Column:
    """One line of text for a row of window_stats()."""
    parts = [F.concat(F.lit(f"{n}="), X.shortest_number(F.col(n))) for n in _STATS]
    return F.concat_ws(" ", *([prefix] if prefix is not None else []), *parts)


def render_series(series: DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """The text of a whole series (id, label, text, values), or (id, start, text) of its windows with their values."""
    whole = windows is None
    if whole:
        windows = series.select("id", F.lit(0).cast("long").alias("start"), "values")
    stats = window_stats(windows).join(windows, ["id", "start"]).join(series.select("id", "label", F.col("text").alias("_text")), "id")
    end = F.col("start") + F.col("n")
    place = F.concat(F.lit("count="), F.col("n").cast("string"))
    at = {"points": place} if whole else {"window": F.concat(F.lit("start="), F.col("start").cast("string"), F.lit(" end="), end.cast("string"), F.lit(" "), place), "values": F.array_join(F.transform("values", X.shortest_number), " ")}
    text = X.render_fields({"text": F.col("_text"), "label": F.col("label"), "series_id": F.col("id").cast("string"), **at, "stats": render_window()})
    return stats.select("id", *([] if whole else ["start"]), text.alias("text"))


def span_children(tokens: DataFrame, size: int, overlap: int, least: int = 1) -> DataFrame:
    """(parent_id, span, vector): means over spans of token vectors (parent_id, pos, vector), at unit length.

    A token of position p is in at most ceil(size / (size - overlap)) spans, so rows grow by that factor only.
    """
    from ..functions import vectors as V

    step = size - overlap
    n = tokens.groupBy("parent_id").agg(F.count("*").alias("n"))
    lo = F.greatest(F.lit(0), F.floor((F.col("pos") - size) / step) + 1)
    hi = F.least(F.floor(F.col("pos") / step), F.greatest(F.lit(0), F.ceil((F.col("n") - size) / step)))
    dealt = tokens.join(n, "parent_id").where(hi >= lo).select("parent_id", F.explode(F.sequence(lo.cast("long"), hi.cast("long"))).alias("span"), F.posexplode("vector").alias("d", "x"))
    mean = dealt.groupBy("parent_id", "span", "d").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("c")).where((F.col("span") == 0) | (F.col("c") >= least))
    packed = mean.groupBy("parent_id", "span").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("v"))
    return packed.select("parent_id", "span", V.normalize(F.transform("v", lambda z: z["x"])).alias("vector"))


def trace_windows(events: DataFrame, width: int, stride: int) -> DataFrame:
    """(id, start, text): windows over the ordered events (id, pos, text) of a trace, one event a line."""
    traces = events.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("e"))
    w = traces.select("id", "e", F.explode(X.window_starts(F.size("e"), width, stride)).alias("start"))
    part = F.transform(F.slice("e", F.col("start") + 1, width), lambda z: z["text"])
    return w.select("id", F.col("start").cast("long").alias("start"), F.array_join(part, "\n").alias("text"))


def adjacent_pairs(docs: DataFrame, least_bytes: int) -> DataFrame:
    """(query, positive): neighbouring segments of a text, both long enough, each pair once."""
    s = F.filter(X.segments(F.col("text")), lambda x: F.octet_length(x) >= least_bytes)
    p = spread(docs.select("text")).select(s.alias("s")).where(F.size("s") > 1)
    z = F.arrays_zip(F.slice("s", 1, F.size("s") - 1).alias("query"), F.slice("s", 2, F.size("s") - 1).alias("positive"))
    return p.select(F.explode(z).alias("z")).select("z.query", "z.positive").distinct()


def _mark(text: Column) -> Column:
    """Sixteen bytes of the SHA-256 of a text, which stand for it where only equality is asked."""
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def _line_parts(text: Column, least_bytes: int) -> Column:
    return F.filter(F.transform(F.split(text, r"[.!?;:]"), X.collapse), lambda x: F.octet_length(x) >= least_bytes)


def _mined_places(lines: DataFrame, least_bytes: int) -> DataFrame:
    """(i, kind, pos, at, k, q, p) of the pairs of mined_pairs: their numbers, lines and places in them, and for the texts their marks.

    at: the mark of the line. No text leaves its task here, so what is shuffled doesn't depend on how long the texts are.
    """
    rows = lines.select("pos", X.collapse(F.col("text")).alias("text")).withColumn("at", _mark(F.col("text")))
    m = rows.select("pos", "at", F.transform(_line_parts(F.col("text"), least_bytes), _mark).alias("m")).where(F.size("m") > 1)
    z = F.arrays_zip(F.slice("m", 1, F.size("m") - 1).alias("q"), F.slice("m", 2, F.size("m") - 1).alias("p"))
    inner = m.select(F.lit(0).alias("kind"), "pos", "at", F.posexplode(z).alias("k", "z")).select("kind", "pos", "at", "k", "z.q", "z.p")
    numbered = place(rows.select("pos", "at", (F.octet_length("text") >= least_bytes).alias("fits")), F.col("pos"), ["at"], "_i")
    numbered = materialise(numbered, "lines")
    follows = numbered.where("fits").select((F.col("_i") - 1).alias("_i"), F.col("at").alias("p"))
    outer = numbered.where("fits").join(follows, "_i").select(F.lit(1).alias("kind"), "pos", "at", F.lit(0).alias("k"), F.col("at").alias("q"), "p")
    both = inner.unionByName(outer).where("q <> p").groupBy("q", "p").agg(F.min(F.struct("kind", "pos", "k", "at")).alias("m"))
    both = materialise(both.select("m.kind", "m.pos", "m.at", "m.k", "q", "p"), "pairs")
    first, then = both.where("kind = 0"), both.where("kind = 1")
    n = first.count()
    return place(first, F.col("pos"), ["k", "at"], "i").unionByName(place(then, F.col("pos"), ["at"], "i").withColumn("i", F.col("i") + n))


def _mined_texts(places: DataFrame, lines: DataFrame, least_bytes: int) -> DataFrame:
    """(i, query, positive): the texts of some of the places, which the lines they are from are joined with."""
    rows = lines.select("pos", X.collapse(F.col("text")).alias("text")).withColumn("at", _mark(F.col("text")))
    if rows.groupBy("pos", "at").count().where("count > 1").take(1):  # a line that comes twice gives its pairs once
        rows = rows.dropDuplicates(["pos", "at"])
    asked = places.where("kind = 0").groupBy("pos", "at").agg(F.collect_list(F.struct("i", "k")).alias("asked"))
    inner = rows.join(asked, ["pos", "at"]).select("asked", _line_parts(F.col("text"), least_bytes).alias("s"))
    both = F.transform("asked", lambda x: F.struct(x["i"].alias("i"), F.get("s", x["k"]).alias("query"), F.get("s", x["k"] + 1).alias("positive")))
    outer = places.where("kind = 1")
    follows = rows.select(F.col("at").alias("p"), F.col("text").alias("positive")).join(outer.select("p").distinct(), "p", "left_semi").dropDuplicates(["p"])
    outer = rows.join(outer.select("pos", "at", "i", "p"), ["pos", "at"]).join(follows, "p").select("i", F.col("text").alias("query"), "positive")
    return inner.select(F.explode(both).alias("z")).select("z.*").unionByName(outer)


def mined_pairs(lines: DataFrame, least_bytes: int = 8, most: int = 0, seed: str = "1") -> DataFrame:
    """(i, query, positive): neighbouring parts of each line (pos, text), then neighbouring lines, each different pair once,
    numbered in that order; with `most` a seeded draw of so many, numbered in the order of the draw."""
    from .mining import hash_order

    places = materialise(_mined_places(lines, least_bytes), "numbered")
    if most:
        digits = _mined_texts(places, lines, least_bytes).select("i", hash_order(seed, F.concat_ws("\0", "query", "positive")).alias("d"))
        digits = materialise(digits, "digits")
        drawn = place(digits, F.conv(F.substring("d", 1, 12), 16, 10).cast("long"), ["d"], "n").where(F.col("n") < most).select("i", "n")
        drawn = materialise(places.join(drawn, "i").drop("i").withColumnRenamed("n", "i"), "drawn")
        return _mined_texts(drawn, lines, least_bytes)
    return _mined_texts(places, lines, least_bytes)


def mined_train_and_eval(lines: DataFrame, eval_pairs: int, least_bytes: int = 8) -> tuple[DataFrame, DataFrame]:
    """train_and_eval of mined_pairs: who is judged with what is found by marks, and texts come to the pairs that are asked for."""
    places = materialise(_mined_places(lines, least_bytes), "numbered")
    held, others = _judged(places.select("i", F.col("q").alias("query"), F.col("p").alias("positive")), eval_pairs)
    others = materialise(others, "others")
    asked = others.select("i").unionByName(others.select(F.col("j").alias("i"))).unionByName(places.where(F.col("i") < held).select("i")).distinct()
    asked = materialise(asked, "asked")  # few rows, known to be few before anything is shuffled
    texts = materialise(_mined_texts(places.join(asked, "i", "left_semi"), lines, least_bytes), "texts")
    right = texts.where(F.col("i") < held).select("query", F.col("positive").alias("right"), F.lit(1).alias("target"))
    wrong = others.join(texts.select("i", "query"), "i").join(texts.select(F.col("i").alias("j"), F.col("positive").alias("right")), "j").select("query", "right", F.lit(-1).alias("target"))
    return _mined_texts(places.where(F.col("i") >= held), lines, least_bytes), right.unionByName(wrong)


def _judged(pairs: DataFrame, eval_pairs: int) -> tuple[int, DataFrame]:
    """How many of numbered pairs (i, query, positive) are judged, and (i, j): the pair whose positive each of these is judged with.

    j is the first after i, round the end, whose positive is neither the pair's positive nor its query. Among the judged
    only pairs with such a positive can be in the way, so one place more than there are of these is looked at; behind
    them the first pairs of three different positives are enough.
    """
    n = pairs.count()
    held = min(eval_pairs, n // 2) or (1 if n > 2 and eval_pairs >= 0 else 0)
    judged = pairs.where(F.col("i") < held)
    tail = pairs.where(F.col("i") >= held).select(F.col("i").alias("j"), F.col("positive").alias("right"))
    behind: list = []
    while len(behind) < 3 and (found := tail.where(~F.col("right").isin([r.right for r in behind])).orderBy("j").limit(1).collect()):
        behind += found
    same = judged.select(F.col("positive").alias("t")).groupBy("t").count()
    many = lambda c: judged.select("i", F.col(c).alias("t")).join(same, "t").select("i", "count")
    blocked = many("query").unionByName(many("positive")).groupBy("i").agg(F.sum("count").alias("b"))
    own = judged.join(blocked, "i").select("i", "query", F.col("positive").alias("own"), "b")
    near = F.explode(F.sequence(F.lit(0), F.least(F.col("b"), F.lit(max(held - 1, 0))).cast("int")))
    looks = own.select("i", "query", "own", near.alias("d")).select("i", "query", "own", F.explode(F.array(F.col("i") + 1 + F.col("d"), F.col("d").cast("long"))).alias("j"))
    met = looks.join(judged.select(F.col("i").alias("j"), F.col("positive").alias("right")), "j").select("i", "j", "query", "own", "right")
    if behind:
        met = met.unionByName(own.select("i", "query", "own", F.explode(F.array(*[F.struct(F.lit(r.j).cast("long").alias("j"), F.lit(r.right).alias("right")) for r in behind])).alias("x")).select("i", "x.j", "query", "own", "x.right"))
    free = met.where("right <> own and right <> query")
    return held, free.groupBy("i").agg(F.min_by("j", (F.col("j") - F.col("i") - 1 + n) % max(n, 1)).alias("j"))


def train_and_eval(pairs: DataFrame, eval_pairs: int) -> tuple[DataFrame, DataFrame]:
    """Of numbered pairs (i, query, positive) those to train on, and (query, right, target) to judge with.

    The first eval_pairs (at most half, one at least of three or more) are judged; each also with the first positive
    after its own, round the end, that is neither its positive nor its query.
    """
    pairs = materialise(pairs, "numbered")
    held, others = _judged(pairs, eval_pairs)
    judged = pairs.where(F.col("i") < held)
    wrong = judged.select("i", "query").join(others, "i").join(pairs.select(F.col("i").alias("j"), F.col("positive").alias("right")), "j").select("query", "right", F.lit(-1).alias("target"))
    right = judged.select("query", F.col("positive").alias("right"), F.lit(1).alias("target"))
    return pairs.where(F.col("i") >= held), right.unionByName(wrong)


def half_pairs(docs: DataFrame, least_words: int = 40) -> DataFrame:
    """(doc_id, query, positive): first and second half of texts of enough words."""
    w = docs.select("doc_id", X.words(F.col("text")).alias("w")).where(F.size("w") >= least_words)
    mid = F.floor(F.size("w") / 2).cast("int")
    return w.select("doc_id", F.array_join(F.slice("w", F.lit(1), mid), " ").alias("query"), F.array_join(F.slice("w", mid + 1, F.size("w")), " ").alias("positive"))


def with_other_body(pairs: DataFrame, seed: str, tries: int = 4) -> DataFrame:
    """pairs (doc_id, query, positive) with negative: the positive of another row, by a hashed distance on the ring of all rows by doc_id.

    Each other row is as likely as any; of `tries` distances the first whose text is not the row's own is taken, and a row that
    meets none has no negative (null). A row is joined with `tries` others, whatever the number of rows.
    """
    from .mining import hash_order

    n = pairs.count()
    ring = place(pairs.select("doc_id", "query", "positive"), F.col("doc_id"), [], "i")
    digits = F.conv(F.substring(hash_order(seed, F.concat_ws(":", F.col("doc_id").cast("string"), F.col("k").cast("string"))), 1, 15), 16, 10).cast("long")
    asked = ring.select("doc_id", "query", "positive", "i", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("k"))
    asked = asked.withColumn("j", (F.col("i") + 1 + digits % max(n - 1, 1)) % max(n, 1))
    met = asked.join(ring.select(F.col("i").alias("j"), F.col("positive").alias("other")), "j").where("other <> positive")
    return ring.drop("i").join(met.groupBy("doc_id").agg(F.min_by("other", "k").alias("negative")), "doc_id", "left")


def batch_order(rows: DataFrame, length: str, key: str, batch: int) -> DataFrame:
    """rows with `position`: sorted by length within windows of 4 batches of the order by key.

    The key is a number; the place in its order is found by ranges of it, so no task gets all rows.
    """
    w = place(rows, F.col(key), [], "_i")
    w = w.withColumn("_w", F.floor(F.col("_i") / (4 * batch)))
    at = F.row_number().over(W.partitionBy("_w").orderBy(length, key)) - 1
    return w.withColumn("position", (F.col("_w") * 4 * batch + at).cast("long")).drop("_i", "_w")


def round_robin(rows: DataFrame, source: str, key: str) -> DataFrame:
    """rows with `turn` and `position`: sources take turns in proportion to their sizes (by fractional rank)."""
    n = rows.groupBy(source).agg(F.count("*").alias("_n"))
    r = place(rows, F.col(key), [], "_r", within=[source]).join(n, source)
    r = r.withColumn("turn", (F.col("_r") + 0.5) / F.col("_n")).drop("_r", "_n")
    return place(r, F.col("turn"), [source, key], "position").withColumn("position", F.col("position").cast("long"))
