"""Conversations from batches against a plain simulation, and their defined results."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("lumenrank.llm.common")
from lumenrank.llm import turns  # noqa: E402

ARRIVAL = "conv_id long, turn long, role string, text string, batch long, first long"


def simulate(batches, first, end, patience=3):
    """Events of batches (a list of {(conv, turn): (payload, role)}), by the rules as they are written."""
    events, state = [], {}

    def close(conv, batch):
        s = state[conv]
        s["closed"] = True
        kept, left = s["kept"], sorted(t for t in s["kept"] if t >= s["next"])
        digest = hashlib.sha256(",".join(map(str, left)).encode()).hexdigest()
        breaks = sum(t - 1 in kept and kept[t][1] == kept[t - 1][1] for t in kept)
        events.append(("close", conv, -1, batch, None, max(kept) - first[conv] + 1 - len(kept), breaks, digest))

    for b, arrived in enumerate(batches):
        for conv in {c for c, _ in arrived}:
            s = state.setdefault(conv, {"kept": {}, "next": first[conv], "last": b, "closed": False})
            for (c, t), p in arrived.items():
                if c == conv and s["closed"]:
                    events.append(("reject", c, t, b, p[0], None, None, None))
                elif c == conv:
                    s["kept"].setdefault(t, p)
            if not s["closed"]:
                s["last"] = b
                while s["next"] in s["kept"]:
                    events.append(("release", conv, s["next"], b, s["kept"][s["next"]][0], None, None, None))
                    s["next"] += 1
        for conv, s in state.items():
            if not s["closed"] and b - s["last"] >= patience:
                close(conv, b)
    for conv, s in state.items():
        if not s["closed"]:
            close(conv, end)
    return sorted(events, key=str)


def told(events):
    payload = F.when(F.col("event") != "close", F.concat_ws("|", "role", "text"))
    rows = events.select("event", "conv_id", "turn", "batch", payload.alias("p"), "n_missing", "n_breaks", "left_sha256").collect()
    return sorted((tuple(r) for r in rows), key=str)


def test_table_of_conversations(spark):
    """Nulls, repeated rows, a row without a conv_id and a role that holds the payload's separator."""
    rng = np.random.default_rng(11)
    rows = [(int(c), int(t) + int(c) - 3, ["user", "assistant", None, "a|b"][int(r)], None if x == 0 else f"text {x} é") for c, t, r, x in rng.integers(0, 9, (160, 4)) % [7, 9, 4, 9]]
    rows += rows[:30] + [(3, None, "user", "dropped"), (None, 1, "user", "no id"), (None, 2, "user", "")]
    first, batches = {}, [{} for _ in range(12)]
    for c, t, role, text in rows:
        if t is None:
            continue
        first[c] = min(t, first.get(c, t))
        h = int(hashlib.sha256(f"{'' if c is None else c}:{t}".encode()).hexdigest()[:8], 16)
        for b, as_role in [(h % 12, role or "")] + [((h + 3) % 12, "user")] * (h % 7 < 2):
            p = (f"{as_role}|{text or ''}", as_role)
            batches[b][c, t] = min(p, batches[b].get((c, t), p))
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, first long")
    assert told(turns.reassembled(table)) == simulate(batches, first, 12)


def test_long_and_idle_conversations(spark):
    """More waiting turns than a conversation's row takes, several kinds of ends, empty batches, a query that starts anew each time."""
    order = np.random.default_rng(3).permutation(np.arange(1, 200))
    plan = [[(1, int(t)) for t in order[:150]] + [(2, 0)], [(2, 2), (1, int(order[0]))], [], [(2, 2)], [], [], [(2, 1), (3, 5)], [(1, 0), (3, 6)], [(1, int(order[170]))]]
    first = {1: 0, 2: 0, 3: 5}
    batches = [{(c, t): (f"user|{b} {t}", "user") for c, t in p} for b, p in enumerate(plan)]
    feed = turns.Feed(spark, end=len(plan))
    for b, arrived in enumerate(batches):
        rows = [(c, t, "user", p[5:], b, first[c]) for (c, t), (p, _) in arrived.items()]
        rows += [(c, t, "user", text + "~", b, f) for c, t, _, text, _, f in rows]  # larger payloads of the same batch
        feed.push(b, spark.createDataFrame(rows, ARRIVAL), last=b == len(plan) - 1)
    assert told(feed.events()) == simulate(batches, first, len(plan))


def test_no_conversations(spark):
    assert turns.arrivals(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_stream_that_ends_early(spark):
    """The batches were to be five; after two the stream is ended, and time is put forward."""
    batches = [{(1, 0): ("user|a", "user"), (1, 2): ("user|c", "user")}, {(2, 4): ("user|x", "user")}]
    feed = turns.Feed(spark, end=5)
    for b, arrived in enumerate(batches):
        rows = [(c, t, "user", p[5:], b, {1: 0, 2: 4}[c]) for (c, t), (p, _) in arrived.items()]
        feed.push(b, spark.createDataFrame(rows, ARRIVAL), last=b == 1)
    assert [e for e in told(feed.events()) if e[0] == "close"] == [e for e in simulate([*batches, {}, {}, {}], {1: 0, 2: 4}, 5) if e[0] == "close"]


def test_stores_are_closed_when_their_tasks_end(spark):
    """An executor holds no store of a batch that is over: with many partitions they would fill its memory."""

    def open_stores():
        name = "org.apache.spark.sql.execution.streaming.state.StateStore$"
        field = spark._jvm.java.lang.Thread.currentThread().getContextClassLoader().loadClass(name).getDeclaredField("loadedProviders")
        field.setAccessible(True)
        found = field.get(None).keysIterator()
        return {found.next().toString() for _ in iter(found.hasNext, False)}

    before = open_stores()
    feed = turns.Feed(spark, end=2)
    feed.push(0, spark.createDataFrame([(1, 0, "user", "a", 0, 0)], ARRIVAL))
    assert open_stores() <= before
    feed.push(1, spark.createDataFrame([(1, 1, "user", "b", 1, 0)], ARRIVAL), last=True)
    assert open_stores() <= before
    assert [e[:4] for e in told(feed.events())] == [("close", 1, -1, 2), ("release", 1, 0, 0), ("release", 1, 1, 1)]


def test_one_operator_keeps_state(spark):
    """Repeats of released and of waiting turns are told by the conversation's own state, so no second operator and its stores are needed."""
    plan = [[(1, 0), (1, 1), *((1, t) for t in range(3, 40))], [(1, 1), (1, 5), (1, 39)], [(1, 2), (1, 7)], [(1, 2), (1, 0), (1, 41)]]
    batches = [{(c, t): (f"user|{b} {t}", "user") for c, t in p} for b, p in enumerate(plan)]
    feed = turns.Feed(spark, end=len(plan))
    for b, arrived in enumerate(batches):
        feed.push(b, spark.createDataFrame([(c, t, "user", p[5:], b, 0) for (c, t), (p, _) in arrived.items()], ARRIVAL), last=b == len(plan) - 1)
    assert told(feed.events()) == simulate(batches, {1: 0}, len(plan))
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{feed.folder}/state/state")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    assert [f.getPath().getName() for f in found if f.isDirectory()] == ["0"]
