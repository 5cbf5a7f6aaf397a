"""The serial merge under state equals a batch fold, and its state ends empty."""

import datetime as dt
import random

import pytest

from kgloom.streaming import merging

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "response_id long, callback_id string, sent_at timestamp, expected int, ts timestamp, answer string, kedge_id string, score double"


def _callbacks(seed):
    rng = random.Random(seed)
    out = []
    for i in range(12):
        sent, expected = T0 + dt.timedelta(seconds=20 * i), rng.randint(1, 4)
        for c in range(expected - (i % 3 == 0) * rng.randint(0, 1)):  # some never come back
            at = sent + dt.timedelta(seconds=rng.choice([1, 2, 2, 5, 209]))
            out.append([(i, f"c{i}.{c}", sent, expected, at, f"a{rng.randint(0, 3)}", f"e{rng.randint(0, 9)}", rng.random()) for _ in range(rng.randint(1, 5))])
        if i % 4 == 1:  # after its time
            out.append([(i, f"late{i}", sent, expected, sent + dt.timedelta(seconds=300), "a9", "e9", 9.0)])
    return out


def _plain(rows):
    return sorted((r.response_id, r.outcome, r.returned, r.answer, tuple(r.edges), r.score, r.first_edge) for r in rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_arrival_gives_the_batch_fold(spark, tmp_path, seed):
    callbacks = _callbacks(seed)
    batch = _plain(merging.batch_merge(spark.createDataFrame([r for c in callbacks for r in c], SCHEMA)).collect())
    arriving = callbacks + random.Random(seed).sample(callbacks, 5)  # some are delivered twice
    random.Random(seed + 10).shuffle(arriving)
    odd = [(None, "x", T0, 1, T0, "a", "e", 1.0), (3, None, T0, 1, T0, "a", "e", 1.0), (3, "y", T0, 1, None, "a", "e", 1.0), (3, "z", T0, 1, T0, None, "e", 1.0)]
    end = [(10_000, "end", T0 + dt.timedelta(hours=h), 1, T0 + dt.timedelta(hours=h), "a", "e", 1.0) for h in (2,)]
    parts = [[r for c in arriving[k::4] for r in c] for k in range(4)] + [odd, end]
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with merging.map_state(spark):
        q = merging.serial_merge(stream).writeStream.outputMode("append").format("memory").queryName(f"serial{seed}").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(200)
    assert q.exception() is None
    found = [r for r in spark.table(f"serial{seed}").collect() if r.response_id != 10_000]
    assert _plain(found) == batch
    left = spark.read.format("statestore").option("stateVarName", "edges").load(str(tmp_path / "state"))
    open_ = spark.read.format("statestore").option("stateVarName", "open").load(str(tmp_path / "state"))
    assert left.count() == 0 and {r.key.response_id for r in open_.collect()} <= {10_000}


def test_a_batch_costs_few_state_calls():
    """a response's rows go to the state at once, not one by one."""
    import pandas as pd

    calls = []

    class State:
        def __init__(self, name):
            self.name = name

        def __getattr__(self, what):
            def call(*args):
                calls.append((self.name, what))
                return iter(()) if what == "get" and self.name != "open" else None

            return call

    class Handle:
        def getListState(self, name, _):  # noqa: N802
            return State(name)

        getMapState = getValueState = getListState  # noqa: N815

        def registerTimer(self, at):  # noqa: N802
            calls.append(("timer", at))

    own = merging.SerialMerge(210)
    own.init(Handle())
    n = 1000
    rows = pd.DataFrame({"callback_id": [f"c{i}" for i in range(n)], "expected": n + 1, "at": pd.Timestamp(T0), "deadline": 7, "answer": "a", "kedge_id": [f"e{i}" for i in range(n)], "score": 0.5})
    assert list(own.handleInputRows((1,), iter([rows]), None)) == []
    assert len(calls) <= 5
    (whole,) = own.handleInputRows((2,), iter([rows.assign(expected=n)]), None)
    assert whole["returned"].tolist() == [n] and len(whole["edges"][0]) == n and whole["first_edge"].tolist() == ["e0"]
