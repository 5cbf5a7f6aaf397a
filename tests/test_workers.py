"""Lives of workers against a plain walk through time, in any order of arrival and across ranges."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from kgloom.streaming import merging, workers

T0 = dt.datetime(2024, 1, 1)
BEATS = "worker string, consumer string, ts timestamp, stopping boolean"
SECOND = 1_000_000
BASE = int(T0.replace(tzinfo=dt.timezone.utc).timestamp()) * SECOND


def _at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def _fed(spark, tmp_path, parts, schema, rowwise):
    """The stream's rows after each part has come as a batch of its own, and a far one at the end."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = rowwise(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))

        def replace(df, batch, k=k):
            df.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={batch}"))

        with merging.map_state(spark):
            q = out.writeStream.foreachBatch(replace).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
            q.awaitTermination(120)
    return spark.read.parquet(str(tmp_path / "out")).drop("batch").collect()


def _beats(seed):
    rng = random.Random(seed)
    out = [(w, f"c{c}", _at(s), rng.random() < 0.15) for w in "ab" for c in range(3) for s in sorted(rng.sample(range(0, 400), 20))]
    return out + out[:3]  # some twice


def _walk(beats, silent=15):
    found = []
    for w, c in sorted({(b[0], b[1]) for b in beats}):
        last = None
        for at, stop in sorted(((b[2] - T0).total_seconds(), b[3]) for b in beats if b[:2] == (w, c)) + [(1e9, None)]:
            if last is not None and at - last > silent:
                found.append((w, c, last + silent, "silent"))
                last = None
            if stop is False and last is None:
                found.append((w, c, at, "up"))
            if stop and last is not None:
                found.append((w, c, at, "stopped"))
            last = at if stop is False else None
    return sorted(found)


@pytest.mark.parametrize("seed", [1, 2])
def test_consumers_fall_silent_by_timers_in_any_order_of_arrival(spark, tmp_path, seed):
    beats = _beats(seed)
    cuts = [[b for b in beats if 140 * k <= (b[2] - T0).total_seconds() < 140 * (k + 1)] for k in range(3)]
    for part in cuts:
        random.Random(seed).shuffle(part)
    swap = [b for b in cuts[1] if (b[2] - T0).total_seconds() < 145]  # these come before their time
    odd = [(None, "c", T0, False), ("a", None, T0, False), ("a", "c0", None, False)]
    parts = [cuts[0] + swap + odd, [b for b in cuts[1] if b not in swap], cuts[2], [("z", "end", _at(10_000), False)]]
    found = _fed(spark, tmp_path, parts, BEATS, lambda s: workers.consumer_changes(s))
    assert sorted((r.worker, r.consumer, (r.at - BASE) / SECOND, r.change) for r in found) == _walk(beats)


def test_a_null_stop_is_a_beat_and_no_beats_give_nothing(spark, tmp_path):
    found = _fed(spark, tmp_path, [[("a", "c", T0, None)], [("z", "end", _at(100), False)]], BEATS, lambda s: workers.consumer_changes(s))
    assert [(r.change, (r.at - BASE) / SECOND) for r in found] == [("up", 0), ("silent", 15)]
    (tmp_path / "none").mkdir()
    assert _fed(spark, tmp_path / "none", [[]], BEATS, lambda s: workers.consumer_changes(s)) == []


def _states(changes, marker=120):
    found, order = [], {"up": 0, "stopped": 1, "silent": 2}
    for w in sorted({c[0] for c in changes}):
        n, stop, state = 0, None, "unknown"
        for at, _, c, change in sorted((c[2], order[c[3]], c[1], c[3]) for c in changes if c[0] == w):
            before, was = n, state
            n += 1 if change == "up" else -1
            stop = at if change == "stopped" else stop
            if n:
                state = "alive"
            else:
                state = "scaled_down" if stop is not None and at - stop <= marker * SECOND else "crashed"
            found.append((w, at, c, "scale_up" if n > before else "scale_down", before, n, state, was if was != "alive" and state == "alive" else None))
    return sorted(found, key=str)


def test_worker_states_across_ranges(spark):
    changes = [(w, c, int(BASE + at * SECOND), x) for seed in (1, 2, 3) for w, c, at, x in [(f"{w}{seed}", *r) for w, *r in _walk(_beats(seed))]]
    before = [spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")]
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = workers.worker_states(spark.createDataFrame(changes, workers.CHANGES)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert sorted(map(tuple, found), key=str) == _states(changes)
    assert {"crashed", "scaled_down", "alive"} == {r.state for r in found}
    assert workers.worker_states(spark.createDataFrame([], workers.CHANGES)).count() == 0


def test_ends_within_a_moment_are_one_alert(spark, tmp_path):
    ends = [("x", "w0", _at(10), "crashed")]  # within the grace
    ends += [("x", "w1", _at(100), "crashed"), ("x", "w2", _at(103), "scaled_down"), ("x", "w1", _at(104), "scaled_down"), ("x", "w3", _at(105), "crashed")]
    ends += [("x", "w2", _at(106), "crashed"), ("x", "w1", _at(650), "crashed"), ("x", "w1", _at(700), "crashed"), ("y", "w1", _at(101), "scaled_down"), (None, "w", T0, "crashed"), ("y", "w9", None, "crashed")]
    random.Random(3).shuffle(ends)
    far = [("z", "w", _at(100_000), "crashed")]
    found = _fed(spark, tmp_path, [[e for e in ends if e[2] is None or e[2] < _at(104)], [e for e in ends if e[2] and e[2] >= _at(104)], far], "channel string, worker string, ts timestamp, kind string", lambda s: workers.down_alerts(s, boot=F.lit(T0)))
    seen = sorted((r.channel, (r.closed_at - BASE) / SECOND, r.n, r.workers, r.message) for r in found)
    assert seen == [
        ("x", 105, 3, "w1:scaled_down,w2:scaled_down,w3:crashed", "3 workers are down"),
        ("x", 111, 1, "w2:crashed", "w2 stopped without a word"),
        ("x", 705, 1, "w1:crashed", "w1 stopped without a word"),
        ("y", 106, 1, "w1:scaled_down", "w1 was scaled to nothing"),
    ]


def test_one_call_takes_all_consumers_of_a_shard():
    class Kept:
        def __init__(self):
            self.rows = None

        def exists(self):
            return self.rows is not None

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows = rows

        def clear(self):
            self.rows = None

    own = workers._Consumers(10)
    own.up = Kept()
    own.up.put([("w", "a", 5), ("w", "c", 1)])
    due = [(20, "w", "a", False), (21, "w", "b", False), (21, "w", "b", True), (22, "v", "a", True), (22, "v", "b", False), (23, "v", "b", False), (40, "v", "b", True)]
    found = own.advance((0,), due, 50)
    assert sorted(found.itertuples(index=False, name=None)) == [
        ("v", "b", 22, "up"), ("v", "b", 33, "silent"), ("w", "a", 15, "silent"), ("w", "a", 20, "up"), ("w", "a", 30, "silent"), ("w", "b", 21, "stopped"), ("w", "b", 21, "up"), ("w", "c", 11, "silent"),
    ]
    assert not own.up.exists() and own.next_timer() is None
    own.advance((0,), [(60, "w", "d", False), (65, "w", "d", False)], 70)
    assert own.up.rows == [("w", "d", 65)] and own.next_timer() == 75
