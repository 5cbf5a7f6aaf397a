"""Batches that come again, fail half-way or overlap; frames without a size, damaged, missing, over their time."""

import datetime as dt
import os
import random
import shutil

import pytest
import zstandard
from pyspark.sql import functions as F

from kgloom.sources import frames
from kgloom.sources.stored import KeyedTable

COLUMNS = "metric string, ts timestamp, value double"
T0 = dt.datetime(2024, 1, 1, 23)


def _table(spark, tmp_path):
    return KeyedTable(spark, f"file://{tmp_path}/metrics", COLUMNS, ["metric", "ts"], "ts", required=("value",))


def _rows(seed, n=60):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", None]), T0 + dt.timedelta(minutes=rng.randint(0, 90)), rng.choice([1.0, 2.0, None, 3.5])) for _ in range(n)] + [("a", None, 1.0)]


def _walk(batches):
    held = {}
    for rows in batches:
        own = {}
        for m, at, v in rows:
            if None not in (m, at, v):
                own[m, at] = min(v, own.get((m, at), v))
        held = {**own, **held}
    return sorted((*k, v) for k, v in held.items())


def _plain(df):
    return sorted(map(tuple, df.collect()))


def _files(path):
    return sorted(os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


def test_a_batch_twice_changes_nothing(spark, tmp_path):
    t, batches = _table(spark, tmp_path), [_rows(s) for s in (1, 2, 3)]
    for k, rows in enumerate(batches):
        t.insert(spark.createDataFrame(rows, COLUMNS), k)
    assert _plain(t.read()) == _walk(batches)
    for k in (2, 0, 1):  # again, in any order
        t.insert(spark.createDataFrame(batches[k], COLUMNS), k)
    assert _plain(t.read()) == _walk(batches)
    later = T0 + dt.timedelta(minutes=70)
    assert _plain(t.days(F.lit(later), F.lit(later + dt.timedelta(days=1)))) == [r for r in _walk(batches) if r[1] >= later]


def test_a_failure_half_way_is_mended_by_the_repetition(spark, tmp_path):
    t, batches = _table(spark, tmp_path), [_rows(1), _rows(2)]
    for k, rows in enumerate(batches):
        t.insert(spark.createDataFrame(rows, COLUMNS), k)
    lost = [d for d in (tmp_path / "metrics").glob("day=*/batch=1")]
    assert len(lost) == 2
    shutil.rmtree(lost[0])  # one day of the batch never came
    assert _plain(t.read()) != _walk(batches)
    t.insert(spark.createDataFrame(batches[1], COLUMNS), 1)
    assert _plain(t.read()) == _walk(batches)


def test_only_the_days_of_a_batch_are_touched(spark, tmp_path):
    t = _table(spark, tmp_path)
    t.insert(spark.createDataFrame([("a", T0, 1.0)], COLUMNS), 0)
    before = _files(tmp_path)
    t.insert(spark.createDataFrame([("a", T0 + dt.timedelta(days=3), 1.0)], COLUMNS), 1)
    assert set(before) < set(_files(tmp_path))
    t.insert(spark.createDataFrame([], COLUMNS), 2)
    assert t.read().count() == 2
    assert _table(spark, tmp_path / "none").read().count() == 0
    with pytest.raises(ValueError):
        KeyedTable(spark, "x", COLUMNS, ["metric"], "ts")


def test_a_stream_that_starts_again_takes_what_is_new(spark, tmp_path):
    t, batches = _table(spark, tmp_path), [_rows(s) for s in (4, 5)]
    for rows in batches:
        spark.createDataFrame(rows, COLUMNS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        t.fed_by(spark.readStream.schema(COLUMNS).parquet(str(tmp_path / "in")), str(tmp_path / "progress")).awaitTermination(120)
    assert _plain(t.read()) == _walk(batches)


def _later(seconds):
    return F.lit(dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)).cast("timestamp")


def test_messages_live_as_long_as_said_and_the_latest_counts(spark, tmp_path):
    at = f"file://{tmp_path}/messages"
    frames.save(spark.createDataFrame([("m1", "{}"), ("m2", "é" * 5000), ("m3", ""), (None, "x"), ("m4", None)], "message_id string, raw string"), at, _later(0), 100)
    frames.save(spark.createDataFrame([("m1", "[1]")], "message_id string, raw string"), at, _later(10), 20)
    read = lambda now: dict(map(tuple, frames.load(spark, at, now).collect()))
    assert read(_later(15)) == {"m1": "[1]", "m2": "é" * 5000, "m3": ""}
    assert read(_later(50))["m1"] == "{}"  # the later save's time is over, the first one's isn't
    assert read(_later(100)) == {}
    assert {r.raw for r in frames.get(spark, at, ["m1", "m3", "m1"], _later(15)).collect()} == {"[1]", ""}
    for ids, now in ((["m1", "m9"], _later(15)), (["m2"], _later(200))):
        with pytest.raises(Exception, match=f"no message {ids[-1]}"):
            frames.get(spark, at, ids, now).collect()
    frames.living(spark, at, _later(40), at + "-2")
    assert {r.message_id for r in frames.load(spark, at + "-2", _later(41)).collect()} == {"m1", "m2", "m3"}


def test_frames_without_a_size_are_read_and_damaged_ones_named(spark, tmp_path):
    plain = b'{"message": {}}' * 1000
    unsized = zstandard.ZstdCompressor(write_content_size=False).compress(plain)
    sized = zstandard.ZstdCompressor(write_checksum=True).compress(plain)
    for name, blob in {"whole.json.zst": sized, "unsized.zst": unsized, "cut.zst": unsized[:-4], "short.zst": sized[:-6], "text.zst": b"hello", "latin.zst": zstandard.compress(b"\xff\xfe")}.items():
        (tmp_path / name).write_bytes(blob)
    found = {r.message_id: r for r in frames.read_files(spark, f"file://{tmp_path}", strict=False).collect()}
    assert {k for k, r in found.items() if r.problem is None} == {"whole", "unsized"}
    assert all(r.raw == plain.decode() for r in found.values() if r.problem is None)
    with pytest.raises(Exception, match="frame of message text"):
        frames.read_files(spark, f"file://{tmp_path}/text.zst").collect()


def test_intake_saves_under_both_ids(spark, tmp_path):
    at = f"file://{tmp_path}/messages"
    rows = [("q1", "r1", "{}", None, "x"), ("q2", None, "{}", "http://h", None), ("q3", "r3", None, None, None)]
    states = frames.intake(spark.createDataFrame(rows, "query_id string, response_id string, raw string, callback_url string, target string"), at, _later(0), 100)
    assert [(r.query_id, r.state, r.status) for r in states.orderBy("query_id").collect()] == [("q1", "QUEUED", "OK"), ("q2", "ERROR", "ERROR"), ("q3", "ERROR", "ERROR")]
    assert {r.message_id for r in frames.load(spark, at, _later(1)).collect()} == {"q1", "r1"}
