import datetime as dt

from pyspark.sql import functions as F

from kgloom.streaming import monitor

T0 = dt.datetime(2024, 1, 1)


def _stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def _run(df, name, mode, tmp_path):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_latency_windows(spark, tmp_path):
    rows = [("a", T0 + dt.timedelta(seconds=s), float(s)) for s in (1, 2, 40, 400)]
    found = _run(monitor.latency_windows(_stream(spark, tmp_path, rows, "stream string, finished_at timestamp, duration_ms double")), "latency", "append", tmp_path)
    assert sorted((r["count"], r["mean"], r["p50"], r["p99"]) for r in found) == [(1, 40.0, 40.0, 40.0), (2, 1.5, 1.0, 2.0)]


def test_a_callback_counts_once(spark, tmp_path):
    rows = [("c1", T0), ("c1", T0 + dt.timedelta(seconds=5)), ("c2", T0)]
    assert sorted(r.callback_id for r in _run(monitor.once(_stream(spark, tmp_path, rows, "callback_id string, ts timestamp")).select("callback_id"), "once", "append", tmp_path)) == ["c1", "c2"]


def test_streaming_merge_equals_batch(spark, tmp_path):
    schema = "response_id long, answer string, kedge_id string, score double"
    rows = [(1, "x", f"e{i % 3}", float(i)) for i in range(6)] + [(1, "y", "e9", 0.5)]
    found = _run(monitor.merged_answers(_stream(spark, tmp_path, rows, schema)), "merged", "complete", tmp_path)
    batch = monitor.merged_answers(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, batch))


def test_liveness(spark, tmp_path):
    rows = [("w1", T0, False), ("w1", T0 + dt.timedelta(seconds=5), True), ("w2", T0, False)]
    found = _run(monitor.liveness(_stream(spark, tmp_path, rows, "consumer string, ts timestamp, stopping boolean")).where(F.col("event") != "crashed"), "alive", "append", tmp_path)
    assert sorted((r.consumer, r.event) for r in found) == [("w1", "scale_down"), ("w1", "scale_up"), ("w2", "scale_up")]


def _at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_alerts_wait_for_a_streak_and_cool_down(spark, tmp_path):
    values = [(0, 9.0), (10, 9.0), (20, 9.0), (30, 5.0), (40, 9.0), (50, 9.0), (60, 9.0), (70, None), (80, 9.0)]
    rows = [("xlen", _at(s), v) for s, v in values] + [("disk", _at(0), 80.0), ("other", _at(0), 1e9), (None, _at(0), 1e9), ("xlen", None, 1e9)]
    rules = spark.createDataFrame([("long", "xlen", 5.0, False, 20, 45), ("each", "xlen", 8.0, None, None, None), ("full", "disk", 80.0, True, 0, 600)], "rule string, metric string, threshold double, inclusive boolean, duration int, cooldown int")
    found = _run(monitor.alerts(_stream(spark, tmp_path, rows, "metric string, ts timestamp, value double"), rules), "alerts", "append", tmp_path)
    seen = sorted((r.rule, (r.ts - T0).total_seconds()) for r in found)
    # the second streak's alert comes at 60: 40 + 20 s of streak, but 20 + 45 s of cooldown isn't over, so it stays away
    assert seen == [("each", s) for s in (0, 10, 20, 40, 50, 60, 80)] + [("full", 0), ("long", 20)]


def test_completion(spark, tmp_path):
    rows = [(1, _at(0), "sent", 2), (1, _at(5), "back", None), (1, _at(9), "back", None), (1, _at(11), "back", None), (2, _at(0), "sent", 2), (2, _at(3), "back", None)]
    rows += [(3, _at(0), "back", None), (None, _at(0), "back", None), (4, None, "sent", 1), (9, _at(1000), "sent", 1)]
    found = _run(monitor.completion(_stream(spark, tmp_path, rows, "response_id long, ts timestamp, kind string, n int")), "completion", "append", tmp_path)
    seen = sorted((r.response_id, r.outcome, (r.ts - T0).total_seconds(), r.returned) for r in found)
    assert seen == [(1, "complete", 9.0, 2), (1, "late", 11.0, 3), (2, "timeout", 210.0, 1), (3, "unknown", 210.0, 1)]


def test_a_drained_stream_without_rows_is_empty(spark, tmp_path):
    schema = "response_id long, answer string, kedge_id string, score double"
    assert monitor.drained(monitor.merged_answers(_stream(spark, tmp_path, [], schema)), "none").count() == 0
