"""Ranks, streaks and sessions over ranges of rows: brute force, and no task that holds all rows."""

import datetime
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from kgloom.operators import monitor, scoring


@pytest.fixture()
def ranges(spark):
    before = [spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")]
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_quantile_rank_is_the_share_at_or_below(spark, ranges):
    values = [None, None, *(i * 37 % 101 / 4 for i in range(400)), *[5.0] * 300]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v double")
    found = {r.id: r.rank for r in scoring.quantile_rank(df, "v", "rank").collect()}
    low = [float("-inf") if v is None else v for v in values]
    assert found == pytest.approx({i: sum(x <= v for x in low) / len(low) for i, v in enumerate(low)})


def test_several_ranks_at_once_with_hot_values_and_nulls(spark, ranges):
    rows = [(i, [None, 5.0, i * 37 % 101 / 4][i % 3], i % 4, None if i < 400 else i) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, a double, b int, c long")
    found = {r.id: (r.ra, r.rb, r.rc) for r in scoring.quantile_ranks(df, {"a": "ra", "b": "rb", "c": "rc"}).collect()}

    def share(k):
        low = [float("-inf") if r[k] is None else r[k] for r in rows]
        return [sum(x <= v for x in low) / len(low) for v in low]

    want = list(zip(share(1), share(2), share(3), strict=True))
    assert len(found) == 700 and all(found[i] == pytest.approx(want[i]) for i in range(700))
    assert scoring.quantile_ranks(df.limit(0), {"a": "ra", "b": "rb"}).count() == 0


def test_last_rows_of_a_hot_group(spark, ranges):
    rows = [("hot" if i % 3 else None, i * 37 % 1000, i) for i in range(900)]
    found = monitor.last_n(spark.createDataFrame(rows, "kind string, at int, id int"), 7, ["kind"], F.desc("at"), F.desc("id"), parts=5).collect()
    want = [r for kind in ("hot", None) for r in sorted((r for r in rows if r[0] == kind), key=lambda r: (r[1], r[2]))[-7:]]
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


def test_ties_are_broken_in_the_first_thousand(spark, ranges):
    rows = [(i, round(0.9 - i // 7 / 2000, 6)) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, score double")
    want, least = {i: 0.0 for i, _ in rows}, 10**9
    for k, (i, s) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0]))[:1000], 1):
        least = min(least, int(s * 1000 + 0.5) + k)
        want[i] = max(0, least - k) / 1000
    found = scoring.ties_broken(df, "id", "score", F.col("score").desc(), F.col("id"))
    assert {r.id: r.score for r in found.collect()} == pytest.approx(want)


def _rows(n=900):
    start = datetime.datetime(2024, 1, 1)
    hot = [("hot", start + datetime.timedelta(seconds=i * 60 + (i // 50) * 2000), i, None if i % 211 == 0 else 10 if i % 97 == 0 else 90) for i in range(n)]
    return hot + [("calm", start + datetime.timedelta(seconds=900 * i), n + i, 90 if i % 3 else 1) for i in range(20)] + [("one", start, 2 * n, 90)]


def test_streaks_and_sessions_meet_across_ranges(spark, ranges):
    rows = _rows()
    df = spark.createDataFrame(rows, "kind string, ts timestamp_ntz, event_id long, value int").repartition(5)
    streaks, sessions = [], []
    for kind, own in groupby(sorted(rows), lambda r: r[0]):
        own = list(own)
        for hit, part in groupby(own, lambda r: (r[3] or 0) > 40):
            part = list(part)
            if hit:
                streaks.append((kind, part[0][1], part[-1][1], len(part)))
        burst = []
        for r in [*own, None]:
            if burst and (r is None or r[1] > burst[-1][1] + datetime.timedelta(seconds=600)):
                sessions.append((kind, burst[0][1], burst[-1][1], len(burst), burst[-1][2]))
                burst = []
            burst.append(r)
    assert sorted(map(tuple, monitor.streaks(df, F.col("value") > 40, "kind").collect())) == sorted(streaks)
    assert sorted(map(tuple, monitor.sessions(df, 600, "kind").collect())) == sorted(sessions)
    # one run over all ranges
    assert [tuple(r)[3] for r in monitor.sessions(df.where("kind = 'hot'"), 100_000, "kind").collect()] == [900]
    assert monitor.streaks(df.limit(0), F.col("value") > 40, "kind").count() == 0


@pytest.mark.parametrize("run", [lambda df: monitor.streaks(df, F.col("value") > 40, "kind"), lambda df: monitor.sessions(df, 600, "kind")])
def test_no_window_holds_a_hot_key(spark, ranges, monkeypatch, run):
    frames, kept = [], monitor.kept
    monkeypatch.setattr(monitor, "kept", lambda df: frames.append(kept(df)) or frames[-1])
    run(spark.createDataFrame(_rows(), "kind string, ts timestamp_ntz, event_id long, value int"))
    most = frames[0].where("kind = 'hot'").groupBy("part").count().agg(F.max("count")).first()[0]
    assert most < 400


def test_no_window_holds_all_values(spark, ranges, monkeypatch):
    frames, kept = [], scoring.kept
    monkeypatch.setattr(scoring, "kept", lambda df: frames.append(kept(df)) or frames[-1])
    scoring.quantile_rank(spark.range(2000).withColumn("v", F.col("id") * 0.5), "v", "rank")
    assert frames[1].groupBy("_part").count().agg(F.max("count")).first()[0] < 800
