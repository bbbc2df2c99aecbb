"""Null-aware anti-joins, medians, sketches, newest files, and streams whose rows come late."""

from __future__ import annotations

import datetime
import random
import statistics

import pytest
from pyspark.sql import functions as F

from hardwood.operators import quality
from hardwood.plans import streams
from hardwood.sources import feeds
from hardwood.streaming import events


@pytest.mark.parametrize("others,left", [([1, 2], [3]), ([1, None], []), ([None], []), ([], [1, 2, 3, None]), ([2, 2], [1, 3])])
def test_not_in(spark, others, left):
    rows = spark.createDataFrame([(x,) for x in (1, 2, 3, None)], "k int")
    got = [r.k for r in quality.not_in(rows, "k", spark.createDataFrame([(x,) for x in others], "o int"), "o").collect()]
    assert sorted(got, key=str) == sorted(left, key=str)


def test_not_in_is_no_single_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(100).toDF("k")
        plan = quality.not_in(rows, "k", spark.range(50).toDF("o"), "o")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastNestedLoopJoin" not in plan and "SortMergeJoin" in plan


@pytest.mark.parametrize("ranges", [1, 3, 256])
def test_medians(spark, ranges):
    rng = random.Random(ranges)
    rows = [("hot", rng.choice((1.0, 2.0, 2.5, 1e9))) for _ in range(3000)] + [("even", float(x)) for x in range(10)] + [("odd", -1.0), ("one", 5.0), (None, 1.0), (None, 4.0), ("gaps", None), ("gaps", 3.0)] + [("same", 7.0)] * 4
    got = {r.k: (r.median, r.n) for r in quality.exact_medians(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", ranges).collect()}
    values = {}
    for k, v in rows:
        if v is not None:
            values.setdefault(k, []).append(v)
    assert got == {k: (statistics.median(v), len(v)) for k, v in values.items()}
    assert quality.exact_medians(spark.createDataFrame([], "k string, v double"), ["k"], "v").count() == 0


def test_sketches_merge_over_any_range(spark):
    """Days overlap; the merged sketch counts a value once, within three standard errors."""
    rows = spark.range(60_000).select((F.col("id") % 6).alias("day"), (F.col("id") % 20_000).alias("who"))
    s = quality.distinct_sketches(rows, ["day"], "who")
    for days in ((0, 1, 2, 3, 4, 5), (0, 3), (2,)):
        exact = rows.where(F.col("day").isin(*days)).agg(F.count_distinct("who")).first()[0]
        found = quality.merged_distinct(s.where(F.col("day").isin(*days)), []).first()[0]
        assert abs(found - exact) <= 3 * 0.0125 * exact


def test_newest_files(spark, tmp_path):
    for i, name in enumerate(("c", "a", "b")):
        spark.createDataFrame([(i,)], "n int").coalesce(1).write.json(f"{tmp_path}/{name}")
    got = [(r.path.rsplit("/", 2)[1], r.place) for r in feeds.newest_files(spark, str(tmp_path), 2).orderBy("place").collect()]
    assert got == [("b", 1), ("a", 2)] and feeds.newest_files(spark, str(tmp_path), 9).count() == 3


def test_late_rows_are_gone_and_a_restart_changes_nothing(spark, tmp_path):
    day = lambda n, h=1: datetime.datetime(2025, 1, n, h)
    folder = str(tmp_path)

    def arrive(*times):
        spark.createDataFrame([(i, t, 1, "view", 1.0, None) for i, t in enumerate(times)], events.SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")

    def run():
        stream = events.tumbling(events.read_events(spark, f"{folder}/in", "*.parquet"), late="1 day")
        return {(r.start.day, r.n) for r in events.stored(spark, stream, folder).collect()}

    arrive(day(1), day(2))
    assert run() == set()
    arrive(day(5))
    assert run() == {(1, 1), (2, 1)}
    # The first comes for a day that is over, the second in time.
    arrive(day(2, 5), day(4), day(8))
    assert run() == {(1, 1), (2, 1), (4, 1), (5, 1)}
    assert run() == {(1, 1), (2, 1), (4, 1), (5, 1)}


@pytest.mark.parametrize("name", ["stream_tumbling_days", "stream_sessions"])
def test_no_event_is_left_in_an_open_window(spark, name):
    """The rows of all windows count every event, the last ones too."""
    folder = "/root/testdata/sf0.001"
    want = spark.read.parquet(f"{folder}/events.parquet").count()
    assert streams.QUERIES[name](spark, folder).agg(F.sum("n")).first()[0] == want


def test_windows_are_closed_once_events_are_over(spark, tmp_path):
    at = lambda d, h, m=0: datetime.datetime(2025, 1, d, h, m)
    rows = [(i, t, u, "view", 1.0, None) for i, (u, t) in enumerate([(1, at(1, 9)), (1, at(1, 9, 59)), (1, at(3, 23, 30)), (2, at(3, 23, 59)), (None, at(3, 1))])]
    spark.createDataFrame(rows, events.SCHEMA).write.parquet(f"{tmp_path}/in")
    stream = events.read_events(spark, f"{tmp_path}/in", "*.parquet")
    got = {(r.start.day, r.event_type, r.n, r.total) for r in events.finished(spark, stream, events.tumbling, f"{tmp_path}/a").collect()}
    assert got == {(1, "view", 2, 2.0), (3, "view", 3, 3.0)}
    got = {(r.user_id, r.start, r.end, r.n) for r in events.finished(spark, stream, events.sessions, f"{tmp_path}/b").collect()}
    assert got == {(1, at(1, 9), at(1, 10, 59), 2), (1, at(3, 23, 30), at(4, 0, 30), 1), (2, at(3, 23, 59), at(4, 0, 59), 1), (None, at(3, 1), at(3, 2), 1)}


def test_limits_over_sliding_windows(spark, tmp_path):
    at = lambda h, m=0: datetime.datetime(2025, 1, 1, h, m)
    rows = [(i, t, u, "view", 1.0, None) for i, (u, t) in enumerate([(1, at(0, 10)), (1, at(1, 11)), (1, at(1, 50)), (2, at(0, 10)), (2, at(5)), (3, at(23))])]
    spark.createDataFrame(rows, events.SCHEMA).write.parquet(f"{tmp_path}/in")
    assert events.stored(spark, events.tumbling(events.read_events(spark, f"{tmp_path}/in", "*.none")), f"{tmp_path}/none").count() == 0
    stream = events.read_events(spark, f"{tmp_path}/in", "*.parquet")
    got = events.stored(spark, events.over_limit(stream, "user_id", 2, "2 hours", "1 hour", "1 hour"), f"{tmp_path}/a").collect()
    assert [(r.user_id, r.start.hour, r.end.hour, r.n) for r in got] == [(1, 0, 2, 3)]
    got = events.stored(spark, events.renewed_counters(stream, "user_id", 1, "1 hour", "1 hour"), f"{tmp_path}/b").collect()
    assert [(r.user_id, r.start.hour, r.n) for r in got] == [(1, 1, 2)]
