"""Streaming queries over events, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from hardwood.operators import upsert
from hardwood.plans.bridge import table
from hardwood.session import run_folder
from hardwood.streaming import events


def _folder(spark):
    return run_folder(spark, "stream")


def _run(shape):
    return lambda spark, d: events.stored(spark, shape(events.read_events(spark, d)), _folder(spark))


def _whole(shape):
    """With the windows that are open when the events end."""
    return lambda spark, d: events.finished(spark, events.read_events(spark, d), shape, _folder(spark))


def _published(spark, d):
    """Daily counts, merged batch by batch into a stored table of days."""
    folder = _folder(spark)
    stream = events.tumbling(events.read_events(spark, d))

    def merge(batch, _):
        rows = batch.select(F.to_date("start").alias("day"), "event_type", "n")
        upsert.upsert(rows, f"{folder}/days", ["day", "event_type"], "day")

    events.publish(stream, merge, f"{folder}/checkpoint")
    return spark.read.schema("event_type string, n long, day date").parquet(f"{folder}/days").select("day", "event_type", "n")


def _distinct(spark, d):
    """A stream that brings every event twice, without the repeats."""
    e = events.read_events(spark, d)
    return events.stored(spark, events.distinct_events(e.union(e)), _folder(spark)).select("event_id", "event_type", "value")


#: Days of one arrival, how late events with a value of 80 and more arrive, and how late an event may be.
ARRIVAL, LATE, ALLOWED = 5, 6, "2 days"


def _late_rows(spark, d):
    """Daily counts of events that arrive in seven parts, those of high value six days late. Every part is read by a run
    of its own, which goes on from the checkpoint of the one before; a last run finds nothing and changes nothing."""
    folder = _folder(spark)
    e = table(spark, d, "events")
    part = F.floor((F.dayofmonth("ts") - 1 + F.when(F.col("value") >= 80, LATE).otherwise(0)) / ARRIVAL).cast("int")
    e.withColumn("part", part).write.partitionBy("part").parquet(f"{folder}/parts")
    out = None
    for n in [*range((30 + LATE) // ARRIVAL + 1), None]:
        if n is not None:
            spark.read.schema(events.SCHEMA).parquet(f"{folder}/parts/part={n}").write.mode("append").parquet(f"{folder}/arrived")
        stream = events.tumbling(events.read_events(spark, f"{folder}/arrived", "*.parquet"), late=ALLOWED)
        out = events.stored(spark, stream, folder)
    return out


QUERIES = {
    "stream_tumbling_days": _whole(events.tumbling),
    "stream_sessions": _whole(events.sessions),
    "stream_published_days": _published,
    "stream_distinct": _distinct,
    "stream_late_rows": _late_rows,
    "stream_sliding_limits": _run(lambda e: events.over_limit(e, "user_id", 2, "6 hours", "2 hours")),
    "stream_renewed_counters": _run(lambda e: events.renewed_counters(e, "user_id", 3, "8 hours")),
}

_END = "(SELECT max(ts) - INTERVAL 6 HOUR FROM events)"
_PART = f"CAST(floor((day(ts) - 1 + CASE WHEN value >= 80 THEN {LATE} ELSE 0 END) / {ARRIVAL}) AS INTEGER)"


def _sessions(gap, least):
    return f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL {gap} HOUR THEN 0 ELSE 1 END AS fresh FROM events),
        s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
        SELECT user_id, min(ts) AS start, max(ts) + INTERVAL {gap} HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, session HAVING max(ts) + INTERVAL {gap} HOUR <= {_END} AND count(*) > {least}"""


ORACLE = {
    "stream_tumbling_days": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "stream_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
        s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
        SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, session""",
    "stream_renewed_counters": _sessions(8, 3),
    "stream_distinct": "SELECT event_id, event_type, value FROM events",
    "stream_published_days": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    # A row counts if its day isn't over by what the earlier parts have brought; a day is given out once it is over.
    "stream_late_rows": f"""WITH p AS (SELECT *, {_PART} AS part FROM events), m AS (SELECT part, max(max(ts)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL {ALLOWED.replace('days', 'DAY')} AS mark FROM p GROUP BY part)
        SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM p JOIN m USING (part) WHERE mark IS NULL OR date_trunc('day', ts) + INTERVAL 1 DAY > mark
        GROUP BY 1, 2 HAVING date_trunc('day', max(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL {ALLOWED.replace('days', 'DAY')} FROM events)""",
    "stream_sliding_limits": f"""WITH w AS (SELECT user_id, time_bucket(INTERVAL 2 HOUR, ts) - to_hours(CAST(2 * k AS BIGINT)) AS start FROM events, range(3) t(k))
        SELECT user_id, start, start + INTERVAL 6 HOUR AS "end", count(*) AS n FROM w GROUP BY ALL HAVING count(*) > 2 AND start + INTERVAL 6 HOUR <= {_END}""",
}
