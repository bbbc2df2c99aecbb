"""Queries over large profiles: null-aware anti-joins, mergeable distinct counts, exact medians, waits, newest files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hardwood.operators import quality
from hardwood.plans.bridge import table
from hardwood.session import run_folder
from hardwood.sources import feeds


def _not_in(spark, d):
    """Customers that no urgent order names; then against orders of which some name nobody; then against none."""
    c = table(spark, d, "customer").select("c_custkey")
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey", "o_totalprice")
    gaps = o.select(F.when(F.col("o_totalprice") < 300000, F.col("o_custkey")).alias("o_custkey"))
    each = {"plain": o, "with_nulls": gaps, "none": o.where("o_totalprice < 0")}
    parts = [quality.not_in(c, "c_custkey", others, "o_custkey").select(F.lit(name).alias("kind"), "c_custkey") for name, others in each.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _sketches(spark, d):
    """Users of each week from the sketches of its days: the exact number, and whether the estimate is off by 4 % at most."""
    e = table(spark, d, "events").select(F.to_date("ts").alias("day"), F.concat("event_type", F.col("user_id").cast("string")).alias("who"))
    week = F.floor((F.dayofmonth("day") - 1) / 7).cast("int").alias("week")
    estimate = quality.merged_distinct(quality.distinct_sketches(e, ["day"], "who"), [week])
    exact = e.groupBy(week).agg(F.count_distinct("who").alias("users"))
    return exact.join(estimate, "week").select("week", "users", (F.abs(F.col("distinct") - F.col("users")) <= F.ceil(F.col("users") * 0.04)).alias("close"))


def _medians(spark, d):
    """Medians of values by event type and of prices by supplier's part of the alphabet, one of which has most rows."""
    e = quality.exact_medians(table(spark, d, "events"), ["event_type"], "value").select(F.col("event_type").alias("key"), "median", "n")
    li = table(spark, d, "lineitem").select(F.when(F.col("l_suppkey") % 10 < 9, "most").when(F.col("l_suppkey") % 20 < 10, "few").alias("key"), "l_extendedprice")
    return e.unionByName(quality.exact_medians(li, ["key"], "l_extendedprice", 64).select("key", "median", "n"))


WAIT_HOURS, WAIT_MOST = 24, 3


def _waits(spark, d):
    """Requests of users that come when there were three already in the last 24 hours, and how long they would wait."""
    e = table(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    w = Window.partitionBy("user_id").orderBy("at").rangeBetween(-(WAIT_HOURS * 3_600_000_000 - 1), -1)
    e = e.select("event_id", "user_id", F.count("*").over(w).alias("before"), ((F.min("at").over(w) + WAIT_HOURS * 3_600_000_000 - F.col("at")) / 1e6).alias("wait"))
    return e.where(F.col("before") >= WAIT_MOST).select("event_id", "user_id", "before", F.round("wait", 3).alias("wait"))


def _newest(spark, d) -> DataFrame:
    """The three newest of five reports, which are written one after the other, with what they say."""
    folder = run_folder(spark, "reports")
    e = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    e.write.parquet(f"{folder}/all")
    made = spark.read.parquet(f"{folder}/all")
    for kind in ("click", "error", "purchase", "signup", "view"):
        made.where(F.col("event_type") == kind).coalesce(1).write.json(f"{folder}/reports/{kind}")
    newest = feeds.newest_files(spark, f"{folder}/reports")
    lines = spark.read.schema("event_type string, n long, total double").option("recursiveFileLookup", "true").json(f"{folder}/reports").select("*", F.col("_metadata.file_path").alias("_path"))
    tail = lambda c: F.substring_index(c, "/", -2)
    return lines.join(newest, tail(F.col("_path")) == tail(F.col("path"))).select("event_type", "n", "total", F.col("place").cast("long").alias("place"))


QUERIES = {"not_in": _not_in, "merged_distinct": _sketches, "exact_medians": _medians, "request_waits": _waits, "newest_reports": _newest}

_URGENT = "SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'"
ORACLE = {
    "not_in": f"""SELECT 'plain' AS kind, c_custkey FROM customer WHERE c_custkey NOT IN ({_URGENT})
        UNION ALL SELECT 'with_nulls', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_totalprice < 300000 THEN o_custkey END FROM orders WHERE o_orderpriority = '1-URGENT')
        UNION ALL SELECT 'none', c_custkey FROM customer WHERE c_custkey NOT IN ({_URGENT} AND o_totalprice < 0)""",
    "merged_distinct": "SELECT CAST(floor((day(ts) - 1) / 7) AS INTEGER) AS week, count(DISTINCT event_type || user_id) AS users, TRUE AS close FROM events GROUP BY 1",
    "exact_medians": """SELECT event_type AS key, median(value) AS median, count(value) AS n FROM events GROUP BY 1
        UNION ALL SELECT CASE WHEN l_suppkey % 10 < 9 THEN 'most' WHEN l_suppkey % 20 < 10 THEN 'few' END, median(l_extendedprice), count(*) FROM lineitem GROUP BY 1""",
    "request_waits": f"""WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events), w AS (SELECT event_id, user_id, t, count(*) OVER x AS before, min(t) OVER x AS oldest FROM e WINDOW x AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN {WAIT_HOURS * 3_600_000_000 - 1} PRECEDING AND 1 PRECEDING))
        SELECT event_id, user_id, before, round((oldest + {WAIT_HOURS * 3_600_000_000} - t) / 1e6::DOUBLE, 3) AS wait FROM w WHERE before >= {WAIT_MOST}""",
    "newest_reports": "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, row_number() OVER (ORDER BY event_type DESC) AS place FROM events GROUP BY event_type QUALIFY place <= 3",
}
