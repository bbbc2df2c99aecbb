"""Structured Streaming over the events table: windows, sessions, duplicates and incremental publication."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hardwood.operators.upsert import exists

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"

STORE = "spark.sql.streaming.stateStore.providerClass"
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_events(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """A stream of event files; times become instants, as watermarks need them."""
    return spark.readStream.schema(SCHEMA).option("pathGlobFilter", pattern).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 day", late: str = "6 hours") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "6 hours") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def over_limit(requests: DataFrame, key: str, most: int, width: str, slide: str, late: str = "6 hours") -> DataFrame:
    """The overlapping windows in which a key has more than `most` requests: start, end, key, n. Each event counts in
    width / slide windows; a window is given out once, when the watermark has passed its end."""
    w = requests.withWatermark("ts", late).groupBy(F.window("ts", width, slide), key).agg(F.count("*").alias("n")).where(F.col("n") > most)
    return w.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")


def renewed_counters(requests: DataFrame, key: str, most: int, expires: str, late: str = "6 hours") -> DataFrame:
    """The runs of requests of a key in which each follows the last before its counter expires, with more than `most` of
    them: key, start, end, n."""
    w = requests.withWatermark("ts", late).groupBy(F.session_window("ts", expires), key).agg(F.count("*").alias("n")).where(F.col("n") > most)
    return w.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def distinct_events(events: DataFrame, late: str = "6 hours") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def publish(stream: DataFrame, upsert: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    """Runs the stream over what is there now and hands each batch to an idempotent upsert. A run on the checkpoint of an
    earlier one goes on where that has stopped, with its state and its watermark. State lies on disk, unless the session
    names a store of its own: what is open at once may be more than the heap holds."""
    conf = stream.sparkSession.conf
    own = conf.get(STORE, None)
    conf.set(STORE, own or ON_DISK)
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(upsert).start()
    finally:
        conf.set(STORE, own) if own else conf.unset(STORE)
    query.awaitTermination()


def stored(spark: SparkSession, stream: DataFrame, folder: str) -> DataFrame:
    """Runs the stream, in append mode, over what is there now; its result, as its batches and those of earlier runs have
    written it below folder, which driver and executors share. State ends with the watermark, which is why rows stay
    out that it hasn't passed yet. Every batch writes a folder of its own, so that one that is repeated leaves no trace."""

    def write(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/result/batch={n}")

    publish(stream, write, f"{folder}/checkpoint", "append")
    if not exists(spark, f"{folder}/result"):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).option("basePath", f"{folder}/result").parquet(f"{folder}/result").select(*stream.columns)


#: Later than any event: a row of this time takes the watermark past every window that is open.
END = datetime.datetime(9999, 1, 1)


def finished(spark: SparkSession, events: DataFrame, shape: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """`stored`, of events that are over: the windows that the watermark hasn't passed once all is read are closed and
    given out too. A row at END, of no user and no type, follows the events in a run of its own; its own window stays
    open. Events that arrive after that are late."""
    ends = f"{folder}/end"
    spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(ends)
    stream = shape(events.unionByName(read_events(spark, ends, "*.parquet")))
    stored(spark, stream, folder)
    spark.createDataFrame([(None, END, None, None, None, None)], SCHEMA).coalesce(1).write.mode("append").parquet(ends)
    return stored(spark, stream, folder)
