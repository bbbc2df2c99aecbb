"""Keyed merges as one plan, and Parquet tables that Spark itself overwrites by partition."""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Natural keys of the stored tables, columns that keep their first value, and the partition column; fixed values.
TABLES = {
    "gamelogs": (("player_id", "game_id"), (), "season"),
    "team_game_stats": (("game_id", "team_id"), (), "season"),
    "streaks": (("player_id", "stat", "threshold", "season", "streak_kind"), (), "season"),
    "stat_windows": (("player_id", "stat", "threshold", "season", "window_size"), (), "season"),
    "heat_index": (("player_id", "stat", "season", "window_size"), (), "season"),
    "consistency": (("player_id", "season", "stat", "window_size"), (), "season"),
    "team_metrics": (("stat_date", "team_id", "window_size"), (), "season"),
    "team_flags": (("stat_date", "team_id", "flag_type"), (), "season"),
    "game_environment": (("game_id", "game_date"), (), "season"),
    "schedule_factors": (("game_id", "team_id"), (), "season"),
    "game_odds": (("game_id", "sportsbook_id"), ("recorded_at",), "season"),
    "player_game_status": (("game_id", "player_id"), ("recorded_at",), "season"),
    "roster": (("team_id", "player_id", "season"), (), "season"),
    "team_feature_snapshots": (("game_id", "team_id", "window_size", "feature_as_of", "calculation_version"), ("created_at",), "season"),
    "environment_snapshots": (("game_id", "window_size", "feature_as_of", "calculation_version"), ("created_at",), "season"),
}


def last_of_batch(rows: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The last row of each key by the sequence column; nulls stay nulls."""
    w = Window.partitionBy(*keys).orderBy(F.desc(sequence))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def merged(existing: DataFrame, incoming: DataFrame, keys: list[str], preserve: tuple[str, ...] = (), sequence: str | None = None) -> DataFrame:
    """existing with incoming rows instead of those of equal key; `preserve` columns keep their first value.

    One aggregation by key. Of incoming rows that share a key the last counts, by the column `sequence` if there is one,
    else the largest by all columns; so it does for existing rows. Null keys are equal to each other."""
    columns = existing.columns
    order = F.col(sequence) if sequence else F.lit(0)
    e = existing.select(*keys, F.lit(False).alias("_new"), F.lit(None).cast(incoming.select(order.alias("o")).schema["o"].dataType).alias("_order"), F.struct(*columns).alias("_row"))
    i = incoming.select(*keys, F.lit(True).alias("_new"), order.alias("_order"), F.struct(*(F.col(c).cast(existing.schema[c].dataType).alias(c) for c in columns)).alias("_row"))
    best = F.max_by("_row", F.struct("_new", "_order", "_row"))
    first = {c: F.max_by(F.col(f"_row.{c}"), F.when(~F.col("_new") & F.col(f"_row.{c}").isNotNull(), F.col("_row"))) for c in preserve}
    g = e.unionByName(i).groupBy(*(F.col(k).alias(f"_k_{k}") for k in keys)).agg(best.alias("_best"), *(v.alias(f"_first_{c}") for c, v in first.items()))
    return g.select(*(F.coalesce(F.col(f"_first_{c}"), F.col(f"_best.{c}")).alias(c) if c in preserve else F.col(f"_best.{c}").alias(c) for c in columns))


def merged_table(name: str, existing: DataFrame, incoming: DataFrame, sequence: str | None = None) -> DataFrame:
    """`merged` by the contract of a stored table."""
    keys, preserve, _ = TABLES[name]
    return merged(existing, incoming, list(keys), preserve, sequence)


def classified(existing: DataFrame, incoming: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, change): inserted, removed, updated or unchanged."""
    e = existing.select(*keys, F.struct(*values).alias("_e"))
    i = incoming.select(*keys, F.struct(*values).alias("_i"))
    change = F.when(F.col("_e").isNull(), "inserted").when(F.col("_i").isNull(), "removed").when(~F.col("_e").eqNullSafe(F.col("_i")), "updated").otherwise("unchanged")
    return e.join(i, keys, "full").select(*keys, change.alias("change"))


def reconciled_roster(existing: DataFrame, incoming: DataFrame, scope: list[str], key: str) -> DataFrame:
    """existing with the scopes (such as team and season) that incoming has replaced by its rows; of these, rows that
    incoming lacks go. An empty incoming frame replaces nothing."""
    stays = existing.join(incoming.select(*scope).distinct(), scope, "left_anti")
    return stays.unionByName(incoming.dropDuplicates([*scope, key]).select(*existing.columns))


def deduplicated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each whole key, the smallest by all columns."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in rows.columns])
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def retained(rows: DataFrame, seasons: list[str]) -> DataFrame:
    return rows.where(F.col("season").isin(seasons))


def latest_seasons(rows: DataFrame, n: int = 10) -> DataFrame:
    """Rows of the n latest seasons; the seasons, a few, are ranked and joined back."""
    seasons = rows.select("season").where("season is not null").distinct().orderBy(F.desc("season")).limit(n)
    return rows.join(F.broadcast(seasons), "season", "left_semi")


def cleaned(rows: DataFrame, keys: list[str], defaults: dict[str, object], names: list[str] = [], seasons: int = 10) -> DataFrame:  # noqa: B006
    """The cleanup of a stored table: one row a key, names in title case, defaults for nulls, the latest seasons only."""
    one = deduplicated(rows, keys)
    one = one.select(*(F.initcap(F.trim(c)).alias(c) if c in names else F.col(c) for c in one.columns)).na.fill(defaults)
    return latest_seasons(one, seasons)


class Cleanup(NamedTuple):
    """How a stored table is cleaned: its key, columns of names, its season column, and whether missing numbers are zeros."""

    key: tuple[str, ...]
    names: tuple[str, ...] = ()
    season: str | None = "season"
    zeros: bool = True
    texts: tuple[tuple[str, str], ...] = ()


#: The tables that are cleaned.
CLEANUPS = {
    "players": Cleanup(("player_id",), ("name",), None, False),
    "statistics": Cleanup(("player_id", "season_year"), (), "season_year"),
    "game_schedule": Cleanup(("game_id", "team_id"), zeros=False),
    "team_game_stats": Cleanup(("game_id", "team_id")),
    "gamelogs": Cleanup(("player_id", "game_id"), texts=(("minutes_played", "00:00"),)),
    "player_dashboards": Cleanup(("player_id", "season"), ("player_name",)),
    "player_streaks": Cleanup(("player_id", "stat", "season", "threshold")),
    "team_dashboards": Cleanup(("team_id", "season", "season_type")),
}


def cleaned_table(name: str, rows: DataFrame, seasons: int = 10) -> DataFrame:
    """`cleaned` by the rules of a table: where numbers are zeros, that holds for all of its numbers but keys and ids."""
    c = CLEANUPS[name]
    numbers = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in c.key and not f.name.endswith("_id")]
    one = deduplicated(rows, list(c.key))
    one = one.select(*(F.initcap(F.trim(x)).alias(x) if x in c.names else F.col(x) for x in one.columns)).na.fill({x: 0 for x in numbers if c.zeros} | dict(c.texts))
    if c.season is None:
        return one
    return latest_seasons(one.withColumnRenamed(c.season, "season"), seasons).withColumnRenamed("season", c.season).select(*rows.columns)


# -- stored tables ---------------------------------------------------------------------------------------------------


def replace_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Writes rows over the partitions of `by` that they have; all others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def upsert(incoming: DataFrame, path: str, keys: list[str], by: str, preserve: tuple[str, ...] = (), sequence: str | None = None) -> None:
    """Merges rows into a Parquet table that is partitioned by `by`, one of its keys; a missing table is made.

    Only the partitions of incoming rows are read and written; null is a partition too, and empty text is stored as null,
    as folders have no empty name. The table is read with the types
    of the incoming rows, as folder names don't tell "01" from 1. The merged rows are first written beside the table, so
    that a run that stops there leaves the table as it was, and running it again gives the same table."""
    spark, staging = incoming.sparkSession, f"{path.rstrip('/')}-staging-{uuid.uuid4().hex}"
    if by not in keys:
        raise ValueError("rows of one key have to lie in one partition")
    if isinstance(incoming.schema[by].dataType, T.StringType):
        incoming = incoming.withColumn(by, F.nullif(by, F.lit("")))
    new = incoming
    if exists(spark, path):
        old = spark.read.schema(incoming.schema).parquet(path)
        parts = incoming.select(F.col(by).alias("_by")).distinct()
        touched = old.join(parts, old[by].eqNullSafe(parts["_by"]), "left_semi")
        new = merged(touched.select(*incoming.columns), incoming, keys, preserve, sequence)
    else:
        new = merged(incoming.limit(0), incoming, keys, preserve, sequence)
    new.write.parquet(staging)
    replace_partitions(spark.read.schema(new.schema).parquet(staging), path, by)
    p = spark._jvm.org.apache.hadoop.fs.Path(staging)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def write_marker(spark: SparkSession, path: str, fields: dict[str, str]) -> None:
    """A small JSON file that appears whole: written beside its place, then renamed over what is there, in one step where
    the file system has one."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    draft, place = hadoop.Path(f"{path}.next-{uuid.uuid4().hex}"), hadoop.Path(path)
    out = place.getFileSystem(conf).create(draft, True)
    out.write(bytearray(json.dumps(fields).encode()))
    out.close()
    options = spark._sc._gateway.new_array(getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
    options[0] = getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(place.toUri(), conf).rename(draft, place, options)
