"""Player form from game logs in long shape: (player_id, stat, game_id, game_time, value).

Every function is one shuffle by (player_id, stat) at most for the order of the games; thresholds and windows are
exploded after that, in place. A player and stat with a missing value is left out whole, as a missing box score must
not count as a zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hardwood.functions import ratings

KEY = ["player_id", "stat"]
NEWEST = [F.desc, F.desc]


def unpivot_stats(logs: DataFrame, stats: dict[str, str], keys: list[str]) -> DataFrame:
    """Wide logs to long ones; stats maps names to columns. PRA is the sum of its parts, null if one is."""
    pra = logs.withColumn("_pra", F.col(stats["PTS"]) + F.col(stats["REB"]) + F.col(stats["AST"])) if {"PTS", "REB", "AST"} <= set(stats) else logs
    named = {**stats, **({"PRA": "_pra"} if "_pra" in pra.columns else {})}
    wide = pra.select(*keys, *(F.col(c).cast("double").alias(n) for n, c in named.items()))
    return wide.unpivot(keys, list(named), "stat", "value")


def complete(facts: DataFrame) -> DataFrame:
    """Facts of the players and stats without a missing value."""
    return facts.withColumn("_missing", F.max(F.col("value").isNull()).over(Window.partitionBy(*KEY))).where("not _missing").drop("_missing")


def numbered(facts: DataFrame) -> DataFrame:
    """Adds n_desc (1 is the newest game) and n_asc; games are ordered by time, then id."""
    w = Window.partitionBy(*KEY)
    return facts.withColumn("n_desc", F.row_number().over(w.orderBy(F.desc("game_time"), F.desc("game_id")))).withColumn("n_asc", F.count("*").over(w) - F.col("n_desc") + 1)


def with_thresholds(facts: DataFrame, thresholds: list[float] | dict[str, tuple]) -> DataFrame:
    """A row for each threshold of the stat."""
    if isinstance(thresholds, dict):
        grid = F.create_map(*[x for s, ts in thresholds.items() for x in (F.lit(s), F.array(*(F.lit(float(t)) for t in ts)))])
        return facts.withColumn("threshold", F.explode(F.element_at(grid, F.col("stat"))))
    return facts.withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))))


def current_streaks(facts: DataFrame, thresholds) -> DataFrame:
    """Games in a row, up to the newest, that reach the threshold; only where there is one at least.

    One row a game and threshold is aggregated; the start comes from the least n_desc that misses, which a window over
    the same key tells every row, so no history is gathered in an array."""
    f = with_thresholds(numbered(facts), thresholds)
    w = Window.partitionBy(*KEY, "threshold")
    miss = F.min(F.when(F.col("value") < F.col("threshold"), F.col("n_desc"))).over(w)
    own = f.withColumn("_miss", miss).where(F.col("_miss").isNull() | (F.col("n_desc") < F.col("_miss")))
    return own.groupBy(*KEY, "threshold").agg(F.count("*").alias("streak_games"), F.min("game_time").alias("start_time"), F.max("game_time").alias("end_time"))


def longest_streaks(facts: DataFrame, thresholds) -> DataFrame:
    """The longest run of games that reach the threshold, the earliest of equals; is_active if it includes the newest."""
    hits = with_thresholds(numbered(facts), thresholds).where(F.col("value") >= F.col("threshold"))
    w = Window.partitionBy(*KEY, "threshold")
    runs = hits.withColumn("_run", F.col("n_asc") - F.row_number().over(w.orderBy("n_asc")))
    runs = runs.groupBy(*KEY, "threshold", "_run").agg(F.count("*").alias("streak_games"), F.min("game_time").alias("start_time"), F.max("game_time").alias("end_time"), (F.min("n_desc") == 1).alias("is_active"))
    best = runs.withColumn("_r", F.row_number().over(w.orderBy(F.desc("streak_games"), "start_time"))).where("_r = 1")
    return best.select(*KEY, "threshold", "streak_games", "start_time", "end_time", "is_active")


def stat_windows(facts: DataFrame, thresholds, windows: tuple[int, ...]) -> DataFrame:
    """Over the newest games of each window: how many there are and how many reach the threshold."""
    f = numbered(facts).where(F.col("n_desc") <= max(windows))
    f = with_thresholds(f, thresholds).withColumn("window_size", F.explode(F.array(*map(F.lit, windows)))).where("n_desc <= window_size")
    return f.groupBy(*KEY, "threshold", "window_size").agg(F.count_if(F.col("value") >= F.col("threshold")).alias("games_hit"), F.count("*").alias("games_played"))


def heat_index(facts: DataFrame, windows: tuple[int, ...], min_games: int = 3, decimals: int = 4) -> DataFrame:
    """How far the mean of the newest games is from the mean of all, in standard deviations."""
    recent = [F.avg(F.when(F.col("n_desc") <= w, F.col("value"))).alias(f"_r{w}") for w in windows]
    one = numbered(facts).groupBy(*KEY).agg(F.count("*").alias("games"), F.avg("value").alias("_avg"), F.stddev_samp("value").alias("_sd"), *recent)
    one = one.where((F.col("games") >= min_games) & (F.col("_sd") > 0))
    out = one.select("*", F.explode(F.array(*(F.struct(F.lit(w).alias("window_size"), F.col(f"_r{w}").alias("recent")) for w in windows))).alias("_w"))
    z = (F.col("_w.recent") - F.col("_avg")) / F.col("_sd")
    return out.select(
        *KEY, F.col("_w.window_size").alias("window_size"), "games", F.round("_w.recent", decimals).alias("recent_avg"), F.round("_avg", decimals).alias("season_avg"),
        F.round("_sd", decimals).alias("season_sd"), F.round(z, decimals).alias("z_score"), ratings.heat_status(z).alias("status"),
    )


def consistency(facts: DataFrame, windows: tuple[int, ...] = (0, 10), min_games: int = 5, decimals: int = 4) -> DataFrame:
    """Spread of all games (window 0) and of the newest ones."""
    f = numbered(facts).withColumn("window_size", F.explode(F.array(*map(F.lit, windows)))).where("window_size = 0 or n_desc <= window_size")
    g = f.groupBy(*KEY, "window_size").agg(F.count("*").alias("games_played"), F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.median("value").alias("_med"))
    cv = F.when(F.col("_m") > 0, F.col("_s") / F.col("_m")).otherwise(0.0)
    return g.where(F.col("games_played") >= min_games).select(
        *KEY, "window_size", "games_played", F.round("_m", decimals).alias("mean"), F.round("_s", decimals).alias("sd"), F.round(cv, decimals).alias("cv"), "min_value", "max_value",
        F.round("_med", decimals).alias("median"), ratings.consistency_tier(cv).alias("tier"),
    )


def profile_class(consistency_rows: DataFrame, margin: int = 2) -> DataFrame:
    """Steady or volatile where one tier leads the other by more than the margin, over a player's stats and windows."""
    g = consistency_rows.groupBy("player_id").agg(F.count_if(F.col("tier") == "steady").alias("n_steady"), F.count_if(F.col("tier") == "volatile").alias("n_volatile"))
    label = F.when(F.col("n_steady") > F.col("n_volatile") + margin, "steady").when(F.col("n_volatile") > F.col("n_steady") + margin, "volatile").otherwise("mixed")
    return g.withColumn("profile", label)


def leaders(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows; the order has to be total."""
    return rows.orderBy(*order).limit(n)


def top_per_key(rows: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each key."""
    out = rows.withColumn(rank or "_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank or "_rank") <= n)
    return out if rank else out.drop("_rank")


def streak_scores(streaks: DataFrame, averages: DataFrame) -> DataFrame:
    """1000 if active + 100 for a current one + 100 threshold / average, or the bare threshold where there is no positive
    average, + a tenth of its length."""
    j = streaks.join(averages, KEY, "left")
    base = F.when(F.col("is_active"), 1000.0).otherwise(0.0) + F.when(F.col("kind") == "current", 100.0).otherwise(0.0)
    size = F.when(F.col("season_avg") > 0, F.lit(100.0) * F.col("threshold") / F.col("season_avg")).otherwise(F.col("threshold"))
    return j.withColumn("rank_score", F.round(base + size + F.col("streak_games") * 0.1, 4))


def window_scores(windows: DataFrame, averages: DataFrame) -> DataFrame:
    """Threshold, up to 100, + 50 hit rate + 10 for ten games. The threshold counts 50 times its share of the average, or
    three times itself where there is no positive average. Without a hit a row goes; under a fifth of hits it stays only
    up to one and a half times the average."""
    rate = F.when(F.col("games_played") > 0, F.col("games_hit") / F.col("games_played")).otherwise(0.0)
    j = windows.join(averages, KEY, "left")
    known = F.coalesce(F.col("season_avg") > 0, F.lit(False))
    keep = (rate > 0) & ((rate >= 0.2) | (known & (F.col("threshold") <= F.col("season_avg") * 1.5)))
    size = F.least(F.when(known, F.lit(50.0) * F.col("threshold") / F.col("season_avg")).otherwise(F.col("threshold") * 3), F.lit(100.0))
    return j.where(keep).withColumn("rank_score", F.round(size + rate * 50 + F.when(F.col("window_size") == 10, 10.0).otherwise(0.0), 4))


def meaningful_bests(streaks: DataFrame, averages: DataFrame) -> DataFrame:
    """Season bests worth a line: five games or more, or a threshold of at least 0.8 of the average, or, without one, of
    the stat's least value."""
    least = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ratings.LEAST_BEST.items() for x in (kv[0], float(kv[1]))]), F.col("stat")), F.lit(5.0))
    j = streaks.join(averages, KEY, "left")
    known = F.coalesce(F.col("season_avg") > 0, F.lit(False))
    return j.where((F.col("streak_games") >= 5) | F.when(known, F.col("threshold") >= F.col("season_avg") * 0.8).otherwise(F.col("threshold") >= least))


def season_averages(heat: DataFrame) -> DataFrame:
    """(player_id, stat, season_avg) of heat rows: the value of the smallest window, as all windows have the same."""
    return heat.groupBy(*KEY).agg(F.min_by("season_avg", "window_size").alias("season_avg"))


def streaks_by_stat(streaks: DataFrame, least: int, n: int) -> DataFrame:
    """(stat, streaks): the n longest streaks of each stat with `least` games or more, as a list, longest first."""
    top = top_per_key(streaks.where(F.col("streak_games") >= least), ["stat"], [F.desc("streak_games"), "player_id", "threshold"], n, "_place")
    return top.groupBy("stat").agg(F.array_sort(F.collect_list(F.struct("_place", "player_id", "threshold", "streak_games"))).alias("_l")).select("stat", F.transform("_l", lambda x: F.struct(x["player_id"], x["threshold"], x["streak_games"])).alias("streaks"))
