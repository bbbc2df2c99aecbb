"""Team games from both sides: pairing, sum ratios, strength of schedule, flags and matchup environments.

A game has two rows (game_id, season, game_date, team_id, opponent_team_id, is_home, box score). The opponent's box is
added in one shuffle by game; everything after that is one shuffle by team.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hardwood.functions import ratings

OWN = ("fg", "fga", "fg3", "fta", "oreb", "tov", "pts")
OPPONENT = ("fga", "fta", "oreb", "dreb", "tov", "pts")
METRICS = ("off_rtg", "def_rtg", "net_rtg", "pace", "efg", "tov_pct", "orb_pct", "ftr", "pct_pts_3pt")
#: Shares of the points, where the box scores split them.
OLDER_METRICS = ("pct_pts_paint", "pct_pts_fb")


def with_opponent(games: DataFrame) -> DataFrame:
    """Adds the opponent's box as o_*; rows whose opponent isn't there or doesn't answer to them get nulls. One shuffle by
    game, whose few rows meet; games that have the columns already stay as they are."""
    if all(f"o_{c}" in games.columns for c in OPPONENT):
        return games
    g = games.groupBy("game_id").agg(F.collect_list(F.struct(*games.columns)).alias("_rows")).select("_rows", F.explode("_rows").alias("_own"))
    other = F.get(F.filter("_rows", lambda r: (r["team_id"] == F.col("_own.opponent_team_id")) & (r["opponent_team_id"] == F.col("_own.team_id"))), F.lit(0))
    g = g.withColumn("_other", other)
    return g.select("_own.*", *(F.col(f"_other.{c}").alias(f"o_{c}") for c in OPPONENT))


def missing_fields() -> Column:
    """Names of the needed fields that are null, as an array; empty for a usable game."""
    return F.array_compact(F.array(*(F.when(F.col(c).isNull(), c) for c in [*OWN, *(f"o_{x}" for x in OPPONENT)])))


def usable(pairs: DataFrame) -> DataFrame:
    return pairs.dropna(subset=[*OWN, *(f"o_{c}" for c in OPPONENT)])


def ratio_metrics(when: Column | None = None, decimals: int = 4, older: bool = False) -> dict[str, Column]:
    """Metrics as ratios of sums, over the rows where `when` holds."""

    def s(c: Column) -> Column:
        return F.sum(c if when is None else F.when(when, c))

    own = s(ratings.possessions(F.col("fga"), F.col("fta"), F.col("oreb"), F.col("tov"))) / 100
    opp = s(ratings.possessions(F.col("o_fga"), F.col("o_fta"), F.col("o_oreb"), F.col("o_tov"))) / 100
    fga, fta, tov, oreb, fg3, pts = (s(F.col(c)) for c in ("fga", "fta", "tov", "oreb", "fg3", "pts"))
    games = F.count("*") if when is None else F.count_if(when)
    off, against = ratings.safe_ratio(pts, own) * 100, ratings.safe_ratio(s(F.col("o_pts")), opp) * 100
    found = {
        "off_rtg": off, "def_rtg": against, "net_rtg": off - against, "pace": ratings.safe_ratio(own, games), "efg": ratings.safe_ratio(s(F.col("fg") + 0.5 * F.col("fg3")), fga),
        "tov_pct": ratings.safe_ratio(tov, fga + 0.44 * fta + tov), "orb_pct": ratings.safe_ratio(oreb, oreb + s(F.col("o_dreb"))), "ftr": ratings.safe_ratio(fta, fga),
        "pct_pts_3pt": ratings.safe_ratio(3 * fg3, pts),
    }
    if older:
        found |= {"pct_pts_paint": ratings.safe_ratio(s(F.col("paint")), pts), "pct_pts_fb": ratings.safe_ratio(s(F.col("fb")), pts)}
    return {k: F.round(v, decimals) for k, v in found.items()}


def newest_first(games: DataFrame, keys: tuple[str, ...] = ("team_id",)) -> DataFrame:
    return games.withColumn("n_desc", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("game_date"), F.desc("game_id"))))


def season_and_recent(games: DataFrame, window: int = 10, older: bool = False, decimals: int = 4) -> DataFrame:
    """One row a team: every metric over all games, over the last `window` played ones, and the difference.

    The window counts played games; unusable ones among them are then left out."""
    pairs = newest_first(with_opponent(games))
    counts = [F.count("*").alias("season_games"), F.count_if(F.col("n_desc") <= window).alias("recent_games")]
    season, lastn = ratio_metrics(None, decimals, older), ratio_metrics(F.col("n_desc") <= window, decimals, older)
    g = usable(pairs).groupBy("team_id").agg(*counts, *(v.alias(f"{k}_season") for k, v in season.items()), *(v.alias(f"{k}_lastn") for k, v in lastn.items()))
    return g.withColumns({f"{m}_delta": F.round(F.col(f"{m}_lastn") - F.col(f"{m}_season"), decimals) for m in season})


def filled_recent(games: DataFrame, window: int = 10, decimals: int = 4) -> DataFrame:
    """The older form of the last games' metrics: missing box values count as 0, and a team needs a full window."""
    pairs = newest_first(with_opponent(games)).where(F.col("n_desc") <= window)
    pairs = pairs.na.fill(0, [*OWN, "dreb", *(f"o_{c}" for c in OPPONENT)])
    return pairs.groupBy("team_id").agg(F.count("*").alias("recent_games"), *(v.alias(k) for k, v in ratio_metrics(None, decimals).items())).where(F.col("recent_games") >= window)


def strength_of_schedule(games: DataFrame, window: int = 10, decimals: int = 4) -> DataFrame:
    """Mean season net rating of the opponents met, over all games and over the last ones; repeats count each time.

    Ratings are rounded and summed as whole numbers, so that the order of the rows can't change a mean."""
    pairs = newest_first(with_opponent(games))
    net = usable(pairs).groupBy("team_id").agg(ratio_metrics(None, decimals)["net_rtg"].alias("net"))
    met = pairs.select("team_id", "opponent_team_id", "n_desc").join(net.withColumnRenamed("team_id", "opponent_team_id"), "opponent_team_id")
    whole = F.round(F.col("net") * 10**decimals).cast("long")

    def mean(x: Column) -> Column:
        return F.sum(x) / (F.count(x) * F.lit(float(10**decimals)))

    out = met.groupBy("team_id").agg(mean(whole).alias("sos_net_season"), mean(F.when(F.col("n_desc") <= window, whole)).alias("sos_net_lastn"))
    return out.withColumn("sos_net_delta", F.col("sos_net_lastn") - F.col("sos_net_season"))


def flags(metrics: DataFrame, older: bool = False, keys: tuple[str, ...] = ("team_id",)) -> DataFrame:
    """(keys, flag, metric, delta, threshold, severity, details): the rules that a team's deltas meet, inclusively. Rules
    are literals: no join. details: JSON of delta, threshold, metric and the two values."""
    rules = [
        F.struct(F.lit(n).alias("flag"), F.lit(m).alias("metric"), F.col(f"{m}_delta").alias("delta"), F.lit(t).alias("threshold"), F.lit(s).alias("side"), F.col(f"{m}_season").alias("season_value"), F.col(f"{m}_lastn").alias("lastn_value"))
        for n, m, t, s in (*ratings.FLAG_RULES, *(ratings.OLDER_FLAG_RULES if older else ()))
    ]
    r = metrics.select(*keys, F.explode(F.array(*rules)).alias("r")).select(*keys, "r.*").where(F.col("delta") * F.col("side") >= F.col("threshold") * F.col("side"))
    details = F.to_json(F.struct("delta", "threshold", F.concat("metric", F.lit("_delta")).alias("metric"), "season_value", "lastn_value"))
    return r.withColumn("severity", F.abs("delta")).withColumn("details", details).drop("side", "season_value", "lastn_value")


def flag_names(metric: str = "{}_delta") -> Column:
    """The flags that a row's deltas meet, as an array in the order of the rules; metric: how its columns are named."""
    rules = ((n, F.col(metric.format(m)) * s >= F.lit(t) * s) for n, m, t, s in ratings.FLAG_RULES)
    return F.array_compact(F.array(*(F.when(c, n) for n, c in rules)))


def completeness(games: DataFrame, window: int = 10) -> DataFrame:
    """(team_id, played, used, status): complete if the window is full and nothing had to be left out."""
    pairs = newest_first(with_opponent(games)).withColumn("_bad", F.size(missing_fields()) > 0)
    g = pairs.groupBy("team_id").agg(F.count("*").alias("played"), F.count_if(~F.col("_bad")).alias("used"), F.count_if(F.col("n_desc") <= window).alias("_w"))
    return g.withColumn("status", F.when((F.col("_w") == window) & (F.col("played") == F.col("used")), "complete").otherwise("partial")).drop("_w")


def pair_sides(games: DataFrame, columns: list[str]) -> DataFrame:
    """One row a game with home_* and away_* of the columns; games without exactly one of each are left out."""
    g = games.groupBy("game_id").agg(
        F.count("*").alias("_n"), F.count_if("is_home").alias("_h"), *(F.max(F.when(F.col("is_home"), F.col(c))).alias(f"home_{c}") for c in columns), *(F.max(F.when(~F.col("is_home"), F.col(c))).alias(f"away_{c}") for c in columns)
    )
    return g.where("_n = 2 and _h = 1").drop("_n", "_h")


def environments(sides: DataFrame, older: bool = False, decimals: int = 2) -> DataFrame:
    """From home_/away_ off_rtg, def_rtg, pace, tov_pct and pct_pts_3pt: indices and tags of each matchup. Without one of
    the first four there are none; without the last no three_env_index. older: tags of paint, boards and fouls too, and
    turnovers may be missing."""
    h, a = (lambda c: F.col(f"home_{c}")), (lambda c: F.col(f"away_{c}"))
    there = F.lit(True)
    for c in ("off_rtg", "def_rtg", "pace", *(() if older else ("tov_pct",))):
        there = there & h(c).isNotNull() & a(c).isNotNull()
    e = sides.withColumn("pace_projection", F.when(there, F.round(ratings.pace_projection(h("pace"), a("pace")), decimals)))
    e = e.withColumn("scoring_env_index", F.round(ratings.scoring_env_index(h("off_rtg"), h("def_rtg"), a("off_rtg"), a("def_rtg"), F.col("pace_projection")), decimals))
    e = e.withColumn("three_env_index", F.when(there, F.round(ratings.three_env_index(h("pct_pts_3pt"), a("pct_pts_3pt")), decimals))).withColumn("chaos_index", F.round(ratings.chaos_index(F.col("pace_projection"), h("tov_pct"), a("tov_pct"), older), decimals))
    means = [(h(c) + a(c)) / 2 for c in ("pct_pts_paint", "orb_pct", "ftr")] if older else []
    return e.withColumn("tags", ratings.environment_tags(F.col("pace_projection"), F.col("scoring_env_index"), F.col("three_env_index"), F.col("chaos_index"), *means))


def records(games: DataFrame, keys: list[str]) -> DataFrame:
    """Wins and losses at home, away and in all, and the share won."""
    won = F.col("result") == "W"
    g = games.groupBy(*keys).agg(
        F.count_if(won).alias("wins"), F.count_if(~won).alias("losses"), F.count_if(won & F.col("is_home")).alias("home_wins"), F.count_if(~won & F.col("is_home")).alias("home_losses"),
        F.count_if(won & ~F.col("is_home")).alias("away_wins"), F.count_if(~won & ~F.col("is_home")).alias("away_losses"),
    )
    return g.withColumn("w_pct", F.round(F.col("wins") / (F.col("wins") + F.col("losses")), 4))
