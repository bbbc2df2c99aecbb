"""As-of reads and the rankings that pages are built from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hardwood.functions import ratings
from hardwood.operators import form


def as_of(snapshots: DataFrame, keys: list[str], cutoff: Column | str, complete_only: bool = True) -> DataFrame:
    """The newest snapshot of each key that was known at the cutoff: feature_as_of and data_available_at not after it.

    It never falls forward to a later snapshot."""
    cut = F.lit(cutoff).cast("timestamp") if isinstance(cutoff, str) else cutoff
    known = (F.col("feature_as_of") <= cut) & (F.col("data_available_at") <= cut)
    s = snapshots.where(known & (F.col("status") == "complete") if complete_only else known)
    w = Window.partitionBy(*keys).orderBy(F.desc("feature_as_of"), F.desc("data_available_at"))
    return s.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, known: str, columns: list[str], strict: bool = True) -> DataFrame:
    """left with the columns of the newest right row of its key whose `known` is before (or at) left's `at`.

    Both sides are one stream ordered by time within the key; the last right row is carried forward. One shuffle by
    key, no row is multiplied. Right rows of equal time: the one with the largest columns."""
    carried = F.struct(F.col(known).alias("_t"), *(F.col(c) for c in columns))
    r = right.groupBy(*keys, F.col(known).alias("_time")).agg(F.max(carried).alias("_right")).withColumn("_left", F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType))
    lf = left.select(*keys, F.col(at).alias("_time"), F.lit(None).cast(r.schema["_right"].dataType).alias("_right"), F.struct("*").alias("_left"))
    # At equal times a left row comes first if the right one has to be strictly before it.
    first = F.col("_left").isNull() if strict else F.col("_left").isNotNull()
    w = Window.partitionBy(*keys).orderBy("_time", first).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = lf.unionByName(r.select(*lf.columns))
    out = both.withColumn("_found", F.last("_right", ignorenulls=True).over(w)).where("_left is not null")
    return out.select("_left.*", *(F.col(f"_found.{c}").alias(c) for c in columns))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def latest_with_ties(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """All rows of each key that have its largest value."""
    return rows.withColumn("_r", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(column)))).where("_r = 1").drop("_r")


def pinned(anchor: DataFrame, families: dict[str, DataFrame], at: str = "feature_as_of") -> dict[str, DataFrame]:
    """Every family cut to the anchor's newest snapshot time: one row, joined by broadcast."""
    point = anchor.agg(F.max(at).alias(at))
    return {name: f.join(F.broadcast(point), at, "left_semi") for name, f in families.items()}


#: The tiers and windows of heat that are worth a line, and the least streak and hit rate.
NOTABLE_TIERS, NOTABLE_WINDOWS, LEAST_STREAK, LEAST_HITS = ("on_fire", "heating_up", "ice_cold", "cooling_off"), (3, 5, 10), 3, 70


def _listed(rows: DataFrame, order: list[Column], columns: list[str], n: int, name: str) -> DataFrame:
    """player_id, n_<name> (rows in all) and <name> (the first n of them, in order)."""
    w = Window.partitionBy("player_id")
    r = rows.withColumns({"_place": F.row_number().over(w.orderBy(*order)), "_all": F.count("*").over(w)}).where(F.col("_place") <= n)
    r = r.groupBy("player_id").agg(F.max("_all").alias(f"n_{name}"), F.array_sort(F.collect_list(F.struct("_place", *columns))).alias("_l"))
    return r.select("player_id", f"n_{name}", F.transform("_l", lambda x: F.struct(*(x[c].alias(c) for c in columns))).alias(name))


def callouts(players: DataFrame, heat: DataFrame, streaks: DataFrame, windows: DataFrame, consistency: DataFrame, injuries: DataFrame, k: int = 5) -> DataFrame:
    """The k most notable players of each team: player_id, team_id, score, position, consistency_tier and the lists heat
    (the three largest |z|), streaks and windows (three of each), injuries (two).

    Score: 10 a current streak of three games or more, |z| of the first three notable heats by stat and window, 2 a
    window of ten games with 70 % hits. Players without a score stay if they are injured.

    injuries: player_id, game_date, description."""
    h = heat.withColumn("tier", ratings.heat_tier(F.col("z_score"))).where(F.col("tier").isin(*NOTABLE_TIERS) & F.col("window_size").isin(*NOTABLE_WINDOWS)).withColumn("z", F.abs("z_score"))
    first = _listed(h, ["stat", "window_size"], ["z"], 3, "first").select("player_id", F.aggregate("first", F.lit(0.0), lambda a, x: a + x["z"]).alias("z_sum"))
    largest = _listed(h, [F.desc("z"), F.asc("stat"), F.asc("window_size")], ["stat", "window_size", "z_score", "tier"], 3, "heat").drop("n_heat")
    s = _listed(streaks.where(F.col("streak_games") >= LEAST_STREAK), ["stat", "threshold"], ["stat", "threshold", "streak_games"], 3, "streaks")
    w = windows.where((F.col("window_size") == 10) & (F.col("games_hit") * 100 >= F.col("games_played") * LEAST_HITS))
    w = _listed(w, ["stat", "threshold"], ["stat", "threshold", "games_hit", "games_played"], 3, "windows")
    i = _listed(injuries, [F.desc("game_date"), F.asc("description")], ["game_date", "description"], 2, "injuries")
    c = form.profile_class(consistency, margin=1).select("player_id", F.col("profile").alias("consistency_tier"))
    p = players
    for part in (first, largest, s, w, i, c):
        p = p.join(part, "player_id", "left")
    score = F.coalesce("n_streaks", F.lit(0)) * 10 + F.coalesce("z_sum", F.lit(0.0)) + F.coalesce("n_windows", F.lit(0)) * 2
    p = p.withColumns({"score": F.round(score, 4), "consistency_tier": F.coalesce("consistency_tier", F.lit("mixed"))}).where((F.col("score") > 0) | F.col("n_injuries").isNotNull())
    p = p.withColumn("position", F.row_number().over(Window.partitionBy("team_id").orderBy(F.desc("score"), "player_id"))).where(F.col("position") <= k)
    return p.select(*players.columns, "score", "position", "consistency_tier", "heat", "streaks", "windows", "injuries")


def consensus_odds(odds: DataFrame, country: str = "US") -> DataFrame:
    """By game, over the rows of one country: how many there are, the mean prices (those that are there and not zero), the
    mean spread (zero is one), and the names of the books in order, joined by commas."""

    def mean(c, n):
        return F.round(F.avg(F.when(F.col(c) != 0, F.col(c))), n)

    return odds.where(F.col("country_code") == country).groupBy("game_id").agg(
        mean("home_odds", 3).alias("home_odds"), mean("away_odds", 3).alias("away_odds"), F.round(F.avg("home_spread"), 1).alias("home_spread"), F.count("*").alias("n_books"),
        F.array_join(F.array_sort(F.collect_list("sportsbook_name")), ",").alias("books"),
    )


def primary_book(odds: DataFrame) -> DataFrame:
    """One book a game: the first with a spread, by name, else the first."""
    w = Window.partitionBy("game_id").orderBy(F.col("home_spread").isNull(), "sportsbook_id", "home_odds")
    return odds.withColumn("_r", F.row_number().over(w)).withColumn("n_books", F.count("*").over(Window.partitionBy("game_id"))).where("_r = 1").drop("_r")


def tiers(heat: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Players by five-tier heat, each of the tiers that have a cap cut to it by distance from the middle.

    The largest cap is a plain bound, up to which each task cuts its own rows before the tiers are brought together."""
    t = heat.withColumn("tier", ratings.heat_tier(F.col("z_score"))).where(F.col("tier").isin(*caps))
    w = Window.partitionBy("tier").orderBy(F.desc(F.abs("z_score")), "player_id", "stat", "window_size")
    cap = F.element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col("tier"))
    most = t.withColumn("position", F.row_number().over(w)).where(F.col("position") <= max(caps.values(), default=0))
    return most.where(F.col("position") <= cap)


def compare(left: DataFrame, right: DataFrame, stats: dict[str, float]) -> DataFrame:
    """Two players' averages by stat, capped and scaled to 100."""
    cap = F.element_at(F.create_map(*[F.lit(x) for kv in stats.items() for x in kv]), F.col("stat"))
    j = left.select("stat", F.col("season_avg").alias("a")).join(right.select("stat", F.col("season_avg").alias("b")), "stat", "full")
    return j.select("stat", *(F.round(F.least(F.col(c), cap) / cap * 100, 4).alias(f"{c}_scaled") for c in ("a", "b")), "a", "b")


def text_report(rows: DataFrame, key: str, line: Column, order: list[str]) -> DataFrame:
    """One text a key: its lines in order."""
    g = rows.withColumn("_line", line).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, "_line"))).alias("_l"))
    return g.select(key, F.array_join(F.transform("_l", lambda x: x["_line"]), "\n").alias("report"))


# -- availability ----------------------------------------------------------------------------------------------------


def injury_summary(status: DataFrame) -> DataFrame:
    """By date: injuries, teams affected, and the injured of each team as lists sorted by name.

    status: game_date, team_id, player_id, player_name, not_playing_reason, not_playing_description."""
    hurt = status.where(ratings.is_injured(F.col("not_playing_reason")))
    team = hurt.groupBy("game_date", "team_id").agg(F.array_sort(F.collect_list(F.struct("player_name", "player_id", F.col("not_playing_description").alias("description")))).alias("players"))
    return team.groupBy("game_date").agg(F.sum(F.size("players")).alias("total_injuries"), F.count("*").alias("teams_affected"), F.array_sort(F.collect_list(F.struct("team_id", "players"))).alias("by_team"))


def injury_history(status: DataFrame, season: str | None = None) -> DataFrame:
    """Injuries by player, each numbered from the newest."""
    hurt = status.where(ratings.is_injured(F.col("not_playing_reason")))
    hurt = hurt if season is None else hurt.where(F.col("season") == season)
    return hurt.withColumn("n_desc", F.row_number().over(Window.partitionBy("player_id").orderBy(F.desc("game_date"), F.desc("game_id"))))


def current_injuries(status: DataFrame) -> DataFrame:
    """Each player's injuries on the newest date on which they had one."""
    return latest_with_ties(injury_summary_rows(status), ["player_id"], "game_date")


def injury_summary_rows(status: DataFrame) -> DataFrame:
    return status.where(ratings.is_injured(F.col("not_playing_reason")))


# -- pages -----------------------------------------------------------------------------------------------------------


def featured(games: DataFrame, n: int = 3) -> DataFrame:
    """The first n games of each date that aren't final, filled up with final ones; `place` orders a date's games."""
    w = Window.partitionBy("game_date").orderBy(F.col("status") == "Final", "place")
    return games.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def roster_of_season(roster: DataFrame, teams: DataFrame, season: str) -> DataFrame:
    """Each team's roster of a season, or, for teams without one, the rows filed under its year."""
    r = roster.join(teams.select("team_id").distinct(), "team_id", "left_semi").where(F.col("season").isin(season, season[:4]))
    best = F.max(F.col("season") == season).over(Window.partitionBy("team_id"))
    return r.withColumn("_best", best).where((F.col("season") == season) == F.col("_best")).drop("_best")


def slate_streaks(games: DataFrame, roster: DataFrame, streaks: DataFrame) -> DataFrame:
    """The streaks of all players of both teams of each game. games: game_id, home_team_id, away_team_id."""
    sides = games.select("game_id", F.explode(F.array(F.struct(F.col("home_team_id").alias("team_id"), F.lit("H").alias("side")), F.struct(F.col("away_team_id").alias("team_id"), F.lit("A").alias("side")))).alias("s")).select("game_id", "s.*")
    return sides.join(roster.select("team_id", "player_id"), "team_id").join(streaks, "player_id")


def slate_context(matchups: DataFrame, environments: DataFrame, rest: DataFrame, odds: DataFrame, flags: DataFrame, metrics: DataFrame | None = None, called: DataFrame | None = None, hurt: DataFrame | None = None) -> DataFrame:
    """Matchups with their environment, both sides' rest, flags, metrics, callouts and injuries, and the odds; what is
    missing is null.

    rest: game_id, team_id, days_rest, rest_edge. flags: team_id, flags (array). metrics: team_id and its columns, which
    get the side's name in front. called: rows of `callouts`. hurt: team_id, player_id, description."""
    out = matchups.join(environments, "game_id", "left").join(odds, "game_id", "left")
    for side in ("home", "away"):
        own = rest.select("game_id", F.col("team_id").alias(f"{side}_team_id"), F.col("days_rest").alias(f"{side}_rest"), F.col("rest_edge").alias(f"{side}_edge"))
        out = out.join(own, ["game_id", f"{side}_team_id"], "left").join(flags.select(F.col("team_id").alias(f"{side}_team_id"), F.col("flags").alias(f"{side}_flags")), f"{side}_team_id", "left")
    lists = {"callouts": (called, ["position", "player_id", "score", "consistency_tier"]), "injuries": (hurt, ["player_id", "description"])}
    for side in ("home", "away"):
        key = F.col("team_id").alias(f"{side}_team_id")
        if metrics is not None:
            out = out.join(metrics.select(key, *(F.col(c).alias(f"{side}_{c}") for c in metrics.columns if c != "team_id")), f"{side}_team_id", "left")
        for name, (rows, columns) in lists.items():
            if rows is not None:
                out = out.join(rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(f"{side}_{name}")), f"{side}_team_id", "left")
    return out


def matchup_logs(logs: DataFrame) -> DataFrame:
    """Game logs as a matchup page shows them: missing counts are 0, minutes one decimal, the result from the scores where
    it is neither W nor L, and the score as text."""
    count = [F.coalesce(c, F.lit(0)).alias(c) for c in ("points", "assists", "rebounds", "steals", "blocks", "turnovers")]
    mine, theirs = F.coalesce("team_score", F.lit(0)), F.coalesce("opponent_score", F.lit(0))
    own, other = F.coalesce("team_abbreviation", F.lit("TEAM")), F.coalesce("opponent_abbreviation", F.lit("OPP"))
    result = F.when(F.col("result").isin("W", "L"), F.col("result")).otherwise(F.when(mine > theirs, "W").otherwise("L"))
    minutes = F.format_string("%.1f", F.coalesce(ratings.minutes(F.col("minutes_played")), F.lit(0.0)))
    return logs.select("game_id", *count, minutes.alias("minutes_played"), F.coalesce("home_or_away", F.lit("H")).alias("home_or_away"), result.alias("result"), F.format_string("%s %d - %d %s", own, mine, theirs, other).alias("formatted_score"))


def odds_summary(odds: DataFrame) -> DataFrame:
    """By game: the consensus, and each book's American odds as a list by book, with its name."""
    books = odds.groupBy("game_id").agg(F.array_sort(F.collect_list(F.struct("sportsbook_id", "sportsbook_name", ratings.american_odds(F.col("home_odds")).alias("home"), ratings.american_odds(F.col("away_odds")).alias("away")))).alias("prices"))
    return books.join(consensus_odds(odds), "game_id", "left")
