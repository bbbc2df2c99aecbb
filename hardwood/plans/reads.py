"""Queries for the reads that services make of stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hardwood.functions import ratings, seasons
from hardwood.operators import form, reading, teams
from hardwood.plans.availability import _S, statuses
from hardwood.plans.bridge import SQL_GAMES, SQL_LOGS, SQL_ODDS, games, logs, odds, table
from hardwood.plans.team_games import _M, _SOS, _season, _strength


def _windows(spark, d):
    """Windows by optional predicates: a list of thresholds, one size, any player."""
    w = form.stat_windows(form.complete(logs(spark, d)), [10, 20, 50], (5, 10))
    got = reading.filtered(w, [F.desc("games_hit"), "player_id", "threshold"], 25, threshold=[20.0, 50.0], window_size=10, player_id=None)
    return got.select("player_id", "threshold", "games_hit", "games_played", ratings.hit_mark(F.col("games_hit"), F.col("games_played")).alias("mark"))


def _pairs(spark, d):
    """Games of the pairs of teams that met on the first day of a season."""
    g = games(spark, d, box=False)
    first = g.groupBy("season").agg(F.min("game_date").alias("game_date"))
    pairs = g.join(first, ["season", "game_date"])
    return reading.matching(g, pairs, ["team_id", "opponent_team_id"]).select("game_id", "team_id", "opponent_team_id")


def _metric(spark, d):
    return reading.chosen(_season(games(spark, d)), ["team_id"], "pace_season", tuple(f"{m}_season" for m in teams.METRICS))


def _distinct(spark, d):
    return games(spark, d, box=False).select("season").distinct()


def _roster(spark, d):
    """The team of each player's latest season."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("player_id"), seasons.season_of(F.to_date("o_orderdate")).alias("season"), (F.col("o_orderkey") % 30).alias("team_id"))
    return reading.latest_by(o, "player_id", "season")


def _record(spark, d):
    """The record of each team: season, last games, difference and strength of schedule; a team needs all of them."""
    g = games(spark, d)
    return _season(g).select("team_id", "season_games", "recent_games", "net_rtg_season", "net_rtg_lastn", "net_rtg_delta").join(_strength(g), "team_id").join(teams.filled_recent(g).select("team_id"), "team_id", "left_semi")


def _player_page(spark, d):
    """One player's newest games, each with its place, and what the heat and the streak say."""
    f = form.complete(logs(spark, d).where("player_id = 7"))
    heat = form.heat_index(f, (5,), decimals=8).select("player_id", "z_score", "status")
    streak = form.current_streaks(f, [20]).select("player_id", "streak_games")
    newest = form.numbered(f).where("n_desc <= 5").select("player_id", "game_id", "value", F.col("n_desc").cast("long").alias("n_desc"))
    return newest.join(heat, "player_id", "left").join(streak, "player_id", "left")


def _named(spark, d):
    """Named reads of the stored tables, each as its number of rows and the sum of a column."""
    g = games(spark, d)
    played = g.select("game_id", "season", "game_date", "team_id", "opponent_team_id", "result", "pts")
    logs_ = logs(spark, d).select("player_id", "game_id", F.to_date("game_time").alias("game_date"), F.col("value").alias("points"), F.lit("2023-24").alias("season"))
    o = odds(spark, d).select("game_id", "sportsbook_id", "sportsbook_name", "country_code")
    s = statuses(spark, d).select("game_id", "player_id", "player_name", "team_id", "game_date", "season", "not_playing_reason")
    w = form.stat_windows(form.complete(logs(spark, d)), [10, 20, 50], (5, 10)).withColumn("season", F.lit("2023-24"))
    players = table(spark, d, "customer").select(F.col("c_custkey").alias("player_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("position"), F.when(F.col("c_custkey") % 3 != 0, F.array(F.lit("2023-24"), (F.col("c_custkey") % 2).cast("string"))).alias("available_seasons"))
    asked = [
        ("logs_of_player_and_season", logs_, "points", {"player_id": 3, "season": "2023-24"}), ("last_logs", logs_, "points", {"player_id": 3, "limit": 5}), ("best_log", logs_, "points", {"player_id": 3}), ("has_logs", logs_, "rows", {"player_id": 3}),
        ("schedule_of_date", played, "pts", {"game_date": "1998-03-03"}), ("last_games", played, "pts", {"team_id": 7, "game_date": "1998-03-03", "limit": 4}), ("next_games", played, "pts", {"team_id": 7, "game_date": "1998-03-03", "limit": 4}),
        ("meetings", played, "pts", {"team_id": 7, "opponent_team_id": 3}), ("box_scores_of_team", played, "pts", {"team_id": [5, 7], "season": "1997-98"}), ("odds_of_game", o, "sportsbook_id", {"game_id": "0000000007"}),
        ("injuries_of_date", s, "player_id", {"game_date": "1998-03-03", "not_playing_reason": "INACTIVE_INJURY"}), ("injuries_of_player", s, "team_id", {"player_id": 7, "not_playing_reason": "INACTIVE_INJURY"}), ("status_of_season", s, "player_id", {"season": "1997-98"}),
        ("windows_of_player", w, "games_hit", {"player_id": 3, "window_size": 10}), ("players_of_season", players, "player_id", {"available_seasons": "1"}), ("player_by_name", players, "player_id", {"name": "CUSTOMER"}), ("players_of_position", players, "player_id", {"position": "BUILDING"}),
    ]
    parts = [reading.named(name, rows, **args).agg(F.lit(name).alias("read"), F.count("*").alias("rows"), F.round(F.coalesce(F.sum(column).cast("double"), F.lit(0.0)), 4).alias("total")) for name, rows, column, args in asked]
    return reduce(DataFrame.unionByName, parts)


QUERIES = {
    "named_reads": _named,
    "filtered_windows": _windows, "pair_filter": _pairs, "chosen_metric": _metric, "distinct_seasons": _distinct, "latest_roster_row": _roster, "team_metric_record": _record, "player_page": _player_page,
}

_L, _G = f"WITH {SQL_LOGS}", f"WITH {SQL_GAMES}"

_NAMED = [
    ("logs_of_player_and_season", "value", "events WHERE user_id = 3", ""), ("last_logs", "value", "events WHERE user_id = 3", "CAST(ts AS DATE) DESC, user_id, lpad(CAST(event_id AS VARCHAR), 10, '0') LIMIT 5"), ("best_log", "value", "events WHERE user_id = 3", "value DESC LIMIT 1"),
    ("schedule_of_date", "pts", "ga WHERE game_date = DATE '1998-03-03'", ""), ("last_games", "pts", "ga WHERE team_id = 7 AND result IS NOT NULL AND game_date < DATE '1998-03-03'", "game_date DESC, game_id LIMIT 4"), ("next_games", "pts", "ga WHERE team_id = 7 AND game_date >= DATE '1998-03-03'", "game_date, game_id LIMIT 4"),
    ("meetings", "pts", "ga WHERE team_id = 7 AND opponent_team_id = 3", ""), ("box_scores_of_team", "pts", "ga WHERE team_id IN (5, 7) AND season = '1997-98'", ""), ("odds_of_game", "sportsbook_id", "od WHERE game_id = '0000000007'", ""),
    ("injuries_of_date", "player_id", "st WHERE game_date = DATE '1998-03-03' AND reason = 'INACTIVE_INJURY'", ""), ("injuries_of_player", "team_id", "st WHERE player_id = 7 AND reason = 'INACTIVE_INJURY'", ""), ("status_of_season", "player_id", "st WHERE season = '1997-98'", ""),
    ("windows_of_player", "hit", "(SELECT threshold, count(*) FILTER (WHERE value >= threshold) AS hit FROM nl, (VALUES (10.0::DOUBLE), (20.0), (50.0)) t(threshold) WHERE player_id = 3 AND n_desc <= 10 GROUP BY 1)", ""), ("players_of_season", "c_custkey", "customer WHERE c_custkey % 3 <> 0 AND c_custkey % 2 = 1", ""),
    ("player_by_name", "c_custkey", "customer WHERE c_name ILIKE '%CUSTOMER%'", "c_custkey LIMIT 1"), ("players_of_position", "c_custkey", "customer WHERE c_mktsegment = 'BUILDING'", ""),
]
ORACLE = {
    "named_reads": f"WITH {SQL_GAMES}, {SQL_LOGS}, {SQL_ODDS}, {_S} SELECT 'has_logs' AS read, CAST(1 AS BIGINT) AS \"rows\", CAST(count(*) AS DOUBLE) AS total FROM events WHERE user_id = 3 "
    + "".join(f"UNION ALL SELECT '{n}', count(*), round(coalesce(CAST(sum(x) AS DOUBLE), 0), 4) FROM (SELECT {c} AS x FROM {rows}{' ORDER BY ' + order if order else ''}) " for n, c, rows, order in _NAMED),
    "filtered_windows": f"""{_L}, w AS (SELECT player_id, threshold, count(*) FILTER (WHERE value >= threshold) AS games_hit, count(*) AS games_played FROM nl, (VALUES (20.0::DOUBLE), (50.0)) t(threshold) WHERE n_desc <= 10 GROUP BY ALL)
        SELECT *, CASE WHEN games_hit / games_played >= 0.8 THEN '🔥' WHEN games_hit / games_played >= 0.6 THEN '✓' WHEN games_hit / games_played >= 0.4 THEN '○' ELSE '✗' END AS mark FROM w ORDER BY games_hit DESC, player_id, threshold LIMIT 25""",
    "pair_filter": f"{_G}, p AS (SELECT DISTINCT team_id, opponent_team_id FROM ga JOIN (SELECT season, min(game_date) AS game_date FROM ga GROUP BY season) USING (season, game_date)) SELECT game_id, team_id, opponent_team_id FROM ga SEMI JOIN p USING (team_id, opponent_team_id)",
    "chosen_metric": f"{_G}, {_M} SELECT team_id, pace_season AS value FROM ms",
    "distinct_seasons": f"{_G} SELECT DISTINCT season FROM ga",
    "latest_roster_row": "WITH o AS (SELECT o_custkey AS player_id, printf('%04d-%02d', y, (y + 1) % 100) AS season, o_orderkey % 30 AS team_id FROM (SELECT *, year(o_orderdate) - CASE WHEN month(o_orderdate) < 10 THEN 1 ELSE 0 END AS y FROM orders)) SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY season DESC, team_id DESC) = 1",
    "team_metric_record": f"{_G}, {_M}, {_SOS} SELECT team_id, season_games, recent_games, net_rtg_season, net_rtg_lastn, net_rtg_delta, sos_net_season, sos_net_lastn, sos_net_delta FROM md JOIN sd USING (team_id) WHERE team_id IN (SELECT team_id FROM ga GROUP BY team_id HAVING count(*) >= 10)",
    "player_page": f"""{_L}, p AS (SELECT * FROM nl WHERE player_id = 7), z AS (SELECT count(*) AS n, avg(value) AS a, stddev_samp(value) AS s, avg(value) FILTER (WHERE n_desc <= 5) AS r, coalesce(min(n_desc) FILTER (WHERE value < 20) - 1, max(n_desc)) AS g FROM p)
        SELECT player_id, game_id, value, n_desc, CASE WHEN n >= 3 AND s > 0 THEN round((r - a) / s, 8) END AS z_score, CASE WHEN n >= 3 AND s > 0 THEN CASE WHEN (r - a) / s >= 1 THEN 'on_fire' WHEN (r - a) / s <= -1 THEN 'ice_cold' ELSE 'normal' END END AS status,
               CASE WHEN g >= 1 THEN g END AS streak_games FROM p, z WHERE n_desc <= 5""",
}
