"""Queries over team schedules: rest, density, edges and calendars."""

from __future__ import annotations

from pyspark.sql import functions as F

from hardwood.functions import seasons
from hardwood.operators import schedule
from hardwood.plans.bridge import SQL_GAMES, games, table


def _q(f):
    return lambda spark, d: f(games(spark, d, box=False))


_DENSITY = ["team_id", "game_date", "days_rest", "prior_3in4", "prior_4in5", "prior_5in7", "is_b2b", "is_3in4", "is_4in5", "is_5in7"]


def _seasons(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    s = seasons.season_of(F.col("day"))
    return o.select("o_orderkey", s.alias("season"), seasons.neighbour(s, -1).alias("previous"), seasons.season_start(s).alias("start"), seasons.active_season(F.col("day"), F.lit("1995-96"), F.lit(False)).alias("active"))


def _eastern(spark, d):
    e = table(spark, d, "events").select("event_id", seasons.eastern_date(F.col("ts")).alias("day"))
    return e.groupBy("day").agg(F.count("*").alias("events"), F.date_format(seasons.slate_cutoff(F.col("day")), "yyyy-MM-dd HH:mm").alias("cutoff"))


def _player_seasons(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("player_id"), seasons.season_of(F.to_date("o_orderdate")).alias("season"))
    return o.groupBy("player_id").agg(F.array_join(F.array_sort(F.collect_set("season")), ",").alias("available_seasons"))


def _with_season(spark, d):
    return _player_seasons(spark, d).where(F.array_contains(F.split("available_seasons", ","), "1997-98")).select("player_id")


QUERIES = {
    "days_rest": _q(lambda g: schedule.rest_and_density(g).select("team_id", "game_date", F.col("days_rest").cast("long").alias("days_rest"), "is_b2b")),
    "games_in_trailing_days": _q(lambda g: schedule.rest_and_density(g).select(*_DENSITY).withColumn("days_rest", F.col("days_rest").cast("long"))),
    "legacy_rest_density": _q(lambda g: schedule.rest_and_density(g, legacy=True).select(*_DENSITY).withColumn("days_rest", F.col("days_rest").cast("long"))),
    "rest_edge": _q(lambda g: schedule.factors(g).select("game_id", "team_id", F.col("rest_diff").cast("long").alias("rest_diff"), "rest_edge", "description")),
    "team_schedule_summary": _q(lambda g: schedule.team_summary(schedule.factors(g))),
    "slate_schedule_summary": _q(lambda g: schedule.slate_summary(schedule.factors(g))),
    "slate_calendar_7d": _q(lambda g: schedule.calendar(g, "1998-03-01", 7)),
    "season_from_date": _seasons,
    "eastern_slates": _eastern,
    "player_season_arrays": _player_seasons,
    "array_contains_season": _with_season,
}

_G = f"WITH {SQL_GAMES}"


def _density(back, rest, rows):
    n = "sum(games)" if rows else "count(*)"
    part = ", ".join(f"CAST(coalesce({n} OVER (PARTITION BY team_id ORDER BY d RANGE BETWEEN {b} PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prior_{k}" for b, k in zip(back, ("3in4", "4in5", "5in7"), strict=True))
    return f"""
dd AS (SELECT team_id, game_date, game_date - DATE '1970-01-01' AS d, count(*) AS games FROM ga GROUP BY ALL),
de AS (SELECT team_id, game_date, CAST(d - max(d) OVER (PARTITION BY team_id ORDER BY d RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {rest} AS BIGINT) AS days_rest, {part} FROM dd),
df AS (SELECT *, coalesce(days_rest = 0, FALSE) AS is_b2b, prior_3in4 >= 2 AS is_3in4, prior_4in5 >= 3 AS is_4in5, prior_5in7 >= 4 AS is_5in7 FROM de)"""


_D = _density((3, 4, 6), 1, False)
_F = """
fc AS (SELECT g.game_id, g.team_id, g.opponent_team_id, g.game_date, x.days_rest, x.is_b2b, x.is_3in4, x.is_4in5, x.is_5in7, x.days_rest - y.days_rest AS rest_diff
       FROM ga g JOIN df x USING (team_id, game_date) LEFT JOIN df y ON y.team_id = g.opponent_team_id AND y.game_date = g.game_date),
fe AS (SELECT *, CASE WHEN rest_diff >= 2 THEN 'advantage' WHEN rest_diff <= -2 THEN 'disadvantage' WHEN rest_diff IS NOT NULL THEN 'even' END AS rest_edge,
       CASE WHEN is_b2b THEN 'Back-to-Back' WHEN is_3in4 THEN '3-in-4 nights (' || days_rest || ' days rest)' WHEN is_4in5 THEN '4-in-5 nights (' || days_rest || ' days rest)' WHEN is_5in7 THEN '5-in-7 nights (' || days_rest || ' days rest)'
       WHEN days_rest >= 3 THEN 'Well rested (' || days_rest || ' days rest)' WHEN days_rest = 2 THEN 'Normal rest (2 days rest)' WHEN days_rest = 1 THEN 'Short rest (1 day rest)' WHEN days_rest IS NOT NULL THEN days_rest || ' days rest' ELSE 'Unknown' END AS description FROM fc)"""
_SEASON = "printf('%04d-%02d', {y}, ({y} + 1) % 100)"
_Y = "(year(o_orderdate) - CASE WHEN month(o_orderdate) < 10 THEN 1 ELSE 0 END)"


def _teams(cond):
    return f"coalesce(array_to_string(list_sort(list_distinct(list(team_id) FILTER (WHERE {cond}))), ','), '')"


ORACLE = {
    "days_rest": f"{_G}, {_D} SELECT team_id, game_date, days_rest, is_b2b FROM df",
    "games_in_trailing_days": f"{_G}, {_D} SELECT {', '.join(_DENSITY)} FROM df",
    "legacy_rest_density": f"{_G}, {_density((4, 5, 7), 0, True)} SELECT {', '.join(_DENSITY)} FROM df",
    "rest_edge": f"{_G}, {_D}, {_F} SELECT game_id, team_id, rest_diff, rest_edge, description FROM fe",
    "team_schedule_summary": f"""{_G}, {_D}, {_F} SELECT team_id, count(*) AS games, count(*) FILTER (WHERE is_b2b) AS b2b, count(*) FILTER (WHERE is_3in4) AS three_in_four,
        count(*) FILTER (WHERE is_4in5) AS four_in_five, count(*) FILTER (WHERE is_5in7) AS five_in_seven, round(100.0::DOUBLE * count(*) FILTER (WHERE is_b2b) / count(*), 4) AS b2b_pct,
        round(avg(coalesce(days_rest, 0)), 4) AS avg_rest, count(*) FILTER (WHERE rest_edge = 'advantage') AS advantages, count(*) FILTER (WHERE rest_edge = 'disadvantage') AS disadvantages FROM fe GROUP BY team_id""",
    "slate_schedule_summary": f"""{_G}, {_D}, {_F} SELECT game_date, count(DISTINCT game_id) AS games, count(*) FILTER (WHERE is_b2b) AS b2b_sides, {_teams('is_b2b')} AS b2b_teams,
        {_teams("rest_edge = 'advantage'")} AS advantage_teams, {_teams("rest_edge = 'disadvantage'")} AS disadvantage_teams FROM fe GROUP BY game_date""",
    "slate_calendar_7d": f"""{_G}, c AS (SELECT CAST(unnest(generate_series(DATE '1998-03-01', DATE '1998-03-07', INTERVAL 1 DAY)) AS DATE) AS game_date)
        SELECT c.game_date, count(DISTINCT game_id) AS games FROM c LEFT JOIN ga USING (game_date) GROUP BY c.game_date""",
    "season_from_date": f"""SELECT o_orderkey, {_SEASON.format(y=_Y)} AS season, {_SEASON.format(y=f'({_Y} - 1)')} AS previous, CAST({_Y} AS INTEGER) AS start,
        CASE WHEN month(o_orderdate) BETWEEN 7 AND 9 THEN '1995-96' ELSE {_SEASON.format(y=_Y)} END AS active FROM orders""",
    "eastern_slates": """WITH e AS (SELECT CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) AS day FROM events)
        SELECT day, count(*) AS events, strftime(timezone('UTC', timezone('America/New_York', day + INTERVAL 10 HOUR)), '%Y-%m-%d %H:%M') AS cutoff FROM e GROUP BY day""",
    "player_season_arrays": f"SELECT o_custkey AS player_id, array_to_string(list_sort(list_distinct(list({_SEASON.format(y=_Y)}))), ',') AS available_seasons FROM orders GROUP BY o_custkey",
    "array_contains_season": f"SELECT DISTINCT o_custkey AS player_id FROM orders WHERE {_SEASON.format(y=_Y)} = '1997-98'",
}
