"""Queries for what pages and reports show, and for the players' snapshots behind them."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hardwood.functions import ratings, seasons
from hardwood.operators import form, reports, schedule, serving, snapshots, teams, upsert
from hardwood.plans.bridge import SQL_GAMES, SQL_LOGS, SQL_ODDS, games, logs, odds, orders, table
from hardwood.plans.pages import _CALLED, called_out
from hardwood.plans.players import _longest
from hardwood.plans.team_games import _ENV
from hardwood.sources import feeds

DATES = (datetime.date(2024, 1, 10), datetime.date(2024, 1, 12))


def _labels(spark, d):
    e = table(spark, d, "events")
    east = F.from_utc_timestamp(F.col("ts").cast("timestamp"), seasons.EASTERN)
    clock = F.format_string("%d:%02d", F.floor("value").cast("int"), (F.col("event_id") % 60).cast("int"))
    raw = F.when(F.col("event_id") % 5 == 0, "").when(F.col("event_id") % 5 == 1, "n/a").otherwise(F.concat(F.lit(" "), F.col("event_id").cast("string"), F.lit(" ")))
    return e.select(
        "event_id", seasons.day_label(east).alias("day"), seasons.clock_label(east).alias("clock"), ratings.minutes(clock).alias("minutes"), ratings.int_or_null(raw).alias("number"),
        ratings.trend(F.col("value") - 50, 20.0).alias("trend"), ratings.trend(F.col("value") - 50, 20.0, lower_is_better=True).alias("trend_lower"), ratings.win_pct_text(F.col("event_id") % 10, F.lit(9)).alias("won"),
        ratings.whole_scores(F.format_string("AB %.1f - %.1f CD", F.round("value"), F.floor("value") + 0.5)).alias("score"), ratings.as_fraction(F.col("value")).alias("fraction"),
    )


def _log_lines(spark, d):
    """Matchup lines of a week's games, with gaps that are filled."""
    g = games(spark, d, orders(spark, d).where("game_date between '1998-03-01' and '1998-03-07'"))
    raw = g.select(
        "game_id", F.when(F.col("tov") > 10, F.col("pts")).alias("points"), F.col("fg3").alias("assists"), F.col("dreb").alias("rebounds"), F.lit(None).cast("long").alias("steals"), F.lit(1).cast("long").alias("blocks"), F.col("tov").alias("turnovers"),
        F.when(F.col("is_home"), F.concat(F.col("fga").cast("string"), F.lit(":30"))).alias("minutes_played"), F.when(F.col("is_home"), "H").alias("home_or_away"), F.when(F.col("tov") % 2 == 0, "x").otherwise(F.col("result")).alias("result"),
        F.concat(F.lit("T"), F.col("team_id").cast("string")).alias("team_abbreviation"), F.lit(None).cast("string").alias("opponent_abbreviation"), F.col("pts").alias("team_score"), F.col("o_pts").alias("opponent_score"),
    )
    return serving.matchup_logs(raw)


def _featured(spark, d):
    """Featured games of the dates around one: the first three without a result, filled up with final ones."""
    g = games(spark, d, orders(spark, d).where("game_date between '1998-02-27' and '1998-03-02'")).where("is_home")
    result = F.when(F.col("game_date") < "1998-03-01", F.col("result")).when(F.col("tov") > 14, F.col("result"))
    g = g.withColumn("status", ratings.game_status(result, F.col("game_date"), F.lit("1998-03-01").cast("date"))).withColumn("place", F.col("game_id"))
    return serving.featured(g).select("game_date", "game_id", "status", F.col("position").cast("long").alias("position"))


def _slate_streaks(spark, d):
    """Streaks of both sides' players of a day's games; customers are players of the supplier with their number modulo
    the suppliers."""
    day = games(spark, d, orders(spark, d).where("game_date = '1998-03-03'"), box=False)
    pairs = teams.pair_sides(day, ["team_id"])
    roster = table(spark, d, "customer").select(F.col("c_custkey").alias("player_id"), (F.col("c_custkey") % 10).alias("team_id"))
    s = form.current_streaks(form.complete(logs(spark, d)), [20])
    return serving.slate_streaks(pairs, roster, s).select("game_id", "side", "team_id", "player_id", "streak_games")


def _roster_fallback(spark, d):
    """Rosters of a season: teams of even-numbered regions are filed under it, all under the year."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    season = F.when(F.col("n_regionkey") % 2 == 0, F.array(F.lit("1997-98"), F.lit("1997"))).otherwise(F.array(F.lit("1997")))
    roster = c.select(F.col("c_nationkey").alias("team_id"), F.col("c_custkey").alias("player_id"), F.explode(season).alias("season"))
    wanted = table(spark, d, "nation").select(F.col("n_nationkey").alias("team_id"))
    return serving.roster_of_season(roster, wanted, "1997-98")


def _context(spark, d):
    """A week's slate with everything that is known before it."""
    o = orders(spark, d)
    week = o.where("game_date between '1998-03-01' and '1998-03-07'")
    before = games(spark, d, o.where("game_date <= '1998-03-07'"))
    facts = before.withColumn("game_time", F.col("game_date").cast("timestamp"))
    slate = before.where("game_date >= '1998-03-01'")
    f = snapshots.team_features(slate, facts, decimals=10)
    env = snapshots.game_environments(f, 10).select("game_id", "pace_projection", F.array_join("tags", ",").alias("tags"))
    rest = schedule.factors(before).where("game_date >= '1998-03-01'").select("game_id", "team_id", "days_rest", "rest_edge")
    flags = f.groupBy("team_id").agg(F.max_by(F.array_join("flags", ","), F.struct("game_date", "game_id")).alias("flags"))
    metrics = f.groupBy("team_id").agg(*(F.max_by(c, F.struct("game_date", "game_id")).alias(c) for c in ("net_rtg_season", "pace_lastn")))
    called, hurt = called_out(spark, d, 5)
    hurt = hurt.select((F.col("player_id") % 10).alias("team_id"), "player_id", F.concat_ws(" ", F.col("game_date").cast("string"), "description").alias("description"))
    out = serving.slate_context(teams.pair_sides(slate, ["team_id"]), env, rest, serving.consensus_odds(odds(spark, d, week)).select("game_id", "home_odds", "n_books"), flags, metrics, called, hurt)
    sides = ("home", "away")
    players = [F.array_join(F.transform(f"{s}_callouts", lambda x: F.concat_ws(":", x["player_id"].cast("string"), x["consistency_tier"])), ",").alias(f"{s}_callouts") for s in sides]
    return out.select(
        "game_id", "home_team_id", "away_team_id", "tags", "home_odds", "n_books", "home_edge", "away_edge", "home_flags", "away_flags", *(F.col(f"{s}_rest").cast("long").alias(f"{s}_rest") for s in sides),
        *(f"{s}_{c}" for s in sides for c in ("net_rtg_season", "pace_lastn")), *players, *(F.size(f"{s}_injuries").alias(f"{s}_injured") for s in sides),
    )


def _rest_lists(spark, d):
    """Rest advantages of a month, largest first, and its back-to-backs, newest first: the season's games before are the
    context, only the month is shown."""
    f = schedule.factors(games(spark, d, orders(spark, d).where("game_date <= '1998-03-31'"), box=False)).where("game_date >= '1998-03-01'")
    first = form.leaders(f.where("rest_edge = 'advantage'"), [F.desc("rest_diff"), "game_date", "game_id", "team_id"], 20).withColumn("kind", F.lit("advantage"))
    second = form.leaders(f.where("is_b2b"), [F.desc("game_date"), "game_id", "team_id"], 20).withColumn("kind", F.lit("b2b"))
    return first.unionByName(second).select("kind", "game_id", "team_id", "game_date", F.col("rest_diff").cast("long").alias("rest_diff"))


def _odds_books(spark, d):
    s = serving.odds_summary(odds(spark, d, orders(spark, d).where("game_date between '1998-03-01' and '1998-03-07'")))
    text = F.transform("prices", lambda p: F.concat_ws(":", p["sportsbook_name"], p["home"].cast("string"), p["away"].cast("string")))
    return s.select("game_id", "home_odds", "n_books", F.array_join(F.array_sort(text), ";").alias("prices"))


def _bests(spark, d):
    f = form.complete(logs(spark, d))
    avg = form.season_averages(form.heat_index(f, (3, 5), decimals=8))
    best = form.longest_streaks(f, [20, 50, 100])
    return form.meaningful_bests(best, avg.where("player_id % 4 <> 0")).select("player_id", "threshold", "streak_games")


def _by_stat(spark, d):
    s = form.streaks_by_stat(form.current_streaks(form.complete(logs(spark, d, True)), [20]), 2, 10)
    return s.select("stat", F.array_join(F.transform("streaks", lambda x: F.concat_ws(":", x["player_id"].cast("string"), x["streak_games"].cast("string"))), ",").alias("streaks"))


def _unpivoted(spark, d):
    """Wide team logs as long ones, with the sum of three stats, which is missing where one of them is."""
    g = games(spark, d).select("team_id", "game_id", F.col("pts").alias("p"), F.col("dreb").alias("r"), F.col("fg3").alias("a"), F.col("tov").alias("t"))
    long = form.unpivot_stats(g, {"PTS": "p", "REB": "r", "AST": "a", "TOV": "t"}, ["team_id", "game_id"])
    return long.groupBy("stat").agg(F.count("*").alias("rows"), F.count("value").alias("known"), F.sum("value").alias("total"))


def _snapshot_parts(spark, d, first, last):
    dates = snapshots.slate_dates(logs(spark, d).select(seasons.eastern_date(F.col("game_time")).alias("game_date")), first, last)
    return snapshots.player_snapshots(logs(spark, d), dates, [20, 50])


def _player_heat(spark, d):
    h = _snapshot_parts(spark, d, *DATES)["heat"]
    return h.select("player_id", F.date_format("feature_as_of", "yyyy-MM-dd HH:mm").alias("feature_as_of"), "window_size", "games", "z_score", "status")


def _cleanup(spark, d):
    """The cleanup of a table: one row a key, names in title case, defaults, the three latest seasons."""
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = li.select("l_orderkey", "l_linenumber", F.concat(F.lit(" "), F.upper("p_name")).alias("name"), F.nullif("l_discount", F.lit(0.0)).alias("discount"), seasons.season_of(F.to_date("l_shipdate")).alias("season"))
    out = upsert.cleaned(rows, ["l_orderkey", "l_linenumber"], {"discount": -1.0}, ["name"], 3)
    return out.groupBy("season").agg(F.count("*").alias("rows"), F.round(F.sum("discount"), 4).alias("total"), F.max("name").alias("last_name"))


def _cleanups(spark, d):
    """Five tables with repeated rows and gaps, each cleaned by its rules: rows, seasons and sums of what is left."""
    g = games(spark, d)
    gap = F.when(F.col("tov") % 5 != 0, F.col("pts"))
    box = g.select("game_id", "team_id", "opponent_team_id", "season", gap.alias("pts"), "tov")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("player_id"), F.concat(F.lit(" "), F.upper("c_name")).alias("name"), F.nullif("c_acctbal", F.lit(0.0)).alias("weight"))
    e = table(spark, d, "events").select(F.col("user_id").alias("player_id"), F.col("event_id").cast("string").alias("game_id"), F.when(F.col("value") > 20, F.col("value")).alias("points"), F.when(F.col("event_id") % 3 != 0, "12:00").alias("minutes_played"), F.lit("2023-24").alias("season"))
    dash = g.groupBy(F.col("team_id").alias("player_id"), "season").agg(F.lit("joHN dOE").alias("player_name"), F.max(F.when(F.col("pts") > 130, F.col("pts"))).alias("best"))
    made = {"team_game_stats": (box, "pts"), "game_schedule": (box, "pts"), "players": (c, "weight"), "gamelogs": (e, "points"), "player_dashboards": (dash, "best")}
    out = []
    for name, (rows, number) in made.items():
        r = upsert.cleaned_table(name, rows.unionByName(rows), 3)
        text = next((x for x in ("name", "player_name", "minutes_played") if x in r.columns), "game_id")
        out.append(r.agg(F.lit(name).alias("table"), F.count("*").alias("rows"), F.count(number).alias("known"), F.round(F.sum(F.col(number).cast("double")), 4).alias("total"), F.min(text).alias("least")))
    return reduce(DataFrame.unionByName, out)


def _player_reports(spark, d):
    """The report of each player: streaks, windows of ten games, heat and consistency, a section each."""
    f = form.complete(logs(spark, d))
    names = table(spark, d, "customer").select(F.col("c_custkey").alias("player_id"), F.col("c_name").alias("player_name"))
    last = f.groupBy("player_id").agg(F.max("game_time").alias("last_game_date"))
    best = form.longest_streaks(f, [20, 50]).withColumn("kind", F.lit("season_max"))
    streaks = form.current_streaks(f, [20, 50]).withColumns({"is_active": F.lit(True), "kind": F.lit("current")}).unionByName(best).join(names, "player_id")
    windows = form.stat_windows(f, [20, 50], (10,)).join(names, "player_id").join(last, "player_id")
    heat = form.heat_index(f, (3, 5), decimals=8).join(names, "player_id")
    return reports.report([
        reports.section(1, streaks, "player_id", reports.streak_line(), [F.asc("kind"), F.asc("threshold")], "🔥 %d Streaks"), reports.section(2, windows, "player_id", reports.window_line(), [F.asc("threshold")], "📊 %d Stat Windows"),
        reports.section(3, heat, "player_id", reports.heat_line(), [F.asc("window_size")], "📈 %d Heat Rows"), reports.section(4, form.consistency(f, decimals=8), "player_id", reports.consistency_line(), [F.asc("window_size")]),
    ], "player_id")


def _retained(spark, d):
    o = table(spark, d, "orders").select(seasons.season_of(F.to_date("o_orderdate")).alias("season"))
    return upsert.retained(o, ["1996-97", "1998-99"]).groupBy("season").agg(F.count("*").alias("rows"))


def _season_lists(spark, d):
    """Seasons as stored text, with malformed and repeated ones, cleaned."""
    o = table(spark, d, "orders")
    s = seasons.season_of(F.to_date("o_orderdate"))
    text = F.concat_ws(",", s, F.lit("1999"), seasons.canonical_season(F.year("o_orderdate").cast("string")), s, F.lit("1998-98"))
    return o.select("o_orderkey", seasons.joined(seasons.season_array(text)).alias("seasons"))


def _valid_ids(spark, d):
    e = table(spark, d, "events")
    s = seasons.season_name((F.col("event_id") % 30 + 2000).cast("int"))
    return e.agg(F.count_if(feeds.is_player_id((F.col("event_id") - 3).cast("string"))).alias("players"), F.count_if(feeds.is_team_id(F.col("event_id") + 1610612500)).alias("teams"), F.count_if(feeds.is_page_season(s)).alias("seasons"))


QUERIES = {
    "display_labels": _labels, "matchup_log_lines": _log_lines, "featured_games": _featured, "slate_streaks": _slate_streaks, "roster_fallback": _roster_fallback, "slate_context": _context,
    "rest_lists": _rest_lists, "odds_by_book": _odds_books, "meaningful_season_bests": _bests, "streaks_by_stat": _by_stat, "unpivoted_stats": _unpivoted, "player_snapshot_heat": _player_heat,
    "cleanup": _cleanup, "cleanup_tables": _cleanups, "player_reports": _player_reports, "retained_seasons": _retained, "season_lists": _season_lists, "valid_ids": _valid_ids,
}

_G = f"WITH {SQL_GAMES}"
_WEEK = "game_date BETWEEN DATE '1998-03-01' AND DATE '1998-03-07'"
_REST = """
dd AS (SELECT DISTINCT team_id, game_date, game_date - DATE '1970-01-01' AS d FROM ga), de AS (SELECT team_id, game_date, CAST(d - lag(d) OVER (PARTITION BY team_id ORDER BY d) - 1 AS BIGINT) AS rest FROM dd),
rs AS (SELECT g.game_id, g.team_id, g.game_date, x.rest, x.rest - y.rest AS diff, CASE WHEN x.rest - y.rest >= 2 THEN 'advantage' WHEN x.rest - y.rest <= -2 THEN 'disadvantage' WHEN x.rest - y.rest IS NOT NULL THEN 'even' END AS edge
       FROM ga g JOIN de x USING (team_id, game_date) LEFT JOIN de y ON y.team_id = g.opponent_team_id AND y.game_date = g.game_date)"""
_KNOWN = f"""WITH {SQL_LOGS}, ct AS (SELECT CAST(unnest(generate_series(DATE '2024-01-10', DATE '2024-01-12', INTERVAL 1 DAY)) AS DATE) AS day),
    cu AS (SELECT day, timezone('UTC', timezone('America/New_York', day + INTERVAL 10 HOUR)) AS cut FROM ct),
    kf AS (SELECT player_id, game_id, game_time, value, cut, day FROM lg JOIN cu ON CAST(timezone('America/New_York', timezone('UTC', game_time)) AS DATE) < day AND game_time + INTERVAL 6 HOUR <= cut),
    kn AS (SELECT *, row_number() OVER (PARTITION BY player_id, cut ORDER BY game_time DESC, game_id DESC) AS n FROM kf)"""


def _american(c):
    return f"CASE WHEN {c} >= 2 THEN CAST(trunc(({c} - 1) * 100) AS INTEGER) WHEN {c} > 1 THEN CAST(trunc(-100 / ({c} - 1)) AS INTEGER) END"


ORACLE = {
    "display_labels": """SELECT event_id, strftime(e, '%a %m/%d') AS day, strftime(e, '%I:%M %p') AS clock, round(floor(value) + (event_id % 60) / 60.0::DOUBLE, 1) AS minutes, CASE WHEN event_id % 5 >= 2 THEN CAST(event_id AS INTEGER) END AS number,
        CASE WHEN value - 50 > 20 THEN '📈' WHEN value - 50 < -20 THEN '📉' ELSE '➖' END AS trend, CASE WHEN value - 50 < -20 THEN '📈' WHEN value - 50 > 20 THEN '📉' ELSE '➖' END AS trend_lower,
        CASE WHEN event_id % 10 = 9 THEN '1.000' ELSE printf('%.3f', (event_id % 10) / 9.0::DOUBLE)[2:] END AS won, printf('AB %d - %.1f CD', CAST(round(value) AS BIGINT), floor(value) + 0.5::DOUBLE) AS score,
        CASE WHEN value <= 1 THEN value WHEN value <= 100 THEN value / 100 END AS fraction FROM (SELECT *, timezone('America/New_York', timezone('UTC', ts)) AS e FROM events)""",
    "matchup_log_lines": f"""{_G} SELECT game_id, CASE WHEN tov > 10 THEN pts ELSE 0 END AS points, fg3 AS assists, coalesce(dreb, 0) AS rebounds, CAST(0 AS BIGINT) AS steals, CAST(1 AS BIGINT) AS blocks, tov AS turnovers, CASE WHEN is_home THEN printf('%.1f', fga + 0.5::DOUBLE) ELSE '0.0' END AS minutes_played,
        CASE WHEN is_home THEN 'H' ELSE 'H' END AS home_or_away, CASE WHEN tov % 2 <> 0 AND result IS NOT NULL THEN result WHEN pts > o_pts THEN 'W' ELSE 'L' END AS result, printf('T%d %d - %d OPP', team_id, pts, o_pts) AS formatted_score FROM ga WHERE {_WEEK}""",
    "featured_games": f"""{_G}, f AS (SELECT game_date, game_id, CASE WHEN result IS NOT NULL AND (game_date < DATE '1998-03-01' OR tov > 14) THEN 'Final' WHEN game_date = DATE '1998-03-01' THEN 'Today' ELSE 'Scheduled' END AS status FROM ga WHERE is_home AND game_date BETWEEN DATE '1998-02-27' AND DATE '1998-03-02')
        SELECT *, row_number() OVER (PARTITION BY game_date ORDER BY status = 'Final', game_id) AS position FROM f QUALIFY position <= 3""",
    "slate_streaks": f"""{_G}, {SQL_LOGS}, s AS (SELECT player_id, coalesce(min(n_desc) FILTER (WHERE value < 20) - 1, max(n_desc)) AS streak_games FROM nl GROUP BY player_id)
        SELECT game_id, CASE WHEN is_home THEN 'H' ELSE 'A' END AS side, team_id, player_id, streak_games FROM ga JOIN customer ON c_custkey % 10 = team_id JOIN s ON player_id = c_custkey WHERE game_date = DATE '1998-03-03' AND streak_games >= 1""",
    "roster_fallback": "SELECT c_nationkey AS team_id, c_custkey AS player_id, CASE WHEN n_regionkey % 2 = 0 THEN '1997-98' ELSE '1997' END AS season FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "rest_lists": f"""{_G}, {_REST} (SELECT 'advantage' AS kind, game_id, team_id, game_date, diff AS rest_diff FROM rs WHERE edge = 'advantage' AND game_date BETWEEN DATE '1998-03-01' AND DATE '1998-03-31' ORDER BY diff DESC, game_date, game_id, team_id LIMIT 20)
        UNION ALL (SELECT 'b2b', game_id, team_id, game_date, diff FROM rs WHERE rest = 0 AND game_date BETWEEN DATE '1998-03-01' AND DATE '1998-03-31' ORDER BY game_date DESC, game_id, team_id LIMIT 20)""",
    "odds_by_book": f"""WITH {SQL_ODDS}, w AS (SELECT od.* FROM od JOIN orders ON lpad(CAST(o_orderkey AS VARCHAR), 10, '0') = game_id WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1998-03-01' AND DATE '1998-03-07'),
        t AS (SELECT *, concat_ws(':', sportsbook_name, {_american('home_odds')}, {_american('away_odds')}) AS x FROM w)
        SELECT game_id, round(avg(home_odds) FILTER (WHERE country_code = 'US'), 3) AS home_odds, nullif(count(*) FILTER (WHERE country_code = 'US'), 0) AS n_books, string_agg(x, ';' ORDER BY x) AS prices FROM t GROUP BY game_id""",
    "meaningful_season_bests": f"""WITH {SQL_LOGS}, {_longest('(VALUES (20.0::DOUBLE), (50.0), (100.0)) t(threshold)')}, av AS (SELECT player_id, round(avg(value), 8) AS a FROM lg GROUP BY player_id HAVING player_id % 4 <> 0 AND count(*) >= 3 AND stddev_samp(value) > 0)
        SELECT player_id, threshold, streak_games FROM mx LEFT JOIN av USING (player_id) WHERE streak_games >= 5 OR CASE WHEN a > 0 THEN threshold >= a * 0.8::DOUBLE ELSE threshold >= 5 END""",
    "streaks_by_stat": """WITH n AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, lpad(CAST(event_id AS VARCHAR), 10, '0') DESC) AS k FROM events),
        s AS (SELECT user_id, event_type AS stat, coalesce(min(k) FILTER (WHERE value < 20) - 1, max(k)) AS g FROM n GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY stat ORDER BY g DESC, user_id) AS p FROM s WHERE g >= 2)
        SELECT stat, string_agg(user_id || ':' || g, ',' ORDER BY p) AS streaks FROM r WHERE p <= 10 GROUP BY stat""",
    "unpivoted_stats": f"""{_G} SELECT 'PTS' AS stat, count(*) AS "rows", count(pts) AS known, CAST(sum(pts) AS DOUBLE) AS total FROM ga UNION ALL SELECT 'REB', count(*), count(dreb), CAST(sum(dreb) AS DOUBLE) FROM ga UNION ALL SELECT 'AST', count(*), count(fg3), CAST(sum(fg3) AS DOUBLE) FROM ga
        UNION ALL SELECT 'TOV', count(*), count(tov), CAST(sum(tov) AS DOUBLE) FROM ga UNION ALL SELECT 'PRA', count(*), count(pts + dreb + fg3), CAST(sum(pts + dreb + fg3) AS DOUBLE) FROM ga""",
    "player_snapshot_heat": f"""{_KNOWN}, b AS (SELECT player_id, cut, count(*) AS games, avg(value) AS a, stddev_samp(value) AS s, avg(value) FILTER (WHERE n <= 3) AS r3, avg(value) FILTER (WHERE n <= 5) AS r5, avg(value) FILTER (WHERE n <= 10) AS r10 FROM kn GROUP BY ALL HAVING count(*) >= 3 AND stddev_samp(value) > 0),
        u AS (SELECT *, unnest([3, 5, 10]) AS window_size, unnest([r3, r5, r10]) AS r FROM b)
        SELECT player_id, strftime(cut, '%Y-%m-%d %H:%M') AS feature_as_of, window_size, games, round((r - a) / s, 8) AS z_score, CASE WHEN (r - a) / s >= 1 THEN 'on_fire' WHEN (r - a) / s <= -1 THEN 'ice_cold' ELSE 'normal' END AS status FROM u""",
    "cleanup": """WITH r AS (SELECT l_orderkey, l_linenumber, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS name, ' ' || upper(p_name) AS raw, nullif(l_discount, 0.0) AS discount, printf('%04d-%02d', y, (y + 1) % 100) AS season
            FROM (SELECT *, year(l_shipdate) - CASE WHEN month(l_shipdate) < 10 THEN 1 ELSE 0 END AS y FROM lineitem) JOIN part ON p_partkey = l_partkey),
        o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY raw, discount NULLS LAST, season) = 1)
        SELECT season, count(*) AS "rows", round(sum(coalesce(discount, -1.0)), 4) AS total, max(name) AS last_name FROM o WHERE season IN (SELECT DISTINCT season FROM o ORDER BY 1 DESC LIMIT 3) GROUP BY season""",
    "player_reports": f"""WITH {SQL_LOGS}, {_longest('(VALUES (20.0::DOUBLE), (50.0)) t(threshold)')}, th AS (SELECT * FROM (VALUES (20.0::DOUBLE), (50.0)) t(threshold)),
        cu AS (SELECT player_id, threshold, coalesce(min(n_desc) FILTER (WHERE value < threshold) - 1, max(n_desc)) AS g FROM nl, th GROUP BY ALL), nw AS (SELECT player_id, max(game_time) AS newest FROM lg GROUP BY 1),
        sk AS (SELECT player_id, 'Current' AS kind, threshold, g, min(game_time) AS a, max(game_time) AS b, TRUE AS active FROM cu JOIN nl USING (player_id) WHERE n_desc <= g GROUP BY ALL
               UNION ALL SELECT player_id, 'Season Best', threshold, streak_games, start_time, end_time, end_time = newest FROM mx JOIN nw USING (player_id)),
        w AS (SELECT player_id, threshold, count(*) FILTER (WHERE value >= threshold) AS hit, count(*) AS n FROM nl, th WHERE n_desc <= 10 GROUP BY ALL),
        b AS (SELECT player_id, avg(value) AS m, stddev_samp(value) AS s, avg(value) FILTER (WHERE n_desc <= 3) AS r3, avg(value) FILTER (WHERE n_desc <= 5) AS r5 FROM nl GROUP BY 1 HAVING count(*) >= 3 AND stddev_samp(value) > 0),
        h AS (SELECT player_id, unnest([3, 5]) AS window_size, round(unnest([r3, r5]), 8) AS r, round(m, 8) AS m, round((unnest([r3, r5]) - m) / s, 8) AS z FROM b),
        c AS (SELECT player_id, k AS window_size, round(avg(value), 8) AS m, round(stddev_samp(value), 8) AS s, min(value) AS lo, max(value) AS hi, CASE WHEN avg(value) > 0 THEN stddev_samp(value) / avg(value) ELSE 0 END AS cv FROM nl, (SELECT unnest([0, 10]) AS k) WHERE k = 0 OR n_desc <= k GROUP BY ALL HAVING count(*) >= 5),
        ln AS (
          SELECT player_id, 1 AS sec, row_number() OVER (PARTITION BY player_id ORDER BY kind, threshold) AS pl, printf('%-25s |  ALL | >=%3s | %3d games | %s - %s | %12s | %s', c_name, printf('%.0f', threshold), g, strftime(a, '%m/%d'), strftime(b, '%m/%d'), kind, CASE WHEN active THEN '🔥 ACTIVE' ELSE '✓ Complete' END) AS line FROM sk JOIN customer ON c_custkey = player_id
          UNION ALL SELECT player_id, 2, row_number() OVER (PARTITION BY player_id ORDER BY threshold), printf('%-25s |  ALL | >=%3s | %2d/%2d | %2dg | %6s | %s | %s', c_name, printf('%.0f', threshold), hit, n, CAST(10 AS BIGINT), printf('%.1f', round(100.0 * hit / n, 1)) || '%', strftime(newest, '%m/%d/%Y'),
            CASE WHEN hit / n >= 0.8 THEN '🔥' WHEN hit / n >= 0.6 THEN '✓' WHEN hit / n >= 0.4 THEN '○' ELSE '✗' END) FROM w JOIN nw USING (player_id) JOIN customer ON c_custkey = player_id
          UNION ALL SELECT player_id, 3, row_number() OVER (PARTITION BY player_id ORDER BY window_size), printf('%-25s |  ALL | %2dg | Z: %6s | Recent: %6s | Season: %6s | %s', c_name, window_size, printf('%.2f', round(z, 2) + 0), printf('%.2f', round(r, 2)), printf('%.2f', round(m, 2)),
            CASE WHEN z >= 1 THEN '🔥 ON FIRE' WHEN z >= 0.65 THEN '📈 HEATING UP' WHEN z >= -0.64 THEN '➖ AVERAGE' WHEN z >= -1 THEN '📉 COOLING OFF' ELSE '🧊 ICE COLD' END) FROM h JOIN customer ON c_custkey = player_id
          UNION ALL SELECT player_id, 4, row_number() OVER (PARTITION BY player_id ORDER BY window_size), printf(' ALL | Avg: %6s | StdDev: %5s | CV: %5s | Range: %s-%s | %s', printf('%.1f', round(m, 1)), printf('%.1f', round(s, 1)), printf('%.2f', round(round(cv, 8), 2)), printf('%.0f', round(lo)), printf('%.0f', round(hi)),
            CASE WHEN cv < 0.35::DOUBLE THEN '🎯 STEADY' WHEN cv > 0.55::DOUBLE THEN '🎰 VOLATILE' ELSE '➖ AVERAGE' END) FROM c),
        hd AS (SELECT player_id, sec, 0 AS pl, CASE sec WHEN 1 THEN '🔥 ' || count(*) || ' Streaks' WHEN 2 THEN '📊 ' || count(*) || ' Stat Windows' ELSE '📈 ' || count(*) || ' Heat Rows' END AS line FROM ln WHERE sec < 4 GROUP BY player_id, sec)
        SELECT player_id, string_agg(line, chr(10) ORDER BY sec, pl) AS report FROM (FROM ln UNION ALL FROM hd) GROUP BY player_id""",
    "cleanup_tables": f"""{_G}, r AS (SELECT * FROM ga WHERE season IN (SELECT DISTINCT season FROM ga ORDER BY 1 DESC LIMIT 3)), b AS (SELECT game_id, CASE WHEN tov % 5 <> 0 THEN pts END AS pts FROM r),
        da AS (SELECT team_id, season, max(pts) FILTER (WHERE pts > 130) AS best FROM r GROUP BY ALL)
        SELECT 'team_game_stats' AS "table", count(*) AS "rows", count(*) AS known, CAST(sum(coalesce(pts, 0)) AS DOUBLE) AS total, min(game_id) AS least FROM b
        UNION ALL SELECT 'game_schedule', count(*), count(pts), CAST(sum(pts) AS DOUBLE), min(game_id) FROM b
        UNION ALL SELECT 'players', count(*), count(nullif(c_acctbal, 0)), round(sum(nullif(c_acctbal, 0)), 4), min(upper(c_name[1]) || lower(c_name[2:])) FROM customer
        UNION ALL SELECT 'gamelogs', count(*), count(*), round(sum(CASE WHEN value > 20 THEN value ELSE 0 END), 4), min(CASE WHEN event_id % 3 <> 0 THEN '12:00' ELSE '00:00' END) FROM events
        UNION ALL SELECT 'player_dashboards', count(*), count(*), CAST(sum(coalesce(best, 0)) AS DOUBLE), 'John Doe' FROM da""",
    "retained_seasons": """SELECT CASE WHEN o_orderdate < DATE '1997-10-01' THEN '1996-97' ELSE '1998-99' END AS season, count(*) AS "rows" FROM orders
        WHERE (o_orderdate >= DATE '1996-10-01' AND o_orderdate < DATE '1997-10-01') OR (o_orderdate >= DATE '1998-10-01' AND o_orderdate < DATE '1999-10-01') GROUP BY 1""",
    "season_lists": """WITH y AS (SELECT o_orderkey, year(o_orderdate) - CASE WHEN month(o_orderdate) < 10 THEN 1 ELSE 0 END AS a, year(o_orderdate) AS b FROM orders)
        SELECT o_orderkey, CASE WHEN a = b THEN printf('%04d-%02d', a, (a + 1) % 100) ELSE printf('%04d-%02d,%04d-%02d', a, (a + 1) % 100, b, (b + 1) % 100) END AS seasons FROM y""",
    "valid_ids": """SELECT count(*) FILTER (WHERE event_id - 3 > 0 AND event_id - 3 < 10000000) AS players, count(*) FILTER (WHERE event_id + 1610612500 < 1610612800) AS teams, count(*) FILTER (WHERE event_id % 30 + 2000 BETWEEN 2010 AND 2025) AS seasons FROM events""",
    "slate_context": f"""{_G}, {_ENV}, {_REST}, {SQL_ODDS}, {SQL_LOGS}, {_CALLED},
        cl AS (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY score DESC, player_id) AS position FROM q WHERE score > 0 OR injuries IS NOT NULL QUALIFY position <= 5),
        ca AS (SELECT team_id, string_agg(player_id || ':' || consistency_tier, ',' ORDER BY position) AS called FROM cl GROUP BY 1), hu AS (SELECT player_id % 10 AS team_id, CAST(count(*) AS INTEGER) AS injured FROM hi GROUP BY 1),
        nm AS (SELECT team_id, max_by(net_rtg_season, (game_date, game_id)) AS net, max_by(pace_lastn, (game_date, game_id)) AS pace FROM sn WHERE {_WEEK} GROUP BY 1), oc AS (SELECT game_id, round(avg(home_odds), 3) AS home_odds, count(*) AS n_books FROM od WHERE country_code = 'US' GROUP BY game_id),
        fw AS (SELECT team_id, max_by(flags, (game_date, game_id)) AS flags FROM sn WHERE {_WEEK} GROUP BY team_id)
        SELECT h.game_id, h.team_id AS home_team_id, h.opponent_team_id AS away_team_id, et.tags, oc.home_odds, oc.n_books, x.edge AS home_edge, y.edge AS away_edge, x.rest AS home_rest, y.rest AS away_rest, fh.flags AS home_flags, fa.flags AS away_flags,
        nh_.net AS home_net_rtg_season, nh_.pace AS home_pace_lastn, na_.net AS away_net_rtg_season, na_.pace AS away_pace_lastn, ch.called AS home_callouts, ca_.called AS away_callouts, hh.injured AS home_injured, ha.injured AS away_injured
        FROM ga h JOIN et USING (game_id) LEFT JOIN oc USING (game_id) JOIN rs x ON x.game_id = h.game_id AND x.team_id = h.team_id JOIN rs y ON y.game_id = h.game_id AND y.team_id = h.opponent_team_id
        LEFT JOIN fw fh ON fh.team_id = h.team_id LEFT JOIN fw fa ON fa.team_id = h.opponent_team_id LEFT JOIN nm nh_ ON nh_.team_id = h.team_id LEFT JOIN nm na_ ON na_.team_id = h.opponent_team_id
        LEFT JOIN ca ch ON ch.team_id = h.team_id LEFT JOIN ca ca_ ON ca_.team_id = h.opponent_team_id LEFT JOIN hu hh ON hh.team_id = h.team_id LEFT JOIN hu ha ON ha.team_id = h.opponent_team_id WHERE h.is_home AND h.{_WEEK}""",
}
