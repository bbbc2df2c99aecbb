"""Queries behind pages: as-of reads, rankings, odds and lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from hardwood.functions import ratings
from hardwood.operators import form, schedule, serving, teams
from hardwood.plans.availability import _S, statuses
from hardwood.plans.bridge import SQL_GAMES, SQL_LOGS, SQL_ODDS, games, logs, odds, orders, table
from hardwood.plans.players import _CUR, _HEAT, _win

_CUT = "2024-01-20 15:00:00"


def _snapshots(f):
    """Each event as a snapshot of its player: the value so far, known six hours later, every seventh one partial."""
    s = f.withColumn("feature_as_of", F.col("game_time").cast("timestamp"))
    s = s.withColumn("data_available_at", F.col("feature_as_of") + F.expr("INTERVAL 6 HOURS"))
    return s.withColumn("status", F.when(F.col("game_id").cast("long") % 7 == 0, "partial").otherwise("complete"))


def _as_of(spark, d):
    return serving.as_of(_snapshots(logs(spark, d)), ["player_id"], _CUT).select("player_id", "game_id", "value")


def _as_of_join(spark, d):
    """Every purchase with the player's last view strictly before it."""
    e = logs(spark, d, True).withColumn("at", F.col("game_time"))
    left = e.where("stat = 'purchase'").select("player_id", "game_id", "at")
    right = e.where("stat = 'view'").select("player_id", F.col("at").alias("seen"), F.col("value").alias("view_value"))
    return serving.as_of_join(left, right, ["player_id"], "at", "seen", ["view_value"])


def _pinned(spark, d):
    s = logs(spark, d).withColumn("feature_as_of", F.to_date("game_time"))
    hot = s.where("value >= 50")
    cut = serving.pinned(hot.where("feature_as_of <= '2024-01-20'"), {"all": s})["all"]
    return cut.groupBy("feature_as_of").agg(F.count("*").alias("rows_at_cutoff"), F.count_distinct("player_id").alias("players"))


def called_out(spark, d, k):
    """The callouts of ten teams; customers with urgent orders since August 1998 are injured. Also the injured rows."""
    f = form.complete(logs(spark, d))
    hurt = serving.injury_summary_rows(statuses(spark, d)).where("game_date >= '1998-08-01'").select("player_id", "game_date", F.col("not_playing_description").alias("description"))
    players = f.select("player_id").distinct().unionByName(hurt.select("player_id").distinct()).distinct().withColumn("team_id", F.col("player_id") % 10)
    heat, by_type = form.heat_index(f, (3, 5, 10), decimals=8), form.complete(logs(spark, d, True))
    return serving.callouts(players, heat, form.current_streaks(f, [10, 20, 50, 100]), form.stat_windows(f, [10, 20, 50, 100], (5, 10)), form.consistency(by_type, decimals=8), hurt, k), hurt


def _callouts(spark, d):
    c, _ = called_out(spark, d, 4)
    shown = lambda c, *parts: F.array_join(F.transform(c, lambda x: F.concat_ws(":", *(x[p].cast("string") for p in parts))), ",")
    return c.select(
        "team_id", "player_id", "score", F.col("position").cast("long").alias("position"), "consistency_tier", shown("heat", "window_size", "tier").alias("heat"),
        shown("streaks", "streak_games").alias("streaks"), shown("windows", "games_hit").alias("windows"), shown("injuries", "game_date").alias("injuries"),
    )


def _tiers(spark, d):
    h = form.heat_index(form.complete(logs(spark, d)), (5,), decimals=8)
    t = serving.tiers(h, {"on_fire": 20, "heating_up": 15, "cooling_off": 15, "ice_cold": 20, "average": 10})
    return t.select("tier", "player_id", "z_score", F.col("position").cast("long").alias("position"))


def _american(spark, d):
    o = odds(spark, d)
    h, a = ratings.american_odds(F.col("home_odds")), ratings.american_odds(F.col("away_odds"))
    return o.groupBy(h.alias("home_american"), a.alias("away_american"), ratings.signed(h).alias("home_text"), ratings.spread_text(F.round("home_spread", 1)).alias("spread")).agg(F.count("*").alias("prices"))


def _primary(spark, d):
    p = serving.primary_book(odds(spark, d))
    return p.select("game_id", "sportsbook_id", "n_books")


def _compare(spark, d):
    f = logs(spark, d, True)

    def avg(player):
        return f.where(F.col("player_id") == player).groupBy("stat").agg(F.avg("value").alias("season_avg"))

    c = serving.compare(avg(1), avg(2), {"click": 100.0, "error": 100.0, "purchase": 100.0, "signup": 100.0, "view": 100.0})
    return c.select("stat", "a_scaled", "b_scaled", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


def _slate(spark, d):
    """Games of a week with both teams' names, rest edge and consensus odds. Lines of other games are read for the
    teams' schedules only, up to the week."""
    o = orders(spark, d)
    week = o.where("game_date between '1998-03-01' and '1998-03-07'")
    sides = teams.pair_sides(games(spark, d, week, box=False), ["team_id"])
    f = schedule.factors(games(spark, d, o.where("game_date <= '1998-03-07'"), box=False))
    rest = f.where("game_date >= '1998-03-01'").select("game_id", "team_id", "rest_edge")
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("team_id"), F.col("s_name").alias("name"))
    s = sides.join(rest.withColumnsRenamed({"team_id": "home_team_id", "rest_edge": "home_edge"}), ["game_id", "home_team_id"], "left")
    s = s.join(serving.consensus_odds(odds(spark, d, week)), "game_id", "left")
    for side in ("home", "away"):
        s = s.join(names.withColumnsRenamed({"team_id": f"{side}_team_id", "name": f"{side}_name"}), f"{side}_team_id", "left")
    return s.select("game_id", "home_name", "away_name", "home_edge", "home_odds", "away_odds", "home_spread", "n_books")


def _report(spark, d):
    h = form.heat_index(form.complete(logs(spark, d)), (3, 5, 10), decimals=8)
    line = F.format_string("%-3d %8.3f %s", "window_size", "z_score", "status")
    return serving.text_report(h, "player_id", line, ["window_size"])


def _search(spark, d):
    return table(spark, d, "part").where(F.col("p_name").ilike("%RING%")).select("p_partkey", "p_name", F.initcap("p_name").alias("title"))


def _props(spark, d):
    e = table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("total"), F.max("k").alias("largest"), F.count("k").alias("n"))


def _vs(spark, d):
    """Games of a team, on either side: only orders with a line of that supplier are read into the shuffle."""
    mine = table(spark, d, "lineitem").where("l_suppkey = 7").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    g = games(spark, d, orders(spark, d).join(mine, "o_orderkey", "left_semi"), box=False)
    return g.where("team_id = 7 or opponent_team_id = 7").select("game_id").distinct()


def _ranks(spark, d):
    """The first 15 by rating; ranks are given to these alone, as no other row can share a better one."""
    g = teams.season_and_recent(games(spark, d), decimals=10).select("team_id", F.col("off_rtg_season").alias("rating"))
    return form.leaders(g, [F.desc("rating"), "team_id"], 15).withColumn("position", F.rank().over(form.Window.orderBy(F.desc("rating"))).cast("long"))


QUERIES = {
    "asof_latest_metrics": _as_of,
    "asof_join_backward": _as_of_join,
    "pinned_cutoff_bundle": _pinned,
    "latest_per_key": lambda s, d: serving.latest(logs(s, d), ["player_id"], [F.desc("game_time"), F.desc("game_id")]).select("player_id", "game_id", "value"),
    "latest_with_ties": lambda s, d: serving.latest_with_ties(games(s, d).select("team_id", "game_id", "game_date"), ["team_id"], "game_date"),
    "callouts_topk": _callouts,
    "heat_tier_lists": _tiers,
    "consensus_odds": lambda s, d: serving.consensus_odds(odds(s, d)),
    "american_odds": _american,
    "primary_book": _primary,
    "player_compare": _compare,
    "slate_assembly": _slate,
    "heat_text_report": _report,
    "ilike_search": _search,
    "json_props_extract": _props,
    "either_side_games": _vs,
    "rank_columns_top15": _ranks,
}

_L, _G = f"WITH {SQL_LOGS}", f"WITH {SQL_GAMES}"
_TIER = "CASE WHEN z_score >= 1 THEN 'on_fire' WHEN z_score >= 0.65 THEN 'heating_up' WHEN z_score >= -0.64 THEN 'average' WHEN z_score >= -1 THEN 'cooling_off' ELSE 'ice_cold' END"
_CON = """
co AS (SELECT game_id, round(avg(home_odds) FILTER (WHERE home_odds <> 0), 3) AS home_odds, round(avg(away_odds) FILTER (WHERE away_odds <> 0), 3) AS away_odds, round(avg(home_spread), 1) AS home_spread,
       count(*) AS n_books, string_agg(sportsbook_name, ',' ORDER BY sportsbook_name) AS books FROM od WHERE country_code = 'US' GROUP BY game_id)"""

_CALLED = f"""{_HEAT}, {_CUR}, {_win('5, 10')}, {_S},
        hi AS (SELECT player_id, game_date FROM st WHERE reason = 'INACTIVE_INJURY' AND game_date >= DATE '1998-08-01'),
        p AS (SELECT DISTINCT player_id, player_id % 10 AS team_id FROM (SELECT player_id FROM lg UNION ALL SELECT player_id FROM hi)),
        nh AS (SELECT player_id, window_size, z_score, {_TIER} AS tier FROM ht WHERE {_TIER} <> 'average'),
        z AS (SELECT player_id, sum(abs(z_score)) AS z_sum, string_agg(window_size || ':' || tier, ',' ORDER BY abs(z_score) DESC, window_size) AS heat FROM nh GROUP BY 1),
        s AS (SELECT player_id, max(c) AS n, string_agg(streak_games, ',' ORDER BY threshold) AS streaks FROM (SELECT *, count(*) OVER (PARTITION BY player_id) AS c FROM cs WHERE streak_games >= 3 QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY threshold) <= 3) GROUP BY 1),
        w AS (SELECT player_id, max(c) AS n, string_agg(games_hit, ',' ORDER BY threshold) AS windows FROM (SELECT *, count(*) OVER (PARTITION BY player_id) AS c FROM wn WHERE window_size = 10 AND games_hit * 100 >= games_played * 70 QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY threshold) <= 3) GROUP BY 1),
        i AS (SELECT player_id, string_agg(game_date, ',' ORDER BY game_date DESC) AS injuries FROM (SELECT * FROM hi QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY game_date DESC) <= 2) GROUP BY 1),
        te AS (SELECT user_id AS player_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, lpad(CAST(event_id AS VARCHAR), 10, '0') DESC) AS k FROM events),
        ct AS (SELECT player_id, event_type, w, stddev_samp(value) / avg(value) AS cv FROM te, (SELECT unnest([0, 10]) AS w) WHERE w = 0 OR k <= w GROUP BY ALL HAVING count(*) >= 5),
        cp AS (SELECT player_id, CASE WHEN count(*) FILTER (WHERE cv < 0.35::DOUBLE) > count(*) FILTER (WHERE cv > 0.55::DOUBLE) + 1 THEN 'steady' WHEN count(*) FILTER (WHERE cv > 0.55::DOUBLE) > count(*) FILTER (WHERE cv < 0.35::DOUBLE) + 1 THEN 'volatile' ELSE 'mixed' END AS tier FROM ct GROUP BY 1),
        q AS (SELECT team_id, player_id, round(coalesce(s.n, 0) * 10 + coalesce(z_sum, 0) + coalesce(w.n, 0) * 2, 4) AS score, coalesce(cp.tier, 'mixed') AS consistency_tier, heat, streaks, windows, injuries
              FROM p LEFT JOIN z USING (player_id) LEFT JOIN s USING (player_id) LEFT JOIN w USING (player_id) LEFT JOIN i USING (player_id) LEFT JOIN cp USING (player_id))"""


def _am(c):
    return f"CASE WHEN {c} >= 2 THEN CAST(trunc(({c} - 1) * 100) AS INTEGER) WHEN {c} > 1 THEN CAST(trunc(-100 / ({c} - 1)) AS INTEGER) END"


ORACLE = {
    "asof_latest_metrics": f"""{_L} SELECT player_id, game_id, value FROM lg WHERE game_time + INTERVAL 6 HOUR <= TIMESTAMP '{_CUT}' AND CAST(game_id AS BIGINT) % 7 <> 0
        QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY game_time DESC) = 1""",
    "asof_join_backward": """WITH p AS (SELECT user_id AS player_id, lpad(CAST(event_id AS VARCHAR), 10, '0') AS game_id, ts AS at FROM events WHERE event_type = 'purchase'),
        v AS (SELECT user_id AS player_id, ts, value FROM events WHERE event_type = 'view')
        SELECT p.player_id, p.game_id, p.at, v.value AS view_value FROM p ASOF LEFT JOIN v ON p.player_id = v.player_id AND p.at > v.ts""",
    "pinned_cutoff_bundle": f"""{_L}, d AS (SELECT *, CAST(game_time AS DATE) AS feature_as_of FROM lg), c AS (SELECT max(feature_as_of) AS m FROM d WHERE value >= 50 AND feature_as_of <= DATE '2024-01-20')
        SELECT feature_as_of, count(*) AS rows_at_cutoff, count(DISTINCT player_id) AS players FROM d JOIN c ON feature_as_of = m GROUP BY feature_as_of""",
    "latest_per_key": f"{_L} SELECT player_id, game_id, value FROM nl WHERE n_desc = 1",
    "latest_with_ties": f"{_G} SELECT team_id, game_id, game_date FROM ga QUALIFY rank() OVER (PARTITION BY team_id ORDER BY game_date DESC) = 1",
    "callouts_topk": f"{_L}, {_CALLED} SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY score DESC, player_id) AS position FROM q WHERE score > 0 OR injuries IS NOT NULL QUALIFY position <= 4",
    "heat_tier_lists": f"""{_L}, {_HEAT}, t AS (SELECT {_TIER} AS tier, player_id, z_score FROM ht WHERE window_size = 5)
        SELECT tier, player_id, z_score, row_number() OVER (PARTITION BY tier ORDER BY abs(z_score) DESC, player_id) AS position FROM t
        QUALIFY position <= CASE tier WHEN 'on_fire' THEN 20 WHEN 'ice_cold' THEN 20 WHEN 'average' THEN 10 ELSE 15 END""",
    "consensus_odds": f"WITH {SQL_ODDS}, {_CON} SELECT * FROM co",
    "american_odds": f"""WITH {SQL_ODDS}, a AS (SELECT {_am('home_odds')} AS h, {_am('away_odds')} AS a, round(home_spread, 1) AS s FROM od)
        SELECT h AS home_american, a AS away_american, CASE WHEN h > 0 THEN '+' || h ELSE CAST(h AS VARCHAR) END AS home_text, CASE WHEN s = 0 THEN 'PK' WHEN s IS NOT NULL THEN printf('%+.1f', s) END AS spread, count(*) AS prices FROM a GROUP BY ALL""",
    "primary_book": f"WITH {SQL_ODDS} SELECT game_id, sportsbook_id, count(*) OVER (PARTITION BY game_id) AS n_books FROM od QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY home_spread IS NULL, sportsbook_id, home_odds) = 1",
    "player_compare": """WITH m AS (SELECT user_id, event_type AS stat, avg(value) AS v FROM events WHERE user_id IN (1, 2) GROUP BY ALL), a AS (SELECT stat, v FROM m WHERE user_id = 1), b AS (SELECT stat, v FROM m WHERE user_id = 2)
        SELECT coalesce(a.stat, b.stat) AS stat, round(least(a.v, 100), 4) AS a_scaled, round(least(b.v, 100), 4) AS b_scaled, round(a.v, 4) AS a, round(b.v, 4) AS b FROM a FULL JOIN b ON a.stat = b.stat""",
    "slate_assembly": f"""{_G}, {SQL_ODDS}, {_CON},
        dd AS (SELECT DISTINCT team_id, game_date, game_date - DATE '1970-01-01' AS d FROM ga), de AS (SELECT team_id, game_date, d - lag(d) OVER (PARTITION BY team_id ORDER BY d) - 1 AS rest FROM dd),
        h AS (SELECT * FROM ga WHERE is_home AND game_date BETWEEN DATE '1998-03-01' AND DATE '1998-03-07')
        SELECT h.game_id, sh.s_name AS home_name, sa.s_name AS away_name, CASE WHEN x.rest - y.rest >= 2 THEN 'advantage' WHEN x.rest - y.rest <= -2 THEN 'disadvantage' WHEN x.rest - y.rest IS NOT NULL THEN 'even' END AS home_edge,
               home_odds, away_odds, home_spread, n_books
        FROM h LEFT JOIN co USING (game_id) JOIN supplier sh ON sh.s_suppkey = h.team_id JOIN supplier sa ON sa.s_suppkey = h.opponent_team_id
        LEFT JOIN de x ON x.team_id = h.team_id AND x.game_date = h.game_date LEFT JOIN de y ON y.team_id = h.opponent_team_id AND y.game_date = h.game_date""",
    "ilike_search": "SELECT p_partkey, p_name, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS title FROM part WHERE p_name ILIKE '%RING%'",
    "json_props_extract": "SELECT event_type, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS total, max(CAST(props->>'$.k' AS BIGINT)) AS largest, count(props->>'$.k') AS n FROM events GROUP BY event_type",
    "either_side_games": f"{_G} SELECT DISTINCT game_id FROM ga WHERE team_id = 7 OR opponent_team_id = 7",
    "rank_columns_top15": f"""{_G} SELECT team_id, rating, rank() OVER (ORDER BY rating DESC) AS position FROM (
        SELECT team_id, round(sum(pts) / (sum(fga * 100 + fta * 44 - oreb * 100 + tov * 100) / 100.0::DOUBLE) * 100, 10) AS rating FROM ga WHERE ok GROUP BY team_id) ORDER BY position, team_id LIMIT 15""",
    "heat_text_report": f"""{_L}, {_HEAT} SELECT player_id, string_agg(rpad(CAST(window_size AS VARCHAR), 3, ' ') || ' ' || lpad(printf('%.3f', z_score), 8, ' ') || ' ' || status, chr(10) ORDER BY window_size) AS report FROM ht GROUP BY player_id""",
}
