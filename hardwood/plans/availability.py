"""Queries over players' availability. An order is a game and its customer a player of the nation's team; the priority
stands for the reason, the status for the status."""

from __future__ import annotations

from pyspark.sql import functions as F

from hardwood.functions import ratings, seasons
from hardwood.operators import serving
from hardwood.plans.bridge import table
from hardwood.sources import feeds


def statuses(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    reason = F.when(p == "1-URGENT", "INACTIVE_INJURY").when(p == "2-HIGH", "INACTIVE_GLEAGUE_TWOWAY").when(p == "3-MEDIUM", "INACTIVE_REST").when(p == "5-LOW", "DND_OTHER")
    day = F.to_date("o_orderdate")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        seasons.game_id(F.col("o_orderkey")).alias("game_id"), F.col("o_custkey").alias("player_id"), F.col("c_name").alias("player_name"), F.col("c_nationkey").alias("team_id"), day.alias("game_date"), seasons.season_of(day).alias("season"),
        reason.alias("not_playing_reason"), F.when(F.col("o_totalprice") > 300000, "sore knee").when(F.col("o_totalprice") < 20000, "").alias("not_playing_description"), F.when(s == "F", "ACTIVE").when(s == "O", "INACTIVE").otherwise("OUT").alias("status"),
        ((s == "F") & p.isin("4-NOT SPECIFIED", "5-LOW")).alias("played"),
    )


def _summary(spark, d):
    s = serving.injury_summary(statuses(spark, d))
    text = F.transform("by_team", lambda t: F.concat(t["team_id"].cast("string"), F.lit(":"), F.array_join(F.transform(t["players"], lambda p: p["player_name"]), "/")))
    return s.select("game_date", F.col("total_injuries").cast("long").alias("total_injuries"), "teams_affected", F.array_join(F.array_sort(text), ";").alias("listing"))


def _history(spark, d):
    h = serving.injury_history(statuses(spark, d)).where("n_desc <= 3")
    return h.select("player_id", "game_id", "game_date", F.col("n_desc").cast("long").alias("n_desc"))


def _current(spark, d):
    return serving.current_injuries(statuses(spark, d)).select("team_id", "game_date", "player_id", "game_id")


def _display(spark, d):
    s = statuses(spark, d)
    r = F.col("not_playing_reason")
    shown = ratings.reason_text(r, F.col("not_playing_description"), F.col("status"), F.col("played"))
    return s.groupBy(shown.alias("shown"), ratings.is_injured(r).alias("injured"), ratings.is_gleague(r).alias("gleague")).agg(F.count("*").alias("rows"))


def _to_fetch(spark, d):
    """Games completed in March 1998 without a status row; only customers of even-numbered nations' regions have rows."""
    s = statuses(spark, d)
    schedule = s.select("game_id", "game_date", "season", "team_id", F.when(F.col("status") == "ACTIVE", "W").alias("result"), F.lit("H").alias("home_or_away"))
    return feeds.games_to_fetch(schedule, s.where("not_playing_reason is not null"), "1998-03-01", "1998-03-31").select("game_id", "game_date", "season", "team_id")


def _bounds(spark, d):
    s = statuses(spark, d)
    return feeds.season_bounds(s.select("season", "game_date", F.when(F.col("status") == "ACTIVE", "W").alias("result")))


def _tiers(spark, d):
    s = statuses(spark, d)
    each = [feeds.tier(s, "1999-00", k).agg(F.lit(k).alias("tier"), F.count("*").alias("rows"), F.count_distinct("season").alias("seasons")) for k in ("current", "recent", "all")]
    return each[0].unionByName(each[1]).unionByName(each[2])


def _rebuilt(spark, d):
    """Seasons of each customer, from the years of the first and last order, where none is stored; those with urgent
    orders have a stored one."""
    s = statuses(spark, d)
    p = s.groupBy("player_id").agg(F.min(F.year("game_date")).cast("string").alias("from_year"), F.max(F.year("game_date")).cast("string").alias("to_year"), F.max(F.when(F.col("not_playing_reason") == "INACTIVE_INJURY", "1990-91")).alias("stored"))
    p = p.withColumn("available_seasons", F.array_compact(F.array("stored", F.lit("198"))))
    return feeds.rebuilt_seasons(p, ["1996-97", "1997-98", "1999-00", "bad"]).select("player_id", seasons.joined(F.col("available_seasons")).alias("seasons"))


QUERIES = {
    "injury_summary": _summary, "injury_history": _history, "current_injuries": _current, "status_display": _display,
    "games_to_fetch": _to_fetch, "season_bounds": _bounds, "refresh_tiers": _tiers, "rebuilt_seasons": _rebuilt,
}

_S = """st AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS game_id, o_custkey AS player_id, c_name AS player_name, c_nationkey AS team_id, CAST(o_orderdate AS DATE) AS game_date,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'INACTIVE_INJURY' WHEN '2-HIGH' THEN 'INACTIVE_GLEAGUE_TWOWAY' WHEN '3-MEDIUM' THEN 'INACTIVE_REST' WHEN '5-LOW' THEN 'DND_OTHER' END AS reason, o_totalprice AS price, o_orderstatus AS os, o_orderpriority AS pr,
    printf('%04d-%02d', y, (y + 1) % 100) AS season FROM (SELECT *, year(o_orderdate) - CASE WHEN month(o_orderdate) < 10 THEN 1 ELSE 0 END AS y FROM orders) JOIN customer ON c_custkey = o_custkey)"""

ORACLE = {
    "injury_summary": f"""WITH {_S}, t AS (SELECT game_date, team_id, count(*) AS n, string_agg(player_name, '/' ORDER BY player_name) AS names FROM st WHERE reason = 'INACTIVE_INJURY' GROUP BY ALL)
        SELECT game_date, CAST(sum(n) AS BIGINT) AS total_injuries, count(*) AS teams_affected, string_agg(team_id || ':' || names, ';' ORDER BY team_id || ':' || names) AS listing FROM t GROUP BY game_date""",
    "injury_history": f"WITH {_S} SELECT player_id, game_id, game_date, row_number() OVER (PARTITION BY player_id ORDER BY game_date DESC, game_id DESC) AS n_desc FROM st WHERE reason = 'INACTIVE_INJURY' QUALIFY n_desc <= 3",
    "current_injuries": f"WITH {_S}, l AS (SELECT *, max(game_date) OVER (PARTITION BY player_id) AS last FROM st WHERE reason = 'INACTIVE_INJURY') SELECT team_id, game_date, player_id, game_id FROM l WHERE game_date = last",
    "status_display": f"""WITH {_S} SELECT CASE WHEN os = 'F' AND pr IN ('4-NOT SPECIFIED', '5-LOW') THEN 'Played' WHEN price > 300000 THEN 'sore knee' WHEN reason = 'INACTIVE_INJURY' THEN 'Injured' WHEN reason = 'INACTIVE_GLEAGUE_TWOWAY' THEN 'G-League'
        WHEN reason = 'INACTIVE_REST' THEN 'Rest' WHEN reason IS NOT NULL THEN reason WHEN os = 'O' THEN 'Inactive' ELSE 'Did Not Play' END AS shown, coalesce(reason = 'INACTIVE_INJURY', FALSE) AS injured, coalesce(reason = 'INACTIVE_GLEAGUE_TWOWAY', FALSE) AS gleague, count(*) AS "rows" FROM st GROUP BY ALL""",
    "games_to_fetch": f"WITH {_S} SELECT game_id, game_date, season, team_id FROM st WHERE os = 'F' AND reason IS NULL AND game_date BETWEEN DATE '1998-03-01' AND DATE '1998-03-31'",
    "season_bounds": f"WITH {_S} SELECT season, min(game_date) AS first_game, max(game_date) FILTER (WHERE os = 'F') AS last_completed FROM st GROUP BY season",
    "refresh_tiers": f"""WITH {_S}, r AS (SELECT DISTINCT season, player_id FROM st) SELECT 'current' AS tier, count(*) AS "rows", count(DISTINCT season) AS seasons FROM r WHERE season = '1999-00'
        UNION ALL SELECT 'recent', count(*), count(DISTINCT season) FROM r WHERE season IN ('1997-98', '1998-99', '1999-00') UNION ALL SELECT 'all', count(*), count(DISTINCT season) FROM r""",
    "rebuilt_seasons": f"""WITH {_S}, p AS (SELECT player_id, min(year(game_date)) AS a, max(year(game_date)) AS b, max(CASE WHEN reason = 'INACTIVE_INJURY' THEN '1990-91,198' END) AS stored FROM st GROUP BY player_id)
        SELECT player_id, coalesce(stored, array_to_string(list_filter(['1996-97', '1997-98', '1999-00'], lambda s: CAST(s[1:4] AS INTEGER) BETWEEN a AND b), ',')) AS seasons FROM p""",
}
