"""Queries over provider payloads. The star tables are put into the nested shapes of the feeds, which are then read."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hardwood.functions import seasons
from hardwood.plans.bridge import SQL_GAMES, games, table
from hardwood.sources import feeds


def _schedule(spark, d):
    """Payloads of up to about 64 games of a date; games are final if the home team's turnovers are even, and one in fifty
    has no time."""
    g = games(spark, d).where("is_home")
    side = lambda team, pts: F.struct(F.col(team).alias("teamId"), F.col(pts).cast("int").alias("score"))
    time = F.when(F.col("game_id").cast("long") % 50 != 0, F.date_format("game_date", "yyyy-MM-dd'T'12:00:00'Z'"))
    one = F.struct(F.col("game_id").alias("gameId"), time.alias("gameDateTimeUTC"), F.when(F.col("tov") % 2 == 0, 3).otherwise(1).alias("gameStatus"), side("team_id", "pts").alias("homeTeam"), side("opponent_team_id", "o_pts").alias("awayTeam"))
    per_day = F.ceil(F.count("*").over(Window.partitionBy("game_date")) / 64)
    feed = g.withColumn("part", F.pmod(F.xxhash64("game_id"), per_day)).groupBy("game_date", "part").agg(F.array(F.struct(F.collect_list(one).alias("games"))).alias("gameDates"))
    return feeds.schedule_rows(feed).select("game_id", "team_id", "opponent_team_id", "home_or_away", "result", "score", F.to_date("game_date").alias("game_date"))


def _odds(spark, d):
    """One payload an order, a book for each line and market; every third book is abroad, and a price of 0 is none."""
    li = table(spark, d, "lineitem")
    book = lambda outcomes: F.struct(F.col("l_partkey").cast("string").alias("id"), F.lit("book").alias("name"), F.when(F.col("l_partkey") % 3 == 0, "CA").otherwise("US").alias("countryCode"), outcomes.alias("outcomes"))
    out = lambda kind, price, spread: F.struct(F.lit(kind).alias("type"), price.cast("string").alias("odds"), spread.cast("string").alias("spread"))
    none = F.lit(None).cast("string")
    home = F.max("l_discount").alias("home"), F.max("l_tax").alias("away"), F.max("l_quantity").alias("spread")
    rows = li.groupBy("l_orderkey", "l_partkey").agg(*home)
    two = book(F.array(out("home", F.col("home"), none), out("away", F.col("away"), none)))
    spread = book(F.array(out("home", none, -F.col("spread")), out("away", none, F.col("spread"))))
    g = rows.groupBy("l_orderkey").agg(F.collect_list(two).alias("two"), F.collect_list(spread).alias("spread"))
    market = lambda name, books: F.struct(F.lit(name).alias("name"), F.col(books).alias("books"))
    feed = g.select(F.array(F.struct(F.col("l_orderkey").cast("string").alias("gameId"), F.array(market("2way", "two"), market("spread", "spread")).alias("markets"))).alias("games"))
    return feeds.odds_rows(feed).select("game_id", "sportsbook_id", "home_odds", "away_odds", "home_spread", "away_spread")


def _availability(spark, d):
    """One payload an order: its customer at home, the next one away; who is out by status and priority."""
    o = table(spark, d, "orders")
    player = lambda i, status, played, reason: F.array(F.struct(i.alias("personId"), status.alias("status"), played.alias("played"), reason.alias("notPlayingReason")))
    status = F.when(F.col("o_orderstatus") == "F", "ACTIVE").when(F.col("o_orderstatus") == "O", "INACTIVE")
    reason = F.when(F.col("o_orderpriority") == "1-URGENT", "INACTIVE_INJURY").when(F.col("o_orderpriority") == "2-HIGH", " ")
    home = F.struct(F.lit(1).cast("long").alias("teamId"), player(F.col("o_custkey"), status, F.lit("1"), reason).alias("players"))
    away = F.struct(F.lit(2).cast("long").alias("teamId"), player(F.col("o_custkey") + 1, F.lit("ACTIVE"), F.when(F.col("o_orderpriority") != "5-LOW", "1"), F.lit(None).cast("string")).alias("players"))
    return feeds.availability_rows(o.select(F.col("o_orderkey").cast("string").alias("gameId"), home.alias("homeTeam"), away.alias("awayTeam"))).select("game_id", "team_id", "player_id", "status", "played")


def _records(spark, d):
    """Rows of part as header and row arrays, some hundred rows a payload, read back by name and counted."""
    p = table(spark, d, "part")
    payload = p.groupBy("p_brand", F.floor(F.col("p_partkey") / 4096).alias("part")).agg(F.collect_list(F.array(F.col("p_partkey").cast("string"), F.col("p_size").cast("string"))).alias("rowSet")).withColumn("headers", F.array(F.lit("KEY"), F.lit("SIZE")))
    r = feeds.records(payload).select(F.element_at("record", "KEY").cast("long").alias("key"), F.element_at("record", "SIZE").cast("int").alias("size"))
    return r.groupBy("size").agg(F.count("*").alias("parts"), F.max("key").alias("last"))


def _scoreboard(spark, d):
    """Games of 1998 with both line scores; a meeting of the two teams counts as the last one if it is the home team's
    newest game of the pair before the year."""
    g = games(spark, d)
    headers = g.where("is_home and year(game_date) = 1998").select("game_id", "team_id", "opponent_team_id")
    before = g.where("is_home and year(game_date) < 1998").groupBy("team_id", "opponent_team_id").agg(F.max(F.struct("game_date", F.col("game_id").alias("met"))).alias("m"))
    meetings = headers.join(before, ["team_id", "opponent_team_id"]).select("game_id", "m.met")
    s = feeds.scoreboard(headers.select("game_id"), g.select("game_id", "team_id", F.col("pts").alias("points")), meetings)
    return s.select("game_id", F.array_join(F.transform("line_scores", lambda x: F.concat_ws(":", x["team_id"].cast("string"), x["points"].cast("string"))), ",").alias("lines"), F.col("last_meeting.met").alias("last_meeting"))


def _standings(spark, d):
    """Standings of suppliers by region: those of two regions have no record in the first feed and come from the second."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    label = F.when(F.col("n_regionkey") < 2, " EASTERN").when(F.col("n_regionkey") < 4, "west").otherwise("other")
    text = lambda c: c.cast("string")

    def feed(wins):
        return feeds.standings_rows(s.select(label.alias("Conference"), text(F.col("s_suppkey")).alias("TeamID"), F.col("s_name").alias("TeamName"), text(wins).alias("WINS"), F.lit("0").alias("LOSSES"), F.lit(None).cast("string").alias("WinPCT"), F.lit("").alias("HOME"), F.lit("").alias("ROAD")))

    first = feed(F.when(F.col("n_regionkey") < 2, F.lit(0)).otherwise(F.col("s_suppkey") + 1))
    return feeds.standings(first, feed(F.col("s_suppkey") + 100)).select("conference", "team_id", "w")


def _sync(spark, d):
    """The seasons of players after a sync in which everyone with an urgent order is active."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("player_id"), seasons.season_of(F.to_date("o_orderdate")).alias("season"), "o_orderpriority")
    stored = o.where("o_orderpriority <> '1-URGENT'").groupBy("player_id").agg(F.array_sort(F.collect_set("season")).alias("available_seasons"))
    after = feeds.with_season(stored, o.where("o_orderpriority = '1-URGENT'"), "2001-02")
    return after.select("player_id", seasons.joined(F.col("available_seasons")).alias("seasons"))


QUERIES = {
    "schedule_feed": _schedule, "odds_feed": _odds, "availability_feed": _availability, "records_feed": _records, "scoreboard_feed": _scoreboard, "standings_feed": _standings, "player_sync": _sync,
}

_G = f"WITH {SQL_GAMES}"
ORACLE = {
    "schedule_feed": f"""{_G}, h AS (SELECT game_id, tov % 2 = 0 AS final FROM ga WHERE is_home AND CAST(game_id AS BIGINT) % 50 <> 0)
        SELECT game_id, team_id, opponent_team_id, CASE WHEN is_home THEN 'H' ELSE 'A' END AS home_or_away, CASE WHEN final THEN result END AS result, CASE WHEN final THEN score END AS score, game_date FROM ga JOIN h USING (game_id)""",
    "odds_feed": """SELECT lpad(CAST(l_orderkey AS VARCHAR), 10, '0') AS game_id, CAST(l_partkey AS VARCHAR) AS sportsbook_id, nullif(max(l_discount), 0) AS home_odds, nullif(max(l_tax), 0) AS away_odds, -max(l_quantity) AS home_spread, max(l_quantity) AS away_spread
        FROM lineitem WHERE l_partkey % 3 <> 0 GROUP BY l_orderkey, l_partkey""",
    "availability_feed": """SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS game_id, CAST(1 AS BIGINT) AS team_id, o_custkey AS player_id, CASE o_orderstatus WHEN 'F' THEN 'ACTIVE' WHEN 'O' THEN 'INACTIVE' END AS status, TRUE AS played FROM orders WHERE o_orderstatus <> 'F' OR o_orderpriority = '1-URGENT'
        UNION ALL SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0'), 2, o_custkey + 1, 'ACTIVE', FALSE FROM orders WHERE o_orderpriority = '5-LOW'""",
    "records_feed": "SELECT p_size AS size, count(*) AS parts, max(p_partkey) AS last FROM part GROUP BY p_size",
    "scoreboard_feed": f"""{_G}, b AS (SELECT team_id, opponent_team_id, max_by(game_id, (game_date, game_id)) AS met FROM ga WHERE is_home AND year(game_date) < 1998 GROUP BY ALL)
        SELECT h.game_id, CASE WHEN h.team_id < h.opponent_team_id THEN h.team_id || ':' || h.pts || ',' || h.opponent_team_id || ':' || h.o_pts ELSE h.opponent_team_id || ':' || h.o_pts || ',' || h.team_id || ':' || h.pts END AS lines, b.met AS last_meeting
        FROM ga h LEFT JOIN b USING (team_id, opponent_team_id) WHERE h.is_home AND year(h.game_date) = 1998""",
    "standings_feed": """SELECT CASE WHEN n_regionkey < 2 THEN 'East' WHEN n_regionkey < 4 THEN 'West' ELSE 'Unknown' END AS conference, s_suppkey AS team_id, CAST(CASE WHEN n_regionkey < 2 THEN s_suppkey + 100 ELSE s_suppkey + 1 END AS VARCHAR) AS w FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
    "player_sync": """WITH o AS (SELECT o_custkey AS player_id, CASE WHEN o_orderpriority = '1-URGENT' THEN '2001-02' ELSE printf('%04d-%02d', y, (y + 1) % 100) END AS season FROM (SELECT *, year(o_orderdate) - CASE WHEN month(o_orderdate) < 10 THEN 1 ELSE 0 END AS y FROM orders))
        SELECT player_id, array_to_string(list_sort(list_distinct(list(season))), ',') AS seasons FROM o GROUP BY player_id""",
}
