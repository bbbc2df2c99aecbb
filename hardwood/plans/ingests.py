"""Feeds on their way into stored tables: checked, completed from what is stored, and merged by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hardwood.functions import ratings, seasons
from hardwood.operators import reading, schedule, snapshots, teams, upsert
from hardwood.plans.availability import _S, statuses
from hardwood.plans.bridge import SQL_GAMES, games, table
from hardwood.plans.team_games import _ENV, _FL, _M, _facts, _season
from hardwood.session import run_folder
from hardwood.sources import feeds

TODAY, RECENT = "1998-03-20", 60


def _refresh(spark, d):
    """Customers whose orders have to be fetched again: those with few stored ones, with a recent one that isn't stored,
    or with a very large order, which is always fetched."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("player_id"), seasons.game_id(F.col("o_orderkey")).alias("game_id"), F.to_date("o_orderdate").alias("game_date"), "o_orderpriority", "o_totalprice")
    o = o.where(F.col("game_date") <= TODAY)
    stored = o.where("o_orderpriority <> '1-URGENT'")
    forced = o.where("o_totalprice > 400000").select("player_id")
    return feeds.needs_refresh(o.select("player_id", "game_id", "game_date"), stored.select("player_id", "game_id"), TODAY, RECENT, 5, forced)


def _marker(spark, d):
    """A marker with the time of the newest event, written whole, read back, and held against later times."""
    path = f"{run_folder(spark, 'marker')}/done.json"
    newest = table(spark, d, "events").agg(F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("t")).first().t
    upsert.write_marker(spark, path, {"completed_at": "2000-01-01T00:00:00"})
    upsert.write_marker(spark, path, {"completed_at": newest})
    marker = spark.read.schema("completed_at string").json(path)
    each = [feeds.is_stale(marker, f"{newest[:10]} 00:00:00", 1).withColumn("at", F.lit("before")), feeds.is_stale(marker, "2024-03-01 00:00:00").withColumn("at", F.lit("a month later")), feeds.is_stale(marker.where("completed_at is null"), newest).withColumn("at", F.lit("no marker"))]
    return reduce(DataFrame.unionByName, each).withColumn("completed_at", F.lit(newest))


def _logs(spark, d):
    """Game logs of events under a feed's names, malformed ids and unknown players left out, merged into those stored
    before the 20th."""
    e = table(spark, d, "events")
    feed = e.select(F.when(F.col("event_id") % 41 == 0, "n/a").otherwise(F.col("event_id").cast("string")).alias("Game_ID"), F.col("user_id").alias("Player_ID"), F.round("value").cast("int").alias("PTS"), F.col("ts").alias("GAME_DATE"))
    rows = feeds.game_logs(feed, {"Game_ID": "game_id", "Player_ID": "player_id", "PTS": "points", "GAME_DATE": "at"})
    known = feeds.known_only(rows, player_id=table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("player_id")))
    known = known.select("player_id", "game_id", "points", seasons.season_of(F.to_date("at")).alias("season"), "at")
    stored = known.where("at < '2024-01-20'").withColumn("points", F.lit(0)).drop("at")
    return upsert.merged_table("gamelogs", stored, known.where("at >= '2024-01-10'"), "at")


def _rosters(spark, d):
    """Rosters of nations: the first row of a customer counts; players of the teams of one region, each row once."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    number = F.when(F.col("c_custkey") % 3 == 0, "00x").otherwise((F.col("c_custkey") % 100).cast("string"))
    one = c.select(F.col("c_custkey").cast("string").alias("player_id"), F.concat(F.lit(" "), "c_name").alias("name"), number.alias("number"), F.col("c_nationkey"), "n_regionkey", F.lit(2).alias("position"))
    again = one.withColumns({"name": F.lit("Other"), "position": F.lit(3)})
    bad = one.withColumns({"player_id": F.lit("x"), "position": F.lit(1)})
    roster = feeds.resolved_roster(one.unionByName(again).unionByName(bad), table(spark, d, "customer").select(F.col("c_custkey").alias("player_id")))
    named = roster.join(one.select(F.col("player_id").cast("long").alias("player_id"), F.col("c_nationkey").alias("team_id"), "n_regionkey"), "player_id")
    return feeds.team_players(named, named.where("n_regionkey = 1").select("team_id")).select("team_id", "player_id", "name", "number")


VALID = ["1995-96", "1996-97", "1997-98", "1998-99"]


def _bios(spark, d):
    """Bios of customers that aren't stored yet, which are those with an urgent order, from their first and last orders."""
    s = statuses(spark, d)
    p = s.groupBy("player_id").agg(F.min("player_name").alias("name"), F.min(F.year("game_date")).cast("string").alias("from_year"), F.max(F.year("game_date")).cast("string").alias("to_year"), F.date_format(F.min("game_date"), "yyyy-MM-dd").alias("birthdate"), F.count("*").cast("string").alias("weight"), F.when(F.count("*") > 10, "R").otherwise("3").alias("exp"))
    out = feeds.bios(p, s.where("not_playing_reason = 'INACTIVE_INJURY'").select("player_id").distinct(), VALID, 2025)
    return out.withColumn("available_seasons", seasons.joined(F.col("available_seasons")))


def _schedule(spark, d):
    """Games between suppliers with a positive balance, merged into the stored ones, which have no result yet."""
    g = games(spark, d).select("game_id", "season", "team_id", "opponent_team_id", "game_date", F.when(F.col("is_home"), "H").otherwise("A").alias("home_or_away"), "result", "score")
    known = feeds.known_schedule(g, table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("team_id")))
    stored = g.where("season < '1997-98'").withColumns({"result": F.lit(None).cast("string"), "score": F.lit("-")})
    merged = upsert.merged(stored, known.where("season >= '1996-97'"), ["game_id", "team_id"])
    return merged.groupBy("season", "result").agg(F.count("*").alias("rows"), F.count_if(F.col("score") == "-").alias("open"), F.max("game_id").alias("last"))


def _boxes(spark, d):
    """Team box scores of a feed, with dates as it writes them, completed from the schedule and merged by game and team."""
    g = games(spark, d)
    feed = g.select(F.col("game_id").cast("long").cast("string").alias("game_id"), "team_id", F.upper(F.date_format("game_date", "MMM dd, yyyy")).alias("game_date"), "pts", "tov")
    box = feeds.team_box_scores(feed, g.where("tov % 2 = 0").select("game_id", "team_id", "opponent_team_id"))
    box = box.select("game_id", "team_id", "opponent_team_id", "season", "game_date", "pts")
    out = upsert.merged_table("team_game_stats", box.where("season <= '1997-98'").withColumn("pts", -F.col("pts")), box.where("season >= '1997-98'"))
    return out.groupBy("season").agg(F.count("*").alias("rows"), F.sum("pts").alias("points"), F.count_distinct("opponent_team_id").alias("opponents"), F.max("game_date").alias("last"))


def _stamped(spark, d):
    """Status rows of a feed with the date and season of their games, merged by game and player; recorded_at stays."""
    s = statuses(spark, d)
    rows = s.where("not_playing_reason is not null").select("game_id", "player_id", F.col("not_playing_reason").alias("reason"))
    out = feeds.stamped(rows, s.where("status <> 'OUT'")).withColumn("recorded_at", F.lit("2030-01-01").cast("date"))
    new = out.where("game_date >= '1998-01-01'").withColumns({"reason": F.lit("CONFIRMED"), "recorded_at": F.lit("2031-01-01").cast("date")})
    merged = upsert.merged_table("player_game_status", out.where("game_date < '1998-06-01'"), new)
    return merged.groupBy("season", "reason", "recorded_at").agg(F.count("*").alias("rows"))


def _lineups(spark, d):
    """Lineups of two customers of a nation, most used and with most minutes, matched to the roster by short names."""
    names = F.concat(F.element_at(F.array(*map(F.lit, ("Al", "Bo", "Cy", "Di"))), (F.col("c_custkey") % 4 + 1).cast("int")), F.lit(" N"), F.col("c_custkey").cast("string"), F.lit("x"))
    roster = table(spark, d, "customer").select(F.col("c_nationkey").alias("team_id"), F.col("c_custkey").alias("player_id"), names.alias("player_name"))
    short = F.concat(F.substring("player_name", 1, 1), F.lit(". "), F.element_at(F.split("player_name", " "), 2))
    pair = roster.select("team_id", "player_id", short.alias("short"), F.lead(short).over(Window.partitionBy("team_id").orderBy("player_id")).alias("other")).where("other is not null")
    groups = pair.select("team_id", F.concat_ws(" - ", "short", "other").alias("group_name"), (F.col("player_id") * 7919 % 97).cast("int").alias("gp"), (F.col("player_id") * 104729 % 101).cast("double").alias("minutes"))
    out = feeds.lineups(groups, roster)
    return out.withColumn("player_ids", F.array_join(F.transform("player_ids", lambda x: x.cast("string")), ","))


def _dashboards(spark, d):
    """Season totals of players over a range of seasons under the table's names, in bulk; seasons fetched again replace
    those that are stored."""
    g = games(spark, d).withColumn("y", seasons.season_start(F.col("season")))
    wanted = F.array_contains(feeds.season_range(1996, 1998), F.col("season"))
    feed = g.where(wanted).groupBy("team_id", "season").agg(F.count("*").alias("GP"), F.sum("pts").alias("PTS"), F.sum("tov").alias("TOV"))
    rows = feeds.renamed(feed, {"team_id": "player_id", "season": "season", "GP": "gp", "PTS": "pts", "TOV": "tov"})
    stored = rows.where("season < '1998-99'").withColumn("pts", F.lit(0).cast("long"))
    return upsert.merged(stored, rows.where("season >= '1997-98'"), ["player_id", "season"])


def _families(spark, d):
    """Metrics, flags, environments and schedule factors of teams, each merged by its key into the rows of an earlier day."""
    g = games(spark, d)
    day, key = F.lit("1998-08-01").cast("date"), {"season": F.lit("1997-98")}
    m = _season(g)
    march = g.where("game_date between '1998-03-01' and '1998-03-07'")
    features = snapshots.team_features(march, _facts(g.where("game_date <= '1998-03-07' and season = '1997-98'")))
    made = {
        "team_metrics": m.select("team_id", F.col("net_rtg_season").alias("value")).withColumns({"stat_date": day, "window_size": F.lit(10), **key}),
        "team_flags": teams.flags(m).select("team_id", F.col("flag").alias("flag_type"), F.col("delta").alias("value")).withColumns({"stat_date": day, **key}),
        "game_environment": snapshots.game_environments(features).select("game_id", "game_date", F.size("tags").cast("double").alias("value"), "season"),
        "schedule_factors": schedule.factors(march).select("game_id", "team_id", F.col("days_rest").cast("double").alias("value")).withColumns(key),
    }
    out = []
    for name, rows in made.items():
        old = rows.where(F.col("value") > 0).withColumn("value", F.lit(-1.0)).select(*rows.columns)
        merged = upsert.merged_table(name, old, rows.where("value is null or value > 1 or value < 0"))
        out.append(merged.agg(F.lit(name).alias("table"), F.count("*").alias("rows"), F.count_if(F.col("value") == -1.0).alias("kept")))
    return reduce(DataFrame.unionByName, out)


def _rebuilt(spark, d):
    """A stored table of counts by season, of which one season is replaced by its recount and one has never been there."""
    path = f"{run_folder(spark, 'seasons')}/t"
    g = games(spark, d).groupBy("season", "team_id").agg(F.count("*").alias("games"), F.sum("pts").alias("pts"))
    upsert.replace_partitions(g.where("season <> '1998-99'").withColumn("pts", F.lit(0).cast("long")), path, "season")
    upsert.replace_partitions(g.where("season in ('1997-98', '1998-99') and games > 1"), path, "season")
    return spark.read.schema("team_id long, games long, pts long, season string").parquet(path).groupBy("season").agg(F.count("*").alias("teams"), F.sum("pts").alias("pts"))


def _codes(spark, d):
    """Names in lower case, spellings of season types, environment labels, and whether a table has such rows."""
    li = table(spark, d, "lineitem")
    low = feeds.lower_names(li.select(F.struct(F.col("l_suppkey").alias("Mode"), F.col("l_orderkey").alias("KEY")).alias("Line"), (F.col("l_quantity") * 2 + 50).alias("Pace")))
    kind = seasons.season_type(F.element_at(F.array(*map(F.lit, ("regular_season", "PLAYOFFS", "Preseason", "other"))), (F.col("line.key") % 4 + 1).cast("int")))
    pace, scoring = ratings.environment_label(F.col("pace"), F.col("pace") + 3)
    there = [reading.exists(li, c) for c in ("l_quantity > 40", "l_quantity > 4000")]
    return low.groupBy(kind.alias("kind"), pace.alias("pace"), scoring.alias("scoring")).agg(F.count("*").alias("rows"), F.max("line.mode").alias("mode")).withColumns({"large": F.lit(there[0]), "huge": F.lit(there[1])})


QUERIES = {
    "refresh_decisions": _refresh, "marker_staleness": _marker, "gamelog_ingest": _logs, "roster_ingest": _rosters, "bio_ingest": _bios, "schedule_ingest": _schedule, "team_box_ingest": _boxes,
    "availability_ingest": _stamped, "lineup_scan": _lineups, "dashboard_ingest": _dashboards, "team_family_upserts": _families, "season_rebuild": _rebuilt, "feed_codes": _codes,
}

_G = f"WITH {SQL_GAMES}"
_MARCH = "game_date BETWEEN DATE '1998-03-01' AND DATE '1998-03-07'"
_SPAN = "array_to_string(list_filter(['1995-96', '1996-97', '1997-98', '1998-99'], lambda s: CAST(s[1:4] AS INTEGER) BETWEEN {a} AND {b}), ',')"
_NEWEST = "(SELECT max(ts) FROM events)"

ORACLE = {
    "refresh_decisions": f"""WITH o AS (SELECT *, CAST(o_orderdate AS DATE) AS day, o_orderpriority <> '1-URGENT' AS stored FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '{TODAY}')
        SELECT o_custkey AS player_id, bool_or(o_totalprice > 400000) OR count(*) FILTER (WHERE stored) < 5 OR bool_or(NOT stored AND DATE '{TODAY}' - day <= {RECENT}) AS refresh FROM o GROUP BY 1""",
    "marker_staleness": f"""SELECT CASE k WHEN 0 THEN 'before' WHEN 1 THEN 'a month later' ELSE 'no marker' END AS at, CASE k WHEN 0 THEN FALSE WHEN 1 THEN TIMESTAMP '2024-03-01' - {_NEWEST} > INTERVAL 30 HOUR ELSE TRUE END AS stale,
        strftime({_NEWEST}, '%Y-%m-%dT%H:%M:%S') AS completed_at FROM range(3) t(k)""",
    "gamelog_ingest": """SELECT user_id AS player_id, lpad(CAST(event_id AS VARCHAR), 10, '0') AS game_id, CASE WHEN ts >= '2024-01-10' THEN CAST(round(value) AS INTEGER) ELSE 0 END AS points, '2023-24' AS season
        FROM events JOIN customer ON c_custkey = user_id AND c_acctbal > 0 WHERE event_id % 41 <> 0""",
    "roster_ingest": "SELECT c_nationkey AS team_id, c_custkey AS player_id, c_name AS name, CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_custkey % 100 AS INTEGER) END AS number FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1",
    "bio_ingest": f"""WITH {_S}, p AS (SELECT player_id, min(player_name) AS name, CAST(count(*) AS INTEGER) AS weight, min(game_date) AS born_date, max(game_date) AS last FROM st GROUP BY 1 HAVING count(*) FILTER (WHERE reason = 'INACTIVE_INJURY') = 0)
        SELECT player_id, name, weight, born_date, CAST(2025 - year(born_date) AS INTEGER) AS age, CASE WHEN weight <= 10 THEN CAST(3 AS INTEGER) END AS exp, {_SPAN.format(a='year(born_date)', b='year(last)')} AS available_seasons FROM p WHERE available_seasons <> ''""",
    "schedule_ingest": f"""{_G}, k AS (SELECT ga.* FROM ga JOIN supplier x ON x.s_suppkey = team_id AND x.s_acctbal > 0 JOIN supplier y ON y.s_suppkey = opponent_team_id AND y.s_acctbal > 0),
        m AS (SELECT season, result, score, game_id FROM k WHERE season >= '1996-97' UNION ALL SELECT season, NULL, '-', game_id FROM ga WHERE season < '1997-98' AND NOT (season >= '1996-97' AND (game_id, team_id) IN (SELECT game_id, team_id FROM k)))
        SELECT season, result, count(*) AS "rows", count(*) FILTER (WHERE score = '-') AS open, max(game_id) AS last FROM m GROUP BY season, result""",
    "team_box_ingest": f"""{_G} SELECT season, count(*) AS "rows", CAST(sum(CASE WHEN season < '1997-98' THEN -pts ELSE pts END) AS BIGINT) AS points, count(DISTINCT opponent_team_id) AS opponents, max(game_date) AS last FROM ga WHERE tov % 2 = 0 GROUP BY season""",
    "availability_ingest": f"""WITH {_S}, r AS (SELECT game_id, player_id, season, reason, game_date FROM st WHERE reason IS NOT NULL AND os IN ('F', 'O'))
        SELECT season, CASE WHEN game_date >= DATE '1998-01-01' THEN 'CONFIRMED' ELSE reason END AS reason, CASE WHEN game_date < DATE '1998-06-01' THEN DATE '2030-01-01' ELSE DATE '2031-01-01' END AS recorded_at, count(*) AS "rows" FROM r GROUP BY ALL""",
    "lineup_scan": """WITH r AS (SELECT c_nationkey AS team_id, c_custkey AS player_id, ['A', 'B', 'C', 'D'][c_custkey % 4 + 1] || '. N' || c_custkey || 'x' AS s FROM customer),
        g AS (SELECT *, lead(s) OVER w AS o, lead(player_id) OVER w AS p, CAST(player_id * 7919 % 97 AS INTEGER) AS gp, player_id * 104729 % 101 AS minutes, s || ' - ' || lead(s) OVER w AS lineup FROM r WINDOW w AS (PARTITION BY team_id ORDER BY player_id)),
        k AS (SELECT * FROM g WHERE o IS NOT NULL)
        SELECT team_id, 'most_used' AS kind, lineup, gp, player_id || ',' || p AS player_ids FROM k QUALIFY row_number() OVER (PARTITION BY team_id ORDER BY gp DESC, lineup DESC) = 1
        UNION ALL SELECT team_id, 'most_recent', lineup, gp, player_id || ',' || p FROM k QUALIFY row_number() OVER (PARTITION BY team_id ORDER BY minutes DESC, lineup DESC) = 1""",
    "dashboard_ingest": f"""{_G} SELECT team_id AS player_id, season, count(*) AS gp, CAST(CASE WHEN season >= '1997-98' THEN sum(pts) ELSE 0 END AS BIGINT) AS pts, CAST(sum(tov) AS BIGINT) AS tov FROM ga WHERE season IN ('1996-97', '1997-98', '1998-99') GROUP BY team_id, season""",
    "team_family_upserts": f"""{_G}, {_M}, {_FL}, {_ENV.lstrip()}, dd AS (SELECT DISTINCT team_id, game_date FROM ga WHERE {_MARCH}), de AS (SELECT team_id, game_date, game_date - lag(game_date) OVER (PARTITION BY team_id ORDER BY game_date) - 1 AS v FROM dd),
        v AS (SELECT 'team_metrics' AS t, net_rtg_season AS v FROM md UNION ALL SELECT 'team_flags', delta FROM fl UNION ALL SELECT 'game_environment', CASE WHEN tags = '' THEN 0 ELSE len(string_split(tags, ',')) END FROM et JOIN (SELECT DISTINCT game_id FROM ga WHERE {_MARCH}) USING (game_id)
              UNION ALL SELECT 'schedule_factors', v FROM ga JOIN de USING (team_id, game_date))
        SELECT t AS "table", count(*) FILTER (WHERE v IS NULL OR v > 0 OR v < 0) AS "rows", count(*) FILTER (WHERE v > 0 AND v <= 1) AS kept FROM v GROUP BY t""",
    "season_rebuild": f"""{_G}, c AS (SELECT season, team_id, count(*) AS games, sum(pts) AS pts FROM ga GROUP BY ALL) SELECT season, count(*) AS teams, CAST(sum(CASE WHEN season IN ('1997-98', '1998-99') THEN pts ELSE 0 END) AS BIGINT) AS pts FROM c WHERE season NOT IN ('1997-98', '1998-99') OR games > 1 GROUP BY season""",
    "feed_codes": """WITH p AS (SELECT CASE l_orderkey % 4 WHEN 0 THEN 'Regular Season' WHEN 1 THEN 'Playoffs' WHEN 2 THEN 'Pre Season' END AS kind, l_quantity * 2 + 50 AS p, l_suppkey FROM lineitem)
        SELECT kind, CASE WHEN p > 102 THEN 'fast' WHEN p < 96 THEN 'slow' ELSE 'average' END AS pace, CASE WHEN p + 3 > 105 THEN 'high' WHEN p + 3 < 95 THEN 'low' ELSE 'average' END AS scoring, count(*) AS "rows", max(l_suppkey) AS mode, TRUE AS large, FALSE AS huge FROM p GROUP BY ALL""",
}
