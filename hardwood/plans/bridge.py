"""The star tables as game logs, games and odds, in Spark and, word for word, in DuckDB.

A player's game is a row of events, with the event type as stat. A game is an order whose first two lines come from
different suppliers: the home and the away team, each line its box score, scaled so that possessions, points and shares
lie where those of real games do. One box in 89 lacks its defensive rebounds, and some games end level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hardwood.functions import seasons
from hardwood.operators.teams import OPPONENT

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
BOX = ("fg", "fga", "fg3", "fta", "oreb", "dreb", "tov", "pts", "paint", "fb")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def logs(spark: SparkSession, sf_dir: str, by_type: bool = False) -> DataFrame:
    """player_id, stat, game_id, game_time, value."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("player_id"), (F.col("event_type") if by_type else F.lit("ALL")).alias("stat"), seasons.game_id(F.col("event_id")).alias("game_id"), F.col("ts").alias("game_time"), "value")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("game_date"))


def games(spark: SparkSession, sf_dir: str, of: DataFrame | None = None, box: bool = True) -> DataFrame:
    """Two rows a game: game_id, season, game_date, team_id, opponent_team_id, is_home, box score, the opponent's box as
    o_*, result (null if level) and score.

    of: some rows of `orders`; their lines alone are then read into the shuffle. box: without it, who plays whom and when
    only. Each task cuts the lines of its orders to the first two, raw, before they are brought together; boxes are made of
    what is left."""
    o = orders(spark, sf_dir) if of is None else of
    raw = [*LINE_ORDER, *(["l_discount", "l_tax"] if box else [])]
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", *raw)
    if of is not None:
        li = li.join(of.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")

    def line(c):
        q, part, pts = c("l_quantity"), c("l_partkey"), F.floor(c("l_extendedprice")) % 51 + 85
        stats = {
            "fg": F.floor(q * 0.4 + 18), "fga": q + 60, "fg3": F.floor(q * 0.2 + 8), "fta": F.round(c("l_discount") * 100) + 20, "oreb": F.round(c("l_tax") * 100) + 6,
            "dreb": F.when(part % 89 != 0, part % 20 + 20), "tov": part % 14 + 8, "pts": pts, "paint": F.floor(pts * (part % 25 + 30) / 100), "fb": F.floor(pts * (part % 11 + 8) / 100),
        } if box else {}
        return F.struct(c("l_suppkey").alias("team"), *(v.cast("long").alias(n) for n, v in stats.items()))

    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    two = li.withColumn("_n", F.row_number().over(w)).where("_n <= 2")
    pair = two.withColumn("_a", F.lead(F.struct(*raw)).over(w)).where("_n = 1 and _a.l_suppkey <> l_suppkey")
    g = pair.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "game_date", line(F.col).alias("h"), line(lambda c: F.col(f"_a.{c}")).alias("a"))

    keys = [seasons.game_id(F.col("l_orderkey")).alias("game_id"), seasons.season_of(F.col("game_date")).alias("season"), "game_date"]
    if not box:
        both = F.array(*(F.struct(F.col(f"{a}.team").alias("team_id"), F.col(f"{b}.team").alias("opponent_team_id"), F.lit(a == "h").alias("is_home")) for a, b in ("ha", "ah")))
        return g.select(*keys, F.inline(both))

    def side(own, other, home):
        won = F.when(F.col(f"{own}.pts") > F.col(f"{other}.pts"), "W").when(F.col(f"{own}.pts") < F.col(f"{other}.pts"), "L")
        opponent = [F.col(f"{other}.{c}").alias(f"o_{c}") for c in OPPONENT]
        return F.struct(F.lit(home).alias("is_home"), F.col(own).alias("b"), F.col(f"{other}.team").alias("opponent_team_id"), won.alias("result"), *opponent)

    score = F.concat_ws("-", F.col("h.pts").cast("string"), F.col("a.pts").cast("string"))
    both = g.select(*keys, score.alias("score"), F.explode(F.array(side("h", "a", True), side("a", "h", False))).alias("s"))
    return both.select("game_id", "season", "game_date", F.col("s.b.team").alias("team_id"), "s.opponent_team_id", "s.is_home", *(f"s.b.{c}" for c in BOX), *(f"s.o_{c}" for c in OPPONENT), "s.result", "score")


def odds(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """One row a line: the order is the game, the supplier the book; some books are Canadian, some of no known country, some
    spreads are zero and some missing. of: some rows of `orders`."""
    li = table(spark, sf_dir, "lineitem")
    if of is not None:
        li = li.join(of.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    book = F.col("l_suppkey")
    spread = F.when(F.col("l_partkey") % 11 != 0, F.round(F.col("l_tax") * 100) - 4)
    return li.select(
        seasons.game_id(F.col("l_orderkey")).alias("game_id"), book.alias("sportsbook_id"), F.concat(F.lit("Book "), book.cast("string")).alias("sportsbook_name"), F.when(book % 7 != 3, "US").when(book % 2 == 0, "CA").alias("country_code"),
        (F.col("l_discount") * 10 + 1.0103).alias("home_odds"), (F.lit(2.5003) - F.col("l_discount") * 10).alias("away_odds"), spread.alias("home_spread"),
    )


SQL_LOGS = """
lg AS (SELECT user_id AS player_id, 'ALL' AS stat, lpad(CAST(event_id AS VARCHAR), 10, '0') AS game_id, ts AS game_time, value FROM events),
nl AS (SELECT *, row_number() OVER (PARTITION BY player_id, stat ORDER BY game_time DESC, game_id DESC) AS n_desc,
       row_number() OVER (PARTITION BY player_id, stat ORDER BY game_time, game_id) AS n_asc FROM lg)"""

SQL_LOGS_BY_TYPE = SQL_LOGS.replace("'ALL' AS stat", "event_type AS stat")

SQL_GAMES = """
li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n,
       CAST(floor(l_extendedprice) AS BIGINT) % 51 + 85 AS p FROM lineitem),
bx AS (SELECT l_orderkey, n, l_suppkey AS team, CAST(floor(l_quantity * 0.4::DOUBLE + 18) AS BIGINT) AS fg, CAST(l_quantity + 60 AS BIGINT) AS fga,
       CAST(floor(l_quantity * 0.2::DOUBLE + 8) AS BIGINT) AS fg3, CAST(round(l_discount * 100) + 20 AS BIGINT) AS fta, CAST(round(l_tax * 100) + 6 AS BIGINT) AS oreb,
       CASE WHEN l_partkey % 89 <> 0 THEN l_partkey % 20 + 20 END AS dreb, l_partkey % 14 + 8 AS tov, p AS pts, (p * (l_partkey % 25 + 30)) // 100 AS paint, (p * (l_partkey % 11 + 8)) // 100 AS fb FROM li WHERE n <= 2),
gm AS (SELECT lpad(CAST(h.l_orderkey AS VARCHAR), 10, '0') AS game_id, CAST(o_orderdate AS DATE) AS game_date,
       CAST(h.pts AS VARCHAR) || '-' || CAST(a.pts AS VARCHAR) AS score, h, a
       FROM (SELECT * FROM bx WHERE n = 1) h JOIN (SELECT * FROM bx WHERE n = 2) a ON h.l_orderkey = a.l_orderkey AND h.team <> a.team JOIN orders ON o_orderkey = h.l_orderkey),
tg AS (
  SELECT game_id, game_date, score, TRUE AS is_home, h.team AS team_id, a.team AS opponent_team_id, h.fg, h.fga, h.fg3, h.fta, h.oreb, h.dreb, h.tov, h.pts, h.paint, h.fb,
         a.fga AS o_fga, a.fta AS o_fta, a.oreb AS o_oreb, a.dreb AS o_dreb, a.tov AS o_tov, a.pts AS o_pts FROM gm
  UNION ALL
  SELECT game_id, game_date, score, FALSE, a.team, h.team, a.fg, a.fga, a.fg3, a.fta, a.oreb, a.dreb, a.tov, a.pts, a.paint, a.fb, h.fga, h.fta, h.oreb, h.dreb, h.tov, h.pts FROM gm),
ga AS (SELECT *, printf('%04d-%02d', y, (y + 1) % 100) AS season, CASE WHEN pts > o_pts THEN 'W' WHEN pts < o_pts THEN 'L' END AS result, o_dreb IS NOT NULL AS ok,
       row_number() OVER (PARTITION BY team_id ORDER BY game_date DESC, game_id DESC) AS n_desc
       FROM (SELECT *, year(game_date) - CASE WHEN month(game_date) < 10 THEN 1 ELSE 0 END AS y FROM tg))"""

SQL_ODDS = """
od AS (SELECT lpad(CAST(l_orderkey AS VARCHAR), 10, '0') AS game_id, l_suppkey AS sportsbook_id, 'Book ' || l_suppkey AS sportsbook_name, CASE WHEN l_suppkey % 7 <> 3 THEN 'US' WHEN l_suppkey % 2 = 0 THEN 'CA' END AS country_code,
       l_discount * 10 + 1.0103::DOUBLE AS home_odds, 2.5003::DOUBLE - l_discount * 10 AS away_odds, CASE WHEN l_partkey % 11 <> 0 THEN round(l_tax * 100) - 4 END AS home_spread FROM lineitem)"""


def sql_metrics(suffix: str = "", when: str | None = None, decimals: int = 10, older: bool = True) -> str:
    """The ratio metrics as SQL over the columns of ga, over the rows where `when` holds."""

    def s(x):
        return f"sum({x})" + (f" FILTER (WHERE {when})" if when else "")

    n = "count(*)" + (f" FILTER (WHERE {when})" if when else "")
    own, opp = (f"({s(f'{o}fga * 100 + {o}fta * 44 - {o}oreb * 100 + {o}tov * 100')} / 100.0::DOUBLE)" for o in ("", "o_"))

    def ratio(a, b, times=""):
        return f"CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} END{times}"

    off, against = ratio(s("pts"), own), ratio(s("o_pts"), opp)
    found = {
        "off_rtg": f"({off}) * 100", "def_rtg": f"({against}) * 100", "net_rtg": f"({off}) * 100 - ({against}) * 100", "pace": ratio(own, n),
        "efg": ratio(s("fg + 0.5::DOUBLE * fg3"), s("fga")), "tov_pct": ratio(s("tov"), f"({s('fga')} + 0.44::DOUBLE * {s('fta')} + {s('tov')})"),
        "orb_pct": ratio(s("oreb"), f"({s('oreb')} + {s('o_dreb')})"), "ftr": ratio(s("fta"), s("fga")), "pct_pts_3pt": ratio(f"3 * {s('fg3')}", s("pts")),
        "pct_pts_paint": ratio(s("paint"), s("pts")), "pct_pts_fb": ratio(s("fb"), s("pts")),
    }
    return ", ".join(f"round({v}, {decimals}) AS {k}{suffix}" for k, v in found.items() if older or k not in ("pct_pts_paint", "pct_pts_fb"))
