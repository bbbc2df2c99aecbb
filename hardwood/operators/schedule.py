"""Rest and density from team schedules: (team_id, game_id, game_date, ...), several games a date allowed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hardwood.functions import ratings


def rest_and_density(games: DataFrame, legacy: bool = False) -> DataFrame:
    """One row a team and date: days_rest and games in the days before.

    Distinct dates count: rest is the days between, 0 back to back, and the windows reach 3, 4 and 6 days back. The
    legacy variant counts the plain difference of dates and windows one day wider, over games instead of dates."""
    day = F.datediff("game_date", F.lit("1970-01-01").cast("date"))
    d = games.groupBy("team_id", F.to_date("game_date").alias("game_date")).agg(F.count("*").alias("games")).withColumn("_d", day)
    w = Window.partitionBy("team_id").orderBy("_d")
    back = (4, 5, 7) if legacy else (3, 4, 6)
    count = F.sum("games") if legacy else F.count("*")
    last = F.max("_d").over(w.rangeBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("days_rest", F.col("_d") - last - (0 if legacy else 1))
    d = d.withColumns({f"prior_{n}": F.coalesce(count.over(w.rangeBetween(-b, -1)), F.lit(0)).cast("long") for n, b in zip(("3in4", "4in5", "5in7"), back, strict=True)})
    flags = {"is_b2b": F.coalesce(F.col("days_rest") == 0, F.lit(False)), "is_3in4": F.col("prior_3in4") >= 2, "is_4in5": F.col("prior_4in5") >= 3, "is_5in7": F.col("prior_5in7") >= 4}
    return d.withColumns(flags).drop("_d", "games")


def factors(games: DataFrame) -> DataFrame:
    """One row a game and team: its rest and density, and the edge over the opponent's rest."""
    own = rest_and_density(games)
    g = games.select("game_id", "team_id", "opponent_team_id", "is_home", F.to_date("game_date").alias("game_date")).join(own, ["team_id", "game_date"])
    other = g.select("game_id", F.col("team_id").alias("opponent_team_id"), F.col("days_rest").alias("opponent_rest"))
    g = g.join(other, ["game_id", "opponent_team_id"], "left").withColumn("rest_diff", F.col("days_rest") - F.col("opponent_rest"))
    text = ratings.schedule_text(F.col("is_b2b"), F.col("is_3in4"), F.col("is_4in5"), F.col("is_5in7"), F.col("days_rest"))
    return g.withColumn("rest_edge", ratings.rest_edge(F.col("rest_diff"))).withColumn("description", text)


def team_summary(rows: DataFrame) -> DataFrame:
    """Counts of the flags, share of back-to-backs and mean rest (an opener counts as 0) by team."""
    n = F.count("*")
    return rows.groupBy("team_id").agg(
        n.alias("games"), F.count_if("is_b2b").alias("b2b"), F.count_if("is_3in4").alias("three_in_four"), F.count_if("is_4in5").alias("four_in_five"), F.count_if("is_5in7").alias("five_in_seven"),
        F.round(F.lit(100.0) * F.count_if("is_b2b") / n, 4).alias("b2b_pct"), F.round(F.avg(F.coalesce("days_rest", F.lit(0))), 4).alias("avg_rest"),
        F.count_if(F.col("rest_edge") == "advantage").alias("advantages"), F.count_if(F.col("rest_edge") == "disadvantage").alias("disadvantages"),
    )


def slate_summary(rows: DataFrame) -> DataFrame:
    """By date: games, teams on a back-to-back and the sides with an edge, as sorted lists joined by commas."""

    def teams(cond):
        return F.array_join(F.transform(F.array_sort(F.collect_set(F.when(cond, F.col("team_id")))), lambda x: x.cast("string")), ",")

    return rows.groupBy("game_date").agg(
        F.count_distinct("game_id").alias("games"), F.count_if("is_b2b").alias("b2b_sides"), teams(F.col("is_b2b")).alias("b2b_teams"), teams(F.col("rest_edge") == "advantage").alias("advantage_teams"), teams(F.col("rest_edge") == "disadvantage").alias("disadvantage_teams")
    )


def calendar(games: DataFrame, first: str, days: int) -> DataFrame:
    """Every date of the range with its number of games, zero included."""
    spark = games.sparkSession
    dates = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.date_add(F.lit(first).cast("date"), days - 1))).alias("game_date"))
    n = games.groupBy(F.to_date("game_date").alias("game_date")).agg(F.count_distinct("game_id").alias("games"))
    return dates.join(n, "game_date", "left").select("game_date", F.coalesce("games", F.lit(0)).alias("games"))
