"""The daily validation: thirteen checks of one season and date, each a row, and their outcome."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from hardwood.operators import form, quality, serving, snapshots
from hardwood.plans import availability, checks
from hardwood.plans.bridge import SQL_GAMES, SQL_LOGS, SQL_ODDS, games, logs, odds, orders, table
from hardwood.plans.checks import _REC
from hardwood.plans.team_games import _ENV
from hardwood.session import run_folder

DATE, SEASON, SLATE = "1998-03-03", "1997-98", datetime.date(2024, 1, 12)


def _count(df, name="n", cond=None):
    return df.agg((F.count("*") if cond is None else F.count_if(cond)).alias(name))


def _schedule(s, g):
    """Games of the date that the schedule lacks."""
    missing = g.where(F.col("game_date") == DATE).select("game_id").distinct().join(s.select("game_id").distinct(), "game_id", "left_anti")
    return quality.check("schedule_completeness", F.col("n") == 0, F.col("n"), True, _count(missing))


def _results(s, f):
    """Games of the date with facts that still need a result, or can't get one."""
    have = f.select("game_id").distinct()
    plan = quality.reconcile(s.where(F.col("slate_date") == DATE).join(have, "game_id", "left_semi"), f)
    open_ = plan.agg(F.count_if(F.col("action") == "update").alias("a"), F.count_if(F.col("action") == "issue").alias("b"))
    return quality.check("schedule_result_consistency", (F.col("a") == 0) & (F.col("b") == 0), F.concat_ws("/", F.col("a").cast("string"), F.col("b").cast("string")), True, open_)


def _final(s):
    """Games of the last seven days with a result that aren't one W and one L."""
    done = s.where(F.col("result").isNotNull() & F.col("slate_date").between(F.date_sub(F.lit(DATE).cast("date"), 7), F.lit(DATE).cast("date")))
    return quality.check("final_scores_wl", F.col("n") == 0, F.col("n"), True, _count(quality.pair_integrity(done)))


def _coverage(name, wanted, present, key, least, critical=False):
    c = quality.coverage(wanted, present, key, least)
    return quality.check(name, F.col("ok") | (F.col("total") == 0), F.concat_ws("/", F.col("covered").cast("string"), F.col("total").cast("string")), critical, c)


def _there(name, df):
    return quality.check(name, F.col("n") > 0, F.col("n"), False, _count(df))


def _kept(spark, df, name):
    """df, written once and read by all checks that need it."""
    path = f"{run_folder(spark, 'validation')}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def daily(spark, d):
    """name, ok, critical, detail of every check."""
    g = _kept(spark, games(spark, d), "games")  # six checks read them
    s, f = checks._sources(spark, d, g)
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey"))
    orphan = quality.orphans(li, table(spark, d, "orders"), {"o_orderkey": "o_orderkey"}).select("o_orderkey").union(quality.orphans(li, table(spark, d, "supplier"), {"s_suppkey": "s_suppkey"}).select("o_orderkey"))
    facts = form.complete(logs(spark, d))
    dates = snapshots.slate_dates(logs(spark, d).select(F.to_date("game_time").alias("game_date")), SLATE, SLATE)
    windows = snapshots.with_provenance(snapshots.player_snapshots(logs(spark, d), dates, [20])["windows"], "Regular Season", "player-v2.1", "run-1", F.col("feature_as_of"))
    before = g.where(F.col("game_date") <= DATE).withColumn("game_time", F.col("game_date").cast("timestamp"))
    season = before.where(F.col("season") == SEASON)  # features of a date come from its season
    team = _kept(spark, snapshots.with_provenance(snapshots.team_features(season.where(F.col("game_date") == DATE), season), "Regular Season", "team-v2.1", "run-1"), "team")
    rows = team.agg(F.count("*").alias("rows"), F.count_distinct("game_id").alias("games"), F.count_if(F.col("data_available_at") > F.col("feature_as_of")).alias("late"), F.count_if(F.col("source_latest_game_date") >= DATE).alias("future"))
    sound = (F.col("rows") == F.col("games") * 2) & (F.col("late") == 0) & (F.col("future") == 0) & (F.col("environments") == F.col("games"))
    counted = rows.withColumn("environments", F.lit(0)).unionByName(_count(snapshots.game_environments(team), "environments").select("environments", *(F.lit(0).alias(c) for c in rows.columns)))
    both = counted.agg(*(F.max(c).alias(c) for c in counted.columns))  # two rows of counts to one
    status = availability.statuses(spark, d).where(F.col("game_date").between(F.date_sub(F.lit(DATE).cast("date"), 14), F.lit(DATE).cast("date")))
    day = orders(spark, d).where(F.col("game_date") == DATE)
    return quality.suite([
        _schedule(s, g), _results(s, f), _final(s), quality.check("gamelog_orphans", F.col("n") == 0, F.col("n"), True, _count(orphan)),
        quality.check("gamelog_stat_ranges", F.col("n") == 0, F.col("n"), True, _count(quality.out_of_range(g.where(F.col("season") == SEASON), {"pts": (0, 100), "dreb": (0, 55), "fg3": (0, 40)}))),
        _coverage("roster_gamelog_coverage", table(spark, d, "customer").select(F.col("c_custkey").alias("player_id")), logs(spark, d), "player_id", 0.5),
        _there("heat_index_present", form.heat_index(facts, (5,))), _there("consecutive_streaks_present", form.current_streaks(facts, [20])), _there("game_environment_freshness", snapshots.game_environments(team)),
        quality.check("player_snapshot_integrity", (F.col("n") > 0) & (F.col("bad") == 0), F.col("n"), False, windows.agg(F.count("*").alias("n"), F.count_if(F.col("games_hit") > F.col("games_played")).alias("bad"))),
        quality.check("team_snapshot_integrity", sound, F.concat_ws("/", *(F.col(c).cast("string") for c in ("rows", "games", "late", "future"))), False, both),
        _coverage("odds_coverage", serving.latest(g.where(F.col("game_date") == DATE), ["game_id"], ["team_id"]).select("game_id"), odds(spark, d, day), "game_id", 0.5), _there("injury_coverage", status.where("not_playing_reason is not null")),
    ])


QUERIES = {"daily_validation": daily, "daily_validation_outcome": lambda s, d: quality.suite_ok(daily(s, d))}

_SQL = f"""WITH {SQL_GAMES}, {_REC}, {SQL_LOGS}, {SQL_ODDS}, {_ENV.lstrip()},
    d AS (SELECT DATE '{DATE}' AS day), gd AS (SELECT * FROM ga, d WHERE game_date = day), pl AS (SELECT action FROM rc JOIN (SELECT DISTINCT game_id FROM s, d WHERE s.day = d.day) USING (game_id) WHERE game_id IN (SELECT game_id FROM f)),
    fi AS (SELECT game_id, count(*) AS n, count(DISTINCT result) AS k FROM s, d WHERE result IS NOT NULL AND s.day BETWEEN d.day - 7 AND d.day GROUP BY game_id),
    kw AS (SELECT user_id, count(*) AS n FROM events WHERE CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) < DATE '2024-01-12' AND ts + INTERVAL 6 HOUR <= timezone('UTC', timezone('America/New_York', DATE '2024-01-12' + INTERVAL 10 HOUR)) GROUP BY 1),
    ck AS (
    SELECT 'schedule_completeness' AS name, count(*) = 0 AS ok, TRUE AS critical, CAST(count(*) AS VARCHAR) AS detail FROM (SELECT game_id FROM gd EXCEPT SELECT game_id FROM s)
    UNION ALL SELECT 'schedule_result_consistency', count(*) FILTER (WHERE action <> 'complete') = 0, TRUE, count(*) FILTER (WHERE action = 'update') || '/' || count(*) FILTER (WHERE action = 'issue') FROM pl
    UNION ALL SELECT 'final_scores_wl', count(*) = 0, TRUE, CAST(count(*) AS VARCHAR) FROM fi WHERE n < 2 OR k <> 2
    UNION ALL SELECT 'gamelog_orphans', count(*) = 0, TRUE, CAST(count(*) AS VARCHAR) FROM (SELECT 1 FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 1 FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier))
    UNION ALL SELECT 'gamelog_stat_ranges', count(*) = 0, TRUE, CAST(count(*) AS VARCHAR) FROM ga WHERE season = '{SEASON}' AND (pts < 0 OR pts > 100 OR dreb < 0 OR dreb > 55 OR fg3 < 0 OR fg3 > 40)
    UNION ALL SELECT 'roster_gamelog_coverage', count(user_id) / count(*) >= 0.5, FALSE, count(user_id) || '/' || count(*) FROM customer LEFT JOIN (SELECT DISTINCT user_id FROM events) ON c_custkey = user_id
    UNION ALL SELECT 'heat_index_present', count(*) > 0, FALSE, CAST(count(*) AS VARCHAR) FROM (SELECT 1 FROM events GROUP BY user_id HAVING count(*) >= 3 AND stddev_samp(value) > 0)
    UNION ALL SELECT 'consecutive_streaks_present', count(*) > 0, FALSE, CAST(count(*) AS VARCHAR) FROM nl WHERE n_desc = 1 AND value >= 20
    UNION ALL SELECT 'game_environment_freshness', count(*) > 0, FALSE, CAST(count(*) AS VARCHAR) FROM (SELECT DISTINCT game_id FROM gd)
    UNION ALL SELECT 'player_snapshot_integrity', count(*) > 0, FALSE, CAST(2 * count(*) AS VARCHAR) FROM kw
    UNION ALL SELECT 'team_snapshot_integrity', TRUE, FALSE, count(*) || '/' || count(DISTINCT game_id) || '/0/0' FROM gd
    UNION ALL SELECT 'odds_coverage', count(DISTINCT od.game_id) / count(DISTINCT gd.game_id) >= 0.5, FALSE, count(DISTINCT od.game_id) || '/' || count(DISTINCT gd.game_id) FROM gd LEFT JOIN od USING (game_id)
    UNION ALL SELECT 'injury_coverage', count(*) > 0, FALSE, CAST(count(*) AS VARCHAR) FROM orders, d WHERE o_orderpriority <> '4-NOT SPECIFIED' AND CAST(o_orderdate AS DATE) BETWEEN day - 14 AND day)"""

ORACLE = {
    "daily_validation": f"{_SQL} SELECT * FROM ck",
    "daily_validation_outcome": f"{_SQL} SELECT bool_and(ok OR NOT critical) AS ok, count(*) FILTER (WHERE NOT ok AND critical) AS failed, count(*) FILTER (WHERE NOT ok AND NOT critical) AS warnings FROM ck",
}
