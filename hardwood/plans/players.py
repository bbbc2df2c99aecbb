"""Queries over player game logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from hardwood.functions import ratings
from hardwood.operators import form
from hardwood.plans.bridge import SQL_LOGS, SQL_LOGS_BY_TYPE, logs, table

THRESHOLDS, WINDOWS = [10, 20, 50, 100], (3, 5, 10)
#: Means of two-digit values over up to a hundred games have no ties at this many digits, which engines round apart.
DIGITS = 8
_TH = "(VALUES (10.0::DOUBLE), (20.0), (50.0), (100.0)) t(threshold)"


def _q(f, by_type=False):
    return lambda spark, d: f(logs(spark, d, by_type))


def _labelled(name):
    return lambda df: df.withColumn("kind", F.lit(name))


def _heat(f):
    return form.heat_index(form.complete(f), WINDOWS, decimals=DIGITS)


def _consistency(f):
    return form.consistency(form.complete(f), decimals=DIGITS)


def _averages(f):
    return f.groupBy("player_id", "stat").agg(F.avg("value").alias("season_avg"))


def _streak_rank(f):
    f = form.complete(f)
    now = form.current_streaks(f, THRESHOLDS).withColumn("is_active", F.lit(True))
    both = _labelled("current")(now).unionByName(_labelled("season_max")(form.longest_streaks(f, THRESHOLDS)))
    known = _averages(f).where("season_avg < 45")  # players of higher averages count as without one
    scored = form.streak_scores(both, known).select("player_id", "kind", "threshold", "streak_games", "rank_score")
    return form.top_per_key(scored, ["player_id"], [F.desc("rank_score"), "kind", "threshold"], 1)


def _window_rank(f):
    f = form.complete(f)
    scored = form.window_scores(form.stat_windows(f, THRESHOLDS, (5, 10)), _averages(f)).select("player_id", "threshold", "window_size", "games_hit", "games_played", "rank_score")
    return form.top_per_key(scored, ["player_id"], [F.desc("rank_score"), "threshold", "window_size"], 3, "position")


def _x_of_ten(f):
    w = form.stat_windows(form.complete(f), THRESHOLDS, (10,))
    return w.where("games_hit >= 7").select("player_id", "threshold", "games_hit", "games_played")


def _high_hit(f):
    w = form.stat_windows(form.complete(f), THRESHOLDS, (5, 10))
    rate = F.col("games_hit") / F.col("games_played")
    return w.where(rate >= 0.8).select("player_id", "threshold", "window_size", F.round(rate, 4).alias("hit_rate"))


def _five_tiers(f):
    h = _heat(f)
    return h.groupBy("window_size", ratings.heat_tier(F.col("z_score")).alias("tier")).agg(F.count("*").alias("players"))


def _composite(f):
    g = f.groupBy("player_id").pivot("stat", ["click", "error", "purchase", "signup", "view"]).agg(F.avg("value"))
    kinds = ["click", "error", "purchase", "signup", "view"]
    score = ratings.weighted_score([F.col(k) for k in kinds], [1.0, -2.0, 3.0, 1.5, 0.5])
    return g.select("player_id", F.round(score, 10).alias("score"))


def _last_n(f):
    n = form.numbered(f).where("n_desc <= 10")
    return n.groupBy("player_id").agg(F.round(F.avg("value"), 4).alias("avg_value"), F.count("*").alias("games"), F.max("value").alias("best"))


def _grid(f):
    return form.with_thresholds(f.select("player_id", "stat").distinct(), THRESHOLDS)


def _streaks_with_team(spark, d):
    """Current streaks with the customer's name and segment; players who aren't customers with a balance get 'N/A'."""
    s = form.current_streaks(form.complete(logs(spark, d)), THRESHOLDS)
    c = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("player_id"), "c_name", "c_mktsegment")
    j = s.join(c, "player_id", "left")
    return j.select("player_id", F.coalesce("c_name", F.lit("N/A")).alias("name"), F.coalesce("c_mktsegment", F.lit("N/A")).alias("team"), "threshold", "streak_games")


QUERIES = {
    "heat_index_w3_5_10": _q(_heat),
    "heat_index_by_stat": _q(_heat, True),
    "current_streaks": _q(lambda f: form.current_streaks(form.complete(f), THRESHOLDS)),
    "season_max_streaks": _q(lambda f: form.longest_streaks(form.complete(f), THRESHOLDS).drop("is_active")),
    "season_max_streaks_by_stat": _q(lambda f: form.longest_streaks(form.complete(f), [20, 50]).drop("is_active"), True),
    "stat_windows_5_10": _q(lambda f: form.stat_windows(form.complete(f), THRESHOLDS, (5, 10))),
    "consistency_profile": _q(_consistency, True),
    "consistency_overall_class": _q(lambda f: form.profile_class(_consistency(f)), True),
    "legacy_x_of_last_10": _q(_x_of_ten),
    "hot_players_top20": _q(lambda f: form.leaders(_heat(f).where("window_size = 3 and status = 'on_fire'").select("player_id", "z_score"), [F.desc("z_score"), "player_id"], 20)),
    "cold_players_top20": _q(lambda f: form.leaders(_heat(f).where("window_size = 3 and status = 'ice_cold'").select("player_id", "z_score"), ["z_score", "player_id"], 20)),
    "most_volatile": _q(lambda f: form.leaders(_consistency(f).where("window_size = 0").select("player_id", "cv"), [F.desc("cv"), "player_id"], 15)),
    "most_steady": _q(lambda f: form.leaders(_consistency(f).where("window_size = 0").select("player_id", "cv"), ["cv", "player_id"], 15)),
    "high_hit_rate_windows": _q(_high_hit),
    "five_tier_heat_buckets": _q(_five_tiers),
    "last_10_averages": _q(_last_n),
    "best_event_per_user": _q(lambda f: form.top_per_key(f, ["player_id"], [F.desc("value"), "game_id"]).select("player_id", "game_id", "value")),
    "streak_rank_score": _q(_streak_rank),
    "window_rank_score": _q(_window_rank),
    "composite_score": _q(_composite, True),
    "threshold_grid": _q(_grid),
    "streaks_left_outer_roster": _streaks_with_team,
}

_HEAT = """
hb AS (SELECT player_id, stat, count(*) AS games, avg(value) AS a, stddev_samp(value) AS s, avg(value) FILTER (WHERE n_desc <= 3) AS r3,
       avg(value) FILTER (WHERE n_desc <= 5) AS r5, avg(value) FILTER (WHERE n_desc <= 10) AS r10 FROM nl GROUP BY ALL),
ht AS (SELECT player_id, stat, w.window_size, games, round(r, 8) AS recent_avg, round(a, 8) AS season_avg, round(s, 8) AS season_sd, round((r - a) / s, 8) AS z_score,
       CASE WHEN (r - a) / s >= 1 THEN 'on_fire' WHEN (r - a) / s <= -1 THEN 'ice_cold' ELSE 'normal' END AS status
       FROM (SELECT *, unnest([3, 5, 10]) AS window_size, unnest([r3, r5, r10]) AS r FROM hb WHERE games >= 3 AND s > 0) w)"""
_CUR = f"""
cu AS (SELECT player_id, stat, threshold, coalesce(min(n_desc) FILTER (WHERE value < threshold) - 1, max(n_desc)) AS streak_games, max(game_time) AS end_time
       FROM nl, {_TH} GROUP BY ALL),
cs AS (SELECT cu.*, nl.game_time AS start_time FROM cu JOIN nl USING (player_id, stat) WHERE nl.n_desc = cu.streak_games)"""


def _longest(th):
    return f"""
rn AS (SELECT player_id, stat, threshold, game_time, n_asc - row_number() OVER (PARTITION BY player_id, stat, threshold ORDER BY n_asc) AS run FROM nl, {th} WHERE value >= threshold),
rg AS (SELECT player_id, stat, threshold, count(*) AS streak_games, min(game_time) AS start_time, max(game_time) AS end_time FROM rn GROUP BY player_id, stat, threshold, run),
mx AS (SELECT * FROM rg QUALIFY row_number() OVER (PARTITION BY player_id, stat, threshold ORDER BY streak_games DESC, start_time) = 1)"""


def _win(sizes):
    return f"""
wn AS (SELECT player_id, stat, threshold, window_size, count(*) FILTER (WHERE value >= threshold) AS games_hit, count(*) AS games_played
       FROM nl, {_TH}, (SELECT unnest([{sizes}]) AS window_size) WHERE n_desc <= window_size GROUP BY ALL)"""


_CONS = """
cb AS (SELECT player_id, stat, window_size, count(*) AS games_played, avg(value) AS m, stddev_samp(value) AS s, min(value) AS min_value, max(value) AS max_value, median(value) AS med
       FROM nl, (SELECT unnest([0, 10]) AS window_size) WHERE window_size = 0 OR n_desc <= window_size GROUP BY ALL),
cn AS (SELECT player_id, stat, window_size, games_played, round(m, 8) AS mean, round(s, 8) AS sd, round(CASE WHEN m > 0 THEN s / m ELSE 0 END, 8) AS cv, min_value, max_value, round(med, 8) AS median,
       CASE WHEN CASE WHEN m > 0 THEN s / m ELSE 0 END < 0.35 THEN 'steady' WHEN CASE WHEN m > 0 THEN s / m ELSE 0 END > 0.55 THEN 'volatile' ELSE 'average' END AS tier
       FROM cb WHERE games_played >= 5)"""
_L, _T = f"WITH {SQL_LOGS}", f"WITH {SQL_LOGS_BY_TYPE}"
_MEAN = "av AS (SELECT player_id, stat, avg(value) AS a FROM lg GROUP BY ALL)"

ORACLE = {
    "heat_index_w3_5_10": f"{_L}, {_HEAT} SELECT * FROM ht",
    "heat_index_by_stat": f"{_T}, {_HEAT} SELECT * FROM ht",
    "current_streaks": f"{_L}, {_CUR} SELECT player_id, stat, threshold, streak_games, start_time, end_time FROM cs",
    "season_max_streaks": f"{_L}, {_longest(_TH)} SELECT * FROM mx",
    "season_max_streaks_by_stat": f"{_T}, {_longest('(VALUES (20.0::DOUBLE), (50.0)) t(threshold)')} SELECT * FROM mx",
    "stat_windows_5_10": f"{_L}, {_win('5, 10')} SELECT * FROM wn",
    "consistency_profile": f"{_T}, {_CONS} SELECT * FROM cn",
    "consistency_overall_class": f"""{_T}, {_CONS} SELECT player_id, count(*) FILTER (WHERE tier = 'steady') AS n_steady, count(*) FILTER (WHERE tier = 'volatile') AS n_volatile,
        CASE WHEN count(*) FILTER (WHERE tier = 'steady') > count(*) FILTER (WHERE tier = 'volatile') + 2 THEN 'steady'
             WHEN count(*) FILTER (WHERE tier = 'volatile') > count(*) FILTER (WHERE tier = 'steady') + 2 THEN 'volatile' ELSE 'mixed' END AS profile FROM cn GROUP BY player_id""",
    "legacy_x_of_last_10": f"{_L}, {_win('10')} SELECT player_id, threshold, games_hit, games_played FROM wn WHERE games_hit >= 7",
    "hot_players_top20": f"{_L}, {_HEAT} SELECT player_id, z_score FROM ht WHERE window_size = 3 AND status = 'on_fire' ORDER BY z_score DESC, player_id LIMIT 20",
    "cold_players_top20": f"{_L}, {_HEAT} SELECT player_id, z_score FROM ht WHERE window_size = 3 AND status = 'ice_cold' ORDER BY z_score, player_id LIMIT 20",
    "most_volatile": f"{_L}, {_CONS} SELECT player_id, cv FROM cn WHERE window_size = 0 ORDER BY cv DESC, player_id LIMIT 15",
    "most_steady": f"{_L}, {_CONS} SELECT player_id, cv FROM cn WHERE window_size = 0 ORDER BY cv, player_id LIMIT 15",
    "high_hit_rate_windows": f"{_L}, {_win('5, 10')} SELECT player_id, threshold, window_size, round(games_hit / games_played, 4) AS hit_rate FROM wn WHERE games_hit / games_played >= 0.8",
    "five_tier_heat_buckets": f"""{_L}, {_HEAT} SELECT window_size, CASE WHEN z_score >= 1 THEN 'on_fire' WHEN z_score >= 0.65 THEN 'heating_up' WHEN z_score >= -0.64 THEN 'average'
        WHEN z_score >= -1 THEN 'cooling_off' ELSE 'ice_cold' END AS tier, count(*) AS players FROM ht GROUP BY ALL""",
    "last_10_averages": f"{_L} SELECT player_id, round(avg(value), 4) AS avg_value, count(*) AS games, max(value) AS best FROM nl WHERE n_desc <= 10 GROUP BY player_id",
    "best_event_per_user": f"{_L} SELECT player_id, game_id, value FROM lg QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY value DESC, game_id) = 1",
    "streak_rank_score": f"""{_L}, {_CUR}, {_longest(_TH)}, {_MEAN},
        nw AS (SELECT player_id, max(game_time) AS newest FROM lg GROUP BY player_id),
        bo AS (SELECT player_id, 'current' AS kind, threshold, streak_games, TRUE AS active FROM cs UNION ALL SELECT player_id, 'season_max', threshold, streak_games, end_time = newest FROM mx JOIN nw USING (player_id)),
        sc AS (SELECT bo.* EXCLUDE (active), round(CASE WHEN active THEN 1000.0::DOUBLE ELSE 0 END + CASE WHEN kind = 'current' THEN 100 ELSE 0 END + CASE WHEN a > 0 AND a < 45 THEN 100.0::DOUBLE * threshold / a ELSE threshold END + streak_games * 0.1::DOUBLE, 4) AS rank_score FROM bo LEFT JOIN av USING (player_id))
        SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY rank_score DESC, kind, threshold) = 1""",
    "window_rank_score": f"""{_L}, {_win('5, 10')}, {_MEAN},
        sc AS (SELECT player_id, threshold, window_size, games_hit, games_played, round(CASE WHEN a > 0 THEN least(50.0::DOUBLE * threshold / a, 100.0) ELSE least(threshold * 3, 100.0) END + games_hit / games_played * 50 + CASE WHEN window_size = 10 THEN 10 ELSE 0 END, 4) AS rank_score
               FROM wn LEFT JOIN av USING (player_id) WHERE games_hit > 0 AND (games_hit / games_played >= 0.2 OR (a > 0 AND threshold <= a * 1.5::DOUBLE)))
        SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY rank_score DESC, threshold, window_size) AS position FROM sc QUALIFY position <= 3""",
    "composite_score": f"""{_T}, p AS (SELECT player_id, stat, avg(value) AS a, CASE stat WHEN 'click' THEN 1.0 WHEN 'error' THEN -2.0 WHEN 'purchase' THEN 3.0 WHEN 'signup' THEN 1.5 WHEN 'view' THEN 0.5 END::DOUBLE AS w FROM lg GROUP BY player_id, stat)
        SELECT player_id, round(sum(w * a) / nullif(sum(abs(w)), 0), 10) AS score FROM p GROUP BY player_id""",
    "threshold_grid": f"{_L} SELECT DISTINCT player_id, stat, threshold FROM lg, {_TH}",
    "streaks_left_outer_roster": f"""{_L}, {_CUR} SELECT player_id, coalesce(c_name, 'N/A') AS name, coalesce(c_mktsegment, 'N/A') AS team, threshold, streak_games
        FROM cs LEFT JOIN customer ON c_custkey = player_id AND c_acctbal > 0""",
}
