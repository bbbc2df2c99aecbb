"""Queries over team games seen from both sides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from hardwood.functions import ratings
from hardwood.operators import form, snapshots, teams
from hardwood.plans.bridge import SQL_GAMES, games, sql_metrics, table
from hardwood.sources import feeds


#: Ratios of hundredths to up to some hundred games have no ties at this many digits, which engines round apart.
DIGITS = 10


def _season(g, older=False):
    return teams.season_and_recent(g, older=older, decimals=DIGITS)


def _strength(g):
    return teams.strength_of_schedule(g, decimals=DIGITS)


def _q(f):
    return lambda spark, d: f(games(spark, d))


def _conference(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("team_id"), F.col("s_name").alias("team_name"), "s_nationkey")
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("team_id", "team_name", F.col("r_name").alias("conference"))


def _standings(spark, d):
    g = teams.records(games(spark, d), ["team_id"]).join(_conference(spark, d), "team_id")
    return form.top_per_key(g.select("conference", "team_id", "team_name", "wins", "losses", "w_pct"), ["conference"], [F.desc("w_pct"), "team_id"], 1 << 30, "position")


def _head_to_head(g):
    return g.groupBy("team_id", "opponent_team_id").agg(F.count("*").alias("games"), F.count_if(F.col("result") == "W").alias("wins"), F.max("game_date").alias("last_met"), F.sum("pts").alias("points"))


def _facts(g):
    return g.withColumn("game_time", F.col("game_date").cast("timestamp"))


def _features(g):
    return snapshots.team_features(g, _facts(g), decimals=DIGITS)


def _environment(g):
    e = snapshots.game_environments(_features(g), DIGITS)
    return e.select("game_id", "home_team_id", "away_team_id", "pace_projection", "scoring_env_index", "three_env_index", "chaos_index", F.array_join("tags", ",").alias("tags"), "pace_up_for_home", "pace_up_for_away", "completeness_status")


def _older_environment(g):
    """Environments of the older kind: from the last games of all, with the tags of paint, boards and fouls."""
    used = ["off_rtg", "def_rtg", "pace", "tov_pct", "pct_pts_3pt", "pct_pts_paint", "orb_pct", "ftr"]
    m = _season(g, older=True).select("team_id", *(F.col(f"{c}_lastn").alias(c) for c in used))
    e = teams.environments(teams.pair_sides(g.join(m, "team_id"), ["team_id", *used]), older=True, decimals=DIGITS)
    return e.groupBy(F.array_join("tags", ",").alias("tags")).agg(F.count("*").alias("games"))


def _tags(g):
    return _environment(g).groupBy("tags").agg(F.count("*").alias("games"))


def _leaders(metric, descending, n=10):
    def f(g):
        m = _season(g).where(F.col(f"{metric}_delta").isNotNull()).select("team_id", F.col(f"{metric}_delta").alias("delta"))
        return form.leaders(m, [F.desc("delta") if descending else F.asc("delta"), "team_id"], n)

    return f


def _headlines(g):
    m = _season(g).select("team_id", F.col("net_rtg_delta").alias("delta")).where("delta is not null")
    up = form.leaders(m, [F.desc("delta"), "team_id"], 3).withColumn("kind", F.lit("improver"))
    return up.unionByName(form.leaders(m, [F.asc("delta"), "team_id"], 3).withColumn("kind", F.lit("decliner")))


def _sos_boards(g):
    """The five hardest and easiest schedules, and those that got harder and easier lately."""
    s = _strength(g)
    boards = [("toughest", F.desc("sos_net_season")), ("easiest", F.asc("sos_net_season")), ("harder_lately", F.desc("sos_net_delta")), ("easier_lately", F.asc("sos_net_delta"))]
    each = [form.leaders(s.where(F.col("sos_net_delta").isNotNull()) if "lately" in n else s, [o, "team_id"], 5).withColumn("board", F.lit(n)) for n, o in boards]
    return reduce(lambda a, b: a.unionByName(b), each)


def _summary_boards(g):
    """Teams by season net rating and the biggest movers, with their flags."""
    m = _season(g).withColumn("flags", F.array_join(teams.flag_names(), ",")).select("team_id", F.col("net_rtg_season").alias("net"), F.col("net_rtg_delta").alias("delta"), "flags")
    boards = [("top", F.desc("net")), ("risers", F.desc("delta")), ("fallers", F.asc("delta"))]
    return reduce(lambda a, b: a.unionByName(b), [form.leaders(m, [o, "team_id"], 10).withColumn("board", F.lit(n)) for n, o in boards])


def _flags_by_type(g):
    """The three strongest cases of each flag."""
    f = teams.flags(_season(g, older=True), older=True)
    top = form.top_per_key(f, ["flag"], [F.desc("severity"), "team_id"], 3, "position")
    return top.select("flag", "team_id", F.col("position").cast("long").alias("position"), "severity", "threshold", F.get_json_object("details", "$.season_value").cast("double").alias("season_value"), F.get_json_object("details", "$.lastn_value").cast("double").alias("lastn_value"))


def _next_games(g):
    """The three next games of each team from a date on, and the three last before it."""
    day = F.to_date(F.lit("1998-03-01"))
    ahead = form.top_per_key(g.where(F.col("game_date") >= day), ["team_id"], ["game_date", "game_id"], 3, "position").withColumn("kind", F.lit("next"))
    past = form.top_per_key(g.where((F.col("game_date") < day) & F.col("result").isNotNull()), ["team_id"], [F.desc("game_date"), F.desc("game_id")], 3, "position").withColumn("kind", F.lit("last"))
    return ahead.unionByName(past).select("team_id", "kind", F.col("position").cast("long").alias("position"), "game_id", "game_date")


def _measures(g):
    """Wide team statistics, one column a measure and mode, then those of one measure with the prefix taken off."""
    sums = g.groupBy("team_id", "season").agg(F.sum("pts").cast("double").alias("base"), F.sum("o_pts").cast("double").alias("opp"))
    long = sums.unpivot(["team_id", "season"], ["base", "opp"], "measure", "value").select("*", F.lit("Totals").alias("mode"), F.lit("PTS").alias("stat"))
    return feeds.with_prefix(feeds.wide_stats(long, ["base_totals_pts", "opp_totals_pts"]), ["team_id", "season"], "opp_totals")


def _filled(g):
    return teams.filled_recent(g, decimals=DIGITS).select("team_id", "recent_games", *teams.METRICS)


def _snapshot_rows(g):
    f = snapshots.with_provenance(_features(g), "Regular Season", "team-v2.1", "run-1")
    return f.select(
        "game_id", "team_id", "season_games_played", "season_games_used", "window_games_played", "window_games_used", *(f"{m}_{k}" for m in teams.METRICS for k in ("season", "lastn", "delta")), F.array_join("flags", ",").alias("flags"),
        "completeness_status", "source_latest_game_id", "source_latest_game_date", F.date_format("feature_as_of", "yyyy-MM-dd HH:mm").alias("feature_as_of"), (F.col("data_available_at") > F.col("feature_as_of")).alias("late"),
        F.coalesce(F.size(F.json_object_keys(F.get_json_object("missing_input_flags", "$.excluded_season_games"))), F.lit(0)).alias("left_out"),
    )


def _sos_notes(g):
    j = _season(g).select("team_id", "net_rtg_delta").join(_strength(g), "team_id")
    return j.select("team_id", "net_rtg_delta", "sos_net_delta", ratings.sos_note(F.col("net_rtg_delta"), F.col("sos_net_delta")).alias("note"))


def _score_split(g):
    own, other = (ratings.score_side(F.col("score"), F.col("is_home"), x) for x in (True, False))
    return g.select("game_id", "team_id", own.alias("own_points"), other.alias("other_points"))


QUERIES = {
    "paired_game_facts": _q(lambda g: teams.with_opponent(g.drop(*(f"o_{c}" for c in teams.OPPONENT))).select("game_id", "season", "game_date", "team_id", "opponent_team_id", "is_home", "pts", "o_pts", "result", "score")),
    "team_season_metrics": _q(lambda g: _season(g).select("team_id", "season_games", *(f"{m}_season" for m in _METRICS))),
    "team_last10_metrics": _q(lambda g: _season(g).select("team_id", "recent_games", *(f"{m}_lastn" for m in teams.METRICS))),
    "team_metric_deltas": _q(lambda g: _season(g).select("team_id", *(f"{m}_delta" for m in teams.METRICS))),
    "team_metrics_by_season": _q(lambda g: teams.usable(teams.with_opponent(g)).groupBy("team_id", "season").agg(*(v.alias(k) for k, v in teams.ratio_metrics(decimals=DIGITS, older=True).items()))),
    "strength_of_schedule": _q(_strength),
    "team_flags": _q(lambda g: teams.flags(_season(g)).select("team_id", "flag", "metric", "delta")),
    "flag_histogram": _q(lambda g: teams.flags(_season(g)).groupBy("flag").count().select("flag", F.col("count").alias("teams"))),
    "game_environment": _q(_environment),
    "environment_tags": _q(_tags),
    "older_environment_tags": _q(_older_environment),
    "team_snapshot_features": _q(_snapshot_rows),
    "team_snapshot_strength": _q(lambda g: snapshots.prior_strength(g, _facts(g), decimals=DIGITS).select("game_id", "team_id", "sos_net_season", "sos_net_lastn", "sos_net_delta")),
    "team_last10_filled": _q(_filled),
    "sos_boards": _q(_sos_boards),
    "summary_boards": _q(_summary_boards),
    "flags_by_type": _q(_flags_by_type),
    "last_and_next_games": _q(_next_games),
    "measure_columns": _q(_measures),
    "home_away_records": _q(lambda g: teams.records(g, ["team_id"])),
    "conference_standings": _standings,
    "head_to_head": _q(_head_to_head),
    "team_leaders_by_delta": _q(_leaders("net_rtg", True)),
    "team_decliners_by_delta": _q(_leaders("net_rtg", False)),
    "headlines": _q(_headlines),
    "sos_context_notes": _q(_sos_notes),
    "team_completeness": _q(lambda g: teams.completeness(g)),
    "score_split": _q(_score_split),
    "last_10_games": _q(lambda g: teams.newest_first(g).where("n_desc <= 10").select("team_id", "game_id", "game_date", F.col("n_desc").cast("long").alias("n_desc"))),
}

_G = f"WITH {SQL_GAMES}"
_METRICS = ("off_rtg", "def_rtg", "net_rtg", "pace", "efg", "tov_pct", "orb_pct", "ftr", "pct_pts_3pt")
_M = f"""
ms AS (SELECT team_id, count(*) AS season_games, count(*) FILTER (WHERE n_desc <= 10) AS recent_games, {sql_metrics('_season')}, {sql_metrics('_lastn', 'n_desc <= 10')} FROM ga WHERE ok GROUP BY team_id),
md AS (SELECT *, {', '.join(f'round({m}_lastn - {m}_season, 10) AS {m}_delta' for m in (*_METRICS, 'pct_pts_paint', 'pct_pts_fb'))} FROM ms)"""
_SOS = f"""
nt AS (SELECT team_id AS opponent_team_id, CAST(round(net_rtg_season * 10000000000) AS BIGINT) AS net FROM ms),
so AS (SELECT team_id, CAST(CAST(sum(net) AS BIGINT) AS DOUBLE) / (count(net) * 10000000000.0::DOUBLE) AS sos_net_season,
       CAST(CAST(sum(net) FILTER (WHERE n_desc <= 10) AS BIGINT) AS DOUBLE) / (count(net) FILTER (WHERE n_desc <= 10) * 10000000000.0::DOUBLE) AS sos_net_lastn FROM ga JOIN nt USING (opponent_team_id) GROUP BY team_id),
sd AS (SELECT *, sos_net_lastn - sos_net_season AS sos_net_delta FROM so)"""
# The rules once more, written out: flag, metric, operator and bound.
_RULES = [("offense_rising", "off_rtg", ">= 5.0"), ("offense_falling", "off_rtg", "<= -5.0"), ("defense_improving", "def_rtg", "<= -4.0"), ("defense_declining", "def_rtg", ">= 5.0"), ("pace_up", "pace", ">= 4.0"), ("pace_down", "pace", "<= -4.0"),
          ("shooting_hot", "efg", ">= 0.03"), ("shooting_cold", "efg", "<= -0.03"), ("turnover_prone", "tov_pct", ">= 0.02"), ("ball_secure", "tov_pct", "<= -0.03"), ("three_point_heavy", "pct_pts_3pt", ">= 0.05")]
_OLDER = [("paint_attack", "pct_pts_paint", ">= 0.03"), ("transition_heavy", "pct_pts_fb", ">= 0.03")]


def _fl(rules):
    return "fl AS (" + " UNION ALL ".join(f"SELECT team_id, '{n}' AS flag, '{m}' AS metric, {m}_delta AS delta, {c.split()[1]}::DOUBLE AS threshold, {m}_season AS season_value, {m}_lastn AS lastn_value FROM md WHERE {m}_delta {c}::DOUBLE" for n, m, c in rules) + ")"


_FL = _fl(_RULES)
_NAMES = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {m}_delta {c}::DOUBLE THEN '{n}' END" for n, m, c in _RULES) + "], lambda x: x IS NOT NULL), ',')"
# What was known before each game: every earlier game of the season is joined to it.
_SNAP = f"""
kn AS (SELECT *, row_number() OVER (PARTITION BY team_id, season ORDER BY game_date, game_id) AS n FROM ga),
pr AS (SELECT t.game_id AS t_id, t.team_id AS t_team, k.*, row_number() OVER (PARTITION BY t.game_id, t.team_id ORDER BY k.n DESC) AS back
       FROM ga t JOIN kn k ON k.team_id = t.team_id AND k.season = t.season AND k.game_date < t.game_date),
pc AS (SELECT t_id, t_team, count(*) AS season_games_played, count(*) FILTER (WHERE ok) AS season_games_used, count(*) FILTER (WHERE back <= 10) AS window_games_played, count(*) FILTER (WHERE ok AND back <= 10) AS window_games_used,
       max_by(game_id, n) FILTER (WHERE ok) AS source_latest_game_id, max_by(game_date, n) FILTER (WHERE ok) AS source_latest_game_date FROM pr GROUP BY ALL),
pm AS (SELECT t_id, t_team, {sql_metrics('_season')}, {sql_metrics('_lastn', 'back <= 10')} FROM pr WHERE ok GROUP BY ALL),
pf AS (SELECT *, {', '.join(f'round({m}_lastn - {m}_season, 10) AS {m}_delta' for m in _METRICS)} FROM pm),
sn AS (SELECT t.game_id, t.team_id, t.is_home, t.season, t.game_date, coalesce(season_games_played, 0) AS season_games_played, coalesce(season_games_used, 0) AS season_games_used, coalesce(window_games_played, 0) AS window_games_played, coalesce(window_games_used, 0) AS window_games_used,
       {', '.join(f'{m}_{k}' for m in _METRICS for k in ('season', 'lastn', 'delta'))}, {_NAMES} AS flags, source_latest_game_id, source_latest_game_date,
       CASE WHEN window_games_played >= 10 AND season_games_used = season_games_played THEN 'complete' ELSE 'partial' END AS completeness_status
       FROM ga t LEFT JOIN pc ON pc.t_id = t.game_id AND pc.t_team = t.team_id LEFT JOIN pf ON pf.t_id = t.game_id AND pf.t_team = t.team_id)"""
_STRENGTH = f"""op AS (SELECT DISTINCT p.t_id, p.t_team, t.game_date AS t_date, p.back, p.game_id, p.opponent_team_id AS opp, p.season FROM pr p JOIN ga t ON t.game_id = p.t_id AND t.team_id = p.t_team),
        oq AS (SELECT DISTINCT opp, season, t_date FROM op),
        orr AS (SELECT opp, q.season, t_date, {sql_metrics()} FROM oq q JOIN ga ON ga.team_id = q.opp AND ga.season = q.season AND ga.game_date < q.t_date WHERE ok GROUP BY ALL),
        oz AS (SELECT t_id, t_team, CAST(round(net_rtg * 10000000000) AS BIGINT) AS net, back FROM op LEFT JOIN orr USING (opp, season, t_date)),
        os AS (SELECT t_id, t_team, CAST(CAST(sum(net) AS BIGINT) AS DOUBLE) / (count(net) * 10000000000.0::DOUBLE) AS a, CAST(CAST(sum(net) FILTER (WHERE back <= 10) AS BIGINT) AS DOUBLE) / (count(net) FILTER (WHERE back <= 10) * 10000000000.0::DOUBLE) AS b FROM oz GROUP BY ALL)"""
_ENV = f"""{_SNAP},
pj AS (SELECT a.game_id, a.team_id AS home_team_id, b.team_id AS away_team_id, a.off_rtg_lastn AS hf, a.def_rtg_lastn AS he, b.off_rtg_lastn AS af, b.def_rtg_lastn AS ae, a.tov_pct_lastn AS h_tov, b.tov_pct_lastn AS a_tov, a.pct_pts_3pt_lastn AS hh, b.pct_pts_3pt_lastn AS ah,
       round(0.7::DOUBLE * (a.pace_lastn + b.pace_lastn) / 2 + 0.3::DOUBLE * CASE WHEN a.pace_lastn > b.pace_lastn THEN a.pace_lastn WHEN b.pace_lastn IS NOT NULL THEN CASE WHEN a.pace_lastn IS NOT NULL THEN b.pace_lastn END END, 10) AS pace_projection,
       coalesce(a.pace_delta >= 2, FALSE) AS pace_up_for_home, coalesce(b.pace_delta >= 2, FALSE) AS pace_up_for_away, CASE WHEN a.completeness_status = 'complete' AND b.completeness_status = 'complete' THEN 'complete' ELSE 'partial' END AS completeness_status
       FROM sn a JOIN sn b ON a.game_id = b.game_id AND a.is_home AND NOT b.is_home),
en AS (SELECT game_id, home_team_id, away_team_id, pace_projection, round(((hf + ae) / 2 + (af + he) / 2) / 2 * pace_projection / 99 / 115 * 100, 10) AS scoring_env_index, pace_up_for_home, pace_up_for_away, completeness_status,
       CASE WHEN pace_projection IS NOT NULL THEN round((hh + ah) / 2 / 0.35::DOUBLE * 100, 10) END AS three_env_index, round(pace_projection / 99 * 50 + (h_tov + a_tov) / 2 / 0.14::DOUBLE * 50, 10) AS chaos_index FROM pj),
et AS (SELECT *, array_to_string(list_filter([CASE WHEN pace_projection > 105 THEN 'fast_pace' END, CASE WHEN pace_projection < 94 THEN 'slow_pace' END, CASE WHEN scoring_env_index > 108 THEN 'high_scoring' END, CASE WHEN scoring_env_index < 92 THEN 'defensive_battle' END,
       CASE WHEN three_env_index > 110 THEN 'three_point_fest' END, CASE WHEN chaos_index > 115 THEN 'chaotic' END], lambda x: x IS NOT NULL), ',') AS tags FROM en)"""
_OLD_ENV = f"""
ow AS (SELECT g.game_id, g.is_home, m.off_rtg_lastn AS f, m.def_rtg_lastn AS e, m.pace_lastn AS p, m.tov_pct_lastn AS t, m.pct_pts_3pt_lastn AS h, m.pct_pts_paint_lastn AS pa, m.orb_pct_lastn AS ob, m.ftr_lastn AS ft FROM ga g JOIN ms m USING (team_id)),
oj AS (SELECT a.game_id, round(0.7::DOUBLE * (a.p + b.p) / 2 + 0.3::DOUBLE * greatest(a.p, b.p), 10) AS pp, (a.f + b.e) / 2 AS x, (b.f + a.e) / 2 AS y, round((a.h + b.h) / 2 / 0.35::DOUBLE * 100, 10) AS th, (a.t + b.t) / 2 AS tv, (a.pa + b.pa) / 2 AS pa, (a.ob + b.ob) / 2 AS ob, (a.ft + b.ft) / 2 AS ft
       FROM ow a JOIN ow b ON a.game_id = b.game_id AND a.is_home AND NOT b.is_home),
ot AS (SELECT game_id, pp, th, pa, ob, ft, round((x + y) / 2 * pp / 99 / 115 * 100, 10) AS sc, round(pp / 99 * 50 + tv / 0.14::DOUBLE * 50, 10) AS ch FROM oj)
SELECT array_to_string(list_filter([CASE WHEN pp > 105 THEN 'fast_pace' END, CASE WHEN pp < 94 THEN 'slow_pace' END, CASE WHEN sc > 108 THEN 'high_scoring' END, CASE WHEN sc < 92 THEN 'defensive_battle' END, CASE WHEN th > 110 THEN 'three_point_fest' END,
       CASE WHEN pa > 0.4::DOUBLE THEN 'paint_battle' END, CASE WHEN ob > 0.28::DOUBLE THEN 'glass_war' END, CASE WHEN ft > 0.3::DOUBLE THEN 'whistle_heavy' END, CASE WHEN ch > 115 THEN 'chaotic' END], lambda x: x IS NOT NULL), ',') AS tags, count(*) AS games FROM ot GROUP BY 1"""
_REC = """SELECT team_id, count(*) FILTER (WHERE result = 'W') AS wins, count(*) FILTER (WHERE result = 'L') AS losses, count(*) FILTER (WHERE result = 'W' AND is_home) AS home_wins,
    count(*) FILTER (WHERE result = 'L' AND is_home) AS home_losses, count(*) FILTER (WHERE result = 'W' AND NOT is_home) AS away_wins, count(*) FILTER (WHERE result = 'L' AND NOT is_home) AS away_losses,
    round(count(*) FILTER (WHERE result = 'W') / (count(*) FILTER (WHERE result = 'W') + count(*) FILTER (WHERE result = 'L')), 4) AS w_pct FROM ga GROUP BY team_id"""


def _board(name, order, columns, n, where="TRUE", source="sd"):
    return f"(SELECT {columns}, '{name}' AS board FROM {source} WHERE {where} ORDER BY {order}, team_id LIMIT {n})"


def _cols(suffix):
    return ", ".join(f"{m}{suffix}" for m in teams.METRICS)


ORACLE = {
    "paired_game_facts": f"{_G} SELECT game_id, season, game_date, team_id, opponent_team_id, is_home, pts, o_pts, result, score FROM ga",
    "team_season_metrics": f"{_G}, {_M} SELECT team_id, season_games, {_cols('_season')} FROM ms",
    "team_last10_metrics": f"{_G}, {_M} SELECT team_id, recent_games, {_cols('_lastn')} FROM ms",
    "team_metric_deltas": f"{_G}, {_M} SELECT team_id, {_cols('_delta')} FROM md",
    "team_metrics_by_season": f"{_G} SELECT team_id, season, {sql_metrics()} FROM ga WHERE ok GROUP BY team_id, season",
    "strength_of_schedule": f"{_G}, {_M}, {_SOS} SELECT * FROM sd",
    "team_flags": f"{_G}, {_M}, {_FL} SELECT team_id, flag, metric, delta FROM fl",
    "flag_histogram": f"{_G}, {_M}, {_FL} SELECT flag, count(*) AS teams FROM fl GROUP BY flag",
    "game_environment": f"{_G}, {_ENV} SELECT * FROM et",
    "environment_tags": f"{_G}, {_ENV} SELECT tags, count(*) AS games FROM et GROUP BY tags",
    "older_environment_tags": f"{_G}, {_M}, {_OLD_ENV}",
    "team_snapshot_features": f"""{_G}, {_SNAP} SELECT game_id, team_id, season_games_played, season_games_used, window_games_played, window_games_used, {', '.join(f'{m}_{k}' for m in _METRICS for k in ('season', 'lastn', 'delta'))},
        flags, completeness_status, source_latest_game_id, source_latest_game_date, strftime(timezone('UTC', timezone('America/New_York', game_date + INTERVAL 10 HOUR)), '%Y-%m-%d %H:%M') AS feature_as_of,
        CASE WHEN source_latest_game_id IS NOT NULL THEN FALSE END AS late, CAST(season_games_played - season_games_used AS INTEGER) AS left_out FROM sn""",
    "team_snapshot_strength": f"""{_G}, {_SNAP},
        {_STRENGTH}
        SELECT game_id, team_id, a AS sos_net_season, b AS sos_net_lastn, b - a AS sos_net_delta FROM ga LEFT JOIN os ON t_id = game_id AND t_team = team_id""",
    "team_last10_filled": f"{_G}, z AS (SELECT * REPLACE (coalesce(o_dreb, 0) AS o_dreb) FROM ga WHERE n_desc <= 10) SELECT team_id, count(*) AS recent_games, {sql_metrics(older=False)} FROM z GROUP BY team_id HAVING count(*) >= 10",
    "sos_boards": f"{_G}, {_M}, {_SOS} " + " UNION ALL ".join(_board(n, o, "team_id, sos_net_season, sos_net_lastn, sos_net_delta", 5) for n, o in (("toughest", "sos_net_season DESC"), ("easiest", "sos_net_season"), ("harder_lately", "sos_net_delta DESC"), ("easier_lately", "sos_net_delta"))),
    "summary_boards": f"{_G}, {_M}, mf AS (SELECT *, {_NAMES} AS flags FROM md) " + " UNION ALL ".join(_board(n, o, "team_id, net_rtg_season AS net, net_rtg_delta AS delta, flags", 10, source="mf") for n, o in (("top", "net_rtg_season DESC"), ("risers", "net_rtg_delta DESC"), ("fallers", "net_rtg_delta"))),
    "flags_by_type": f"""{_G}, {_M}, {_fl(_RULES + _OLDER)} SELECT flag, team_id, row_number() OVER (PARTITION BY flag ORDER BY abs(delta) DESC, team_id) AS position, abs(delta) AS severity, threshold, season_value, lastn_value FROM fl QUALIFY position <= 3""",
    "last_and_next_games": f"""{_G} SELECT team_id, 'next' AS kind, row_number() OVER (PARTITION BY team_id ORDER BY game_date, game_id) AS position, game_id, game_date FROM ga WHERE game_date >= DATE '1998-03-01' QUALIFY position <= 3
        UNION ALL SELECT team_id, 'last' AS kind, row_number() OVER (PARTITION BY team_id ORDER BY game_date DESC, game_id DESC) AS position, game_id, game_date FROM ga WHERE game_date < DATE '1998-03-01' AND result IS NOT NULL QUALIFY position <= 3""",
    "measure_columns": f"{_G} SELECT team_id, season, CAST(sum(o_pts) AS DOUBLE) AS pts FROM ga GROUP BY ALL",
    "home_away_records": f"{_G} {_REC}",
    "conference_standings": f"""{_G}, rc AS ({_REC}) SELECT r_name AS conference, team_id, s_name AS team_name, wins, losses, w_pct, row_number() OVER (PARTITION BY r_name ORDER BY w_pct DESC, team_id) AS position
        FROM rc JOIN supplier ON s_suppkey = team_id JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "head_to_head": f"{_G} SELECT team_id, opponent_team_id, count(*) AS games, count(*) FILTER (WHERE result = 'W') AS wins, max(game_date) AS last_met, CAST(sum(pts) AS BIGINT) AS points FROM ga GROUP BY ALL",
    "team_leaders_by_delta": f"{_G}, {_M} SELECT team_id, net_rtg_delta AS delta FROM md WHERE delta IS NOT NULL ORDER BY delta DESC, team_id LIMIT 10",
    "team_decliners_by_delta": f"{_G}, {_M} SELECT team_id, net_rtg_delta AS delta FROM md WHERE delta IS NOT NULL ORDER BY delta, team_id LIMIT 10",
    "headlines": f"""{_G}, {_M} (SELECT team_id, net_rtg_delta AS delta, 'improver' AS kind FROM md WHERE delta IS NOT NULL ORDER BY delta DESC, team_id LIMIT 3)
        UNION ALL (SELECT team_id, net_rtg_delta AS delta, 'decliner' AS kind FROM md WHERE delta IS NOT NULL ORDER BY delta, team_id LIMIT 3)""",
    "sos_context_notes": f"""{_G}, {_M}, {_SOS} SELECT team_id, net_rtg_delta, sos_net_delta, CASE WHEN net_rtg_delta > 3 AND sos_net_delta > 2 THEN '✅ Improved vs harder schedule - legitimate surge'
        WHEN net_rtg_delta > 3 AND sos_net_delta < -2 THEN '⚠️ Improved vs easier schedule - may regress' WHEN net_rtg_delta < -3 AND sos_net_delta > 2 THEN '📊 Decline vs harder schedule - may not be as bad'
        WHEN net_rtg_delta < -3 AND sos_net_delta < -2 THEN '🚨 Decline vs easier schedule - concerning' END AS note FROM md JOIN sd USING (team_id)""",
    "team_completeness": f"{_G} SELECT team_id, count(*) AS played, count(*) FILTER (WHERE ok) AS used, CASE WHEN count(*) FILTER (WHERE n_desc <= 10) = 10 AND count(*) FILTER (WHERE NOT ok) = 0 THEN 'complete' ELSE 'partial' END AS status FROM ga GROUP BY team_id",
    "score_split": f"{_G} SELECT game_id, team_id, CAST(pts AS INTEGER) AS own_points, CAST(o_pts AS INTEGER) AS other_points FROM ga",
    "last_10_games": f"{_G} SELECT team_id, game_id, game_date, n_desc FROM ga WHERE n_desc <= 10",
}
