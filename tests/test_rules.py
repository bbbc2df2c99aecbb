"""Rules at their bounds, with known answers."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from hardwood.functions import ratings
from hardwood.operators import form, reading, reports, serving

DAY = datetime.date


def shown(spark, c):
    return spark.range(1).select(c.alias("c")).first()[0]


@pytest.mark.parametrize(
    "net,sos,note",
    [
        (3.0, 3.0, None), (4.0, 2.0, None), (3.1, 2.1, "✅ Improved vs harder schedule - legitimate surge"), (3.1, -2.1, "⚠️ Improved vs easier schedule - may regress"), (-3.1, 2.1, "📊 Decline vs harder schedule - may not be as bad"),
        (-3.1, -2.1, "🚨 Decline vs easier schedule - concerning"), (-3.0, -3.0, None), (None, 5.0, None), (5.0, None, None),
    ],
)
def test_sos_note(spark, net, sos, note):
    assert shown(spark, ratings.sos_note(F.lit(net).cast("double"), F.lit(sos).cast("double"))) == note


@pytest.mark.parametrize("delta,mark", [(2.0, "➖"), (2.1, "📈"), (-2.0, "➖"), (-2.1, "📉"), (None, None)])
def test_trend(spark, delta, mark):
    assert shown(spark, ratings.trend(F.lit(delta).cast("double"), 2.0)) == mark
    turned = {"📈": "📉", "📉": "📈"}.get(mark, mark)
    assert shown(spark, ratings.trend(F.lit(delta).cast("double"), 2.0, lower_is_better=True)) == turned


@pytest.mark.parametrize(
    "dense,rest,text",
    [
        ((True, True, False, False), 0, "Back-to-Back"), ((False, True, True, True), 1, "3-in-4 nights (1 days rest)"), ((False, False, True, False), 1, "4-in-5 nights (1 days rest)"), ((False, False, False, True), 2, "5-in-7 nights (2 days rest)"),
        ((False,) * 4, 4, "Well rested (4 days rest)"), ((False,) * 4, 3, "Well rested (3 days rest)"), ((False,) * 4, 2, "Normal rest (2 days rest)"), ((False,) * 4, 1, "Short rest (1 day rest)"), ((False,) * 4, None, "Unknown"),
    ],
)
def test_schedule_text(spark, dense, rest, text):
    assert shown(spark, ratings.schedule_text(*map(F.lit, dense), F.lit(rest).cast("long"))) == text


def test_profile_needs_a_lead_of_more_than_the_margin(spark):
    rows = lambda i, steady, volatile: [(i, "steady")] * steady + [(i, "volatile")] * volatile
    c = spark.createDataFrame(rows(1, 3, 1) + rows(2, 4, 1) + rows(3, 1, 4) + rows(4, 1, 3), "player_id long, tier string")
    got = lambda m: {r.player_id: r.profile for r in form.profile_class(c, m).collect()}
    assert got(2) == {1: "mixed", 2: "steady", 3: "volatile", 4: "mixed"} and got(1) == {1: "steady", 2: "steady", 3: "volatile", 4: "volatile"}


def test_consensus_of_us_books(spark):
    """A spread of 0 counts, prices of 0 don't; books of other countries or none are left out; rows are counted."""
    rows = [("g", 1, "A", "US", 1.5, 0.0, 0.0), ("g", 1, "A", "US", 2.0, 3.0, 1.0), ("g", 2, "B", "US", None, None, None), ("g", 3, "C", "CA", 9.0, 9.0, 9.0), ("g", 4, "D", None, 9.0, 9.0, 9.0), ("h", 3, "C", "CA", 1.0, 1.0, 1.0)]
    odds = spark.createDataFrame(rows, "game_id string, sportsbook_id long, sportsbook_name string, country_code string, home_odds double, away_odds double, home_spread double")
    assert [tuple(r) for r in serving.consensus_odds(odds).collect()] == [("g", 1.75, 3.0, 0.5, 3, "A,A,B")]


def test_streak_scores(spark):
    streaks = spark.createDataFrame([(1, "PTS", 20.0, 4, "current", True), (1, "PTS", 10.0, 9, "season_max", True), (1, "PTS", 30.0, 9, "season_max", False), (2, "PTS", 20.0, 5, "current", True), (3, "PTS", 20.0, 5, "season_max", False)], "player_id long, stat string, threshold double, streak_games long, kind string, is_active boolean")
    averages = spark.createDataFrame([(1, "PTS", 25.0), (3, "PTS", 0.0)], "player_id long, stat string, season_avg double")
    got = {(r.player_id, r.threshold): r.rank_score for r in form.streak_scores(streaks, averages).collect()}
    assert got == {(1, 20.0): 1180.4, (1, 10.0): 1040.9, (1, 30.0): 120.9, (2, 20.0): 1120.5, (3, 20.0): 20.5}


def test_season_best_that_is_still_active(spark):
    times = [datetime.datetime(2025, 1, 1 + i) for i in range(5)]
    f = spark.createDataFrame([(1, "PTS", str(i), t, v) for i, (t, v) in enumerate(zip(times, (25.0, 5.0, 25.0, 25.0, 25.0), strict=True))], "player_id long, stat string, game_id string, game_time timestamp_ntz, value double")
    assert [(r.streak_games, r.is_active) for r in form.longest_streaks(f, [20]).collect()] == [(3, True)]
    assert [(r.streak_games, r.is_active) for r in form.longest_streaks(f.where("game_id <> '4'").unionByName(f.where("game_id = '0'").withColumn("game_id", F.lit("9")).withColumn("value", F.lit(1.0)).withColumn("game_time", F.lit(times[4]).cast("timestamp_ntz"))), [20]).collect()] == [(2, False)]


def test_current_injuries_are_each_players_newest(spark):
    """The team has played on since: a player who was hurt before its last date is still listed."""
    rows = [(1, 10, DAY(2025, 1, 1), "a"), (1, 10, DAY(2025, 1, 5), "b"), (2, 10, DAY(2025, 1, 3), "c"), (3, 10, DAY(2025, 1, 9), "d"), (1, 11, DAY(2025, 1, 5), "e")]
    status = spark.createDataFrame([(p, t, d, g, "INACTIVE_REST" if g == "d" else "INACTIVE_INJURY") for p, t, d, g in rows], "player_id long, team_id long, game_date date, game_id string, not_playing_reason string")
    assert sorted(r.game_id for r in serving.current_injuries(status).collect()) == ["b", "c", "e"]


def test_callouts(spark):
    players = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (4, 7), (5, 8)], "player_id long, team_id long")
    heat = spark.createDataFrame([(1, "PTS", 3, 0.7), (1, "PTS", 5, -0.7), (1, "PTS", 10, 1.5), (1, "REB", 3, 3.0), (1, "AST", 5, 0.5), (2, "PTS", 3, 0.64), (2, "PTS", 4, 2.0)], "player_id long, stat string, window_size int, z_score double")
    streaks = spark.createDataFrame([(1, "PTS", 20.0, 3), (1, "PTS", 10.0, 2), (3, "PTS", 20.0, 2)], "player_id long, stat string, threshold double, streak_games long")
    windows = spark.createDataFrame([(1, "PTS", 20.0, 10, 7, 10), (1, "PTS", 30.0, 10, 6, 10), (2, "PTS", 20.0, 5, 5, 5), (5, "PTS", 20.0, 10, 7, 9)], "player_id long, stat string, threshold double, window_size int, games_hit long, games_played long")
    consistency = spark.createDataFrame([(1, "steady"), (1, "steady"), (5, "volatile")], "player_id long, tier string")
    injuries = spark.createDataFrame([(4, DAY(2025, 1, d), f"knee {d}") for d in (1, 2, 3)], "player_id long, game_date date, description string")
    got = {r.player_id: r for r in serving.callouts(players, heat, streaks, windows, consistency, injuries).collect()}
    # Heat in list order: 0.7, 0.7, 1.5 of PTS; the 3.0 of REB comes fourth.
    assert {k: (r.score, r.position, r.consistency_tier) for k, r in got.items()} == {1: (14.9, 1, "steady"), 4: (0.0, 2, "mixed"), 5: (2.0, 1, "mixed")}
    assert [(h.stat, h.z_score) for h in got[1].heat] == [("REB", 3.0), ("PTS", 1.5), ("PTS", 0.7)] and [i.description for i in got[4].injuries] == ["knee 3", "knee 2"]
    assert [w.threshold for w in got[1].windows] == [20.0] and [x.streak_games for x in got[1].streaks] == [3]


def test_tiers_are_cut_to_their_caps(spark):
    heat = spark.createDataFrame([(i, "PTS", 5, 1.0 + i) for i in range(5)] + [(10 + i, "PTS", 5, 0.0) for i in range(4)] + [(20, "PTS", 5, -2.0)], "player_id long, stat string, window_size int, z_score double")
    got = [(r.tier, r.player_id, r.position) for r in serving.tiers(heat, {"on_fire": 2, "average": 1, "ice_cold": 3}).collect()]
    assert sorted(got) == [("average", 10, 1), ("ice_cold", 20, 1), ("on_fire", 3, 2), ("on_fire", 4, 1)]


def test_named_reads(spark):
    rows = spark.createDataFrame([(1, "a", 5, ["x"], DAY(2025, 1, 1)), (2, "Ab", 7, None, DAY(2025, 1, 2)), (3, "cAB", 7, ["x", "y"], DAY(2025, 1, 3))], "player_id int, name string, pts int, available_seasons array<string>, game_date date")
    ids = lambda read, **a: [r.player_id for r in reading.named(read, rows, **a).collect()]
    assert ids("player", player_id=2) == [2] and ids("player_by_name", name="aB") == [2] and ids("players_all") == [2, 1, 3] and ids("player", player_id=9) == []
    assert ids("players_of_season", available_seasons="x") == [1, 3] and reading.named("has_player", rows, player_id=[1, 3, 4]).first()[0] == 2
    g = rows.select(F.col("player_id").alias("team_id"), "game_date", "pts", F.when(F.col("pts") > 5, "W").alias("result"), F.lit("s").alias("season"), F.lit(True).alias("is_b2b"))
    assert [r.team_id for r in reading.named("last_games", g, limit=1, game_date=DAY(2025, 1, 3)).collect()] == [2]
    assert [r.team_id for r in reading.named("next_games", g, limit=5, game_date=DAY(2025, 1, 2)).collect()] == [2, 3]
    assert [r.team_id for r in reading.named("back_to_backs", g, game_date=(DAY(2025, 1, 2), DAY(2025, 1, 3))).collect()] == [3, 2]
    with pytest.raises(ValueError, match="pts"):
        reading.named("player", rows, pts=1)


def test_report_lines_and_sections(spark):
    t = lambda d: datetime.datetime(2025, 1, d)
    s = spark.createDataFrame([(1, "Al Bo", "PTS", 20.0, 4, t(2), t(9), "current", True), (1, "Al Bo", "REB", 5.0, 12, t(1), t(30), "season_max", False)], "player_id int, player_name string, stat string, threshold double, streak_games long, start_time timestamp_ntz, end_time timestamp_ntz, kind string, is_active boolean")
    w = spark.createDataFrame([(1, "Al Bo", "PTS", 20.0, 7, 10, 10, t(9)), (2, "Cy", "PTS", 20.0, 0, 0, 5, t(9))], "player_id int, player_name string, stat string, threshold double, games_hit long, games_played long, window_size int, last_game_date timestamp_ntz")
    h = spark.createDataFrame([(1, "Al Bo", "PTS", 5, 0.655, 22.125, 20.0)], "player_id int, player_name string, stat string, window_size int, z_score double, recent_avg double, season_avg double")
    c = spark.createDataFrame([(1, "pts", 0, 20.25, 5.0, 0.2469, 8.0, 31.5, "steady")], "player_id int, stat string, window_size int, mean double, sd double, cv double, min_value double, max_value double, tier string")
    text = reports.report([reports.section(1, s, "player_id", reports.streak_line(), [F.asc("stat")], "%d Streaks"), reports.section(2, w, "player_id", reports.window_line(), [F.asc("stat")]), reports.section(3, h, "player_id", reports.heat_line(), [F.asc("stat")]), reports.section(4, c, "player_id", reports.consistency_line(), [F.asc("stat")])], "player_id")
    got = {r.player_id: r.report.split("\n") for r in text.collect()}
    assert got == {
        1: [
            "2 Streaks",
            "Al Bo                     |  PTS | >= 20 |   4 games | 01/02 - 01/09 |      Current | 🔥 ACTIVE",
            "Al Bo                     |  REB | >=  5 |  12 games | 01/01 - 01/30 |  Season Best | ✓ Complete",
            "Al Bo                     |  PTS | >= 20 |  7/10 | 10g |  70.0% | 01/09/2025 | ✓",
            "Al Bo                     |  PTS |  5g | Z:   0.66 | Recent:  22.13 | Season:  20.00 | 📈 HEATING UP",
            " PTS | Avg:   20.3 | StdDev:   5.0 | CV:  0.25 | Range: 8-32 | 🎯 STEADY",
        ],
        2: ["Cy                        |  PTS | >= 20 |  0/ 0 |  5g |   0.0% | 01/09/2025 | ✗"],
    }
