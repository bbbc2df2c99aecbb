"""Small cases with known answers: streaks, seasons, snapshots, reconciliation, merges."""

from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from hardwood.functions import ratings, seasons
from hardwood.operators import form, quality, reading, snapshots, teams, upsert
from hardwood.plans import checks
from hardwood.sources import feeds

DAY = datetime.date


def facts(spark, points, stat="PTS"):
    """Games oldest first, one a day."""
    rows = [(1, stat, f"{i:010d}", datetime.datetime(2025, 1, 1 + i), float(p) if p is not None else None) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "player_id long, stat string, game_id string, game_time timestamp, value double")


@pytest.mark.parametrize("points,want", [((20, 22, 18, 25, 24), 2), ((25, 24, 18, 25, 24), 2), ((15, 18, 12), None)])
def test_current_streaks(spark, points, want):
    got = form.current_streaks(facts(spark, points), [20]).collect()
    assert [r.streak_games for r in got] == ([] if want is None else [want])
    if got:
        assert got[0].start_time == datetime.datetime(2025, 1, 1 + len(points) - want) and got[0].end_time == datetime.datetime(2025, 1, len(points))


def test_season_best_and_windows(spark):
    points = (25, 24, 18, 25, 24, 26, 23, 15, 25)
    assert [r.streak_games for r in form.longest_streaks(facts(spark, points), [20]).collect()] == [4]
    assert [r.streak_games for r in form.current_streaks(facts(spark, points), [20]).collect()] == [1]
    w = form.stat_windows(facts(spark, (25, 24, 18, 25, 24)), [20], (5,)).first()
    assert (w.games_hit, w.games_played) == (4, 5)


def test_missing_component_is_no_zero(spark):
    logs = spark.createDataFrame([(1, "a", 10, 5, 5), (1, "b", 20, None, 5)], "player_id long, game_id string, p int, r int, a int")
    long = form.unpivot_stats(logs, {"PTS": "p", "REB": "r", "AST": "a"}, ["player_id", "game_id"])
    assert {(r.game_id, r.stat): r.value for r in long.where("stat = 'PRA'").collect()} == {("a", "PRA"): 20.0, ("b", "PRA"): None}
    left = form.complete(long.withColumn("game_time", F.current_timestamp()))
    assert {r.stat for r in left.collect()} == {"PTS", "AST"}


def test_seasons(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    day = lambda x: F.lit(x).cast("date")
    assert [one(seasons.season_of(day(x))) for x in ("2024-09-30", "2024-10-01", "2025-01-01", "1999-12-31")] == ["2023-24", "2024-25", "2024-25", "1999-00"]
    assert [one(seasons.is_season(F.lit(x))) for x in ("2024-25", "2024-26", "1999-00", "24-25", "2024", None)] == [True, False, True, False, False, False]
    assert one(seasons.active_season(day("2025-08-01"), F.lit("2024-25"), F.lit(False))) == "2024-25"
    assert one(seasons.active_season(day("2025-08-01"), F.lit("2024-25"), F.lit(True))) == "2025-26"
    assert one(seasons.canonical_season(F.lit("1998"))) == "1998-99" and one(seasons.canonical_season(F.lit("98"))) is None
    assert one(seasons.season_type(F.lit(" ALL_STAR "))) == "All-Star" and one(seasons.season_type(F.lit("summer"))) is None
    assert one(seasons.season_type_of_game(F.lit("0032400001"))) == "All-Star"
    assert [one(F.date_format(seasons.slate_cutoff(day(x)), "HH:mm")) for x in ("2025-01-10", "2025-07-10")] == ["15:00", "14:00"]


def test_small_columns(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(ratings.as_fraction(F.lit(x))) for x in (0.5, 45.0, 101.0, -2.0)] == [0.5, 0.45, None, -2.0]
    assert [one(ratings.minutes(F.lit(x))) for x in ("34:30", "12.26", "x", None)] == [34.5, 12.3, None, None]
    assert [one(ratings.int_or_null(F.lit(x))) for x in (" 7 ", "", "a", None)] == [7, None, None, None]
    assert [one(ratings.whole_scores(F.lit(x))) for x in ("AB 101.0 - 99.5 CD", "AB 101 - 99.0 CD", "none")] == ["AB 101 - 99.5 CD", "AB 101 - 99 CD", "none"]
    assert [one(ratings.hit_mark(F.lit(n), F.lit(10))) for n in (8, 6, 4, 3)] == ["🔥", "✓", "○", "✗"] and one(ratings.hit_mark(F.lit(0), F.lit(0))) == "✗"
    show = lambda *a: one(ratings.reason_text(*(F.lit(x) for x in a)))
    assert show("INACTIVE_REST", "", "INACTIVE", False) == "Rest" and show("X", None, None, True) == "Played" and show(None, None, "INACTIVE", False) == "Inactive"
    assert show("ODD", None, None, False) == "ODD" and show(None, "sore", None, False) == "sore" and show(None, None, "OUT", False) == "Did Not Play"
    assert one(ratings.environment_label(F.lit(103.0), F.lit(94.0))[0]) == "fast" and one(ratings.environment_label(F.lit(103.0), F.lit(94.0))[1]) == "low"
    assert one(ratings.any_of([F.lit(False), F.lit(True)])) and not one(ratings.all_of([F.lit(True), None, F.lit(False)]))


BOX = "game_id string, season string, team_id long, opponent_team_id long, game_date date, game_time timestamp, is_home boolean, fg int, fga int, fg3 int, fta int, oreb int, dreb int, tov int, pts int"


def team_games(days=range(10), dreb=32):
    rows = []
    for i in days:
        at = datetime.datetime(2025, 10, 22) + datetime.timedelta(days=i)
        for team, other, fg, fg3, pts in ((1, 2, 40, 12, 105 + i), (2, 1, 38, 10, 101 + i)):
            rows.append((f"002250{i:04d}", "2025-26", team, other, at.date(), at + datetime.timedelta(hours=23), team == 1, fg, 85, fg3, 22, 10, dreb, 13, pts))
    return rows


def slate(spark, day):
    at = DAY(2025, 10, 22) + datetime.timedelta(days=day)
    return spark.createDataFrame([("0022509999", "2025-26", 1, 2, at, True), ("0022509999", "2025-26", 2, 1, at, False)], "game_id string, season string, team_id long, opponent_team_id long, game_date date, is_home boolean")


def features(spark, rows, day=10):
    out = snapshots.team_features(slate(spark, day), spark.createDataFrame(rows, BOX))
    return out, {r.team_id: r for r in out.collect()}


def test_team_features_from_full_history(spark):
    df, got = features(spark, team_games())
    r = got[1]
    own = 85 + 0.44 * 22 - 10 + 13
    assert (r.season_games_played, r.window_games_used, r.completeness_status) == (10, 10, "complete")
    assert r.off_rtg_lastn == pytest.approx(sum(105 + i for i in range(10)) / (10 * own) * 100, abs=1e-4) and r.pace_season == pytest.approx(own, abs=1e-4)
    assert r.source_latest_game_id == "0022500009" and r.net_rtg_season > 0 and got[2].net_rtg_season == pytest.approx(-r.net_rtg_season)
    env = snapshots.game_environments(df).collect()
    assert len(env) == 1 and env[0].home_team_id == 1 and env[0].completeness_status == "complete" and env[0].pace_projection == pytest.approx(round(own, 2))
    assert json.loads(r.missing_input_flags) == {}


def test_later_and_target_games_change_nothing(spark):
    before = features(spark, team_games())[1]
    after = features(spark, team_games(range(14)))[1]
    assert {k: v.asDict() for k, v in before.items()} == {k: v.asDict() for k, v in after.items()}


def test_missing_box_value_is_left_out_and_reported(spark):
    rows = [(*r[:12], None, *r[13:]) if r[0] == "0022500004" and r[2] == 2 else r for r in team_games()]
    got = features(spark, rows)[1]
    assert (got[1].season_games_played, got[1].season_games_used, got[1].completeness_status) == (10, 9, "partial")
    assert json.loads(got[1].missing_input_flags)["excluded_season_games"] == {"0022500004": ["o_dreb"]} and got[2].season_games_used == 10


def test_early_season_is_partial(spark):
    got = features(spark, team_games(range(3)), 3)[1]
    assert got[1].completeness_status == "partial" and json.loads(got[1].missing_input_flags) == {"insufficient_window_games": {"required": 10, "available": 3}}
    first = features(spark, team_games(range(3)), 0)[1]
    assert first[1].off_rtg_season is None and json.loads(first[1].missing_input_flags)["no_prior_games"] is True


def test_strength_of_schedule_so_far(spark):
    rows = spark.createDataFrame(team_games(), BOX)
    got = {r.team_id: r for r in snapshots.prior_strength(slate(spark, 10), rows).collect()}
    net = {r.team_id: r.net_rtg_season for r in features(spark, team_games())[0].collect()}
    assert got[1].sos_net_season == pytest.approx(net[2], abs=1e-4) and got[2].sos_net_lastn == pytest.approx(net[1], abs=1e-4)


def test_backfills_are_bounded_and_resume(spark):
    games = spark.createDataFrame([(DAY(2025, 1, d),) for d in (1, 2, 3)], "game_date date")
    dates = lambda **k: sorted(r[0].day for r in snapshots.slate_dates(games, DAY(2025, 1, 1), DAY(2025, 1, 31), **k).collect())
    assert dates() == [1, 2, 3] and dates(resume_after=DAY(2025, 1, 1)) == [2, 3]
    with pytest.raises(ValueError):
        snapshots.slate_dates(games, DAY(2025, 2, 1), DAY(2025, 1, 1))


def test_player_snapshots_without_dates_and_late_sources(spark):
    f = facts(spark, (20, 25, 30, 10, 15))
    none = spark.createDataFrame([], "game_date date")
    assert all(v.count() == 0 for v in snapshots.player_snapshots(f, none, [20]).values())
    one = spark.createDataFrame([(DAY(2025, 1, 4),)], "game_date date")
    w = snapshots.player_snapshots(f, one, [20], windows=(5,))["windows"].first()
    assert (w.games_hit, w.games_played) == (3, 3) or w.games_played == 4  # games at midnight UTC lie on the day before
    rows = spark.createDataFrame([(1, datetime.datetime(2025, 1, 2), datetime.datetime(2025, 1, 1))], "k int, data_available_at timestamp, feature_as_of timestamp")
    assert snapshots.late(rows).count() == 1
    with pytest.raises(ValueError):
        snapshots.with_provenance(rows, "Regular Season", "v", "")


SCHEDULE = "game_id string, season string, team_id int, opponent_team_id int, slate_date date, home_or_away string, result string, score string"
FACTS = "game_id string, season string, team_id int, opponent_team_id int, game_date date, result string, points int"
D0 = DAY(2025, 1, 10)


def sources(spark, results=(None, None), scores=(None, None), wl=("W", "L"), points=(112, 105), fact_rows=2, opponent=10, season="2024-25", day=D0, sides=("H", "A")):
    s = [("g", "2024-25", 10, 20, D0, sides[0], results[0], scores[0]), ("g", "2024-25", 20, 10, D0, sides[1], results[1], scores[1])]
    f = [("g", season, 10, 20, day, wl[0], points[0]), ("g", season, 20, opponent, day, wl[1], points[1])][:fact_rows]
    return spark.createDataFrame(s, SCHEDULE), spark.createDataFrame(f, FACTS)


@pytest.mark.parametrize(
    "case,action,issue",
    [
        ({}, "update", None), ({"results": ("W", None)}, "issue", "schedule has a mixed null/non-null result pair"), ({"opponent": 30}, "issue", "team-game pair is not reciprocal"), ({"points": (100, 105)}, "issue", "W/L disagrees with team-game points"),
        ({"results": ("W", "L"), "scores": (None, None)}, "complete", None), ({"results": ("W", "L"), "scores": ("1-2", "1-2")}, "complete", None), ({"results": ("W", "L"), "fact_rows": 0}, "complete", None),
        ({"results": ("W", "W")}, "issue", "existing schedule results are not a W/L pair"), ({"scores": ("99-98", None)}, "issue", "existing schedule score disagrees with team-game points"), ({"scores": ("0-0", "-")}, "update", None), ({"scores": ("112-105", None)}, "update", None),
        ({"fact_rows": 0}, "issue", "expected 2 team-game rows; found 0"), ({"season": "2023-24"}, "issue", "schedule and team-game seasons differ"), ({"day": DAY(2025, 1, 11)}, "issue", "schedule and team-game dates differ"), ({"wl": ("W", None)}, "issue", "team-game rows are not a W/L pair"),
        ({"points": (112, None)}, "issue", "team-game score is missing"), ({"sides": ("H", "H")}, "issue", "schedule must contain one H and one A row"),
    ],
)
def test_reconciliation(spark, case, action, issue):
    s, f = sources(spark, **case)
    plan = quality.reconcile(s, f)
    r = plan.first()
    assert (r.action, r.issue) == (action, issue) and r.final_score == ("112-105" if action == "update" else None)
    updates = quality.result_updates(plan, f)
    assert quality.blocked_updates(s, updates).count() == 0
    if action == "issue":
        with pytest.raises(quality.Blocked, match="1 reconciliation issue"):
            quality.apply_results(s, plan, updates)
    else:
        after = {x.team_id: (x.result, x.score) for x in quality.apply_results(s, plan, updates).collect()}
        assert after == ({10: ("W", "112-105"), 20: ("L", "112-105")} if action == "update" else {x.team_id: (x.result, x.score) for x in s.collect()})


@pytest.mark.parametrize("change", ["result", "score", "season", "gone", "twice", "update twice"])
def test_a_schedule_that_changed_is_not_written(spark, change):
    """Each stops the run, whatever columns are read; the row of the other team is as it was."""
    s, f = sources(spark)
    plan = quality.reconcile(s, f)
    updates = quality.result_updates(plan, f)
    one = F.col("team_id") == 10
    changed = {
        "result": s.withColumn("result", F.when(one, "L")), "score": s.withColumn("score", F.when(one, "1-2")), "season": s.withColumn("season", F.when(one, "2023-24").otherwise(F.col("season"))), "gone": s.where(~one), "twice": s.unionByName(s.where(one)), "update twice": s,
    }[change]
    if change == "update twice":
        updates = updates.unionByName(updates.where(one))
    else:
        assert quality.blocked_updates(changed, updates).count() == 1
    with pytest.raises(Exception, match="changed after planning"):
        quality.apply_results(changed, plan, updates).select("game_id").collect()


def test_the_applied_schedule_is_whole(spark):
    """The query gives out every row of the schedule; those of games with an issue are the schedule's own."""
    folder = "/root/testdata/sf0.001"
    s, f = checks._sources(spark, folder)
    actions = {r.game_id: r.action for r in quality.reconcile(s, f).collect()}
    got = [tuple(r) for r in checks.QUERIES["reconcile_apply"](spark, folder).collect()]
    own = [tuple(r) for r in s.select("game_id", "team_id", "result", "score").collect()]
    assert len(got) == len(own) and {r[0] for r in got} == set(actions) and "issue" in actions.values()
    assert sorted((r for r in got if actions[r[0]] != "update"), key=str) == sorted((r for r in own if actions[r[0]] != "update"), key=str)


def test_pairs_sides_and_opponents(spark):
    rows = spark.createDataFrame([r for r in team_games(range(2)) if not (r[0].endswith("1") and r[2] == 2)], BOX)
    got = {(r.game_id[-1], r.team_id): r.o_pts for r in teams.with_opponent(rows).collect()}
    assert got == {("0", 1): 101, ("0", 2): 105, ("1", 1): None}
    assert teams.pair_sides(rows, ["pts"]).count() == 1


ROWS = "k int, v string, at int"


def test_merge_takes_the_last_of_a_batch_and_keeps_firsts(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (None, "n", 1)], ROWS)
    new = spark.createDataFrame([(1, "b", 2), (1, "c", 3), (3, "d", 3), (None, "m", 4)], ROWS)
    got = sorted(upsert.merged(old, new, ["k"], ("at",), "at").collect(), key=lambda r: r.k or 0)
    assert [tuple(r) for r in got] == [(None, "m", 1), (1, "c", 1), (2, "b", 1), (3, "d", 3)]
    assert upsert.merged(old, new, ["k"], (), "at").where("k = 1").collect() == [(1, "c", 3)]


def test_stored_table(spark, tmp_path):
    """Only touched partitions change; running it again, or after a stop before the swap, gives the same table."""
    path = f"{tmp_path}/t"
    table = lambda: sorted(tuple(r) for r in spark.read.parquet(path).select("k", "v", "at").collect())
    upsert.upsert(spark.createDataFrame([(1, "a", 1), (2, "b", 2), (2, "bb", 2)], ROWS), path, ["k", "at"], "at")
    assert table() == [(1, "a", 1), (2, "bb", 2)]
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 2)], ROWS)
    real = upsert.replace_partitions
    try:
        upsert.replace_partitions = lambda *a: (_ for _ in ()).throw(RuntimeError("stopped"))
        with pytest.raises(RuntimeError):
            upsert.upsert(new, path, ["k", "at"], "at")
    finally:
        upsert.replace_partitions = real
    assert table() == [(1, "a", 1), (2, "bb", 2)]
    for _ in range(2):
        upsert.upsert(new, path, ["k", "at"], "at")
        assert table() == [(1, "a", 1), (2, "c", 2), (3, "d", 2)]
    with pytest.raises(ValueError):
        upsert.upsert(new, path, ["k"], "at")


def test_roster_scopes(spark):
    schema = "team_id int, player_id int, name string"
    old = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 3, "c")], schema)
    new = spark.createDataFrame([(1, 2, "bb"), (1, 4, "d"), (1, 4, "d")], schema)
    assert sorted(map(tuple, upsert.reconciled_roster(old, new, ["team_id"], "player_id").collect())) == [(1, 2, "bb"), (1, 4, "d"), (2, 3, "c")]
    assert upsert.reconciled_roster(old, new.limit(0), ["team_id"], "player_id").count() == 3


def test_success_marker(spark, tmp_path):
    path = f"file://{tmp_path}/done.json"
    for at in ("2025-01-01T00:00:00", "2025-01-03T00:00:00"):
        upsert.write_marker(spark, path, {"completed_at": at})
        assert spark.read.json(path).first().completed_at == at
    assert not feeds.is_stale(spark.read.json(path), "2025-01-04 00:00:00").first().stale


def test_reads(spark):
    rows = spark.createDataFrame([(1, "a", 2.0), (2, "b", 1.0), (2, "c", 3.0)], "k int, v string, m double")
    assert {r.v for r in reading.filtered(rows, k=None, v=["a", "b"]).collect()} == {"a", "b"} and reading.filtered(rows, [F.desc("m")], 1, k=2).first().v == "c"
    assert reading.chosen(rows, ["k"], "m", ("m",)).columns == ["k", "value"] and reading.exists(rows, "m > 2") and not reading.exists(rows, "m > 3")
    with pytest.raises(ValueError):
        reading.chosen(rows, ["k"], "v", ("m",))
    assert sorted(map(tuple, reading.latest_by(rows, "k", "m").collect())) == [(1, "a", 2.0), (2, "c", 3.0)]
