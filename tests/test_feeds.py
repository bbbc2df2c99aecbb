"""Provider payloads, as small JSON, and what may be stored of them."""

from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from hardwood.sources import feeds

DAY = datetime.date


@pytest.fixture
def load(spark, tmp_path):
    def read(payload, schema):
        path = tmp_path / f"{abs(hash(json.dumps(payload)))}.json"
        path.write_text(json.dumps(payload))
        return spark.read.schema(schema).json(str(path), multiLine=True)

    return read


def game(i, at, status, home, away, hs=None, as_=None):
    return {"gameId": i, "gameDateTimeUTC": at, "gameStatus": status, "homeTeam": {"teamId": home, "score": hs}, "awayTeam": {"teamId": away, "score": as_}}


def test_schedule(load):
    payload = {"gameDates": [{"games": [game("22400001", "2025-01-11T00:30:00Z", 3, 1, 2, 100, 90), game("22400002", "2025-01-11T20:00:00Z", 1, 3, 4)]}, {"games": [game("22400003", None, 3, 1, 2, 1, 0), game("22400004", "2025-01-12T00:00:00Z", 3, 5, 6, 80, 80), game("22400005", "2025-01-12T00:00:00Z", 3, None, 6, 80, 81)]}]}
    feed = load(payload, feeds.SCHEDULE)
    got = {(r.game_id, r.team_id): r for r in feeds.schedule_rows(feed).collect()}
    assert len(got) == 6
    r = got["0022400001", 2]
    assert (r.home_or_away, r.opponent_team_id, r.result, r.score) == ("A", 1, "L", "100-90") and got["0022400002", 3].result is None and got["0022400004", 5].result is None
    assert sorted(r.game_id for r in feeds.feed_games_on(feed, "2025-01-10").collect()) == ["0022400001"]


def test_records_and_wide_columns(spark):
    df = spark.createDataFrame([(["A", "B"], [["1", "2"], ["3", None]])], "headers array<string>, rowSet array<array<string>>")
    assert [r.record for r in feeds.records(df).collect()] == [{"A": "1", "B": "2"}, {"A": "3", "B": None}]
    long = spark.createDataFrame([(1, "s", "Base", "PerGame", "PTS", 10.0), (1, "s", "Opp", "PerGame", "PTS", 8.0)], "team_id int, season string, measure string, mode string, stat string, value double")
    wide = feeds.wide_stats(long)
    assert set(wide.columns) == {"team_id", "season", "base_pergame_pts", "opp_pergame_pts"}
    assert feeds.with_prefix(wide, ["team_id"], "opp_pergame").collect() == [(1, 8.0)]


def test_odds(load):
    book = lambda i, c, outcomes: {"id": i, "name": f"B{i}", "countryCode": c, "outcomes": outcomes}
    payload = {"games": [{"gameId": "22400001", "markets": [{"name": "2way", "books": [book("1", "US", [{"type": "home", "odds": "1.5"}, {"type": "away", "odds": "0"}]), book("2", "CA", [{"type": "home", "odds": "9"}])]}, {"name": "spread", "books": [book("1", "US", [{"type": "home", "odds": "1.9", "spread": "-3.5"}, {"type": "away", "odds": "1.9", "spread": "3.5"}])]}]}]}
    got = feeds.odds_rows(load(payload, feeds.ODDS)).collect()
    assert [tuple(r) for r in got] == [("0022400001", "1", "B1", 1.5, None, -3.5, 3.5)]


def test_availability(load):
    p = lambda i, status, played, reason=None: {"personId": i, "status": status, "played": played, "notPlayingReason": reason}
    payload = {"gameId": "22400001", "homeTeam": {"teamId": 1, "players": [p(1, "ACTIVE", "1"), p(2, "INACTIVE", "0", "INACTIVE_INJURY"), p(3, None, "1")]}, "awayTeam": {"teamId": 2, "players": [p(4, "ACTIVE", "0"), p(5, "ACTIVE", "1", "DNP")]}}
    rows = feeds.availability_rows(load(payload, feeds.BOX))
    assert sorted(r.player_id for r in rows.collect()) == [2, 3, 4, 5]
    games = load([{"game_id": "0022400001", "game_date": "2025-01-11", "season": "2024-25"}], "game_id string, game_date date, season string")
    assert {(r.game_date, r.season) for r in feeds.stamped(rows, games).collect()} == {(DAY(2025, 1, 11), "2024-25")}


ROSTER = "position int, player_id string, name string, number string"


def test_rosters(spark):
    payload = spark.createDataFrame([(1, "7", " Al Bo ", "12"), (2, "7", "Other", "1"), (3, "x", "No Id", "2"), (4, "8", " ", "3"), (5, "9", "Cy", "00x")], ROSTER)
    known = spark.createDataFrame([(7,), (9,)], "player_id long")
    assert sorted(map(tuple, feeds.resolved_roster(payload, known).collect())) == [(7, "Al Bo", 12), (9, "Cy", None)]
    with pytest.raises(ValueError, match="not stored"):
        feeds.resolved_roster(payload, known.where("player_id = 7"))
    with pytest.raises(ValueError, match="no player"):
        feeds.resolved_roster(payload.limit(0), known)
    rosters = spark.createDataFrame([(1, "2024-25", 5), (1, "2023-24", 5), (2, "2021-22", 6)], "team_id int, season string, player_id int")
    assert [feeds.tier(rosters, "2024-25", k).count() for k in ("current", "recent", "all")] == [1, 2, 3]
    with pytest.raises(ValueError):
        feeds.tier(rosters, "2024-25", "some")
    assert feeds.team_players(rosters, spark.createDataFrame([(1,), (1,)], "team_id int")).count() == 2


def test_seasons_of_players(spark):
    valid = ["2022-23", "2023-24", "2024-25"]
    players = spark.createDataFrame([(1, ["2020-21"], "2022", "2023"), (2, ["22"], "2022", "2023"), (3, None, None, "2023"), (4, [], "2024", "2030")], "player_id int, available_seasons array<string>, from_year string, to_year string")
    got = {r.player_id: r.available_seasons for r in feeds.rebuilt_seasons(players, valid).collect()}
    assert got == {1: ["2020-21"], 2: ["2022-23", "2023-24"], 3: [], 4: ["2024-25"]}
    synced = feeds.with_season(players.select("player_id", "available_seasons"), spark.createDataFrame([(2,), (9,)], "player_id int"), "2024-25")
    assert {r.player_id: r.available_seasons for r in synced.collect()}[9] == ["2024-25"]
    bios = spark.createDataFrame([(1, "Old", "200", "1990-02-03", "4", "2022", "2023"), (5, "New", "x", "2000-01-01", "", "2023", "2024"), (6, "Gone", "1", None, "1", "1990", "1991"), (5, "New", "x", "2000-01-01", "", "2023", "2024")], "player_id int, name string, weight string, birthdate string, exp string, from_year string, to_year string")
    out = feeds.bios(bios, players, valid, 2025).collect()
    assert [(r.player_id, r.weight, r.age, r.exp, r.available_seasons) for r in out] == [(5, None, 25, None, ["2023-24", "2024-25"])]
    assert spark.range(1).select(feeds.season_range(1999, 2001)).first()[0] == ["1999-00", "2000-01", "2001-02"]


def test_refresh_and_selection(spark):
    completed = spark.createDataFrame([(1, "a", DAY(2025, 1, 9)), (2, "b", DAY(2025, 1, 1)), (3, "a", DAY(2025, 1, 9))], "player_id int, game_id string, game_date date")
    stored = spark.createDataFrame([(p, g) for p in (1, 2) for g in ("c", "d", "e", "f", "g")] + [(3, x) for x in "acdefg"], "player_id int, game_id string")
    refresh = lambda **k: {r.player_id: r.refresh for r in feeds.needs_refresh(completed, stored, "2025-01-10", **k).collect()}
    assert refresh() == {1: True, 2: False, 3: False}
    assert refresh(forced=spark.createDataFrame([(2,)], "player_id int"))[2] and refresh(least=7)[3]
    schedule = spark.createDataFrame([("g1", DAY(2025, 1, 2), "s", 1, 2, "H", "W"), ("g1", DAY(2025, 1, 2), "s", 2, 1, "A", "L"), ("g2", DAY(2025, 1, 3), "s", 1, 3, "H", None), ("g3", DAY(2025, 1, 3), "s", 1, 4, "H", "W")], "game_id string, game_date date, season string, team_id int, opponent_team_id int, home_or_away string, result string")
    having = spark.createDataFrame([("g3",)], "game_id string")
    assert [tuple(r) for r in feeds.games_to_fetch(schedule, having, "2025-01-01", "2025-01-05").collect()] == [("g1", DAY(2025, 1, 2), "s", 1)]
    assert feeds.known_schedule(schedule, spark.createDataFrame([(1,), (2,)], "team_id int")).count() == 2
    assert feeds.known_only(schedule, game_id=having).count() == 1
    b = feeds.season_bounds(schedule).first()
    assert (b.first_game, b.last_completed) == (DAY(2025, 1, 2), DAY(2025, 1, 3))
    box = spark.createDataFrame([("1", 1, "JAN 02, 2025", 100)], "game_id string, team_id int, game_date string, pts int")
    known = schedule.withColumn("game_id", F.when(F.col("game_id") == "g1", "0000000001").otherwise(F.col("game_id")))
    r = feeds.team_box_scores(box, known).first()
    assert (r.game_date, r.season, r.opponent_team_id) == (DAY(2025, 1, 2), "2024-25", 2)
    logs = feeds.game_logs(spark.createDataFrame([("22400001", 5), ("bad", 1)], "Game_ID string, PTS int"), {"Game_ID": "game_id", "PTS": "points"})
    assert [tuple(r) for r in logs.collect()] == [("0022400001", 5)]


def test_markers(spark):
    m = spark.createDataFrame([("2025-01-01T00:00:00",)], "completed_at string")
    stale = lambda df, now: feeds.is_stale(df, now).first().stale
    assert not stale(m, "2025-01-02 05:00:00") and stale(m, "2025-01-02 07:00:00") and stale(m.limit(0), "2025-01-01 00:00:00")


STAND = "Conference string, TeamID string, TeamName string, WINS string, LOSSES string, WinPCT string, HOME string, ROAD string"


def test_scoreboard_and_standings(spark):
    headers = spark.createDataFrame([("g1", "7 pm"), ("g2", "8 pm")], "game_id string, tipoff string")
    lines = spark.createDataFrame([("g1", 2, 90), ("g1", 1, 100)], "game_id string, team_id int, points int")
    meetings = spark.createDataFrame([("g2", 1, 2)], "game_id string, home int, away int")
    got = {r.game_id: r for r in feeds.scoreboard(headers, lines, meetings).collect()}
    assert [tuple(x) for x in got["g1"].line_scores] == [(1, 100), (2, 90)] and got["g1"].last_meeting is None and tuple(got["g2"].last_meeting) == (1, 2)
    first = feeds.standings_rows(spark.createDataFrame([(" EASTERN", "1", "A", "0", "0", "0", None, None), ("west", "2", "B", "x", None, ".5", None, None), ("South", "3", "C", "1", "0", "1", None, None)], STAND))
    second = feeds.standings_rows(spark.createDataFrame([("East", "1", "A", "5", "1", ".8", "3-0", "2-1"), ("West", "2", "B", "9", "1", ".9", "3-0", "2-1")], STAND))
    assert {r.conference for r in first.collect()} == {"East", "West", "Unknown"}
    assert sorted((r.conference, r.w) for r in feeds.standings(first, second).collect()) == [("East", "5"), ("Unknown", "1"), ("West", "x")]
    assert first.where("conference = 'East'").agg(feeds.has_records()).first()[0] is False and first.limit(0).agg(feeds.has_records()).first()[0] is False


def test_lineups(spark):
    groups = spark.createDataFrame([(1, "A. Bo - C. Di Jr.", 20, 5.0), (1, "A. Bo - E. Fo", 3, 30.0)], "team_id int, group_name string, gp int, minutes double")
    roster = spark.createDataFrame([(1, 10, "Al Bo"), (1, 11, "Cy Di Jr."), (1, 12, "Ed Fo"), (1, 13, "Mono"), (2, 14, "Al Bo")], "team_id int, player_id int, player_name string")
    got = {r.kind: (r.gp, r.player_ids) for r in feeds.lineups(groups, roster).collect()}
    assert got == {"most_used": (20, [10, 11]), "most_recent": (3, [10, 12])}


def test_names_and_codes(spark):
    df = spark.sql("select named_struct('AbC', array(named_struct('X', 1))) as Top, map('K', named_struct('Y', 2)) as M")
    low = feeds.lower_names(df)
    assert low.columns == ["top", "m"] and low.select("top.abc.x", "m").first() == ([1], {"K": (2,)}) and low.schema["m"].dataType.valueType.names == ["y"]
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(feeds.is_player_id(F.lit(x))) for x in ("1", "0", "10000000", "a", None)] == [True, False, False, False, False]
    assert [one(feeds.is_team_id(F.lit(x))) for x in ("1610612740", "5", None)] == [True, False, False]
    assert [one(feeds.is_page_season(F.lit(x))) for x in ("2024-25", "2009-10", "24-25", None)] == [True, False, False, False]
