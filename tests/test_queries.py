"""Every registered game-log query against its DuckDB statement, on the smallest tables."""

from __future__ import annotations

import pytest

from hardwood import registry
from tests import oracle

FOLDER = "/root/testdata/sf0.001"
ORACLE = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.views(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, FOLDER)
    assert oracle.difference(df, con, ORACLE[name]) == ""


#: None of the fifteen players of the smallest tables is that far off; on larger ones some are.
EMPTY = {"hot_players_top20", "cold_players_top20"}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_statement_finds_rows(con, name):
    """A statement without rows would hold against anything."""
    assert name in EMPTY or con.execute(ORACLE[name]).fetchone() is not None


def test_labels_as_stated(spark):
    """Flags, tags and tiers are output values; they are written out here, apart from the code and its statements."""
    q = registry.queries()
    flags = {r.flag for r in q["team_flags"](spark, FOLDER).collect()}
    assert flags <= {"offense_rising", "offense_falling", "defense_improving", "defense_declining", "pace_up", "pace_down", "shooting_hot", "shooting_cold", "turnover_prone", "ball_secure", "three_point_heavy"}
    tags = {t for r in q["older_environment_tags"](spark, FOLDER).collect() for t in r.tags.split(",") if t}
    assert {"fast_pace", "slow_pace", "high_scoring", "defensive_battle", "three_point_fest", "paint_battle", "glass_war", "whistle_heavy", "chaotic"} >= tags and len(tags) >= 4
    assert {r.tier for r in q["five_tier_heat_buckets"](spark, FOLDER).collect()} <= {"on_fire", "heating_up", "average", "cooling_off", "ice_cold"}


def test_every_query_has_a_statement():
    assert set(ORACLE) == set(registry.queries())
