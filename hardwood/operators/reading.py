"""Reads that pages and services make of stored tables: optional filters, chosen columns, latest rows."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hardwood.functions import ratings


def filtered(rows: DataFrame, order: list[Column] | None = None, limit: int | None = None, **wanted) -> DataFrame:
    """Rows whose columns have the wanted values: one value, a list of them, or None for any. With an order, sorted; with
    a limit too, the first so many."""
    predicates = [None if v is None else F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c) == F.lit(v) for c, v in wanted.items()]
    found = rows.where(ratings.all_of(predicates))
    found = found.orderBy(*order) if order else found
    return found if limit is None else found.limit(limit)


def matching(rows: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys occur together in pairs, however many there are: a join instead of a list of conditions."""
    return rows.join(pairs.select(*keys).distinct(), keys, "left_semi")


def chosen(rows: DataFrame, keys: list[str], metric: str, allowed: tuple[str, ...]) -> DataFrame:
    """The keys and one metric of the allowed ones, as `value`; another name is an error."""
    if metric not in allowed or metric not in rows.columns:
        raise ValueError(f"no such metric: {metric}")
    return rows.select(*keys, F.col(metric).alias("value"))


def exists(rows: DataFrame, condition: Column | str) -> bool:
    return not rows.where(condition).isEmpty()


def latest_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, with the largest `order`, of equal ones the largest row; one aggregation."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(order, *others)).alias("_r")).select(key, "_r.*")


# -- named reads -----------------------------------------------------------------------------------------------------


class Read(NamedTuple):
    """A read of a stored table: the columns that may be asked for, the order, and what is taken: all, first, limit or count.

    A column may be asked for by equality (or a list of values); ">=x" and "<=x" are bounds, "<x" is an open one, "~x"
    contains a text whatever its case, "@x" is a list that holds a value, "!x" has to be there. "-x" sorts x downwards."""

    table: str
    asked: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    take: str = "all"


#: The reads of each stored table.
READS = {
    "streak": Read("streaks", ("id",), (), "first"),
    "streaks_active": Read("streaks", ("season", "streak_kind", "is_active", ">=streak_games", "stat"), ("-streak_games",)),
    "streaks_of_player": Read("streaks", ("player_id", "season", "stat", "streak_kind"), ("-streak_games",)),
    "environment_of_game": Read("game_environment", ("game_id",), (), "first"),
    "environments_of_date": Read("game_environment", ("game_date",)),
    "odds_of_game": Read("game_odds", ("game_id",), ("sportsbook_name",)),
    "odds_of_date": Read("game_odds", ("game_date", "country_code"), ("game_id", "sportsbook_name")),
    "logs_of_player": Read("gamelogs", ("player_id",), ("-game_date",)),
    "logs_of_player_and_season": Read("gamelogs", ("player_id", "season"), ("-game_date",)),
    "logs_of_team": Read("gamelogs", ("team_id",), ("-game_id",)),
    "logs_of_game": Read("gamelogs", ("game_id",)),
    "log": Read("gamelogs", ("player_id", "game_id"), (), "first"),
    "last_logs": Read("gamelogs", ("player_id",), ("-game_date",), "limit"),
    "best_log": Read("gamelogs", ("player_id",), ("-points",), "first"),
    "has_logs": Read("gamelogs", ("player_id", "season"), (), "count"),
    "schedule_entry": Read("game_schedule", ("game_id", "team_id"), (), "first"),
    "schedule_of_team": Read("game_schedule", ("team_id", "season"), ("-game_date",)),
    "schedule_of_date": Read("game_schedule", ("game_date",), ("game_date", "game_id")),
    "last_games": Read("game_schedule", ("team_id", "!result", "<game_date"), ("-game_date",), "limit"),
    "next_games": Read("game_schedule", ("team_id", ">=game_date"), ("game_date",), "limit"),
    "dashboard_of_player": Read("player_dashboards", ("player_id", "season"), (), "first"),
    "dashboards_of_season": Read("player_dashboards", ("season",), ("-pts",)),
    "dashboards_of_team": Read("player_dashboards", ("team_id", "season"), ("-pts",)),
    "top_scorers": Read("player_dashboards", ("season",), ("-pts",), "limit"),
    "dashboards_by_name": Read("player_dashboards", ("~player_name", "season"), ("-pts",)),
    "team_dashboard": Read("team_dashboards", ("team_id", "season", "season_type"), (), "first"),
    "team_dashboards": Read("team_dashboards", ("season", "season_type"), ("base_totals_w_pct_rank",)),
    "consistency_of_player": Read("consistency", ("player_id", "season", "window_size"), ("stat",)),
    "most_volatile": Read("consistency", ("season", "stat", "window_size", ">=games_played"), ("-cv",), "limit"),
    "most_steady": Read("consistency", ("season", "stat", "window_size", ">=games_played"), ("cv",), "limit"),
    "status_of_game": Read("player_game_status", ("game_id",), ("team_id", "player_name")),
    "injuries_of_date": Read("player_game_status", ("game_date", "not_playing_reason"), ("team_id", "player_name")),
    "injuries_of_player": Read("player_game_status", ("player_id", "not_playing_reason", "season"), ("-game_date",)),
    "status_of_season": Read("player_game_status", ("season",)),
    "heat_of_player": Read("heat_index", ("player_id", "season"), ("stat", "window_size")),
    "hot_players": Read("heat_index", ("season", "stat", "window_size", "status"), ("-z_score",), "limit"),
    "cold_players": Read("heat_index", ("season", "stat", "window_size", "status"), ("z_score",), "limit"),
    "player": Read("players", ("player_id",), (), "first"),
    "player_by_name": Read("players", ("~name",), (), "first"),
    "players_all": Read("players", (), ("name",)),
    "players_of_season": Read("players", ("!available_seasons", "@available_seasons"), ("name",)),
    "players_of_position": Read("players", ("position",), ("name",)),
    "has_player": Read("players", ("player_id",), (), "count"),
    "window": Read("stat_windows", ("id",), (), "first"),
    "windows_of_player": Read("stat_windows", ("player_id", "season", "stat", "window_size"), ("-window_size", "-games_hit")),
    "windows_of_size": Read("stat_windows", ("season", "window_size", "stat")),
    "older_streak": Read("player_streaks", ("id",), (), "first"),
    "older_streaks_of_season": Read("player_streaks", ("season",), ("-streak_games",)),
    "older_streaks_of_player": Read("player_streaks", ("player_id", "season"), ("-streak_games",)),
    "hot_streaks": Read("player_streaks", ("season", ">=streak_games"), ("-streak_games",), "limit"),
    "streaks_by_stat": Read("player_streaks", ("season", ">=streak_games"), ("stat", "-streak_games")),
    "z_scores_of_player": Read("player_z_scores", ("player_id",), (), "first"),
    "z_scores": Read("player_z_scores", (), (), "limit"),
    "statistic": Read("statistics", ("stat_id",), (), "first"),
    "statistics_of_player": Read("statistics", ("player_id",), ("-season_year",)),
    "statistic_of_season": Read("statistics", ("player_id", "season_year"), (), "first"),
    "statistics_of_season": Read("statistics", ("season_year",)),
    "has_statistics": Read("statistics", ("player_id",), (), "count"),
    "players_with_statistics": Read("statistics", ("season_year",), ("player_id",)),
    "flags_of_team": Read("team_flags", ("team_id", "stat_date")),
    "flags_of_type": Read("team_flags", ("season", "flag_type"), ("-severity",), "limit"),
    "metrics_of_team": Read("team_metrics", ("team_id", "stat_date", "window_size"), (), "first"),
    "metrics_of_season": Read("team_metrics", ("season", "window_size"), ("-stat_date", "team_name")),
    "box_score": Read("team_game_stats", ("game_id", "team_id"), (), "first"),
    "box_scores_of_team": Read("team_game_stats", ("team_id", "season"), ("-game_date",)),
    "box_scores_of_season": Read("team_game_stats", ("season",), ("-game_date",)),
    "box_scores_of_date": Read("team_game_stats", ("game_date",)),
    "meetings": Read("team_game_stats", ("team_id", "opponent_team_id"), ("-game_date",)),
    "factors": Read("schedule_factors", ("game_id", "team_id"), (), "first"),
    "factors_of_team": Read("schedule_factors", ("team_id", "season"), ("-game_date",)),
    "factors_of_date": Read("schedule_factors", ("game_date",), ("team_id",)),
    "back_to_backs": Read("schedule_factors", ("season", "is_b2b", ">=game_date", "<=game_date"), ("-game_date",)),
    "rest_advantages": Read("schedule_factors", ("season", "rest_edge", ">=game_date", "<=game_date"), ("-rest_diff",)),
    "team": Read("teams", ("team_id",), (), "first"),
    "team_by_abbreviation": Read("teams", ("abbreviation",), (), "first"),
    "teams_all": Read("teams", (), ("name",)),
    "teams_listed": Read("teams", ("team_id",)),
    "roster_of_team": Read("roster", ("team_id", "season")),
    "rosters_of_player": Read("roster", ("player_id",), ("-season",)),
    "team_of_player": Read("roster", ("player_id",), ("-season",), "first"),
}
_CONDITIONS = {
    ">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v, "<": lambda c, v: c < v, "~": lambda c, v: F.contains(F.lower(c), F.lower(v)), "@": lambda c, v: F.array_contains(c, v),
}


def named(name: str, rows: DataFrame, /, *, limit: int | None = None, **args) -> DataFrame:
    """The rows of a named read of its table; of an argument with two bounds the value is a pair. What isn't given isn't
    asked for; an argument that the read doesn't have is an error. Ties are broken by the other columns, so that reads
    that take some rows take the same ones each time; a count gives one row with `rows`."""
    read, known, conditions = READS[name], set(), []
    for term in read.asked:
        op = next((o for o in (">=", "<=", "<", "~", "@", "!") if term.startswith(o)), "")
        column = term[len(op) :]
        if op == "!":
            conditions.append(F.col(column).isNotNull())
            continue
        known.add(column)
        value = args.get(column)
        if value is None:
            continue
        if sum(t.lstrip("<>=") == column for t in read.asked) == 2:
            value = value[0] if op == ">=" else value[1]
        if op:
            conditions.append(_CONDITIONS[op](F.col(column), F.lit(value)))
        else:
            conditions.append(F.col(column).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(column) == F.lit(value))
    if unknown := set(args) - known:
        raise ValueError(f"{name} does not ask for {sorted(unknown)}")
    found = rows.where(ratings.all_of(conditions))
    if read.take == "count":
        return found.agg(F.count("*").alias("rows"))
    named_order = [c.removeprefix("-") for c in read.order]
    order = [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in read.order]
    rest = [F.asc(f.name) for f in rows.schema.fields if f.name not in named_order and f.dataType.typeName() not in ("map", "variant")]
    if read.take == "all":
        return found.orderBy(*order) if order else found
    return found.orderBy(*order, *rest).limit(1 if read.take == "first" else limit or 10)
