"""Text reports of fixed width: a line a row, lines in sections, one text a key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hardwood.functions import ratings

#: Marks and words of heat tiers and consistency tiers.
HEAT_WORDS = {"on_fire": "🔥 ON FIRE", "heating_up": "📈 HEATING UP", "average": "➖ AVERAGE", "cooling_off": "📉 COOLING OFF", "ice_cold": "🧊 ICE COLD"}
TIER_WORDS = {"steady": "🎯 STEADY", "average": "➖ AVERAGE", "volatile": "🎰 VOLATILE"}


def _word(c: Column, words: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in words.items() for x in kv]), c)


def _fixed(c: Column | str, digits: int) -> Column:
    """A number with so many digits, rounded half up, as text."""
    return F.format_string(f"%.{digits}f", F.round(c, digits))


def streak_line() -> Column:
    """Of player_name, stat, threshold, streak_games, start_time, end_time, kind, is_active."""
    day = lambda c: F.date_format(c, "MM/dd")
    kind = F.when(F.col("kind") == "current", "Current").otherwise("Season Best")
    active = F.when(F.col("is_active"), "🔥 ACTIVE").otherwise("✓ Complete")
    return F.format_string("%-25s | %4s | >=%3s | %3d games | %s - %s | %12s | %s", "player_name", "stat", _fixed("threshold", 0), "streak_games", day("start_time"), day("end_time"), kind, active)


def window_line() -> Column:
    """Of player_name, stat, threshold, games_hit, games_played, window_size, last_game_date."""
    rate = F.concat(_fixed(F.coalesce(ratings.safe_ratio(F.col("games_hit"), F.col("games_played")), F.lit(0.0)) * 100, 1), F.lit("%"))
    mark = ratings.hit_mark(F.col("games_hit"), F.col("games_played"))
    return F.format_string("%-25s | %4s | >=%3s | %2d/%2d | %2dg | %6s | %s | %s", "player_name", "stat", _fixed("threshold", 0), "games_hit", "games_played", "window_size", rate, F.date_format("last_game_date", "MM/dd/yyyy"), mark)


def heat_line() -> Column:
    """Of player_name, stat, window_size, z_score, recent_avg, season_avg."""
    return F.format_string(
        "%-25s | %4s | %2dg | Z: %6s | Recent: %6s | Season: %6s | %s", "player_name", "stat", "window_size", _fixed("z_score", 2), _fixed("recent_avg", 2), _fixed("season_avg", 2), _word(ratings.heat_tier(F.col("z_score")), HEAT_WORDS)
    )


def consistency_line() -> Column:
    """Of stat, mean, sd, cv, min_value, max_value, tier."""
    return F.format_string("%4s | Avg: %6s | StdDev: %5s | CV: %5s | Range: %s-%s | %s", F.upper("stat"), _fixed("mean", 1), _fixed("sd", 1), _fixed("cv", 2), _fixed("min_value", 0), _fixed("max_value", 0), _word(F.col("tier"), TIER_WORDS))


def section(number: int, rows: DataFrame, key: str, line: Column, order: list[Column], title: str | None = None) -> DataFrame:
    """key, _section, _place and _line of a section: its title with the number of its lines, where a title has %d, and its
    lines in order. A key without rows has no section."""
    w = Window.partitionBy(key)
    lines = rows.select(key, F.lit(number).alias("_section"), F.row_number().over(w.orderBy(*order)).alias("_place"), line.alias("_line"))
    if title is None:
        return lines
    head = lines.groupBy(key).agg(F.count("*").alias("n")).select(key, F.lit(number).alias("_section"), F.lit(0).alias("_place"), F.format_string(title, "n").alias("_line"))
    return head.unionByName(lines)


def report(sections: list[DataFrame], key: str) -> DataFrame:
    """key and report: the sections of a key one after the other, as one text. A key's text is meant to be read, so it has
    some hundred lines; sections of many rows are cut to their first before they come here."""
    rows = reduce(DataFrame.unionByName, sections)
    g = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_section", "_place", "_line"))).alias("_l"))
    return g.select(key, F.array_join(F.transform("_l", lambda x: x["_line"]), "\n").alias("report"))
