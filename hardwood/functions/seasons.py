"""Season, calendar and identifier columns. A season is named "1998-99" and starts in October."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EASTERN = "America/New_York"
FIRST_SEASON, LAST_SEASON = 1946, 9998
#: Spellings of the season types; a fixed value.
SEASON_TYPES = {
    "pre season": "Pre Season", "preseason": "Pre Season", "regular": "Regular Season", "regular season": "Regular Season",
    "all star": "All-Star", "all-star": "All-Star", "playoffs": "Playoffs", "postseason": "Playoffs",
}
TYPE_BY_PREFIX = {"1": "Pre Season", "2": "Regular Season", "3": "All-Star", "4": "Playoffs"}


def season_name(year: Column) -> Column:
    return F.format_string("%04d-%02d", year, (year + 1) % 100)


def season_of(date: Column) -> Column:
    """The season a date belongs to."""
    return season_name(F.year(date) - (F.month(date) < 10).cast("int"))


def season_start(season: Column) -> Column:
    """First year of a well-formed season, else null."""
    year = F.substring(season, 1, 4).try_cast("int")
    fits = season.rlike(r"^\d{4}-\d{2}$") & (F.substring(season, 6, 2) == F.format_string("%02d", (year + 1) % 100))
    return F.when(fits & year.between(FIRST_SEASON, LAST_SEASON), year)


def is_season(season: Column) -> Column:
    return F.coalesce(season_start(season).isNotNull(), F.lit(False))


def neighbour(season: Column, by: int) -> Column:
    return season_name(season_start(season) + F.lit(by))


def active_season(today: Column, latest_known: Column, scheduled: Column) -> Column:
    """July to September stay on the latest known season until the next is scheduled; else the calendar decides."""
    upcoming = season_name(F.year(today))
    summer = F.month(today).between(7, 9)
    return F.when(summer & scheduled, upcoming).when(summer & latest_known.isNotNull(), latest_known).otherwise(season_of(today))


def canonical_season(text: Column) -> Column:
    """"1998" becomes "1998-99"; well-formed seasons stay, anything else is null."""
    return F.when(text.rlike(r"^\d{4}$"), season_name(text.cast("int"))).when(is_season(text), text)


def season_type(text: Column) -> Column:
    """The canonical spelling, null for unknown ones."""
    pairs = [F.lit(x) for kv in SEASON_TYPES.items() for x in kv]
    return F.element_at(F.create_map(*pairs), F.lower(F.trim(F.regexp_replace(text, "_", " "))))


def season_type_of_game(game_id: Column) -> Column:
    pairs = [F.lit(x) for kv in TYPE_BY_PREFIX.items() for x in kv]
    return F.element_at(F.create_map(*pairs), F.substring(F.ltrim(game_id, F.lit("0")), 1, 1))


def game_id(text: Column) -> Column:
    """Ten digits with leading zeros; null for anything but up to ten digits."""
    t = F.trim(text.cast("string"))
    return F.when(t.rlike(r"^[0-9]{1,10}$"), F.lpad(t, 10, "0"))


def eastern_date(utc: Column) -> Column:
    """Calendar date in the east of a naive UTC time."""
    return F.to_date(F.from_utc_timestamp(utc.cast("timestamp"), EASTERN))


def slate_cutoff(date: Column) -> Column:
    """Ten in the morning, eastern time, of a date, in UTC."""
    return F.to_utc_timestamp(F.to_timestamp(date) + F.expr("INTERVAL 10 HOURS"), EASTERN)


def available_at(game_time: Column) -> Column:
    """When the source of a game can be known: six hours after it starts."""
    return game_time + F.expr("INTERVAL 6 HOURS")


def day_label(ts: Column) -> Column:
    return F.date_format(ts, "EEE MM/dd")


def clock_label(ts: Column) -> Column:
    return F.date_format(ts, "hh:mm a")


def season_array(text: Column) -> Column:
    """The well-formed seasons of a list joined by commas, each once, in order."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.regexp_replace(text, r"\s", ""), ","), is_season)))


def joined(array: Column) -> Column:
    return F.array_join(array, ",")
