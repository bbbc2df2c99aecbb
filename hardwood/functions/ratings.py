"""Ratings, bands and display columns over box scores, odds and schedules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Thresholds of the streak grid by stat, and of the flags on season-versus-recent deltas; fixed values.
STREAK_GRID = {
    "PTS": (10, 15, 20, 25, 30), "REB": (4, 6, 8, 10, 12), "AST": (2, 4, 6, 8, 10), "STL": (1, 2, 3, 4), "BLK": (1, 2, 3, 4),
    "PRA": (20, 25, 30, 35, 40),
}
FLAG_RULES = (
    ("offense_rising", "off_rtg", 5.0, 1), ("offense_falling", "off_rtg", -5.0, -1), ("defense_improving", "def_rtg", -4.0, -1),
    ("defense_declining", "def_rtg", 5.0, 1), ("pace_up", "pace", 4.0, 1), ("pace_down", "pace", -4.0, -1),
    ("shooting_hot", "efg", 0.03, 1), ("shooting_cold", "efg", -0.03, -1), ("turnover_prone", "tov_pct", 0.02, 1),
    ("ball_secure", "tov_pct", -0.03, -1), ("three_point_heavy", "pct_pts_3pt", 0.05, 1),
)
#: Further rules of the older flags, on box scores that split the points; fixed values.
OLDER_FLAG_RULES = (("paint_attack", "pct_pts_paint", 0.03, 1), ("transition_heavy", "pct_pts_fb", 0.03, 1))
#: Display names of the reasons for not playing; fixed values.
REASONS = {
    "INACTIVE_INJURY": "Injured", "INACTIVE_GLEAGUE_TWOWAY": "G-League", "INACTIVE_REST": "Rest",
    "INACTIVE_PERSONAL": "Personal", "INACTIVE_SUSPENSION": "Suspended",
}
#: Thresholds from which a season best counts without an average to hold it against; fixed values.
LEAST_BEST = {"PTS": 20, "REB": 8, "AST": 5, "STL": 2, "BLK": 2, "FG3M": 3, "PRA": 25}


def possessions(fga: Column, fta: Column, oreb: Column, tov: Column) -> Column:
    """In hundredths: whole numbers, so that the order of the rows can't change a sum."""
    return fga * 100 + fta * 44 - oreb * 100 + tov * 100


def safe_ratio(n: Column, d: Column) -> Column:
    """Null unless the denominator is positive."""
    return F.when(d > 0, n / d)


def as_fraction(pct: Column) -> Column:
    """0..1 stays, up to 100 is a percentage, more is no percentage; negatives stay."""
    return F.when(pct > 100, F.lit(None)).when(pct > 1, pct / 100).otherwise(pct)


def pace_projection(a: Column, b: Column) -> Column:
    return F.lit(0.7) * (a + b) / 2 + F.lit(0.3) * F.greatest(a, b)


def scoring_env_index(h_off: Column, h_def: Column, a_off: Column, a_def: Column, pace: Column) -> Column:
    return ((h_off + a_def) / 2 + (a_off + h_def) / 2) / 2 * pace / 99 / 115 * 100


def three_env_index(h: Column, a: Column) -> Column:
    return (h + a) / 2 / 0.35 * 100


def chaos_index(pace: Column, h_tov: Column, a_tov: Column, older: bool = False) -> Column:
    """older: without the turnovers of both sides their half is neutral, 50."""
    turnovers = (h_tov + a_tov) / 2 / 0.14 * 50
    return pace / 99 * 50 + (F.coalesce(turnovers, F.lit(50.0)) if older else turnovers)


def environment_tags(pace: Column, scoring: Column, three: Column, chaos: Column, paint: Column | None = None, orb: Column | None = None, ftr: Column | None = None) -> Column:
    """Names of the bounds that a matchup passes, as an array in this order; paint, orb and ftr, the means of both sides,
    add the tags of the older environments."""
    rules = [("fast_pace", pace > 105), ("slow_pace", pace < 94), ("high_scoring", scoring > 108), ("defensive_battle", scoring < 92), ("three_point_fest", three > 110)]
    rules += [(n, c > bound) for n, c, bound in (("paint_battle", paint, 0.40), ("glass_war", orb, 0.28), ("whistle_heavy", ftr, 0.30)) if c is not None]
    return F.array_compact(F.array(*(F.when(c, n) for n, c in [*rules, ("chaotic", chaos > 115)])))


def environment_label(pace: Column, scoring: Column) -> tuple[Column, Column]:
    return (
        F.when(pace > 102, "fast").when(pace < 96, "slow").when(pace.isNotNull(), "average"),
        F.when(scoring > 105, "high").when(scoring < 95, "low").when(scoring.isNotNull(), "average"),
    )


def heat_status(z: Column) -> Column:
    return F.when(z >= 1, "on_fire").when(z <= -1, "ice_cold").when(z.isNotNull(), "normal")


def heat_tier(z: Column) -> Column:
    return F.when(z >= 1, "on_fire").when(z >= 0.65, "heating_up").when(z >= -0.64, "average").when(z >= -1, "cooling_off").when(z.isNotNull(), "ice_cold")


def consistency_tier(cv: Column) -> Column:
    return F.when(cv < 0.35, "steady").when(cv > 0.55, "volatile").when(cv.isNotNull(), "average")


def rest_edge(diff: Column) -> Column:
    return F.when(diff >= 2, "advantage").when(diff <= -2, "disadvantage").when(diff.isNotNull(), "even")


#: How a schedule is described, from the densest kind to the rest in days.
SCHEDULE_TEXTS = {
    "b2b": "Back-to-Back", "3in4": "3-in-4 nights (%d days rest)", "4in5": "4-in-5 nights (%d days rest)", "5in7": "5-in-7 nights (%d days rest)",
    "well": "Well rested (%d days rest)", "normal": "Normal rest (%d days rest)", "short": "Short rest (%d day rest)", "other": "%d days rest", "unknown": "Unknown",
}


def schedule_text(b2b: Column, three4: Column, four5: Column, five7: Column, rest: Column) -> Column:
    t = lambda k: F.format_string(SCHEDULE_TEXTS[k], rest)
    return (
        F.when(b2b, SCHEDULE_TEXTS["b2b"]).when(three4, t("3in4")).when(four5, t("4in5")).when(five7, t("5in7"))
        .when(rest >= 3, t("well")).when(rest == 2, t("normal")).when(rest == 1, t("short")).when(rest.isNotNull(), t("other")).otherwise(SCHEDULE_TEXTS["unknown"])
    )


def american_odds(decimal: Column) -> Column:
    """Whole American odds of decimal ones, cut towards zero; null at 1 or below."""
    plus, minus = (decimal - 1) * 100, F.lit(-100) / (decimal - 1)
    return F.when(decimal >= 2, plus.cast("int")).when(decimal > 1, minus.cast("int"))


def signed(n: Column) -> Column:
    return F.when(n > 0, F.concat(F.lit("+"), n.cast("string"))).otherwise(n.cast("string"))


def spread_text(spread: Column) -> Column:
    return F.when(spread == 0, "PK").when(spread.isNotNull(), F.format_string("%+.1f", spread))


def score_side(score: Column, home: Column, own: bool) -> Column:
    """Points of a side in "home-away"; null for malformed scores."""
    parts = F.split(F.regexp_replace(score, r"\s", ""), "-")
    at = F.when(home, F.lit(1 if own else 2)).otherwise(F.lit(2 if own else 1))
    return F.when(F.size(parts) == 2, F.element_at(parts, at).try_cast("int"))


def score_missing(score: Column) -> Column:
    """Null and the three texts that mean "not known", which are fixed values."""
    return F.coalesce(score, F.lit("")).isin("", "-", "0-0")


def minutes(text: Column) -> Column:
    """Minutes of "MM:SS" or a decimal, one digit."""
    parts = F.split(text, ":")
    clock = F.element_at(parts, 1).try_cast("double") + F.get(parts, F.lit(1)).try_cast("double") / 60
    return F.round(F.when(text.contains(":"), clock).otherwise(text.try_cast("double")), 1)


def int_or_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit("")).try_cast("int")


def win_pct_text(w: Column, n: Column) -> Column:
    """".667" style, "1.000" for all won."""
    return F.regexp_replace(F.format_string("%.3f", safe_ratio(w, n)), "^0", "")


def reason_text(reason: Column, description: Column, status: Column, played: Column) -> Column:
    """What is shown for a player and game: played, the description, the reason's name, or what the status says."""
    pairs = [F.lit(x) for kv in REASONS.items() for x in kv]
    named = F.coalesce(F.element_at(F.create_map(*pairs), reason), reason)
    return F.when(played, "Played").otherwise(F.coalesce(F.nullif(description, F.lit("")), F.nullif(named, F.lit("")), F.when(status == "INACTIVE", "Inactive").otherwise("Did Not Play")))


def is_injured(reason: Column) -> Column:
    return F.coalesce(reason == "INACTIVE_INJURY", F.lit(False))


def is_gleague(reason: Column) -> Column:
    return F.coalesce(reason == "INACTIVE_GLEAGUE_TWOWAY", F.lit(False))


def whole_scores(text: Column) -> Column:
    """"Team 101.0 - 99.0 Team" without the decimals of whole scores; other texts stay."""
    fits = text.rlike(r"\D+\s\d+\.?\d*\s-\s\d+\.?\d*\s\D+")
    return F.when(fits, F.regexp_replace(F.regexp_replace(text, r"(\s\d+)\.0*(?=\s-\s)", "$1"), r"(\s-\s\d+)\.0*(?=\s)", "$1")).otherwise(text)


def game_status(result: Column, game_date: Column, today: Column) -> Column:
    return F.when(result.isNotNull(), "Final").when(game_date == today, "Today").otherwise("Scheduled")


#: Marks of a hit rate from 80, 60 and 40 percent on and below, and of a rising, falling and level metric.
HIT_MARKS = ("🔥", "✓", "○", "✗")
TREND_MARKS = {"up": "📈", "down": "📉", "level": "➖"}
#: What a change in net rating means if the schedule has changed too, by (better, harder).
SOS_NOTES = {
    (True, False): "⚠️ Improved vs easier schedule - may regress", (True, True): "✅ Improved vs harder schedule - legitimate surge",
    (False, True): "📊 Decline vs harder schedule - may not be as bad", (False, False): "🚨 Decline vs easier schedule - concerning",
}


def hit_mark(hits: Column, games: Column) -> Column:
    """The mark of a hit rate; without games it counts as 0."""
    rate = F.coalesce(safe_ratio(hits, games), F.lit(0.0))
    return F.when(rate >= 0.8, HIT_MARKS[0]).when(rate >= 0.6, HIT_MARKS[1]).when(rate >= 0.4, HIT_MARKS[2]).otherwise(HIT_MARKS[3])


def trend(delta: Column, threshold: float, lower_is_better: bool = False) -> Column:
    """The mark of a change of more than the threshold, for the better or the worse."""
    d = -delta if lower_is_better else delta
    return F.when(d > threshold, TREND_MARKS["up"]).when(d < -threshold, TREND_MARKS["down"]).when(d.isNotNull(), TREND_MARKS["level"])


def sos_note(net_delta: Column, sos_net_delta: Column) -> Column:
    """What a change in rating of more than 3 means against a schedule that has changed by more than 2."""
    better, worse, harder, easier = net_delta > 3, net_delta < -3, sos_net_delta > 2, sos_net_delta < -2
    return F.when(better & easier, SOS_NOTES[True, False]).when(better & harder, SOS_NOTES[True, True]).when(worse & harder, SOS_NOTES[False, True]).when(worse & easier, SOS_NOTES[False, False])


def weighted_score(values: list[Column], weights: list[float]) -> Column:
    """Weighted mean by absolute weight over the values that are there."""
    num = reduce(lambda a, b: a + b, (F.coalesce(v * w, F.lit(0.0)) for v, w in zip(values, weights, strict=True)))
    den = reduce(lambda a, b: a + b, (F.when(v.isNotNull(), F.lit(abs(w))).otherwise(0.0) for v, w in zip(values, weights, strict=True)))
    return safe_ratio(num, den)


def any_of(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, predicates)


def all_of(predicates: list[Column | None]) -> Column:
    """The conjunction of those that are given; true for none."""
    return reduce(lambda a, b: a & b, (p for p in predicates if p is not None), F.lit(True))
