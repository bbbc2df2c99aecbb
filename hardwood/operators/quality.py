"""Profiles and checks of stored tables, each one aggregation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hardwood.functions import ratings


def null_rates(df: DataFrame) -> DataFrame:
    """(column, nulls, total, rate): one pass over all columns."""
    one = df.agg(F.count("*").alias("_n"), *(F.count(c).alias(c) for c in df.columns))
    rows = one.select("_n", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), (F.col("_n") - F.col(c)).alias("nulls")) for c in df.columns))).alias("r"))
    rate = F.when(F.col("_n") > 0, F.round(F.col("r.nulls") / F.col("_n"), 4))
    return rows.select("r.column", "r.nulls", F.col("_n").alias("total"), rate.alias("rate"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: groups of a key with several rows, and the rows beyond the first."""
    g = df.groupBy(*keys).count().where("count > 1")
    return g.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("extra_rows"))


def orphans(child: DataFrame, parent: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Child rows whose key, complete, isn't in parent."""
    named = child.dropna(subset=list(keys))
    p = parent.select(*(F.col(v).alias(f"_{k}") for k, v in keys.items())).distinct()
    return named.join(p, reduce(lambda a, b: a & b, (F.col(k) == F.col(f"_{k}") for k in keys)), "left_anti")


def not_in(rows: DataFrame, key: str, others: DataFrame, other: str) -> DataFrame:
    """Rows whose key is in none of the others, as SQL's NOT IN has it: nothing if one of the others is null, and no row
    whose key is null unless there are no others at all.

    Nulls are counted first, so the rest is a plain anti-join, dealt by key; NOT IN itself sends the others to every task."""
    n, known = others.agg(F.count("*"), F.count(other)).first()
    if n == 0:
        return rows
    if known < n:
        return rows.where(F.lit(False))
    o = others.select(F.col(other).alias("_other")).distinct()
    return rows.where(F.col(key).isNotNull()).join(o, F.col(key) == F.col("_other"), "left_anti")


def exact_medians(rows: DataFrame, keys: list[str], value: str, ranges: int = 256) -> DataFrame:
    """keys, median and n: the exact median of each key's values that aren't null, also where one key has most of the rows.

    Equal values are counted before they are dealt. Counts by range of values, between the key's least and largest, tell
    in which ranges the middle ranks lie; only the distinct values of these one or two ranges are put in order."""
    v = F.col(value).cast("double")
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, v.alias("_v")).agg(F.count("*").alias("_c"))
    bounds = counts.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_c").alias("n"))
    at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(ranges - 1), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * ranges))).otherwise(0).cast("int")
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    placed = counts.alias("c").join(bounds.alias("b"), reduce(lambda x, y: x & y, same, F.lit(True))).select(*(F.col(f"c.{k}").alias(k) for k in keys), "_v", "_c", "n", at.alias("_range"))
    sums = placed.groupBy(*keys, "_range", "n").agg(F.sum("_c").alias("_in"))
    up = Window.partitionBy(*keys).orderBy("_range")
    sums = sums.withColumn("_before", F.sum("_in").over(up.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_in"))
    middle = F.array_distinct(F.array(F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1))
    wanted = sums.withColumn("_ranks", F.filter(middle, lambda r: (r > F.col("_before")) & (r <= F.col("_before") + F.col("_in")))).where(F.size("_ranks") > 0)
    held = placed.drop("n").alias("p").join(wanted.alias("w"), reduce(lambda x, y: x & y, [F.col(f"p.{k}").eqNullSafe(F.col(f"w.{k}")) for k in [*keys, "_range"]]))
    held = held.select(*(F.col(f"p.{k}").alias(k) for k in keys), "p._v", "p._c", "p._range", "w.n", "w._before", "w._ranks")
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    found = held.withColumn("_upto", upto).withColumn("_hits", F.size(F.filter("_ranks", lambda r: (r <= F.col("_upto")) & (r > F.col("_upto") - F.col("_c"))))).where("_hits > 0")
    return found.groupBy(*keys, "n").agg((F.sum(F.col("_v") * F.col("_hits")) / F.sum("_hits")).alias("median"))


def distinct_sketches(rows: DataFrame, keys: list[str], value: str, bits: int = 12) -> DataFrame:
    """keys and sketch: a mergeable sketch of the distinct values of each key. With 2**bits registers an estimate is off
    by about 0.8 / sqrt(2**bits), 1.3 % with 12 bits."""
    return rows.groupBy(*keys).agg(F.hll_sketch_agg(value, bits).alias("sketch"))


def merged_distinct(sketches: DataFrame, keys: list) -> DataFrame:
    """keys and distinct: the estimate over all sketches of a key, without another look at the rows."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))


def two_row_check(rows: DataFrame) -> DataFrame:
    """One row: games with one row, with two and with more."""
    n = rows.groupBy("game_id").count()
    return n.agg(F.count_if(F.col("count") == 1).alias("single"), F.count_if(F.col("count") == 2).alias("paired"), F.count_if(F.col("count") > 2).alias("overfull"), F.count("*").alias("games"))


def pair_integrity(rows: DataFrame) -> DataFrame:
    """Games that aren't one W and one L."""
    g = rows.groupBy("game_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("result")), ",").alias("results"))
    return g.where((F.col("n") < 2) | (F.col("results") != "L,W"))


def coverage(wanted: DataFrame, present: DataFrame, key: str, least: float) -> DataFrame:
    """One row: how many of the wanted keys are present, the share, and whether it is enough."""
    p = present.select(key).distinct().withColumn("_p", F.lit(1))
    one = wanted.select(key).distinct().join(p, key, "left").agg(F.count("*").alias("total"), F.count("_p").alias("covered"))
    rate = F.when(F.col("total") > 0, F.round(F.col("covered") / F.col("total"), 4))
    return one.withColumn("rate", rate).withColumn("ok", F.coalesce(F.col("rate") >= least, F.lit(False)))


def key_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys in only one of both."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    j = x.join(y, key, "full").where("_a is null or _b is null")
    return j.select(key, F.when(F.col("_a").isNull(), "missing_left").otherwise("missing_right").alias("side"))


def out_of_range(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    return df.where(reduce(lambda a, b: a | b, ((F.col(c) < lo) | (F.col(c) > hi) for c, (lo, hi) in bounds.items())))


def check(name: str, ok: Column, detail: Column, critical: bool, df: DataFrame) -> DataFrame:
    """One row from a one-row frame: the outcome of a named check."""
    return df.select(F.lit(name).alias("name"), F.coalesce(ok, F.lit(False)).alias("ok"), F.lit(critical).alias("critical"), detail.cast("string").alias("detail"))


def suite(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def suite_ok(checks: DataFrame) -> DataFrame:
    """One row: whether every critical check passed, and the counts."""
    return checks.agg(F.bool_and(F.col("ok") | ~F.col("critical")).alias("ok"), F.count_if(~F.col("ok") & F.col("critical")).alias("failed"), F.count_if(~F.col("ok") & ~F.col("critical")).alias("warnings"))


#: Why a game isn't reconciled, in the order of the checks; two end with the number of rows.
REASONS = {
    "schedule_rows": "expected 2 schedule rows; found ", "schedule_pair": "schedule team pair is not reciprocal", "schedule_sides": "schedule must contain one H and one A row",
    "schedule_keys": "schedule rows disagree on season or date", "schedule_results": "existing schedule results are not a W/L pair", "mixed_results": "schedule has a mixed null/non-null result pair",
    "fact_rows": "expected 2 team-game rows; found ", "fact_pair": "team-game pair is not reciprocal", "teams": "schedule and team-game team IDs differ", "seasons": "schedule and team-game seasons differ",
    "dates": "schedule and team-game dates differ", "fact_results": "team-game rows are not a W/L pair", "points": "team-game score is missing", "winner": "W/L disagrees with team-game points",
    "score": "existing schedule score disagrees with team-game points",
}


def reconcile(schedule: DataFrame, facts: DataFrame) -> DataFrame:
    """One row a scheduled game: issue (the first rule it breaks, null if none), action and final_score.

    schedule: game_id, season, team_id, opponent_team_id, slate_date, home_or_away, result, score. facts: game_id, season,
    team_id, opponent_team_id, game_date, result, points. action: complete (has a W and an L already, facts aren't
    looked at), issue, or update (both rows get their result and the score "home-away")."""
    def side(df, names):
        return df.groupBy("game_id").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("r"))

    s = side(schedule, ["team_id", "opponent_team_id", "home_or_away", "season", "slate_date", "result", "score"]).withColumnRenamed("r", "s")
    f = side(facts, ["team_id", "opponent_team_id", "season", "game_date", "result", "points"]).withColumnRenamed("r", "f")
    j = s.join(f, "game_id", "left")

    def one(rows, i, c):
        return F.get(F.col(f"{rows}.{c}"), F.lit(i))

    def values(rows, c):
        """Sorted distinct values, nulls included."""
        return F.array_sort(F.array_distinct(F.col(f"{rows}.{c}")))

    def reciprocal(rows):
        return one(rows, 0, "team_id").eqNullSafe(one(rows, 1, "opponent_team_id")) & one(rows, 1, "team_id").eqNullSafe(one(rows, 0, "opponent_team_id"))

    def is_pair(rows, c, a, b):
        return F.coalesce(values(rows, c) == F.array(F.lit(a), F.lit(b)), F.lit(False))

    def of(team, c):
        return F.get(F.filter("f", lambda r: r["team_id"] == team), F.lit(0))[c]

    def with_value(rows, c, value, want):
        return F.get(F.filter(rows, lambda r: r[c] == value), F.lit(0))[want]

    n_results = F.size(F.filter("s.result", lambda x: x.isNotNull()))
    score = F.concat_ws("-", *(of(with_value("s", "home_or_away", side_, "team_id"), "points").cast("string") for side_ in ("H", "A")))
    j = j.withColumn("_score", score)
    conflict = F.exists("s.score", lambda x: ~ratings.score_missing(x) & (x != F.col("_score")))
    count = lambda rows: F.coalesce(F.size(rows), F.lit(0)).cast("string")
    rules = [
        (F.concat(F.lit(REASONS["schedule_rows"]), count("s")), F.size("s") != 2), ("schedule_pair", ~reciprocal("s")), ("schedule_sides", ~is_pair("s", "home_or_away", "A", "H")),
        ("schedule_keys", (F.size(values("s", "season")) != 1) | (F.size(values("s", "slate_date")) != 1)),
        (None, (n_results == 2) & is_pair("s", "result", "L", "W")), ("schedule_results", n_results == 2), ("mixed_results", n_results == 1),
        (F.concat(F.lit(REASONS["fact_rows"]), count("f")), F.coalesce(F.size("f"), F.lit(0)) != 2), ("fact_pair", ~reciprocal("f")), ("teams", values("s", "team_id") != values("f", "team_id")),
        ("seasons", (F.size(values("f", "season")) != 1) | ~one("s", 0, "season").eqNullSafe(one("f", 0, "season"))),
        ("dates", (F.size(values("f", "game_date")) != 1) | ~one("s", 0, "slate_date").eqNullSafe(one("f", 0, "game_date"))),
        ("fact_results", ~is_pair("f", "result", "L", "W")), ("points", F.exists("f.points", lambda x: x.isNull())),
        ("winner", with_value("f", "result", "W", "points") <= with_value("f", "result", "L", "points")), ("score", conflict),
    ]
    rules = [(F.lit(REASONS.get(name, "complete")) if name is None or isinstance(name, str) else name, holds) for name, holds in rules]
    # The first rule that holds decides; null: complete already.
    found = reduce(lambda acc, r: acc.when(r[1], r[0]), rules[1:], F.when(rules[0][1], rules[0][0]))
    j = j.withColumn("_found", found)
    action = F.when(F.col("_found").isNull(), "update").when(F.col("_found") == "complete", "complete").otherwise("issue")
    return j.select("game_id", F.when(F.col("_found") != "complete", F.col("_found")).alias("issue"), action.alias("action"), F.when(F.col("_found").isNull(), F.col("_score")).alias("final_score"))


def reconcile_counts(plan: DataFrame) -> DataFrame:
    """One row: games inspected, eligible for an update, complete already, and with an issue."""
    return plan.agg(F.count("*").alias("inspected"), F.count_if(F.col("action") == "update").alias("eligible"), F.count_if(F.col("action") == "complete").alias("complete"), F.count_if(F.col("action") == "issue").alias("issues"))


def result_updates(plan: DataFrame, facts: DataFrame) -> DataFrame:
    """(game_id, season, team_id, new_result, new_score): both rows of every game to update."""
    return plan.where("action = 'update'").join(facts, "game_id").select("game_id", "season", "team_id", F.col("result").alias("new_result"), F.col("final_score").alias("new_score"))


TARGET = ["game_id", "team_id", "season"]


class Blocked(RuntimeError):
    """A plan that isn't applied."""


def apply_results(schedule: DataFrame, plan: DataFrame, updates: DataFrame) -> DataFrame:
    """schedule with the updates of a plan, which has to be without issues.

    Each update needs exactly one row of its game, team and season, which still has no result and no other score. A row
    that is gone, repeated or changed since the plan was made raises an error when the result is computed, whatever
    columns of it are read; so nothing is written in part. `blocked_updates` names these rows beforehand."""
    issues = plan.where("action = 'issue'").count()
    if issues:
        raise Blocked(f"refusing to apply a plan with {issues} reconciliation issue(s)")
    rows = schedule.select(*TARGET, F.struct(*schedule.columns).alias("_row"))
    j = rows.join(updates.withColumn("_update", F.lit(True)), TARGET, "full")
    # Rows that aren't updated need no count, and aren't brought together by their key again: the join has done so.
    targets = F.count("_row").over(Window.partitionBy(*TARGET))
    state = {c: F.col(f"_row.{c}") for c in ("result", "score")}
    fits = (targets == 1) & state["result"].isNull() & (ratings.score_missing(state["score"]) | (state["score"] == F.col("new_score")))
    message = F.concat(F.lit("schedule row changed after planning; refusing partial reconciliation for game="), F.col("game_id"), F.lit(" team="), F.col("team_id").cast("string"))
    j = j.withColumn("_fits", F.coalesce(fits, F.lit(False))).where(F.when(F.col("_update") & ~F.col("_fits"), F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
    new = {"result": "new_result", "score": "new_score"}
    return j.select(*(F.when(F.col("_update"), F.col(new[c])).otherwise(F.col(f"_row.{c}")).alias(c) if c in new else F.col(f"_row.{c}").alias(c) for c in schedule.columns))


def _open_row() -> Column:
    return F.col("result").isNull() & (ratings.score_missing(F.col("score")) | (F.col("score") == F.col("new_score")))


def blocked_updates(schedule: DataFrame, updates: DataFrame) -> DataFrame:
    """The updates without exactly one row to change: gone, repeated, or changed since the plan was made."""
    j = updates.join(schedule.withColumn("_there", F.lit(True)), TARGET, "left")
    n = j.groupBy(*TARGET).agg(F.count_if(F.col("_there") & _open_row()).alias("open"), F.count("_there").alias("rows"))
    return n.where("open <> 1 or rows <> 1")


def report_json(checks: DataFrame) -> DataFrame:
    """One row: the suite's outcome and its checks, by name, as JSON."""
    each = F.array_sort(F.collect_list(F.struct("name", "ok", "critical", "detail")))
    return checks.agg(F.to_json(F.struct(F.bool_and(F.col("ok") | ~F.col("critical")).alias("ok"), each.alias("checks"))).alias("report"))


def markdown_table(df: DataFrame, title: str, order: list[str]) -> DataFrame:
    """One row: a small result, such as a profile, as a Markdown section; nulls are empty cells."""
    def line(cells):
        return F.concat(F.lit("| "), F.array_join(F.array(*cells), " | "), F.lit(" |"))

    body = F.array_sort(F.collect_list(F.struct(*order, line([F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("_line"))))
    head = f"## {title}\n\n| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}\n"
    return df.agg(F.concat(F.lit(head), F.array_join(F.transform(body, lambda r: r["_line"]), "\n")).alias("section"))
