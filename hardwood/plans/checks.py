"""Profiles, checks, reconciliation and merges over stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from hardwood.functions import seasons
from hardwood.operators import form, quality, upsert
from hardwood.plans.bridge import SQL_GAMES, SQL_LOGS, games, logs, table


def _lines(spark, d):
    return table(spark, d, "lineitem").withColumn("game_id", F.col("l_orderkey"))


def _with_nulls(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", F.nullif("l_discount", F.lit(0.0)).alias("l_discount"), F.nullif("l_tax", F.lit(0.0)).alias("l_tax"), "l_quantity")


def _orphans(spark, d):
    return quality.orphans(table(spark, d, "orders"), table(spark, d, "lineitem"), {"o_orderkey": "l_orderkey"}).select("o_orderkey", "o_orderstatus")


def _by_season(spark, d):
    return games(spark, d).groupBy("season").agg(F.count("*").alias("rows"), F.count_distinct("game_id").alias("games"))


def _rollup(spark, d):
    g = games(spark, d).rollup("season", "team_id").agg(F.count("*").alias("rows"))
    return g.select(F.coalesce("season", F.lit("all")).alias("season"), F.coalesce("team_id", F.lit(-1)).alias("team_id"), "rows")


def _bounds(spark, d):
    o = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"), F.max(F.when(F.col("o_totalprice") > 300000, F.col("o_orderdate"))).alias("c"))
    return o.select("o_orderstatus", *(F.to_date(x).alias(n) for x, n in (("a", "first_date"), ("b", "last_date"), ("c", "last_large"))))


def _coverage(spark, d):
    return quality.coverage(table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), "k", 0.5)


def _latest_date(spark, d):
    """Per game of the last date: whether it has both sides, then the share that has."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("game_date"))
    last = o.join(F.broadcast(o.agg(F.max("game_date").alias("game_date"))), "game_date")
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("teams"))
    one = last.join(li, "k", "left").select("game_date", "k", F.coalesce((F.col("n") >= 2) & (F.col("teams") >= 2), F.lit(False)).alias("ok"))
    return one.groupBy("game_date").agg(F.count("*").alias("total"), F.count_if("ok").alias("covered"))


def _derived(spark, d):
    e = table(spark, d, "events").groupBy(F.to_date("ts").alias("calc_date")).agg(F.count("*").alias("rows"))
    return e.orderBy(F.desc("calc_date")).limit(30)


def _snapshot_coverage(spark, d):
    e = table(spark, d, "events").withColumn("available", F.col("ts") + F.expr("INTERVAL 6 HOURS"))
    invalid = F.count_if(F.to_date("available") > F.to_date("ts"))
    return e.groupBy("event_type").agg(F.count("*").alias("rows"), F.count_distinct(F.to_date("ts")).alias("cutoffs"), F.to_date(F.min("ts")).alias("first_cutoff"), F.to_date(F.max("ts")).alias("last_cutoff"), invalid.alias("late"))


def _integrity(spark, d):
    g = games(spark, d).withColumn("result", F.when(F.col("pts") % 10 == 0, "L").otherwise(F.col("result")))
    return quality.pair_integrity(g)


def _sources(spark, d, g=None):
    """A schedule with gaps and wrong entries, and the facts of the same games (g, by default all), as made from the star
    tables."""
    g = (games(spark, d) if g is None else g).withColumn("k", F.col("game_id").cast("long"))
    m = F.col("k") % 13
    result = F.when(m == 0, F.col("result")).when((m == 1) & F.col("is_home"), F.col("result")).when(m == 2, "W")
    score = F.when(m == 0, "1-2").when(m == 3, "0-0").when((m == 4) & F.col("is_home"), F.col("score")).when(m == 5, "77-70").when(m == 6, "-")
    season = F.when((m == 7) & F.col("is_home"), "1900-01").otherwise(F.col("season"))
    s = g.where("not (k % 13 = 8 and is_home)").select("game_id", season.alias("season"), "team_id", "opponent_team_id", F.col("game_date").alias("slate_date"), F.when(F.col("is_home"), "H").otherwise("A").alias("home_or_away"), result.alias("result"), score.alias("score"))
    day = F.when(F.col("k") % 17 == 1, F.date_add("game_date", 1)).otherwise(F.col("game_date"))
    f = g.where("k % 7 <> 3 and not (k % 11 = 5 and is_home)").select("game_id", "season", "team_id", "opponent_team_id", day.alias("game_date"), F.when(F.col("k") % 19 != 2, F.col("result")).alias("result"), F.when(F.col("k") % 23 != 4, F.when(F.col("k") % 29 == 5, 200 - F.col("pts")).otherwise(F.col("pts"))).alias("points"))
    return s, f


def _reconcile(spark, d):
    return quality.reconcile(*_sources(spark, d))


def _apply(spark, d):
    """The whole schedule after the updates of the plan; games with an issue have none and stay as they are."""
    s, f = _sources(spark, d)
    plan = quality.reconcile(s, f).where("action <> 'issue'")
    return quality.apply_results(s, plan, quality.result_updates(plan, f)).select("game_id", "team_id", "result", "score")


def _dated(spark, d, *columns):
    o = table(spark, d, "orders").select(F.col("o_orderkey"), F.col("o_custkey").alias("player_id"), F.to_date("o_orderdate").alias("day"), *columns)
    return o.join(table(spark, d, "customer").select(F.col("c_custkey").alias("player_id"), F.col("c_nationkey").alias("team_id"), F.col("c_name").alias("name")), "player_id")


def _rosters(spark, d):
    """Who ordered in 1997, and in 1998, where names of customers with a large order are shown in capitals."""
    o = _dated(spark, d, "o_totalprice")

    def of(year, name):
        return o.where(F.year("day") == year).groupBy("team_id", "player_id").agg(F.max("o_totalprice").alias("most"), F.max("name").alias("name")).select("team_id", "player_id", name.alias("name"))

    return of(1997, F.col("name")), of(1998, F.when(F.col("most") > 200000, F.upper("name")).otherwise(F.col("name")))


def _diff(spark, d):
    return upsert.classified(*_rosters(spark, d), ["team_id", "player_id"], ["name"])


def _roster_after(spark, d):
    """The roster after the teams with an incoming row are reconciled: stale rows of these teams are gone."""
    old, new = _rosters(spark, d)
    return upsert.reconciled_roster(old, new.where("name <> upper(name) or team_id < 10"), ["team_id"], "player_id")


def _merge(spark, d):
    """Open and filled orders as stored, filled and pending ones with another price and time as incoming; existing rows
    keep when they were recorded."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"), F.to_date("o_orderdate").alias("recorded_at"), "o_orderstatus")
    old = o.where("o_orderstatus in ('O', 'F')").drop("o_orderstatus")
    new = o.where("o_orderstatus in ('F', 'P')").withColumn("price", F.col("price") + 1).withColumn("recorded_at", F.lit("2030-01-01").cast("date")).drop("o_orderstatus")
    return upsert.merged(old, new, ["k"], preserve=("recorded_at",))


def _merge_batch(spark, d):
    """Odds by (game, book), several rows of a batch for one key: the last counts, the first time of recording stays."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("game_id"), F.col("l_suppkey").alias("sportsbook_id"), F.col("l_discount").alias("home_odds"), F.to_date("l_shipdate").alias("recorded_at"), "l_linenumber", "l_partkey", F.lit("1997-98").alias("season"))
    sequence = F.struct("l_linenumber", "l_partkey", "home_odds", "recorded_at").alias("_seq")
    old = li.where("recorded_at < '1998-01-01'").groupBy("game_id", "sportsbook_id").agg(F.max_by(F.struct("home_odds", "recorded_at", "season"), sequence).alias("r")).select("game_id", "sportsbook_id", "r.*")
    return upsert.merged_table("game_odds", old, li.where("recorded_at >= '1998-01-01'").withColumn("_seq", sequence), "_seq").drop("season")


def _upserts(spark, d):
    """Rows, old keys kept and new keys, of the merges of four derived tables: those of the first ten days and of all."""
    f = form.complete(logs(spark, d)).withColumn("season", F.lit("2023-24"))
    early = f.where("game_time < '2024-01-11'")
    made = {
        "streaks": lambda x: form.current_streaks(x, [10, 50]).withColumn("streak_kind", F.lit("current")).withColumn("season", F.lit("2023-24")), "stat_windows": lambda x: form.stat_windows(x, [10, 50], (5, 10)).withColumn("season", F.lit("2023-24")),
        "heat_index": lambda x: form.heat_index(x, (3, 5), decimals=8).withColumn("season", F.lit("2023-24")), "consistency": lambda x: form.consistency(x, decimals=8).withColumn("season", F.lit("2023-24")),
    }
    value = {"streaks": "streak_games", "stat_windows": "games_hit", "heat_index": "z_score", "consistency": "games_played"}
    out = [upsert.merged_table(n, make(early), make(f)).agg(F.lit(n).alias("table"), F.count("*").alias("rows"), F.round(F.sum(value[n]), 4).cast("double").alias("total")) for n, make in made.items()]
    return reduce(lambda a, b: a.unionByName(b), out)


def _last_of_batch(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "value", "event_id")
    return upsert.last_of_batch(e, ["user_id", "event_type"], "event_id")


def _dedupe(spark, d):
    return upsert.deduplicated(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"), ["l_orderkey", "l_linenumber"])


def _suite(spark, d):
    pairs = quality.two_row_check(_lines(spark, d))
    dup = quality.duplicate_keys(table(spark, d, "orders"), ["o_orderkey"])
    cov = _coverage(spark, d)
    rng = quality.out_of_range(table(spark, d, "lineitem"), {"l_quantity": (1, 50), "l_discount": (0, 0.1)}).agg(F.count("*").alias("n"))
    orphan = _orphans(spark, d).agg(F.count("*").alias("n"))
    return quality.suite([
        quality.check("paired_games", (F.col("single") + F.col("overfull")) == 0, F.col("single") + F.col("overfull"), True, pairs), quality.check("unique_orders", F.col("groups") == 0, F.col("groups"), True, dup),
        quality.check("line_coverage", F.col("ok"), F.col("covered"), True, cov), quality.check("ranges", F.col("n") == 0, F.col("n"), False, rng), quality.check("orders_without_lines", F.col("n") == 0, F.col("n"), False, orphan),
    ])


def _difference(spark, d):
    """Keys that only one of orders and lineitem has."""
    a, b = table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"))
    return quality.key_difference(a, b, "k").groupBy("side").agg(F.count("*").alias("keys"))


def _types(spark, d):
    o = table(spark, d, "orders").select(F.concat(F.lit("00"), (F.col("o_orderkey") % 5 + 1).cast("string"), F.lpad(F.col("o_orderkey").cast("string"), 7, "0")).alias("game_id"))
    return o.groupBy(seasons.season_type_of_game(F.col("game_id")).alias("season_type")).agg(F.count("*").alias("games"))


QUERIES = {
    "two_row_failures": lambda s, d: quality.two_row_check(_lines(s, d)),
    "duplicate_keys": lambda s, d: quality.duplicate_keys(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]),
    "orphans_left_anti": _orphans,
    "null_rates": lambda s, d: quality.null_rates(_with_nulls(s, d)),
    "counts_by_season": _by_season,
    "counts_by_season_team": _rollup,
    "date_bounds_filtered": _bounds,
    "coverage_ratio": _coverage,
    "latest_date_coverage": _latest_date,
    "derived_counts_by_date": _derived,
    "snapshot_coverage": _snapshot_coverage,
    "range_violations": lambda s, d: quality.out_of_range(table(s, d, "lineitem"), {"l_quantity": (2, 49), "l_tax": (0.0, 0.07)}).select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"),
    "wl_pair_integrity": _integrity,
    "reconcile_plan": _reconcile,
    "reconcile_issue_counts": lambda s, d: _reconcile(s, d).groupBy("action", F.coalesce("issue", F.lit("none")).alias("issue")).agg(F.count("*").alias("games")),
    "reconcile_summary": lambda s, d: quality.reconcile_counts(_reconcile(s, d)),
    "reconcile_apply": _apply,
    "roster_diff": _diff,
    "roster_reconciled": _roster_after,
    "upsert_merge": _merge,
    "upsert_odds_batch": _merge_batch,
    "upsert_derived_tables": _upserts,
    "upsert_dedupe": _last_of_batch,
    "dedupe_by_key": _dedupe,
    "validation_suite": _suite,
    "key_set_difference": _difference,
    "season_types": _types,
    "validation_report": lambda s, d: quality.report_json(_suite(s, d)),
    "profile_markdown": lambda s, d: quality.markdown_table(quality.null_rates(_with_nulls(s, d)), "Null rates", ["column"]),
    "suite_outcome": lambda s, d: quality.suite_ok(_suite(s, d)),
}

_G = f"WITH {SQL_GAMES}"
_REC = """
k AS (SELECT *, CAST(game_id AS BIGINT) AS k, CAST(game_id AS BIGINT) % 13 AS m FROM ga),
s AS (SELECT game_id, CASE WHEN m = 7 AND is_home THEN '1900-01' ELSE season END AS season, team_id, opponent_team_id, game_date AS day, is_home,
      CASE WHEN m = 0 OR (m = 1 AND is_home) THEN result WHEN m = 2 THEN 'W' END AS result, CASE WHEN m = 0 THEN '1-2' WHEN m = 3 THEN '0-0' WHEN m = 4 AND is_home THEN score WHEN m = 5 THEN '77-70' WHEN m = 6 THEN '-' END AS sc FROM k WHERE NOT (m = 8 AND is_home)),
f AS (SELECT game_id, season, team_id, is_home, game_date + CASE WHEN k % 17 = 1 THEN 1 ELSE 0 END AS day, CASE WHEN k % 19 <> 2 THEN result END AS result, CASE WHEN k % 23 <> 4 THEN CASE WHEN k % 29 = 5 THEN 200 - pts ELSE pts END END AS points
      FROM k WHERE k % 7 <> 3 AND NOT (k % 11 = 5 AND is_home)),
sg AS (SELECT game_id, count(*) AS n, count(DISTINCT season) AS seasons, count(result) AS results, count(DISTINCT result) AS kinds, min(day) AS day, list(sc) AS scs FROM s GROUP BY game_id),
fg AS (SELECT game_id, count(*) AS n, count(result) AS results, count(DISTINCT result) AS kinds, count(points) AS points, min(day) AS day, max(points) FILTER (WHERE result = 'W') AS won, max(points) FILTER (WHERE result = 'L') AS lost,
       CAST(max(points) FILTER (WHERE is_home) AS VARCHAR) || '-' || CAST(max(points) FILTER (WHERE NOT is_home) AS VARCHAR) AS score FROM f GROUP BY game_id),
i AS (SELECT sg.game_id, fg.score, CASE WHEN sg.n <> 2 THEN 'expected 2 schedule rows; found ' || sg.n WHEN sg.seasons <> 1 THEN 'schedule rows disagree on season or date' WHEN sg.results = 2 AND sg.kinds = 2 THEN 'complete' WHEN sg.results = 2 THEN 'existing schedule results are not a W/L pair'
      WHEN sg.results = 1 THEN 'schedule has a mixed null/non-null result pair' WHEN coalesce(fg.n, 0) <> 2 THEN 'expected 2 team-game rows; found ' || coalesce(fg.n, 0) WHEN fg.day <> sg.day THEN 'schedule and team-game dates differ' WHEN fg.results <> 2 OR fg.kinds <> 2 THEN 'team-game rows are not a W/L pair' WHEN fg.points <> 2 THEN 'team-game score is missing'
      WHEN won <= lost THEN 'W/L disagrees with team-game points' WHEN len(list_filter(scs, lambda x: x IS NOT NULL AND x NOT IN ('', '-', '0-0') AND x <> fg.score)) > 0 THEN 'existing schedule score disagrees with team-game points' END AS found FROM sg LEFT JOIN fg USING (game_id)),
rc AS (SELECT game_id, CASE WHEN found <> 'complete' THEN found END AS issue, CASE WHEN found IS NULL THEN 'update' WHEN found = 'complete' THEN 'complete' ELSE 'issue' END AS action, CASE WHEN found IS NULL THEN score END AS final_score FROM i)"""
_ROST = """o AS (SELECT c_nationkey AS team_id, c_custkey AS player_id, c_name AS name, max(o_totalprice) FILTER (WHERE year(o_orderdate) = 1997) AS a, max(o_totalprice) FILTER (WHERE year(o_orderdate) = 1998) AS b FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
        old AS (SELECT team_id, player_id, name FROM o WHERE a IS NOT NULL), new AS (SELECT team_id, player_id, CASE WHEN b > 200000 THEN upper(name) ELSE name END AS name FROM o WHERE b IS NOT NULL)"""
_COV = """SELECT count(*) AS total, count(l.k) AS covered, round(count(l.k) / count(*), 4) AS rate, count(l.k) / count(*) >= 0.5 AS ok
    FROM (SELECT DISTINCT o_orderkey AS k FROM orders) o LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) l ON o.k = l.k"""
_TWO = "SELECT count(*) FILTER (WHERE n = 1) AS single, count(*) FILTER (WHERE n = 2) AS paired, count(*) FILTER (WHERE n > 2) AS overfull, count(*) AS games FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)"

_SUITE = f"""WITH t AS ({_TWO}), c AS ({_COV}), d AS (SELECT count(*) AS n FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)),
        r AS (SELECT count(*) AS n FROM lineitem WHERE l_quantity < 1 OR l_quantity > 50 OR l_discount < 0 OR l_discount > 0.1::DOUBLE), o AS (SELECT count(*) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey))
        SELECT 'paired_games' AS name, single + overfull = 0 AS ok, TRUE AS critical, CAST(single + overfull AS VARCHAR) AS detail FROM t
        UNION ALL SELECT 'unique_orders', n = 0, TRUE, CAST(n AS VARCHAR) FROM d UNION ALL SELECT 'line_coverage', ok, TRUE, CAST(covered AS VARCHAR) FROM c
        UNION ALL SELECT 'ranges', n = 0, FALSE, CAST(n AS VARCHAR) FROM r UNION ALL SELECT 'orders_without_lines', n = 0, FALSE, CAST(n AS VARCHAR) FROM o"""

ORACLE = {
    "two_row_failures": _TWO,
    "duplicate_keys": "SELECT count(*) AS groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS extra_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)",
    "orphans_left_anti": "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "null_rates": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({e}) AS nulls, count(*) AS total, round((count(*) - count({e})) / count(*), 4) AS rate FROM lineitem" for c, e in (("l_orderkey", "l_orderkey"), ("l_discount", "nullif(l_discount, 0)"), ("l_tax", "nullif(l_tax, 0)"), ("l_quantity", "l_quantity"))),
    "counts_by_season": f'{_G} SELECT season, count(*) AS "rows", count(DISTINCT game_id) AS games FROM ga GROUP BY season',
    "counts_by_season_team": f"""{_G} SELECT coalesce(season, 'all') AS season, coalesce(team_id, -1) AS team_id, count(*) AS "rows" FROM ga GROUP BY ROLLUP (season, team_id)""",
    "date_bounds_filtered": "SELECT o_orderstatus, CAST(min(o_orderdate) AS DATE) AS first_date, CAST(max(o_orderdate) AS DATE) AS last_date, CAST(max(o_orderdate) FILTER (WHERE o_totalprice > 300000) AS DATE) AS last_large FROM orders GROUP BY 1",
    "coverage_ratio": _COV,
    "latest_date_coverage": """WITH l AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_suppkey) AS t FROM lineitem GROUP BY 1)
        SELECT CAST(o_orderdate AS DATE) AS game_date, count(*) AS total, count(*) FILTER (WHERE n >= 2 AND t >= 2) AS covered FROM orders LEFT JOIN l ON l_orderkey = o_orderkey WHERE CAST(o_orderdate AS DATE) = (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) GROUP BY 1""",
    "derived_counts_by_date": 'SELECT CAST(ts AS DATE) AS calc_date, count(*) AS "rows" FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 30',
    "snapshot_coverage": """SELECT event_type, count(*) AS "rows", count(DISTINCT CAST(ts AS DATE)) AS cutoffs, CAST(min(ts) AS DATE) AS first_cutoff, CAST(max(ts) AS DATE) AS last_cutoff,
        count(*) FILTER (WHERE CAST(ts + INTERVAL 6 HOUR AS DATE) > CAST(ts AS DATE)) AS late FROM events GROUP BY event_type""",
    "range_violations": "SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem WHERE l_quantity < 2 OR l_quantity > 49 OR l_tax < 0.0 OR l_tax > 0.07::DOUBLE",
    "wl_pair_integrity": f"""{_G}, w AS (SELECT game_id, CASE WHEN pts % 10 = 0 THEN 'L' ELSE result END AS result FROM ga)
        SELECT game_id, count(*) AS n, coalesce(array_to_string(list_sort(list_distinct(list(result) FILTER (WHERE result IS NOT NULL))), ','), '') AS results FROM w GROUP BY game_id HAVING results <> 'L,W'""",
    "reconcile_plan": f"{_G}, {_REC} SELECT * FROM rc",
    "reconcile_issue_counts": f"{_G}, {_REC} SELECT action, coalesce(issue, 'none') AS issue, count(*) AS games FROM rc GROUP BY ALL",
    "reconcile_summary": f"""{_G}, {_REC} SELECT count(*) AS inspected, count(*) FILTER (WHERE action = 'update') AS eligible, count(*) FILTER (WHERE action = 'complete') AS complete, count(*) FILTER (WHERE action = 'issue') AS issues FROM rc""",
    "reconcile_apply": f"""{_G}, {_REC} SELECT s.game_id, s.team_id, CASE WHEN action = 'update' THEN f.result ELSE s.result END AS result, CASE WHEN action = 'update' THEN final_score ELSE sc END AS score
        FROM s JOIN rc USING (game_id) LEFT JOIN f ON f.game_id = s.game_id AND f.team_id = s.team_id""",
    "roster_diff": f"""WITH {_ROST} SELECT team_id, player_id, CASE WHEN old.name IS NULL THEN 'inserted' WHEN new.name IS NULL THEN 'removed' WHEN old.name <> new.name THEN 'updated' ELSE 'unchanged' END AS change FROM old FULL JOIN new USING (team_id, player_id)""",
    "roster_reconciled": f"""WITH {_ROST}, i AS (SELECT * FROM new WHERE name <> upper(name) OR team_id < 10) SELECT * FROM i UNION ALL SELECT * FROM old WHERE team_id NOT IN (SELECT team_id FROM i)""",
    "upsert_merge": """SELECT o_orderkey AS k, CASE WHEN o_orderstatus <> 'O' THEN o_totalprice + 1 ELSE o_totalprice END AS price, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) ELSE DATE '2030-01-01' END AS recorded_at
        FROM orders WHERE o_orderstatus IN ('O', 'F', 'P')""",
    "upsert_odds_batch": """WITH l AS (SELECT l_orderkey AS game_id, l_suppkey AS sportsbook_id, l_discount AS home_odds, CAST(l_shipdate AS DATE) AS d, CAST(l_shipdate AS DATE) >= DATE '1998-01-01' AS fresh, l_linenumber AS n, l_partkey AS p FROM lineitem),
        r AS (SELECT *, row_number() OVER (PARTITION BY game_id, sportsbook_id, fresh ORDER BY n DESC, p DESC, home_odds DESC, d DESC) AS back FROM l),
        o AS (SELECT * FROM r WHERE back = 1 AND NOT fresh), w AS (SELECT * FROM r WHERE back = 1 AND fresh)
        SELECT game_id, sportsbook_id, coalesce(w.home_odds, o.home_odds) AS home_odds, coalesce(o.d, w.d) AS recorded_at FROM o FULL JOIN w USING (game_id, sportsbook_id)""",
    "upsert_derived_tables": f"""WITH {SQL_LOGS}, e AS (SELECT * FROM lg WHERE game_time < TIMESTAMP '2024-01-11'), th AS (SELECT unnest([10.0::DOUBLE, 50.0]) AS t), ws AS (SELECT unnest([5, 10]) AS w),
        en AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY game_time DESC, game_id DESC) AS nd FROM e), fn AS (SELECT *, n_desc AS nd FROM nl),
        s1 AS (SELECT player_id, t, coalesce(min(nd) FILTER (WHERE value < t) - 1, max(nd)) AS v FROM en, th GROUP BY ALL), s2 AS (SELECT player_id, t, coalesce(min(nd) FILTER (WHERE value < t) - 1, max(nd)) AS v FROM fn, th GROUP BY ALL),
        w1 AS (SELECT player_id, t, w, count(*) FILTER (WHERE value >= t) AS v FROM en, th, ws WHERE nd <= w GROUP BY ALL), w2 AS (SELECT player_id, t, w, count(*) FILTER (WHERE value >= t) AS v FROM fn, th, ws WHERE nd <= w GROUP BY ALL),
        h1 AS (SELECT player_id, w, round((avg(value) FILTER (WHERE nd <= w) - avg(value)) / stddev_samp(value), 8) AS v FROM en, (SELECT unnest([3, 5]) AS w) GROUP BY ALL HAVING count(*) >= 3 AND stddev_samp(value) > 0),
        h2 AS (SELECT player_id, w, round((avg(value) FILTER (WHERE nd <= w) - avg(value)) / stddev_samp(value), 8) AS v FROM fn, (SELECT unnest([3, 5]) AS w) GROUP BY ALL HAVING count(*) >= 3 AND stddev_samp(value) > 0),
        c1 AS (SELECT player_id, w, count(*) AS v FROM en, (SELECT unnest([0, 10]) AS w) WHERE w = 0 OR nd <= w GROUP BY ALL HAVING count(*) >= 5), c2 AS (SELECT player_id, w, count(*) AS v FROM fn, (SELECT unnest([0, 10]) AS w) WHERE w = 0 OR nd <= w GROUP BY ALL HAVING count(*) >= 5)
        SELECT 'streaks' AS "table", count(*) AS "rows", round(CAST(sum(coalesce(b.v, a.v)) AS DOUBLE), 4) AS total FROM (SELECT * FROM s1 WHERE v >= 1) a FULL JOIN (SELECT * FROM s2 WHERE v >= 1) b USING (player_id, t)
        UNION ALL SELECT 'stat_windows', count(*), round(CAST(sum(coalesce(w2.v, w1.v)) AS DOUBLE), 4) FROM w1 FULL JOIN w2 USING (player_id, t, w)
        UNION ALL SELECT 'heat_index', count(*), round(sum(coalesce(h2.v, h1.v)), 4) FROM h1 FULL JOIN h2 USING (player_id, w)
        UNION ALL SELECT 'consistency', count(*), round(CAST(sum(coalesce(c2.v, c1.v)) AS DOUBLE), 4) FROM c1 FULL JOIN c2 USING (player_id, w)""",
    "upsert_dedupe": "SELECT user_id, event_type, value, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1",
    "dedupe_by_key": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1""",
    "validation_suite": _SUITE,
    "key_set_difference": """WITH a AS (SELECT DISTINCT o_orderkey AS k FROM orders), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem)
        SELECT CASE WHEN a.k IS NULL THEN 'missing_left' ELSE 'missing_right' END AS side, count(*) AS keys FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL GROUP BY 1""",
    "season_types": "SELECT CASE o_orderkey % 5 + 1 WHEN 1 THEN 'Pre Season' WHEN 2 THEN 'Regular Season' WHEN 3 THEN 'All-Star' WHEN 4 THEN 'Playoffs' END AS season_type, count(*) AS games FROM orders GROUP BY 1",
    "suite_outcome": f"WITH x AS ({_SUITE}) SELECT bool_and(ok OR NOT critical) AS ok, count(*) FILTER (WHERE NOT ok AND critical) AS failed, count(*) FILTER (WHERE NOT ok AND NOT critical) AS warnings FROM x",
    "validation_report": f"""WITH x AS ({_SUITE}) SELECT '{{"ok":' || CAST(bool_and(ok OR NOT critical) AS VARCHAR) || ',"checks":[' ||
        string_agg('{{"name":"' || name || '","ok":' || CAST(ok AS VARCHAR) || ',"critical":' || CAST(critical AS VARCHAR) || ',"detail":"' || detail || '"}}', ',' ORDER BY name) || ']}}' AS report FROM x""",
}
_NULLS = ORACLE["null_rates"]
ORACLE["profile_markdown"] = f"""SELECT '## Null rates' || chr(10) || chr(10) || '| column | nulls | total | rate |' || chr(10) || '|---|---|---|---|' || chr(10) ||
        string_agg('| ' || "column" || ' | ' || nulls || ' | ' || total || ' | ' || CASE WHEN rate = 0 THEN '0.0' ELSE CAST(rate AS VARCHAR) END || ' |', chr(10) ORDER BY "column") AS section FROM ({_NULLS})"""
