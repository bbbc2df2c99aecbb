"""Nested provider payloads as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hardwood.functions import ratings, seasons

SIDE = "struct<teamId:long,score:int>"
SCHEDULE = f"gameDates array<struct<games:array<struct<gameId:string,gameDateTimeUTC:string,gameStatus:int,homeTeam:{SIDE},awayTeam:{SIDE}>>>>"
ODDS = "games array<struct<gameId:string,markets:array<struct<name:string,books:array<struct<id:string,name:string,countryCode:string,outcomes:array<struct<type:string,odds:string,spread:string>>>>>>>>"
BOX = "gameId string, homeTeam struct<teamId:long,players:array<struct<personId:long,status:string,played:string,notPlayingReason:string>>>, awayTeam struct<teamId:long,players:array<struct<personId:long,status:string,played:string,notPlayingReason:string>>>"


def schedule_rows(feed: DataFrame) -> DataFrame:
    """Two rows a game from payloads of SCHEDULE; games without time or teams go. The result only counts when the
    game is final (status 3); a tie has none."""
    g = feed.select(F.explode("gameDates").alias("d")).select(F.explode("d.games").alias("g")).select("g.*")
    g = g.withColumn("game_date", F.to_timestamp("gameDateTimeUTC")).where("game_date is not null and homeTeam.teamId is not null and awayTeam.teamId is not null")
    final = F.col("gameStatus") == 3
    h, a = F.col("homeTeam.score"), F.col("awayTeam.score")
    score = F.when(final, F.concat_ws("-", h.cast("string"), a.cast("string")))

    def side(own, other, label, mine, theirs):
        result = F.when(final & (mine > theirs), "W").when(final & (mine < theirs), "L")
        return F.struct(F.col(f"{own}.teamId").alias("team_id"), F.col(f"{other}.teamId").alias("opponent_team_id"), F.lit(label).alias("home_or_away"), result.alias("result"))

    both = F.explode(F.array(side("homeTeam", "awayTeam", "H", h, a), side("awayTeam", "homeTeam", "A", a, h))).alias("s")
    return g.select(seasons.game_id(F.col("gameId")).alias("game_id"), "game_date", score.alias("score"), both).select("game_id", "s.*", "game_date", "score")


def records(payload: DataFrame) -> DataFrame:
    """Header and row arrays to one map a record."""
    return payload.select(F.explode("rowSet").alias("r"), "headers").select(F.map_from_arrays("headers", "r").alias("record"))


def odds_rows(feed: DataFrame, country: str = "US") -> DataFrame:
    """One row a game and book from payloads of ODDS: moneylines of the two-way market, spreads of the spread market;
    zero prices are missing."""
    b = feed.select(F.explode("games").alias("g")).select("g.gameId", F.explode("g.markets").alias("m")).select("gameId", "m.name", F.explode("m.books").alias("b"))
    o = b.where(F.col("b.countryCode") == country).select("gameId", F.col("name").alias("market"), "b.id", F.col("b.name").alias("book"), F.explode("b.outcomes").alias("o"))
    price, spread = F.nullif(F.col("o.odds").try_cast("double"), F.lit(0.0)), F.col("o.spread").try_cast("double")

    def pick(market, side, value):
        return F.max(F.when((F.col("market") == market) & (F.col("o.type") == side), value))

    return o.groupBy(seasons.game_id(F.col("gameId")).alias("game_id"), F.col("id").alias("sportsbook_id")).agg(
        F.min("book").alias("sportsbook_name"), pick("2way", "home", price).alias("home_odds"), pick("2way", "away", price).alias("away_odds"), pick("spread", "home", spread).alias("home_spread"), pick("spread", "away", spread).alias("away_spread")
    )


def availability_rows(box: DataFrame) -> DataFrame:
    """Players of BOX payloads that aren't active, didn't play or have a reason."""
    sides = F.explode(F.array("homeTeam", "awayTeam")).alias("t")
    p = box.select("gameId", sides).select("gameId", "t.teamId", F.explode("t.players").alias("p"))
    p = p.select(seasons.game_id(F.col("gameId")).alias("game_id"), F.col("teamId").alias("team_id"), F.col("p.personId").alias("player_id"), "p.status", (F.coalesce(F.col("p.played"), F.lit("0")) == "1").alias("played"), F.col("p.notPlayingReason").alias("reason"))
    return p.where(~F.col("status").eqNullSafe("ACTIVE") | ~F.col("played") | (F.coalesce(F.trim("reason"), F.lit("")) != ""))


def roster_rows(payload: DataFrame) -> DataFrame:
    """(player_id, name, number) of a roster payload: id and name are needed, the first row of a player counts."""
    r = payload.select("position", F.col("player_id").try_cast("long").alias("player_id"), F.nullif(F.trim("name"), F.lit("")).alias("name"), ratings.int_or_null(F.col("number")).alias("number"))
    r = r.dropna(subset=["player_id", "name"])
    return r.groupBy("player_id").agg(F.min_by(F.struct("name", "number"), "position").alias("r")).select("player_id", "r.*")


def wide_stats(long: DataFrame, measures: list[str] | None = None) -> DataFrame:
    """(team_id, season, measure, mode, stat, value) to one column each measure_mode_stat, in lower case; without a list
    of them those that occur, of which Spark takes spark.sql.pivotMaxValues at most."""
    named = long.withColumn("_c", F.lower(F.concat_ws("_", "measure", "mode", "stat")))
    return named.groupBy("team_id", "season").pivot("_c", measures).agg(F.first("value"))


def with_prefix(wide: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """The keys and the columns named prefix_x, as x."""
    return wide.select(*keys, *(F.col(c).alias(c[len(prefix) + 1 :]) for c in wide.columns if c.startswith(prefix + "_")))


def with_season(available: DataFrame, active: DataFrame, season: str) -> DataFrame:
    """(player_id, available_seasons) after a sync: active players get the season, new ones are added."""
    j = available.join(active.select("player_id").distinct().withColumn("_a", F.lit(True)), "player_id", "full")
    old = F.coalesce("available_seasons", F.array().cast("array<string>"))
    return j.select("player_id", F.when(F.col("_a").isNotNull(), F.array_sort(F.array_distinct(F.array_append(old, F.lit(season))))).otherwise(old).alias("available_seasons"))


def needs_refresh(completed: DataFrame, stored: DataFrame, today, recent_days: int = 3, least: int = 5, forced: DataFrame | None = None) -> DataFrame:
    """(player_id, refresh): forced, no rows, fewer than `least`, or a completed game of the last days is missing.

    completed: player_id, game_id, game_date. stored: player_id, game_id. forced: player_id."""
    missing = completed.join(stored, ["player_id", "game_id"], "left_anti").groupBy("player_id").agg(F.max(F.datediff(F.lit(today).cast("date"), "game_date") <= recent_days).alias("_recent"))
    have = stored.groupBy("player_id").agg(F.count("*").alias("_n"))
    everyone = completed.select("player_id").union(stored.select("player_id")).distinct()
    j = everyone.join(missing, "player_id", "left").join(have, "player_id", "left")
    must = F.lit(False)
    if forced is not None:
        j, must = j.join(forced.select("player_id").distinct().withColumn("_f", F.lit(True)), "player_id", "left"), F.coalesce("_f", F.lit(False))
    return j.select("player_id", (must | (F.coalesce("_n", F.lit(0)) < least) | F.coalesce("_recent", F.lit(False))).alias("refresh"))


def is_stale(marker: DataFrame, now, hours: int = 30) -> DataFrame:
    """One row: whether the marker's completed_at is more than so many hours before now, or isn't there."""
    age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.to_timestamp(F.max("completed_at")))) / 3600
    return marker.agg(F.coalesce(age > hours, F.lit(True)).alias("stale"))


def newest_files(spark: SparkSession, folder: str, k: int = 3, pattern: str = "*.json") -> DataFrame:
    """path, modified and place of the k files below a folder that were changed last, newest first, each path once.

    Only the files' names and times are read, as Spark's readers tell them, so any store will do."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime").groupBy("path").agg(F.max("modificationTime").alias("modified"))
    top = files.orderBy(F.desc("modified"), F.desc("path")).limit(k)
    return top.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("modified"), F.desc("path"))))


# -- what is to be fetched, and what of it may be stored -------------------------------------------------------------


def games_to_fetch(schedule: DataFrame, having: DataFrame, first, last) -> DataFrame:
    """Completed games of the dates that have no rows yet: one row a game, the home team's if there is one."""
    done = schedule.where(F.col("result").isNotNull() & F.to_date("game_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    new = done.join(having.select("game_id").distinct(), "game_id", "left_anti")
    one = new.groupBy("game_id").agg(F.min_by(F.struct("game_date", "season", "team_id"), F.struct(F.col("home_or_away") != "H", "team_id")).alias("g"))
    return one.select("game_id", "g.*")


def known_only(rows: DataFrame, **dimensions: DataFrame) -> DataFrame:
    """rows whose every named column has its value in the dimension's column of that name, such as team_id and game_id."""
    for column, dimension in dimensions.items():
        rows = rows.join(dimension.select(column).distinct(), column, "left_semi")
    return rows


def known_schedule(entries: DataFrame, teams: DataFrame) -> DataFrame:
    """Schedule entries whose team and opponent are both known."""
    known = teams.select("team_id").distinct()
    return known_only(entries, team_id=known, opponent_team_id=known.withColumnRenamed("team_id", "opponent_team_id"))


def unknown_players(feed: DataFrame, players: DataFrame) -> DataFrame:
    """Players of a feed that aren't stored yet, each once."""
    return feed.join(players.select("player_id"), "player_id", "left_anti").dropDuplicates(["player_id"])


def require_none(rows: DataFrame, what: str) -> None:
    """Raises an error if there are rows: the step that comes next must not run."""
    found = rows.limit(5).collect()
    if found:
        raise ValueError(f"{what}: {found}")


def require_some(rows: DataFrame, what: str) -> DataFrame:
    """rows, or an error if there are none: an empty payload is a failed fetch, not an empty table."""
    if rows.isEmpty():
        raise ValueError(what)
    return rows


def resolved_roster(payload: DataFrame, players: DataFrame) -> DataFrame:
    """roster_rows of a payload that isn't empty and whose players are all known; otherwise an error."""
    roster = require_some(roster_rows(payload), "the roster payload has no player")
    require_none(roster.join(players.select("player_id"), "player_id", "left_anti"), "roster players that are not stored")
    return roster


def renamed(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """The named columns of a feed under the names of the table."""
    return rows.select(*(F.col(old).alias(new) for old, new in names.items()))


def game_logs(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """renamed, with whole game ids; rows without one go."""
    logs = renamed(rows, names)
    return logs.withColumn("game_id", seasons.game_id(F.col("game_id"))).where("game_id is not null")


def season_range(first: int, last: int) -> Column:
    """The seasons that start in these years, as an array."""
    return F.transform(F.sequence(F.lit(first), F.lit(last)), seasons.season_name)


def seasons_between(first: Column, last: Column, valid: list[str]) -> Column:
    """Of the valid seasons those that start in these years, both included, as a sorted array; empty without both."""
    each = F.filter(F.array(*map(F.lit, sorted(valid))), lambda s: seasons.season_start(s).between(first, last))
    return F.coalesce(each, F.array().cast("array<string>"))


def rebuilt_seasons(players: DataFrame, valid: list[str]) -> DataFrame:
    """(player_id, available_seasons): of players without any well-formed season so far, those between from_year and
    to_year; players that have one stay as they are."""
    has = F.exists(F.coalesce("available_seasons", F.array().cast("array<string>")), seasons.is_season)
    span = seasons_between(F.col("from_year").try_cast("int"), F.col("to_year").try_cast("int"), valid)
    return players.select("player_id", F.when(has, F.col("available_seasons")).otherwise(span).alias("available_seasons"))


def bios(feed: DataFrame, players: DataFrame, valid: list[str], this_year: int) -> DataFrame:
    """New players of a bio feed: whole numbers or null, age by year of birth, and the seasons they span; those that span
    none go."""
    new = unknown_players(feed, players)
    span = seasons_between(F.col("from_year").try_cast("int"), F.col("to_year").try_cast("int"), valid)
    born = F.to_date("birthdate")
    out = new.select("player_id", "name", ratings.int_or_null(F.col("weight")).alias("weight"), born.alias("born_date"), (F.lit(this_year) - F.year(born)).alias("age"), ratings.int_or_null(F.col("exp")).alias("exp"), span.alias("available_seasons"))
    return out.where(F.size("available_seasons") > 0)


def team_box_scores(feed: DataFrame, schedule: DataFrame) -> DataFrame:
    """Box scores with opponent, date and season; games that the schedule doesn't have go. Dates are like "OCT 22, 2024"."""
    day = F.to_date(F.initcap("game_date"), "MMM dd, yyyy")
    s = schedule.select("game_id", "team_id", "opponent_team_id").distinct()
    b = feed.withColumn("game_id", seasons.game_id(F.col("game_id"))).withColumn("game_date", day).withColumn("season", seasons.season_of(F.col("game_date")))
    return b.join(s, ["game_id", "team_id"])


def stamped(children: DataFrame, games: DataFrame) -> DataFrame:
    """Rows of a game's feed with the date and season of the game."""
    return children.join(games.select("game_id", "game_date", "season").dropDuplicates(["game_id"]), "game_id")


def season_bounds(schedule: DataFrame) -> DataFrame:
    """(season, first_game, last_completed): what a backfill of a season spans."""
    return schedule.groupBy("season").agg(F.min("game_date").alias("first_game"), F.max(F.when(F.col("result").isNotNull(), F.col("game_date"))).alias("last_completed"))


def tier(rosters: DataFrame, season: str, kind: str) -> DataFrame:
    """(season, player_id) to fetch: of the current season, of it and the two before ("recent"), or of all."""
    year = int(season[:4])
    wanted = {"current": 1, "recent": 3}.get(kind)
    if wanted is None and kind != "all":
        raise ValueError(f"no such tier: {kind}")
    rows = rosters if wanted is None else rosters.where(seasons.season_start(F.col("season")).between(year - wanted + 1, year))
    return rows.select("season", "player_id").distinct()


def team_players(rosters: DataFrame, teams: DataFrame) -> DataFrame:
    """Players of these teams, each roster row once."""
    return rosters.join(teams.select("team_id").distinct(), "team_id", "left_semi")


def feed_games_on(feed: DataFrame, day: str) -> DataFrame:
    """Ids and times of a SCHEDULE payload's games on one Eastern date."""
    g = feed.select(F.explode("gameDates").alias("d")).select(F.explode("d.games").alias("g")).select("g.*")
    at = F.to_timestamp("gameDateTimeUTC")
    return g.where(seasons.eastern_date(at) == F.lit(day).cast("date")).select(seasons.game_id(F.col("gameId")).alias("game_id"), at.alias("game_time")).dropDuplicates(["game_id"])


# -- scoreboards, standings, lineups ---------------------------------------------------------------------------------


def scoreboard(headers: DataFrame, lines: DataFrame, meetings: DataFrame) -> DataFrame:
    """One row a game: the header, its line scores as a list by team, and the last meeting of both."""
    each = lines.groupBy("game_id").agg(F.array_sort(F.collect_list(F.struct("team_id", "points"))).alias("line_scores"))
    last = meetings.select("game_id", F.struct(*(c for c in meetings.columns if c != "game_id")).alias("last_meeting"))
    return headers.join(each, "game_id", "left").join(last, "game_id", "left")


def conference(label: Column) -> Column:
    """East or West by how a label starts; other labels stay."""
    low = F.lower(F.trim(label))
    return F.when(F.length(low) == 0, F.lit(None)).when(low.startswith("east"), "East").when(low.startswith("west"), "West").otherwise(label)


def standings_rows(feed: DataFrame) -> DataFrame:
    """(conference, team_id, team, w, l, w_pct, home, road) of a standings feed; other conferences are "Unknown"."""
    c = conference(F.col("Conference"))
    bucket = F.when(c.isin("East", "West"), c).otherwise("Unknown")
    return feed.select(bucket.alias("conference"), F.col("TeamID").try_cast("long").alias("team_id"), F.col("TeamName").alias("team"), F.col("WINS").alias("w"), F.col("LOSSES").alias("l"), F.col("WinPCT").alias("w_pct"), F.col("HOME").alias("home"), F.col("ROAD").alias("road"))


def has_records() -> Column:
    """Whether any row has a win, a loss or a share won above 0; what is no number counts as 0."""
    return F.coalesce(F.bool_or(F.greatest(*(F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in ("w", "l", "w_pct"))) > 0), F.lit(False))


def standings(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Each conference's rows of the primary feed, or of the fallback where the primary has no real record. A conference
    is one of three values, so what is joined is tiny."""
    real = primary.groupBy("conference").agg(has_records().alias("_real")).where("_real").select("conference")
    return primary.join(F.broadcast(real), "conference", "left_semi").unionByName(fallback.join(F.broadcast(real), "conference", "left_anti"))


def lineups(groups: DataFrame, roster: DataFrame) -> DataFrame:
    """(team_id, kind, lineup, gp, player_ids): each team's lineup with the most games and the one with the most minutes,
    names like "A. Last" matched to roster players of that team.

    groups: team_id, group_name ("A. B - C. D"), gp, minutes. roster: team_id, player_id, player_name."""
    row = F.struct("group_name", "gp")
    g = groups.groupBy("team_id").agg(F.max_by(row, F.struct("gp", "group_name")).alias("most_used"), F.max_by(row, F.struct("minutes", "group_name")).alias("most_recent"))
    g = g.select("team_id", F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"{k}.group_name").alias("lineup"), F.col(f"{k}.gp").alias("gp")) for k in ("most_used", "most_recent")))))
    parts = F.split("player_name", " ", 2)
    r = roster.where(F.size(parts) == 2).select("team_id", "player_id", F.concat(F.substring(parts[0], 1, 1), F.lit(". "), parts[1]).alias("_short"))
    j = g.withColumn("_names", F.split("lineup", " - ")).join(r, "team_id", "left")
    fits = F.exists("_names", lambda n: F.contains(n, F.col("_short")))
    return j.groupBy("team_id", "kind", "lineup", "gp").agg(F.array_sort(F.collect_set(F.when(fits, F.col("player_id")))).alias("player_ids"))


# -- names and codes -------------------------------------------------------------------------------------------------


def lower_names(df: DataFrame) -> DataFrame:
    """The same rows with all column and field names in lower case, nested ones too."""
    def low(kind):
        if isinstance(kind, T.StructType):
            return T.StructType([T.StructField(f.name.lower(), low(f.dataType), f.nullable) for f in kind.fields])
        if isinstance(kind, T.ArrayType):
            return T.ArrayType(low(kind.elementType), kind.containsNull)
        return T.MapType(kind.keyType, low(kind.valueType), kind.valueContainsNull) if isinstance(kind, T.MapType) else kind

    return df.select(*(F.col(f"`{f.name}`").cast(low(f.dataType)).alias(f.name.lower()) for f in df.schema.fields))


def is_player_id(c: Column) -> Column:
    n = c.cast("string").try_cast("long")
    return F.coalesce((n > 0) & (n < 10_000_000), F.lit(False))


def is_team_id(c: Column) -> Column:
    n = c.cast("string").try_cast("long")
    return F.coalesce((n > 1_610_600_000) & (n < 1_610_612_800), F.lit(False))


def is_page_season(c: Column) -> Column:
    """Seasons that pages may be asked for: 2010 to 2025."""
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}$") & F.substring(c, 1, 4).try_cast("int").between(2010, 2025), F.lit(False))
