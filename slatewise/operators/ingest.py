"""Landed records to game, line, odds and identity rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatewise.functions.parsing import canonical, date_only, did_not_play, eastern_date, is_regular, season_of, season_of_label, season_type, seconds, surrogate_id

#: Bookmakers in the order of the consensus line.
BOOKS = ("fanduel", "draftkings", "betmgm", "pointsbet", "caesars")
STATS = ("points", "assists", "rebounds", "steals", "blocks", "turnovers")


def first_of(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def game_rows(games: DataFrame) -> DataFrame:
    """Regular-season games of the games file with a date; a game without scores has 0."""
    points = lambda side: F.coalesce(F.col(f"scores.{side}.points"), F.lit(0))
    rows = games.where(is_regular(F.col("stage"), F.col("league"))).select(
        F.col("id").cast("long").alias("game_id"), date_only(F.col("date.start")).alias("date"), "season", F.col("teams.home.id").alias("home_team_id"), F.col("teams.visitors.id").alias("away_team_id"), points("home").alias("home_score"), points("visitors").alias("away_score")
    )
    return rows.where("date is not null")


def dimension(rows: DataFrame, key: str, order: str, last: bool = True) -> DataFrame:
    """One row per key: that of the last (or first) ``order``."""
    return first_of(rows, [key], F.desc(order) if last else F.asc(order))


def line_rows(lines: DataFrame) -> DataFrame:
    """Lines of the player-stat file of players who played, one per game and player, with seconds."""
    played = lines.where(~did_not_play(F.col("comment"), seconds(F.col("min")), F.col("points"), F.col("totReb"), F.col("assists"), F.col("steals"), F.col("blocks"), F.col("turnovers")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return played.select(
        F.col("game.id").cast("long").alias("game_id"), F.col("player.id").cast("long").alias("player_id"), F.col("team.id").alias("team_id"), seconds(F.col("min")).alias("secs"), *[zero("totReb" if s == "rebounds" else s).alias(s) for s in STATS]
    ).dropDuplicates(["game_id", "player_id"])


def split_orphans(lines: DataFrame, game: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of known games, and the others with a reason."""
    return lines.join(game.select("game_id"), "game_id", "left_semi"), lines.join(game.select("game_id"), "game_id", "left_anti").withColumn("reason", F.lit("NO_GAME_MATCH"))


def game_date(date: Column, time: Column) -> Column:
    """A box score's date: its own, else the Eastern date of its tip-off."""
    return F.coalesce(date_only(date), eastern_date(time.try_cast("timestamp")))


def box_games(box: DataFrame) -> DataFrame:
    """A game row per box score, with its season, its kind of season and defaults for what is missing."""
    date = game_date(F.col("date"), F.col("gameTimeUTC"))
    return box.select(
        F.col("gameId").alias("source_id"), date.alias("date"), F.coalesce(season_of_label(F.col("season")), season_of(date)).alias("season"), season_type(F.col("gameId")).alias("season_type"), "homeTeamId", "awayTeamId",
        F.coalesce("homeScore", F.lit(0)).alias("home_score"), F.coalesce("awayScore", F.lit(0)).alias("away_score"), F.coalesce("status", F.lit("Final")).alias("status"),
    )


def box_lines(box: DataFrame) -> DataFrame:
    """A line per player of each box score, under new or old field names; shooting splits stay null where missing."""
    p = box.select(F.col("gameId").alias("source_id"), F.inline("playerStats"))
    either = lambda *names: F.coalesce(*names)
    base = {"points": either("points"), "assists": either("assists"), "rebounds": either("rebounds", "reboundsTotal"), "steals": either("steals"), "blocks": either("blocks"), "turnovers": either("turnovers")}
    splits = {"fga": ("fga", "fieldGoalsAttempted"), "fg3m": ("fg3m", "threePointersMade"), "fg3a": ("fg3a", "threePointersAttempted"), "ftm": ("ftm", "freeThrowsMade"), "fta": ("fta", "freeThrowsAttempted"), "oreb": ("oreb", "reboundsOffensive")}
    own = p.where(F.coalesce("personId", "playerId").isNotNull() & ~did_not_play(F.col("comment"), seconds(F.col("minutes")), *base.values()))
    return own.select("source_id", F.coalesce("personId", "playerId").alias("player_id"), F.col("teamId").alias("team_id"), seconds(F.col("minutes")).alias("secs"), *[F.coalesce(c, F.lit(0)).alias(n) for n, c in base.items()], *[either(*c).alias(n) for n, c in splits.items()])


def enriched(game_lines: DataFrame, box: DataFrame) -> DataFrame:
    """Stored lines (game_id, player_id, ...) with splits of ``box`` lines where they lack them; their base stats stay."""
    splits = ("fga", "fg3m", "fg3a", "ftm", "fta", "oreb")
    new = box.select("game_id", "player_id", *[F.col(c).alias(f"_{c}") for c in splits])
    return game_lines.join(new, ["game_id", "player_id"], "left").select(*[F.coalesce(c, f"_{c}").alias(c) if c in splits else F.col(c) for c in game_lines.columns])


def substrings(text: Column, least: int = 1) -> Column:
    """All different substrings of a short text: what it contains becomes an equality."""
    n = F.length(text)
    of = lambda a: F.transform(F.sequence(F.lit(least), n - a + 1), lambda k: F.substring(text, a, k))
    return F.when(n >= least, F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n - least + 1), of)))).otherwise(F.array().cast("array<string>"))


def canonical_names(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, canonical) of each different ``name``: its letters are an alias, or else hold or are held in the first of ``aliases`` (place, alias,
    canonical); what no alias fits keeps its letters.

    Digits go with all else that is no letter, so a name with digits is found by its other letters. Parts meet on equality."""
    n = names.select("name").distinct().withColumn("plain", F.regexp_replace(F.lower("name"), "[^a-z]", ""))
    exact = n.join(aliases.select(F.col("alias").alias("plain"), "canonical"), "plain")
    rest = n.join(aliases.select(F.col("alias").alias("plain")), "plain", "left_anti")
    held = rest.withColumn("alias", F.explode(substrings(F.col("plain"), 2))).join(aliases, "alias")
    holds = rest.join(aliases.withColumn("plain", F.explode(substrings(F.col("alias")))), "plain")
    cols = ["name", "plain", "place", "canonical"]
    part = first_of(held.select(*cols).unionByName(holds.select(*cols)), ["name"], "place").select("name", "canonical")
    found = exact.select("name", "canonical").dropDuplicates(["name"]).unionByName(part)
    return n.join(found, "name", "left").select("name", F.coalesce("canonical", "plain").alias("canonical"))


def find_teams(asked: DataFrame, team: DataFrame) -> DataFrame:
    """``asked`` (code, name, city) with the smallest team_id that has the code, or whose name or city holds the name or city in any case."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    parts = team.select("team_id", F.col("code").alias("_code"), low("name").alias("_name"), low("city").alias("_city"))
    q = asked.select("code", "name", "city").distinct()
    by = [q.join(parts.select("team_id", F.col("_code").alias("code")), "code")]
    for c in ("name", "city"):
        words = parts.select("team_id", F.explode(substrings(F.col(f"_{c}"))).alias("_part"))
        by.append(q.withColumn("_part", low(c)).where("_part <> ''").join(words, "_part").drop("_part"))
    found = by[0].select("code", "name", "city", "team_id")
    for other in by[1:]:
        found = found.unionByName(other.select("code", "name", "city", "team_id"))
    one = found.groupBy("code", "name", "city").agg(F.min("team_id").alias("team_id"))
    same = lambda c: F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return asked.alias("a").join(one.alias("b"), same("code") & same("name") & same("city"), "left").select("a.*", "b.team_id")


def resolve(events: DataFrame, game: DataFrame, team: DataFrame, known: DataFrame, with_context: DataFrame) -> DataFrame:
    """event_id with the game_id that it means and how it was found: 1 by a known id, 2 by the surrogate of its id, by Eastern date and teams on either side
    3 among games of ``with_context`` (game_id), 4 among all, 5 a game to be created under its surrogate; null and 9 where a team is unknown.

    ``events``: event_id, commence_time (UTC), home_team, away_team. ``known``: event_id, game_id."""
    t = team.select("team_id", canonical(F.col("name")).alias("name"))
    e = events.select("event_id", eastern_date(F.col("commence_time").try_cast("timestamp")).alias("date"), canonical(F.col("home_team")).alias("h"), canonical(F.col("away_team")).alias("a")).dropDuplicates(["event_id"]).withColumn("own", surrogate_id(F.col("event_id")))
    e = e.join(t.select(F.col("team_id").alias("home_team_id"), F.col("name").alias("h")), "h", "left").join(t.select(F.col("team_id").alias("away_team_id"), F.col("name").alias("a")), "a", "left")
    pair = lambda df: df.withColumns({"low": F.least("home_team_id", "away_team_id"), "high": F.greatest("home_team_id", "away_team_id")})
    both = e.where("home_team_id is not null and away_team_id is not null")
    g = pair(game).join(with_context.select("game_id", F.lit(3).alias("how")), "game_id", "left").fillna(4, ["how"])
    # of a date's games of two teams only the first can be meant: events don't meet all of them
    g = g.groupBy("date", "low", "high").agg(F.min(F.when(F.col("how") == 3, F.col("game_id"))).alias("_3"), F.min("game_id").alias("_4")).select("date", "low", "high", F.when(F.col("_3").isNotNull(), 3).otherwise(4).alias("how"), F.coalesce("_3", "_4").alias("game_id"))
    met = pair(both).join(g, ["date", "low", "high"]).select("event_id", "game_id", "how")
    by_own = e.join(game.select(F.col("game_id").alias("own")), "own").select("event_id", F.col("own").alias("game_id"), F.lit(2).alias("how"))
    made = both.select("event_id", F.col("own").alias("game_id"), F.lit(5).alias("how"))
    ways = known.select("event_id", "game_id", F.lit(1).alias("how")).unionByName(by_own).unionByName(met).unionByName(made)
    least = ways.groupBy("event_id").agg(*[F.min(F.when(F.col("how") == n, F.col("game_id"))).alias(f"_{n}") for n in (1, 2, 3, 4, 5)])
    found = least.select("event_id", F.coalesce(*[F.when(F.col(f"_{n}").isNotNull(), n) for n in (1, 2, 3, 4, 5)]).alias("how"), F.coalesce(*[f"_{n}" for n in (1, 2, 3, 4, 5)]).alias("game_id"))
    return e.select("event_id").join(found, "event_id", "left").fillna(9, ["how"])


def created_games(events: DataFrame, resolved: DataFrame, team: DataFrame) -> DataFrame:
    """Game rows for the events that ``resolve`` could only create: scheduled, without scores, under the surrogate of the event's id."""
    name = lambda s: team.select(F.col("team_id").alias(f"{s}_team_id"), canonical(F.col("name")).alias(f"{s}_key"))
    e = events.join(resolved.where("how = 5").select("event_id", "game_id"), "event_id").withColumns({"home_key": canonical(F.col("home_team")), "away_key": canonical(F.col("away_team")), "date": eastern_date(F.col("commence_time").try_cast("timestamp"))})
    own = e.join(name("home"), "home_key").join(name("away"), "away_key")
    return own.select("game_id", "date", season_of(F.col("date")).cast("int").alias("season"), "home_team_id", "away_team_id", F.lit(0).alias("home_score"), F.lit(0).alias("away_score"), F.lit("Scheduled").alias("status")).dropDuplicates(["game_id"])


def market_pivot(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """One row per game and book of its outcome rows (market, name, price, point, home_team, away_team)."""
    name, home, away = canonical(F.col("name")), canonical(F.col("home_team")), canonical(F.col("away_team"))
    pick = lambda market, who, value, alias: F.max(F.when((F.col("market") == market) & who, F.col(value))).alias(alias)
    return outcomes.groupBy(*by).agg(
        pick("spreads", name == home, "point", "spread_home"), pick("spreads", name == away, "point", "spread_away"), pick("totals", F.col("name") == "Over", "point", "total_over"),
        pick("totals", F.col("name") == "Under", "point", "total_under"), pick("h2h", name == home, "price", "ml_home"), pick("h2h", name == away, "price", "ml_away"),
    )


def consensus(lines: DataFrame) -> DataFrame:
    """Per game the line of the first of BOOKS that has a spread or a total."""
    place = F.array_position(F.array(*[F.lit(b) for b in BOOKS]), F.col("book"))
    return first_of(lines.where((place > 0) & (F.col("spread_home").isNotNull() | F.col("total_over").isNotNull())), ["game_id"], place, "book").withColumn("book", F.lit("consensus"))


def over_under(props: DataFrame, by: list[str]) -> DataFrame:
    """Prop outcomes (description: player, name: Over or Under, price, point) as one line per player, book and market; without a point there is none."""
    pick = lambda name, value: F.max(F.when(F.col("name") == name, F.col(value)))
    line = F.coalesce(pick("Over", "point"), pick("Under", "point"))
    return props.groupBy(*by, "book", "market", F.col("description").alias("player")).agg(line.alias("line"), pick("Over", "price").alias("over_odds"), pick("Under", "price").alias("under_odds")).where("line is not null")


def match_players(names: DataFrame, player: DataFrame, start: bool = False) -> DataFrame:
    """``names`` (name) with the smallest player_id whose first name holds its first word and last name the others (with ``start``: begins with
    them); null with fewer than two words. A trailing "jr." doesn't count.

    They meet on equality with the parts of last names, of which a name has few."""
    words = F.split(F.lower(F.trim(F.regexp_replace("name", r"(?i)\s+jr\.?$", ""))), r"\s+")
    n = names.select("name").distinct().withColumns({"first": words[0], "rest": F.when(F.size(words) >= 2, F.concat_ws(" ", F.slice(words, 2, 10)))})
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.length(low("lastname")), F.lit(1))), lambda k: F.substring(low("lastname"), 1, k)) if start else substrings(low("lastname"))
    p = player.select("player_id", low("firstname").alias("f"), F.explode(parts).alias("rest"))
    fits = F.col("f").startswith(F.col("first")) if start else F.col("f").contains(F.col("first"))
    met = n.join(p, "rest").where(fits).groupBy("name").agg(F.min("player_id").alias("player_id"))
    return names.join(met, "name", "left")


def to_insert(new: DataFrame, game: DataFrame) -> DataFrame:
    """Upcoming games that no stored game has on the same date, also not with its sides swapped."""
    key = [F.col("date"), F.least("home_team_id", "away_team_id").alias("low"), F.greatest("home_team_id", "away_team_id").alias("high")]
    return new.select("*", *key[1:]).join(game.select(*key), ["date", "low", "high"], "left_anti").select(*new.columns)


def gaps(days: DataFrame, until: str | None = None) -> DataFrame:
    """Dates between the first and the last of ``days`` (or ``until``) that are missing."""
    last = F.max("date") if until is None else F.lit(until).cast("date")
    every = days.agg(F.min("date").alias("a"), last.alias("b")).where("a <= b").select(F.explode(F.sequence("a", "b")).alias("date"))
    return every.join(days.select("date").distinct(), "date", "left_anti")


def completed(games: DataFrame) -> DataFrame:
    return games.where(F.upper("status").startswith("FINAL"))


def audit(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Per season how many expected games (season, source_id) were found (season, source_id, corrupt), are missing, unasked-for or corrupt."""
    e, f = expected.select("season", "source_id").distinct().withColumn("e", F.lit(1)), found.groupBy("season", "source_id").agg(F.max(F.coalesce("corrupt", F.lit(False))).alias("corrupt")).withColumn("f", F.lit(1))
    both = e.join(f, ["season", "source_id"], "full_outer")
    return both.groupBy("season").agg(F.count("e").alias("expected"), F.count("f").alias("found"), F.count_if(F.col("f").isNull()).alias("missing"), F.count_if(F.col("e").isNull()).alias("orphan"), F.count_if(F.coalesce("corrupt", F.lit(False))).alias("corrupted"))


def complete_dates(board: DataFrame, box: DataFrame) -> DataFrame:
    """Per date of a scoreboard (date, source_id) whether every game has a box score (source_id)."""
    both = board.select("date", "source_id").distinct().join(box.select("source_id").distinct().withColumn("has", F.lit(True)), "source_id", "left")
    return both.groupBy("date").agg(F.count("*").alias("games"), F.count("has").alias("found"), F.every(F.coalesce("has", F.lit(False))).alias("complete"))


# ---- ids of other sources
def known_teams(rows: DataFrame, teams: DataFrame, column: str = "provider_id") -> DataFrame:
    """``rows`` with team_id for their provider's id; rows of a team that ``teams`` (provider_id, team_id) lacks go."""
    return rows.join(teams.select(F.col("provider_id").alias(column), "team_id"), column)


def crosswalk(kind: str, source: str, rows: DataFrame, source_id: str, internal_id: str) -> DataFrame:
    """(entity_type, source, source_id, internal_id) of ``rows``, the internal id under the prefix of its kind."""
    return rows.where(F.col(source_id).isNotNull()).select(F.lit(kind).alias("entity_type"), F.lit(source).alias("source"), F.col(source_id).cast("string").alias("source_id"), F.concat(F.lit(f"{kind.lower()}_"), F.col(internal_id).cast("string")).alias("internal_id"))


def without_external(game: DataFrame, known: DataFrame) -> DataFrame:
    """(game_id, source_id) of games with a positive source id that no row of ``known`` (game_id) has."""
    return game.where("source_id > 0").select("game_id", "source_id").join(known.select("game_id"), "game_id", "left_anti")


def provider_ids(game: DataFrame, known: DataFrame) -> DataFrame:
    """(game_id, provider_id): the external id of ``known`` (game_id, external_id), else a positive source id; null without either."""
    one = known.groupBy("game_id").agg(F.min("external_id").alias("external_id"))
    return game.join(one, "game_id", "left").select("game_id", F.coalesce("external_id", F.when(F.col("source_id") > 0, F.col("source_id").cast("string"))).alias("provider_id"))


# ---- changes of stored games
def updated_scores(game: DataFrame, box: DataFrame) -> DataFrame:
    """``game`` with the scores and status of ``box`` (game_id, home_score, away_score, status), where that has a score and the stored game has none or isn't final."""
    b = first_of(box, ["game_id"], F.desc("home_score"), F.desc("away_score")).select("game_id", *[F.col(c).alias(f"_{c}") for c in ("home_score", "away_score", "status")])
    g = game.join(b, "game_id", "left")
    better = (F.coalesce("_home_score", F.lit(0)) > 0) & ((F.coalesce("home_score", F.lit(0)) == 0) | (F.coalesce("status", F.lit("")) != "Final"))
    return g.select(*[F.when(better, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in ("home_score", "away_score", "status") else F.col(c) for c in game.columns])


def enriched_games(box: DataFrame, game: DataFrame) -> DataFrame:
    """(source_id, game_id, swapped): the stored game that each box score (source_id, date, home_team_id, away_team_id) means, by date and teams on either side."""
    pair = [F.least("home_team_id", "away_team_id").alias("low"), F.greatest("home_team_id", "away_team_id").alias("high")]
    b = box.select("source_id", "date", *pair, F.col("home_team_id").alias("_home"))
    one = game.select("date", "home_team_id", *pair, "game_id").groupBy("date", "home_team_id", "low", "high").agg(F.min("game_id").alias("game_id"))  # the first of those alike
    met = b.join(one, ["date", "low", "high"])
    return first_of(met.select("source_id", "game_id", (F.col("_home") != F.col("home_team_id")).alias("swapped")), ["source_id"], "swapped", "game_id")


def same_day(events: DataFrame, day: str = "day") -> DataFrame:
    """Odds events whose tip-off falls on the Eastern date of their file (``day``)."""
    return events.where(eastern_date(F.col("commence_time").try_cast("timestamp")) == F.col(day))


def schedule_from_logs(logs: DataFrame) -> DataFrame:
    """(game_id, date, team_id, is_home, points): one row per game of team logs (game_id, game_date, team_id, matchup, points): the one that was fetched first, where
    logs have ``fetched``, else that of the smaller team id; at home where the match-up says "vs."."""
    one = first_of(logs, ["game_id"], *(["fetched"] if "fetched" in logs.columns else []), "team_id")
    return one.select("game_id", date_only(F.col("game_date")).alias("date"), "team_id", F.col("matchup").contains(" vs. ").alias("is_home"), F.coalesce("points", F.lit(0)).alias("points"))


# ---- contracts of shape
def _told(required: list[str], lists: list[str]) -> list[Column]:
    return [F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in required] + [F.when(F.size(F.col(c)) == 0, F.lit(f"empty {c}")) for c in lists]


def issues(rows: DataFrame, required: list[str], lists: list[str] = ()) -> DataFrame:
    """``rows`` with ``issues``: a text for each of ``required`` (fields, dotted) that is null and each of ``lists`` that is empty."""
    return rows.withColumn("issues", F.array_compact(F.array(*_told(required, lists))))


#: What rows of games, of player lines, of box scores and of scoreboards must have.
SHAPES = {
    "games": (["id", "date.start", "teams.visitors.id", "teams.home.id", "scores.visitors.points", "scores.home.points", "season", "stage", "league"], []), "lines": (["player.id", "team.id", "game.id", "points", "assists", "totReb", "min"], []),
    "box": (["gameId", "date", "playerStats"], ["playerStats"]), "board": (["date", "games"], []),
}


def shape_report(rows: DataFrame, kind: str) -> DataFrame:
    """(issue, rows): how many rows break each rule of their kind's shape; a kind that keeps all of them gives no rows."""
    told = _told(*SHAPES[kind])
    # one row of counts: where issues are exploded, Spark looks before it whether there are any, and parses a row's JSON anew for that
    counts = rows.agg(*[F.count(t).alias(f"n{i}") for i, t in enumerate(told)], *[F.max(t).alias(f"t{i}") for i, t in enumerate(told)])
    return counts.select(F.inline(F.array(*[F.struct(F.col(f"t{i}").alias("issue"), F.col(f"n{i}").alias("rows")) for i in range(len(told))]))).where("rows > 0")
