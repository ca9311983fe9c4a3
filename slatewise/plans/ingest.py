"""Registered queries of ingest work, on records that Spark forms from the tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from slatewise.functions import parsing, teams
from slatewise.operators import ingest, night
from slatewise.plans.queries import SQL, register
from slatewise.sources import landing, sinks, versions
from slatewise.sources.fixtures import with_ctes
from slatewise.sources.kept import shared_dir

STATS = (*ingest.STATS, "fga", "fg3m", "fg3a", "ftm", "fta", "oreb")


def minutes(fx):
    m, s = F.floor(F.col("secs") / 60), F.col("secs") % 60
    kinds = [F.format_string("%d:%02d", m, s), F.format_string("PT%02dM%02d.00S", m, s), (F.col("secs") / 60).cast("string")]
    kind = F.when(F.col("player_id") % 4 == 3, "inactive").otherwise(F.get(F.array(*kinds), F.col("player_id") % 4))
    return fx.stat.select("game_id", "player_id", parsing.seconds(kind).alias("secs"))


register("ing02_minutes", minutes, with_ctes("select game_id, player_id, case when player_id % 4 = 3 then 0 else secs end secs from fx_stat"))
register("ing13_surrogate_ids", lambda fx: fx.game.select("game_id", parsing.surrogate_id(F.concat(F.lit("evt-"), "game_id")).alias("surrogate")), with_ctes(
    "select game_id, -abs(case when h >= 2147483648 then h - 4294967296 else h end) surrogate from (select game_id, list_reduce(list_prepend(0::bigint, list_transform(string_split('evt-' || game_id, ''), lambda c: ascii(c)::bigint)), lambda h, c: (h * 31 + c) % 4294967296) h from fx_game)"))


def events(fx):
    """An odds event per game: sides swapped in every fifth, an unknown team in every seventh."""
    name = lambda side: fx.team.select(F.col("team_id").alias(f"{side}_team_id"), F.col("name").alias(f"{side}_name"))
    g = fx.game.join(F.broadcast(name("home")), "home_team_id").join(F.broadcast(name("away")), "away_team_id")
    swap = F.col("game_id") % 5 == 0
    home = F.when(F.col("game_id") % 7 == 0, "Nowhere").when(swap, F.col("away_name")).otherwise(F.col("home_name"))
    return g.select(F.concat(F.lit("evt-"), "game_id").alias("event_id"), F.concat(F.col("date").cast("string"), F.lit("T23:30:00Z")).alias("commence_time"), home.alias("home_team"), F.when(swap, F.col("home_name")).otherwise(F.col("away_name")).alias("away_team"))


def with_context(fx):
    return fx.game.where("game_id % 2 = 0").select("game_id")


def known_events(fx):
    return fx.game.where("game_id % 11 = 0").select(F.concat(F.lit("evt-"), "game_id").alias("event_id"), "game_id")


resolved = lambda fx: fx.once("resolved", lambda fx: ingest.resolve(events(fx), stored_games(fx), fx.team, known_events(fx), with_context(fx)))


def stored_games(fx):
    """All games but one in thirteen, and one made earlier from an odds event in each seventeen under its surrogate id."""
    surrogate = parsing.surrogate_id(F.concat(F.lit("evt-"), "game_id"))
    return fx.game.where("game_id % 13 <> 0").unionByName(fx.game.where("game_id % 17 = 0").withColumn("game_id", surrogate))


HASHED = {
    "hashed": "select game_id, -abs(case when h >= 2147483648 then h - 4294967296 else h end) surrogate from (select game_id, list_reduce(list_prepend(0::bigint, list_transform(string_split('evt-' || game_id, ''), lambda c: ascii(c)::bigint)), lambda h, c: (h * 31 + c) % 4294967296) h from fx_game)",
    "held": "select game_id, date, home_team_id, away_team_id from fx_game where game_id % 13 <> 0 union all select surrogate, date, home_team_id, away_team_id from fx_game join hashed using (game_id) where game_id % 17 = 0",
    "options": "select g.game_id evt, g.game_id, 1 how from fx_game g where game_id % 11 = 0 union all select game_id, surrogate, 2 from hashed where surrogate in (select game_id from held) "
    "union all select g.game_id, o.game_id, case when o.game_id % 2 = 0 and o.game_id > 0 then 3 else 4 end from fx_game g join held o on o.date = g.date and least(o.home_team_id, o.away_team_id) = least(g.home_team_id, g.away_team_id) and greatest(o.home_team_id, o.away_team_id) = greatest(g.home_team_id, g.away_team_id) where g.game_id % 7 <> 0 union all select game_id, surrogate, 5 from hashed where game_id % 7 <> 0",
    "resolved": "select 'evt-' || g.game_id event_id, g.game_id evt, o.game_id, coalesce(how, 9) how from fx_game g left join (select *, row_number() over (partition by evt order by how, game_id) n from options) o on o.evt = g.game_id and n = 1",
}
register("ing12_resolve", lambda fx: resolved(fx).select("event_id", "game_id", "how"), with_ctes("select event_id, game_id, how from resolved", HASHED))
register("ing12_created", lambda fx: ingest.created_games(events(fx), resolved(fx), fx.team), with_ctes("select r.game_id, g.date, g.season, case when evt % 5 = 0 then away_team_id else home_team_id end home_team_id, case when evt % 5 = 0 then home_team_id else away_team_id end away_team_id, 0 home_score, 0 away_score, 'Scheduled' status from resolved r join fx_game g on g.game_id = r.evt where how = 5", HASHED))


def provider_rows(fx):
    """A row per game from a provider that knows its own team ids; two in a hundred are of no team."""
    return fx.game.select("game_id", (F.lit(1610612736) + F.when(F.col("game_id") % 50 == 3, 99).otherwise(F.col("home_team_id"))).alias("provider_id"))


def provider_teams(fx):
    return fx.team.select((F.lit(1610612736) + F.col("team_id")).alias("provider_id"), "team_id")


register("ing08_provider_teams", lambda fx: ingest.known_teams(provider_rows(fx), provider_teams(fx)).select("game_id", "team_id"), with_ctes("select game_id, home_team_id team_id from fx_game where game_id % 50 <> 3"))
ALIASES = {"called": "select row_number() over (order by team_id) - 1 place, lower(regexp_replace(translate(name, '0123456789_', 'abcdefghij '), '[^A-Za-z]', '', 'g')) al, 'team' || team_id canonical from fx_team"}


def alias_rows(fx):
    return fx.team.select((F.row_number().over(Window.orderBy("team_id")) - 1).alias("place"), F.regexp_replace(F.lower(F.translate("name", "0123456789_", "abcdefghij ")), "[^a-z]", "").alias("alias"), F.concat(F.lit("team"), "team_id").alias("canonical"))


def spoken_names(fx):
    """The home team's name of each game as it is, with words around it, or cut short; one in seven is nobody's."""
    n = fx.team.select(F.col("team_id").alias("home_team_id"), F.translate("name", "0123456789_", "abcdefghij ").alias("name"))
    k = F.col("game_id") % 7
    return fx.game.join(F.broadcast(n), "home_team_id").select("game_id", F.when(k == 0, "Q-9").when(k < 3, F.col("name")).when(k < 5, F.concat(F.lit("The "), "name", F.lit(" 76"))).otherwise(F.expr("substring(name, 1, 4)")).alias("name"))


SPOKEN = ALIASES | {"spoken": "select game_id, case when game_id % 7 = 0 then 'Q-9' when game_id % 7 < 3 then name when game_id % 7 < 5 then 'The ' || name || ' 76' else substr(name, 1, 4) end as name from fx_game join (select team_id, translate(name, '0123456789_', 'abcdefghij ') as name from fx_team) on team_id = home_team_id", "plain": "select distinct name, lower(regexp_replace(name, '[^A-Za-z]', '', 'g')) p from spoken"}
register("ing09_canonical", lambda fx: spoken_names(fx).join(ingest.canonical_names(spoken_names(fx), alias_rows(fx)), "name").select("game_id", "canonical"), with_ctes(
    "select game_id, coalesce(e.canonical, f.canonical, p) canonical from spoken s join plain using (name) left join called e on e.al = p left join (select name, arg_min(canonical, place) canonical from plain join called on (contains(p, al) and length(al) >= 2) or contains(al, p) group by name) f on f.name = s.name", SPOKEN))
register("ing10_find_teams", lambda fx: ingest.find_teams(spoken_names(fx).select("game_id", F.when(F.col("game_id") % 3 == 0, F.concat(F.lit("N"), (F.col("game_id") % 30).cast("string"))).alias("code"), F.col("name"), F.lit(None).cast("string").alias("city")), fx.team.withColumn("name", F.translate("name", "0123456789_", "abcdefghij "))).select("game_id", "team_id"), with_ctes(
    "select game_id, (select min(team_id) from fx_team t where t.code = case when s.game_id % 3 = 0 then 'N' || s.game_id % 30 end or contains(lower(translate(t.name, '0123456789_', 'abcdefghij ')), lower(s.name))) team_id from spoken s", SPOKEN))


def people(fx):
    return fx.stat.select("player_id").distinct().select("player_id", F.concat(F.lit("First"), (F.col("player_id") % 10).cast("string")).alias("firstname"), F.concat(F.lit("Last"), F.col("player_id").cast("string")).alias("lastname"))


def said_names(fx):
    return fx.stat.select("game_id", "player_id", F.concat(F.lit("first"), F.when(F.col("game_id") % 4 == 0, "").otherwise((F.col("player_id") % 10).cast("string")), F.lit(" Last"), "player_id", F.when(F.col("game_id") % 2 == 0, " Jr.").otherwise("")).alias("name"))


for _name, _start in (("ing11_players", False), ("ing11_players_start", True)):
    _fit = "starts_with" if _start else "contains"
    register(_name, lambda fx, start=_start: ingest.match_players(said_names(fx).select("game_id", "name"), people(fx), start).select("game_id", "name", "player_id"), with_ctes(
        f"select s.game_id, s.name, m.player_id from said s left join (select n.name, min(p.player_id) player_id from (select distinct name, split_part(regexp_replace(lower(name), ' jr\\.$', ''), ' ', 1) f, split_part(regexp_replace(lower(name), ' jr\\.$', ''), ' ', 2) l from said) n join people p on {_fit}('last' || p.player_id, n.l) and {_fit}('first' || p.player_id % 10, n.f) group by n.name) m on m.name = s.name",
        {"people": "select distinct player_id from fx_stat", "said": "select game_id, player_id, 'first' || case when game_id % 4 = 0 then '' else cast(player_id % 10 as varchar) end || ' Last' || player_id || case when game_id % 2 = 0 then ' Jr.' else '' end as name from fx_stat"}))
_SOURCED = "case when game_id % 9 = 0 then -game_id else game_id + 20000 end"


def sourced(fx):
    return fx.game.withColumn("source_id", F.expr(_SOURCED))


def external(fx):
    return fx.game.where("game_id % 4 = 1").select("game_id", F.concat(F.lit("x"), "game_id").alias("external_id"))


register("ing22_without_external", lambda fx: ingest.without_external(sourced(fx), external(fx)), with_ctes(f"select game_id, {_SOURCED} source_id from fx_game where game_id % 9 <> 0 and game_id % 4 <> 1"))
register("ing23_provider_ids", lambda fx: ingest.provider_ids(sourced(fx), external(fx)), with_ctes("select game_id, case when game_id % 4 = 1 then 'x' || game_id when game_id % 9 <> 0 then cast(game_id + 20000 as varchar) end provider_id from fx_game"))
register("snk07_crosswalk", lambda fx: sinks.merged(ingest.crosswalk("GAME", "odds_api", external(fx), "external_id", "game_id"), ingest.crosswalk("GAME", "odds_api", known_events(fx), "event_id", "game_id").unionByName(ingest.crosswalk("TEAM", "league", provider_teams(fx), "provider_id", "team_id")), ["entity_type", "source", "source_id"]), with_ctes(
    "select 'GAME' entity_type, 'odds_api' source, 'x' || game_id source_id, 'game_' || game_id internal_id from fx_game where game_id % 4 = 1 union all select 'GAME', 'odds_api', 'evt-' || game_id, 'game_' || game_id from fx_game where game_id % 11 = 0 union all select 'TEAM', 'league', cast(1610612736 + team_id as varchar), 'team_' || team_id from fx_team"))


def late_scores(fx):
    """Box scores of even games: without a score in every sixth."""
    zero = F.col("game_id") % 6 == 0
    return fx.game.where("game_id % 2 = 0").select("game_id", F.when(zero, 0).otherwise(F.lit(101)).alias("home_score"), F.when(zero, 0).otherwise(F.lit(99)).alias("away_score"), F.lit("Final").alias("status"))


_better = "game_id % 2 = 0 and game_id % 6 <> 0 and (home_score = 0 or status <> 'Final')"
register("ing20_scores", lambda fx: ingest.updated_scores(fx.game, late_scores(fx)).select("game_id", "home_score", "away_score", "status"), with_ctes(f"select game_id, case when {_better} then 101 else home_score end home_score, case when {_better} then 99 else away_score end away_score, case when {_better} then 'Final' else status end status from fx_game"))
register("ing19_enriched_games", lambda fx: ingest.enriched_games(fx.game.where("status = 'Final'").select(F.concat(F.lit("002"), "game_id").alias("source_id"), "date", F.expr("case when game_id % 5 = 0 then away_team_id else home_team_id end").alias("home_team_id"), F.expr("case when game_id % 5 = 0 then home_team_id else away_team_id end").alias("away_team_id")), fx.game), with_ctes(
    "select source_id, game_id, swapped from (select '002' || b.game_id source_id, g.game_id, (case when b.game_id % 5 = 0 then b.away_team_id else b.home_team_id end) <> g.home_team_id swapped, row_number() over (partition by b.game_id order by (case when b.game_id % 5 = 0 then b.away_team_id else b.home_team_id end) <> g.home_team_id, g.game_id) n from fx_game b join fx_game g on g.date = b.date and least(g.home_team_id, g.away_team_id) = least(b.home_team_id, b.away_team_id) and greatest(g.home_team_id, g.away_team_id) = greatest(b.home_team_id, b.away_team_id) where b.status = 'Final') where n = 1"))
register("ing19_enriched_lines", lambda fx: ingest.enriched(fx.stat.withColumn("fga", F.expr("case when game_id % 3 = 0 then fga end")), fx.stat.where("game_id % 2 = 0")).select("game_id", "player_id", "fga", "fg3m", "points"), with_ctes("select game_id, player_id, case when game_id % 3 = 0 or game_id % 2 = 0 then fga end fga, fg3m, points from fx_stat"))
register("ing24_dimension", lambda fx: ingest.dimension(fx.stat.withColumn("at", F.col("game_id") * 1000 + F.col("team_id")), "player_id", "at").select("player_id", "team_id", "game_id"), with_ctes("select player_id, team_id, game_id from (select *, row_number() over (partition by player_id order by game_id * 1000 + team_id desc) n from fx_stat) where n = 1"))
register("ing26_same_day", lambda fx: ingest.same_day(fx.game.select("game_id", F.col("date").alias("day"), F.concat(F.date_add("date", F.when(F.col("game_id") % 3 == 0, 1).otherwise(0)).cast("string"), F.when(F.col("game_id") % 3 < 2, "T01:30:00Z").otherwise("T22:00:00Z")).alias("commence_time"))).select("game_id"), with_ctes("select game_id from fx_game where game_id % 3 <> 1"))
register("ing30_schedule", lambda fx: ingest.schedule_from_logs(fx.game.select("game_id", F.concat(F.col("date").cast("string"), F.lit("T00:00:00")).alias("game_date"), F.expr("stack(2, home_team_id, home_score, 'AAA vs. BBB', away_team_id, away_score, 'BBB @ AAA') as (team_id, points, matchup)"))), with_ctes("select game_id, date, least(home_team_id, away_team_id) team_id, home_team_id < away_team_id is_home, case when home_team_id < away_team_id then home_score else away_score end points from fx_game"))


_logs = "stack(2, home_team_id, home_score, 'AAA vs. BBB', away_team_id, away_score, 'BBB @ AAA') as (team_id, points, matchup)"
register("ing30_fetched", lambda fx: ingest.schedule_from_logs(fx.game.select("game_id", F.concat(F.col("date").cast("string"), F.lit("T00:00:00")).alias("game_date"), F.expr(_logs)).withColumn("fetched", (F.col("game_id") + F.col("team_id")) % 3)), with_ctes(
    "select game_id, date, team_id, is_home, points from (select *, row_number() over (partition by game_id order by (game_id + team_id) % 3, team_id) n from (select game_id, date, home_team_id team_id, true is_home, home_score points from fx_game union all select game_id, date, away_team_id, false, away_score from fx_game)) where n = 1"))


def seeded_teams(fx):
    """The league's teams merged into the table of those that games have."""
    seed = fx.spark.createDataFrame([(t, n, c, y) for t, _, c, y, n in teams.TEAMS], "team_id int, name string, code string, city string")
    return sinks.merged(fx.team.select("team_id", "name", "code", "city"), seed, ["team_id"]).join(fx.game.groupBy(F.col("home_team_id").alias("team_id")).agg(F.count("*").alias("home_games")), "team_id", "left").fillna(0, ["home_games"])


register("ing28_teams", seeded_teams, with_ctes("select t.*, coalesce(n, 0) home_games from (values " + ", ".join(f"({t}, '{n}', '{c}', '{y}')" for t, _, c, y, n in teams.TEAMS) + ") t(team_id, name, code, city) left join (select home_team_id h, count(*) n from fx_game group by h) on h = t.team_id"))


def table_of(fx, name: str) -> str:
    return f"{shared_dir(fx.spark)}/{name}-{uuid.uuid4().hex}"


def upserted(fx):
    """A table of games by month; then the even ones arrive again, every fourth a week later."""
    path = table_of(fx, "games")
    month = lambda df: df.withColumn("month", F.date_format("date", "yyyy-MM"))
    sinks.upsert(month(fx.game), path, ["game_id"], "month")
    moved = F.when(F.col("game_id") % 4 == 0, F.date_add("date", 7)).otherwise(F.col("date"))
    sinks.upsert(month(fx.game.where("game_id % 2 = 0").withColumns({"date": moved, "status": F.lit("Corrected")})), path, ["game_id"], "month")
    return fx.spark.read.schema(month(fx.game).schema).parquet(path)


register("snk01_upsert", lambda fx: upserted(fx).select("game_id", "date", "status"), with_ctes("select game_id, cast(case when game_id % 4 = 0 then date + 7 else date end as date) date, case when game_id % 2 = 0 then 'Corrected' else status end status from fx_game"))
def rewritten(fx):
    """Team nights by season; then the nights of 1996 are written anew, twice the points."""
    path, nights = table_of(fx, "nights"), night.team_night(fx.stat).select("date", "season", "team_id", "points")
    sinks.replace_partitions(nights, path, "season")
    sinks.replace_partitions(nights.where("season = 1996").withColumn("points", F.col("points") * 2), path, "season")
    return fx.spark.read.schema(nights.schema).parquet(path)


register("snk04_rewrite", rewritten, with_ctes("select date, season, team_id, points * case when season = 1996 then 2 else 1 end points from team_night", night.events_sql()))
def one_team_rebuilt(fx):
    """Team nights by season; then those of team 3 in 1996 go and come again from the lines, twice the points."""
    path, nights = table_of(fx, "nights"), night.team_night(fx.stat).select("date", "season", "team_id", "points")
    sinks.replace_partitions(nights, path, "season")
    of_team = (F.col("season") == 1996) & (F.col("team_id") == 3)
    sinks.replace_range(nights.where(of_team).withColumn("points", F.col("points") * 2), path, of_team, "season")
    return fx.spark.read.schema(nights.schema).parquet(path)


register("snk03_range", one_team_rebuilt, with_ctes("select date, season, team_id, points * case when season = 1996 and team_id = 3 then 2 else 1 end points from team_night", night.events_sql()))


def reloaded(fx):
    """Games and lines committed together; then both anew for one season, read from the version before."""
    path = table_of(fx, "reloaded")
    versions.commit(fx.spark, path, games=fx.game, lines=fx.stat)
    games, lines = versions.read(fx.spark, path, "games", "lines")
    versions.commit(fx.spark, path, games=games.where("season = 1996"), lines=lines.where("season = 1996"))
    games, lines = versions.read(fx.spark, path, "games", "lines")
    return games.join(lines.groupBy("game_id").agg(F.count("*").alias("lines")), "game_id", "left").select("game_id", "date", "lines")


register("snk05_reloaded", reloaded, with_ctes("select g.game_id, g.date, n \"lines\" from fx_game g left join (select game_id, count(*) n from fx_stat group by game_id) using (game_id) where season = 1996"))


def stored_scores(fx):
    """Stored games by season take up box scores where they have none or aren't final; other rows, and seasons without such a game, stay."""
    path = table_of(fx, "scores")
    sinks.replace_partitions(fx.game, path, "season")
    better = (F.coalesce("new.home_score", F.lit(0)) > 0) & ((F.coalesce("old.home_score", F.lit(0)) == 0) | (F.coalesce("old.status", F.lit("")) != "Final"))
    sinks.merge_where(late_scores(fx), path, ["game_id"], "season", better, {c: F.col(f"new.{c}") for c in ("home_score", "away_score", "status")})
    return fx.spark.read.schema(fx.game.schema).parquet(path)


register("ing20_stored", lambda fx: stored_scores(fx).select("game_id", "home_score", "away_score", "status"), SQL["ing20_scores"])


def stored_lines(fx):
    """Stored lines by season get the splits they lack from the box scores of even games."""
    path, splits = table_of(fx, "lines"), ("fga", "fg3m", "fg3a", "ftm", "fta", "oreb")
    sinks.replace_partitions(fx.stat.withColumn("fga", F.expr("case when game_id % 3 = 0 then fga end")), path, "season")
    lacks = F.lit(False)
    for c in splits:
        lacks = lacks | (F.col(f"old.{c}").isNull() & F.col(f"new.{c}").isNotNull())
    sinks.merge_where(fx.stat.where("game_id % 2 = 0").select("game_id", "player_id", *splits), path, ["game_id", "player_id"], "season", lacks, {c: F.coalesce(f"old.{c}", f"new.{c}") for c in splits})
    return fx.spark.read.schema(fx.stat.schema).parquet(path)


register("ing19_stored", lambda fx: stored_lines(fx).select("game_id", "player_id", "fga", "fg3m", "points"), SQL["ing19_enriched_lines"])
register("snk02_inserted", lambda fx: sinks.inserted(fx.stat.where("game_id % 3 = 0"), fx.stat, ["game_id", "player_id"]).select("game_id", "player_id"), with_ctes("select game_id, player_id from fx_stat where game_id % 3 <> 0"))
register("snk06_orphans", lambda fx: ingest.split_orphans(fx.stat, fx.game.where("game_id % 5 > 0"))[1].groupBy("reason", "season").agg(F.count("*").alias("lines")), with_ctes("select 'NO_GAME_MATCH' reason, season, count(*) as lines from fx_stat where game_id % 5 = 0 group by season"))


def game_payload(fx):
    """Games as nested records: one in eight without a date, one in nine without a score."""
    side = lambda s: F.struct(F.col(f"{s}_team_id").alias("id"))
    points = lambda s: F.struct(F.when(F.col("game_id") % 9 > 0, F.col(f"{s}_score")).alias("points"))
    return fx.game.select(F.col("game_id").alias("id"), F.struct(F.when(F.col("game_id") % 8 > 0, F.col("date").cast("string")).alias("start")).alias("date"), F.struct(side("away").alias("visitors"), side("home").alias("home")).alias("teams"), F.struct(points("away").alias("visitors"), points("home").alias("home")).alias("scores"), "season", F.lit("2").alias("stage"), F.lit("standard").alias("league"))


register("dq04_shapes", lambda fx: ingest.shape_report(game_payload(fx), "games"), with_ctes("select issue, count(*) as \"rows\" from (select 'missing date.start' issue from fx_game where game_id % 8 = 0 union all select unnest(['missing scores.visitors.points', 'missing scores.home.points']) from fx_game where game_id % 9 = 0) group by issue"))
register("dq01_box_issues", lambda fx: ingest.shape_report(boxes(fx).withColumns({"date": F.when(F.length("gameId") > 2, F.col("date")), "playerStats": F.when(F.col("homeTeamId") % 5 == 0, F.slice("playerStats", 1, 0)).otherwise(F.col("playerStats"))}), "box"), with_ctes("select issue, count(*) as \"rows\" from (select 'missing date' issue from fx_game where game_id < 100 and game_id in (select game_id from fx_stat) union all select 'empty playerStats' from fx_game where home_team_id % 5 = 0 and game_id in (select game_id from fx_stat)) group by issue"))


def outcomes(fx):
    rows = fx.odds.select("game_id", F.col("source").alias("book"), F.expr("stack(4, 'spreads', 'H H', spread_home, 'spreads', 'A-A', -spread_home, 'totals', 'Over', total_over, 'totals', 'Under', total_over) as (market, name, point)"))
    return rows.withColumns({"price": F.lit(-110), "home_team": F.lit("hh"), "away_team": F.lit("aa")})


register("ing14_market_pivot", lambda fx: ingest.market_pivot(outcomes(fx), ["game_id", "book"]).drop("ml_home", "ml_away"), with_ctes("select game_id, source book, spread_home, -spread_home spread_away, total_over, total_over total_under from fx_odds"))
register("ing15_consensus_of_outcomes", lambda fx: ingest.consensus(ingest.market_pivot(outcomes(fx), ["game_id", "book"])).select("game_id", "book", "spread_home", "total_over"), with_ctes("select game_id, 'consensus' book, spread_home, total_over from fx_line"))
register("ing16_over_under", lambda fx: ingest.over_under(fx.stat.select("game_id", F.lit("fanduel").alias("book"), F.lit("player_points").alias("market"), F.col("player_id").cast("string").alias("description"), F.expr("stack(2, 'Over', -110, case when game_id % 3 > 0 then points + 0.5D end, 'Under', -105, case when game_id % 5 > 0 then points + 1.5D end) as (name, price, point)")), ["game_id"]),
         with_ctes("select game_id, 'fanduel' book, 'player_points' market, cast(player_id as varchar) player, cast(case when game_id % 3 > 0 then points + 0.5 else points + 1.5 end as double) line, -110 over_odds, -105 under_odds from fx_stat where game_id % 3 > 0 or game_id % 5 > 0"))


def box_rows(fx):
    """Box scores of the tables: odd players under the older field names."""
    new, old = F.col("player_id") % 2 == 0, F.col("player_id") % 2 == 1
    line = F.struct(
        F.when(new, F.col("player_id")).alias("personId"), F.when(old, F.col("player_id")).alias("playerId"), F.col("team_id").alias("teamId"), F.format_string("%d:%02d", F.floor(F.col("secs") / 60), F.col("secs") % 60).alias("minutes"),
        *[F.col(s) for s in ingest.STATS if s != "rebounds"], F.when(new, F.col("rebounds")).alias("reboundsTotal"), F.when(old, F.col("rebounds")).alias("rebounds"),
        *[F.when(new, F.col(a)).alias(b) for a, b in (("fga", "fieldGoalsAttempted"), ("fg3m", "threePointersMade"), ("fg3a", "threePointersAttempted"), ("ftm", "freeThrowsMade"), ("fta", "freeThrowsAttempted"), ("oreb", "reboundsOffensive"))],
        *[F.when(old, F.col(a)).alias(a) for a in ("fga", "fg3m", "fg3a", "ftm", "fta", "oreb")],
    )
    own = fx.stat.groupBy("game_id").agg(F.collect_list(line).alias("playerStats")).join(fx.game, "game_id")
    return own.select(F.col("game_id").cast("string").alias("gameId"), F.col("date").cast("string").alias("date"), F.col("home_score").alias("homeScore"), F.col("away_score").alias("awayScore"), F.col("home_team_id").alias("homeTeamId"), F.col("away_team_id").alias("awayTeamId"), "playerStats")


def boxes(fx):
    """Box scores as JSON text and read again."""
    rows = fx.once("box_rows", box_rows)
    return rows.select(F.from_json(F.to_json(F.struct(*rows.columns)), landing.BOX).alias("b")).select("b.*")


register("ing17_box_lines", lambda fx: ingest.box_lines(boxes(fx)).select(F.col("source_id").cast("long").alias("game_id"), "player_id", "team_id", "secs", *STATS), with_ctes(f"select game_id, player_id, team_id, secs, {', '.join(STATS)} from fx_stat"))
register("ing17_box_games", lambda fx: ingest.box_games(boxes(fx)).select(F.col("source_id").cast("long").alias("game_id"), "date", "season", "home_score", "away_score", "status"), with_ctes("select game_id, date, season, home_score, away_score, status from fx_game where game_id in (select game_id from fx_stat)"))
register("ing21_to_insert", lambda fx: ingest.to_insert(fx.game.where("status = 'Scheduled'"), fx.game.where("status = 'Final'")).select("game_id", "date"), with_ctes("select game_id, date from fx_game s where status = 'Scheduled' and not exists (select 1 from fx_game f where f.status = 'Final' and f.date = s.date and least(f.home_team_id, f.away_team_id) = least(s.home_team_id, s.away_team_id) and greatest(f.home_team_id, f.away_team_id) = greatest(s.home_team_id, s.away_team_id))"))
register("ing25_gaps", lambda fx: ingest.gaps(fx.stat), with_ctes("select cast(d as date) date from (select unnest(generate_series((select min(date) from fx_stat), (select max(date) from fx_stat), interval 1 day)) d) where cast(d as date) not in (select date from fx_stat)"))
register("dq02_audit", lambda fx: ingest.audit(fx.game.where("status = 'Final'").select("season", F.col("game_id").alias("source_id")), fx.stat.where("season <> 1996 or game_id % 2 = 0").select("season", F.col("game_id").alias("source_id"), (F.col("turnovers") > 10).alias("corrupt"))), with_ctes(
    "select season, count(*) expected, count(corrupt) found, count(case when corrupt is null then 1 end) missing, 0 orphan, count(case when corrupt > 0 then 1 end) corrupted from (select g.season, g.game_id, max(case when turnovers > 10 then 1 when turnovers is not null then 0 end) corrupt from fx_game g left join fx_stat s on s.game_id = g.game_id and (s.season <> 1996 or s.game_id % 2 = 0) where status = 'Final' group by g.season, g.game_id) group by season"))
register("dq03_complete_dates", lambda fx: ingest.complete_dates(fx.game.where("status = 'Final'").select("date", F.col("game_id").alias("source_id")), fx.stat.select(F.col("game_id").alias("source_id"))), with_ctes("select date, count(*) games, count(case when has then 1 end) found, count(case when has then 1 end) = count(*) complete from (select date, game_id in (select game_id from fx_stat) has from fx_game where status = 'Final') group by date"))
