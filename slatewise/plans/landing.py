"""Registered queries of landed JSON files: scans of every shape, and the landing stream with corrections, late and broken files."""

from __future__ import annotations

from collections.abc import Callable
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatewise.operators import ingest, night, reports
from slatewise.plans.ingest import box_rows, table_of
from slatewise.plans.queries import NIGHT_SQL, night_events, night_measures, register
from slatewise.sources import landing, sinks
from slatewise.sources.fixtures import Tables, with_ctes
from slatewise.streaming import landing as stream

#: A month's deliveries are cut by so many ids, so that more games make more files, not larger ones.
PART = 1 << 22


def month() -> Column:
    return F.date_format("date", "yyyy-MM").alias("month")


def part() -> Column:
    return F.floor(F.col("game_id") / PART).alias("part")


def dump(path: str, items: DataFrame, wrap: Callable[[Column], Column] = lambda body: F.concat(F.lit("["), body, F.lit("]")), more: tuple[str, ...] = ()) -> str:
    """A gzipped JSON file for each ``month`` (and ``part``, where there are any) of ``items`` (month, item), the items' texts in its body; and files of the texts ``more``."""
    rows = items.groupBy(*[c for c in ("month", "part") if c in items.columns]).agg(F.concat_ws(",", F.collect_list("item")).alias("body")).select(wrap(F.col("body")).alias("value"))
    if more:
        rows = rows.unionByName(items.sparkSession.createDataFrame([(m,) for m in more], "value string"))
    rows.write.mode("append").option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)
    return path


def item(*fields) -> Column:
    return F.to_json(F.struct(*fields)).alias("item")


# ---- scans: files written from the tables, read by their schemas
def game_files(fx: Tables) -> DataFrame:
    """Games of each month as a bare array or in one of the two wrappers; one in eight of another league or stage."""
    side = lambda s: F.struct(F.col(f"{s}_team_id").alias("id"))
    points = lambda s: F.struct(F.col(f"{s}_score").alias("points"))
    rows = fx.game.select(month(), item(
        F.col("game_id").alias("id"), F.struct(F.concat(F.col("date").cast("string"), F.lit("T19:00:00Z")).alias("start")).alias("date"), F.when(F.col("game_id") % 8 == 1, "1").otherwise("2").alias("stage"), F.lit("standard").alias("league"), "season",
        F.struct(side("away").alias("visitors"), side("home").alias("home")).alias("teams"), F.struct(points("away").alias("visitors"), points("home").alias("home")).alias("scores"),
    ))
    path = table_of(fx, "games-json")
    for n, wrap in enumerate((lambda b: F.concat(F.lit("["), b, F.lit("]")), lambda b: F.concat(F.lit('{"games":['), b, F.lit("]}")), lambda b: F.concat(F.lit('{"response":['), b, F.lit("]}")))):
        dump(path, rows.where(F.substring("month", 6, 2).cast("int") % 3 == n), wrap, ('{"games": [',) if n == 0 else ())
    return ingest.game_rows(landing.games(fx.spark, path))


register("src01_game_files", lambda fx: game_files(fx).select("game_id", "date", "season", "home_team_id", "away_team_id", "home_score", "away_score"), with_ctes("select game_id, date, season, home_team_id, away_team_id, home_score, away_score from fx_game where game_id % 8 <> 1"))


def line_files(fx: Tables) -> DataFrame:
    """Player lines of each month in ``{response: []}``; one in nine did not play, one in eleven has no game."""
    rows = fx.stat.select(month(), item(
        F.struct(F.col("player_id").alias("id")).alias("player"), F.struct(F.col("team_id").alias("id")).alias("team"), F.struct(F.when(F.col("game_id") % 11 > 0, F.col("game_id")).otherwise(-1 - F.col("game_id")).alias("id")).alias("game"),
        F.format_string("%d:%02d", F.floor(F.col("secs") / 60), F.col("secs") % 60).alias("min"), "points", "assists", F.col("rebounds").alias("totReb"), "steals", "blocks", "turnovers", F.when(F.col("player_id") % 9 == 0, "DNP - rest").alias("comment"),
    ))
    path = dump(table_of(fx, "lines-json"), rows, lambda b: F.concat(F.lit('[{"response":['), b, F.lit("]}]")))
    return ingest.split_orphans(ingest.line_rows(landing.player_lines(fx.spark, path)), fx.game)[0]


_LINE = ("team_id", "secs", *ingest.STATS)
register("src02_line_files", lambda fx: line_files(fx).select("game_id", "player_id", *_LINE), with_ctes(f"select game_id, player_id, {', '.join(_LINE)} from fx_stat where game_id % 11 <> 0 and player_id % 9 <> 0"))


def box_texts(fx: Tables) -> DataFrame:
    """(month, game_id, date and the other fields) of every box score."""
    own = fx.once("box_rows", box_rows)
    return own.select(F.substring("date", 1, 7).alias("month"), F.col("gameId").cast("long").alias("game_id"), "date", *[c for c in own.columns if c != "date"])


def box_files(fx: Tables) -> DataFrame:
    """Box scores of each month and PART of ids."""
    rows = box_texts(fx)
    return landing.box_scores(fx.spark, dump(table_of(fx, "boxes-json"), rows.select("month", part(), item(*[c for c in rows.columns if c not in ("month", "game_id")])), more=("{",)))


register("src03_box_files", lambda fx: ingest.box_lines(box_files(fx)).select(F.col("source_id").cast("long").alias("game_id"), "player_id", *_LINE), with_ctes(f"select game_id, player_id, {', '.join(_LINE)} from fx_stat"))


def odds_files(fx: Tables) -> DataFrame:
    """An event per game with its books' spreads and totals."""
    price = lambda name, point: F.struct(F.lit(name).alias("name"), F.lit(-110).alias("price"), point.alias("point"))
    markets = F.array(F.struct(F.lit("spreads").alias("key"), F.array(price("H", F.col("spread_home")), price("A", -F.col("spread_home"))).alias("outcomes")), F.struct(F.lit("totals").alias("key"), F.array(price("Over", F.col("total_over"))).alias("outcomes")))
    books = fx.odds.groupBy("game_id").agg(F.collect_list(F.struct(F.col("source").alias("key"), markets.alias("markets"))).alias("bookmakers")).join(fx.game.select("game_id", "date"), "game_id")
    rows = books.select(month(), item(F.concat(F.lit("evt-"), "game_id").alias("id"), F.concat(F.col("date").cast("string"), F.lit("T23:00:00Z")).alias("commence_time"), F.lit("H").alias("home_team"), F.lit("A").alias("away_team"), "bookmakers"))
    return landing.odds(fx.spark, dump(table_of(fx, "odds-json"), rows, more=('[{"id": "cut',)))


register("src04_odds_files", lambda fx: odds_files(fx).select("event_id", "commence_time", "book", "market", "name", "price", "point"), with_ctes(
    "select 'evt-' || o.game_id event_id, date || 'T23:00:00Z' commence_time, source book, m market, n as name, -110 price, cast(case n when 'H' then spread_home when 'A' then -spread_home else total_over end as double) point from fx_odds o join fx_game using (game_id), (values ('spreads', 'H'), ('spreads', 'A'), ('totals', 'Over')) k(m, n)"))


def prop_files(fx: Tables) -> DataFrame:
    """One event a game with a book's Over and Under of every second player, in a folder of its month's name; read again with those folders."""
    line = lambda side: F.struct(F.lit(side).alias("name"), F.col("player_id").cast("string").alias("description"), F.lit(-115).alias("price"), (F.col("points") + 0.5).cast("double").alias("point"))
    outcomes = fx.stat.where("player_id % 2 = 0").select("game_id", "date", F.explode(F.array(line("Over"), line("Under"))).alias("o")).groupBy("game_id", "date").agg(F.collect_list("o").alias("outcomes"))
    rows = outcomes.select(month(), item(F.concat(F.lit("evt-"), "game_id").alias("id"), F.array(F.struct(F.lit("fanduel").alias("key"), F.array(F.struct(F.lit("player_points").alias("key"), "outcomes")).alias("markets"))).alias("bookmakers")))
    path = table_of(fx, "props-json")
    for half in (0, 1):
        dump(f"{path}/half={half}", rows.where(F.substring("month", 6, 2).cast("int") % 2 == half), more=("not json",))
    return landing.odds(fx.spark, path)


register("src05_prop_files", lambda fx: ingest.over_under(prop_files(fx).withColumn("game_id", F.regexp_extract("event_id", r"(\d+)$", 1).cast("long")), ["game_id"]).select("game_id", "player", "line", "over_odds", "under_odds"), with_ctes("select game_id, cast(player_id as varchar) player, cast(points + 0.5 as double) line, -115 over_odds, -115 under_odds from fx_stat where player_id % 2 = 0"))


def board_rows(fx: Tables) -> DataFrame:
    """A scoreboard for each date, its games with both teams; files of a month."""
    team = lambda g, s: F.struct(g["game_id"].cast("string").alias("gameId"), g[f"{s}_team_id"].cast("long").alias("teamId"), g[f"{s}_score"].alias("score"), (g["game_id"] % 7).cast("int").alias("wins"))
    game = lambda g: F.struct(g["game_id"].cast("string").alias("gameId"), F.when(g["status"] == "Final", F.when(g["game_id"] % 5 == 0, "Final/OT").otherwise("Final")).otherwise("7:00 pm ET").alias("gameStatusText"))
    own = fx.game.groupBy("date").agg(F.collect_list(F.struct("game_id", "status", "away_team_id", "away_score", "home_team_id", "home_score")).alias("own"))
    dates = own.select("date", F.transform("own", game).alias("games"), F.flatten(F.transform("own", lambda g: F.array(team(g, "away"), team(g, "home")))).alias("teams"))
    return landing.scoreboards(fx.spark, dump(table_of(fx, "boards-json"), dates.select(month(), item(F.col("date").cast("string").alias("date"), "games", "teams"))))


boards = lambda fx: fx.once("boards", board_rows)
_SIDES = ("away_team_id", "home_team_id", "away_score", "home_score", "away_wins", "home_wins")
register("src06_boards", lambda fx: boards(fx).select(F.col("gameId").cast("long").alias("game_id"), "date", "status", *_SIDES), with_ctes("select game_id, cast(date as varchar) date, case when status <> 'Final' then '7:00 pm ET' when game_id % 5 = 0 then 'Final/OT' else 'Final' end status, away_team_id, home_team_id, away_score, home_score, game_id % 7 away_wins, game_id % 7 home_wins from fx_game"))
register("ing31_completed", lambda fx: ingest.completed(boards(fx)).select(F.col("gameId").cast("long").alias("game_id")), with_ctes("select game_id from fx_game where status = 'Final'"))
register("ing29_assembled", lambda fx: landing.assembled(boards(fx).where("gameId % 3 > 0"), box_files(fx)).select(F.col("gameId").cast("long").alias("game_id"), "home_wins", "away_wins", F.size("playerStats").alias("lines")), with_ctes(
    "select game_id, max(case when game_id % 3 > 0 then game_id % 7 else 0 end)::integer home_wins, max(case when game_id % 3 > 0 then game_id % 7 else 0 end)::integer away_wins, count(*)::integer \"lines\" from fx_stat group by game_id"))


def schedule_files(fx: Tables) -> DataFrame:
    """A provider's schedule: dates that hold games."""
    side = lambda s: F.struct(F.col(f"{s}_team_id").cast("long").alias("teamId"), F.col(f"{s}_score").alias("score"))
    game = F.struct(F.col("game_id").cast("string").alias("gameId"), F.col("status").alias("gameStatusText"), side("home").alias("homeTeam"), side("away").alias("awayTeam"))
    dates = fx.game.groupBy("date").agg(F.collect_list(game).alias("games"))
    rows = dates.select(month(), item(F.date_format("date", "MM/dd/yyyy").alias("gameDate"), "games"))
    return landing.schedules(fx.spark, dump(table_of(fx, "schedule-json"), rows, lambda b: F.concat(F.lit('{"leagueSchedule":{"gameDates":['), b, F.lit("]}}"))))


register("src08_schedule", lambda fx: schedule_files(fx).select(F.col("gameId").cast("long").alias("game_id"), F.to_date("gameDate", "MM/dd/yyyy").alias("date"), "status", "home_team_id", "home_score", "away_team_id", "away_score"), with_ctes("select game_id, date, status, home_team_id, home_score, away_team_id, away_score from fx_game"))


# ---- the stream
def _moved(fx: Tables, source: str, folder: str) -> None:
    """Deliver the files of ``source`` to ``folder``; they keep the time they were written."""
    jvm = fx.spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(source).getFileSystem(fx.spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(jvm.Path(source)):
        if status.getPath().getName().startswith("part-"):
            fs.rename(status.getPath(), jvm.Path(f"{folder}/{status.getPath().getName()}"))


def delivered(fx: Tables) -> tuple[str, str]:
    """(folder, tables) after four deliveries: half of the months; corrections of every tenth game, whose date moves in every
    fiftieth; then, written before those, older states of every twentieth game and the other half of the months, with a cut
    and an empty file; and, not taken up yet, new states of every thirtieth."""
    folder, table, checkpoint = table_of(fx, "landing"), table_of(fx, "landed"), table_of(fx, "checkpoint")
    rows = box_texts(fx)
    fields = [c for c in rows.columns if c not in ("month", "game_id")]
    scored = lambda df, n: df.withColumn("playerStats", F.transform("playerStats", lambda p: p.withField("points", p["points"] + n)))
    text = lambda df: df.select("month", part(), item(*fields))
    run = lambda: stream.land(fx.spark, folder, table, checkpoint, derive=night.nights, odds=fx.odds, by="month").awaitTermination()
    odd = F.substring("month", 6, 2).cast("int") % 2 == 1
    older = dump(table_of(fx, "older"), text(scored(rows.where("game_id % 20 = 0"), -1)))
    late = dump(table_of(fx, "late"), text(rows.where(odd)), more=('[{"gameId": "1", "pl', ""))
    dump(folder, text(rows.where(~odd)))
    run()
    fixed = scored(rows.where("game_id % 10 = 0"), 5).withColumns({"homeScore": F.col("homeScore") + 7, "date": F.when(F.col("game_id") % 50 == 0, F.date_add(F.col("date").cast("date"), 1).cast("string")).otherwise(F.col("date"))})
    dump(folder, text(fixed))
    run()
    _moved(fx, older, folder)
    _moved(fx, late, folder)
    run()
    dump(folder, text(rows.where("game_id % 30 = 0")).drop("part"))  # progress tells one file a month of these
    return folder, table


def landed(fx: Tables) -> tuple[str, str]:
    if "delivered" not in fx.kept:
        fx.kept["delivered"] = delivered(fx)
    return fx.kept["delivered"]


def landed_table(fx: Tables, name: str) -> DataFrame:
    return fx.spark.read.parquet(f"{landed(fx)[1]}/{name}")


#: What must be stored after all deliveries: the tables with their corrections.
LANDED = {
    "landed_game": "select game_id, d date, cast(year(d) - case when month(d) < 10 then 1 else 0 end as int) season, home_team_id, away_team_id, home_score, away_score, status from (select game_id, cast(case when game_id % 50 = 0 then date + 1 else date end as date) d, home_team_id, away_team_id, home_score + case when game_id % 10 = 0 then 7 else 0 end home_score, away_score, status from fx_game where game_id in (select game_id from fx_stat))",
    "landed_stat": f"select s.game_id, g.date, g.season, s.player_id, s.team_id, s.points + case when s.game_id % 10 = 0 then 5 else 0 end points, {', '.join('s.' + c for c in ('rebounds', 'assists', 'steals', 'blocks', 'turnovers', 'secs', 'fg3m', 'fg3a', 'ftm', 'fta', 'fga', 'oreb'))} from fx_stat s join landed_game g on g.game_id = s.game_id",
}
NIGHTS = LANDED | {k: v.replace("fx_game", "landed_game").replace("fx_stat", "landed_stat") for k, v in night.events_sql().items()}
register("sm01_landed_games", lambda fx: landed_table(fx, "games").select(F.col("source_id").cast("long").alias("game_id"), "date", "season", "home_score", "away_score"), with_ctes("select game_id, date, season, home_score, away_score from landed_game", LANDED))
register("sm02_landed_lines", lambda fx: landed_table(fx, "lines").select(F.col("source_id").cast("long").alias("game_id"), "date", "player_id", *_LINE), with_ctes(f"select game_id, date, player_id, {', '.join(_LINE)} from landed_stat", LANDED))
register("sm03_night_events", lambda fx: landed_table(fx, "night_events").select("date", "season", "event_key"), with_ctes("select date, season, event_key from night_events", NIGHTS))
register("sm03_night_summary", lambda fx: landed_table(fx, "night_summary").select("date", "season", "n_games", "n_scored", "n_stats", "n_events", "logic_version"), with_ctes(f"select m.date, m.season, n_games, n_scored, n_stats, coalesce(n, 0) n_events, {night.LOGIC_VERSION} logic_version from measures m left join (select date, count(*) n from night_events group by date) e on e.date = m.date", NIGHTS))
register("sm03_team_nights", lambda fx: landed_table(fx, "team_nights").select("date", "team_id", *night.STATS), with_ctes(f"select date, team_id, {', '.join(night.STATS)} from team_night", NIGHTS))
register("ing27_taken", lambda fx: landed_table(fx, "taken").select("records", F.lit(None).cast("string").alias("reason")).unionByName(landed_table(fx, "dead").select(F.lit(0).cast("long").alias("records"), "reason")).agg(F.sum("records").alias("records"), *[F.count_if(F.col("reason") == r).alias(n) for r, n in (("NOT_JSON", "broken"), ("EMPTY_FILE", "empty"))]), with_ctes("select count(*) + count(case when game_id % 10 = 0 then 1 end) + count(case when game_id % 20 = 0 then 1 end) records, 1 broken, 1 empty from landed_game", LANDED))
register("dq02_progress", lambda fx: stream.progress(fx.spark, *landed(fx)).groupBy("issue").agg(F.count("*").alias("files")), with_ctes("select 'NOT_TAKEN' issue, count(distinct strftime(date, '%Y-%m')) files from fx_game where game_id % 30 = 0 and game_id in (select game_id from fx_stat)"))


def taken_up(fx: Tables) -> DataFrame:
    """Stored summaries, those up to 1996 by an older logic that knew no event; then only dates of an older logic are worked out anew."""
    path, current = table_of(fx, "summaries"), night.summary(night_measures(fx), night_events(fx)).withColumn("logic_version", F.lit(night.LOGIC_VERSION))
    old = F.col("season") <= 1996
    sinks.replace_partitions(current.withColumns({"n_events": F.when(old, 0).otherwise(F.col("n_events")).cast("long"), "logic_version": F.when(old, 0).otherwise(F.col("logic_version"))}), path, "season")
    read = lambda: fx.spark.read.schema(current.schema).parquet(path)
    dates = night.outdated(read(), fx.game)
    some = SimpleNamespace(**{n: getattr(fx, n).join(dates, "date", "left_semi") for n in ("game", "stat")}, line=fx.line)
    sinks.replace_keys(new := night.nights(some)["night_summary"].select(*current.columns), new, path, ["date"], "season")
    return read()


register("ag10_taken_up", taken_up, with_ctes(f"select m.date, m.season, n_games, n_scored, n_stats, coalesce(n, 0) n_events, {night.LOGIC_VERSION} logic_version from measures m left join (select date, count(*) n from night_events group by date) e on e.date = m.date", NIGHT_SQL))


# ---- reports of a night
_label = lambda side: f"(select coalesce(nullif(concat_ws(' ', nullif(trim(city), ''), nullif(trim(name), '')), ''), '#' || team_id) from fx_team where team_id = {side}_team_id) {side}"
register("prj1_game_card", lambda fx: reports.game_card(fx.game, fx.team), with_ctes(f"select date, game_id, {_label('away')}, away_score, {_label('home')}, home_score, abs(home_score - away_score) margin, case when home_score > away_score then 'H' when home_score < away_score then 'A' else 'T' end winner from fx_game"))


def catalog_keys(fx: Tables) -> DataFrame:
    return fx.spark.createDataFrame([(k,) for k in night.CATALOG], "event_key string")


_odd = "case when event_key = 'NO_TEAM_120_PLUS' then 'NO_TEAM_120' else event_key end"
register("dq05_alignment", lambda fx: reports.alignment(catalog_keys(fx), night_events(fx)), with_ctes("select k event_key, 'NEVER_LIVE' issue from (values " + ", ".join(f"('{k}')" for k in night.CATALOG) + ") c(k) where k not in (select event_key from night_events)", NIGHT_SQL))
_named = {"live": f"select distinct {_odd} e from night_events", "keys": "select k from (values " + ", ".join(f"('{k}')" for k in night.CATALOG) + ") c(k)"}
register("dq05_renamed", lambda fx: reports.alignment(catalog_keys(fx), night_events(fx).select(F.expr(_odd).alias("event_key"))), with_ctes("select e event_key, 'NOT_IN_CATALOG' issue from live where e not in (select k from keys) union all select k, 'NEVER_LIVE' from keys where k not in (select e from live)", NIGHT_SQL | _named))
