"""Landed JSON files as DataFrames, by explicit schemas; files are split by file, so keep one game, date or event in each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEAM = "struct<id:int,name:string,code:string,nickname:string>"
GAME = f"id:int,date:struct<start:string,end:string,duration:string>,stage:string,league:string,season:int,teams:struct<visitors:{TEAM},home:{TEAM}>,scores:struct<visitors:struct<points:int>,home:struct<points:int>>"
LINE = f"player:struct<id:int,firstname:string,lastname:string>,team:{TEAM},game:struct<id:int>,min:string,points:int,assists:int,totReb:int,steals:int,blocks:int,turnovers:int,comment:string"
#: A box score's player line under its new and old field names.
BOX_LINE = (
    "personId:long,playerId:long,teamId:long,firstName:string,familyName:string,minutes:string,comment:string,points:int,assists:int,reboundsTotal:int,rebounds:int,reboundsOffensive:int,oreb:int,steals:int,blocks:int,turnovers:int,"
    "fieldGoalsMade:int,fgm:int,fieldGoalsAttempted:int,fga:int,threePointersMade:int,fg3m:int,threePointersAttempted:int,fg3a:int,freeThrowsMade:int,ftm:int,freeThrowsAttempted:int,fta:int"
)
BOX = f"gameId string, date string, season string, homeTeamId long, awayTeamId long, homeScore int, awayScore int, status string, gameTimeUTC string, playerStats array<struct<{BOX_LINE}>>"
OUTCOME = "name:string,description:string,price:int,point:double"
ODDS = f"id string, commence_time string, home_team string, away_team string, bookmakers array<struct<key:string,markets:array<struct<key:string,outcomes:array<struct<{OUTCOME}>>>>>>"
BOARD = "date string, games array<struct<gameId:string,gameStatusText:string>>, teams array<struct<gameId:string,teamId:long,score:int,wins:int,losses:int,teamTricode:string>>, broadcasts array<struct<gameId:string,name:string>>, leaders array<struct<gameId:string,teamId:long,personId:long,points:int,rebounds:int,assists:int>>"
SIDE = "struct<teamId:long,score:int,wins:int,losses:int>"
SCHEDULE = f"leagueSchedule struct<gameDates:array<struct<gameDate:string,games:array<struct<gameId:string,gameDateTimeUTC:string,gameStatusText:string,homeTeam:{SIDE},awayTeam:{SIDE}>>>>>"


def read(spark: SparkSession, path: str, schema: str, corrupt: str | None = None) -> DataFrame:
    """Multi-line JSON; records that don't parse are dropped, or kept as text in the column ``corrupt``."""
    reader = spark.read.option("multiLine", True)
    if corrupt is None:
        return reader.option("mode", "DROPMALFORMED").schema(schema).json(path)
    return reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt).schema(f"{schema}, {corrupt} string").json(path)


def games(spark: SparkSession, path: str) -> DataFrame:
    """Games from a bare array, ``{games: []}`` or ``{response: []}``."""
    fields = ("id", "date", "stage", "league", "season", "teams", "scores")
    top = GAME.replace(",stage:", ", stage ").replace(",league:", ", league ").replace(",season:", ", season ").replace(",teams:", ", teams ").replace(",scores:", ", scores ").replace("id:int,date:", "id int, date ", 1)
    raw = read(spark, path, f"{top}, games array<struct<{GAME}>>, response array<struct<{GAME}>>")
    alone = F.when(F.col("id").isNotNull(), F.array(F.struct(*fields)))
    return raw.select(F.inline(F.coalesce("games", "response", alone)))


def player_lines(spark: SparkSession, path: str) -> DataFrame:
    """Player lines of an array of ``{response: []}`` or of one."""
    return read(spark, path, f"response array<struct<{LINE}>>").select(F.inline("response"))


def box_scores(spark: SparkSession, path: str, corrupt: str | None = None) -> DataFrame:
    """One row per box-score file of a folder; names that start with _ are not read."""
    return read(spark, path, BOX, corrupt)


def odds(spark: SparkSession, path: str) -> DataFrame:
    """One row per event, bookmaker, market and outcome of odds or player-prop files."""
    raw = read(spark, path, ODDS)
    books = raw.select(F.col("id").alias("event_id"), "commence_time", "home_team", "away_team", F.explode("bookmakers").alias("b"))
    markets = books.select("event_id", "commence_time", "home_team", "away_team", F.col("b.key").alias("book"), F.explode("b.markets").alias("m"))
    return markets.select("event_id", "commence_time", "home_team", "away_team", "book", F.col("m.key").alias("market"), F.inline("m.outcomes"))


def scoreboards(spark: SparkSession, path: str) -> DataFrame:
    """One row per game of scoreboard files: the first team row of a game is the road side, the second the home side, each with score, wins and losses; lists of broadcasts and leaders."""
    raw = read(spark, path, BOARD)
    # what boards tell of a game are rows of one shape: files are read once, and all that belongs to a game meets in one grouping
    kinds = {"game": "struct<status:string>", "team": "struct<at:int,team_id:bigint,score:int,wins:int,losses:int>", "shown": "struct<name:string>", "led": "struct<teamId:bigint,personId:bigint,points:int,rebounds:int,assists:int>"}
    told = {
        "game": ("games", lambda x, i: F.struct(x["gameStatusText"])), "team": ("teams", lambda x, i: F.struct(i, x["teamId"], x["score"], x["wins"], x["losses"])),
        "shown": ("broadcasts", lambda x, i: F.struct(x["name"])), "led": ("leaders", lambda x, i: F.struct(*[x[c] for c in ("teamId", "personId", "points", "rebounds", "assists")])),
    }
    shape = f"array<struct<gameId:string,{','.join(f'{k}:{t}' for k, t in kinds.items())}>>"
    rows = lambda kind, column, one: F.coalesce(F.transform(column, lambda x, i: F.struct(x["gameId"], *[one(x, i) if k == kind else F.lit(None).cast(t) for k, t in kinds.items()])).cast(shape), F.array().cast(shape))
    met = raw.select("date", F.inline(F.concat(*[rows(k, *told[k]) for k in kinds]))).groupBy("date", "gameId").agg(*[F.collect_list(k).alias(k) for k in kinds])
    # a game without a date or an id meets nothing
    known = lambda c: F.when(F.col("date").isNotNull() & F.col("gameId").isNotNull() & (F.size(c) > 0), F.array_sort(c))
    own = met.select("date", "gameId", F.explode("game").alias("g"), known(F.col("team")).alias("s"), known(F.col("shown")).alias("shown"), known(F.col("led")).alias("leaders"))
    side = lambda i, name: [F.get("s", F.lit(i))[c].alias(f"{name}_{c}") for c in ("team_id", "score")] + [F.coalesce(F.get("s", F.lit(i))[c], F.lit(0)).alias(f"{name}_{c}") for c in ("wins", "losses")]
    return own.select("date", "gameId", "g.status", *side(0, "away"), *side(1, "home"), F.array_compact(F.col("shown.name")).alias("broadcasts"), "leaders")


def assembled(board: DataFrame, box: DataFrame) -> DataFrame:
    """Box scores (see box_scores) with the records, broadcasts and leaders of their game's scoreboard row; a box score without one keeps 0 wins and losses."""
    b = board.select("gameId", *[f"{s}_{c}" for s in ("home", "away") for c in ("wins", "losses")], "broadcasts", "leaders").dropDuplicates(["gameId"])
    return box.join(b, "gameId", "left").fillna(0, [f"{s}_{c}" for s in ("home", "away") for c in ("wins", "losses")])


def schedules(spark: SparkSession, path: str) -> DataFrame:
    """One row per game of a provider's schedule payload: dates that hold games."""
    raw = read(spark, path, SCHEDULE)
    games = raw.select(F.explode("leagueSchedule.gameDates").alias("d")).select("d.gameDate", F.inline("d.games"))
    return games.select("gameId", "gameDate", "gameDateTimeUTC", F.col("gameStatusText").alias("status"), *[F.col(f"{s}Team.{c}").alias(f"{s}_{n}") for s in ("home", "away") for c, n in (("teamId", "team_id"), ("score", "score"), ("wins", "wins"), ("losses", "losses"))])
