"""Box scores from a landing folder as a stream: each file once, the latest version of a game counts, only touched dates are rebuilt."""

from __future__ import annotations

from collections.abc import Callable
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from slatewise.operators.ingest import box_games, box_lines, game_date
from slatewise.sources.kept import keep
from slatewise.sources.landing import BOX
from slatewise.sources.sinks import exists, replace_keys, replace_partitions, replace_range

#: A file is forgotten when it is older than this before the newest one; files of any age that were never seen are taken up.
RETENTION = "36500d"
#: What a game's versions are told by: when its file was written, then the file's name.
VERSION = ("landed", "file")
GAMES = "source_id string, date date, season int, season_type string, homeTeamId long, awayTeamId long, home_score int, away_score int, status string, landed timestamp, file string"


def records(files: DataFrame) -> DataFrame:
    """Rows (file, landed, reason, box) of ``files`` (value, file, landed), each the whole text of a file: one per box score, alone or in an
    array, with a null reason; and one for what can't be taken up, with its reason: EMPTY_FILE, NOT_JSON, NO_RECORDS, NO_GAME_ID, NO_DATE."""
    parsed = files.withColumn("boxes", F.from_json("value", f"array<struct<{_struct(BOX)}>>"))
    alone = F.when(~F.coalesce("value", F.lit("")).rlike(r"\S"), "EMPTY_FILE").when(F.col("boxes").isNull(), "NOT_JSON").when(F.size("boxes") == 0, "NO_RECORDS")
    own = parsed.withColumn("whole", alone).select("file", "landed", "whole", F.explode_outer(F.when(F.col("whole").isNull(), F.col("boxes")).otherwise(F.array(F.lit(None)))).alias("box"))  # never empty: before a plain explode Spark would parse the text again to see that
    date = game_date(F.col("box.date"), F.col("box.gameTimeUTC"))
    reason = F.coalesce("whole", F.when(F.col("box").isNull() | (F.coalesce(F.trim("box.gameId"), F.lit("")) == ""), "NO_GAME_ID").when(date.isNull(), "NO_DATE"))
    return own.select("file", "landed", reason.alias("reason"), "box")


def _struct(fields: str) -> str:
    """Top-level fields "a long, b array<...>" in the form that a struct has."""
    return ",".join(part.replace(" ", ":", 1) for part in fields.split(", "))


def land(
    spark: SparkSession, folder: str, table: str, checkpoint: str, rebuild: Callable[[DataFrame], DataFrame] | None = None, derived: str | None = None, files: int = 1000,
    derive: Callable[[SimpleNamespace], dict[str, DataFrame]] | None = None, odds: DataFrame | None = None, by: str = "date",
) -> StreamingQuery:
    """Take up files of ``folder`` that the ``checkpoint`` does not know, at most ``files`` in a batch, and stop.

    Files hold a box score or an array of them. Under ``table``: games and lines by date (or by ``month``: ``by``, fewer and larger files, of which a batch rewrites whole months); taken (batch, file, landed, records)
    names every file but those of no bytes (see progress); dead (batch, file, landed, game_id, reason) what could not be taken up; touched (batch, date). Of a game
    the version of the latest file counts, by the time the file was written and then its name, in whatever order they arrive:
    it brings all its lines, also where its date moves; an older version is taken up and changes nothing.

    Touched dates, where a game came, changed, moved to or from, are rebuilt: ``rebuild`` turns their lines into rows of
    ``derived`` by date; ``derive`` turns their game, stat, odds and line tables (see dependents; ``odds``: game_id, source, spread_home,
    total_over) into tables by date, under ``table``/name. A batch first writes what dates it touches, so that taking it up again
    after a failure at any place rebuilds the same dates and gives the same tables."""
    raw = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files).option("maxFileAge", RETENTION).load(folder)
    stamped = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("landed"))
    return stamped.writeStream.foreachBatch(lambda batch, number: take(batch, number, table, rebuild, derived, derive, odds, by)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def take(batch: DataFrame, number: int, table: str, rebuild=None, derived: str | None = None, derive=None, odds: DataFrame | None = None, by: str = "date") -> None:
    """One batch of files (value, file, landed); see land."""
    spark = batch.sparkSession
    told = keep(records(batch), "records")
    counted = told.groupBy("file", "landed").agg(F.count_if(F.col("reason").isNull()).alias("records")).withColumn("batch", F.lit(number).cast("long"))
    replace_partitions(counted, f"{table}/taken", "batch")
    dead = told.where("reason is not null").select("file", "landed", F.col("box.gameId").alias("game_id"), "reason", F.lit(number).cast("long").alias("batch"))
    if not dead.isEmpty():
        replace_partitions(dead, f"{table}/dead", "batch")

    last = F.struct("landed", "file")
    fields = told.schema["box"].dataType.names
    versions = told.where("reason is null").select("box.*", "landed", "file")
    own = keep(versions.groupBy("gameId").agg(F.max_by(F.struct(*fields, "landed", "file"), last).alias("r")).select("r.*"), "versions")
    games = box_games(own).join(own.select(F.col("gameId").alias("source_id"), "landed", "file"), "source_id")
    there = exists(spark, f"{table}/games")
    stored = spark.read.schema(GAMES if by == "date" else f"{GAMES}, {by} string").parquet(f"{table}/games") if there else spark.createDataFrame([], GAMES)
    known = stored.select("source_id", F.col("date").alias("old_date"), F.struct("landed", "file").alias("old"))
    newer = keep(games.join(known, "source_id", "left").where(F.col("old").isNull() | (last >= F.col("old"))), "newer")

    dates = newer.select(F.explode(F.array("date", "old_date")).alias("date")).where("date is not null").distinct()
    before = f"{table}/touched"
    if exists(spark, before):
        dates = dates.union(spark.read.schema("date date, batch long").parquet(before).where(F.col("batch") == number).select("date")).distinct()
    dates = keep(dates, "touched")
    touched = [r[0] for r in dates.collect()]  # the dates of one batch's games
    if not touched:
        return
    replace_partitions(dates.withColumn("batch", F.lit(number).cast("long")), before, "batch")

    dealt = lambda df: df if by == "date" else df.withColumn(by, F.date_format("date", "yyyy-MM"))
    games = dealt(newer.select(*[f.strip().split()[0] for f in GAMES.split(",")]))
    lines = keep(dealt(box_lines(own).join(games.select("source_id", "date", "season"), "source_id")), "lines")
    replace_keys(lines, games, f"{table}/lines", ["source_id"], by)
    replace_keys(games, games, f"{table}/games", ["source_id"], by)
    gone = F.col("date").isin(touched) if by == "date" else F.col("date").isin(touched) & F.col(by).isin(sorted({f"{d:%Y-%m}" for d in touched}))
    of_dates = lambda name, schema: spark.read.schema(schema).parquet(f"{table}/{name}").where(gone)

    def replace(df: DataFrame, path: str) -> None:
        if by == "date":
            replace_partitions(df, path, by, touched)
        else:
            replace_range(dealt(df), path, gone, by)

    if rebuild is not None:
        replace(rebuild(of_dates("lines", lines.schema)), derived)
    if derive is not None:
        plain = lambda df: df.drop(by) if by != "date" else df
        for name, df in derive(dependents(plain(of_dates("games", games.schema)), plain(of_dates("lines", lines.schema)), odds)).items():
            replace(df, f"{table}/{name}")


def dependents(games: DataFrame, lines: DataFrame, odds: DataFrame | None = None) -> SimpleNamespace:
    """Stored games and lines as the tables that night operators read: game, stat, odds and line."""
    number = F.col("source_id").cast("long").alias("game_id")
    game = games.select(number, "date", "season", F.col("homeTeamId").alias("home_team_id"), F.col("awayTeamId").alias("away_team_id"), "home_score", "away_score", "status")
    stat = lines.select(number, *[c for c in lines.columns if c != "source_id"])
    none = game.sparkSession.createDataFrame([], "game_id long, source string, spread_home double, total_over double")
    held = none if odds is None else odds.join(game.select("game_id"), "game_id", "left_semi")
    order = F.when(F.col("source") == "fanduel", 1).when(F.col("source") == "draftkings", 2).when(F.col("source") == "betmgm", 3).when(F.col("source") == "pointsbet", 4).otherwise(5)
    line = held.groupBy("game_id").agg(F.min_by(F.struct("spread_home", "total_over"), F.struct(order, "source")).alias("l")).select("game_id", "l.*")
    return SimpleNamespace(game=game, stat=stat, odds=held, line=line)


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(file, bytes) of the files of ``folder``, hidden ones apart; the driver lists them, as the stream's own source does."""
    jvm = spark._jvm.org.apache.hadoop.fs
    there = jvm.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(jvm.Path(folder))
    rows = [(s.getPath().toString(), s.getLen()) for s in there if s.isFile() and s.getPath().getName()[0] not in "._"]
    return spark.createDataFrame(rows, "file string, bytes long")


def progress(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """(file, issue) where the folder and what the stream took up differ: NOT_TAKEN files that lie there, EMPTY_FILE for those of no bytes,
    which no reader gets to see, GONE files that were taken up and lie there no more."""
    plain = F.regexp_replace("file", "^file:/+", "/").alias("file")
    taken = spark.read.parquet(f"{table}/taken").select(plain).distinct()
    there = listed(spark, folder).select(plain, "bytes")
    missing = there.join(taken, "file", "left_anti").select("file", F.when(F.col("bytes") == 0, "EMPTY_FILE").otherwise("NOT_TAKEN").alias("issue"))
    return missing.unionByName(taken.join(there, "file", "left_anti").withColumn("issue", F.lit("GONE")))
