"""Steps whose rows, shuffles or tasks would grow faster than their tables, against the plain ways on the same rows."""

import glob
import random
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from slatewise.operators import games, ingest, mining, players, predict, reports
from slatewise.plans import queries as q
from slatewise.sources import sinks
from slatewise.sources.fixtures import frames


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_events_meet_one_game_of_a_matchup(spark):
    """Many games of one date and two teams; an event takes the first with context, else the first."""
    team = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "team_id int, name string")
    rows = [(i, "2000-01-02", 1 + i % 2, 2 - i % 2) for i in range(50, 90)] + [(i, "2000-01-02", 1, 3) for i in (7, 5, 6)]
    game = spark.createDataFrame(rows, "game_id long, d string, home_team_id int, away_team_id int").withColumn("date", F.col("d").cast("date")).drop("d")
    events = spark.createDataFrame([(f"e{i}", "2000-01-02T23:30:00Z", "B", "A") for i in range(40)] + [("c", "2000-01-02T23:30:00Z", "C", "A"), ("n", "2000-01-02T23:30:00Z", "X", "A"), ("k", "2000-01-02T23:30:00Z", "B", "A")], "event_id string, commence_time string, home_team string, away_team string")
    known = spark.createDataFrame([("k", 99), ("k", 98)], "event_id string, game_id long")
    done = ingest.resolve(events, game, team, known, spark.createDataFrame([(70,), (77,)], "game_id long"))
    got = {r.event_id: (r.game_id, r.how) for r in done.collect()}
    assert got == {f"e{i}": (70, 3) for i in range(40)} | {"c": (5, 4), "n": (None, 9), "k": (98, 1)}
    assert re.search(r"Aggregate \[date#\d+, low#\d+, high#\d+\]", plan(done))


def test_best_games_put_few_lines_in_order(spark):
    """ties, and a player with nulls and fewer lines than are asked for."""
    rng = random.Random(5)
    rows = [(p, g, *[rng.randrange(4) for _ in range(3)]) for p in (1, 2) for g in range(40)] + [(3, 1, 5, None, 2), (3, 2, None, None, 2)]
    stat = spark.createDataFrame(rows, "player_id int, game_id long, points int, assists int, rebounds int")
    got = reports.best_games(stat)
    long = stat.select("player_id", "game_id", F.expr("stack(3, 'points', points, 'assists', assists, 'rebounds', rebounds) as (measure, value)"))
    want = long.withColumn("place", F.row_number().over(Window.partitionBy("player_id", "measure").orderBy(F.desc("value"), "game_id"))).where("place <= 5")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and "LeftSemi" in plan(got)


def test_large_partitions_are_several_files(spark, tmp_path):
    """a partition is not one task's."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(key, "20000")
    try:
        sinks.replace_partitions(spark.range(0, 100_000, 1, 8).select(F.lit(1996).alias("season"), "id"), str(tmp_path / "t"), "season")
    finally:
        spark.conf.unset(key)
    assert len(glob.glob(f"{tmp_path}/t/season=1996/*.parquet")) > 1 and spark.read.parquet(str(tmp_path / "t")).distinct().count() == 100_000


def test_hits_are_explained_in_one_join(spark, sf_dir):
    """hits move once, by their game, and take none of the game's columns to another shuffle."""
    fx = frames(spark, sf_dir)
    wide, key = q.game_wide(fx), "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, "-1")
    try:
        done = predict.explained(q.game_events(fx).where("kind = 'outcome'").select("game_id", F.col("event_key").alias("outcome")), wide, fx.stat, fx.stat.select("player_id", F.lit("x").alias("name")).distinct())
        shuffles = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", done._jdf.queryExecution().sparkPlan().toString() + done._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.unset(key)
    assert not any("_name" in s or "_player#" in s for s in shuffles)


def test_slate_sides_without_a_row_a_player(spark, sf_dir):
    """The best of a side by team and day are those of its games' players."""
    fx = frames(spark, sf_dir)
    q.slate_wide(fx)
    context = fx.kept["slate_context"]
    got, want = players.slate_sides(fx.game, fx.stat, context), players.sides(players.slate_players(fx.game, fx.stat, context))
    some = got.where("home_best_ppg is not null or away_best_ppg is not null or home_top_ppg_ppg is not null or away_top_ppg_ppg is not null")
    assert sorted(map(str, some.select(*want.columns).collect())) == sorted(map(str, want.collect())) and want.count() > 10


def test_profiles_of_wide_games(spark, sf_dir):
    """A game's codes, masks and bits from its own row are those of its events."""
    fx = frames(spark, sf_dir)
    cols = ["game_id", "season", "codes", "low", "high", "bits", "date"]
    got = mining.wide_profiles(q.game_wide(fx)).where("size(codes) > 0 or bits <> 0")
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, mining.profiles(q.game_events(fx), fx.game).select(*cols).collect()))
    slate, cols = q.slate_wide(fx), [c for c in cols if c != "bits"]
    got = mining.wide_profiles(slate, outcomes=False).where("size(codes) > 0")
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, mining.profiles(games.conditions(slate), fx.game).select(*cols).collect()))
    assert "Exchange" not in mining.wide_profiles(slate, outcomes=False)._jdf.queryExecution().executedPlan().toString()
