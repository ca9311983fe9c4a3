"""Files of box scores and scoreboards: written small, read once."""

import gzip
import json

from pyspark.sql import functions as F

from slatewise.operators import ingest
from slatewise.plans import landing as plans
from slatewise.sources import landing
from slatewise.streaming import landing as stream


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scoreboards_are_read_once(spark, tmp_path):
    team = lambda g, n: {"gameId": g, "teamId": n, "score": 80 + n}
    boards = [
        {"date": "2024-01-01", "games": [{"gameId": "1", "gameStatusText": "Final"}, {"gameId": None, "gameStatusText": "?"}], "teams": [team("1", 5), team("1", 6), team(None, 7)], "broadcasts": [{"gameId": "1", "name": "Y"}, {"gameId": "1", "name": "X"}, {"gameId": "9", "name": "Z"}]},
        {"date": "2024-01-02", "games": [{"gameId": "1"}, {"gameId": "2", "gameStatusText": "7:00 pm"}], "teams": [team("2", 8), team("2", 9)], "broadcasts": [{"gameId": "2", "name": None}]},
    ]
    (tmp_path / "b.json.gz").write_bytes(gzip.compress(json.dumps(boards).encode()))
    b = landing.scoreboards(spark, str(tmp_path / "b.json.gz"))
    assert plan_of(b).count("FileScan json") == 1
    got = {(r.date[-1], r.gameId): (r.status, r.away_team_id, r.home_score, r.home_wins, r.broadcasts, r.leaders) for r in b.collect()}
    assert got == {("1", "1"): ("Final", 5, 86, 0, ["X", "Y"], None), ("1", None): ("?", None, None, 0, None, None), ("2", "1"): (None, None, None, 0, None, None), ("2", "2"): ("7:00 pm", 8, 89, 0, [], None)}


def test_dumped_files_are_packed_and_read_again(spark, tmp_path):
    rows = spark.range(400).select(F.lit("2024-01").alias("month"), (F.col("id") % 4).alias("part"), plans.item(F.col("id").cast("string").alias("gameId"), F.lit("2024-01-01").alias("date"), F.array().cast("array<struct<points:int>>").alias("playerStats")))
    path = plans.dump(str(tmp_path / "d"), rows, more=("{",))
    files = list((tmp_path / "d").glob("part-*.gz"))
    assert len(files) == 5 and sum(f.stat().st_size for f in files) < 5000
    assert landing.box_scores(spark, path).select("gameId").distinct().count() == 400


def test_shapes_parse_once(spark):
    text = spark.range(6).select(F.when(F.col("id") > 1, '{"gameId":"1","date":"2024-01-01","playerStats":[]}').otherwise('{"gameId":"2"}').alias("value"))
    rows = text.select(F.from_json("value", landing.BOX).alias("b")).select("b.*")
    report = ingest.shape_report(rows, "box")
    assert plan_of(report).count("from_json") == 1
    assert {r.issue: r.rows for r in report.collect()} == {"missing date": 2, "missing playerStats": 2, "empty playerStats": 4}


def test_landed_texts_parse_once(spark):
    files = spark.range(3).select(F.when(F.col("id") == 0, '[{"gameId":"1","date":"2024-01-01"},{"gameId":"2"}]').when(F.col("id") == 1, " ").otherwise("[{").alias("value"), F.col("id").cast("string").alias("file"), F.lit(None).cast("timestamp").alias("landed"))
    told = stream.records(files)
    assert plan_of(told).count("from_json(") == 1
    assert sorted((r.file, r.reason or "") for r in told.collect()) == [("0", ""), ("0", "NO_DATE"), ("1", "EMPTY_FILE"), ("2", "NOT_JSON")]
