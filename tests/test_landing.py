"""Landed files, parsing, sinks and the landing stream on small fixtures with malformed, idle, orphan, swapped and repeated rows."""

import json

from pyspark.sql import functions as F

from slatewise.functions import parsing
from slatewise.operators import ingest
from slatewise.sources import landing, sinks
from slatewise.streaming.landing import land


def write(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def test_parsing(spark):
    cases = {"34:27": 2067, "PT34M27.00S": 2067, "12": 720, "12.5": 750, "": 0, "0": 0, "-1:0-57": 0, "DNP": 0, None: 0, "-3": 0}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", parsing.seconds(F.col("t")).alias("s"))
    assert {r.t: r.s for r in df.collect()} == cases
    one = spark.range(1).select(
        parsing.surrogate_id(F.lit("abc")), parsing.date_only(F.lit("on 2024-03-01T00:00")).cast("string"), parsing.date_only(F.lit("none")), parsing.eastern_date(F.lit("2024-03-02 03:30:00").cast("timestamp")).cast("string"),
        parsing.season_of(F.lit("2024-09-30").cast("date")), parsing.season_of_label(F.lit("2024-25")), parsing.season_type(F.lit("0042300101")), parsing.season_type(F.lit("9")), parsing.canonical(F.lit("Philadelphia 76ers")),
    ).first()
    assert tuple(one) == (-96354, "2024-03-01", None, "2024-03-01", 2023, 2024, "POST", "REG", "philadelphia76ers")


def game(i, stage="2", league="standard", points=(100, 90)):
    team = lambda n: {"id": n, "name": f"T{n}", "code": f"T{n}", "nickname": "x"}
    return {"id": i, "date": {"start": f"2024-01-0{i}T00:00:00Z"}, "stage": stage, "league": league, "season": 2023, "teams": {"visitors": team(2), "home": team(1)}, "scores": {"visitors": {"points": points[1]}, "home": {"points": points[0]}}}


def test_game_files(spark, tmp_path):
    for name, value in (("bare", [game(1), game(2, stage=1)]), ("games", {"games": [game(1), game(3, league="Africa")]}), ("response", {"response": [game(1, league=None), game(4, points=(None, None))]})):
        rows = ingest.game_rows(landing.games(spark, write(tmp_path / f"{name}.json", value))).collect()
        assert {r.game_id for r in rows} == ({1, 4} if name == "response" else {1})
        assert all(r.home_team_id == 1 and (r.home_score, r.away_score) in ((100, 90), (0, 0)) for r in rows)


def test_line_files(spark, tmp_path):
    line = lambda p, g, m, pts, comment=None: {"player": {"id": p}, "team": {"id": 1}, "game": {"id": g}, "min": m, "points": pts, "comment": comment}
    path = write(tmp_path / "l.json", [{"response": [line(1, 1, "10:00", 5), line(2, 1, "5", 2, "DNP - coach"), line(3, 1, "0", 0)]}, {"response": [line(1, 9, "7", 3), line(1, 1, "10:00", 5)]}])
    rows = ingest.line_rows(landing.player_lines(spark, path))
    known, orphans = ingest.split_orphans(rows, spark.createDataFrame([(1,)], "game_id long"))
    assert [(r.player_id, r.secs, r.points, r.rebounds) for r in known.collect()] == [(1, 600, 5, 0)]
    assert [(r.game_id, r.reason) for r in orphans.collect()] == [(9, "NO_GAME_MATCH")]


def test_odds_and_boards(spark, tmp_path):
    event = {"id": "e", "commence_time": "2024-01-02T03:00:00Z", "home_team": "A 1", "away_team": "B", "bookmakers": [{"key": "draftkings", "markets": [{"key": "spreads", "outcomes": [{"name": "a1", "price": -110, "point": -3.5}, {"name": "B", "price": -110, "point": 3.5}]}, {"key": "h2h", "outcomes": [{"name": "B", "price": 150}]}]}]}
    rows = landing.odds(spark, write(tmp_path / "o/2024.json", [event])).withColumn("game_id", F.lit(7))
    r = ingest.consensus(ingest.market_pivot(rows, ["game_id", "book"])).first()
    assert (r.book, r.spread_home, r.spread_away, r.total_over, r.ml_away, r.ml_home) == ("consensus", -3.5, 3.5, None, 150, None)
    board = {"date": "2024-01-01", "games": [{"gameId": "1", "gameStatusText": "Final/OT"}, {"gameId": "2", "gameStatusText": "7:00 pm"}], "teams": [{"gameId": "1", "teamId": 5, "score": 90}, {"gameId": "1", "teamId": 6, "score": 95}], "broadcasts": [{"gameId": "1", "name": "X"}], "leaders": [{"gameId": "1", "teamId": 5, "personId": 9, "points": 30}]}
    board["teams"][1] |= {"wins": 7, "losses": 2}
    b = landing.scoreboards(spark, write(tmp_path / "b/1.json", board))
    got = {r.gameId: r for r in b.collect()}
    assert (got["1"].away_team_id, got["1"].home_team_id, got["1"].home_score, got["1"].broadcasts) == (5, 6, 95, ["X"]) and got["2"].home_team_id is None
    assert [r.gameId for r in ingest.completed(b).collect()] == ["1"]
    assert (got["1"].home_wins, got["1"].home_losses, got["1"].away_wins, [x.personId for x in got["1"].leaders]) == (7, 2, 0, [9])
    boxes = landing.box_scores(spark, write(tmp_path / "x/1.json", {"gameId": "1", "playerStats": []})).unionByName(landing.box_scores(spark, write(tmp_path / "y/3.json", {"gameId": "3"})))
    assert {r.gameId: (r.home_wins, r.broadcasts) for r in landing.assembled(b, boxes).collect()} == {"1": (7, ["X"]), "3": (0, None)}
    plan = {"leagueSchedule": {"gameDates": [{"gameDate": "10/01/2024", "games": [{"gameId": "4", "gameDateTimeUTC": "2024-10-01T23:00:00Z", "gameStatusText": "7:00 pm", "homeTeam": {"teamId": 5, "wins": 1}, "awayTeam": {"teamId": 6}}]}]}}
    assert [(r.gameId, r.home_team_id, r.home_wins, r.away_team_id) for r in landing.schedules(spark, write(tmp_path / "s.json", plan)).collect()] == [("4", 5, 1, 6)]


def test_players_by_name(spark):
    p = spark.createDataFrame([(1, "Larry", "Nance"), (2, "LeBron", "James"), (3, "Larry", "Nance")], "player_id int, firstname string, lastname string")
    n = spark.createDataFrame([("Larry Nance Jr.",), ("lebron james",), ("James",), (None,)], "name string")
    assert {r.name: r.player_id for r in ingest.match_players(n, p).collect()} == {"Larry Nance Jr.": 1, "lebron james": 2, "James": None, None: None}


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v string, day string, o int")
    sinks.upsert(rows((1, "a", "d1", 1), (2, "b", "d2", 1), (1, "z", "d1", 0)), path, ["k"], "day", "o")
    sinks.upsert(rows((1, "c", "d1", 1), (3, "d", "d1", 1)), path, ["k"], "day", "o")
    sinks.upsert(rows((1, "c", "d1", 1), (3, "d", "d1", 1)), path, ["k"], "day", "o")
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("k", "v", "day").collect()) == [(1, "c", "d1"), (2, "b", "d2"), (3, "d", "d1")]
    assert [r.k for r in sinks.inserted(rows((1, "a", "d", 1)), rows((1, "x", "d", 1), (4, "y", "d", 1), (4, "y", "d", 1)), ["k"]).collect()] == [4]


def test_upsert_follows_a_key(spark, tmp_path):
    """A key whose partition value changes has one row; an emptied partition goes; dates as text stay text; a null value is a partition."""
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v string, day string")
    read = lambda: sorted((r.k, r.v, r.day) for r in spark.read.schema("k int, v string, day string").parquet(path).collect())
    sinks.upsert(rows((1, "a", "2024-01-01"), (2, "b", "2024-01-02"), (3, "c", None)), path, ["k"], "day")
    assert sorted(sinks.upsert(rows((1, "x", "2024-01-02")), path, ["k"], "day")) == ["2024-01-01", "2024-01-02"]
    assert read() == [(1, "x", "2024-01-02"), (2, "b", "2024-01-02"), (3, "c", None)]
    assert not (tmp_path / "t" / "day=2024-01-01").exists()
    sinks.upsert(rows((3, "y", "2024-01-03"), (1, "z", None)), path, ["k"], "day")
    assert read() == [(1, "z", None), (2, "b", "2024-01-02"), (3, "y", "2024-01-03")]


def test_runs(spark, tmp_path):
    path = str(tmp_path / "p")
    one = lambda *v: spark.createDataFrame([(x,) for x in v], "k int")
    for run, v in (("a", 1), ("b", 2), ("a", 3)):
        sinks.append_run(path, run, one(v), one(v))
    assert sorted((r.run_id, r.k) for r in spark.read.parquet(f"{path}/runs").collect()) == [("a", 3), ("b", 2)]


def box(i, points, date="2024-01-01"):
    return {"gameId": f"002{i}", "date": date, "season": "2023-24", "homeTeamId": 1, "awayTeamId": 2, "homeScore": 100, "awayScore": 99, "playerStats": [{"personId": 1, "teamId": 1, "minutes": "30:00", "points": points}]}


def test_stream_takes_new_files_once_and_corrections(spark, tmp_path):
    folder, table, derived = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "sums")
    run = lambda: land(spark, str(folder), table, str(tmp_path / "cp"), lambda lines: lines.groupBy("date").agg(F.sum("points").alias("points")), derived).awaitTermination(120)
    write(folder / "a.json", box(1, 10))
    write(folder / "b.json", box(2, 20, "2024-01-02"))
    assert run() is not False
    write(folder / "c.json", box(1, 11))
    run()
    run()
    assert sorted((r.source_id, r.points) for r in spark.read.parquet(f"{table}/lines").collect()) == [("0021", 11), ("0022", 20)]
    assert sorted((str(r.date), r.points) for r in spark.read.parquet(derived).collect()) == [("2024-01-01", 11), ("2024-01-02", 20)]
    assert spark.read.parquet(f"{table}/games").count() == 2
    write(folder / "d.json", box(1, 12, "2024-01-05"))  # a late correction moves the date
    run()
    assert sorted((r.source_id, str(r.date)) for r in spark.read.parquet(f"{table}/games").collect()) == [("0021", "2024-01-05"), ("0022", "2024-01-02")]
    assert sorted((r.source_id, r.points) for r in spark.read.parquet(f"{table}/lines").collect()) == [("0021", 12), ("0022", 20)]
    assert sorted((str(r.date), r.points) for r in spark.read.parquet(derived).collect()) == [("2024-01-02", 20), ("2024-01-05", 12)]
