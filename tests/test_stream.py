"""The landing stream: versions in any order, backfills, broken files, failures in between; tables that change together; ranges and conditional merges."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from slatewise.operators import night
from slatewise.sources import sinks, versions
from slatewise.streaming import landing

NOW = time.time()


def write(path, value, age=0.0):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    os.utime(path, (NOW - age, NOW - age))


def box(i, points, date="2024-01-01", home=100):
    line = lambda p, t: {"personId": p, "teamId": t, "minutes": "30:00", "points": points}
    return {"gameId": str(i), "date": date, "homeTeamId": 1, "awayTeamId": 2, "homeScore": home, "awayScore": 99, "playerStats": [line(1, 1), line(2, 2)]}


def land(spark, tmp_path, **more):
    landing.land(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "cp"), **more).awaitTermination()


def rows(spark, tmp_path, name, *columns):
    return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "t" / name)).select(*columns).collect())


def test_versions_in_any_order(spark, tmp_path):
    """An older file that lands after the correction changes nothing, one of last year is taken up, one as old by time counts by name."""
    write(tmp_path / "in/b.json", box(1, 11), 100)
    land(spark, tmp_path)
    write(tmp_path / "in/a.json", box(1, 10, "2024-01-09"), 7300)  # older, lands later
    write(tmp_path / "in/c.json", [box(2, 20), box(3, 30, "2023-01-01")], 370 * 86400)  # a backfill
    land(spark, tmp_path)
    assert rows(spark, tmp_path, "lines", "source_id", "points", F.col("date").cast("string")) == [("1", 11, "2024-01-01")] * 2 + [("2", 20, "2024-01-01")] * 2 + [("3", 30, "2023-01-01")] * 2
    write(tmp_path / "in/d.json", box(1, 12, "2024-01-02"), 100)
    land(spark, tmp_path)
    assert rows(spark, tmp_path, "games", "source_id", F.col("date").cast("string")) == [("1", "2024-01-02"), ("2", "2024-01-01"), ("3", "2023-01-01")]
    assert {r[1] for r in rows(spark, tmp_path, "lines", "source_id", "points") if r[0] == "1"} == {12}
    assert [n for _, n in rows(spark, tmp_path, "taken", "file", "records")] == [1, 1, 2, 1]


def test_broken_files_are_told(spark, tmp_path):
    write(tmp_path / "in/ok.json", box(1, 10))
    for name, text in (("cut", '{"gameId": "7", "pl'), ("empty", ""), ("blank", " \n"), ("none", "[]"), ("noid", json.dumps({"date": "2024-01-01"})), ("nodate", json.dumps([box(8, 1, None), box(9, 2)]))):
        write(tmp_path / f"in/{name}.json", text)
    land(spark, tmp_path)
    land(spark, tmp_path)
    dead = {(os.path.basename(f), r, g) for f, r, g in rows(spark, tmp_path, "dead", "file", "reason", "game_id")}
    assert dead == {("cut.json", "NOT_JSON", None), ("blank.json", "EMPTY_FILE", None), ("none.json", "NO_RECORDS", None), ("noid.json", "NO_GAME_ID", None), ("nodate.json", "NO_DATE", "8")}
    assert [g for g, in rows(spark, tmp_path, "games", "source_id")] == ["1", "9"] and len(rows(spark, tmp_path, "taken", "file")) == 6
    table = str(tmp_path / "t")
    assert [(os.path.basename(r.file), r.issue) for r in landing.progress(spark, str(tmp_path / "in"), table).collect()] == [("empty.json", "EMPTY_FILE")]
    write(tmp_path / "in/new.json", box(5, 1))
    os.remove(tmp_path / "in/none.json")
    assert {(os.path.basename(r.file), r.issue) for r in landing.progress(spark, str(tmp_path / "in"), table).collect()} == {("new.json", "NOT_TAKEN"), ("none.json", "GONE"), ("empty.json", "EMPTY_FILE")}


def derived(spark, tmp_path):
    return {n: sorted(map(str, spark.read.parquet(str(tmp_path / "t" / n)).drop("month").collect())) for n in ("team_nights", "night_events", "night_summary")}


@pytest.mark.parametrize("by", ["date", "month"])
def test_derived_tables_equal_a_full_rebuild(spark, tmp_path, by):
    """Also after corrections that move a date, and failures before and amid the derived tables."""
    odds = spark.createDataFrame([(1, "betmgm", 9.0, 150.0), (1, "fanduel", -9.0, 500.0)], "game_id long, source string, spread_home double, total_over double")
    write(tmp_path / "in/a.json", [box(1, 45), box(2, 31), box(3, 20, "2024-01-02")], 500)
    land(spark, tmp_path, derive=night.nights, odds=odds, by=by)
    before = derived(spark, tmp_path)
    assert any("2024-01-01" not in r for r in before["night_events"]) and any("GAME_SPREAD_COVERED" in r for r in before["night_events"])
    write(tmp_path / "in/b.json", [box(3, 50, "2024-01-03", 140)], 50)

    def failing(fx):
        done = night.nights(fx)
        return {"team_nights": done["team_nights"], "broken": fx.game.select("game_id", F.raise_error(F.lit("lost")).cast("date").alias("date"))}

    with pytest.raises(Exception, match="lost"):
        land(spark, tmp_path, derive=failing, odds=odds, by=by)
    land(spark, tmp_path, derive=night.nights, odds=odds, by=by)
    got = derived(spark, tmp_path)
    read = lambda n: spark.read.parquet(str(tmp_path / "t" / n))
    whole = night.nights(landing.dependents(read("games").drop("month"), read("lines").drop("month"), odds))
    want = {n: sorted(map(str, whole[n].select(*[c for c in read(n).columns if c != "month"]).collect())) for n in got}
    assert got == want and not any("2024, 1, 2" in r for n in got for r in got[n])
    assert got != before


def test_outdated_nights(spark):
    game = spark.createDataFrame([("2024-01-01",), ("2024-01-02",), ("2024-01-03",)], "date string").select(F.col("date").cast("date"))
    stored = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2)], "date string, logic_version int").select(F.col("date").cast("date"), "logic_version")
    assert sorted(str(r.date) for r in night.outdated(stored, game, 2).collect()) == ["2024-01-01", "2024-01-03"]


def test_tables_change_together(spark, tmp_path):
    path = f"file://{tmp_path}/v"
    one = lambda *v: spark.createDataFrame([(x,) for x in v], "k int")
    read = lambda: [sorted(r.k for r in df.collect()) for df in versions.read(spark, path, "patterns", "hits")]
    assert versions.pointer(spark, path)["version"] == 0
    versions.commit(spark, path, patterns=one(1, 2), hits=one(3))
    old = versions.read(spark, path, "patterns", "hits")
    lost = one(9).select(F.raise_error(F.lit("lost")).cast("int").alias("k"))
    with pytest.raises(Exception, match="lost"):
        versions.commit(spark, path, patterns=one(7), hits=lost)
    assert read() == [[1, 2], [3]] and versions.pointer(spark, path)["version"] == 1
    assert versions.commit(spark, path, patterns=old[0].where("k > 1")) == 2
    assert read() == [[2], [3]] and sorted(r.k for r in old[0].collect()) == [1, 2]
    assert versions.vacuum(spark, path) == 3 and read() == [[2], [3]]


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_ranges_and_conditional_merges(spark, tmp_path):
    path = tmp_path / "t"
    rows = lambda *r: spark.createDataFrame(list(r), "k int, team int, v int, day string")
    read = lambda: sorted(tuple(r) for r in spark.read.schema("k int, team int, v int, day string").parquet(str(path)).collect())
    sinks.replace_range(rows((1, 1, 0, "a"), (2, 2, 5, "a"), (3, 1, 0, "b"), (4, 2, 6, "c")), str(path), F.lit(False), "day")
    held = files(path)
    assert sorted(sinks.replace_range(rows((9, 1, 7, "d")), str(path), (F.col("team") == 1) & F.col("day").isin("a", "b"), "day")) == ["a", "b", "d"]
    assert read() == [(2, 2, 5, "a"), (4, 2, 6, "c"), (9, 1, 7, "d")]
    assert {p: t for p, t in files(path).items() if "day=c" in p} == {p: t for p, t in held.items() if "day=c" in p}
    held = files(path)
    better = (F.col("new.v") > 0) & (F.col("old.v") < 6)
    new = spark.createDataFrame([(2, 8), (4, 9), (5, 1)], "k int, v int")
    assert sinks.merge_where(new, str(path), ["k"], "day", better, {"v": F.col("new.v")}) == ["a"]
    assert read() == [(2, 2, 8, "a"), (4, 2, 6, "c"), (9, 1, 7, "d")]
    assert {p: t for p, t in files(path).items() if "day=a" not in p} == {p: t for p, t in held.items() if "day=a" not in p}
    held = files(path)
    assert sinks.merge_where(new, str(path), ["k"], "day", better, {"v": F.col("new.v")}) == [] and files(path) == held
    full = rows((4, 2, 1, "c"), (6, 3, 3, "a"))
    assert sinks.merge_where(full, str(path), ["k"], "day", F.lit(False), {}, insert=True) == ["a"]
    assert read() == [(2, 2, 8, "a"), (4, 2, 6, "c"), (6, 3, 3, "a"), (9, 1, 7, "d")]
