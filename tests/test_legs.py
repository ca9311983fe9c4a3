"""Combinations of as many keys as the library's defaults make, against a plain count."""

from itertools import combinations

from pyspark.sql import functions as F

from slatewise.operators import backtest, mining, reports

DATES = [f"{2001 + i % 2}-01-{1 + i:02d}" for i in range(8)]


def night(spark):
    rows = [(d, int(d[:4]) - 1, k) for i, d in enumerate(DATES) for k in "abcde" if k != "e" or i < 4]
    return spark.createDataFrame(rows, "date string, season int, event_key string").selectExpr("to_date(date) date", "season", "event_key")


def hits(c):
    return 4 if "e" in c else 8


def test_night_patterns_of_four_keys(spark):
    got = {r.combo: (r.hits, r.legs, str(r.last)) for r in mining.night_patterns(night(spark)).collect()}
    assert got == {"+".join(c): (hits(c), n, max(DATES[: hits(c)])) for n in (1, 2, 3, 4) for c in combinations("abcde", n)}


def test_dates_of_bitmaps(spark):
    """Nights at the ends of a season's words, and the dates that come back."""
    days = ["2000-08-01", "2000-10-03", "2000-10-04", "2001-09-30", "2001-10-11"]
    events = spark.createDataFrame([(d, 2000, "x") for d in days] + [("2001-10-30", 2001, "x")], "date string, season int, event_key string").selectExpr("to_date(date) date", "season", "event_key")
    got = reports.pattern_dates(mining.night_combinations(events, [2000, 2001], 1), [2000, 2001]).orderBy("date")
    assert [str(r.date) for r in got.collect()] == [*days, "2001-10-30"]


def test_every_stored_part_is_compared(spark):
    got = {(r.combo, r.part): (r.hits, r.part_hits) for r in reports.subset_redundancy(mining.night_patterns(night(spark))).collect()}
    whole = ["+".join(c) for n in (2, 3, 4) for c in combinations("abcde", n)]
    assert got == {(w, "+".join(p)): (hits(w), hits(p)) for w in whole for n in range(1, len(w.split("+"))) for p in combinations(w.split("+"), n)}


def test_game_patterns_of_four_and_folds_of_three_keys(spark):
    names = mining.CONDITION_KEYS[3:5] + mining.CONDITION_KEYS[-2:]
    rows = [(g, 2000 + g % 3, k, kind) for g in range(90) for k, kind in [*[(c, "condition") for c in names], ("HOME_COVERED:game", "outcome")]]
    events = spark.createDataFrame(rows, "game_id int, season int, event_key string, kind string")
    own = mining.profiles(events, spark.range(90).select(F.col("id").cast("int").alias("game_id"), F.lit("2001-01-01").cast("date").alias("date")))
    counts = mining.pattern_counts(own)
    kept = mining.kept_patterns(counts).withColumn("name", mining.combo_name(mining.CONDITION_KEYS))
    assert {(r.name, r.outcome, r["sample"], r.hits) for r in kept.collect()} == {("+".join(c), "HOME_COVERED:game", 90, 90) for n in (1, 2, 3, 4) for c in combinations(names, n)}
    found = backtest.candidates(counts, [2000, 2001, 2002])
    assert {(r.combo, r.test_season) for r in found.collect()} == {("+".join(c), s) for n in (1, 2, 3) for c in combinations(names, n) for s in (2001, 2002)}


def test_watchlist(spark):
    events, dates = night(spark), spark.createDataFrame([("2001-01-01",), ("2002-01-08",)], "d string").selectExpr("to_date(d) date")
    watched = reports.watch_add(spark.createDataFrame([("a+e", False), ("b", True)], "combo string, enabled boolean"), spark.createDataFrame([("a+e",), ("c",)], "combo string"))
    watched = reports.watch_remove(watched, spark.createDataFrame([("c",)], "combo string"))
    stat = spark.createDataFrame([("2001-01-01",)], "d string").selectExpr("to_date(d) date")
    got = {(r.combo, str(r.date)): (r.hit, r.has_stats) for r in reports.watch_check(watched, events, dates, stat).collect()}
    assert got == {("a+e", "2001-01-01"): (True, True), ("a+e", "2002-01-08"): (False, False), ("b", "2001-01-01"): (True, True), ("b", "2002-01-08"): (True, False)}


def test_labels(spark):
    rows = spark.createDataFrame([("Boston", "Celtics", 2), (None, " ", 3), ("", "Nets", 4)], "city string, name string, id int")
    assert [r[0] for r in rows.select(reports.label(F.col("city"), F.col("name"), F.col("id"))).collect()] == ["Boston Celtics", "#3", "Nets"]
