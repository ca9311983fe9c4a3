"""Ledgers told by runs of games, and first patterns and last days by bitmaps, against the plain ways on the same games."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from slatewise.operators import backtest, mining, predict, vertical


def some_games(spark, n=3000, keys=6, seed=3):
    rng = random.Random(seed)
    rows = []
    for g in range(n):
        codes = [c for c in (0, 3, 59, 60, 61, 80)[:keys] if rng.random() < 0.6]
        rows.append((g, 2000 + g // 1000, g % 90, codes, sum(1 << c for c in codes if c < 60), sum(1 << c - 60 for c in codes if c >= 60), rng.getrandbits(4) | rng.getrandbits(4)))
    own = spark.createDataFrame(rows, "game_id long, season int, d int, codes array<int>, low long, high long, bits long")
    return own.withColumn("date", F.date_add(F.make_date(F.col("season"), F.lit(1), F.lit(1)), F.col("d"))).drop("d")


def combo(*codes):
    return sum((c + 1) << mining.DIGIT * (len(codes) - 1 - i) for i, c in enumerate(codes))


def test_walked_is_the_ledger(spark, monkeypatch):
    monkeypatch.setattr(backtest, "TOGETHER", 64)
    own = some_games(spark)
    rows = [(f"{c}", f"o{o}", s, c, o, hits, 100) for c in (combo(0), combo(3, 60), combo(0, 59, 80)) for o in (0, 1, 3) for s in (2001, 2002) for hits in (53 + 5 * o,)]
    rows += [("none", "o2", 2001, combo(61), 2, 40, 100), ("absent", "o0", 2001, combo(5), 0, 70, 100)]
    found = spark.createDataFrame(rows, "combo string, outcome string, test_season int, code long, o int, train_hits long, train_n long")
    placed = backtest.bets(own, found)
    for sizing in ("kelly", "halfKelly"):
        want = {(r.combo, r.outcome, r.test_season): r for r in backtest.results(backtest.ledger(placed, backtest.FOLD, sizing), backtest.FOLD).collect()}
        got = backtest.walked(own, found.withColumn("train_rate", F.col("train_hits") / F.col("train_n")), sizing).collect()
        seen = {(r.combo, r.outcome, r.test_season): (r.n, r.h) for r in placed.groupBy(*backtest.FOLD).agg(F.count("*").alias("n"), F.sum("hit").alias("h")).collect()}
        assert {(r.combo, r.outcome, r.test_season): (r.test_n, r.test_hits) for r in got} == seen
        assert len(want) > 10
        for r in got:
            w = want.get((r.combo, r.outcome, r.test_season))
            assert (w is None) == (r.bets is None)
            for c in ("bets", "wins", "wagered", "net", "roi", "peak", "final", "max_drawdown", "sharpe") if w else ():
                assert (r[c] is None) == (w[c] is None) and (w[c] is None or abs(r[c] - w[c]) < 1e-8 * max(1, abs(w[c]))), (c, r, w)


def test_walked_makes_no_row_of_a_bet(spark, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("bets as rows")

    monkeypatch.setattr(backtest, "bets", refused)
    monkeypatch.setattr(backtest, "ledger", refused)
    own = some_games(spark, 300)
    by = spark.createDataFrame([("a", "o0", combo(0), 0, s, 60, 36) for s in (2000, 2001)], "combo string, outcome string, code long, o int, season int, n long, h long")
    assert backtest.leave_one_out(by, own).where("test_n > 100 and bets = test_n").count() == 1


def test_first_patterns(spark):
    own = some_games(spark, 400)
    rng = random.Random(4)
    rows = [(c, f"{c}", f"OUT{o}:game", o, rng.randrange(3) / 4, rng.randrange(2) / 2, rng.randrange(90, 120)) for c in (combo(0), combo(3), combo(0, 60), combo(59, 80), combo(0, 3, 61)) for o in range(3)]
    patterns = spark.createDataFrame(rows, "combo long, name string, outcome string, o int, confidence double, hit_rate double, sample long").withColumn("value", F.col("hit_rate"))
    cols = ["game_id", "combo", "outcome", "place"]
    order = Window.partitionBy("game_id").orderBy(F.desc("confidence"), F.desc("value"), "combo", "outcome")
    want = predict.met_patterns(own, patterns).withColumn("place", F.row_number().over(order)).where("place <= 4").select(*cols).collect()
    assert sorted(predict.predictions(own, patterns, 4).select(*cols).collect()) == sorted(want)
    best = Window.partitionBy("game_id", "outcome").orderBy(F.desc("hit_rate"), F.desc("sample"), "combo")
    one = predict.met_patterns(own, patterns).withColumn("n", F.row_number().over(best)).where("n = 1")
    order = Window.partitionBy("game_id").orderBy(F.desc("hit_rate"), F.desc("sample"), "outcome")
    want = one.withColumns({"place": F.row_number().over(order), "outcomes": F.count("*").over(Window.partitionBy("game_id"))}).where("place <= 2").select(*cols, "outcomes").collect()
    assert sorted(predict.feed(own, patterns, 2).select(*cols, "outcomes").collect()) == sorted(want)
    assert predict.predictions(own, patterns.where("false")).count() == 0


def test_last_days(spark, monkeypatch):
    monkeypatch.setattr(vertical, "GROUP", 4)
    monkeypatch.setattr(vertical, "HELD", 64)
    own = some_games(spark, 500).withColumn("day", F.datediff("date", F.lit("2000-06-01").cast("date")))
    width = len(mining.OUTCOME_KEYS)
    asked = spark.createDataFrame([(combo(*c),) for c in ((0,), (80,), (3, 60), (0, 59, 61), (0, 3, 59, 80), (7,))], "combo long")
    got = {r.combo: r["last"] for r in vertical.last_days(own, asked, len(mining.CONDITION_KEYS), width, mining.DIGIT).collect()}
    rows = own.select("day", "codes", "bits").collect()
    for c in ((0,), (80,), (3, 60), (0, 59, 61), (0, 3, 59, 80)):
        want = [max((r.day for r in rows if set(c) <= set(r.codes) and r.bits >> o & 1), default=None) for o in range(width)]
        assert got.pop(combo(*c)) == want
    assert not got


def test_closing_counts_kinds_of_odds(spark):
    odds = spark.createDataFrame([(1, -120), (1, -120), (1, None), (1, 105), (2, None)], "k int, odds int")
    got = {r.k: r for r in backtest.closing_value(odds, ["k"]).collect()}
    base = 110 / 210
    want = (2 * (base - 120 / 220) + base - 100 / 205) / 4
    assert abs(got[1].value - want) < 1e-12 and (got[1].above, got[1].below) == (1, 2) and (got[2].value, got[2].above, got[2].below) == (0, 0, 0)


def test_settled_hits(spark):
    own = some_games(spark, 60)
    a, b = mining.OUTCOME_KEYS[:2]
    events = own.selectExpr("game_id", f"explode(case when game_id % 3 = 0 then array('{a}') when game_id % 3 = 1 then array('{b.replace(':game', ':away')}', 'SOME:home') else array('SOME:home') end) event_key").where("game_id < 50")
    patterns = spark.createDataFrame([(combo(c), f"{c}", k.replace(":game", ":home"), o) for c in (0, 60) for o, k in enumerate((a, b))], "combo long, name string, outcome string, o int")
    cols = ["game_id", "combo", "outcome", "result"]
    want = predict.settled(predict.met_patterns(own, patterns), events).select(*cols).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(predict.settled_hits(own, patterns, events).select(*cols).collect(), key=key) == sorted(want, key=key)
    assert {r.result for r in want} == {True, False, None}


def test_daily_hits(spark):
    own = some_games(spark, 500)
    patterns = spark.createDataFrame([(combo(*c), f"{c}", f"o{o}", o) for c in ((0,), (3, 60)) for o in (0, 1)], "combo long, name string, outcome string, o int")
    asked = patterns.select(F.col("name").alias("combo"), "outcome", F.explode(F.sequence(F.lit("2000-01-01").cast("date"), F.lit("2000-04-30").cast("date"))).alias("date"))
    days = predict.daily_hits(own, patterns)
    assert days.count() <= 4 * 90
    want = predict.recent_performance(mining.hits_of(own, patterns), asked).collect()
    assert sorted(predict.recent_performance(days, asked).collect()) == sorted(want) and any(r.recent_hits for r in want)


def test_walked_flat_is_the_ledger(spark, monkeypatch):
    """Ledgers that stay full, run short, recover or die, over many batches of games: bets are bits, not rows."""
    monkeypatch.setattr(backtest, "TOGETHER", 16)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    own = some_games(spark)
    rows = [(f"{c}", f"o{o}", s, c, o) for c in (combo(0), combo(3, 60), combo(0, 59, 80)) for o in (0, 1, 3, 6, 9) for s in (2001, 2002)] + [("absent", "o0", 2001, combo(5), 0)]
    found = spark.createDataFrame(rows, "combo string, outcome string, test_season int, code long, o int").withColumns({"train_hits": F.lit(60), "train_n": F.lit(100)})
    own = own.withColumn("bits", F.expr("bits | case when hash(game_id) % 100 < 0 then 64 else 0 end"))  # outcome 6 is even, 9 never comes
    placed = backtest.bets(own, found)
    book = backtest.ledger(placed, backtest.FOLD, "flat")
    want = {r[:3]: r for r in backtest.tested(found, placed, book, 1).collect()}
    money = {r[:3]: r for r in backtest.results(book, backtest.FOLD).collect()}
    for name in ("bets", "ledger"):
        monkeypatch.setattr(backtest, name, lambda *_, **__: 1 / 0)
    flat = backtest.walked_flat(own, found)
    got = {r[:3]: r for r in backtest.judged(found, flat, 1).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    alike = lambda a, b: a == b or (isinstance(a, float) and abs(a - b) < 1e-8 * max(1, abs(b)))
    assert got.keys() == want.keys() and len(want) == 30
    for k, w in want.items():
        assert all(alike(a, b) for a, b in zip(got[k][:-1], w[:-1], strict=True)), (got[k], w)
    assert {r.bets < r.test_n for r in got.values()} == {True, False} and any(r.wagered != 200 * r.bets for r in money.values())
    for r in flat.collect():
        assert all(alike(r[c], money[r[:3]][c]) for c in ("bets", "wins", "wagered", "net", "roi", "peak", "final", "max_drawdown", "sharpe")), (r, money[r[:3]])


def test_walked_days_is_the_combined_ledger(spark, monkeypatch):
    monkeypatch.setattr(backtest, "TOGETHER", 16)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    own = some_games(spark)
    rows = [(f"{c}", f"o{o}", s, c, o, hits, 100) for c in (combo(0), combo(3, 60)) for o in (0, 1, 9) for s in (2001, 2002) for hits in (53 + 5 * o,)] + [("none", "o2", 2001, combo(61), 2, 40, 100)]
    found = spark.createDataFrame(rows, "combo string, outcome string, test_season int, code long, o int, train_hits long, train_n long").withColumn("train_rate", F.col("train_hits") / F.col("train_n"))
    placed = backtest.bets(own, found)
    for sizing in ("kelly", "halfKelly"):
        want = sorted(backtest.combined(backtest.ledger(placed, backtest.FOLD, sizing), "test_season").collect())
        with monkeypatch.context() as m:
            for name in ("bets", "ledger"):
                m.setattr(backtest, name, lambda *_, **__: 1 / 0)
            days = backtest.walked_days(own, found, sizing=sizing)
            got = sorted(backtest.combined_days(days, "test_season").collect())
        assert len(got) == len(want) == 2 and days.count() == 180
        for g, w in zip(got, want, strict=True):
            assert g[:3] == w[:3] and all(abs(a - b) < 1e-8 * max(1, abs(b)) for a, b in zip(g[3:], w[3:], strict=True)), (g, w)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_walked_days_beyond_the_doubles(spark):
    """Bankrolls beyond the doubles, on the day of both wins and losses without a sum, as the ledger's."""
    own = spark.range(400_000).selectExpr("id game_id", "2001 season", "array(0) codes", "1L low", "0L high", "case when id % 1000 < 999 then 1L else 0L end bits", "date_add(date'2001-01-01', cast(id / 100000 as int)) date")
    found = spark.createDataFrame([("a", "o", 2001, combo(0), 0, 0.9)], "combo string, outcome string, test_season int, code long, o int, train_rate double")
    days = {r.date.day: r for r in backtest.walked_days(own, found).collect()}
    assert [days[d].bets for d in (1, 2, 3, 4)] == [100_000] * 4 and days[4].wagered == float("inf") and days[4].profit != days[4].profit


def test_lined_picks_are_not_shuffled(spark):
    """Lines meet games, not picks: the plan shuffles by game_id only what is a game's, and gives what with_prop_lines gives of picks."""
    own = some_games(spark, 200)
    outcomes = ("HOME_TOP_SCORER_25_PLUS:game", "AWAY_TOP_SCORER_30_PLUS:game", "AWAY_TOP_REBOUNDER_12_PLUS:game", "HOME_TOP_REBOUNDER_10_PLUS:game", "PLAYER_10_PLUS_REBOUNDS:game", "PLAYER_DOUBLE_DOUBLE:game", "AWAY_TOP_SCORER_DOUBLE_DOUBLE:game", "HOME_WIN:game")
    rows = [(combo(*c), f"{c}", o, 0, 0.9, 0.2, 0.72, 300, 6) for c in ((0,), (3, 60)) for o in outcomes]
    patterns = spark.createDataFrame(rows, "combo long, name string, outcome string, o int, confidence double, edge double, hit_rate double, sample long, n_seasons long")
    tops = own.selectExpr("game_id", "stack(5, 'home', 'ppg', 1, 'away', 'ppg', 2, 'home', 'rpg', 3, 'away', 'rpg', 4, 'home', 'apg', 1) as (side, stat, p)").selectExpr("game_id", "side", "stat", "concat('Last', p, 'x') lastname")
    props = own.selectExpr("game_id", "explode(sequence(1, 4)) p").selectExpr("*", "explode(array('player_points', 'player_rebounds')) market").selectExpr("game_id", "concat(if(p % 2 = 0, 'Z ', 'A '), 'Last', p, 'x') player", "market", "5.5 + hash(game_id, p, market) % 13 + 13 line").where("hash(line, game_id) % 4 <> 0")
    props = props.withColumn("line", F.col("line").cast("double"))
    props = props.unionByName(props.where("game_id % 3 = 0").selectExpr("game_id", "concat('B', player) player", "market", "line + 1 line"))
    got = predict.lined_picks(own, patterns, tops, props)
    held = predict.picks(own, patterns).select("game_id", "combo", "outcome")
    want = predict.with_prop_lines(held, tops, props)
    key = lambda r: tuple(map(str, r))
    rows = sorted(got.collect(), key=key)
    assert rows == sorted(want.collect(), key=key) and len(rows) == held.count() and {r.prop_line is None for r in rows} == {True, False}
    by = {(r.game_id, r.outcome): (r.prop_player, r.prop_line) for r in rows}
    lines, teams = {}, {(r.game_id, r.side, r.stat): r.lastname.lower() for r in tops.collect()}
    for r in props.collect():
        lines.setdefault((r.game_id, r.market), []).append((r.player, r.line))
    for (g, o), told in by.items():
        points, rebounds = "TOP_SCORER_25" in o or "TOP_SCORER_30" in o, "REBOUND" in o
        if "WIN" in o:
            assert told == (None, None)
            continue
        least = (28.5 if "30" in o else 23.5) if points else (10.5 if "12" in o else 8.5) if rebounds else float("-inf")
        first = "home" if "DOUBLE_DOUBLE" in o or "HOME" in o or (rebounds and "AWAY" not in o) else "away"
        for side in (first, *(() if points else ({"home": "away", "away": "home"}[first],))):
            one = min((x for x in lines.get((g, "player_rebounds" if rebounds else "player_points"), []) if teams[g, side, "ppg" if points else "rpg"] in x[0].lower()), default=None)
            if one and one[1] >= least:
                assert told == one
                break
        else:
            assert told == (None, None)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan[: plan.index("BroadcastHashJoin")]
