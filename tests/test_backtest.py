"""Ledgers against a bet-by-bet replay, also where the bankroll runs out; significance against known values."""

import random

from pyspark.sql import functions as F

from slatewise.functions import significance
from slatewise.operators import backtest, mining


def replay(hits, share=None):
    bank, peak, down, wagered, bets = 10_000.0, 10_000.0, 0.0, 0.0, 0
    for h in hits:
        wager = min(200.0 if share is None else bank * share, bank)
        if wager <= 0:
            continue
        bank += wager * (100 / 110 if h else -1)
        peak, wagered, bets = max(peak, bank), wagered + wager, bets + 1
        down = max(down, (peak - bank) / peak)
    return bets, wagered, bank, peak, down


def test_ledgers(spark):
    rng = random.Random(5)
    runs = {"even": [rng.random() < 0.55 for _ in range(80)], "poor": [rng.random() < 0.1 for _ in range(120)], "lost": [False] * 60, "one": [True]}
    rows = [(k, i // 3, i, int(h), 0.6) for k, hits in runs.items() for i, h in enumerate(hits)]
    placed = spark.createDataFrame(rows, "k string, d int, game_id long, hit int, train_rate double").withColumn("date", F.date_add(F.lit("2000-01-01").cast("date"), F.col("d"))).drop("d")
    full = (100 / 110 * 0.6 - 0.4) / (100 / 110)
    for sizing, share in (("flat", None), ("kelly", min(full, 0.02)), ("halfKelly", min(full / 2, 0.02))):
        got = {r.k: r for r in backtest.results(backtest.ledger(placed, ["k"], sizing), ["k"]).collect()}
        for k, hits in runs.items():
            bets, wagered, bank, peak, down = replay(hits, share)
            r = got[k]
            assert r.bets == bets and all(abs(a - b) < 1e-6 for a, b in ((r.wagered, wagered), (r.final, bank), (r.peak, peak), (r.max_drawdown, down))), (sizing, k)
            assert (r.sharpe is None) == (bets < 30 or len(set(hits[:bets])) == 1)


def test_values(spark):
    l = F.lit  # noqa: E741
    r = spark.range(1).select(
        significance.two_z(l(60), l(100), l(50), l(100)), significance.two_z(l(0), l(0), l(1), l(2)), significance.chi_square(l(60), l(100))[1], significance.sample_size(l(0.056)), significance.decimal_odds(l(150)), significance.decimal_odds(l(-110)),
        significance.implied_probability(l(-110)), significance.kelly(l(0.9), l(-110), 0.25), significance.kelly(l(0.1), l(-110)),
    ).first()
    want = (1.4213, 0, 0.1281, 620, 2.5, 1 + 100 / 110, 110 / 210, 0.25, 0)
    assert all(abs(a - b) < (1.5 if b > 100 else 1e-3) for a, b in zip(r, want, strict=True)), r


def test_matches_need_every_condition(spark):
    keys = mining.CONDITION_KEYS
    code = {"a": 0, "b": 59, "c": 60, "d": 86}
    mask = lambda names, low: sum(1 << (code[n] if low else code[n] - 60) for n in names if (code[n] < 60) == low)
    own = spark.createDataFrame([(g, s, sorted(code[n] for n in names), mask(names, True), mask(names, False), bits) for g, s, names, bits in ((1, 2000, "abc", 1), (2, 2001, "ac", 0), (3, 2000, "", 0))], "game_id int, season int, codes array<int>, low long, high long, bits long")
    combo = lambda names: sum((code[n] + 1) << (mining.DIGIT * (len(names) - 1 - i)) for i, n in enumerate(names))
    patterns = spark.createDataFrame([(combo("ac"), 0, 2000), (combo("b"), 0, 2000), (combo("ad"), 0, 2000), (combo("c"), 1, 2001)], "combo long, o int, test_season int")
    got = mining.matches(own, patterns).withColumn("hit", mining.hit_bit())
    assert sorted((r.game_id, r.combo, r.hit) for r in got.collect()) == sorted([(1, combo("ac"), 1), (1, combo("b"), 1), (2, combo("ac"), 0), (1, combo("c"), 0), (2, combo("c"), 0)])
    own_season = mining.matches(own, patterns, {"season": "test_season"})
    assert sorted((r.game_id, r.combo) for r in own_season.collect()) == sorted([(1, combo("ac")), (1, combo("b")), (2, combo("c"))])
    assert [r[0] for r in patterns.where("o = 1").select(mining.combo_name(keys)).collect()] == [keys[60]]


def test_grade_summary(spark):
    row = spark.createDataFrame([(25.0, 5, 15, 25, "C")], "edge_score double, significance_score int, consistency_score int, pnl_score int, grade string")
    assert row.select(backtest.grade_summary()).first()[0] == "Grade C: Strengths: strong edge over breakeven, excellent P&L metrics. Weaknesses: not statistically significant."
