"""Flat ledgers that run short after very many bets are replayed in time."""

import time

from pyspark.sql import functions as F

from slatewise.operators import backtest


def test_long_short_ledger(spark):
    n = 60_000
    hit = F.when(F.col("id") < n - 200, F.when(F.col("id") % 21 < 11, 1).otherwise(0)).otherwise(0)  # even returns, lost at the end
    placed = spark.range(n).select(F.lit("k").alias("k"), F.date_add(F.lit("1900-01-01").cast("date"), (F.col("id") / 7).cast("int")).alias("date"), F.col("id").alias("game_id"), hit.alias("hit"), F.lit(0.6).alias("train_rate"))
    start = time.time()
    r = backtest.results(backtest.ledger(placed, ["k"], "flat"), ["k"]).first()
    bank, bets, wagered = 10_000.0, 0, 0.0
    for i in range(n):
        wager = min(200.0, bank)
        if wager > 0:
            bets, wagered = bets + 1, wagered + wager
            bank += wager * (100 / 110 if i < n - 200 and i % 21 < 11 else -1)
    assert bank < 200 and (r.bets, round(r.wagered, 4), round(r.final, 4)) == (bets, round(wagered, 4), round(bank, 4))
    assert time.time() - start < 30
