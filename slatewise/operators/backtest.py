"""Walk-forward tests of game patterns, their bet ledgers and grades."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from slatewise.functions.significance import BREAK_EVEN, chi_square, decimal_odds, implied_probability, kelly, p_value, two_z, variation, wilson, z_score
from slatewise.operators.mining import CONDITION_KEYS, DIGIT, combo_name, hit_bit, masked, matches, pattern_totals
from slatewise.sources.kept import keep

#: Keys of the longest combination in walk-forward tests.
LEGS = 3
FOLD = ["combo", "outcome", "test_season"]
#: Bankroll at the start, share of it that one bet stakes (at most, with Kelly), American odds.
START, FRACTION, ODDS = 10_000.0, 0.02, -110
#: Games that a task walks through at once, all patterns beside each other.
TOGETHER = 512


def candidates(counts: DataFrame, seasons: list[int], legs: int = LEGS, least: int = 15, min_rate: float = 0.58, per_fold: int = 500) -> DataFrame:
    """Per test season the ``per_fold`` best patterns of all seasons before it: FOLD, code, o, train_n, train_hits, confidence, value.

    ``counts`` are those of mining.pattern_counts, of as many keys or more. Counts of a season go to every
    later one, so all folds are mined at once."""
    every = F.array(*[F.lit(s) for s in seasons]).cast("array<int>")
    short = counts.where(F.col("combo") < 1 << (DIGIT * legs))
    later = short.withColumn("test_season", F.explode(F.filter(every, lambda s: s > F.col("season"))))
    found = pattern_totals(later, ["combo", "test_season"], least, min_rate).withColumnRenamed("sample", "train_n").withColumnRenamed("hits", "train_hits")
    n = F.col("train_n")
    whole = F.size(F.filter(every, lambda s: s < F.col("test_season")))
    most_n = found.groupBy("test_season").agg(F.max("train_n").alias("most_n"))
    confidence = 0.4 * n / F.col("most_n") + 0.3 * F.col("n_seasons") / whole + 0.3 * (1 - F.col("most") / n)
    value = (F.col("train_hits") / n - BREAK_EVEN) * F.sqrt(n)
    found = found.join(F.broadcast(most_n), "test_season").withColumnRenamed("combo", "code").withColumns({"confidence": F.round(confidence, 9), "value": F.round(value, 9)})
    found = found.withColumn("combo", combo_name(CONDITION_KEYS, legs, "code"))
    order = Window.partitionBy("test_season").orderBy(F.desc("confidence"), F.desc("value"), "combo", "outcome")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_fold).select(*FOLD, "code", "o", "train_n", "train_hits", "confidence", "value")


def bets(own: DataFrame, found: DataFrame) -> DataFrame:
    """One row per candidate and game of its test season that its conditions fit: FOLD, train_rate, date, game_id, hit.

    ``own``: see mining.profiles. Candidates are few by their limit per fold."""
    per_fold = found.select(F.col("code").alias("combo"), "o", F.col("combo").alias("name"), "outcome", "test_season", (F.col("train_hits") / F.col("train_n")).alias("train_rate"))
    met = matches(own, per_fold, {"season": "test_season"})
    return met.select(F.col("name").alias("combo"), "outcome", "test_season", "train_rate", "date", "game_id", hit_bit().alias("hit"))


def _returns() -> Column:
    return F.when(F.col("hit") == 1, decimal_odds(F.lit(ODDS)) - 1).otherwise(-1.0)


def ledger(placed: DataFrame, by: list[str], sizing: str = "flat") -> DataFrame:
    """``placed`` (by, date, game_id, hit and, for Kelly, train_rate) with wager, profit and the bankroll after each bet.

    ``sizing``: flat stakes a share of the first bankroll, or what is left where that is less; kelly and
    halfKelly stake a share of the current one, so that it is a product, here a sum of logarithms. Bets
    that stake nothing are left out. Flat ledgers that run short are replayed bet by bet (see _replayed),
    the others are running sums."""
    order = Window.partitionBy(*by).orderBy("date", "game_id")
    b = placed.withColumn("ret", _returns())
    if sizing != "flat":
        share = F.least(kelly(F.col("train_rate"), F.lit(ODDS)) * (0.5 if sizing == "halfKelly" else 1.0), F.lit(FRACTION))
        b = b.withColumn("share", share).where("share > 0").withColumn("grown", 1 + F.col("share") * F.col("ret"))
        b = b.withColumn("bankroll", START * F.exp(F.sum(F.log("grown")).over(order))).withColumn("wager", F.col("bankroll") / F.col("grown") * F.col("share"))
        return b.withColumn("profit", F.col("wager") * F.col("ret")).drop("share", "grown", "ret")
    stake = START * FRACTION
    b = b.withColumn("profit", stake * F.col("ret")).withColumn("bankroll", START + F.sum("profit").over(order))
    b = b.withColumn("short", F.max(F.col("bankroll") - F.col("profit") < stake).over(Window.partitionBy(*by)))
    full = b.where("not short").withColumn("wager", F.lit(stake)).drop("short", "ret")
    return full.unionByName(_replayed(b.where("short").select(*placed.columns, "ret"), by, stake))


def _replayed(bets: DataFrame, by: list[str], stake: float) -> DataFrame:
    """``bets`` (by, date, game_id, ret) bet by bet, with wager, profit and bankroll: each stakes ``stake`` or what is left. A task reads its
    ledgers in order and holds a batch of rows and one bankroll."""
    names = [c for c in bets.columns if c != "ret"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ledger, bank = None, START
        for batch in batches:
            wagers, profits, banks = [], [], []
            for key, ret in zip(zip(*(batch.column(c).to_pylist() for c in by), strict=True), batch.column("ret").to_pylist(), strict=True):
                if key != ledger:
                    ledger, bank = key, START
                wagers.append(min(stake, bank))
                profits.append(wagers[-1] * ret)
                bank += profits[-1]
                banks.append(bank)
            done = pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(wagers, pa.float64()), pa.array(profits, pa.float64()), pa.array(banks, pa.float64())], names=[*names, "wager", "profit", "bankroll"])
            yield done.filter(pc.greater(done.column("wager"), 0))

    schema = StructType([*bets.select(*names).schema, *(StructField(c, DoubleType()) for c in ("wager", "profit", "bankroll"))])
    return bets.repartition(*by).sortWithinPartitions(*by, "date", "game_id").mapInArrow(run, schema)


def _asked(found: DataFrame, share: Column) -> DataFrame:
    """A kept table of the ledgers of ``found``: FOLD, o, share, masks and a number, ``_at``. They are few by a limit of theirs (candidates of a fold, stored patterns)."""
    codes = masked(found.select(*FOLD, F.col("code").alias("combo_"), "o", share.alias("share")).withColumnsRenamed({"combo": "_name", "combo_": "combo"}))
    return keep(codes.withColumnRenamed("combo", "code").withColumnRenamed("_name", "combo").withColumn("_at", F.row_number().over(Window.orderBy(*FOLD))), "walked")


def _of_seasons(listed: DataFrame, *columns: str) -> dict[int, list[np.ndarray]]:
    """``columns`` of ``listed`` (see _asked) by test season."""
    rows = listed.select("test_season", *columns).toArrow()
    seasons = rows["test_season"].to_numpy()
    return {int(s): [rows[c].to_numpy()[seasons == s] for c in columns] for s in np.unique(seasons)}


def _in_order(own: DataFrame) -> DataFrame:
    """Games (season, date, low, high, bits) in the order in which ledgers bet on them, over all tasks and within each."""
    ordered = own.repartitionByRange(own.sparkSession.sparkContext.defaultParallelism, "season", "date", "game_id").sortWithinPartitions("season", "date", "game_id")
    return ordered.select("season", "date", "low", "high", "bits")


def _pieces(batch: pa.RecordBatch, by: list[str]) -> Iterator[pa.RecordBatch]:
    """The parts of ``batch`` of equal ``by``; its rows are in their order."""
    keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in by]
    ends = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
    for a, b in zip([0, *ends], [*ends, batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def _walks(own: DataFrame, listed: DataFrame, by: list[str]) -> DataFrame:
    """What each run of games (of equal ``by``, of one batch) does to each ledger of ``listed`` (see _asked, _run): _at, run, date of its first game and the
    numbers of _run. Tasks hold games in order against their season's patterns; no bet is a row."""
    asked, win = _of_seasons(listed, "_at", "_low", "_high", "o", "share"), 100 / abs(ODDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = TaskContext.get().partitionId() << 32
        for piece in (p for batch in batches if batch.num_rows for p in _pieces(batch, by)):
            season = piece.column("season")[0].as_py()
            if season not in asked:
                continue
            at, low, high, o, share = asked[season]
            mine, far, bits = (piece.column(c).to_numpy() for c in ("low", "high", "bits"))
            up, down, sums = np.log1p(share * win), np.log1p(-share), None
            for k in range(0, len(mine), TOGETHER):
                fit = ((mine[k : k + TOGETHER, None] & low) == low) & ((far[k : k + TOGETHER, None] & high) == high)
                hit = (bits[k : k + TOGETHER, None] >> o & 1).astype(bool)
                part = _run(fit, hit & fit, up, down)
                sums = part if sums is None else _joined(sums, part)
            some = sums["n"] > 0
            n = int(some.sum())
            yield pa.RecordBatch.from_arrays([pa.array(at[some]), pa.array(np.full(n, order)), pa.array([piece.column("date")[0].as_py()] * n, pa.date32()), *[pa.array(v[some]) for v in sums.values()]], names=["_at", "run", "date", *sums])
            order += 1

    return _in_order(own).mapInArrow(run, "_at int, run long, date date, n long, h long, total double, top double, bottom double, fall double, staked double, lost double, won double")


def _share(sizing: str) -> Column:
    """The share of the bankroll that a ledger stakes, from ``train_rate``."""
    return F.greatest(F.least(kelly(F.col("train_rate"), F.lit(ODDS)) * (0.5 if sizing == "halfKelly" else 1.0), F.lit(FRACTION)), F.lit(0.0))


def _sharpe(n: Column, h: Column) -> Column:
    """Mean by spread of the returns of ``n`` bets with ``h`` hits; null under 30 bets or without spread."""
    win = 100 / abs(ODDS)
    return F.when((n >= 30) & (h > 0) & (h < n), (h * win - (n - h)) / ((win + 1) * F.sqrt(h * (n - h))))


def walked(own: DataFrame, found: DataFrame, sizing: str = "halfKelly") -> DataFrame:
    """(FOLD, test_n, test_hits and what ``results`` tells of a ledger) of each of ``found`` (FOLD, code, o, train_rate) in its test season.

    ``own``: see mining.profiles. Stakes are a share of the bankroll, so its logarithm is a sum over bets and a run of games, whatever was before it,
    is told by few numbers (see _run), which join to those of the next run. Tasks hold games in order against their season's patterns and give these
    numbers; no bet is a row. ``found`` are few by a limit of theirs (candidates of a fold, stored patterns). A pattern that stakes nothing has no ledger."""
    listed = _asked(found, _share(sizing))
    runs = _walks(own, listed, ["season"])
    each = F.array_sort(F.collect_list(F.struct("run", "n", "h", "total", "top", "bottom", "fall", "staked", "lost")))
    none = F.struct(*[F.lit(v).alias(c) for c, v in (("total", 0.0), ("top", 0.0), ("bottom", 0.0), ("fall", 0.0), ("staked", 0.0), ("lost", float("-inf")))])

    def join(a: Column, b: Column) -> Column:
        return F.struct(
            (a["total"] + b["total"]).alias("total"), F.greatest(a["top"], a["total"] + b["top"]).alias("top"), F.least(a["bottom"], a["total"] + b["bottom"]).alias("bottom"),
            F.greatest(a["fall"], b["fall"], a["top"] - a["total"] - b["bottom"]).alias("fall"), (a["staked"] + F.exp(a["total"]) * b["staked"]).alias("staked"), F.greatest(a["lost"], a["total"] + b["lost"]).alias("lost"),
        )

    path = runs.groupBy("_at").agg(F.sum("n").alias("test_n"), F.sum("h").alias("test_hits"), each.alias("runs")).withColumn("p", F.aggregate("runs", none, join))
    n, h, nan = F.col("test_n"), F.col("test_hits"), F.lit(float("nan"))
    money = path.join(F.broadcast(listed.drop("code", "o", "_low", "_high", "_key")), "_at")
    # a bankroll beyond the doubles is infinite, as the ledger's is, and so are its profits; infinite ones of both signs have no sum
    over = F.isnan("peak") | (F.col("peak") == float("inf"))
    money = money.withColumn("peak", START * F.exp("p.top")).withColumns({
        "wagered": F.when(over, float("inf")).otherwise(START * F.col("share") * F.col("p.staked")), "net": F.when(over & (START * F.exp("p.lost") == float("inf")), nan).when(over, float("inf")).otherwise(START * F.expm1("p.total")),
        "max_drawdown": F.when(over, nan).otherwise(-F.expm1(-F.col("p.fall"))), "sharpe": _sharpe(n, h),
    })
    plays = lambda c: F.when(F.col("share") > 0, c)
    told = {"bets": n, "wins": h, "wagered": F.col("wagered"), "net": F.col("net"), "roi": F.col("net") / F.col("wagered"), "peak": F.col("peak"), "final": START + F.col("net"), "max_drawdown": F.col("max_drawdown"), "sharpe": F.col("sharpe")}
    return money.select(*FOLD, "test_n", "test_hits", *[plays(c).alias(k) for k, c in told.items()])


def walked_days(own: DataFrame, found: DataFrame, by: str = "test_season", sizing: str = "halfKelly") -> DataFrame:
    """(by, date, bets, wins, wagered, profit): what all ledgers of ``found`` (see walked) made on a date, for ``combined_days``.

    A ledger gives the numbers of its bets of a date (see _run) as of a first bankroll of 1; those of the dates before tell which bankroll it had. So
    there are rows of ledgers and dates, not of bets. Bankrolls beyond the doubles are infinite, see walked."""
    listed = _asked(found, _share(sizing)).where("share > 0")
    before = Window.partitionBy("_at").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    days = _walks(own, listed, ["season", "date"]).select("_at", "run", "date", "n", "h", "total", "staked", "lost", "won").withColumn("grown", F.coalesce(F.sum("total").over(before), F.lit(0.0)))
    bank, (won, lost) = START * F.exp("grown"), [START * F.exp(F.col("grown") + F.col(c)) == float("inf") for c in ("won", "lost")]
    profit = F.when(won & lost, float("nan")).when(won, float("inf")).when(lost, float("-inf")).otherwise(bank * F.expm1("total"))
    made = days.join(F.broadcast(listed.select(*dict.fromkeys(["_at", "share", by]))), "_at").withColumns({"wagered": F.when(won | lost, float("inf")).otherwise(bank * F.col("share") * F.col("staked")), "profit": profit})
    return made.groupBy(by, "date").agg(F.sum("n").alias("bets"), F.sum("h").alias("wins"), F.sum("wagered").alias("wagered"), F.sum("profit").alias("profit"))


def walked_flat(own: DataFrame, found: DataFrame) -> DataFrame:
    """``walked`` by flat stakes, a share of the first bankroll or what is left where that is less (see ledger); ``found``: FOLD, code, o.

    A short bankroll hangs on each bet before it, so a ledger is walked through in one task; but a bet is one bit there. Tasks hold games in
    order against their season's patterns and give the hits and misses of each ledger as bits; these go to the ledger's task, which holds the
    bits of a batch of games and one bankroll."""
    listed = _asked(found, F.lit(FRACTION))
    asked = _of_seasons(listed, "_at", "_low", "_high", "o")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = TaskContext.get().partitionId() << 32
        for piece in (p for batch in batches if batch.num_rows for p in _pieces(batch, ["season"])):
            mine, far, bits = (piece.column(c).to_numpy() for c in ("low", "high", "bits"))
            held = []
            for at, low, high, o in zip(*asked.get(piece.column("season")[0].as_py(), [()] * 4), strict=True):
                came = bits[((mine & low) == low) & ((far & high) == high)] >> o & 1
                if len(came):
                    held.append((int(at), order, len(came), np.packbits(came.astype(np.uint8)).tobytes()))
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["_at", "run", "n", "hits"])
            order += 1

    def told(at: int, book: dict[str, float]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"_at": at} | book], pa.schema([("_at", pa.int32()), *[(k, pa.int64() if isinstance(v, int) else pa.float64()) for k, v in book.items()]]))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ledger, book = None, {}
        for batch in batches:
            for at, n, hits in zip(*(batch.column(c).to_pylist() for c in ("_at", "n", "hits")), strict=True):
                if at != ledger:
                    if ledger is not None:
                        yield told(ledger, book)
                    ledger, book = at, {"test_n": 0, "test_hits": 0, "bets": 0, "wins": 0, "wagered": 0.0, "net": 0.0, "bank": START, "peak": START, "max_drawdown": 0.0}
                _bet_flat(book, np.unpackbits(np.frombuffer(hits, np.uint8), count=n))
        if ledger is not None:
            yield told(ledger, book)

    bits = _in_order(own).mapInArrow(run, "_at int, run long, n int, hits binary")
    books = bits.repartition("_at").sortWithinPartitions("_at", "run").mapInArrow(walk, "_at int, test_n long, test_hits long, bets long, wins long, wagered double, net double, bank double, peak double, max_drawdown double")
    return books.join(F.broadcast(listed.select("_at", *FOLD)), "_at").select(*FOLD, "test_n", "test_hits", "bets", "wins", "wagered", "net", (F.col("net") / F.col("wagered")).alias("roi"), "peak", (START + F.col("net")).alias("final"), "max_drawdown", _sharpe(F.col("bets"), F.col("wins")).alias("sharpe"))


def _bet_flat(book: dict[str, float], hit: np.ndarray) -> None:
    """Places the next bets, ``hit`` (1 or 0), of a ledger. Up to the first that the bankroll is short of, stakes are full and it is a running sum,
    added up in the order of the bets; one that it is short of stakes what is left. With nothing left no bet is placed."""
    stake, ret = START * FRACTION, np.where(hit, 100 / abs(ODDS), -1.0)
    book["test_n"] += len(hit)
    book["test_hits"] += int(hit.sum())
    at = 0
    while at < len(hit) and book["bank"] > 0:
        path = np.cumsum(np.r_[book["bank"], stake * ret[at : at + TOGETHER]])
        short = path[:-1] < stake
        n = int(short.argmax()) if short.any() else len(short)
        wager = stake if n else book["bank"]
        path = path[1 : n + 1] if n else np.array([book["bank"] + wager * ret[at]])
        n = max(n, 1)
        wins = int(hit[at : at + n].sum())
        top = np.maximum(np.maximum.accumulate(path), book["peak"])
        book["bets"] += n
        book["wins"] += wins
        book["wagered"] += wager * n
        book["net"] += wager * (wins * (100 / abs(ODDS)) - (n - wins))
        book["bank"], book["peak"], book["max_drawdown"] = float(path[-1]), float(top[-1]), max(book["max_drawdown"], float(((top - path) / top).max()))
        at += n


def _run(fit: np.ndarray, hit: np.ndarray, up: np.ndarray, down: np.ndarray) -> dict[str, np.ndarray]:
    """What a run of games (rows) does to each ledger (columns): bets, hits, the logarithm by which the bankroll grows in all, its top and bottom on the way
    (from 0), its largest fall, the sum of the bankrolls that were staked on, and the largest one after a lost and after a won bet; all for a first bankroll of 1."""
    step = np.where(hit, up, np.where(fit, down, 0.0))
    path = np.cumsum(step, axis=0)
    top = np.maximum.accumulate(np.maximum(path, 0.0), axis=0)
    before = np.exp(path - step, where=fit, out=np.zeros_like(path))
    return {
        "n": fit.sum(axis=0), "h": hit.sum(axis=0), "total": path[-1], "top": top[-1], "bottom": np.minimum(path.min(axis=0), 0.0), "fall": (top - path).max(axis=0), "staked": before.sum(axis=0),
        "lost": np.max(path, axis=0, where=fit & ~hit, initial=-np.inf), "won": np.max(path, axis=0, where=hit, initial=-np.inf),
    }


def _joined(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """``_run`` of a run of games and the next one."""
    t = a["total"]
    return {
        "n": a["n"] + b["n"], "h": a["h"] + b["h"], "total": t + b["total"], "top": np.maximum(a["top"], t + b["top"]), "bottom": np.minimum(a["bottom"], t + b["bottom"]),
        "fall": np.maximum(np.maximum(a["fall"], b["fall"]), a["top"] - t - b["bottom"]), "staked": a["staked"] + np.exp(t) * b["staked"], "lost": np.maximum(a["lost"], t + b["lost"]), "won": np.maximum(a["won"], t + b["won"]),
    }


def results(book: DataFrame, by: list[str]) -> DataFrame:
    """Per ledger: bets, wins, wagered, net, roi, peak, final, max_drawdown, sharpe (null under 30 bets or without spread)."""
    order = Window.partitionBy(*by).orderBy("date", "game_id")
    b = book.withColumn("peak", F.greatest(F.lit(START), F.max("bankroll").over(order))).withColumn("ret", _returns())
    sums = b.groupBy(*by).agg(
        F.count("*").alias("bets"), F.sum("hit").alias("wins"), F.sum("wager").alias("wagered"), F.sum("profit").alias("net"), F.max("peak").alias("peak"), F.max((F.col("peak") - F.col("bankroll")) / F.col("peak")).alias("max_drawdown"),
        F.avg("ret").alias("mean"), F.stddev_pop("ret").alias("sd"),
    )
    return sums.select(*by, "bets", "wins", "wagered", "net", F.when(F.col("wagered") > 0, F.col("net") / F.col("wagered")).otherwise(0.0).alias("roi"), "peak", (START + F.col("net")).alias("final"), "max_drawdown", F.when((F.col("bets") >= 30) & (F.col("sd") > 1e-12), F.col("mean") / F.col("sd")).alias("sharpe"))


def _steps(value: Column, bounds: list[tuple[float, int]], test: str = ">=") -> Column:
    """Points of the first bound that ``value`` reaches (or, with <, stays under), else 0."""
    out = F.lit(0)
    for bound, points in reversed(bounds):
        out = F.when(value >= bound if test == ">=" else value < bound, points).otherwise(out)
    return out


def grade(train_rate: Column, rate: Column, z: Column, p: Column, width: Column, consistent: Column, roi: Column, drawdown: Column, sharpe: Column, n_bets: Column, ev: Column) -> dict[str, Column]:
    """Four scores of 0 to 25, their total and the letter. Bounds and points are fixed values; money is held against them to nine digits."""
    roi, drawdown, sharpe = F.round(roi, 9), F.round(drawdown, 9), F.round(sharpe, 9)
    edge = F.least(F.greatest((rate - BREAK_EVEN) / 0.15 * 25, F.lit(0.0)), F.lit(25.0))
    sure = _steps(z, [(1.96, 10), (1.65, 7), (1.28, 4)]) + _steps(p, [(0.01, 8), (0.05, 5), (0.10, 2)], "<") + _steps(width, [(0.10, 7), (0.15, 5), (0.20, 3)], "<")
    lost = (train_rate - rate) / train_rate
    steady = F.when(rate >= train_rate, 15).otherwise(_steps(lost, [(0.05, 12), (0.10, 9), (0.15, 6), (0.25, 3)], "<")) + F.when(consistent, 10).otherwise(0)
    money = F.when(roi >= 0.10, 10).when(roi >= 0.05, 8).when(roi > 0, 5).when(roi > -0.05, 2).otherwise(0) + _steps(drawdown, [(0.10, 5), (0.20, 3), (0.30, 1)], "<")
    money = money + F.when(sharpe.isNotNull(), _steps(sharpe, [(1.5, 5), (1.0, 4), (0.5, 2)])).when((n_bets >= 30) & (roi > 0), 2).otherwise(0) + F.when(ev > 0.05, 5).when(ev > 0.02, 3).when(ev > 0, 1).otherwise(0)
    parts = {"edge_score": edge, "significance_score": F.least(sure, F.lit(25)), "consistency_score": F.least(steady, F.lit(25)), "pnl_score": F.least(money, F.lit(25))}
    total = parts["edge_score"] + parts["significance_score"] + parts["consistency_score"] + parts["pnl_score"]
    return parts | {"total_score": total, "grade": F.when(total >= 85, "A").when(total >= 70, "B").when(total >= 55, "C").when(total >= 40, "D").otherwise("F")}


#: What a score of 20 or more, or of less than 10, says in a summary.
SAID = {
    "edge_score": ("strong edge over breakeven", "limited edge"), "significance_score": ("statistically significant", "not statistically significant"),
    "consistency_score": ("consistent train/test performance", "significant degradation in testing"), "pnl_score": ("excellent P&L metrics", "poor P&L performance"),
}


def grade_summary() -> Column:
    """A sentence on strengths and weaknesses, from the columns of ``grade``."""
    strong = F.concat_ws(", ", *[F.when(F.col(c) >= 20, s) for c, (s, _) in SAID.items()])
    weak = F.concat_ws(", ", *[F.when(F.col(c) < 10, w) for c, (_, w) in SAID.items()])
    said = F.concat(F.when(strong != "", F.concat(F.lit("Strengths: "), strong, F.lit(". "))).otherwise(""), F.when(weak != "", F.concat(F.lit("Weaknesses: "), weak, F.lit("."))).otherwise(""))
    return F.concat(F.lit("Grade "), F.col("grade"), F.lit(": "), F.when(said == "", "Average performance across all metrics.").otherwise(said))


def tested(found: DataFrame, placed: DataFrame, book: DataFrame, min_test: int = 5) -> DataFrame:
    """Candidates with ``min_test`` games in their test season: significance, profit and grade. Their own ``rate``, where they have one,
    stands for that of their training hits.

    A pattern whose stakes are all 0 has a ledger of no bets: no profit and no drawdown."""
    seen = placed.groupBy(*FOLD).agg(F.count("*").alias("test_n"), F.sum("hit").alias("test_hits"))
    return judged(found, seen.join(results(book, FOLD), FOLD, "left"), min_test)


def judged(found: DataFrame, played: DataFrame, min_test: int = 5) -> DataFrame:
    """``tested`` of ``played`` (see walked): how the test season went and what its ledger made; null where it staked nothing."""
    none = {c: F.coalesce(c, F.lit(v)) for c, v in (("bets", 0), ("wins", 0), ("wagered", 0.0), ("net", 0.0), ("roi", 0.0), ("max_drawdown", 0.0))}
    t = found.join(played.where(F.col("test_n") >= min_test).withColumns(none), FOLD)
    h, n, train = F.col("test_hits"), F.col("test_n"), (F.col("train_hits"), F.col("train_n"))
    low, high = wilson(h, n)
    chi, chi_p = chi_square(h, n)
    rate = F.col("rate") if "rate" in found.columns else train[0] / train[1]
    t = t.withColumns({"train_rate": rate, "test_rate": h / n, "z": z_score(h, n), "z_train": two_z(h, n, *train), "low": low, "high": high, "chi": chi, "chi_p": chi_p})
    t = t.withColumns({"p": p_value(F.col("z")), "p_train": p_value(F.col("z_train")), "ev": F.col("train_rate") * (decimal_odds(F.lit(ODDS)) - 1) - (1 - F.col("train_rate"))})
    trained = F.coalesce(F.try_divide(*train), F.lit(0.0))  # not ``rate``: consistency is with the games of the training
    t = t.withColumns({"significant": (F.col("p") < 0.05) & (F.col("test_rate") > BREAK_EVEN), "consistent": (F.col("p_train") > 0.05) | (F.col("test_rate") >= trained)})
    marks = grade(*[F.col(c) for c in ("train_rate", "test_rate", "z", "p")], F.col("high") - F.col("low"), *[F.col(c) for c in ("consistent", "roi", "max_drawdown", "sharpe", "bets", "ev")])
    return t.withColumns({k: v for k, v in marks.items()}).withColumn("summary", grade_summary())


def leave_one_out(by_season: DataFrame, own: DataFrame, min_train: int = 10, sizing: str = "halfKelly") -> DataFrame:
    """Stored patterns tested on each season with the others as training, of which they need ``min_train`` games.

    ``by_season``: combo, outcome, code, o, season, n, h. ``own``: see mining.profiles."""
    whole = by_season.groupBy("combo", "outcome").agg(F.sum("n").alias("all_n"), F.sum("h").alias("all_h"))
    found = by_season.join(whole, ["combo", "outcome"]).select("combo", "outcome", "code", "o", F.col("season").alias("test_season"), (F.col("all_n") - F.col("n")).alias("train_n"), (F.col("all_h") - F.col("h")).alias("train_hits")).where(F.col("train_n") >= min_train)
    return _held_against(found, own, F.col("train_hits") / F.col("train_n"), sizing)


def stored_test(patterns: DataFrame, by_season: DataFrame, own: DataFrame, test_season: int, n: int = 100, sizing: str = "halfKelly") -> DataFrame:
    """The ``n`` best stored patterns (see mining.top) tested on one season; their rate over all seasons stands for that of training."""
    best = patterns.orderBy(F.desc("confidence"), F.desc("value"), "name", "outcome").limit(n).select(F.col("name").alias("combo"), "outcome", F.col("combo").alias("code"), "o", F.col("hit_rate").alias("rate"))
    before = F.col("season") < test_season
    sums = by_season.groupBy("combo", "outcome").agg(F.sum(F.when(before, F.col("n")).otherwise(0)).alias("train_n"), F.sum(F.when(before, F.col("h")).otherwise(0)).alias("train_hits"))
    found = best.join(sums, ["combo", "outcome"]).withColumn("test_season", F.lit(test_season))
    return _held_against(found, own, F.col("rate"), sizing)


def _held_against(found: DataFrame, own: DataFrame, rate: Column, sizing: str) -> DataFrame:
    found = keep(found, "found")
    return judged(found, walked(own, found.withColumn("train_rate", rate), sizing))


def quick(by_season: DataFrame, min_n: int = 3) -> DataFrame:
    """Per stored pattern over its seasons of ``min_n`` games: mean rate, its spread, how much hits vary, and whether every season pays."""
    rate = F.col("h") / F.col("n")
    own = by_season.where(F.col("n") >= min_n)
    return own.groupBy("combo", "outcome").agg(F.count("*").alias("seasons"), F.avg(rate).alias("mean_rate"), (F.max(rate) - F.min(rate)).alias("spread"), variation("h").alias("variation"), (F.min(rate) > BREAK_EVEN).alias("stable"))


def report(done: DataFrame, n: int = 100) -> DataFrame:
    """The ``n`` first tested patterns by grade, then return on investment."""
    return done.orderBy("grade", F.desc(F.round("roi", 9)), *FOLD).limit(n)


def robust(done: DataFrame) -> DataFrame:
    """Of the patterns that made a profit in every fold, the fold with the highest z."""
    folds = done.agg(F.count_distinct("test_season").alias("n")).select("n").scalar()
    best = done.groupBy("combo", "outcome").agg(F.count("*").alias("folds"), F.min("roi").alias("least_roi"), F.max_by("test_season", F.struct(F.round("z", 9), -F.col("test_season"))).alias("test_season"), F.max("z").alias("z"))
    return best.where((F.col("folds") == folds) & (F.col("least_roi") > 0)).select("combo", "outcome", "folds", "test_season", "z")


def fold_summary(done: DataFrame) -> DataFrame:
    """Per fold: patterns tested, passed (significant or profitable), degraded, hit rate, edge, profit and its share of flat stakes."""
    s = done.groupBy("test_season").agg(
        F.count("*").alias("tested"), F.count_if(F.col("significant") | (F.col("roi") > 0)).alias("passed"), F.count_if(F.col("test_rate") < 0.85 * F.col("train_rate")).alias("degraded"),
        F.sum("test_hits").alias("hits"), F.sum("test_n").alias("n"), F.sum("net").alias("net"), F.sum("bets").alias("bets"),
    )
    return s.select("test_season", "tested", "passed", "degraded", (F.col("hits") / F.col("n")).alias("hit_rate"), (F.col("hits") / F.col("n") - BREAK_EVEN).alias("edge"), "net", F.when(F.col("bets") > 0, F.col("net") / (F.col("bets") * START * FRACTION)).otherwise(0.0).alias("fold_roi"))


def combined(book: DataFrame, by: str) -> DataFrame:
    """All ledgers of a run replayed on one bankroll, by days: the bets of a date are settled together.

    Each day is summed before the running sum over days, so that no task holds a run's bets. The bankroll may fall below 0."""
    return combined_days(book.groupBy(by, "date").agg(F.count("*").alias("bets"), F.sum("hit").alias("wins"), F.sum("wager").alias("wagered"), F.sum("profit").alias("profit")), by)


def combined_days(day: DataFrame, by: str) -> DataFrame:
    """``combined`` of days that are summed (by, date, bets, wins, wagered, profit; see walked_days)."""
    order = Window.partitionBy(by).orderBy("date")
    run = day.withColumn("bankroll", START + F.sum("profit").over(order)).withColumn("peak", F.greatest(F.lit(START), F.max("bankroll").over(order)))
    s = run.groupBy(by).agg(F.sum("bets").alias("bets"), F.sum("wins").alias("wins"), F.sum("wagered").alias("wagered"), F.sum("profit").alias("net"), F.max("peak").alias("peak"), F.max((F.col("peak") - F.col("bankroll")) / F.col("peak")).alias("max_drawdown"))
    return s.select(by, "bets", "wins", "net", F.when(F.col("wagered") > 0, F.col("net") / F.col("wagered")).otherwise(0.0).alias("roi"), "peak", (START + F.col("net")).alias("final"), "max_drawdown")


def closing_value(odds: DataFrame, by: list[str]) -> DataFrame:
    """Mean closing-line value of ``odds`` (American; null: the standard) and how often it was above and below 0.

    Bets of the same odds are counted first: what is summed are kinds of odds, not bets."""
    alike = odds.groupBy(*by, "odds").agg(F.count("*").alias("n"))
    value = implied_probability(F.lit(ODDS)) - implied_probability(F.coalesce(F.col("odds"), F.lit(ODDS)))
    times = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return alike.withColumn("v", value).groupBy(*by).agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("value"), times(F.col("v") > 0).alias("above"), times(F.col("v") < 0).alias("below"))
