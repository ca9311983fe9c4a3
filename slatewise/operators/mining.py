"""Pattern mining: combinations of events, scores, and the games that a pattern fits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from slatewise.functions.significance import BREAK_EVEN
from slatewise.operators import vertical
from slatewise.operators.games import CONDITIONS, OUTCOMES
from slatewise.sources.kept import keep

#: Keys of the longest combination.
LEGS = 4
OUTCOME_KEYS = tuple(f"{k}:game" for k in OUTCOMES)
#: Conditions by name; a condition's number is its place here.
CONDITION_KEYS = tuple(sorted(CONDITIONS))
#: A combination of numbered keys is one number: a digit of this base for each key, from 1, the first key first.
DIGIT = 7
#: Games that a condition pattern must have.
LEAST = 15
#: Patterns that are stored: of nights, of games.
STORED, STORED_GAMES = 5000, 2000
#: Games that a task holds against all patterns at once.
FITTED = 2048
#: A season's nights have a bit each in so many 64-bit words, from the first of August before it (448 days: late ends fit).
SEASON_WORDS, SEASON_START = 7, 8


# ---- combinations of numbered keys, made within rows
def spread(own: DataFrame, legs: int) -> DataFrame:
    """Every combination of up to ``legs`` of a row's rising ``codes`` as the number ``combo``, beside the row's other columns.

    A chain of explodes in one pass: each combination ends or grows by a later key of its row. So what is
    shuffled is only what is counted of them, aggregated in each task."""
    rest = [c for c in own.columns if c != "codes"]
    n = F.size("codes")
    level = own.select(*rest, "codes", F.posexplode("codes").alias("_at", "_code")).select(*rest, "codes", "_at", (F.col("_code") + 1).cast("long").alias("combo"))
    for _ in range(1, legs):
        end = F.array(F.lit(-1))
        later = F.when((F.col("_at") >= 0) & (F.col("_at") + 1 < n), F.concat(end, F.sequence(F.col("_at") + 1, n - 1))).otherwise(end)
        level = level.select(*rest, "codes", "combo", F.explode(later).alias("_at"))
        grown = F.shiftleft("combo", DIGIT) + F.get("codes", F.col("_at")) + 1
        level = level.withColumn("combo", F.when(F.col("_at") >= 0, grown).otherwise(F.col("combo")))
    return level.select(*rest, "combo")


def digit(place: int, combo: str = "combo") -> Column:
    """The key's number, from 1, at a place of ``combo`` from the right; 0 where it is shorter."""
    return F.call_function("shiftright", F.col(combo), F.lit(DIGIT * place)).bitwiseAND(F.lit((1 << DIGIT) - 1).cast("long")).cast("int")


def combo_name(keys: tuple[str, ...], legs: int = LEGS, combo: str = "combo") -> Column:
    """The keys of ``combo`` joined by +."""
    names = F.array(*[F.lit(k) for k in keys])
    return F.concat_ws("+", *[F.get(names, digit(p, combo) - 1) for p in reversed(range(legs))])


def combinations(events: DataFrame, unit: str, legs: int, least: int) -> DataFrame:
    """(unit, season, combo) of every sorted combination of up to ``legs`` event keys that ``least`` units have.

    Keys are numbered by name; there may be 127 of them."""
    keys = tuple(r[0] for r in events.select("event_key").distinct().orderBy("event_key").limit(1 << DIGIT).collect())
    if len(keys) >= 1 << DIGIT:
        raise ValueError("more than 127 event keys")
    number = F.create_map(*[F.lit(x) for i, k in enumerate(keys) for x in (k, i)]) if keys else F.create_map().cast("map<string, int>")
    own = events.groupBy(unit, "season").agg(F.array_sort(F.collect_set(F.try_element_at(number, F.col("event_key")))).alias("codes"))
    rows = spread(own, legs)
    frequent = rows.groupBy("combo").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("combo")
    return rows.join(frequent, "combo", "left_semi").withColumn("combo", combo_name(keys, legs))


# ---- night patterns: a calendar has few nights, so a combination is a bitmap of them
def calendar(events: DataFrame) -> list[int]:
    """The seasons of ``events`` in order."""
    return [r[0] for r in events.select("season").distinct().orderBy("season").collect()]


def _slot(seasons: list[int]) -> Column:
    """The bit of a row's ``date``: SEASON_WORDS words for each season, by days from its start. A night outside its season is an error."""
    off = F.datediff("date", F.make_date(F.col("season"), F.lit(SEASON_START), F.lit(1)))
    day = F.when(off.between(0, 64 * SEASON_WORDS - 1), off).otherwise(F.raise_error(F.concat(F.lit("a night outside its season: "), F.col("date").cast("string"))).cast("int"))
    return (F.array_position(F.array(*[F.lit(s) for s in seasons]), F.col("season")) - 1).cast("int") * (64 * SEASON_WORDS) + day


def slot_date(slot: Column, seasons: list[int]) -> Column:
    first = F.make_date(F.get(F.array(*[F.lit(s) for s in seasons]), F.floor(slot / (64 * SEASON_WORDS)).cast("int")), F.lit(SEASON_START), F.lit(1))
    return F.date_add(first, (slot % (64 * SEASON_WORDS)).cast("int"))


def _count(bits: Column) -> Column:
    return F.aggregate(bits, F.lit(0), lambda n, w: n + F.bit_count(w))


def season_hits(seasons: list[int]) -> Column:
    """Hits of each season from ``bits``."""
    return F.array(*[_count(F.slice("bits", SEASON_WORDS * i + 1, SEASON_WORDS)) for i in range(len(seasons))])


def hit_dates(seasons: list[int]) -> Column:
    """The dates of ``bits`` in order."""
    words = F.transform(F.sequence(F.lit(0), F.lit(max(0, SEASON_WORDS * len(seasons) - 1))), lambda w: F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.bit_get(F.element_at("bits", w + 1), b) == 1), lambda b: slot_date(w * 64 + b, seasons)))
    return F.flatten(words)


def night_bitmaps(events: DataFrame, seasons: list[int]) -> DataFrame:
    """(event_key, bits): for each key the nights that it holds, as 64-bit words in the order of the calendar."""
    slot = _slot(seasons)
    words = events.select("event_key", F.floor(slot / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int")).alias("bit")).groupBy("event_key", "word").agg(F.bit_or("bit").alias("b"))
    held = words.groupBy("event_key").agg(F.map_from_entries(F.collect_list(F.struct("word", "b"))).alias("m"))
    every = F.sequence(F.lit(0), F.lit(max(0, SEASON_WORDS * len(seasons) - 1)))
    return held.select("event_key", F.transform(every, lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0).cast("long"))).alias("bits"))


def night_combinations(events: DataFrame, seasons: list[int], legs: int = LEGS, least: int = 3) -> DataFrame:
    """(combo, legs, bits) of every sorted combination of up to ``legs`` keys that ``least`` nights have.

    The bitmaps of the catalog's keys (its keys times a bit a night) are broadcast; level by level a
    combination meets each later key and their bitmaps are intersected, in its row: nothing is shuffled but the
    pairs, once, to deal them out. Support falls along a chain, so rare combinations end it."""
    single = keep(night_bitmaps(events, seasons).where(_count(F.col("bits")) >= least), "bitmaps")
    keys = [r[0] for r in single.select("event_key").orderBy("event_key").collect()]
    n = len(keys)
    single = single.withColumn("code", F.array_position(F.array(*[F.lit(k) for k in keys]).cast("array<string>"), F.col("event_key")).cast("int"))
    later = F.broadcast(single.select("code", F.col("event_key").alias("_key"), F.col("bits").alias("_bits")))
    level = single.select(F.col("event_key").alias("combo"), "code", "bits")
    out = level.select("combo", F.lit(1).alias("legs"), "bits")
    for size in range(2, legs + 1):
        grown = level.where(F.col("code") < n).withColumn("code", F.explode(F.sequence(F.col("code") + 1, F.lit(n)))).join(later, "code")
        both = grown.select(F.concat_ws("+", "combo", "_key").alias("combo"), "code", F.zip_with("bits", "_bits", lambda a, b: a.bitwiseAND(b)).alias("bits"))
        level = both.where(_count(F.col("bits")) >= least)
        if size == 2:
            level = level.repartition(events.sparkSession.sparkContext.defaultParallelism, "combo")
        out = out.unionByName(level.select("combo", F.lit(size).alias("legs"), "bits"))
    return out


def night_patterns(events: DataFrame, legs: int = LEGS, least: int = 3, reference_date: str = "2001-01-01") -> DataFrame:
    """Combinations of night events that pass the season filters: combo, legs, bits, hits, n_seasons and the five scores."""
    seasons = calendar(events)
    return rated(night_combinations(events, seasons, legs, least), seasons, reference_date)


def rated(combos: DataFrame, seasons: list[int], reference_date: str, filtered: bool = True) -> DataFrame:
    """``combos`` (combo, legs, bits) with hits, n_seasons, most, last and the five scores; ``filtered``: of those that pass the season filters."""
    p = combos.withColumn("per", season_hits(seasons)).withColumns({"n_seasons": F.size(F.filter("per", lambda h: h > 0)), "hits": F.aggregate("per", F.lit(0), lambda a, h: a + h).cast("long"), "most": F.array_max("per")}).where("hits > 0")
    share, avg = F.try_divide(F.col("most"), F.col("hits")), F.try_divide(F.col("hits"), F.col("n_seasons"))
    if filtered:
        p = p.where((F.col("n_seasons") >= 2) & (share <= 0.6) & avg.between(0.5, 6))
    latest = F.array_max(F.transform("bits", lambda w, i: F.when(w != 0, i * 64 + F.length(F.bin(w)) - 1)))
    p = p.withColumn("last", slot_date(latest, seasons))
    return p.select("combo", "legs", "bits", "per", "hits", F.col("n_seasons").cast("long").alias("n_seasons"), "most", "last", *five_scores(F.lit(len(seasons)), reference_date))


def five_scores(seasons: Column, reference_date: str) -> list[Column]:
    """Stability, balance, rarity, recency and their weighted sum from hits, n_seasons, most and last."""
    share, avg = F.col("most") / F.col("hits"), F.col("hits") / F.col("n_seasons")
    stability, balance = F.least(F.col("n_seasons") / seasons, F.lit(1.0)), 1 - share
    rarity = 1 - F.least(F.lit(1.0), F.abs(avg - 2.5) / 3)
    recency = F.greatest(F.lit(0.0), 1 - F.datediff(F.lit(reference_date).cast("date"), F.col("last")) / 730)
    overall = 0.35 * stability + 0.25 * balance + 0.25 * rarity + 0.15 * recency
    return [F.round(c, 4).alias(n) for c, n in ((stability, "stability"), (balance, "balance"), (rarity, "rarity"), (recency, "recency"), (overall, "overall"))]


def stored(patterns: DataFrame, n: int = STORED) -> DataFrame:
    """The ``n`` night patterns of the highest overall score."""
    return patterns.orderBy(F.desc("overall"), "combo").limit(n)


# ---- game patterns: games grow with the data, so blocks of them have bitmaps and counts are summed over blocks
def profiles(events: DataFrame, game: DataFrame) -> DataFrame:
    """One row per game: game_id, season, date, its rising condition ``codes``, the same as masks ``low`` and ``high``, and its outcomes as ``bits`` in the order of OUTCOME_KEYS."""
    number = F.create_map(*[F.lit(x) for i, k in enumerate(OUTCOME_KEYS) for x in (k, i)])
    code = F.create_map(*[F.lit(x) for i, k in enumerate(CONDITION_KEYS) for x in (k, i)])
    one = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n)
    e = events.select("game_id", "season", F.when(F.col("kind") == "condition", F.try_element_at(code, F.col("event_key"))).alias("c"), F.when(F.col("kind") == "outcome", F.try_element_at(number, F.col("event_key"))).alias("o"))
    zero = F.lit(0).cast("long")
    own = e.groupBy("game_id", "season").agg(
        F.array_sort(F.collect_list("c")).alias("codes"), F.coalesce(F.bit_or(F.when(F.col("c") < 60, one(F.col("c")))), zero).alias("low"), F.coalesce(F.bit_or(F.when(F.col("c") >= 60, one(F.col("c") - 60))), zero).alias("high"), F.coalesce(F.bit_or(one(F.col("o"))), zero).alias("bits")
    )
    return own.join(game.select("game_id", "date"), "game_id")


def wide_profiles(wide: DataFrame, outcomes: bool = True) -> DataFrame:
    """``profiles`` of the events that hold in the games of ``wide`` (see games.wide_games), worked out in each game's row: no event is a row of
    its own and nothing is shuffled. Without ``outcomes`` there are no ``bits``. Games without an event stay; no pattern fits them."""
    one = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n)
    held = lambda tests: F.array_compact(F.array(*[F.when(F.expr(e), F.lit(i)) for i, e in enumerate(tests)]))
    mask = lambda codes, some=lambda c: F.lit(True), less=0: F.aggregate(codes, F.lit(0).cast("long"), lambda m, c: F.when(some(c), m.bitwiseOR(one(c - less))).otherwise(m))
    own = wide.select("game_id", "season", held([CONDITIONS[k] for k in CONDITION_KEYS]).alias("codes"), *([held(OUTCOMES.values()).alias("_came")] if outcomes else []), "date")
    bits = [mask(F.col("_came")).alias("bits")] if outcomes else []
    return own.select("game_id", "season", "codes", mask(F.col("codes"), lambda c: c < 60).alias("low"), mask(F.col("codes"), lambda c: c >= 60, 60).alias("high"), *bits, "date")


def pattern_counts(own: DataFrame, legs: int = LEGS, least: int = LEAST) -> DataFrame:
    """(combo, season, sample, h0, h1, ...) of each combination of the conditions of ``own`` (see profiles) that ``least`` games have:
    how often it came in a season, and each outcome with it (see vertical)."""
    return vertical.pattern_counts(own, len(CONDITION_KEYS), len(OUTCOME_KEYS), legs, least, DIGIT)


def pattern_totals(counts: DataFrame, by: list[str], least: int, min_rate: float) -> DataFrame:
    """(by, o, outcome, sample, hits, n_seasons, most) of ``counts`` summed over seasons, where ``sample`` and the share of hits are large enough.

    All outcomes of a combination are in one row until it is known which are kept."""
    width = len(OUTCOME_KEYS)
    sums = counts.groupBy(*by).agg(F.sum("sample").alias("sample"), *[f(F.col(f"h{i}")).alias(f"{n}{i}") for i in range(width) for f, n in ((F.sum, "s"), (lambda c: F.count_if(c > 0), "n"), (F.max, "m"))]).where(F.col("sample") >= least)
    each = F.array(*[F.when(F.col(f"s{i}") / F.col("sample") >= min_rate, F.struct(F.lit(i).alias("o"), F.lit(k).alias("outcome"), F.col(f"s{i}").alias("hits"), F.col(f"n{i}").alias("n_seasons"), F.col(f"m{i}").alias("most"))) for i, k in enumerate(OUTCOME_KEYS)])
    return sums.select(*by, "sample", F.inline(F.array_compact(each)))


def kept_patterns(counts: DataFrame, least: int = LEAST, min_rate: float = 0.58, max_share: float = 0.85) -> DataFrame:
    """(combo, o, outcome, sample, hits, n_seasons, most) of condition patterns whose outcome beats the break-even rate."""
    p, rate = pattern_totals(counts, ["combo"], least, min_rate), F.col("hits") / F.col("sample")
    return p.where((rate - BREAK_EVEN >= 0.02) & (F.col("most") / F.col("sample") <= max_share))


def scored(kept: DataFrame, own: DataFrame, legs: int = LEGS, reference_date: str = "2001-01-01") -> DataFrame:
    """``kept`` patterns with hit_rate, edge, confidence and value; a hit in the 90 days before ``reference_date`` adds to the confidence.

    The last dates of the outcomes are looked for in bitmaps of the games of those days (see vertical.last_days)."""
    day = F.lit(reference_date).cast("date")
    recent = own.where((F.col("date") > F.date_sub(day, 90)) & (F.col("date") <= day)).select("game_id", (-F.datediff(day, "date")).alias("day"), "codes", "bits")
    asked = kept.where(F.col("combo") < 1 << (DIGIT * legs)).select("combo").distinct()
    last = vertical.last_days(recent, asked, len(CONDITION_KEYS), len(OUTCOME_KEYS), DIGIT)
    most_n, seasons = kept.agg(F.max("sample").alias("x")).select("x").scalar(), own.agg(F.count_distinct("season").alias("x")).select("x").scalar()
    rate, n = F.col("hits") / F.col("sample"), F.col("sample")
    base = 0.4 * n / most_n + 0.3 * F.col("n_seasons") / seasons + 0.3 * (1 - F.col("most") / n)
    bonus = F.coalesce(0.05 * (1 - -F.get("last", F.col("o")) / 90), F.lit(0.0))
    return kept.join(last, "combo", "left").select("combo", "o", "outcome", "sample", "hits", "n_seasons", rate.alias("hit_rate"), (rate - BREAK_EVEN).alias("edge"), F.round(F.least(base + bonus, F.lit(1.0)), 9).alias("confidence"), F.round((rate - BREAK_EVEN) * F.sqrt("sample"), 9).alias("value"))


def top(patterns: DataFrame, n: int = STORED_GAMES, legs: int = LEGS) -> DataFrame:
    """The ``n`` patterns of the highest confidence, then value, with their ``name``."""
    return patterns.withColumn("name", combo_name(CONDITION_KEYS, legs)).orderBy(F.desc("confidence"), F.desc("value"), "name", "outcome").limit(n)


def masked(patterns: DataFrame, legs: int = LEGS) -> DataFrame:
    """``patterns`` (with combo) with the masks ``_low`` and ``_high`` of their conditions and the first condition, ``_key``."""
    number = [digit(p) - 1 for p in range(legs)]
    one = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n)
    zero = F.lit(0).cast("long")
    mask = lambda low: sum((F.when(n.between(0, 59) if low else n >= 60, one(n if low else n - 60)).otherwise(zero) for n in number), zero)
    first = F.coalesce(*[F.when(n >= 0, n) for n in reversed(number)])
    return patterns.withColumns({"_low": mask(True), "_high": mask(False), "_key": first})


def matches(own: DataFrame, patterns: DataFrame, also: dict[str, str] | None = None, legs: int = LEGS) -> DataFrame:
    """Rows of ``own`` (with codes, low, high) beside each of ``patterns`` (with combo) whose conditions all hold.

    They meet once, on a pattern's first condition and on the columns of ``also`` (of ``own``: of
    ``patterns``); the others are tested on the masks. ``patterns`` are few by a limit of theirs (stored
    patterns, candidates of a fold) and are broadcast."""
    p = masked(patterns, legs)
    met = own.withColumn("_key", F.explode("codes")).alias("g").join(F.broadcast(p).alias("p"), (F.col("g._key") == F.col("p._key")) & F.expr(" and ".join(f"g.{a} = p.{b}" for a, b in (also or {}).items()) or "true"))
    met = met.where("g.low & p._low = p._low and g.high & p._high = p._high")
    return met.select(*[f"g.{c}" for c in own.columns if c not in ("codes", "low", "high")], *[f"p.{c}" for c in patterns.columns])


def first_matches(own: DataFrame, patterns: DataFrame, order: list[Column | str], n: int, each: str | None = None, legs: int = LEGS) -> DataFrame:
    """Rows of ``own`` (with codes, low, high) beside the first ``n`` of ``patterns`` in ``order`` that fit, with their ``place`` from 1.

    ``each``: of the patterns of one value of that column only the first that fits counts; ``values`` tells how many values fit. The order is the
    patterns' own, so it is found once and each row takes its first ones in its task: nothing but these is made, and nothing is
    shuffled. ``patterns`` are few by a limit of theirs (see matches)."""
    listed = keep(masked(patterns, legs).withColumn("_at", F.row_number().over(Window.orderBy(*order)) - 1), "listed")
    got = listed.select("_at", "_low", "_high", *([F.col(each).alias("_each")] if each else [])).orderBy("_at").toArrow()
    low, high, most = got["_low"].to_numpy(), got["_high"].to_numpy(), got.num_rows
    values = got["_each"].to_pylist() if each else []
    groups = [np.array([i for i, v in enumerate(values) if v == one]) for one in sorted(set(values))]
    rest = [c for c in own.columns if c not in ("codes", "low", "high")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, FITTED):
                batch = whole.slice(at, FITTED)
                mine, far = (batch.column(c).to_numpy()[:, None] for c in ("low", "high"))
                fit = ((mine & low) == low) & ((far & high) == high)
                if each:
                    firsts = np.full((batch.num_rows, len(groups)), most)
                    for v, at_v in enumerate(groups):
                        some = fit[:, at_v]
                        firsts[:, v] = np.where(some.any(axis=1), at_v[some.argmax(axis=1)], most)
                    firsts.sort(axis=1)
                    known = (firsts < most).sum(axis=1)
                    taken = firsts[:, :n] < most
                    which = firsts[:, :n][taken]
                else:
                    taken = fit & (np.cumsum(fit, axis=1, dtype=np.int32) <= n)
                    which, known = np.nonzero(taken)[1], fit.sum(axis=1)
                ends = np.r_[0, taken.sum(axis=1).cumsum()].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.ListArray.from_arrays(pa.array(ends), pa.array(which.astype(np.int32))), pa.array(known.astype(np.int64))], names=[*rest, "_ats", "values"])

    schema = StructType([*own.select(*rest).schema, StructField("_ats", ArrayType(IntegerType())), StructField("values", LongType())])
    first = own.select(*rest, "low", "high").mapInArrow(run, schema).select(*rest, "values", F.posexplode("_ats").alias("place", "_at")).withColumn("place", F.col("place") + 1)
    met = first.join(F.broadcast(listed.drop("_low", "_high", "_key")), "_at").drop("_at")
    return met if each else met.drop("values")


def hit_bit() -> Column:
    """1 where the row's ``bits`` have the outcome numbered ``o``, else 0."""
    return F.call_function("shiftright", F.col("bits"), F.col("o")).bitwiseAND(F.lit(1).cast("long")).cast("int")


def hits_of(own: DataFrame, patterns: DataFrame, legs: int = LEGS) -> DataFrame:
    """(name, outcome, game_id, season, date, hit) of every game that the conditions of ``patterns`` (see top) fit."""
    return matches(own, patterns.select("combo", "o", "name", "outcome"), legs=legs).select("name", "outcome", "game_id", "season", "date", hit_bit().alias("hit"))
