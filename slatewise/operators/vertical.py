"""Counts of game patterns by vertical bitmaps: blocks of games with a bit for each game in the words of each key."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.sources.kept import keep

#: Games of a block, about; blocks that one task counts together; combinations of one chunk; elements of one step.
BLOCK, GROUP, CHUNK, STEP = 16_384, 64, 8192, 1 << 19
#: Counts that a task holds at once.
HELD = 1 << 22


def blocks(own: DataFrame, conditions: int, outcomes: int) -> tuple[DataFrame, int]:
    """A kept table (season, block, words) of ``own`` (game_id, season, codes, bits), and how many rows it has. ``words``: a bit for each
    game of the block, for all games, for each outcome, for each condition, in 64-bit words. A season's games lie in the order of their
    codes, so that a combination's games share few words."""
    parallel = own.sparkSession.sparkContext.defaultParallelism
    size = BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        block = TaskContext.get().partitionId() << 32
        for season, games in itertools.groupby(rows, key=lambda r: r[0]):
            while held := [(r[1], r[2]) for r in itertools.islice(games, size)]:
                n = len(held)
                flags = np.zeros((1 + outcomes + conditions, -(-n // 64) * 64), dtype=bool)
                flags[0, :n] = True
                bits = np.array([b for _, b in held], dtype=np.int64)
                for o in range(outcomes):
                    flags[1 + o, :n] = bits >> o & 1
                at = np.repeat(np.arange(n), [len(c) for c, _ in held])
                flags[1 + outcomes + np.array([k for c, _ in held for k in c], dtype=np.int64), at] = True
                words = np.packbits(flags, axis=1, bitorder="little").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([season], pa.int32()), pa.array([block], pa.int64()), pa.array([words], pa.binary())], names=["season", "block", "words"])
                block += 1

    near = own.repartitionByRange(parallel, "season", "codes", "game_id").sortWithinPartitions("season", "codes").select("season", "codes", "bits")
    table = keep(near.mapInArrow(run, "season int, block long, words binary"), "blocks")
    return table, table.count()


def number(combos: np.ndarray, digit: int) -> np.ndarray:
    """Rows of rising keys (from 0) as numbers: a digit for each key, from 1, the first key first."""
    out = np.zeros(len(combos), dtype=np.int64)
    for column in combos.T:
        out = (out << digit) + column + 1
    return out


def grown(frequent: np.ndarray, digit: int) -> np.ndarray:
    """Combinations of one key more, in order, all of whose parts are ``frequent`` (rows of rising keys, in order)."""
    if not len(frequent):
        return np.empty((0, frequent.shape[1] + 1), dtype=np.int64)
    first = np.flatnonzero(np.r_[True, (np.diff(frequent[:, :-1], axis=0) != 0).any(axis=1)]) if frequent.shape[1] > 1 else np.array([0])
    out = []
    for a, b in zip(first, [*first[1:], len(frequent)], strict=True):
        i, j = np.triu_indices(b - a, 1)
        out.append(np.column_stack([frequent[a + i], frequent[a + j, -1]]))
    found = np.concatenate(out)
    known = number(frequent, digit)
    for drop in range(found.shape[1] - 2):  # without one of the last two they are frequent by how they were made
        found = found[np.isin(number(np.delete(found, drop, axis=1), digit), known)]
    return found


def counts(words: np.ndarray, season: np.ndarray, combos: np.ndarray, head: int, rows: int, seasons: int) -> np.ndarray:
    """(combination, season, row) -> games of the season that have all keys of the combination and the bit of one of the first ``rows`` rows.
    ``words``: rows of blocks side by side, keys from row ``head`` on; ``season``: the number of each word's season. Combinations that begin alike share the
    intersection of those keys."""
    out = np.zeros((len(combos), seasons, rows), dtype=np.int64)
    keys, told = words[head:], words[:rows]
    first = np.flatnonzero(np.r_[True, (np.diff(combos[:, :-1], axis=0) != 0).any(axis=1)]) if combos.shape[1] > 1 else np.array([0])
    for a, b in zip(first, [*first[1:], len(combos)], strict=True):
        both = np.bitwise_and.reduce(keys[combos[a, :-1]], axis=0) if combos.shape[1] > 1 else words[0]
        some = np.flatnonzero(both)  # most words have no game of the shared keys
        step = max(1, STEP // ((b - a) * rows))
        for w in range(0, len(some), step):
            at = some[w : w + step]
            part = season[at]
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            have, asked = keys[combos[a:b, -1][:, None], at], told[:, at] & both[at]
            n = np.add.reduceat(np.bitwise_count(have[:, None, :] & asked[None, :, :]), starts, axis=2, dtype=np.int64)
            out[a:b, part[starts]] += n.transpose(0, 2, 1)
    return out


def _parts(total: int, lists: list[np.ndarray], chunk: int, parallel: int) -> int:
    """Parts in which blocks go to a chunk's tasks where these add up what they read: as few as keep all tasks busy."""
    return min(-(-total // GROUP), -(-4 * parallel // sum(-(-len(c) // chunk) for c in lists)))


def _counted(table: DataFrame, total: int, lists: list[np.ndarray], height: int, head: int, rows: int, schema: str, emit, chunk: int | None = None, seasons: list[int] | None = None) -> DataFrame:
    """``emit`` of the counts of each ``chunk`` of ``lists`` (combinations of one length each) and each group of blocks. Chunks go to tasks
    with the blocks of a group, of ``height`` rows each; the lists are bounded by the catalog and broadcast.

    With ``seasons``, all that there are, a task reads the blocks of a part (see _parts) group by group and adds up their counts, so that what is emitted doesn't grow with the games."""
    spark, size = table.sparkSession, chunk or CHUNK
    chunks = [(i, at) for i, combos in enumerate(lists) for at in range(0, len(combos), size)]
    groups = _parts(total, lists, size, spark.sparkContext.defaultParallelism) if seasons else -(-total // GROUP)
    shared = spark.sparkContext.broadcast((lists, chunks))

    def read_together(read: Iterator[tuple[int, bytes]]) -> tuple[list[int], np.ndarray, np.ndarray] | None:
        parts = [(s, np.frombuffer(w, dtype="<u8").reshape(height, -1)) for s, w in read]
        if not parts:
            return None
        names = seasons or sorted({s for s, _ in parts})
        return names, np.repeat([names.index(s) for s, _ in parts], [w.shape[1] for _, w in parts]), np.concatenate([w for _, w in parts], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, chunks = shared.value
        read = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for (chunk, _), rest in itertools.groupby(read, key=lambda r: r[:2]):
            i, at = chunks[chunk]
            held, end = (r[2:] for r in rest), min(at + size, len(lists[i]))
            if seasons:
                sums = np.zeros((end - at, len(seasons), rows), dtype=np.int64)
                while together := read_together(itertools.islice(held, GROUP)):
                    sums += counts(together[2], together[1], lists[i][at:end], head, rows, len(seasons))
                yield from emit(lists[i][at:end], seasons, sums)
                continue
            names, season, near = read_together(held)
            step = max(1, HELD // (len(names) * rows))
            for k in range(at, end, step):
                combos = lists[i][k : min(k + step, end)]
                yield from emit(combos, names, counts(near, season, combos, head, rows, len(names)))

    every = F.explode(F.sequence(F.lit(0), F.lit(len(chunks) - 1))).alias("chunk")
    dealt = table.select(every, F.pmod(F.xxhash64("season", "block"), F.lit(groups)).alias("part"), "season", "words")
    near = dealt.repartition(min(len(chunks) * groups, 4 * spark.sparkContext.defaultParallelism + groups), "chunk", "part").sortWithinPartitions("chunk", "part", "season")
    return near.mapInArrow(run, schema)


def pattern_counts(own: DataFrame, conditions: int, outcomes: int, legs: int, least: int, digit: int) -> DataFrame:
    """(combo, season, sample, h0, h1, ...) of each combination of up to ``legs`` conditions that ``least`` games have: how often it came in a season, and each outcome with it.

    ``own``: game_id, season, rising codes, outcomes as bits. Level by level the combinations whose parts are all frequent are
    candidates, counted by intersections of bitmaps within a block and summed over blocks; the driver holds what is frequent of
    the catalog's combinations, whose number the catalog bounds, not the games."""
    table, total = blocks(own, conditions, outcomes)
    schema = "combo long, season int, sample long, " + ", ".join(f"h{i} long" for i in range(outcomes))
    if not total:
        return own.sparkSession.createDataFrame([], schema)
    head = 1 + outcomes

    def support(combos: np.ndarray, _: list, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        sums = n[:, :, 0].sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(number(combos, digit)), pa.array(sums)], names=["combo", "n"])

    frequent = []
    combos = np.arange(conditions)[:, None]
    for size in range(1, legs + 1):
        if size == legs or not len(combos):
            frequent.append(combos)  # of the longest the sums over seasons decide below
            break
        sums = _counted(table, total, [combos], head + conditions, head, 1, "combo long, n long", support).groupBy("combo").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("combo").toArrow()
        combos = combos[np.isin(number(combos, digit), sums["combo"].to_numpy())]
        frequent.append(combos)
        combos = grown(combos, digit)

    def rows(combos: np.ndarray, names: list[int], n: np.ndarray) -> Iterator[pa.RecordBatch]:
        if whole:
            often = n[:, :, 0].sum(axis=1) >= least
            combos, n = combos[often], n[often]
        codes = number(combos, digit)
        at, season = np.nonzero(n[:, :, 0])
        for k in range(0, len(at), CHUNK):
            i, s = at[k : k + CHUNK], season[k : k + CHUNK]
            values = n[i, s]
            yield pa.RecordBatch.from_arrays([pa.array(codes[i]), pa.array(np.array(names)[s], pa.int32()), *[pa.array(np.ascontiguousarray(values[:, c])) for c in range(values.shape[1])]], names=["combo", "season", "sample", *[f"h{c}" for c in range(values.shape[1] - 1)]])

    if not any(len(c) for c in frequent):
        return own.sparkSession.createDataFrame([], schema)
    lists, seasons = [c for c in frequent if len(c)], [r[0] for r in table.select("season").distinct().orderBy("season").collect()]
    chunk = max(1, min(2 * CHUNK, HELD // (len(seasons) * head)))
    whole = _parts(total, lists, chunk, own.sparkSession.sparkContext.defaultParallelism) == 1
    found = _counted(table, total, lists, head + conditions, head, head, schema, rows, chunk, seasons)
    if whole:
        return found
    sums = keep(found.groupBy("combo", "season").agg(*[F.sum(c).alias(c) for c in found.columns if c not in ("combo", "season")]), "summed")
    often = sums.groupBy("combo").agg(F.sum("sample").alias("n")).where(F.col("n") >= least).select("combo")
    return sums.join(often, "combo", "left_semi")


def keys_of(combos: np.ndarray, digit: int) -> list[np.ndarray]:
    """Numbers as rows of rising keys (from 0), in order: one array for each length."""
    places = 62 // digit
    keys = np.column_stack([combos >> digit * p & (1 << digit) - 1 for p in reversed(range(places))]) - 1
    size = (keys >= 0).sum(axis=1)
    return [rows[np.lexsort(rows.T[::-1])] for n in range(1, places + 1) if len(rows := keys[size == n][:, places - n :])]


def last_days(own: DataFrame, asked: DataFrame, conditions: int, outcomes: int, digit: int) -> DataFrame:
    """(combo, last): of each of ``asked`` (combo, distinct) that a game of ``own`` has, for each outcome the last ``day`` it came with it (null: none).

    ``own``: game_id, day (int), rising codes, outcomes as bits. Counted by days as pattern_counts counts by seasons; what is
    asked is bounded by the catalog."""
    table, total = blocks(own.withColumn("season", F.col("day")), conditions, outcomes)
    schema = "combo long, last array<int>"
    lists = keys_of(asked.select("combo").toArrow()["combo"].to_numpy(), digit)
    if not total or not lists:
        return own.sparkSession.createDataFrame([], schema)
    head = 1 + outcomes

    def lasts(combos: np.ndarray, names: list[int], n: np.ndarray) -> Iterator[pa.RecordBatch]:
        held = n[:, :, 0].any(axis=1)
        came = n[held][:, ::-1, 1:] > 0
        days = np.array(names[::-1], dtype=np.int32)[came.argmax(axis=1)]
        flat = pa.array(days.ravel(), mask=~came.any(axis=1).ravel())
        last = pa.ListArray.from_arrays(pa.array(np.arange(len(days) + 1, dtype=np.int32) * outcomes), flat)
        yield pa.RecordBatch.from_arrays([pa.array(number(combos[held], digit)), last], names=["combo", "last"])

    found = _counted(table, total, lists, head + conditions, head, head, schema, lasts)
    if total <= GROUP:
        return found
    return found.groupBy("combo").agg(F.array(*[F.max(F.get("last", F.lit(i))) for i in range(outcomes)]).alias("last"))
