"""Packing by lexical retrieval: a seed's window is filled with its nearest unused documents of a sharded BM25 index."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.llm.common import in_arrow, keep, per_task, rows_of
from slatewise.llm.packing import default_tokenizer, encoder

CAPACITY = 2048
SEPARATOR = 1
#: Documents of one shard of the index; rows that one task reads for its shards, about.
SHARD, TASK = 2048, 32_768
#: What a task can't fill a window with goes to a next round; so many tasks' rests meet in one task.
RESTS = 512
K1, B = 1.2, 0.75

TOKENS = "doc_id long, doc_tokens long, start long, length long, ids_crc32 long, sequence_id long, item long, ids binary, n_docs long, terms array<int>, counts array<long>"
PLACED = "doc_id long, doc_tokens long, start long, length long, ids_crc32 long, sequence_id long, offset long, first int, second int, item long, ids binary"
PIECES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _kind(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def tokenized(docs: DataFrame, tokenizer: str, capacity: int) -> DataFrame:
    """A kept table of each document's full windows, which are sequences of their own, and of its rest with its ids; and of each task
    the number of its documents and, for each token id, of those that have it. Every document is read once and whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        vocabulary = max(code.tokenizer.get_vocab_size(), SEPARATOR + 1)
        kind, last = _kind(vocabulary), SEPARATOR.to_bytes(4, "little")
        df, n_docs, item = np.zeros(vocabulary, dtype=np.int64), 0, TaskContext.get().partitionId() << 33
        places = np.zeros(vocabulary, dtype=np.int64)
        for batch in rows_of(batches):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(code.encode(text.as_py() or "") + last, dtype="<u4")
                n, n_docs = len(ids), n_docs + 1
                places[ids] = at = np.arange(n)
                df[ids[places[ids] == at]] += 1  # one place of each different id
                for start in range(0, n - n % capacity, capacity):
                    rows.append((doc_id, n, start, capacity, crc(ids[start : start + capacity]), -1 - item, item, None, None, None, None))
                    item += 1
                if n % capacity:
                    rows.append((doc_id, n, n - n % capacity, n % capacity, None, None, item, ids[n - n % capacity :].astype(kind).tobytes(), None, None, None))
                    item += 1
            if rows:
                yield _batch(rows, TOKENS)
        if n_docs:
            some = np.flatnonzero(df)
            yield _batch([(*[None] * 8, n_docs, some.tolist(), df[some].tolist())], TOKENS)

    return keep(in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, TOKENS), "tokens")


def statistics(tokens: DataFrame) -> tuple[np.ndarray, float, int]:
    """(BM25's idf of each token id over all documents, the mean length of the rests, their number). A token that half of all documents
    have, or more, weighs nothing, and neither does one of a single document. The driver gets one row for each id of the vocabulary."""
    total, length, rests = tokens.agg(F.sum("n_docs"), F.avg(F.when(F.col("ids").isNotNull(), F.col("length"))), F.count("ids")).first()
    counted = tokens.where("terms is not null").select(F.inline(F.arrays_zip("terms", "counts"))).groupBy("terms").agg(F.sum("counts").alias("df")).toArrow()
    df = np.zeros(int(counted["terms"].to_numpy().max(initial=0)) + 1, dtype=np.float64)
    df[counted["terms"].to_numpy()] = counted["df"].to_numpy()
    return np.maximum(0, np.log(((total or 0) - df + 0.5) / (df + 0.5))) * (df > 1), float(length or 1), rests


class Index:
    """A BM25 index of one shard: postings by token, with each document's weight of the token."""

    def __init__(self, items: list[np.ndarray], idf: np.ndarray, average: float) -> None:
        self.n, vocabulary = len(items), len(idf)
        lengths = np.array([len(i) for i in items], dtype=np.int64)
        keys = np.repeat(np.arange(self.n), lengths) * vocabulary + np.concatenate([*items, np.empty(0, dtype=np.int64)]).astype(np.int64)
        keys, tf = np.unique(keys, return_counts=True)
        rows, terms = keys // vocabulary, keys % vocabulary
        tells = idf[terms] > 0
        rows, self.terms, tf = rows[tells], terms[tells], tf[tells]
        self.starts = np.searchsorted(rows, np.arange(self.n + 1))  # of each document's terms
        self.weights = idf[self.terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[rows] / average))
        order = np.argsort(self.terms, kind="stable")
        self.rows, self.values = rows[order], self.weights[order]
        self.ends = np.cumsum(np.bincount(self.terms, minlength=vocabulary))

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """A document's terms and weights."""
        return self.terms[self.starts[i] : self.starts[i + 1]], self.weights[self.starts[i] : self.starts[i + 1]]

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """BM25 of every document for a query of different ``terms``."""
        ends = self.ends[terms]
        begin = np.where(terms > 0, self.ends[terms - 1], 0)
        n = ends - begin
        at = np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum())) if len(terms) else np.empty(0, dtype=np.int64)
        return np.bincount(self.rows[at], weights=self.values[at], minlength=self.n)

    def without(self, used: np.ndarray) -> None:
        """Take used documents out of the postings."""
        unused = ~used[self.rows]
        before = np.concatenate([[0], np.cumsum(unused)])
        self.ends = before[self.ends]
        self.rows, self.values = self.rows[unused], self.values[unused]


def windows(items: list[np.ndarray], idf: np.ndarray, average: float, capacity: int = CAPACITY) -> Iterator[list[tuple[int, int, int]]]:
    """Windows of ``items`` (each shorter than ``capacity``) as lists of (item, begin, end), all full but the last.

    A seed, what was cut off the item before or else the next unused one, opens a window and asks the index; unused
    neighbours that fit follow, the nearest first. What room is left goes to the nearest that doesn't fit, cut there; where
    no neighbour shares a term, items follow in their order."""
    index = Index(items, idf, average)
    lengths, used = np.array([len(i) for i in items], dtype=np.int64), np.zeros(len(items), dtype=bool)
    next_unused, live, held, rest = 0, len(items), len(items), None
    while live or rest:
        if live and 2 * live < held:
            index.without(used)
            held = live
        if rest is None:
            while used[next_unused]:
                next_unused += 1
            rest, live = (next_unused, 0, int(lengths[next_unused])), live - 1
            used[next_unused] = True
        window, room, rest = [rest], capacity - (rest[2] - rest[1]), None
        scores = index.scores(index.of(window[0][0])[0]) if live else np.zeros(len(items))
        scores[used] = 0
        while room:
            fit = np.where(lengths <= room, scores, 0)
            i = int(fit.argmax())  # of equal scores the first
            if not fit[i] > 0:
                break
            window.append((i, 0, int(lengths[i])))
            room, live, used[i], scores[i] = room - int(lengths[i]), live - 1, True, 0
        nearest = int(scores.argmax()) if live else 0
        while room and live:
            if scores[nearest] > 0:
                i = nearest
            else:
                while used[next_unused]:
                    next_unused += 1
                i = next_unused
            end = min(room, int(lengths[i]))
            window.append((i, 0, end))
            room, live, used[i] = room - end, live - 1, True
            rest = (i, end, int(lengths[i])) if end < lengths[i] else None
        yield window


def powers(window: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """An unfilled window as sequences whose lengths are powers of two, the largest first."""
    left = sum(e - b for _, b, e in window)
    parts, at = list(window), 0
    while left:
        room, out = 1 << left.bit_length() - 1, []
        left -= room
        while room:
            i, b, e = parts[at]
            end = min(e, b + room)
            out.append((i, b, end))
            room -= end - b
            parts[at] = (i, end, e)
            at += end == e
        yield out


def ranks(idf: np.ndarray) -> np.ndarray:
    """The place of each token in the order of falling ``idf``, then of its number; those that weigh nothing share the last place."""
    order = np.lexsort((np.arange(len(idf)), -idf))
    out = np.empty(len(idf), dtype=np.int32)
    out[order] = np.arange(len(idf))
    out[idf <= 0] = len(idf)
    return out


def rarest(items: list[np.ndarray], rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the second rank among each item's tokens; the last place where there is none."""
    starts = np.concatenate([[0], np.cumsum([len(i) for i in items])[:-1]]).astype(np.int64)
    place = rank[np.concatenate(items)]
    first = np.minimum.reduceat(place, starts)
    place[place == np.repeat(first, [len(i) for i in items])] = len(rank)
    return first, np.minimum.reduceat(place, starts)


def _keys(rank: np.ndarray, kind: str) -> Callable:
    """Adds the ranks of the two tokens of each rest that tell most: documents next to each other in that order share what tells them from others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 1024):
            first, second = rarest([np.frombuffer(i.as_buffer(), dtype=kind) for i in batch.column(4)], rank)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first, pa.int32()), pa.array(second, pa.int32())], names=[*batch.schema.names, "first", "second"])

    return run


def _fill(level: int, idf: np.ndarray, average: float, kind: str, capacity: int, last: bool) -> Callable:
    """Fills windows from rests in order, a shard at a time; gives placed pieces and what is left for another round, with its ids.
    The ``last`` round leaves nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = (level << 55) + (TaskContext.get().partitionId() << 33)
        held: list[tuple] = []

        def solve(ends: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, sequence
            items = [np.frombuffer(r[4], dtype=kind) for r in held]
            rows: list[tuple] = []
            left: list[tuple] = []
            for window in windows(items, idf, average, capacity):
                whole = sum(e - b for _, b, e in window) == capacity
                if not whole and not (ends and last):
                    left = [(*held[i][:2], held[i][2] + b, e - b, items[i][b:e].tobytes(), *held[i][5:]) for i, b, e in window]
                    continue
                for part in [window] if whole else powers(window):
                    offset = 0
                    for i, b, e in part:
                        rows.append((*held[i][:2], held[i][2] + b, e - b, crc(items[i][b:e]), sequence, offset, None, None, None, None))
                        offset += e - b
                    sequence += 1
            held = left
            if ends:
                rows += [(*r[:4], None, None, None, r[6], r[7], r[5], r[4]) for r in held]
            if rows:
                yield _batch(rows, PLACED)

        for batch in rows_of(batches, 256):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                if len(held) >= SHARD:
                    yield from solve(False)
        if held:
            yield from solve(True)

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: every piece of every document and its place.

    A document is its ids and one SEPARATOR. Its full windows are sequences of their own; its rest is packed with its neighbours.
    The index is sharded: rests are dealt by ranges of their two tokens of highest idf, then of their number, so that those
    alike share a shard and a token that a third of them have takes many; SHARD of them have an index, with the idf of
    all documents, and fill windows (see windows). What a task has left, less than a window, meets others' in further
    rounds; the last incomplete window is cut at powers of two, so nothing is padded. Null texts are empty; repeated rows
    and ids are packed each; an empty table gives no rows; other columns are not read."""
    path = tokenizer or default_tokenizer()
    tokens = tokenized(docs, path, capacity)
    idf, average, n = statistics(tokens)
    heads = tokens.where("sequence_id is not null").select(*[c for c in PIECES if c != "offset"], F.lit(0).cast("long").alias("offset"))
    if not n:
        return heads.select(*PIECES)
    kind = _kind(max(encoder(path).tokenizer.get_vocab_size(), SEPARATOR + 1))
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    order = ("first", "second", "item")
    rests = tokens.where("ids is not null").select("doc_id", "doc_tokens", "start", "length", "ids", "item")
    rests = in_arrow(rests, lambda batches: _keys(ranks(shared.value), kind)(batches), "doc_id long, doc_tokens long, start long, length long, ids binary, item long, first int, second int")
    out, level, tasks = heads, 0, max(per_task(docs), -(-n // TASK))
    while True:
        dealt = rests.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
        found = keep(in_arrow(dealt, lambda batches, level=level, last=tasks == 1: _fill(level, shared.value, average, kind, capacity, last)(batches), PLACED), "placed")
        out = out.unionByName(found.where("ids is null").select(*PIECES))
        if tasks == 1:
            return out.select(*PIECES)
        rests = found.where("ids is not null").select("doc_id", "doc_tokens", "start", "length", "ids", "item", "first", "second")
        level, tasks = level + 1, -(-tasks // RESTS)
