"""Exact top-k inner-product search by term-at-a-time accumulation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slatewise.llm.common import in_arrow, keep
from slatewise.llm.vectors import LONG, best, blocks, by_score, dense, largest, score_columns, usable, whole

#: Queries of one block, candidates of one block: a block of scores is their product.
QUERIES, CANDIDATES = 512, 8192
#: Bytes of queries that one round over the candidates answers: the bound of each broadcast.
SENT_QUERIES = 16 << 20
SCALE = 1024

FOUND = "ask long, query_id long, vec_id long, own boolean, score long, wide binary"


def integer_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, terms array<double>); rows with a null id, a null vector or a null or non-finite component are left out.
    Tasks make whole numbers of the components (see vectors.whole), so that no finite one overflows."""
    x = F.col(vec_col)
    return df.where(F.col(id_col).isNotNull() & usable(x)).select(F.col(id_col).cast("long").alias("id"), x.cast("array<double>").alias("terms"))


def accumulate(weights: np.ndarray, postings: list[tuple[np.ndarray, np.ndarray]], n: int, kind: type) -> np.ndarray:
    """Scores of one query against a block of ``n`` candidates: each of its terms scatters its weighted postings."""
    scores = np.zeros(n, dtype=kind)
    for t in np.flatnonzero(weights):
        rows, values = postings[t]
        if len(rows) == n:
            scores += values * weights[t]
        else:
            scores[rows] += values * weights[t]
    return scores


def search(candidates: DataFrame, queries: DataFrame, k: int = 10, sent: int = SENT_QUERIES, scale: int = SCALE) -> DataFrame:
    """For each row of ``queries`` (id, terms) the k candidates (id, terms) of highest inner product of floor(scale * x).

    Queries and candidates meet in blocks: a round sends at most ``sent`` bytes of queries, and every block
    of candidates, scanned once a round, meets every block of them. There the query's terms scatter their weighted
    postings into a dense score array; a block of candidates gives a few rows for each query, which a window merges.
    With more than one round each ends in a kept table, so that the driver holds one round's queries and no plan grows.
    Sums are of 64-bit integers, and of Python's where a block's components are too large for those: all finite
    doubles are exact. A score beyond 64 bits ranks by its true value and is given as the nearest 64-bit number. A
    query's own row (its id and vector) is left out once: of repeated rows the others stay, and each of repeated
    queries asks. Missing components count as zero; an empty side gives no rows."""
    spark = candidates.sparkSession
    width = queries.agg(F.max(F.size("terms"))).first()[0]
    asked = queries.select("id", "terms")
    rounds = 1
    if width:
        rounds = max(1, -(-asked.count() * 8 * (width + 2) // sent))
    asked = keep(asked.withColumn("round", F.pmod(F.monotonically_increasing_id(), F.lit(rounds))), "queries") if rounds > 1 else asked.withColumn("round", F.lit(0))
    found = None
    for r in range(rounds):
        rows = asked.where(F.col("round") == r).select("id", "terms").toArrow()
        own = spark.sparkContext.broadcast((r << 40, rows["id"].to_numpy(), dense(rows["terms"].combine_chunks(), width or 0)))
        part = in_arrow(candidates.select("terms", "id"), lambda batches, own=own: _answer(batches, *own.value, k, scale), FOUND)
        if rounds > 1:
            part = keep(part, "round")
            own.destroy()
        found = part if found is None else found.unionByName(part)
    itself = Window.partitionBy("ask").orderBy(F.desc("own"), F.desc("score"))
    first = Window.partitionBy("ask").orderBy(*by_score(), F.asc("vec_id"))
    other = found.withColumn("n", F.row_number().over(itself)).where("not (own and n = 1)")
    return other.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _answer(batches: Iterator[pa.RecordBatch], first: int, own: np.ndarray, weights: np.ndarray, k: int, scale: int) -> Iterator[pa.RecordBatch]:
    """The k + 1 best candidates of one task for each query: one of them may be the query's own row."""
    kept: list[tuple | None] = [None] * len(own)
    asked = whole(weights, scale)
    most = largest(asked) * weights.shape[1]
    for values, names in blocks(batches, CANDIDATES, weights.shape[1]):
        held = whole(values, scale)
        small = asked.dtype != object and held.dtype != object and largest(held) * most < LONG // 2
        kind = np.int64 if small else object
        terms = asked.astype(kind)
        postings = [(at := np.flatnonzero(column), column[at]) for column in np.ascontiguousarray(held.T.astype(kind))]
        for at in range(0, len(own), QUERIES):
            for q in range(at, min(at + QUERIES, len(own))):
                scores = accumulate(terms[q], postings, len(names), kind)
                mine = np.zeros(len(names), dtype=bool)
                same = np.flatnonzero(names == own[q])
                mine[same] = (values[same] == weights[q]).all(axis=1)
                i = best(names, scores, k + 1)
                new = names[i], scores[i], mine[i]
                if kept[q] is not None:
                    new = tuple(np.concatenate(x) for x in zip(kept[q], new, strict=True))
                    i = best(new[0], new[1], k + 1)
                    new = tuple(x[i] for x in new)
                kept[q] = new
    for q, held in enumerate(kept):
        if held is not None:
            m = len(held[0])
            yield pa.RecordBatch.from_arrays([pa.array([first + q] * m, pa.int64()), pa.array([int(own[q])] * m, pa.int64()), pa.array(held[0]), pa.array(held[2]), *score_columns(held[1])], names=[c.split()[0] for c in FOUND.split(", ")])
