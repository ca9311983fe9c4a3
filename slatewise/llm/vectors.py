"""Vectors of doubles as exact whole numbers, in blocks of rows inside tasks, and scores of any size that sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

LONG = (1 << 63) - 1
#: More bits than the product of any two scaled doubles has, summed.
WIDE_BITS = 2176


def usable(vec: Column) -> Column:
    """Whether a vector column is there and all its components are finite numbers."""
    return vec.isNotNull() & F.coalesce(F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf")))), F.lit(False))


def dense(terms: pa.Array, width: int | None = None) -> np.ndarray:
    """The vectors of a list column as rows of doubles, short ones filled up with zeros."""
    offsets = terms.offsets.to_numpy()
    flat = terms.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    n = np.diff(offsets)
    width = int(n.max(initial=0)) if width is None else width
    out = np.zeros((len(n), width))
    col = np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], n)
    inside = col < width
    out[np.repeat(np.arange(len(n)), n)[inside], col[inside]] = flat[inside]
    return out


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles, ``scale`` a power of two: 64-bit integers where all fit, else Python's. Nothing is rounded or cut off."""
    if float(np.abs(values).max(initial=0.0)) < float(1 << 62) / scale:
        return np.floor(values * scale).astype(np.int64)
    exact = lambda v: int(np.floor(v * scale)) if abs(v) < float(1 << 52) else int(v) * scale  # noqa: E731  larger doubles are whole
    return np.array([exact(v) for v in values.ravel().tolist()], dtype=object).reshape(values.shape)


def largest(values: np.ndarray) -> int:
    """The largest size of a whole number of ``values``."""
    return max((abs(v) for v in values.ravel().tolist()), default=0) if values.dtype == object else int(np.abs(values).max(initial=0))


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    at = np.arange(len(scores))
    if scores.dtype == object:
        return np.array(sorted(at.tolist(), key=lambda i: (-scores[i], ids[i]))[:k], dtype=np.int64)
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def blocks(batches: Iterator[pa.RecordBatch], size: int, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrow batches (terms, further columns) as blocks of ``size`` rows: the dense vectors, and each further column."""
    held: list[list[np.ndarray]] = []
    n = 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, size - n)
            held.append([dense(part.column(0), width), *[c.to_numpy(zero_copy_only=False) for c in part.columns[1:]]])
            n, at = n + part.num_rows, at + part.num_rows
            if n == size:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, n = [], 0
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


# ---- scores: a 64-bit number, and bytes where it does not fit
def score_columns(scores: np.ndarray) -> list[pa.Array]:
    """Columns (score, wide): the nearest 64-bit number, and where that isn't the score, bytes that sort as scores do."""
    if scores.dtype != object:
        return [pa.array(scores, pa.int64()), pa.nulls(len(scores), pa.binary())]
    wide = [None if -LONG <= s < LONG else (s + (1 << WIDE_BITS - 1)).to_bytes(WIDE_BITS // 8, "big") for s in scores.tolist()]
    return [pa.array([min(max(s, -LONG - 1), LONG) for s in scores.tolist()], pa.int64()), pa.array(wide, pa.binary())]


def score_of(score: int, wide: bytes | None) -> int:
    return score if wide is None else int.from_bytes(wide, "big") - (1 << WIDE_BITS - 1)


def by_score() -> list[Column]:
    """Highest score first, by its true value."""
    return [F.desc("score"), F.when(F.col("score") > 0, F.col("wide")).desc_nulls_last(), F.when(F.col("score") < 0, F.col("wide")).desc_nulls_first()]
