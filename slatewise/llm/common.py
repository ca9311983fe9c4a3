"""Shared helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slatewise.sources.kept import keep, shared_dir

__all__ = ["WORD", "in_arrow", "keep", "let_go", "per_task", "rows_of", "sent", "shared_dir", "table", "take_turn"]

#: An Arrow batch of texts ends at so many bytes: workers hold little more than one, however long texts are.
BATCH = "4m"
#: A small table is broadcast up to so many bytes.
SENT_BYTES = 16 << 20


_kept: dict[str, Callable[[], None]] = {}
_turn = ""


def let_go(name: str, clear: Callable[[], None]) -> None:
    """``clear`` ends what module ``name`` keeps in a worker, where other modules' tasks come next."""
    _kept[name] = clear


def take_turn(name: str) -> None:
    """Told by a task of module ``name`` as it begins: workers live on from operator to operator, and what another one kept goes back
    to the system, so that a worker holds one operator's memory."""
    global _turn
    if _turn != name:
        for other, clear in _kept.items():
            if other != name:
                clear()
        _turn = name
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # of the C library of Linux
            ctypes.CDLL(None).malloc_trim(0)


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``df.mapInArrow``, its batches ended by bytes as well as by rows where the session doesn't say otherwise."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    name = run.__module__

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn(name)
        yield from run(batches)

    return df.mapInArrow(work, schema)


def rows_of(batches: Iterator[pa.RecordBatch], step: int = 256, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches of at most ``step`` rows and, but for longer single rows, ``limit`` bytes of text."""
    for batch in batches:
        size = np.zeros(batch.num_rows, dtype=np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type):
                size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(size), 0
        while at < batch.num_rows:
            far = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right"))
            end = min(at + step, max(at + 1, far))
            yield batch.slice(at, end - at)
            at = end
    pa.default_memory_pool().release_unused()


def sent(df: DataFrame, limit: int = SENT_BYTES) -> DataFrame:
    """``df`` (kept, columns without nesting), broadcast where its values have at most ``limit`` bytes in all."""
    wide = [F.coalesce(F.octet_length(f.name), F.lit(0)) + F.lit(16) if f.dataType.typeName() in ("string", "binary") else F.lit(8) for f in df.schema]
    size = df.agg(F.sum(sum(wide, F.lit(16)))).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def per_task(df: DataFrame) -> int:
    """Partitions of the wide stages: what the session asks for."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


WORD = r"[^\x20\x09-\x0D]+"
