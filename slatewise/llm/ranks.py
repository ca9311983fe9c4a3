"""Distributed ranks: a global order without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatewise.llm.common import keep, per_task


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` (small columns only) plus the row's place from 0 in ``order``, which must tell rows apart to be the same each time.

    Rows are dealt by ranges of the order and kept; the driver gets one count per range; a window inside
    each range and the counts before it give the places."""
    n = per_task(df)
    dealt = keep(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranked")
    before, seen = {}, 0
    for r in sorted(dealt.groupBy("_range").count().collect(), key=lambda r: r["_range"]):
        before[r["_range"]] = seen
        seen += r["count"]
    if not before:
        return dealt.drop("_range").withColumn(name, F.lit(0).cast("long"))
    offsets = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn(name, own + F.element_at(offsets, F.col("_range")).cast("long")).drop("_range")
