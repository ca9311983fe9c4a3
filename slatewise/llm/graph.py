"""Connected components of a links table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.llm.common import keep


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links`` (a, b): the smallest node reachable.

    Each round a node takes the smallest label of its neighbours and then its label's own label, so
    that chains halve, until none changes; a round ends in a kept table. Sums of a node's links are pre-aggregated."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("next")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("next"))).where("node <> next").distinct()
    both = keep(both, "links")
    held = keep(both.groupBy("node").agg(F.least(F.min("next"), F.first("node")).alias("label")), "labels")
    while True:
        heard = both.join(held.select(F.col("node").alias("next"), "label"), "next").groupBy("node").agg(F.min("label").alias("heard"))
        least = held.join(heard, "node").select("node", F.least("label", "heard").alias("near"), F.col("label").alias("old"))
        jumped = least.join(held.select(F.col("node").alias("near"), F.col("label").alias("far")), "near", "left")
        held_next = keep(jumped.select("node", F.least("near", F.coalesce("far", "near")).alias("label"), "old"), "labels")
        changed = held_next.where("label <> old").limit(1).count()
        held = held_next.select("node", "label")
        if not changed:
            return held
