"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatewise.llm.common import in_arrow, keep, rows_of
from slatewise.llm.hashing import BY_MARK, mixed, tokens
from slatewise.llm.ranks import ranked

BUCKETS = 1 << 14
#: Labelled documents that the target model learns from, at most: those of the smallest hashes of their ids.
MAX_LABELLED = 100_000
#: An n-gram counts so many times more than nothing.
SMOOTHING = 1.0


def hashed_ngrams(column: pa.Array) -> list[np.ndarray]:
    """Buckets of each row's tokens (runs of letters and digits, or of other marks; A-Z lower-cased) and of their pairs."""
    one, at = tokens(column, BY_MARK)
    two = mixed(one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    shift = np.uint64(65 - BUCKETS.bit_length())
    one, two = (one >> shift).astype(np.int64), (two >> shift).astype(np.int64)
    return [np.concatenate([one[a:b], two[a : max(a, b - 1)]]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def learn(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """Log ratio of target to raw probability for each bucket. ``docs`` (doc_id, text) are all raw text; those
    whose ids ``target`` (doc_id, at most MAX_LABELLED) lists are target text too. Each task counts in two
    arrays; sums of BUCKETS rows reach the driver. Without target text the ratio is 0 everywhere."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in rows_of(batches):
            grams = hashed_ngrams(batch.column(0))
            good = [g for g, chosen in zip(grams, batch.column(1).to_pylist(), strict=True) if chosen]
            for total, part in zip(totals, (grams, good), strict=True):
                if part:
                    total += np.bincount(np.concatenate(part), minlength=BUCKETS)
        if totals[0].any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS, dtype=np.int32)), pa.array(totals[0]), pa.array(totals[1])], names=["bucket", "raw", "target"])

    named = docs.select("doc_id", "text").join(F.broadcast(target.select("doc_id").withColumn("chosen", F.lit(True))), "doc_id", "left").select("text", "chosen")
    sums = in_arrow(named, count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    counts = np.zeros((2, BUCKETS))
    counts[:, sums["bucket"].to_numpy()] = np.stack([sums["raw"].to_numpy(), sums["target"].to_numpy()]) if sums.num_rows else 0
    if not counts[1].sum():
        return np.zeros(BUCKETS)
    p = (counts + SMOOTHING) / (counts + SMOOTHING).sum(axis=1, keepdims=True)
    return np.log(p[1]) - np.log(p[0])


def score(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id, n_grams and log_weight (the log ratio of both models' likelihoods: the sum over its n-grams; 0 without any) of each row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            n, w = [], []
            for got in hashed_ngrams(batch.column(1)):
                n.append(len(got))
                w.append(float(sent.value[got].sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(w, pa.float64())], names=["doc_id", "n_grams", "log_weight"])

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_grams long, log_weight double")


def gumbel(doc_id: str, seed: int) -> Column:
    """Standard Gumbel noise that the id and the seed settle."""
    u = (F.pmod(F.xxhash64(F.coalesce(F.col(doc_id), F.lit(-1)), F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def resample(docs: DataFrame, labels: DataFrame, length_power: float = 0.0, temperature: float = 1.0, share: float | None = None, seed: int = 7) -> DataFrame:
    """doc_id, n_grams, log_weight, key and selected for each row of ``docs`` (doc_id, text).

    Target text: documents that ``labels`` (doc_id, quality) call good. A document's
    importance is the ratio of its likelihoods under both models; Gumbel noise is added to its logarithm and the k
    highest keys are selected, k being ``share`` of the rows, by default the labels' share of good documents: a sample
    without replacement in proportion to the importance. ``length_power`` 1 takes the mean log ratio of the n-grams in place
    of their sum, so that long texts don't weigh by length; ``temperature`` divides it, lower ones sharpen. Ties go to smaller ids (null last), then any.
    Without labels all ratios are 0 and share is 1; null and empty texts have weight 0. Repeated rows
    compete each."""
    good = F.when(F.col("quality") == 1, 1.0).otherwise(0.0)
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(good).alias("good"))
    if share is None:
        share = marked.agg(F.avg("good")).first()[0]
        share = 1.0 if share is None else share
    target = keep(marked.where("good = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED).select("doc_id"), "target")
    scored = score(docs, learn(docs, target))
    keyed = scored.withColumn("key", F.col("log_weight") / F.pow(F.greatest("n_grams", F.lit(1)), F.lit(length_power)) / temperature + gumbel("doc_id", seed))
    placed = ranked(keyed, [F.desc("key"), F.asc_nulls_last("doc_id")])
    k = round(share * placed.count())
    return placed.select("doc_id", "n_grams", "log_weight", "key", (F.col("rank") < k).alias("selected"))


