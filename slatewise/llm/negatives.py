"""Hard negatives by exact integer products: several candidates' components side by side in one wide integer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatewise.llm.common import in_arrow, keep
from slatewise.llm.vectors import best, blocks, by_score, dense, largest, score_columns, score_of, usable, whole

#: Anchors and candidates of one block of scores.
ANCHORS, CANDIDATES = 64, 8192
#: Bytes of anchors that one round over the candidates serves: the bound of each broadcast.
SENT_ANCHORS = 8 << 20
#: Fields of up to so many bits share a 64-bit word (scores times 100 stay in 64 bits); wider ones share a Python integer, so many of them.
NATIVE_BITS, WIDE_FIELDS = 54, 16
SCALE = 256

SAME = "ask long, vec_id long, own boolean, score long, wide binary"
OTHER = "ask long, place int, vec_id long, score long, wide binary"


def labelled_vectors(df: DataFrame, id_col: str, vec_col: str, label: Column) -> DataFrame:
    """(id, label, terms array<double>); rows with a null id, label or vector or a null or non-finite component are left out."""
    x = F.col(vec_col)
    return df.where(F.col(id_col).isNotNull() & label.isNotNull() & usable(x)).select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), x.cast("array<double>").alias("terms"))


def packed(values: np.ndarray, bias: int, bits: int, fields: int, kind: type) -> np.ndarray:
    """(width x words) of ``values`` (rows x width): each component of ``fields`` neighbouring rows, made non-negative by ``bias``, in
    fields of ``bits`` of one integer."""
    n, width = values.shape
    biased = np.zeros((-(-n // fields) * fields, width), dtype=kind)
    biased[:n] = (values + bias).astype(kind)
    words = biased[::fields].copy()
    for j in range(1, fields):
        words |= biased[j::fields] << kind(bits * j) if kind is not object else biased[j::fields] << bits * j
    return np.ascontiguousarray(words.T)


def products(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact inner products (anchors x candidates) of whole numbers.

    A word holds the biased components of several candidates in separated fields, wide enough for a whole sum; each
    component of an anchor, biased too, is multiplied with it once. What the biases added is taken off the unpacked sums:
    sum (a + A)(c + C) = sum ac + A sum c + C sum a + width A C. Where no field fits a 64-bit word the words are Python integers."""
    width, n = anchors.shape[1], len(candidates)
    a, c = largest(anchors), largest(candidates)
    bits = max(1, (width * 4 * a * c).bit_length())
    native = anchors.dtype != object and candidates.dtype != object and bits <= NATIVE_BITS
    kind = np.uint64 if native else object
    fields = 64 // bits if native else WIDE_FIELDS
    if not native:
        anchors, candidates = anchors.astype(object), candidates.astype(object)
    words = packed(candidates, c, bits, fields, kind)
    left = (anchors + a).astype(kind)
    sums = np.zeros((len(anchors), words.shape[1]), dtype=kind)
    for i in range(width):
        sums += left[:, i, None] * words[i]
    out = np.empty((len(anchors), words.shape[1] * fields), dtype=np.int64 if native else object)
    mask = (1 << bits) - 1
    for j in range(fields):
        out[:, j::fields] = (sums >> np.uint64(bits * j)) & np.uint64(mask) if native else (sums >> bits * j) & mask
    return out[:, :n] - (a * candidates.sum(axis=1)[None, :] + c * anchors.sum(axis=1)[:, None] + width * a * c)


def _merged(held: tuple | None, new: tuple, k: int) -> tuple:
    """Of (ids, scores, ...) the k best of both."""
    if held is not None:
        new = tuple(np.concatenate(x) for x in zip(held, new, strict=True))
    at = best(new[0], new[1], k)
    return tuple(x[at] for x in new)


def _scored(batches: Iterator[pa.RecordBatch], terms: np.ndarray, scale: int) -> Iterator[tuple]:
    """(anchor number, its scores, ids, labels, vectors) for each block of candidates and each anchor."""
    asked = whole(terms, scale)
    for values, ids, labels in blocks(batches, CANDIDATES, terms.shape[1]):
        held = whole(values, scale)
        for at in range(0, len(terms), ANCHORS):
            for q, scores in enumerate(products(asked[at : at + ANCHORS], held), at):
                yield q, scores, ids, labels, values


def _same(batches: Iterator[pa.RecordBatch], first: int, own: np.ndarray, label: np.ndarray, terms: np.ndarray, k: int, scale: int) -> Iterator[pa.RecordBatch]:
    """The k + 1 best rows of one task of each anchor's label: one of them may be the anchor's own row."""
    kept: dict[int, tuple] = {}
    for q, scores, ids, labels, values in _scored(batches, terms, scale):
        at = np.flatnonzero(labels == label[q])
        at = at[best(ids[at], scores[at], k + 1)]
        mine = (ids[at] == own[q]) & (values[at] == terms[q]).all(axis=1)
        if len(at):
            kept[q] = _merged(kept.get(q), (ids[at], scores[at], mine), k + 1)
    for q, (ids, scores, mine) in kept.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), first + q)), pa.array(ids), pa.array(mine), *score_columns(scores)], names=[c.split()[0] for c in SAME.split(", ")])


def _other(batches: Iterator[pa.RecordBatch], first: int, label: np.ndarray, terms: np.ndarray, bands: list[list[int]], k: int, low: int, high: int, scale: int) -> Iterator[pa.RecordBatch]:
    """The k best rows of one task of other labels in the band of each anchor's positives."""
    kept: dict[tuple[int, int], tuple] = {}
    for q, scores, ids, labels, _ in _scored(batches, terms, scale):
        other = labels != label[q]
        hundred = scores * 100
        for place, positive in enumerate(bands[q]):
            at = np.flatnonzero(other & (hundred >= low * positive) & (hundred <= high * positive))
            if len(at):
                at = at[best(ids[at], scores[at], k)]
                kept[q, place] = _merged(kept.get((q, place)), (ids[at], scores[at]), k)
    for (q, place), (ids, scores) in kept.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), first + q)), pa.array([place] * len(ids), pa.int32()), pa.array(ids), *score_columns(scores)], names=[c.split()[0] for c in OTHER.split(", ")])


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = SCALE, sent: int = SENT_ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each of ``anchors`` (id, label, terms) and its
    ``positives`` best rows of the same label, the ``negatives`` best rows of other labels with low <= 100 * score / positive score <= high.

    Scores are inner products of floor(scale * x), exact for all finite doubles (see products); those beyond 64 bits rank and are
    held against the bounds by their true values and are given as the nearest 64-bit number. A round sends at most ``sent`` bytes
    of anchors and scans the candidates twice: for positives, and with their scores for negatives; each task gives a few rows an
    anchor, which windows merge. Rounds end in kept tables. An anchor's own row (its id and vector) is left out once: of repeated
    rows the others stay, and each of repeated anchors asks. Ties go to smaller ids; missing components count as zero; an anchor
    alone with its label, or a side without rows, gives none. Columns besides id, label and terms are not read."""
    spark = rows.sparkSession
    width = anchors.agg(F.max(F.size("terms"))).first()[0] or 0
    asked = keep(anchors.select("id", "label", "terms"), "anchors")
    rounds = max(1, -(-asked.count() * 8 * (width + 2 + positives) // sent))
    asked = asked.withColumn("round", F.pmod(F.xxhash64("id", "terms"), F.lit(rounds)))
    read = rows.select("terms", "id", "label")
    done = []
    for r in range(rounds):
        own = asked.where(F.col("round") == r).drop("round").toArrow()
        ids, label, terms, first = own["id"].to_numpy(), own["label"].to_numpy(), dense(own["terms"].combine_chunks(), width), r << 40
        sent_own = spark.sparkContext.broadcast((ids, label, terms))
        same = in_arrow(read, lambda batches, b=sent_own, f=first: _same(batches, f, *b.value, positives, scale), SAME)
        itself = Window.partitionBy("ask").orderBy(F.desc("own"), *by_score())
        ranked = same.withColumn("n", F.row_number().over(itself)).where("not (own and n = 1)").withColumn("place", (F.row_number().over(Window.partitionBy("ask").orderBy(*by_score(), F.asc("vec_id"))) - 1).cast("int"))
        chosen = keep(ranked.where(F.col("place") < positives).select("ask", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "wide"), "positives")
        bands: list[list[int]] = [[] for _ in ids]
        for p in chosen.orderBy("ask", "place").toLocalIterator():
            bands[p["ask"] - first].append(score_of(p["positive_score"], p["wide"]))
        sent_bands = spark.sparkContext.broadcast(bands)
        other = in_arrow(read, lambda batches, b=sent_own, p=sent_bands, f=first: _other(batches, f, *b.value[1:], p.value, negatives, low, high, scale), OTHER)
        order = Window.partitionBy("ask", "place").orderBy(*by_score(), F.asc("vec_id"))
        few = other.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
        names = spark.createDataFrame(pa.table({"ask": first + np.arange(len(ids)), "anchor_id": ids})) if len(ids) else spark.createDataFrame([], "ask long, anchor_id long")
        part = few.drop("wide").join(chosen.drop("wide"), ["ask", "place"]).join(F.broadcast(names), "ask")  # names: one round's anchors
        done.append(keep(part.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives"))
        sent_own.destroy()
        sent_bands.destroy()
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
