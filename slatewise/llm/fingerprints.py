"""Canonical exact digests of documents, and the comparison with edited and neighbouring texts."""

from __future__ import annotations

import hashlib
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatewise.llm.common import in_arrow, keep, per_task, rows_of, sent
from slatewise.llm.ranks import ranked

#: The ids of documents that share a digest are broadcast up to this many, else joined by a shuffle.
SENT_MEMBERS = 500_000


def canonical(text: str | None) -> bytes:
    """NFKC, case folded, NFKC again (folding may undo it), white space runs as one space, none at the ends."""
    if not text:
        return b""
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digest(body: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(body)


def digests(docs: DataFrame, key: str) -> DataFrame:
    """(key, digest, size of the canonical bytes) of each row of ``docs`` (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            bodies = [canonical(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(b) for b in bodies], pa.string()), pa.array([len(b) for b in bodies], pa.int64())], names=[key, "digest", "size"])

    return in_arrow(docs.select(key, "text"), run, f"`{key}` {docs.schema[key].dataType.simpleString()}, digest string, size long")


def classes(docs: DataFrame, known: DataFrame, key: str = "doc_id", hashed: Callable[[bytes], str] = digest) -> DataFrame:
    """(key, digest, variant) of the documents whose digest several have: variant numbers the different
    canonical texts of one digest from 0, by byte order. It is 0 for all unless the hash collides.

    ``known`` (key, digest) has the digests. Rows find out whether theirs is shared where they are, as long as the shared digests fit a broadcast
    (see common.sent); beyond it by a shuffle, whose large partitions Spark splits. Only documents of shared buckets are compared byte by byte;
    the aggregation that compares them meets equal bytes in each task first, so that a bucket with a
    third of all documents adds a row per task. A null key is in no comparison."""
    shared = keep(known.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "shared-digests")
    members = keep(known.where(F.col(key).isNotNull()).join(sent(shared), "digest", "left_semi").select(key, "digest"), "buckets")
    asked = members.select(key).distinct()
    if members.count() <= SENT_MEMBERS:
        asked = F.broadcast(asked)

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            body = [canonical(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashed(b) for b in body], pa.string()), pa.array(body, pa.binary())], names=[key, "digest", "body"])

    full = in_arrow(docs.select(key, "text").join(asked, key, "left_semi").select(key, "text"), bodies, f"`{key}` {docs.schema[key].dataType.simpleString()}, digest string, body binary")
    different = keep(full.groupBy("digest").agg(F.min("body").alias("least"), F.max("body").alias("most")).where("least <> most").select("digest"), "collisions")
    if different.count() == 0:
        return members.withColumn("variant", F.lit(0))
    texts = full.join(different, "digest", "left_semi").select("digest", "body").distinct()
    numbered = ranked(texts, [F.col("digest"), F.col("body")])
    first = numbered.groupBy("digest").agg(F.min("rank").alias("first"))
    numbered = numbered.join(first, "digest").select("digest", "body", (F.col("rank") - F.col("first")).cast("int").alias("variant"))
    return full.join(numbered, ["digest", "body"], "left").select(key, "digest", F.coalesce("variant", F.lit(0)).alias("variant")).distinct()


COMPARED = "doc_id long, n_chars long, edited_sha256 string, digest string, edited_digest string, near_edited double, near_next double"
LEAST = -(1 << 63)


def _key() -> Column:
    """What documents are ordered by, descending; null is LEAST."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST))


def _place(bounds: Column, hash_: Column) -> Column:
    """How many of ``bounds`` (id, hash; in the order of documents) don't come after a row."""
    return F.size(F.filter(bounds, lambda b: (b["id"] > F.col("key")) | ((b["id"] == F.col("key")) & (b["hash"] <= hash_))))


def _own_range(bounds: list[tuple[int, int]], hash_: Column) -> Column:
    """The number of the range that a row lies in, told first by every so manyth bound and then by those that follow."""
    wide = int(len(bounds) ** 0.5) + 1
    literal = lambda part: F.array(*[F.struct(F.lit(i).cast("long").alias("id"), F.lit(h).cast("long").alias("hash")) for i, h in part])
    block = _place(literal(bounds[::wide]), hash_) - 1
    return F.greatest(block * wide + _place(F.slice(literal(bounds), block * wide + 1, wide), hash_) - 1, F.lit(0))


def _ranges(docs: DataFrame, n: int) -> tuple[list[tuple[int, int]], Column]:
    """(firsts, hash): the first rows (id, hash) of at most n + 1 ranges of ``docs``, in the order of documents, and what orders rows of one id there.

    Cuts are approximate quantiles of the ids. An id that fills several quantiles (null is LEAST) is cut at even steps of its texts' hashes as
    often; elsewhere the hash is 0, and no text is read. The real first row of each range is found by one aggregation, a row per range, so
    cuts needn't be ids that exist."""
    cuts = F.percentile_approx(_key(), F.array(*[F.lit(i / n) for i in range(1, n + 1)]), F.lit(max(10_000, 20 * n)))
    top, inner = docs.agg(F.max(_key()), cuts).first()
    if top is None:
        return [], F.lit(0)
    times = Counter(inner or [])
    asked = {(top, LEAST)} | {(i, LEAST + (j << 64) // k) for i, k in times.items() for j in range(k)}
    hot = [i for i, k in times.items() if k > 1]
    rows = docs.select(_key().alias("key"), *(["text"] if hot else []))
    hash_ = F.when(F.col("key").isin(*hot), F.xxhash64(F.coalesce("text", F.lit("")))).otherwise(F.lit(0)) if hot else F.lit(0)
    own = _own_range(sorted(asked, key=lambda b: (-b[0], b[1])), hash_)
    found = rows.select(own.alias("range"), "key", hash_.alias("hash")).groupBy("range").agg(F.max(F.struct("key", F.bitwise_not("hash").alias("least"))).alias("first")).collect()
    return sorted(((r["first"]["key"], ~r["first"]["least"]) for r in found), key=lambda b: (-b[0], b[1])), hash_


def edit_and_compare(docs: DataFrame) -> DataFrame:
    """One row per document with its digest, that of its edited text and whether they are alike.

    The edited text has its last floor(n/2) code points replaced by the first as many (or all) of the next
    document in descending order of doc_id, after the last the first. Documents go by ranges of that order,
    text and all, once; the first of each range is also a guest at the end of the range before, so every
    document meets its next one. A single document is its own next one. Null texts are empty; null ids come
    last; repeated ids go by their texts' hashes, and an id (or null) of very many rows is cut into ranges by them, so that only rows of one id and
    one text must meet. Alike is 1.0 where digest and bytes are equal, else 0.0."""
    firsts, hash_ = _ranges(docs, per_task(docs))
    if not firsts:
        return docs.sparkSession.createDataFrame([], COMPARED)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _key().alias("key")).withColumn("hash", hash_)
    rows = rows.withColumn("own", _own_range(firsts, F.col("hash")))
    before = F.pmod(F.col("own") - 1, F.lit(len(firsts)))
    is_first = F.element_at(F.array(*[F.lit(i).cast("long") for i, _ in firsts]), F.col("own") + 1) == F.col("key")
    is_first = is_first & (F.element_at(F.array(*[F.lit(h).cast("long") for _, h in firsts]), F.col("own") + 1) == F.col("hash"))
    places = F.array(F.struct(F.col("own").alias("range"), F.lit(False).alias("guest")))
    guests = F.array(F.struct(F.col("own").alias("range"), F.lit(False).alias("guest")), F.struct(before.alias("range"), F.lit(True).alias("guest")))
    rows = rows.withColumn("place", F.explode(F.when(is_first, guests).otherwise(places)))
    dealt = rows.select("place.range", "place.guest", "doc_id", "text", "key").repartitionById(len(firsts), F.col("range").cast("int"))
    dealt = dealt.sortWithinPartitions("range", "guest", F.desc("key"), F.xxhash64(F.coalesce("text", F.lit("")))).select("range", "guest", "doc_id", "text")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in COMPARED.split(", ")]
        last = None
        for batch in rows_of(batches):
            out: list[tuple] = []
            for at, guest, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = text or ""
                body = canonical(text)
                if last is not None and last[0] == at:
                    _, own_id, own, own_body = last
                    half = len(own) // 2
                    edited = own[: len(own) - half] + text[:half]
                    edited_body = canonical(edited)
                    name, edited_name = digest(own_body), digest(edited_body)
                    same = edited_body == own_body
                    if edited_name == name and not same:
                        edited_name += "-edited"
                    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((own_id, len(own), sha, name, edited_name, float(same), float(body == own_body)))
                last = None if guest else (at, doc_id, text, body)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) if i else pa.array(c, pa.int64()) for i, c in enumerate(zip(*out, strict=True))], names=names)

    return in_arrow(dealt, pairs, COMPARED)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of ``docs`` (doc_id, text).

    A fingerprint is the wide digest of the canonical text; where different canonical texts share a digest
    all but one carry their number in the bucket. See edit_and_compare for order, nulls and repeats."""
    compared = keep(edit_and_compare(docs), "compared")
    apart = classes(docs.select("doc_id", "text"), compared.select("doc_id", "digest")).where("variant > 0")
    named = compared.join(apart, ["doc_id", "digest"], "left")
    return named.select("doc_id", "n_chars", "edited_sha256", F.concat_ws("-", "digest", F.col("variant").cast("string")).alias("fingerprint"), F.col("edited_digest").alias("edited_fingerprint"), "near_edited", "near_next")
