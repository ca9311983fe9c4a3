"""Jaccard join of documents on word shingles by rare-first prefix filtering."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatewise.llm.common import in_arrow, keep, rows_of, sent
from slatewise.llm.graph import components
from slatewise.llm.hashing import shingles

WORDS = 5
#: Documents link when NEED[1] * |intersection| >= NEED[0] * |union|.
NEED = (75, 100)
#: So many of the most frequent shingles are told apart by frequency; the others count as equally rare.
#: They, and the bits below, only set the order and spare postings: results don't depend on them.
FREQUENT, LEAST_FREQUENT = 200_000, 6
#: Bits that say which shingles more than one set has: about as many as there are shingles, a broadcast of 16 MB at most.
LEAST_BITS, MOST_BITS = 16, 27
#: Shingles counted by one task of the frequency count.
COUNTED = 1_000_000
#: Ids of sets to read again are broadcast up to this many, 8 bytes each; beyond, all sets are read.
SENT_SETS = 2_000_000
KEY_BITS = 40
PIVOTS, PIVOT_ROUNDS = 16, 2


def set_id(tokens: np.ndarray) -> bytes | None:
    """128 bits that equal sets share; an empty set has none."""
    return xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None


def row_key() -> Column:
    """128 bits of a row's id and text, which only repeated rows share; a null id counts as one of its own."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text"), F.lit("")))))


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, sid) of each row of ``docs`` (doc_id, text), with its ``key`` where ``docs`` has one."""
    key = ["key"] if "key" in docs.columns else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            sets = shingles(batch.column(1), WORDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) for s in sets], pa.binary()), *batch.columns[2:]], names=["doc_id", "n_shingles", "sid", *key])

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *key), run, "doc_id long, n_shingles long, sid binary" + ", key binary" * len(key))


def _distinct_sets(batches: Iterator[pa.RecordBatch], limit: int = 1 << 17) -> Iterator[tuple[bytes, np.ndarray]]:
    """Sets of a column of texts; copies in the same task count once (as far as ``limit`` ids are remembered)."""
    seen: set[bytes] = set()
    for batch in rows_of(batches, 128):
        for tokens in shingles(batch.column(0), WORDS):
            sid = set_id(tokens)
            if sid is not None and sid not in seen:
                if len(seen) < limit:
                    seen.add(sid)
                yield sid, tokens


def _planes(values: np.ndarray) -> bytes:
    """Rising values as differences, byte plane after byte plane: the upper planes compress to little."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T[:5]).tobytes()


def _values(planes: bytes) -> np.ndarray:
    n = len(planes) // 5
    steps = np.zeros((8, n), dtype=np.uint8)
    steps[:5] = np.frombuffer(planes, dtype=np.uint8).reshape(5, n)
    return np.cumsum(np.ascontiguousarray(steps.T).view("<u8").reshape(-1))


def frequencies(docs: DataFrame, total: int, shared_bits: int) -> tuple[DataFrame, DataFrame]:
    """Kept tables of the documents' shingle frequencies, counted over all sets by key (the first KEY_BITS
    of the hash): the frequent keys (key, df), and 2^``shared_bits`` bits of keys with df >= 2 (place, bits).

    Tasks count their own shingles and send rising keys, packed by ranges of the key, so that one range
    has about COUNTED of them at any size; a key arrives once from each packet."""
    ranges = max(1, -(-total // COUNTED))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held) >> np.uint64(64 - KEY_BITS), return_counts=True)
            owner = (keys.astype(np.float64) * (ranges / float(1 << KEY_BITS))).astype(np.int64)
            cuts = np.searchsorted(owner, np.arange(ranges + 1))
            rows = [(r, _planes(keys[a:b]), np.minimum(n[a:b], 65535).astype("<u2").tobytes()) for r, a, b in zip(range(ranges), cuts[:-1], cuts[1:], strict=True) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["range", "keys", "n"])

        for _, tokens in _distinct_sets(batches):
            held.append(tokens)
            size += len(tokens)
            if size > COUNTED:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packets = (p for batch in rows_of(batches) for p in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for _, parts in itertools.groupby(packets, key=lambda p: p[0]):
            keys, n = (np.concatenate(x) for x in zip(*((_values(keys), np.frombuffer(n, dtype="<u2").astype(np.int64)) for _, keys, n in parts), strict=True))
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            df, keys = np.add.reduceat(n, first), keys[first]
            keys, df = keys[df > 1], df[df > 1]
            if not len(keys):
                continue
            bit = (keys >> np.uint64(KEY_BITS - shared_bits)).astype(np.int64)
            base = int(bit[0]) // 8
            bits = np.zeros(int(bit[-1]) // 8 - base + 1, dtype=np.uint8)
            np.bitwise_or.at(bits, bit // 8 - base, np.uint8(1) << (bit % 8).astype(np.uint8))
            often = df >= LEAST_FREQUENT
            keys, df = keys[often].astype(np.int64), df[often]
            yield pa.RecordBatch.from_arrays([pa.array([base, *[None] * len(keys)], pa.int64()), pa.array([bits.tobytes(), *[None] * len(keys)], pa.binary()), pa.array([None, *keys.tolist()], pa.int64()), pa.array([None, *df.tolist()], pa.int64())], names=["place", "bits", "key", "df"])

    packed = in_arrow(docs.select("text"), pack, "range int, keys binary, n binary").repartitionById(ranges, F.col("range")).sortWithinPartitions("range")
    counted = keep(in_arrow(packed, count, "place long, bits binary, key long, df long"), "frequencies")
    return counted.where("key is not null").select("key", "df"), counted.where("place is not null").select("place", "bits")


def _order(frequent: DataFrame, shared: DataFrame, shared_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    top = frequent.orderBy(F.desc("df"), "key").limit(FREQUENT).toArrow()
    keys, df = top["key"].to_numpy().astype(np.uint64), top["df"].to_numpy()
    order = np.argsort(keys)
    bits = np.zeros(1 << (shared_bits - 3), dtype=np.uint8)
    for place, part in shared.toLocalIterator():
        got = np.frombuffer(part, dtype=np.uint8)
        bits[place : place + len(got)] |= got
    return keys[order], df[order].astype(np.int32), bits


def postings(docs: DataFrame, total: int) -> DataFrame:
    """A kept table (token, sid, n, place, shared), one row per token and set: the prefix shingles of each set in rare-first order that other sets have too.
    First come shingles of no other set, which need no posting, then those of few, then the frequent ones. ``shared`` is the part of the prefix, in thousandths, that has postings.

    Any set that links to one of n shingles shares a shingle of the first n - ceil(3n/4) + 1 of both."""
    shared_bits = min(max((max(total, 1) - 1).bit_length(), LEAST_BITS), MOST_BITS)
    order_of = docs.sparkSession.sparkContext.broadcast(_order(*frequencies(docs, total, shared_bits), shared_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, df, bits = order_of.value
        rows: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([r[0] for r in rows]).view(np.int64)), pa.array([r[1] for r in rows for _ in range(len(r[0]))], pa.binary()),
                 pa.array(np.repeat([r[2] for r in rows], [len(r[0]) for r in rows]).astype(np.int32)), pa.array(np.concatenate([r[3] for r in rows]).astype(np.int32)), pa.array(np.repeat([r[4] for r in rows], [len(r[0]) for r in rows]).astype(np.int32))],
                names=["token", "sid", "n", "place", "shared"],
            )

        for sid, tokens in _distinct_sets(batches):
            n = len(tokens)
            prefix = n - -(-n * NEED[0] // NEED[1]) + 1
            key = tokens >> np.uint64(64 - KEY_BITS)
            bit = (key >> np.uint64(KEY_BITS - shared_bits)).astype(np.int64)
            often = ((bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(np.int32)  # 0: no other set has it
            if len(keys):
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                often = np.where(keys[at] == key, df[at], often)
            order = np.argsort(often, kind="stable")[:prefix]  # hashes rise among equals
            place = np.flatnonzero(often[order])
            if len(place):
                rows.append((tokens[order[place]], sid, n, place, 1000 * len(place) // prefix))
                size += len(place)
                if size > 20_000:
                    yield flush()
                    rows, size = [], 0
        if rows:
            yield flush()

    posted = keep(in_arrow(docs.select("text"), run, "token long, sid binary, n int, place int, shared int").dropDuplicates(["token", "sid"]), "postings")
    order_of.destroy()
    return posted


#: Length and positional filter of a posting: the largest set that what follows the shared shingle still allows to link.
#: At the first place that is 4/3 of its own size; two sets link only if each is within the reach of the other.
REACH = f"({NEED[1]} * n - {sum(NEED)} * place) div {NEED[0]}"
_NEAR = "a.n <= b.reach and b.n <= a.reach"


def unsettled(posted: DataFrame, links: DataFrame | None) -> DataFrame:
    """``posted`` (see postings) with each set's component so far as ``label`` and its ``reach``; postings that can't
    meet one of another component go.

    Of two sets the smaller reaches the larger, so its reach is at least its own size. A frequent shingle comes
    late in most sets, where the reach is smaller: those only meet the few that have it early."""
    own = posted.withColumn("label", F.col("sid")) if links is None else posted.join(components(links).select(F.col("node").alias("sid"), "label"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    own = own.withColumn("reach", F.expr(REACH))
    early = own.where("reach >= n").groupBy("token").agg(F.min("n").alias("least"), F.max("reach").alias("most"))
    able = own.join(early, "token").where("n <= most and reach >= least").drop("least", "most")
    mixed = able.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("token")
    return keep(able.join(mixed, "token", "left_semi"), "unsettled")


def pivot_pairs(lists: DataFrame, seed: int) -> DataFrame:
    """Of each shingle's list the pairs of other components with one set, its pivot: as many as the list is long.

    At first that is the set which shares most of its prefix, as the source of many edited copies does.
    Later PIVOTS kinds of shingles choose by chance, so that a set of many lists meets several pivots."""
    by_chance = F.xxhash64("sid", F.pmod("token", F.lit(PIVOTS)), F.lit(seed))
    chosen = F.struct(F.expr("reach < n").alias("late"), (-F.col("shared") if seed == 0 else F.lit(0)).alias("c"), by_chance.alias("h"), "sid", "n", "reach", "label")
    pivots = lists.groupBy("token").agg(F.min(chosen).alias("p")).select("token", "p.sid", "p.n", "p.reach", "p.label")
    return _near_pairs(pivots.alias("a").join(lists.alias("b"), "token"), "a.label <> b.label")


def cross_pairs(lists: DataFrame) -> DataFrame:
    """Of each shingle's list all pairs of sets that aren't yet in one component, the smaller set on the left.

    Components of a list meet first, by the bounds of their sets; only sets of two that can meet are paired,
    so that a large group of near copies isn't paired with itself."""
    small = lists.where("reach >= n")
    bounds = lambda df: df.groupBy("token", "label").agg(F.min("n").alias("least"), F.max("reach").alias("most"))
    meet = bounds(small).alias("a").join(bounds(lists).alias("b"), "token").where("a.label <> b.label and b.least <= a.most and a.least <= b.most")
    meet = meet.select("token", F.col("a.label").alias("other"), F.col("a.least").alias("least"), F.col("a.most").alias("most"), F.col("b.label").alias("label"))
    large = lists.join(meet, ["token", "label"]).where("n <= most and least <= reach").select("token", F.col("other").alias("label"), "sid", "n", "reach")
    return _near_pairs(small.alias("a").join(large.alias("b"), ["token", "label"]), "(a.n < b.n or (a.n = b.n and a.sid < b.sid))")


def _near_pairs(met: DataFrame, which: str) -> DataFrame:
    return met.where(F.expr(f"{which} and {_NEAR}")).select(F.least("a.sid", "b.sid").alias("a"), F.greatest("a.sid", "b.sid").alias("b")).distinct()


def read_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """A kept table (sid, tokens) of the sets that ``wanted`` (sid) lists, once or a few times each; all, where it is too long to send."""
    n = wanted.count()
    names = np.empty(0, dtype=np.int64)
    if n <= SENT_SETS:
        names = np.sort(wanted.select(F.conv(F.substring(F.hex("sid"), 1, 15), 16, 10).cast("long").alias("x")).toArrow()["x"].to_numpy())
    asked = docs.sparkSession.sparkContext.broadcast((n <= SENT_SETS, names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, names = asked.value
        rows: list[tuple[bytes, bytes]] = []
        size = 0
        for sid, tokens in _distinct_sets(batches):
            if some:
                x = int(sid.hex()[:15], 16)
                at = int(np.searchsorted(names, x))
                if at == len(names) or names[at] != x:
                    continue
            rows.append((sid, tokens.tobytes()))
            size += len(tokens)
            if size > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["sid", "tokens"])
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["sid", "tokens"])

    read = keep(in_arrow(docs.select("text"), run, "sid binary, tokens binary").groupBy("sid").agg(F.first("tokens").alias("tokens")), "tokens")
    asked.destroy()
    return read


def overlaps(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets link. The suffix filter comes first: both are cut at the same shingles, and
    what the parts could share at most must be enough."""
    low, high = NEED
    least = -(-low * (len(a) + len(b)) // (low + high))
    probes = b[:: max(1, len(b) // 16)][1:]
    parts_a = np.diff(np.searchsorted(a, probes), prepend=0, append=len(a))
    parts_b = np.diff(np.searchsorted(b, probes), prepend=0, append=len(b))
    if int(np.minimum(parts_a, parts_b).sum()) < least:
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) >= least


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link; each is looked at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 512):
            own, other = batch.column(2), batch.column(3)
            good = [overlaps(np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)) for x, y in zip(own, other, strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = pairs.join(sets.select(F.col("sid").alias("a"), F.col("tokens").alias("x")), "a")
    both = left.join(sets.select(F.col("sid").alias("b"), F.col("tokens").alias("y")), "b")
    return in_arrow(both.select("a", "b", "x", "y"), run, "a binary, b binary")


def linked(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """A kept table of the ``pairs`` whose sets link; the sets are read from the documents again."""
    pairs = keep(pairs, "pairs")
    sides = keep(pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct(), "sides")
    return keep(verified(pairs, read_sets(docs, sides)), "linked")


def near_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs`` (doc_id, text): the smallest doc_id reachable by links.

    Equal sets are one from the start. The others meet through prefix postings: each list against its
    pivot, a round or two, and then all pairs of a list that the links so far leave in different
    components. So a group of near copies costs about as many pairs as it has members, and no link
    between components is lost. Documents without words are their own component, also repeated
    ones; a null id is nobody's smallest; repeated ids and rows are answered each."""
    sets = keep(shingle_sets(docs), "sets")
    classes = sets.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("least")).join(set_labels(docs, sets).withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    smallest = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    of_set = keep(classes.join(smallest, "label").select("sid", "component_id"), "components")
    named = sets.join(of_set, "sid", "left")
    return named.select("doc_id", "n_shingles", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def set_labels(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, label) of the sets of ``sets`` that link to another: the component of each (see near_components)."""
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    links, lists = None, unsettled(postings(docs, total), None)
    for seed in range(PIVOT_ROUNDS):
        found = linked(docs, pivot_pairs(lists, seed))
        links = found if links is None else links.unionByName(found)
        lists = unsettled(lists.drop("label", "reach"), links)
    return components(links.unionByName(linked(docs, cross_pairs(lists))))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id, a null one last, whatever other texts its id has.

    Of several texts of the component under that id one stays, of repeated rows one. Rows without words stay,
    but for repeated ones that have an id. Rows are told apart by their id and text (see row_key), so an id
    loses only those of its texts that are copies."""
    keyed = docs.withColumn("key", row_key())
    sets = keep(shingle_sets(keyed), "sets")
    best = sets.where("sid is not null").groupBy("sid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sid", "key")).alias("best"))
    classes = best.join(set_labels(docs, sets).withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    chosen = classes.groupBy("label").agg(F.min("best").alias("best")).select("best.key")
    gone = keep(sets.where("sid is not null").join(chosen, "key", "left_anti").select("key").distinct(), "gone")
    kept = keyed.join(sent(gone), "key", "left_anti")
    repeated = keep(sets.where("sid is not null or doc_id is not null").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "repeated")
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    some = sent(repeated)
    return kept.join(some, "key", "left_anti").select(*docs.columns).unionByName(kept.join(some, "key", "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns))
