"""A prefix trie of conversations: a skeleton of range splitters for all, local sorted shards for the rest."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatewise.llm.common import in_arrow, keep, per_task, rows_of, sent

#: A turn in a path: 16 bytes of a hash of its role and text, 4 of its text's code points.
UNIT = 20
#: Conversations of one hundred share the head of the first.
FAMILY, HEADS = 100, 6
#: Sampled paths for each shard, and turns of each that count for its splitters: the skeleton has at most SAMPLES * shards * SPLITTER_TURNS nodes.
SAMPLES, SPLITTER_TURNS = 8, 512
#: Bytes of ids in one piece of an ends list; rows of one batch of nodes.
PIECE, ROWS = 1 << 20, 8192

#: Numbers of a node; ``up`` is the conv_id of its parent, or the number of a parent that is a skeleton node.
NODE = np.dtype([("conv_id", "<i8"), ("depth", "<i8"), ("up", "<i8"), ("n_convs", "<i8"), ("n_children", "<i8"), ("n_leaves", "<i8"), ("saved", "<i8"), ("ends", "u1", 32)])
NODES = "number long, up_number long, conv_id long, depth long, up long, n_convs long, n_children long, n_leaves long, saved long, ends binary"
NO_ENDS = hashlib.sha256(b"").digest()


def unit(role: Column, text: Column) -> Column:
    """A turn as UNIT bytes."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    return F.unhex(F.concat(digest, F.lpad(F.hex(F.length(text)), 8, "0")))


def own_paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path) of each conversation: its turns' units in order of turn, null first, then of the units. Rows with a null conv_id are left out."""
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.hex(unit(F.col("role"), F.col("text"))).alias("unit"))
    ordered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("told"), "turn", "unit"))).alias("t"))
    return ordered.select("conv_id", F.unhex(F.concat_ws("", "t.unit")).alias("path"))


def rebuilt(own: DataFrame) -> DataFrame:
    """``own`` (conv_id, path) with the first h turns of the family's first conversation before what follows each one's own first h; h = crc32(conv_id) % HEADS.

    The first conversation of c is c - c % FAMILY, its sign as in SQL; where it is not there its turns are none. Heads are a
    few units each, and a family has FAMILY members at most, so that the join has no hot key."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    first = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = own.where(first == F.col("conv_id")).select(F.col("conv_id").alias("family"), F.substring("path", 1, HEADS * UNIT).alias("head"))
    bytes_of_head = (h * UNIT).cast("int")
    none = F.unhex(F.lit(""))
    return own.withColumn("family", first).join(heads, "family", "left").select("conv_id", F.concat(F.substring(F.coalesce("head", none), F.lit(1), bytes_of_head), F.substring(F.col("path"), bytes_of_head + 1, F.length("path"))).alias("path"))


# ---- conversations that end at one node
def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (name, conv_id) in order as rows (name, first, part, n): runs of one name as comma-joined ids of at most about PIECE bytes."""
    name, ids, size, out = None, [], 0, []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.binary(), pa.int64()), strict=True)], names=["name", "first", "part", "n"])

    for got in batches:
        for x, i in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
            if x != name or size >= PIECE:
                if ids:
                    out.append((name, ids[0], ",".join(map(str, ids)).encode(), len(ids)))
                    if len(out) >= ROWS or size >= PIECE:
                        yield batch()
                        out = []
                name, ids, size = x, [], 0
            ids.append(i)
            size += 12
    if ids:
        out.append((name, ids[0], ",".join(map(str, ids)).encode(), len(ids)))
    if out:
        yield batch()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order as (name, conv_id, n, ends): the smallest id, their number, the hash of all, read one piece at a time."""
    name, first, n, digest, out = None, 0, 0, None, []
    for got in rows_of(batches, 256, 4 * PIECE):
        for x, i, part, k in zip(*(c.to_pylist() for c in got.columns), strict=True):
            if x != name:
                if digest is not None:
                    out.append((name, first, n, digest.digest()))
                name, first, n, digest = x, i, 0, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(part)
            n += k
        if len(out) >= ROWS:
            yield _ends(out)
            out = []
    if digest is not None:
        out.append((name, first, n, digest.digest()))
    if out:
        yield _ends(out)


def _ends(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["name", "conv_id", "n", "ends"])


def distinct_paths(members: DataFrame) -> DataFrame:
    """(path, conv_id, n, ends) of each different path of ``members`` (conv_id, path, name): its smallest conversation, how many there are, and the hash of their ids.

    Ids of one path are dealt by ranges of (name, id), so that a path which a third of all share lies in many tasks; each
    makes a text of its part, and a hash reads the parts of a path in order, one at a time. Paths meet by their names
    (16 bytes of a hash), counted in each task before."""
    n = per_task(members)
    ranges = members.select("name", "conv_id").repartitionByRange(n, "name", "conv_id").sortWithinPartitions("name", "conv_id")
    parts = in_arrow(ranges, _pieces, "name binary, first long, part binary, n long")
    ends = in_arrow(parts.repartition(n, "name").sortWithinPartitions("name", "first"), _digests, "name binary, conv_id long, n long, ends binary")
    return members.groupBy("name").agg(F.first("path").alias("path")).join(ends, "name").select("path", "conv_id", "n", "ends")


# ---- the skeleton
class Skeleton:
    """The trie of the splitters' paths: nodes numbered in order of their paths, the root 0; ``end`` is one past a node's last descendant."""

    def __init__(self, splitters: list[bytes]) -> None:
        self.splitters = splitters
        self.number: dict[tuple[int, bytes], int] = {}
        self.parent, self.depth, self.chars = [-1], [0], [0]
        for path in splitters:
            at = 0
            for d in range(0, len(path), UNIT):
                step = path[d : d + UNIT]
                if (at, step) not in self.number:
                    self.number[at, step] = len(self.parent)
                    self.parent.append(at)
                    self.depth.append(d // UNIT + 1)
                    self.chars.append(int.from_bytes(step[16:], "big"))
                at = self.number[at, step]
        self.end = list(range(1, len(self.parent) + 1))
        self.children = [0] * len(self.parent)
        for v in range(len(self.parent) - 1, 0, -1):
            up = self.parent[v]
            self.end[up] = max(self.end[up], self.end[v])
            self.children[up] += 1


def shared_turns(a: bytes, b: bytes) -> int:
    """Turns that two paths begin with alike."""
    low, high = 0, min(len(a), len(b)) // UNIT
    while low < high:
        mid = (low + high + 1) // 2
        if a[: mid * UNIT] == b[: mid * UNIT]:
            low = mid
        else:
            high = mid - 1
    return low


def splitters_of(paths: DataFrame, shards: int) -> list[bytes]:
    """At most shards - 1 paths in order that part ``paths`` into about equal ranges: of a sample by hash, each cut after the
    first turn that tells it from the sampled path before it."""
    sample = paths.select(F.substring("path", 1, SPLITTER_TURNS * UNIT).alias("path"), F.xxhash64("path").alias("h")).orderBy("h", "path").limit(SAMPLES * shards).select("path").toArrow()
    held = sorted(set(sample["path"].to_pylist()))
    step = max(1, -(-len(held) // shards))
    cut = [held[i][: (shared_turns(held[i - 1], held[i]) + 1) * UNIT] for i in range(step, len(held), step)]
    return sorted(set(cut))


# ---- the shards
class _Open:
    """A node whose subtree is being read."""

    __slots__ = ("chars", "children", "conv_id", "ends", "held", "leaves", "n", "number", "saved")

    def __init__(self, chars: int, number: int | None) -> None:
        self.chars, self.number = chars, number
        self.n = self.children = self.leaves = self.saved = 0
        self.conv_id: int | None = None
        self.ends = NO_ENDS
        self.held: bytearray | None = None


def _least(a: int | None, b: int | None) -> int | None:
    return a if b is None else b if a is None else min(a, b)


class _Shard:
    """Reads different paths in order and gives the rows of NODES: finished nodes, and parts of skeleton nodes.

    It holds the nodes of the path being read, and of each, packed, its finished children, which wait for its smallest member."""

    def __init__(self, skeleton: dict[tuple[int, bytes], int]) -> None:
        self.skeleton, self.path, self.stack = skeleton, b"", [_Open(0, 0)]
        self.done: list[tuple[int | None, np.ndarray]] = []  # (number of the skeleton parent, its children)
        self.parts: list[tuple] = []
        self.rows = 0

    def _give(self, number: int | None, held: bytearray) -> None:
        rows = np.frombuffer(bytes(held), dtype=NODE)
        self.done.append((number, rows))
        self.rows += len(rows)

    def close(self, depth: int) -> None:
        """Finish the open nodes deeper than ``depth``."""
        while len(self.stack) > depth + 1:
            v, up = self.stack.pop(), self.stack[-1]
            up.n += v.n
            up.conv_id = _least(up.conv_id, v.conv_id)
            if v.held is not None:
                if v.number is None:
                    rows = np.frombuffer(v.held, dtype=NODE).copy()
                    rows["up"] = v.conv_id
                    v.held = bytearray(rows.tobytes())
                self._give(v.number, v.held)
            if v.number is not None:
                self.parts.append((v.number, v.conv_id, v.n, v.children, v.leaves, v.saved, v.ends))
                self.rows += 1
                continue
            saved, leaves = v.saved + (v.n - 1) * v.chars, v.leaves if v.children else 1
            up.children, up.leaves, up.saved = up.children + 1, up.leaves + leaves, up.saved + saved
            row = np.zeros((), dtype=NODE)
            row["conv_id"], row["depth"], row["up"], row["n_convs"], row["n_children"], row["n_leaves"], row["saved"] = v.conv_id, len(self.stack), -1 if up.number is None else up.number, v.n, v.children, leaves, saved
            row["ends"] = np.frombuffer(v.ends, dtype=np.uint8)
            up.held = up.held or bytearray()
            up.held += row.tobytes()

    def read(self, path: bytes, conv_id: int, n: int, ends: bytes) -> None:
        shared = shared_turns(self.path, path)
        self.close(shared)
        for d in range(shared, len(path) // UNIT):
            step = path[d * UNIT : (d + 1) * UNIT]
            up = self.stack[-1].number
            self.stack.append(_Open(int.from_bytes(step[16:], "big"), None if up is None else self.skeleton.get((up, step))))
        at = self.stack[-1]
        at.n, at.conv_id, at.ends = at.n + n, _least(at.conv_id, conv_id), ends
        for v in self.stack:  # what waits for a skeleton parent need not wait
            if v.number is None:
                break
            if v.held is not None and len(v.held) > ROWS * NODE.itemsize:
                self._give(v.number, v.held)
                v.held = None
        self.path = path

    def end(self) -> None:
        self.close(0)
        root = self.stack[0]
        if root.held is not None:
            self._give(0, root.held)
        if root.n:
            self.parts.append((0, root.conv_id, root.n, root.children, root.leaves, root.saved, root.ends))

    def batch(self) -> pa.RecordBatch:
        """What is finished."""
        names = [c.split()[0] for c in NODES.split(", ")]
        out = []
        for number, rows in self.done:
            n = len(rows)
            ends = pa.array([e.tobytes() for e in rows["ends"]], pa.binary())
            up = pa.nulls(n, pa.int64()) if number is not None else pa.array(np.ascontiguousarray(rows["up"]))
            up_number = pa.array(np.full(n, number), pa.int64()) if number is not None else pa.nulls(n, pa.int64())
            values = [pa.array(np.ascontiguousarray(rows[c])) for c in ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved")]
            out.append(pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), up_number, *values[:2], up, *values[2:], ends], names=names))
        if self.parts:
            number, conv_id, n, children, leaves, saved, ends = zip(*self.parts, strict=True)
            none = pa.nulls(len(number), pa.int64())
            out.append(pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), none, pa.array(conv_id, pa.int64()), none, none, *[pa.array(c, pa.int64()) for c in (n, children, leaves, saved)], pa.array(ends, pa.binary())], names=names))
        self.done, self.parts, self.rows = [], [], 0
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0]


def trie(members: DataFrame, shards: int | None = None) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: every node of the trie of ``members`` (conv_id, path).

    Different paths are dealt to ranges of their order by splitters. A node that lies in two ranges is a prefix of a splitter:
    the skeleton, which is sent to all tasks. Every other node lies in one shard, which reads its paths in order and finishes
    it there; of a skeleton node a shard gives its part. Parts are summed by node, and sums over skeleton subtrees are
    differences of running sums in the skeleton's order. Copies are counted before paths are dealt. A path is one value of
    UNIT bytes a turn; a shard holds the path being read and, packed, the finished children of its nodes.
    An empty table gives no nodes; else the root is one, with all conversations."""
    shards = shards or per_task(members)
    kept = keep(members.withColumn("name", F.unhex(F.md5("path"))), "members")
    paths = keep(distinct_paths(kept), "paths")
    skeleton = Skeleton(splitters_of(paths, shards))
    spark = members.sparkSession
    known = spark.sparkContext.broadcast((skeleton.splitters, skeleton.number))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitters = known.value[0]
        for batch in batches:
            yield batch.append_column("shard", pa.array([bisect_right(splitters, p) for p in batch.column(0).to_pylist()], pa.int32()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(known.value[1])
        for batch in rows_of(batches, 1024):
            for row in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True):
                shard.read(*row)
            if shard.rows >= ROWS:
                yield shard.batch()
        shard.end()
        if shard.rows or shard.parts:
            yield shard.batch()

    dealt = in_arrow(paths, deal, "path binary, conv_id long, n long, ends binary, shard int").repartitionById(len(skeleton.splitters) + 1, F.col("shard")).sortWithinPartitions("path")
    found = keep(in_arrow(dealt, read, NODES), "nodes")

    fixed = spark.createDataFrame(pa.table({"number": np.arange(len(skeleton.parent)), "up_number": np.array(skeleton.parent), "depth": np.array(skeleton.depth), "end": np.array(skeleton.end), "chars": np.array(skeleton.chars), "inner": np.array(skeleton.children)}))
    parts = found.where("number is not null").groupBy("number").agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")], F.max(F.when(F.col("ends") != F.lit(NO_ENDS), F.col("ends"))).alias("ends"))
    sums = fixed.join(parts, "number").withColumn("n_children", F.col("n_children") + F.col("inner"))
    sums = sums.withColumns({"n_leaves": F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.col("n_leaves")), "saved": F.col("saved") + (F.col("n_convs") - 1) * F.col("chars")})
    running = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # the skeleton alone: its bound is above
    sums = keep(sums.withColumns({"leaves_to": F.sum("n_leaves").over(running), "saved_to": F.sum("saved").over(running)}), "skeleton")
    last = sums.select((F.col("number") + 1).alias("end"), F.col("leaves_to").alias("leaves_end"), F.col("saved_to").alias("saved_end"))
    names = sums.select(F.col("number").alias("up_number"), F.col("conv_id").alias("known"))
    top = sums.join(sent(last), "end").join(sent(names), "up_number", "left")
    top = top.select("conv_id", "depth", F.col("known").alias("parent_conv_id"), "n_convs", "n_children", (F.col("leaves_end") - F.col("leaves_to") + F.col("n_leaves")).alias("n_leaves"), (F.col("saved_end") - F.col("saved_to") + F.col("saved")).alias("saved"), "ends")
    rest = found.where("number is null").join(sent(names), "up_number", "left")
    rest = rest.select("conv_id", "depth", F.coalesce("known", "up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved", "ends")
    return rest.unionByName(top).select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"), "n_leaves", F.col("saved").alias("saved_tokens"), F.lower(F.hex(F.coalesce("ends", F.lit(NO_ENDS)))).alias("ends_sha256")
    )


def conversation_trie(conversations: DataFrame, shards: int | None = None) -> DataFrame:
    """The trie (see trie) of ``conversations`` (conv_id, turn, role, text) rebuilt with their family's heads (see rebuilt).

    Null roles and texts are empty, null turns come first, turns of one number by their hashes; repeated rows are turns each;
    rows with a null conv_id are left out; other columns are not read."""
    return trie(rebuilt(keep(own_paths(conversations), "paths")), shards)
