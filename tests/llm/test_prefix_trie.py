"""The conversation trie against plain Python: nulls, ties, repeated rows, hot copies, long conversations, missing families."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from slatewise.llm import prefix_trie
from slatewise.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, depth int, n_convs string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def unit(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32].upper() + f"{len(text):08X}"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, unit(role, text), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, path in whole.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    out = Counter()
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(p))))
        out[min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def same(spark, rows, shards=None, cols=SCHEMA):
    frame = spark.createDataFrame([(*r, 7, "x") for r in rows], cols)
    got = prefix_trie.conversation_trie(frame.repartition(3), shards)
    assert tuple(got.columns) == COLUMNS
    assert Counter(tuple(r) for r in got.collect()) == brute(rows)


def test_odd_conversations(spark):
    rows = [(None, 0, "user", "nobody"), (0, 1, "user", "b"), (0, 0, "user", "a"), (0, None, None, "first"), (0, 2, None, None), (5, 0, "user", "a"), (5, 0, "user", "a"), (5, 1, "", "é" * 9), (-3, 0, "user", "a"),
            (250, 0, "user", "no family"), (251, 3, "x", "tie"), (251, 3, "a", "tie"), (100, 0, "u", "h"), (101, 0, "own", "later"), (102, 9, "2:a", ""), (103, 9, "2", "a:")]
    same(spark, rows, 3)
    same(spark, rows)
    assert prefix_trie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    same(spark, [(7, None, None, None)], 4)


@pytest.mark.parametrize("shards", [1, 5, 16])
def test_hot_and_long(spark, shards):
    """A third are copies, a third share one beginning and then part, one is very long and one a prefix of it."""
    rng = np.random.default_rng(3)
    rows = []
    for c in range(240):
        if c % 3 == 0:
            turns = ["same"] * 4
        elif c % 3 == 1:
            turns = ["same", "start", *[f"t{rng.integers(3)}" for _ in range(rng.integers(9))]]
        else:
            turns = [f"w{rng.integers(5)}" for _ in range(rng.integers(1, 7))]
        rows += [(c, i, "user" if i % 2 else "assistant", t) for i, t in enumerate(turns)]
    rows += [(1000, i, "user", f"{i % 7}") for i in range(300)] + [(1001, i, "user", f"{i % 7}") for i in range(150)]
    same(spark, rows, shards)


def test_pieces_join_in_order(monkeypatch):
    """Ids of one node in many pieces hash as one list."""
    monkeypatch.setattr(prefix_trie, "PIECE", 100)
    monkeypatch.setattr(prefix_trie, "ROWS", 3)
    rows = [(b"a", i) for i in range(0, 5000, 7)] + [(b"b", 4)] + [(b"c", i) for i in range(-50, 50)]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[at : at + 60]], pa.binary()), pa.array([r[1] for r in rows[at : at + 60]])], names=["name", "conv_id"]) for at in range(0, len(rows), 60)]
    parts = list(prefix_trie._pieces(iter(batches)))
    assert sum(p.num_rows for p in parts) > 50
    got = [tuple(r.values()) for b in prefix_trie._digests(iter(parts)) for r in b.to_pylist()]
    want = {}
    for name, i in rows:
        want.setdefault(name, []).append(i)
    assert got == [(n, v[0], len(v), hashlib.sha256(",".join(map(str, v)).encode()).digest()) for n, v in want.items()]


def test_query_on_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    name = next(n for n in QUERIES if n.startswith("op13_"))
    assert Counter(tuple(r) for r in QUERIES[name](spark, sf_dir).select(*COLUMNS).collect()) == brute(rows)


def test_units_tell_turns_apart(spark):
    frame = spark.createDataFrame([("a", "b"), ("", "ab"), (None, "ab"), ("ab", None)], "role string, text string")
    got = [bytes(r.u) for r in frame.select(prefix_trie.unit(F.col("role"), F.col("text")).alias("u")).collect()]
    assert len(set(got)) == 3 and got[1] == got[2] and all(len(u) == prefix_trie.UNIT for u in got)
