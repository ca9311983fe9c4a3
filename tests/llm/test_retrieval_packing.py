"""Retrieval packing: exact round trips, BM25 against plain arithmetic, the greedy filling, neighbours that meet."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from slatewise.llm import retrieval_packing as rp
from slatewise.llm.packing import default_tokenizer
from slatewise.llm.queries import QUERIES


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer())


def check(tokenizer, docs, got, capacity=2048):
    """Pieces tile each document, ids are right, sequences have no gap and no padding."""
    ids = [(d, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in docs]
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
    want = defaultdict(Counter)
    copies = Counter((d, len(x)) for d, x in ids)
    for key, rows in pieces.items():
        assert sum(n for _, n, _ in rows) == key[1] * copies[key], key
    for d, x in ids:
        if copies[d, len(x)] == 1:
            at = 0
            for start, n, crc in sorted(pieces[d, len(x)]):
                assert start == at and n > 0 and crc == zlib.crc32(np.array(x[start : start + n], dtype="<u4").tobytes())
                at += n
            assert at == len(x)
        want[d][len(x)] += 1
    assert {k for k in pieces} == set(copies)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for rows in sequences.values():
        at = 0
        for offset, n in sorted(rows):
            assert offset == at
            at += n
        assert at <= capacity and at & (at - 1) == 0
    return sequences


def test_odd_documents(spark, tokenizer, odd_docs, no_docs):
    got = rp.pack(odd_docs).collect()
    check(tokenizer, [(r.doc_id, r.text) for r in odd_docs.collect()], got)
    assert rp.pack(no_docs).count() == 0 and rp.pack(no_docs).columns == list(rp.PIECES)
    one = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [(r.doc_id, r.start, r.length, r.doc_tokens, r.offset) for r in rp.pack(one).collect()] == [(1, 0, 1, 1, 0)]


def test_table(spark, tokenizer, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    name = next(n for n in QUERIES if n.startswith("op11_"))
    got = QUERIES[name](spark, sf_dir).collect()
    sequences = check(tokenizer, [(r.doc_id, r.text) for r in docs.collect()], got)
    assert sum(sum(n for _, n in rows) != 2048 for rows in sequences.values()) <= 11


def test_hot_and_tiny(spark, tokenizer):
    """A third are copies, a third have one token; rounds of rests meet."""
    docs = [(i, "the same text again " * 40 if i % 3 == 0 else "" if i % 3 == 1 else f"word{i} and other{i % 7} " * (i % 50 + 1)) for i in range(600)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    check(tokenizer, docs, rp.pack(frame).collect())


def test_scores():
    rng = np.random.default_rng(5)
    items = [rng.integers(0, 40, rng.integers(1, 60)) for _ in range(30)]
    df = np.array([sum(t in i for i in items) for t in range(40)], dtype=float)
    idf = np.log(1 + 30 / (df + 1))
    idf[3] = 0
    average = float(np.mean([len(i) for i in items]))
    index = rp.Index(items, idf, average)
    for q in (0, 7):
        terms = index.of(q)[0]
        want = []
        for i in items:
            tf = Counter(i.tolist())
            want.append(sum(idf[t] * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(i) / average)) for t in set(items[q].tolist()) if tf[t] and t != 3))
        assert np.allclose(index.scores(terms), want)
        used = np.arange(30) % 2 == 0
        index.without(used)
        assert np.allclose(index.scores(terms)[1::2], want[1::2]) and not index.scores(terms)[::2].any()
        index = rp.Index(items, idf, average)


def test_rarest():
    idf = np.array([0.0, 2.0, 5.0, 2.0, 0.0, 1.0])
    rank = rp.ranks(idf)
    assert rank.tolist() == [6, 1, 0, 2, 6, 3]
    first, second = rp.rarest([np.array([5, 2, 2, 0]), np.array([0]), np.array([3, 1]), np.array([5, 5])], rank)
    assert first.tolist() == [0, 6, 1, 3] and second.tolist() == [3, 6, 2, 6]


def test_greedy_filling():
    """Each window is the one of a plain greedy run over the same scores."""
    rng = np.random.default_rng(6)
    items = [rng.integers(0, 60, rng.integers(1, 99)) for _ in range(80)]
    idf, cap = np.linspace(0.1, 3, 60), 100
    index, left, rest, want = rp.Index(items, idf, 50.0), list(range(80)), None, []
    while left or rest:
        seed = rest or (left.pop(0), 0, None)
        seed, rest = (seed[0], seed[1], len(items[seed[0]])), None
        window, room = [seed], cap - (seed[2] - seed[1])
        scores = index.scores(index.of(seed[0])[0])
        near = sorted((i for i in left if scores[i] > 0), key=lambda i: (-scores[i], i))
        for i in near:
            if 0 < len(items[i]) <= room:
                window.append((i, 0, len(items[i])))
                room -= len(items[i])
                left.remove(i)
        for i in [n for n in near if n in left] + [n for n in left if n not in near]:
            if room:
                end = min(room, len(items[i]))
                window.append((i, 0, end))
                left.remove(i)
                room -= end
                rest = (i, end, None) if end < len(items[i]) else None
        want.append(window)
    got = list(rp.windows(items, idf, 50.0, cap))
    assert got == want and all(sum(e - b for _, b, e in w) == cap for w in got[:-1])


def test_powers():
    parts = list(rp.powers([(0, 0, 700), (1, 5, 300), (2, 0, 1)]))
    assert [sum(e - b for _, b, e in p) for p in parts] == [512, 256, 128, 64, 32, 4]
    assert [x for p in parts for i, b, e in p for x in [(i, j) for j in range(b, e)]] == [(0, j) for j in range(700)] + [(1, j) for j in range(5, 300)] + [(2, 0)]


def test_neighbours_meet(spark):
    """Documents of one topic lie in windows together, far more than by chance."""
    rng = np.random.default_rng(9)
    words = [[f"{chr(97 + t)}{chr(97 + w)}{rng.integers(1000, 9999)}" for w in range(20)] for t in range(12)]
    docs = [(i, " ".join(rng.choice(words[i % 12], 60))) for i in range(480)]
    got = rp.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    windows = defaultdict(Counter)
    for r in got:
        windows[r.sequence_id][r.doc_id % 12] += r.length
    share = sum(max(c.values()) for c in windows.values()) / sum(sum(c.values()) for c in windows.values())
    assert share > 0.7, share


def test_statistics_cover_all_documents(spark, tokenizer, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    idf, average, n = rp.statistics(rp.tokenized(docs, default_tokenizer(), 2048))
    ids = [[*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()]
    df = Counter(t for x in ids for t in set(x))
    rests = [len(x) % 2048 for x in ids if len(x) % 2048]
    assert n == len(rests) and math.isclose(average, sum(rests) / len(rests))
    for t, k in df.items():
        assert math.isclose(idf[t], max(0, math.log((len(ids) - k + 0.5) / (k + 0.5))) if k > 1 else 0, abs_tol=1e-12)
