"""Packed products and mined negatives against plain Python integers."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from slatewise.llm import negatives, topk, vectors
from slatewise.llm.queries import QUERIES

LONG = (1 << 63) - 1


def whole(x, scale):
    return math.floor(x * scale) if abs(x) < 1 << 52 else int(x) * scale


@pytest.mark.parametrize("most", [1, 160, 40_000, 1 << 24, 1 << 40, 1 << 300])
def test_products(most):
    rng = np.random.default_rng(1)
    draw = lambda n: np.array([[int(rng.integers(-1000, 1001)) * most // 1000 for _ in range(9)] for _ in range(n)], dtype=object if most > 1 << 62 else np.int64)
    a, c = draw(5), draw(37)
    want = [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in c] for r in a]
    assert negatives.products(a, c).tolist() == want
    assert negatives.products(a * 0, c).tolist() == [[0] * 37] * 5


def test_whole_numbers():
    values = np.array([[0.5, -0.5, 5e-324, -5e-324, 1e300, 1.7976931348623157e308, -1.7976931348623157e308, 2.0**53 + 2, 1e16]])
    assert vectors.whole(values, 1024).tolist() == [[whole(v, 1024) for v in values[0].tolist()]]
    assert vectors.whole(values[:, :4], 1024).tolist() == [[512, -512, 0, -1]]


def brute(rows, scale=256):
    ok = [(i, lab, [whole(x, scale) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    clamp = lambda s: min(max(s, -LONG - 1), LONG)
    out = Counter()
    for n, (a, lab, v) in enumerate(ok):
        if a % 100:
            continue
        score = [sum(x * y for x, y in zip(v, w, strict=False)) for _, _, w in ok]
        positives = sorted((-score[m], i) for m, (i, other, _) in enumerate(ok) if m != n and other == lab)[:5]
        for s, p in positives:
            fit = sorted((-score[m], i) for m, (i, other, _) in enumerate(ok) if other != lab and 30 * -s <= 100 * score[m] <= 90 * -s)[:10]
            out.update((a, p, k + 1, i, clamp(-s), clamp(-t)) for k, (t, i) in enumerate(fit))
    return out


COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mined(spark, rows, **more):
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, score string").repartition(3)
    own = negatives.labelled_vectors(frame, "vec_id", "embedding", F.col("label"))
    return Counter(tuple(r) for r in negatives.mine(own, own.where("id % 100 = 0"), **more).select(*COLUMNS).collect())


def test_mine(spark):
    rng = np.random.default_rng(7)
    rows = [(i, int(rng.integers(3)), (rng.integers(-300, 301, 6) / 256).tolist()) for i in range(350)]
    rows += [(100, rows[100][1], rows[100][2]), (100, 1, [1.0] * 6), (7, 0, rows[7][2]), (500, 9, [1.0] * 6), (600, None, [1.0] * 6), (None, 1, [1.0] * 6), (700, 1, None), (800, 1, [None, 1.0]), (900, 1, [float("nan")]), (1000, 2, [0.5]), (1100, 2, []), (1200, 0, [0.0] * 6)]
    want = brute(rows)
    assert len(want) > 100
    assert mined(spark, rows) == want
    assert mined(spark, rows, sent=200) == want
    assert mined(spark, []) == Counter()


def test_blocks_merge():
    """Many small blocks give what one does."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    terms = pa.array(rng.integers(-9, 10, (100, 4)).astype(float).tolist(), pa.list_(pa.float64()))
    batch = pa.RecordBatch.from_arrays([terms, pa.array(range(100)), pa.array(rng.integers(0, 3, 100))], names=["terms", "id", "label"])
    for size in (7, 100, 4096):
        got = list(vectors.blocks(iter([batch.slice(0, 33), batch.slice(33)]), size, 4))
        assert np.concatenate([g[1] for g in got]).tolist() == list(range(100)) and all(len(g[1]) <= size for g in got)
        assert np.concatenate([g[0] for g in got]).tolist() == terms.to_pylist()


def test_large_components(spark):
    """Scores far beyond 64 bits rank, and are held against the band, by their true values."""
    big = [1.7976931348623157e308, 1.6e308, 1.2e308, -1e308, 9e307, 5e-324, 1.0, 1e9, 2.5e15]
    rows = [(100 * i, i % 2, [v, 1.0]) for i, v in enumerate(big)] + [(100 * i + 1, i % 3, [v / 2, -1.0]) for i, v in enumerate(big)]
    assert mined(spark, rows) == brute(rows)


def test_topk_at_the_ends_of_doubles(spark):
    rows = [(0, [1.7e308]), (1, [-1.7e308]), (2, [1.7976931348623157e308]), (3, [5e-324]), (4, [-5e-324]), (5, [1e307]), (6, [0.25])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    own = topk.integer_vectors(frame, "vec_id", "embedding")
    ints = {i: whole(v[0], 1024) for i, v in rows}
    got = {}
    for r in topk.search(own, own, 10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q, a in ints.items():
        order = sorted((-a * b, i) for i, b in ints.items() if i != q)
        assert sorted(got[q]) == [(n + 1, i, min(max(-s, -LONG - 1), LONG)) for n, (s, i) in enumerate(order)], q


def test_query_on_the_table(spark, sf_dir):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    name = next(n for n in QUERIES if n.startswith("op12_"))
    assert Counter(tuple(r) for r in QUERIES[name](spark, sf_dir).select(*COLUMNS).collect()) == brute(rows)
