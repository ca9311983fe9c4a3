"""Counts by bitmaps against plain counting: seasons, blocks, groups of blocks, rare keys."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from slatewise.operators import mining, vertical


def profiles(spark, n, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(g, 2000 + int(rng.integers(3)), sorted(rng.choice(mining_keys := 12, int(rng.integers(0, 7)), replace=False).tolist()), int(rng.integers(0, 1 << 5))) for g in range(n)]
    assert mining_keys == 12
    return rows, spark.createDataFrame(rows, "game_id long, season int, codes array<int>, bits long")


def brute(rows, legs, least):
    n, h, whole = Counter(), Counter(), Counter()
    for _, season, codes, bits in rows:
        for k in range(1, legs + 1):
            for c in combinations(codes, k):
                code = 0
                for x in c:
                    code = (code << 7) + x + 1
                whole[code] += 1
                n[code, season] += 1
                for o in range(5):
                    h[code, season, o] += bits >> o & 1
    return {(c, s, k, *[h[c, s, o] for o in range(5)]) for (c, s), k in n.items() if whole[c] >= least}


@pytest.mark.parametrize(("block", "group"), [(16_384, 64), (70, 64), (50, 2)])
def test_counts(spark, monkeypatch, block, group):
    monkeypatch.setattr(vertical, "BLOCK", block)
    monkeypatch.setattr(vertical, "GROUP", group)
    rows, own = profiles(spark, 400)
    for legs, least in ((4, 5), (2, 1), (1, 30)):
        got = vertical.pattern_counts(own, 12, 5, legs, least, 7)
        assert {tuple(r) for r in got.collect()} == brute(rows, legs, least), (legs, least)


def test_nothing(spark):
    rows, own = profiles(spark, 20)
    assert vertical.pattern_counts(own.limit(0), 12, 5, 4, 5, 7).count() == 0
    assert vertical.pattern_counts(own, 12, 5, 4, 1000, 7).count() == 0
    assert vertical.pattern_counts(own, 12, 5, 4, 5, 7).columns == ["combo", "season", "sample", "h0", "h1", "h2", "h3", "h4"]
    assert mining.pattern_counts.__defaults__ == (mining.LEGS, mining.LEAST)


def test_steps(monkeypatch):
    """Small steps over the words give the same counts."""
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << 63, (9, 40), dtype=np.uint64)
    words[0] = np.uint64((1 << 64) - 1)
    season, combos = np.sort(rng.integers(0, 3, 40)), np.array(list(combinations(range(6), 3)))
    want = vertical.counts(words, season, combos, 3, 3, 3)
    monkeypatch.setattr(vertical, "STEP", 50)
    assert (vertical.counts(words, season, combos, 3, 3, 3) == want).all() and want.sum() > 0
    both = words[3 + combos[5]]
    assert want[5, 1, 2] == sum(int(a & b & c & d).bit_count() for a, b, c, d, s in zip(*both, words[2], season, strict=True) if s == 1)


def test_grown():
    frequent = np.array([[0, 1], [0, 2], [0, 3], [1, 2], [2, 3]])
    assert vertical.grown(frequent, 7).tolist() == [[0, 1, 2], [0, 2, 3]]
    assert vertical.grown(np.array([[0], [2], [5]]), 7).tolist() == [[0, 2], [0, 5], [2, 5]]


def test_counts_are_added_up_in_tasks(spark, monkeypatch):
    """what tasks give doesn't grow with the groups of blocks; nothing is summed after them once chunks keep all tasks busy."""
    monkeypatch.setattr(vertical, "BLOCK", 20)
    monkeypatch.setattr(vertical, "GROUP", 2)
    monkeypatch.setattr(vertical, "CHUNK", 4)
    rows, own = profiles(spark, 400)
    got = vertical.pattern_counts(own, 12, 5, 4, 5, 7)
    assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in got.collect()} == brute(rows, 4, 5)
