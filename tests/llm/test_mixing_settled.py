"""Raking until the marginals meet their targets."""

from collections import defaultdict

import pytest

from slatewise.llm import mixing


def marginals(cells, targets):
    """The largest relative error of the weights' marginals; ``cells`` are rows with weight."""
    own = defaultdict(float)
    for r in cells:
        for d in targets:
            own[d, r[d]] += r.weight
    return max(abs(own[d, c] / t - 1) for d, target in targets.items() for c, t in target.items())


@pytest.mark.parametrize("rare", [1, 100])
def test_marginals_meet_targets(spark, rare):
    """A source of 0.01 % (or 1 %) of the tokens needs more than twice its own weight."""
    sizes = {"a": 6000, "b": 4000 - rare, "c": rare}
    rows = [(s, g, t, n * 60 * (1 + (i + j) % 3)) for s, n in sizes.items() for i, g in enumerate(("en", "de", "fr")) for j, t in enumerate(("prose", "list"))]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    frames = {d: mixing.tempered_targets(cells, d, mixing.TEMPER[d]) for d in mixing.DIMENSIONS}
    targets = {d: {r[0]: r[1] for r in f.collect()} for d, f in frames.items()}
    raked = mixing.rake(cells, frames)
    assert marginals(raked.collect(), targets) < 5e-6
    assert {(r.dimension, r.category) for r in mixing.errors(raked, frames).where("abs(error) < 5e-6").collect()} == {(d, c) for d in targets for c in targets[d]}


def test_contradicting_targets_end(spark, caplog):
    """Where each source has one language, targets of both can't be met; the last dimension's are."""
    cells = spark.createDataFrame([("a", "en", "x", 900), ("b", "de", "x", 90), ("c", "de", "x", 10)], "source string, lang string, topic string, tokens long")
    frames = {d: mixing.tempered_targets(cells, d, mixing.TEMPER[d]) for d in mixing.DIMENSIONS}
    got = mixing.rake(cells, frames).collect()
    assert "contradict" in caplog.text
    assert marginals(got, {"topic": {"x": 1000.0}}) < 1e-9


def test_sample_is_drawn_by_settled_weights(spark):
    rows = [(i, f"w{i:04d} " * 60, "en", "rare" if i % 500 == 0 else "often", 9) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    p = {r.source: r.probability for r in mixing.mix(docs).collect()}
    assert p["rare"] == 1 and abs(p["often"] - (4 / 1996) ** 0.2) < 1e-5
    want = [r.doc_id for r in mixing.mix(docs).where("sampled").collect()]
    assert sorted(r.doc_id for r in mixing.sample(docs).collect()) == sorted(want)


def test_topics(spark):
    """The cluster of most different terms, by plain counting; a word that too many documents have is no term."""
    import hashlib
    from collections import Counter

    words = ["alpha", "bravo", "charlie", "deltas", "echoes", "foxtrot"]
    rows = [(i, " ".join(["everywhere"] * 3 + [words[i % 6]] * (1 + i % 3) + [words[(i * 5 + 1) % 6]])) for i in range(0, 12)] + [(i, "everywhere x") for i in range(12, 300)] + [(300, None), (301, "")]
    docs = spark.createDataFrame([(*r, None, "a") for r in rows], "doc_id long, text string, lang string, source string")
    terms = mixing.topic_terms(docs)
    df = Counter(w for _, t in rows for w in set((t or "").split()) if w in words)
    assert terms == sorted(df, key=lambda w: (-df[w], w))
    cluster = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % mixing.CLUSTERS
    for r in mixing.with_cells(docs, terms).collect():
        text = dict(rows)[r.doc_id]
        n = Counter(cluster(w) for w in set((text or "").split()) if w in terms)
        assert r.topic == (f"cluster{min(n, key=lambda c: (-n[c], c))}" if n else mixing.UNKNOWN)
        assert r.lang == mixing.UNKNOWN and r.tokens == max(1, len((text or "").split()))
