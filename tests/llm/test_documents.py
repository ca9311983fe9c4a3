"""Document operators against plain brute force on the small tables and on odd rows."""

import hashlib
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from slatewise.llm import fingerprints, language, mixing, ngram_join, packing, resample, secrets


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def base(text):
    text = text or ""
    found = []
    for k, (name, pattern, flags, least) in enumerate([
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24),
    ]):
        for m in re.finditer(pattern, text, flags):
            if len(m[2] if name == "assign" else m[0]) >= least:
                found.append((m.start(), k, name, m.end()))
    return [(n, s, e) for s, _, n, e in sorted(found)]


def test_secrets_base(docs, odd_docs, no_docs):
    for frame in (docs, odd_docs):
        want = Counter()
        for r in frame.collect():
            b = base(r.text)
            n = Counter(x[0] for x in b)
            want[(r.doc_id, n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in b).encode()).hexdigest())] += 1
        got = rows_of(secrets.scan_secrets(frame))
        assert Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == want
    assert secrets.scan_secrets(no_docs).count() == 0


def test_secrets_link(spark):
    pad = " word" * 60
    far = " word" * 240
    texts = {
        1: "user: bob99 pwd: hunter2 host: db.example.net", 2: "pwd: hunter2 alone", 3: f"login=bob99{far} pwd=hunter2", 4: "user: bob99\n\npwd: hunter2",
        5: "token = abcdef1234 see https://api.example.net/x", 6: "see https://api.example.net/x and https://b.example.net", 7: "token=abc AKIA12345 x",
        13: "user: bob99\n" + "some=config\n" * 120 + "pwd: hunter2", 8: "user: bob99\r\n\r\npwd: hunter2", 9: "user: bob99\n \t\npwd: hunter2", 10: "user: bob99\r\npwd: hunter2", 11: f"login=bob99{pad}\nx\npwd=hunter2", 12: "user: bob99\r\rpwd: hunter2",
    }
    frame = spark.createDataFrame([(k, v) for k, v in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: [s.split(":")[0] for s in r["spans"].split(",") if s] for r in rows_of(secrets.scan_secrets(frame))}
    assert got == {1: ["identifier", "weak_secret", "endpoint"], 2: [], 3: ["identifier", "weak_secret"], 4: [], 5: ["assign", "endpoint"], 6: [], 7: ["weak_secret", "identifier"], 8: [], 9: [], 10: ["identifier", "weak_secret"], 11: ["identifier", "weak_secret"], 12: [], 13: ["identifier", "weak_secret"]}
    spans = {r["doc_id"]: r["spans"] for r in rows_of(secrets.scan_secrets(frame))}
    assert secrets.redact(texts[1], spans[1]) == "<SECRET> <SECRET> <SECRET>"
    assert secrets.redact(None, "assign:0:1") is None


def brute_link(parts, reach):
    out = set()
    for row, kind, role, s, e, scope, weak in parts:
        need = (0, 2) if role == 1 else (1,)
        if weak and any(r2 == row and o in need and c2 == scope and (reach is None or s2 - e <= reach and s - e2 <= reach) for r2, _, o, s2, e2, c2, _ in parts):
            out.add((row, kind, s, e))
    return out


def test_interval_join(spark):
    rng = np.random.default_rng(5)
    parts = [(int(rng.integers(3)), int(rng.integers(6)), int(rng.integers(3)), s := int(rng.integers(900)), s + int(rng.integers(1, 90)), int(rng.integers(2)), bool(rng.integers(2))) for _ in range(300)]
    frame = spark.createDataFrame(parts, "row long, kind int, role int, start long, end long, scope long, weak boolean")
    for reach in (5, 40, None):
        assert {tuple(r) for r in secrets.linked_spans(frame, reach).collect()} == brute_link(parts, reach)


def test_secrets_of_whole_scopes(spark, docs):
    """Every text of the table: base spans, and each weak one whose scope, block of lines by block, has what it lacks."""
    got = {}
    for r in rows_of(secrets.scan_secrets(docs)):
        got.setdefault(r["doc_id"], []).append(r["spans"])
    for r in docs.collect():
        text = r.text or ""
        base = secrets.base_spans(text)
        parts = [(s, k, e, False) for k, s, e in base] + [(s, k, e, True) for k, s, e in secrets.weak_spans(text, base)]
        block, lines = [], 0
        for line in text.splitlines(keepends=True):
            lines += line.isspace()
            block += [lines] * len(line)
        roles = {(block[s], secrets.ROLE[k]) for s, k, e, _ in parts}
        want = sorted({(s, k, e) for s, k, e, weak in parts if not weak or any((block[s], o) in roles for o in ((0, 2) if secrets.ROLE[k] == 1 else (1,)))})
        assert ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in want) in got[r.doc_id], r.doc_id


def canonical(text):
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold()).split()).encode()


def test_fingerprints(spark, docs, odd_docs, no_docs):
    for frame in (docs, odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"])):
        source = sorted(frame.collect(), key=lambda r: -r.doc_id)
        got = {r["doc_id"]: r for r in rows_of(fingerprints.fingerprints(frame))}
        assert len(got) == len(source)
        for i, r in enumerate(source):
            own, after = r.text or "", source[(i + 1) % len(source)].text or ""
            half = len(own) // 2
            edited = own[: len(own) - half] + after[:half]
            g = got[r.doc_id]
            assert g["n_chars"] == len(own) and g["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert g["fingerprint"] == xxhash.xxh3_128_hexdigest(canonical(own)) and g["edited_fingerprint"] == xxhash.xxh3_128_hexdigest(canonical(edited))
            assert g["near_edited"] == (canonical(own) == canonical(edited)) and g["near_next"] == (canonical(own) == canonical(after))
    assert fingerprints.fingerprints(odd_docs).count() == odd_docs.count()
    assert fingerprints.fingerprints(no_docs).count() == 0


def test_fingerprints_of_frequent_and_large_ids(spark):
    """A third of all rows without an id, a third of one id, the rest beyond 2^53: each meets its next one, and frequent ids lie in many ranges."""
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else (1 << 60) + i, f"text {i} " * (i % 7) if i % 50 else None) for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).cache()
    source = sorted(((r.doc_id if r.doc_id is not None else -(1 << 63), r.h, r.text or "") for r in frame.selectExpr("*", "xxhash64(coalesce(text, '')) h").collect()), key=lambda r: (-r[0], r[1]))
    want = Counter()
    for i, (_, _, own) in enumerate(source):
        half, after = len(own) // 2, source[(i + 1) % len(source)][2]
        want[(hashlib.sha256((own[: len(own) - half] + after[:half]).encode()).hexdigest(), len(own))] += 1
    assert Counter((r.edited_sha256, r.n_chars) for r in fingerprints.fingerprints(frame).collect()) == want
    firsts, hash_ = fingerprints._ranges(frame, 12)
    held = Counter(r[0] for r in frame.select(fingerprints._key().alias("key"), "text").select(fingerprints._own_range(firsts, hash_)).collect())
    assert sum(held.values()) == 600 and len(held) == len(firsts) >= 9 and max(held.values()) <= 150
    frame.unpersist()


def test_fingerprint_collisions(spark):
    frame = spark.createDataFrame([(1, "alpha"), (2, "Alpha "), (3, "beta"), (4, "gamma")], "doc_id long, text string")
    known = frame.selectExpr("doc_id", "case when doc_id < 4 then 'same' else 'own' end digest")
    got = {r.doc_id: r.variant for r in fingerprints.classes(frame, known, hashed=lambda body: "own" if body == b"gamma" else "same").collect()}
    assert got == {1: 0, 2: 0, 3: 1}


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in where[x] if j < i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                label[root(i)] = root(j)
    smallest = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None and sets[i]:
            smallest[root(i)] = min(smallest.get(root(i), doc_id), doc_id)
    return Counter((d, len(s), smallest.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def test_ngram_join(spark, odd_docs, no_docs):
    whole = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for frame in (whole, odd_docs):
        want = brute_components([(r.doc_id, r.text) for r in frame.collect()])
        assert Counter(tuple(r) for r in ngram_join.near_components(frame).collect()) == want
    assert ngram_join.near_components(no_docs).count() == 0


def test_ngram_join_near_copies(spark):
    """Copies at every distance around the bound, in chains and stars."""
    rng = np.random.default_rng(3)
    rows, words = [], [f"w{i}" for i in range(400)]
    for g in range(6):
        text = rng.choice(words, size=int(rng.integers(6, 120))).tolist()
        for _ in range(40):
            own = list(text)
            for at in rng.integers(0, len(own), size=int(rng.integers(0, 4))):
                own[at] = str(rng.choice(words))
            if rng.random() < 0.2:
                text = own
            rows.append((len(rows), " ".join(own)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(tuple(r) for r in ngram_join.near_components(frame).collect()) == brute_components(rows)


def test_packing(spark, docs, odd_docs, no_docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    for frame in (docs, odd_docs):
        got, want = rows_of(packing.pack(frame)), Counter()
        for r in frame.collect():
            ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4")
            first = len(ids) % 2048 or 2048
            cuts = [0, *range(first, len(ids), 2048)]
            for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(ids)], strict=True)):
                want[(r.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
        assert Counter((g["doc_id"], g["piece"], g["start"], g["length"], g["ids_crc32"]) for g in got) == want
        places = defaultdict(list)
        for g in got:
            places[g["sequence_id"]].append((g["offset"], g["length"]))
        for held in places.values():
            at = 0
            for offset, length in sorted(held):
                assert offset == at
                at += length
            assert at <= 2048
        total = sum(g["length"] for g in got)
        assert len(places) <= 1.02 * total / 2048 + 2
    assert packing.pack(no_docs).count() == 0


@pytest.mark.parametrize("text", ["a  b\n\n c\t\td 1234 it's   ", "<|endoftext|>x", "   x  \r\n", "’s don't I'LL  ½²", "日本語 text", "a\x00b \x00", "\x85x \xa0\xa0y", "ǅ ʰ x'sx", ""])
def test_encoder(text):
    code = packing.encoder(packing.default_tokenizer())
    for _ in range(2):
        assert code.encode(text) == np.array(code.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_genetic_step():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 1000, size=300)
    start = [packing.best_fit(sizes, rng.permutation(300), np.full(300, -1), [], 2048) for _ in range(3)]
    best = packing.evolve(sizes, start, 1, 2048)[0]
    assert packing.fitness(sizes, best) <= min(packing.fitness(sizes, p) for p in start)
    assert np.bincount(best, weights=sizes).max() <= 2048 and (best >= 0).all()
    child = packing.crossover(sizes, start[0], start[1], rng, 2048)
    assert np.bincount(child, weights=sizes).max() <= 2048 and (child >= 0).all() and set(child) == set(range(child.max() + 1))


def test_language(spark, odd_docs, no_docs):
    whole = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in language.identify(whole).collect()}
    want = {r.doc_id: r.lang for r in whole.collect()}
    assert set(got) == set(want) and all(g.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, g in got.items())
    held = [d for d in got if got[d].held_out]
    assert sum(got[d].lang_pred == want[d] for d in held) / len(held) > 0.97
    assert all(0 <= g.score <= 1 for g in got.values())
    odd = rows_of(language.identify(odd_docs))
    assert len(odd) == odd_docs.count()
    assert {r["doc_id"]: r["lang_pred"] for r in odd if r["doc_id"] in (1, 2, 3, 8)} == dict.fromkeys((1, 2, 3, 8), "und")
    assert language.identify(no_docs).count() == 0


def test_language_brute(spark):
    """Every prediction recomputed from plain sums of trigram vectors, also where languages go in rounds."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(80).collect()
    rows = [(r.doc_id, r.text, r.lang if r.doc_id % 3 else f"tag{r.doc_id % 7}") for r in rows]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    rng = np.random.default_rng(language.SEED)
    letters = rng.choice(np.array([-1, 1], dtype=np.int8), size=(language.SYMBOLS, language.DIMENSIONS)).astype(int)

    def vector(text):
        total = np.zeros(language.DIMENSIONS, dtype=int)
        s = "".join(c if c.isalpha() else " " for c in text.lower())
        symbols = [0, *(int(language.symbol_table()[ord(c)]) for c in s), 0]
        symbols = [x for i, x in enumerate(symbols) if x or not i or symbols[i - 1]]
        for a, b, c in zip(symbols, symbols[1:], symbols[2:], strict=False):
            total += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
        return total

    model = {}
    for d, text, lang in rows:
        if zlib.crc32(str(d).encode()) % 5 and text and lang:
            model[lang] = model.get(lang, 0) + vector(text)
    got = {r.doc_id: r for r in language.identify(frame).collect()}
    old, language.LANGUAGES = language.LANGUAGES, 2
    again = {r.doc_id: r for r in language.identify(frame).collect()}
    language.LANGUAGES = old
    for d, text, _ in rows:
        own = vector(text or "")
        cosine = {k: float(own @ v / np.linalg.norm(own) / np.linalg.norm(v)) for k, v in model.items()} if own.any() else {}
        for g in (got[d], again[d]):
            if not cosine:
                assert g.lang_pred == "und" and g.score == 0
            else:
                assert abs(g.score - max(0.0, max(cosine.values()))) < 1e-5 and cosine[g.lang_pred] > max(cosine.values()) - 1e-5


def test_trigram_vectors():
    table = language.symbol_table()
    a, b, c = (int(table[ord(x)]) for x in "abc")
    letters = np.random.default_rng(language.SEED).choice(np.array([-1, 1], dtype=np.int8), size=(language.SYMBOLS, language.DIMENSIONS))
    code = (a * language.SYMBOLS + b) * language.SYMBOLS + c
    assert (language.trigram_vectors(np.array([0, code]))[1] == np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]).all()
    assert code in language.trigrams("xABC, d")


def brute_ratios(rows, target):
    """Log ratio per bucket and each document's buckets, by plain integers."""
    mask, base = (1 << 64) - 1, 0x9E3779B97F4A7C15 | 1

    def mixed(h):
        h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & mask
        h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & mask
        return h ^ (h >> 31)

    def hashed(token):
        h, power = 0, 1
        for c in token.encode():
            h, power = (h + (c + 1) * power) & mask, (power * base) & mask
        return mixed((h + len(token.encode())) & mask)

    shift, seen = 64 - (resample.BUCKETS.bit_length() - 1), {}
    grams, counts = {}, [Counter(), Counter()]
    marks = "".join(chr(b) for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) != "_")
    for d, text in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        h = [seen.setdefault(t, hashed(t)) for t in re.findall(f"[{re.escape(marks)}]+|[^\\x20\\x09-\\x0D{re.escape(marks)}]+", text)]
        two = [mixed((a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) & mask) for a, b in zip(h, h[1:], strict=False)]
        grams[d] = [x >> shift for x in h + two]
        counts[0].update(grams[d])
        if d in target:
            counts[1].update(grams[d])
    whole = [sum(c.values()) + resample.BUCKETS * resample.SMOOTHING for c in counts]
    return [np.log((counts[1][b] + resample.SMOOTHING) / whole[1]) - np.log((counts[0][b] + resample.SMOOTHING) / whole[0]) for b in range(resample.BUCKETS)], grams


def test_resample(spark, odd_docs, no_docs):
    whole = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in resample.resample(whole, labels).collect()}
    marked = labels.collect()
    share = sum(r.quality == 1 for r in marked) / len(marked)
    assert sum(g.selected for g in got.values()) == round(share * len(got))
    assert min(g.key for g in got.values() if g.selected) >= max(g.key for g in got.values() if not g.selected)
    good, bad = ([got[r.doc_id].selected for r in marked if r.quality == q] for q in (1, 0))
    assert np.mean(good) > 0.6 and np.mean(bad) < 0.4
    # every weight, from counts of plain tokens and pairs and hashes of plain integers
    ratio, grams = brute_ratios([(r.doc_id, r.text) for r in whole.collect()], {r.doc_id for r in marked if r.quality == 1 and r.doc_id is not None})
    for d, g in got.items():
        assert g.n_grams == len(grams[d]) and abs(g.log_weight - sum(ratio[b] for b in grams[d])) < 1e-6
    per_gram = {r.doc_id: r for r in resample.resample(whole, labels, length_power=1.0, temperature=0.02).collect()}
    good, bad = ([per_gram[r.doc_id].selected for r in marked if r.quality == q] for q in (1, 0))
    assert np.mean(good) > 0.9 > 0.3 > np.mean(bad)
    assert resample.resample(odd_docs, labels.limit(0)).where("selected").count() == odd_docs.count()
    assert resample.resample(no_docs, labels).count() == 0


def test_mixing(spark, odd_docs, no_docs):
    whole = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(whole).collect()
    cells = Counter()
    for r in rows:
        cells[(r.source, r.lang, r.topic)] += r.tokens
    keys = list(cells)
    start = np.array([cells[k] for k in keys], dtype=float)
    weight = start.copy()
    targets = []
    for i, d in enumerate(mixing.DIMENSIONS):
        own = defaultdict(float)
        for k, w in zip(keys, start, strict=True):
            own[k[i]] += w
        scale = start.sum() / sum(w ** mixing.TEMPER[d] for w in own.values())
        targets.append({c: scale * w ** mixing.TEMPER[d] for c, w in own.items()})
    for _ in range(200):
        for i, target in enumerate(targets):
            for c in target:
                at = [j for j, k in enumerate(keys) if k[i] == c]
                weight[at] *= target[c] / weight[at].sum()
    p = dict(zip(keys, (weight / start) / (weight / start).max(), strict=True))
    assert all(abs(r.probability - p[(r.source, r.lang, r.topic)]) < 1e-5 for r in rows)
    assert all(r.sampled == (int(hashlib.md5(f"mix:{r.doc_id}".encode()).hexdigest()[:13], 16) / (1 << 52) < r.probability) for r in rows)
    assert mixing.mix(odd_docs).count() == odd_docs.count() and mixing.mix(no_docs).count() == 0
