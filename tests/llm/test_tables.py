"""Operators on pages and vectors, the pipeline, and every registered SQL on the smallest tables."""

import gzip
import hashlib
import itertools
import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from slatewise.llm import queries, topk, urls, warc

PAGES = [
    (1, "http://A.example.net/en/x?q", "<p>" + "x" * 200), (2, None, "<p>" + "x" * 200), (3, "no scheme", None), (4, "HTTP://a.B.example.com:80/de/#f", ""), (4, "HTTP://a.B.example.com:80/de/#f", ""),
    (5, "http://ÄX.org/fr/é\r\n", "é" * 60), (6, "x://y://z.net/", "é" * 60), (None, "http://a.co.uk", "é" * 60), (7, "http://b.example.net", "\r\n\r\nWARC/1.1\r\n" * 12), (5, "http://other.org", "é" * 60), (8, "http://", "x" * 99), (9, "http://net", "x" * 99),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "u", 1) for p in PAGES], "page_id long, url string, html string, host string, bound int")


def test_warc(spark, pages):
    rows = [(p, (h or "").encode()) for p, _, h in PAGES]
    want = Counter()
    for p, body in rows:
        same = [q for q, b in rows if b == body and q is not None]
        first = min(same) if len(body) >= 100 and sum(b == body for _, b in rows) > 1 else None
        again = first is not None and p != first
        want[(p, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first if again else None)] += 1
    assert Counter(tuple(r) for r in warc.page_records(pages).collect()) == want
    assert warc.page_records(pages.limit(0)).count() == 0


def test_warc_nested(spark, pages):
    done = warc.captures(pages, with_block=True).collect()
    assert len(done) == len(PAGES) and all(r.request and r.response and r.metadata for r in done)
    assert {r.response.block for r in done if r.response.warc_type == "response"} == {h or "" for _, _, h in PAGES}
    assert all(r.metadata.block == f"payload-bytes: {r.response.payload_bytes}" for r in done)
    assert all(r.request.target_uri == r.response.target_uri for r in done)


def test_archive_parts():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 7\r\n\r\nab\r\n\r\nc\r\n\r\n"
    data = record * 3
    for step in (1, 7, 1000):
        got = list(warc.parse_archive(data[i : i + step] for i in range(0, len(data), step)))
        assert [g[2] for g in got] == [b"ab\r\n\r\nc"] * 3 and [g[0] for g in got] == [0, len(record), 2 * len(record)]
    with pytest.raises(ValueError):
        list(warc.parse_archive([data[:-9]]))


def test_archives_as_streams(spark, tmp_path):
    """Lines of any kind give back the same bytes; archives of several members, of one record and of none, more of them than tasks."""
    texts = ["", "\n", "\r", "\r\n", "\n\n\r\r\n\n", "\r\n\r\nWARC/1.1\r\n\r\n", "WARC/1.1\nWARC/1.1", "a\u2028b\x0bc\x0cd\x85e", "x" * 300_000, "é\n" * 50_000, "\r\n\r\n" * 9]

    def record(page, text):
        block = b"HTTP/1.1 200 OK\r\n\r\n" + text.encode()
        return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <{page}>\r\nX-Page-ID: {page}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    page, want = 0, []
    for n in range(60):
        members = []
        for k in range(n % 4):
            text = texts[(n + k) % len(texts)]
            members.append(gzip.compress(record(page, text)))
            want.append((f"a{n:02d}.gz", page, text))
            page += 1
        (tmp_path / f"a{n:02d}.gz").write_bytes(b"".join(members) or gzip.compress(b""))
    got = warc.read_records(spark, f"file://{tmp_path}/*.gz", with_block=True)
    assert sorted((r.archive.rsplit("/", 1)[1], r.page_id, r.block) for r in got.collect()) == want
    for archive, rows in itertools.groupby(sorted(got.collect(), key=lambda r: (r.archive, r.place)), key=lambda r: r.archive):
        sizes = [(r.place, r.page_id) for r in rows]
        assert sizes[0][0] == 0 and [p for _, p in sizes] == sorted(p for _, p in sizes), archive
    (tmp_path / "a99.gz").write_bytes(gzip.compress(record(0, "abc")[:-9]))
    with pytest.raises(Exception, match="ends inside a record"):
        warc.read_records(spark, f"file://{tmp_path}/*.gz").collect()


def test_urls(spark, pages):
    def split(url):
        if not url or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:end], rest[end:]
        stop = min([tail.index(c) for c in "?#" if c in tail], default=len(tail))
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:stop]

    def rule(host, path):
        fit = [(len(h + p), h + p, k) for k, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[1:] if fit else (None, None)

    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1), (5, None), (None, 1), (7, 1), (7, 0)], "page_id long, bad int")
    got = urls.judge(pages, labels).collect()
    want = Counter((p, *split(u)) for p, u, _ in PAGES)
    assert Counter((g.page_id, g.host, g.path) for g in got) == want
    for g in got:
        r, v = rule(g.host, g.path)
        assert g.rule == r and (g.verdict == v if v else g.verdict in ("allow", "block"))
    assert urls.judge(pages.limit(0), labels).count() == 0
    assert {g.verdict for g in urls.judge(pages, labels.limit(0)).collect() if g.rule is None} == {"allow"}


def test_posterior_decides_pages(spark):
    """On the tables, with one host's labelled pages bad and every fourth of the others': verdicts without a rule are those of
    the hosts' bounds against the pooled rate, and that host's pages are blocked. (The tables' own labels are of documents; hosts don't differ by them.)"""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    host = urls.split_url(F.col("url"))[0]
    rows = pages.select("page_id", host.alias("host")).collect()
    ruled = {r.page_id for r in urls.judge(pages, spark.createDataFrame([], "page_id long, bad int")).where("rule is not null").collect()}
    worst = Counter(r.host for r in rows if r.page_id not in ruled).most_common(1)[0][0]
    bad = {r.page_id: int(r.host == worst or r.page_id % 4 == 0) for r in rows if r.page_id % 5 < 4}
    got = urls.judge(pages, spark.createDataFrame(list(bad.items()), "page_id long, bad int")).where("rule is null").collect()
    pooled = sum(bad.values()) / len(bad)
    assert {g.verdict for g in got if g.host == worst} == {"block"} and "allow" in {g.verdict for g in got}
    assert all((g.verdict == "block") == (g.bound > pooled) for g in got if abs(g.bound - pooled) > 1e-6)
    n, k = Counter(), Counter()
    for r in rows:
        if r.page_id in bad:
            n[r.host] += 1
            k[r.host] += bad[r.page_id]
    assert all((g.n, g.k) == (n[g.host], k[g.host]) for g in got)


def test_registered(spark):
    hosts = {
        "a.b.example.co.uk": ("example.co.uk", "co.uk"), "h.com:8080": ("h.com", "com"), "1.2.3.4": ("1.2.3.4", "1.2.3.4"), "1.2.3.4:80": ("1.2.3.4", "1.2.3.4"), "user:pw@shop.example.org.": ("example.org", "org"),
        "[::1]:80": ("[::1]", "[::1]"), "me.github.io": ("me.github.io", "github.io"), "x.me.github.io": ("me.github.io", "github.io"), "b.s3.amazonaws.com": ("b.s3.amazonaws.com", "s3.amazonaws.com"), "localhost": ("localhost", "localhost"), "": ("", ""), "a.com.br": ("a.com.br", "com.br"),
    }
    frame = spark.createDataFrame([(h,) for h in hosts], "h string")
    domain, suffix = urls.registered(F.col("h"))
    assert {r.h: (r.d, r.s) for r in frame.select("h", domain.alias("d"), suffix.alias("s")).collect()} == hosts


def test_reputation(spark):
    """The ladder against plain arithmetic; a bad host among good ones is found."""
    rng = np.random.default_rng(2)
    rate = {"a.good.com": 0.05, "b.good.com": 0.1, "bad.com": 0.95, "x.mid.org": 0.4, "y.mid.org": 0.5, "c.co.uk": 0.2}
    rows = [(h, int(rng.random() < p)) for h, p in rate.items() for _ in range(60)] + [("new.bad.com", None), ("unseen.net", None)]
    got = {r.host: r for r in urls.host_reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    n, k = Counter(h for h, b in rows if b is not None), Counter()
    for h, b in rows:
        k[h] += b or 0
    domain = lambda h: ".".join(h.split(".")[-3:]) if h.endswith(".co.uk") else ".".join(h.split(".")[-2:])
    suffix = lambda d: "co.uk" if d.endswith("co.uk") else d.split(".")[-1]
    levels = [Counter(), Counter()], [Counter(), Counter()]
    for h in got:
        for (ln, lk), key in zip(levels, (domain(h), suffix(domain(h))), strict=True):
            ln[key] += n[h]
            lk[key] += k[h]
    p = sum(k.values()) / sum(n.values())

    def strength(ns, ks):
        g = [(ns[x], ks[x]) for x in ns if ns[x]]
        total, v = sum(a for a, _ in g), p * (1 - p)
        ss = sum(a * (b / a - p) ** 2 for a, b in g)
        free = total - sum(a * a for a, _ in g) / total - (len(g) - 1)
        return 1 / min(max((ss / v - (len(g) - 1)) / free, 0.001), 0.5) - 1 if free > 0 else 19

    (dn, dk), (sn, sk) = levels
    ms, md, mh = strength(sn, sk), strength(dn, dk), strength(n, k)
    for h, r in got.items():
        d, s = domain(h), suffix(domain(h))
        mean = (ms * p + sk[s]) / (ms + sn[s])
        mean = (md * mean + dk[d]) / (md + dn[d])
        mean = (mh * mean + k[h]) / (mh + n[h])
        assert math.isclose(r["mean"], mean) and math.isclose(r.bound, mean - math.sqrt(mean * (1 - mean) / (mh + n[h] + 1)))
    assert all(math.isclose(r.pooled, p) for r in got.values())
    blocked = {h for h, r in got.items() if r.bound > p}
    assert {"bad.com", "new.bad.com"} <= blocked and not blocked & {"a.good.com", "b.good.com", "c.co.uk", "unseen.net"}


def test_topk(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-3, 4, 5).tolist()) for i in range(300)] + [(7, [1, 2, 3, 1, 2]), (300, []), (400, [1, 1]), (100, [3, 3, 3, 3, 3]), (200, [1, 0, 0, 2, 1]), (200, [1, 0, 0, 2, 1])]
    rows = [(i, [x / 1024 for x in v]) for i, v in rows] + [(500, None), (600, [None, 1.0]), (700, [float("nan")]), (800, [float("inf")]), (None, [1.0] * 5), (900, [1e38, -1e38])]
    frame = spark.createDataFrame([(*r, "s") for r in rows], "vec_id long, embedding array<float>, score string").repartition(3)
    vectors = topk.integer_vectors(frame, "vec_id", "embedding")
    ok = [(i, [math.floor(1024 * int(np.float32(x))) if abs(x) > 1e30 else math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = Counter()
    for at, (q, a) in enumerate(ok):
        if q % 100 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, v, strict=False)), i) for j, (i, v) in enumerate(ok) if j != at)[:10]
            want.update((q, n + 1, i, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for n, (s, i) in enumerate(best))
    for sent in (1 << 26, 200):
        assert Counter(tuple(r) for r in topk.search(vectors, vectors.where("id % 100 = 0"), 10, sent).collect()) == want
    assert topk.search(vectors.limit(0), vectors.limit(0)).count() == 0


def test_topk_wide(spark):
    """Large finite components: scores of plain integers, in and beyond 64 bits."""
    rows = [(0, [20000.0]), (1, [17000.0]), (2, [30000.0]), (3, [-4e9]), (4, [9e9]), (5, [8e9]), (6, [1e300]), (7, [-1e300]), (8, [9e9])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = topk.integer_vectors(frame, "vec_id", "embedding")
    whole = {i: math.floor(1024 * int(v[0])) for i, v in rows}
    got = {}
    for r in topk.search(vectors, vectors, 10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q, a in whole.items():
        best = sorted((-a * b, i) for i, b in whole.items() if i != q)
        assert sorted(got[q]) == [(n + 1, i, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for n, (s, i) in enumerate(best)], q


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    for name, sql in queries.SQL.items():
        got, want = queries.QUERIES[name](spark, sf_dir), con.execute(sql)
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(got.columns), name
        assert Counter(tuple(r) for r in got.select(*columns).collect()) == Counter(want.fetchall()), name


def test_pipeline(spark, odd_docs, no_docs, tmp_path):
    from tests.llm.test_documents import brute_components

    docs, steps = odd_docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        if name != "pack":
            assert out.columns[:1] == ["doc_id"] and {"doc_id", "text", "lang", "source", "n_chars"} <= set(out.columns)
        out.write.parquet(str(tmp_path / name))
        docs = steps[name] = spark.read.parquet(str(tmp_path / name))
    told = steps["language_id"].collect()
    assert sorted(r.doc_id for r in told if r.doc_id) == [4, 5, 6, 6, 7, 9, 10] and len(told) == 8
    labels = brute_components([(r.doc_id, r.text) for r in told])
    keep = {(d, n) for (d, n, c) in labels if d == c or d is None}
    assert sorted((str(r.doc_id)) for r in steps["near_duplicates"].collect()) == sorted(str(d) for d, _ in keep)
    assert [r.text for r in steps["secret_scan"].where("doc_id is null").collect()] == ["no id here at all, <SECRET>"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, "/root/testdata/sf0.001").count() == 0


def test_pipeline_run(spark, sf_dir):
    done = corpus_pipeline.run(spark, sf_dir)
    assert done.where("length > 2048 or offset + length > 2048").count() == 0 and done.count() > 50
