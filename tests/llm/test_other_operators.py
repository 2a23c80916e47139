import fnmatch
import hashlib
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spectrasieve.llm import queries, url_filter, vector_search, warc_audit

TABLES = "documents embeddings pages benchmark labels conversations".split()


def pattern(glob):
    return re.compile("".join({"**": r"[\s\S]*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in re.findall(r"\*\*|[\s\S]", glob)).encode())


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab/.*?", max_size=90), min_size=1, max_size=4), st.lists(st.text(alphabet="ab/.", max_size=100), max_size=6))
def test_automaton(globs, urls):
    got = url_filter.Automaton(globs).run([u.encode() for u in urls])
    assert got.tolist() == [[bool(pattern(g).fullmatch(u.encode())) for g in globs] for u in urls]


def test_url_filter(spark):
    rows = [(1, "https://A.Example.NET/en/x?y#z"), (2, "http://example.net/de/"), (3, "http://www.example.com/de/1"), (4, "http://www.example.com/den"), (5, "http://a.org/fr/"), (6, "http://evil.com/x.net/y"), (7, None), (8, "no scheme"), (9, "http://x.net"), (10, "http://x.net?a=/en/"), (11, "http://b.com/login?x"), (12, ""), (None, "ftp://q.org/fr/a"), (1, "http://notexample.com/de/"), (13, "http://é.com/日本")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, rule string")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, queries.URL_BLOCK, queries.URL_ALLOW, queries.URL_GLOBS).collect()]
    assert got == [
        (1, "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "example.net", "/de/", "net/", "block"), (3, "www.example.com", "/de/1", "example.com/de/", "block"), (4, "www.example.com", "/den", None, "allow"),
        (5, "a.org", "/fr/", "org/fr/", "allow"), (6, "evil.com", "/x.net/y", None, "allow"), (7, "", "", None, "allow"), (8, "", "", None, "allow"), (9, "x.net", "", None, "allow"), (10, "x.net", "", None, "allow"),
        (11, "b.com", "/login", None, "block"), (12, "", "", None, "allow"), (None, "q.org", "/fr/a", "org/fr/", "allow"), (1, "notexample.com", "/de/", None, "allow"), (13, "é.com", "/日本", None, "allow"),
    ]
    words = spark.createDataFrame([(1, "http://a.free-bets.example.com/x"), (2, "http://ads.example.org"), (3, "http://roads.example.com/ads-x."), (4, "http://x.com/a.ads.b")], "page_id long, url string")
    assert [r.verdict for r in url_filter.judge(words, [], [], queries.URL_GLOBS).orderBy("page_id").collect()] == ["block", "block", "allow", "allow"]
    assert url_filter.judge(df.limit(0), ["net/"], [], []).count() == 0
    assert {r.verdict for r in url_filter.judge(df, [], [], [], default="block").collect()} == {"block"}
    with pytest.raises(ValueError, match="twice"):
        url_filter.judge(df, ["net/"], ["net/"], [])
    assert fnmatch.fnmatch("a", "a")


def pages(spark, n=60, segment=None):
    rows = [(i, f"http://h/{i}", f"<p>{'x' * (i % 7)}{i}</p>") for i in range(n)] + [(None, None, None), (None, "u", "v"), (3, "http://h/3", "again"), (5, None, None)]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")


@pytest.mark.parametrize(("fan", "size"), [(2, 8), (16, 1024), (3, 10)])
def test_audit(spark, fan, size):
    a = pages(spark)
    assert warc_audit.audit(a, a.repartition(3), fan=fan, segment_size=size).count() == 0
    b = a.where("coalesce(page_id, 0) <> 7").withColumn("html", F.when(F.col("page_id").isin(11, 40), F.concat("html", F.lit("!"))).otherwise(F.col("html"))).unionByName(spark.createDataFrame([(900, "u", "new", "")], a.schema))
    got = {(r.page_id, r.kind): r for r in warc_audit.audit(a, b, fan=fan, segment_size=size).collect()}
    assert set(got) == {(7, "missing"), (11, "changed"), (40, "changed"), (900, "added")}
    body = "<p>xxxx11</p>"
    text = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:11>\r\nWARC-Target-URI: http://h/11\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"
    r = got[11, "changed"]
    assert r.digest == hashlib.sha256(text.encode()).hexdigest() and r.length == len(text)
    empty = a.limit(0)
    assert warc_audit.audit(empty, empty).count() == 0 and {r.kind for r in warc_audit.audit(a, empty, fan=fan, segment_size=size).collect()} == {"missing"}
    roots = [sorted(map(tuple, warc_audit.root(p, fan, size).collect())) for p in (a, a.repartition(5), b)]
    assert roots[0] == roots[1] != roots[2]


def plain_top(rows, k):
    v = {}
    for i, x in rows:
        if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x):
            v.setdefault(i, []).append([int(np.floor(256 * np.float64(np.float32(c)))) for c in x])
    out = []
    for q in v:
        if q % 10 == 0:
            score = lambda c, q=q: max(max(1 - 2**63, min(2**63 - 1, sum(m * n for m, n in zip(a, b)))) for a in v[q] for b in v[c])  # noqa: E731, B905
            best = sorted((-score(c), c) for c in v if c != q)[:k]
            out += [(q, n, c, -s) for n, (s, c) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize(("n", "dim", "block"), [(300, 16, 64), (40, 3, 16384), (3, 4, 2)])
def test_vector_search(spark, n, dim, block):
    rng = np.random.default_rng(n)
    rows = [(i, (rng.normal(0, 1, dim) * (1 if i % 3 else 50)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(1000 + i, rows[0][1]) for i in range(0, 20)]  # ties
    rows += [(1500, [1e7] * dim), (1501, [-1e7, 9e6] + [0.0] * (dim - 2)), (1510, [3e9] + [1.0] * (dim - 1))]  # beyond 32 bits
    rows += [(0, rows[0][1]), (1500, [1e7] * dim), (1, rows[1][1]), (1, rows[2][1]), (1010, rows[2][1]), (1501, rows[1][1])]  # repeated ids, equal and not
    rows += [(2000, None), (2010, [None] * dim), (2020, [float("nan")] * dim), (2030, [float("inf")] + [0.0] * (dim - 1)), (None, rows[1][1]), (2040, [1e30] * dim), (2050, [1.0]), (2060, [0.0] * dim), (2070, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in vector_search.top_k(df, F.col("vec_id") % 10 == 0, block=block, query_block=7).collect())
    assert got == plain_top(rows, 5)
    clean = df.where("vec_id < 1000")  # no row is odd, so vectors are read as one array
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in vector_search.top_k(clean, F.col("vec_id") % 10 == 0, block=block, query_block=7).collect())
    assert got == plain_top([r for r in rows if r[0] is not None and r[0] < 1000], 5)
    assert vector_search.top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0 and vector_search.top_k(df, F.lit(False)).count() == 0


@pytest.mark.parametrize("kind", ["long tail", "low rank", "alike", "huge"])
def test_search_block_prunes_nothing_that_counts(kind):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 100, (500, 12))
    if kind == "long tail":
        x *= np.linspace(5, 0.01, 500)[:, None] ** 3
    if kind == "low rank":
        x = rng.normal(0, 100, (500, 2)) @ rng.normal(0, 1, (2, 12)) + rng.normal(0, 1, (500, 12))
    if kind == "huge":
        x *= 1e5
    x = x.astype("<i4")
    x = x[np.argsort(-(x.astype(float) ** 2).sum(1))]
    q, ids, sole = x[::25].copy(), np.arange(500), np.arange(500) % 50 != 7
    rotate = np.linalg.eigh(x.T.astype(float) @ x)[1][:, ::-1]
    counts = np.zeros(5, np.int64)
    qi, ci, score, best = vector_search.search_block(ids[::25], q, ids, sole, x, np.full(len(q), -np.inf), rotate, 5, step=32, counts=counts)
    for k in range(len(q)):
        s = q[k].astype(np.int64) @ x.T.astype(np.int64)
        s[25 * k] = -(10**15)
        top = np.sort(s[sole])[::-1][:5]
        assert best[k].tolist() == top.tolist()
        assert sorted(score[(qi == k) & sole[ci]], reverse=True) == top.tolist()
        assert set(np.flatnonzero(~sole & (s >= top[-1]))) <= set(ci[qi == k])
    assert (q[qi].astype(np.int64) * x[ci]).sum(1).tolist() == score.tolist()
    assert counts[0] == len(q) * 500 and (np.diff(counts) <= 0).all()
    assert kind not in ("long tail", "low rank") or counts[-1] < 0.7 * counts[0]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, data, name):
    df = queries.queries()[name](spark, data)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    rel = con.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    rows = lambda found: sorted((tuple(r[c] for c in columns) for r in found), key=str)
    assert rows(r.asDict() for r in df.collect()) == rows(dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall())
