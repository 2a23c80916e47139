import hashlib
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spectrasieve.llm import bpe, common, exact_dedup, html_extract, ngram_join, packing, quality, token_counts, word_codec

BYTE, WORD = bpe.tokenizer_path("byte_bpe_50k.json"), bpe.tokenizer_path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, n_chars long, label string"
ODD = ["", " ", "\n\n", "a  b", " lead", "trail ", "it's they'll", "<|endoftext|> x<|endoftext|>", "Éé ü x", "a\tb\r\nc", "日本語 テスト", "A" * 5000, "x\x1cy \x85 z", "ΑΣ Σ", "é ́x", "😀 ok", "word " * 3000]


def texts(spark, rows):
    return spark.createDataFrame([(i, t, None, None, "clash") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    return texts(spark, [*enumerate(ODD), (100, None), (None, "null id"), (None, None), (3, "a  b"), (101, "a  b")])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab c\n\t'É<|>日9!  endoftext", max_size=40), max_size=8))
def test_byte_encoder_equals_the_library(given_texts):
    enc = bpe.ByteEncoder(BYTE, limit=8)
    want = [e.ids for e in bpe.load(BYTE).encode_batch(given_texts, add_special_tokens=False)]
    assert [x.tolist() for x in enc.encode(given_texts)] == want
    assert [x.tolist() for x in enc.encode(given_texts)] == want
    size = bpe.byte_lengths(BYTE)
    assert [int(size[np.array(w, int)].sum()) for w in want] == [len(t.encode()) for t in given_texts]


@pytest.mark.parametrize("kw", [{}, {"most": 3}])
def test_word_codec(spark, odd, kw):
    tok = bpe.load(WORD)
    got = word_codec.encode_decode(odd, WORD, **kw).collect()
    assert len(got) == odd.count()
    want = sorted(((r.doc_id, e.ids, tok.decode(e.ids, skip_special_tokens=False)) for r in odd.collect() for e in [tok.encode(r.text or "", add_special_tokens=False)]), key=str)
    assert sorted(((r.doc_id, r.ids, r.decoded) for r in got), key=str) == want
    for r in got:
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert word_codec.encode_decode(odd.limit(0), WORD, **kw).count() == 0


@pytest.mark.parametrize("parts", [1, 50])
def test_word_codec_encodes_each_distinct_word_once(spark, parts):
    rows = [(i, f"common Words {i % 9} \t and\u00a0more{i} ideas end") for i in range(400)] + [(900, "long words " * 200_000)]
    docs, counter = texts(spark, rows).repartition(parts), spark.sparkContext.accumulator(0)
    tok = bpe.load(WORD)
    got = {r.doc_id: (r.ids, r.decoded) for r in word_codec.encode_decode(docs, WORD, most=20, counter=counter).collect()}
    for i, t in rows:
        ids = tok.encode(t, add_special_tokens=False).ids
        assert got[i] == (ids, tok.decode(ids, skip_special_tokens=False))
    assert counter.value == len({w for _, t in rows for w in re.split("[ \t]+", t) if w})


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(spark, odd, rule):
    tok = bpe.load(BYTE)
    got = {}
    for r in token_counts.section_counts(odd, BYTE, rule=rule).collect():
        got.setdefault(r.doc_id, []).append(r)
    for d in odd.collect():
        if d.doc_id is None or d.doc_id == 3:
            continue
        t = d.text or ""
        ids = tok.encode(t, add_special_tokens=False)
        rows = sorted(got[d.doc_id], key=lambda r: r.section)
        assert sum(r.n_tokens for r in rows) == len(ids.ids) and "".join(t[r.start_char : r.end_char] for r in rows) == t
        if rule == "first" and t.isascii():  # the library's own offsets decide
            want = [0] * len(rows)
            for begin, _ in ids.offsets:
                want[next(k for k, r in enumerate(rows) if r.start_char <= begin < r.end_char)] += 1
            assert [r.n_tokens for r in rows] == want
    null_ids = sorted((r.start_char, r.end_char, r.n_tokens) for r in got[None])
    assert null_ids == sorted([(0, 0, 0), (0, 7, len(tok.encode("null id", add_special_tokens=False).ids))])
    assert sorted((r.end_char, r.n_tokens) for r in got[3]) == sorted([(4, len(tok.encode("a  b", add_special_tokens=False).ids))] * 2)  # repeated rows
    assert token_counts.section_counts(odd.limit(0), BYTE, rule=rule).count() == 0
    with pytest.raises(ValueError, match="rule"):
        token_counts.section_counts(odd, BYTE, rule="all")


def test_owners():
    edge, ends = np.array([0, 4, 5, 9]), np.array([3, 7, 9])
    for rule, want in (("first", [0, 0, 2]), ("last", [0, 2, 2]), ("largest", [0, 2, 2])):
        own, crossing = token_counts.owners(ends, edge, rule)
        assert own.tolist() == want and crossing.tolist() == [False, True, False]


def check_pack(spark, df, window=1024):
    tok = bpe.load(BYTE)
    want = sorted(tuple(tok.encode(r.text or "", add_special_tokens=False).ids + [0]) for r in df.collect())
    rows = packing.pack(df, BYTE, window).collect()
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
    for s in by_seq.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == np.cumsum([0, *(r.length for r in s)])[:-1].tolist()
        total = sum(r.length for r in s)
        assert total == window or total & (total - 1) == 0 and total < window
    return rows, want, by_seq


def test_packing(spark, odd):
    unique = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    tok = bpe.load(BYTE)
    rows, want, _ = check_pack(spark, unique)
    docs = {r.doc_id: np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4") for r in unique.collect()}
    at = dict.fromkeys(docs, 0)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        ids = docs[r.doc_id]
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        at[r.doc_id] += r.length
    assert at == {k: len(v) for k, v in docs.items()} and len(want) == len(docs)
    check_pack(spark, odd, 16)
    assert packing.pack(odd.limit(0), BYTE).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60))
def test_packer_places_every_id_once(sizes):
    p = packing.Packer(16, 0)
    for i, n in enumerate(sizes):
        p.add(i, np.arange(n, dtype=np.uint32))
        levels = [len(x) for x in p.open]
        assert levels[1:] == p.count[1:16].tolist()
    p.finish()
    seen = sorted((d, s + k) for d, s, n, *_ in p.rows for k in range(n))
    assert seen == [(i, k) for i, n in enumerate(sizes) for k in range(n)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=50))
def test_packer_takes_the_level_of_least_squares(sizes):
    """After each document the sum of squares is the least that any placement of its remainder gives."""
    p, w = packing.Packer(16, 0), 16
    for i, n in enumerate(sizes):
        before = p.count[1:w].copy()
        p.add(i, np.arange(n, dtype=np.uint32))
        r, options = n % w, []
        for h in range(w - r + 1) if r else ():
            if h and not before[h - 1]:
                continue
            after = before.copy()
            if h:
                after[h - 1] -= 1
            if h + r < w:
                after[h + r - 1] += 1
            options.append(int((after**2).sum()))
        assert int((p.count[1:w] ** 2).sum()) == min(options, default=int((before**2).sum()))


def test_exact_dedup(spark, odd):
    long = "Lorem ipsum dolor sit amet. " * 2000
    df = odd.unionByName(texts(spark, [(200, long), (201, long), (202, long + "x"), (203, "x" + long), (204, long[:-1]), (205, ""), (206, None)]))
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.deduplicate(df, mean=64, least=16, most=512).collect()), key=str)
    groups = {}
    for r in df.collect():
        groups.setdefault(r.text or "", []).append(r.doc_id)
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    assert got == sorted(want, key=str)
    kept = exact_dedup.keep_one(df)
    rows = kept.collect()
    assert kept.columns == df.columns and len(rows) == len(groups)  # one of each group
    assert {(r.doc_id, r.text or "") for r in rows} == {(w[0], t) for t, ids in groups.items() for w in want if w[3] and w[0] in ids and w[4] == hashlib.sha256(t.encode()).hexdigest()}
    assert exact_dedup.deduplicate(df.limit(0)).count() == 0


def test_chunks_depend_on_content_alone():
    rng = np.random.default_rng(0)
    text = rng.integers(0, 255, 20_000).astype(np.uint8)
    alone = exact_dedup.chunk_ends(text, np.array([0, len(text)]), 256, 64, 1024)[0]
    both = exact_dedup.chunk_ends(np.concatenate([text[:777], text]), np.array([0, 777, 777 + len(text)]), 256, 64, 1024)[1]
    assert alone.tolist() == both.tolist() and np.diff(alone, prepend=0).max() <= 1024 + 64 and alone[-1] == len(text)
    shifted = exact_dedup.chunk_ends(np.concatenate([text[:5], text]), np.array([0, len(text) + 5]), 256, 64, 1024)[0] - 5
    assert len(set(alone.tolist()) & set(shifted.tolist())) > 0.8 * len(alone)


def test_collision_takes_the_digests(spark, monkeypatch):
    import xxhash

    made = exact_dedup.recipes(texts(spark, [(1, "a"), (2, "b")]).select("doc_id", "text"))
    assert exact_dedup.unverified(made).isEmpty()
    same = made.withColumn("chunks", F.array(F.lit(7).cast("long"), F.lit(1).cast("long")))
    assert exact_dedup.unverified(same).count() == 1
    assert xxhash.xxh3_64_intdigest(b"a") != xxhash.xxh3_64_intdigest(b"b")


def shingles(text, k=5):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(docs, percent=75):
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            o = len(sets[a] & sets[b])
            if o and 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i)) for i in ids}


def near_copies(seed, groups=8, members=12, words=120):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [vocabulary[i] for i in rng.integers(0, 400, 40)]
    out, n = [], 0
    for g in range(groups):
        base = [vocabulary[i] for i in rng.integers(0, 400, words)] + passage * (g % 2)
        for m in range(members):
            w = list(base)
            for _ in range(int(rng.integers(0, 7))):
                w[int(rng.integers(0, len(w)))] = f"x{rng.integers(0, 9999)}"
            out.append((n * 7 % 1000, " ".join(w) if m % 3 else "  ".join(w).upper()))
            n += 1
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_ngram_join(spark, seed):
    docs = near_copies(seed) + [(2000, ""), (2001, None), (2002, "a b"), (2003, "A  b"), (2004, " \n"), (2005, "a b c d e"), (2006, "one " * 20000)]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link(texts(spark, docs)).collect()}
    want = brute(docs)
    assert got == want and len({c for _, _, c in want}) < len(docs) - 5
    kept = ngram_join.keep_one(texts(spark, docs))
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in want}


def test_ngram_join_without_contraction(spark, monkeypatch):
    """All pairs of the lists lose no link either, where no component was contracted before."""
    monkeypatch.setattr(ngram_join, "_stars", lambda postings, *a: spark.createDataFrame([], "a long, b long"))
    docs = near_copies(3)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link(texts(spark, docs)).collect()} == brute(docs)


def test_ngram_join_finds_its_links_by_the_prefix_filters(spark):
    docs, report = near_copies(5), {}
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link(texts(spark, docs), report=report).collect()}
    assert got == brute(docs)
    assert report["first candidates"] < len(docs) and 0 < report["first links"] <= report["first candidates"] and report["links"] <= report["candidates"] < 8 * 12 * 11 / 2
    links = {(a, b) for a, _, x in got for b, _, y in got if x == y and a < b}
    assert report["first links"] + report["links"] < len(links)  # a group of copies does not give all its pairs


def test_ngram_join_lists_only_documents_that_can_link(spark):
    """A passage that all documents hold lists none of them that has enough tokens of its own."""
    passage = " ".join(f"p{i}" for i in range(60))
    own = [" ".join(f"d{d}w{i}" for i in range(240)) for d in range(60)]
    docs, report = [(d, f"{t} {passage}") for d, t in enumerate(own)], {}
    docs += [(100, f"{own[7]} {passage} end"), (101, " ".join(own[9].split(" ")[:203]))]  # 101 links with nothing: 199 of 296 shingles
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link(texts(spark, docs), report=report).collect()}
    assert got == brute(docs) and (100, 297, 7) in got and (101, 199, 101) in got
    assert report["listed"] <= 6 and report["candidates"] + report["first candidates"] <= 4


def test_ngram_join_keeps_tokens_that_tie(spark, monkeypatch):
    """Where all tokens of a document have one rank, all belong to its prefix."""
    monkeypatch.setattr(ngram_join, "orders", lambda sketch, s: [(np.zeros(len(s), np.uint64), np.ones(len(s), np.int64))] * len(sketch))
    sets = ngram_join.shingle_sets(pa.array(["a b c d e f g h i j"]), 5)
    sketch = spark.sparkContext.broadcast(np.zeros((2, 1 << 20), np.uint32))
    rows = ngram_join._postings(texts(spark, [(1, "a b c d e f g h i j")]).withColumn("label", F.col("doc_id")), sketch, 5, 75, 1, 9).collect()
    assert len(sets[0]) == 6 and [len(r.tokens) // 4 for r in rows] == [6, 6] and all(not any(np.frombuffer(r.places, "<u4")) for r in rows)


def test_ngram_join_grid(spark):
    """Lists that are dealt over a grid lose no link."""
    docs = near_copies(4)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link(texts(spark, docs), hot=2).collect()} == brute(docs)
    for a in range(40):
        which, cell = ngram_join._grid(np.array([0, 9, 3]), a, 3)
        assert which.tolist() == [0, 1, 1, 1, 2]
        other = ngram_join._grid(np.array([9]), a * 31 + 7, 3)[1]
        assert set(cell[1:4].tolist()) & set(other.tolist())


def test_ngram_join_grid_where_one_prefix_holds_the_token(spark, monkeypatch):
    """Ordinary tokens keep their key in a document whose prefix holds a dealt token too."""
    monkeypatch.setattr(ngram_join, "_stars", lambda postings, *a: spark.createDataFrame([], "a long, b long"))
    passage = [f"p{i}" for i in range(35)]
    short = passage + [f"s{i}" for i in range(9)]  # 9 rare shingles in a prefix of 11; the longer copy has 14 for its 12
    docs = [(1, " ".join(short)), (2, " ".join(short + [f"x{i}" for i in range(5)]))]
    docs += [(d, " ".join(passage + [f"d{d}w{i}" for i in range(200)])) for d in range(3, 9)]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link(texts(spark, docs), hot=2).collect()}
    assert got == brute(docs) and (2, 45, 1) in got


def test_ngram_join_odd_rows(spark):
    docs = texts(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (5, "A B c d e f")])
    assert sorted((r.component_id is None, r.component_id) for r in ngram_join.link(docs).collect() if r.n_shingles) == [(False, 1)] * 4
    assert ngram_join.link(docs.limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(i, i + 1) for i in range(0, 60)] + [(int(a), int(b)) for a, b in rng.integers(100, 400, (200, 2))]
    got = {r.node: r.label for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for a, b in edges for x in (a, b) if a != b}


def test_prefix_length():
    for n in range(1, 200):
        p = ngram_join.prefix_length(n, 75)
        assert 1 <= p <= n and n - p < -(-75 * n // 100) <= n - p + 1


HTML = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div>
<nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav><main><article class="post"><header><h1>T &amp; x</h1></header><p>One<br>two <b>bold</b><p>Three &lt;i&gt; &eacute;
<script>var t="</p>";</script><aside>side</aside><form><label>q</label></form><div id="comments"><article class="comment">hi</article></div></article></main>
<div class="sidebar">s</div><!-- <p>no</p> --><footer>&copy; me</footer>"""


def test_html_extract(spark):
    bare = lambda i: f'<div id="menu"><a href="/">Home</a></div><div class="wrap"><p>Body {i} has a long sentence of its own.</p><p>And more {i}</p></div><div class="ads">buy</div>'
    rows = [(1, "http://a/1", HTML), (2, "http://a/2", HTML.replace("One", "Uno")), (3, "http://b/1", bare(1)), (4, "http://b/2", bare(2)), (5, None, None), (None, "x", ""), (6, "http://c/", "plain &amp; text"), (1, "http://a/1", HTML), (7, "http://d/", "<p>unclosed <b>x <script>never ends")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    for kw in ({}, {"broadcast_bytes": -1}):
        got = html_extract.extract(df, **kw).collect()
        by = {r.page_id: r.text for r in got}
        assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
        assert by[1] == "T & x\nOne two bold\nThree <i> é" and by[2] == by[1].replace("One", "Uno")
        assert by[3] == "Body 1 has a long sentence of its own.\nAnd more 1" and by[5] == by[None] == "" and by[6] == "plain & text" and by[7] == "unclosed x"
    assert html_extract.extract(df.limit(0)).count() == 0


def test_roles():
    role = html_extract.role
    assert role("html/body.has.sidebar/div.content.sidebar.wrap/article.post") == 3 and role("html/body/main.no.header/p") == 2
    assert role("html/body/div.entry.content/div.post.header") == 1 and role("html/body/div.post.header") == -1
    for part in ("aside", "div.sidebar", "section.reader.comments", "form", "div.cookie.banner", "article.comment", "footer"):
        assert role(f"html/body/article/{part}/p") == -1


def test_choose_keeps_an_article_with_many_links():
    """Links inside an article don't make one of its paragraphs beat it."""
    head, said, link = "h" * 50, "p" * 200, "l" * 100
    page = html_extract.Page(f"<body><article><h1>{head}</h1><p>{said}</p><ul><li><a href=x>{link}</a></li></ul></article></body>")
    assert html_extract.choose([(p, c, n) for p, (_, c, n) in html_extract.token_rows(page).items()]) == "body/article"
    assert html_extract.main_text(page, html_extract.Template()) == "\n".join([head, said, link])


def test_equivalence_classes(spark):
    df = spark.createDataFrame([("h", f"<body><main><p>{i}</p>{'<div class=x>once</div>' if i == 0 else ''}</main></body>") for i in range(4)], "host string, html string")
    slots = {s.path for r in html_extract.templates(df).collect() for s in r.slots}
    assert slots == {"", "body", "body/main", "body/main/p"}  # one page's own element is in no valid class


@pytest.mark.parametrize("kw", [{}, {"broadcast_bytes": -1}])
def test_template_words_go(spark, kw, monkeypatch):
    """Words that a host's pages repeat belong to its template, whatever their element is called."""
    body = lambda i: f"<body><div><div>Read more of our stories below.</div><p>Story {i} begins with words of its own and goes on.</p><p>It ends so: {i * 7}.</p><div>Subscribe now for more.</div></div></body>"
    rows = [(i, f"http://h/{i}", body(i)) for i in range(20)] + [(19, "http://h/19", body(19)), (50, "http://lone/", body(50))]
    rows += [(60 + i, f"http://copies/{i}", body(60).replace("Subscribe", "Subscribe" + "!" * i)) for i in range(5)]  # near copies are no template
    rows += [(70 + i, f"http://order/{i}", body(70 + i) if i < 6 else body(70 + i).replace("<div>Read more of our stories below.</div>", "").replace("Subscribe now for more.</div>", "Subscribe now for more.</div><div>Read more of our stories below.</div>")) for i in range(7)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text.split("\n") for r in html_extract.extract(df, **kw).collect()}
    assert all(got[i] == [f"Story {i} begins with words of its own and goes on.", f"It ends so: {i * 7}."] for i in range(20))
    assert len(got[50]) == 4 and all(len(got[60 + i]) == 4 for i in range(5)) and all(len(got[70 + i]) == 2 for i in range(6))
    assert got[76][-1] == "Read more of our stories below."  # out of the template's order
    monkeypatch.setattr(html_extract, "templates", lambda p, **k: p.select("host", F.lit(None).cast("array<struct<path:string,chars:long,links:long>>").alias("slots"), F.lit(None).cast("array<long>").alias("words")).distinct())
    assert all(len(r.text.split("\n")) == 4 for r in html_extract.extract(df, **kw).collect())


def test_long_and_broken_pages(spark):
    deep = "<div>" * 200_000 + "deep" + "</div>" * 100_000 + "</section>" * 100_000
    quotes = '<a title="' * 200_000 + "x" * 1000
    open_tags = "<video> " * 100_000 + "<b <p " * 100_000 + "<![CDATA[" * 100_000
    many = "".join(f"<div class=q{chr(97 + i // 26 ** 3)}{chr(97 + i // 676 % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}>t{i}</div>" for i in range(100_000))
    rows = [(1, "http://a/1", deep), (2, "http://a/2", quotes), (3, "http://a/3", open_tags), (4, "http://b/1", many), (5, "http://b/2", many + "<p>end</p>"), (6, "http://c/1", "<p>said</p>" * 500_000)]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), broadcast_bytes=1 << 20).collect()}
    assert got[1].text == "deep" and got[2].n_chars > 1000 and got[4].text.count("\n") == 99_999 and got[6].text == "\n".join(["said"] * 500_000)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(0)
    words = ["the", "stone", "river", "walks", "along", "green", "paths", "while", "people", "talk", "about", "old", "times"]
    docs, labels = [], []
    for i in range(400):
        good = i % 4 != 0
        w = [words[k] for k in rng.integers(0, len(words), 60)]
        w = [f"{x}{j}" for j, x in enumerate(w)] if good else [f"{x}###%%%" for x in w[:3] * 20]
        docs.append((i, " ".join(w) + ".", "en", 1, "x"))
        labels.append((i, int(good), 0))
    labels += [(0, None, 1), (None, 1, 0), (5, 7, 0), (1, 1, 0)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark, labelled, odd):
    docs, labels = labelled
    model = quality.train(docs, labels)
    got = quality.classify(docs, model).join(labels.where("quality in (0, 1)").distinct(), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held) and np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in quality.classify(odd, model).collect())
    assert quality.keep_good(docs, model).columns == docs.columns
    assert {r.doc_id for r in quality.keep_good(docs, model).collect()} == {r.doc_id for r in quality.classify(docs, model).collect() if r.predicted}
    none = quality.train(docs, labels.limit(0))
    assert none.rules == [] and quality.classify(odd.limit(0), model).count() == 0
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert [(w, r) for w, r in quality.train(docs, flipped).rules] == [(w, r) for w, r in model.rules]  # held-out labels teach nothing


def test_quality_training_reaches_the_driver_with_bounded_rows(spark, labelled, monkeypatch):
    docs, labels = labelled
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y, names: seen.append((x.shape[0], len(y))))
    many = docs.unionByName(docs.where("doc_id = 1").drop("text").crossJoin(spark.range(10_000).select(F.concat(F.lit("word "), "id").alias("text"))).select(docs.columns))
    quality.train(many, labels, max_rows=7)
    quality.train(many, labels.where("doc_id = 1"), max_rows=2)
    assert seen[0] == (7, 7) and seen[1][0] <= 2


def test_rule_column_equals_rules(spark, labelled):
    docs, labels = labelled
    model = quality.train(docs, labels)
    stats = docs.select("doc_id", *[c.alias(k) for k, c in quality.statistics(F.col("text")).items()]).collect()
    score = {r.doc_id: r.score for r in quality.classify(docs, model).collect()}
    for r in stats:
        z = model.bias + sum(w for w, rule in model.rules if all((r[model.names[j]] > cut) == above for j, above, cut in rule))
        assert score[r.doc_id] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_shared_folder(spark):
    df = common.cut(spark.range(5))
    assert df.count() == 5 and common.few(df, 5) and not common.few(df, 4)
    common.drop_cut(df)
    with common.scratch(spark):
        gone, stays = common.cut(spark.range(3)), common.keep(common.cut(spark.range(4)))
    assert stays.count() == 4 and not os.path.exists(gone.cut_at.removeprefix("file://")) and os.path.exists(stays.cut_at.removeprefix("file://"))
