import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spectrasieve.llm import meeting, simhash, spelling

DOCS = "doc_id long, text string, fp string, label long, component_id string, node int"


def texts(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1, "clash", 2) for i, t in rows], DOCS)


def roots(nodes, near):
    """The least node that each node reaches."""
    label = {x: x for x in nodes}
    todo = set(nodes)
    for x in sorted(nodes):
        if x in todo:
            todo.remove(x)
            stack = [x]
            while stack:
                y = stack.pop()
                label[y] = x
                more = [z for z in todo if near(y, z)]
                todo.difference_update(more)
                stack += more
    return label


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    h = [xxhash.xxh64(" ".join(words[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(spark):
    rnd = random.Random(5)
    vocabulary = ["Wort", "é", "mot", "a b", "x\u0085y", "Straße", *map(str, range(40))]
    base = [" ".join(rnd.choices(vocabulary, k=rnd.choice([1, 3, 9, 90, 400]))) for _ in range(60)]
    rows = []
    for i, t in enumerate(base):
        rows.append((10 * i + 7, t))
        for k in range(i % 4):
            w = t.split(" ")
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            rows.append((10 * i + k, rnd.choice([" ", "\n", "\t\v "]).join(w)))
    rows += [(9001, None), (9000, ""), (9002, " \r\n\f"), (None, None), (None, base[3].upper()), (37, base[3].upper()), (37, base[3].upper()), (9003, "one"), (9004, "word " * 70_000)]
    got = simhash.link(texts(spark, rows)).collect()
    fps = {t: plain_fingerprint(t) for _, t in rows}
    root = roots(set(fps.values()), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for i, t in rows:
        if i is not None:
            r = root[fps[t]]
            least[r] = min(i, least.get(r, i))
    want = [(i, f"{fps[t]:016x}", least.get(root[fps[t]])) for i, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert any(fps[a] != fps[b] and root[fps[a]] == root[fps[b]] for a in fps for b in fps)
    assert simhash.link(texts(spark, []).where("false")).count() == 0


@pytest.mark.parametrize("bits", [3, 4, 5])
def test_fingerprint_links_equal_brute_force_with_heavy_lists(spark, bits):
    rng = np.random.default_rng(bits)
    seeds = rng.integers(0, 1 << 63, 12).tolist()
    fps = {0, (1 << 64) - 1}
    for s in seeds:
        for _ in range(60):
            fps.add(s ^ sum(1 << int(k) for k in set(rng.integers(0, 64, rng.integers(1, 7)))))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = {x: r for x, r in roots(set(signed), lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= bits).items()}
    for hot, per_part in ((16_384, 1_000_000), (7, 500)):  # lists dealt over cells, many parts
        got = {r.node: r.label for r in simhash.link_fingerprints(df, bits, hot, per_part).collect()}
        assert {x: got.get(x, x) for x in signed} == want


def test_covering_sets_meet_every_agreement():
    import itertools

    for least in range(1, 9):
        sets = simhash.covering(least)
        assert all(any(set(t) <= set(q) for t in sets) for q in itertools.combinations(range(8), least))
    assert len(simhash.covering(4)) == 20
    x = np.array([0, 1, 1 << 63, 0xFF00FF00FF00FF00, 0x0100000000000001], np.uint64)
    assert simhash.shared_bytes(x).tolist() == [8, 7, 7, 4, 6]


def test_dealt_rows_of_a_key_always_meet(spark):
    df = spark.range(100).withColumn("key", F.col("id") % 2).withColumn("key", F.when(F.col("id") == 5, 7).otherwise(F.col("key")))
    got = meeting.dealt(df, ["key"], "id", 10).select("key", "id", "cell").collect()
    cells = {}
    for r in got:
        cells.setdefault((r.key, r.cell), set()).add(r.id)
    assert max(map(len, cells.values())) <= 30
    for key in (0, 1):
        ids = {r.id for r in got if r.key == key}
        assert all(any({a, b} <= c for (k, _), c in cells.items() if k == key) for a in ids for b in ids)
    assert sum(r.key == 7 for r in got) == 1


def edits(word, alphabet):
    """All words one edit away."""
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    for c in alphabet:
        out |= {word[:i] + c + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[i:] for i in range(len(word) + 1)}
    return out - {word}


def plain_variants(rows):
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    count = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    alphabet = sorted({c for w in count for c in w})
    near = {w: edits(w, alphabet) & count.keys() for w in count}
    form = {}
    for w, others in near.items():
        if others and count[best := min(others, key=lambda x: (-count[x], x))] >= 10 * count[w]:
            form[w] = best
    out = []
    for w, n in count.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), count[form[w]] if w in form else None))
    return sorted(out, key=str)


def test_spelling_equals_brute_force(spark):
    rnd = random.Random(3)
    stems = ["aaaaaaaa", "abababab", "straße\u00ffx", "\u00c9lan\u00d7\u00f7vital", "mississippi", "recognise", "wordlike", "z" * 3000]
    stems += ["".join(rnd.choices("abcdefgh", k=rnd.randint(7, 9))) for _ in range(60)]
    rows = []
    for i in range(300):
        words = []
        for s in rnd.choices(stems, weights=[1 + 400 // (k + 1) for k in range(len(stems))], k=30):
            for _ in range(rnd.choice([0] * 8 + [1, 1, 2])):
                if len(s) < 100:
                    s = rnd.choice(sorted(edits(s, "abz\u00e9")))
            words.append(s.upper() if rnd.random() < 0.1 and s.isascii() else s)
        rows.append((i, rnd.choice([" ", "\n", "1", "-"]).join(words)))
    rows += [(400, None), (401, ""), (402, "1 2"), (None, rows[0][1]), (3, rows[3][1]), (3, rows[3][1]), (405, "\u4e2dwordlike\u0100wordlike x")]
    want = plain_variants(rows)
    got = spelling.variants(texts(spark, rows)).collect()
    assert got[0].__fields__ == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got), key=str) == want
    assert any(r[1] and r[1] != r[2] for r in want) and any(r[4] > 3 for r in want)
    assert spelling.variants(texts(spark, []).where("false")).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(texts(spark, []), least=3)


def test_near_words_with_heavy_lists(spark):
    rnd = random.Random(9)
    words = {"".join(rnd.choices("ab", k=rnd.randint(7, 9))) for _ in range(400)}
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    want = {(w, x) for w in words for x in edits(w, "ab") & words}
    for hot, per_part in ((8_192, 400_000), (20, 300)):
        got = [(r.word, r.near) for r in spelling.near_pairs(df, hot, per_part).collect()]
        assert len(got) == len(set(got)) and set(got) == want
