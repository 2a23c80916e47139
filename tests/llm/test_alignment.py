import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spectrasieve.llm import alignment, blocks, bpe, common

BYTE, PIECE = bpe.tokenizer_path("byte_bpe_50k.json"), bpe.tokenizer_path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "\n", " \n x", "a  b", " lead", "trail ", "trail \t\n", "a\tb\r\nc\rd", "x\r y", "it's they'll  've", "<|endoftext|> x<|endoftext|>", "<s> a</s> <unk> <0x41>", "日本語 テスト　全角", "x▁y ok", "a\0b \0", "é ́x", "😀 ok nbsp   x", "A" * 3000, "word " * 3000, "\n\n".join(["line of words"] * 400), "x\x1cy \x85 z  w", "  indented\n    code {\r\n};\r\n\t\ttab", "1234567 89 10.5%"]
DOCS = "doc_id long, text string, unit string, times long, block int"


def texts(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in rows], DOCS)


def plain_tokens(texts):
    """The tokens of whole texts as (id, bytes), of A and of B."""
    tok = Tokenizer.from_file(BYTE)
    tok.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    byte, names = bpe._byte_of(), {i: p for p, i in tok.get_vocab().items()}
    out = []
    for t in texts:
        a = [(i, bytes(byte[c] for c in names[i])) for i in tok.encode(" " + t, add_special_tokens=False).ids] if t else []
        b = [(i, bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()) for i in model.encode(t) for p in [model.id_to_piece(i)]] if t else []
        whole = (" " + t).encode() if t else b""
        out.append((a, b) if t and b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], []))
    return out


def spans(tokens):
    at = 0
    for i, b in tokens:
        yield i, at, at + len(b)
        at += len(b)


def plain(rows):
    docs, count = [], Counter()
    for (key, _), (a, b) in zip(rows, plain_tokens([t for _, t in rows]), strict=True):
        a, b = list(spans(a)), list(spans(b))
        links, j = [], 0
        for i, lo, hi in a:
            while j and b[j - 1][2] > lo:
                j -= 1
            while j < len(b) and b[j][1] < hi:
                if b[j][2] > lo:
                    links.append((i, b[j][0]))
                j += 1
        ends = sorted({x[2] for x in a} & {x[2] for x in b})
        groups = []
        for lo, hi in zip([0, *ends], ends, strict=False):
            groups.append("|".join(",".join(str(i) for i, _, e in side if lo < e <= hi) for side in (a, b)))
        count.update(links)
        docs.append((key, len(a), len(b), groups, links))
    best = {}
    for (_, b), n in count.items():
        best[b] = max(n, best.get(b, 0))
    return [(k, a, b, len(g), len(x), sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for k, a, b, g, x in docs]


@pytest.mark.parametrize("most", [1_000_000, 40])
def test_alignment_equals_whole_texts(spark, most):
    rnd = random.Random(1)
    alphabet = ["the ", "Zauber", "naïve\n", " ", "  ", "\t", "\r\n", "x_1", "::", "ß", "中", "'s", " ", "), ", "</s>", "\n    return x"]
    rows = [*enumerate(ODD), (900, None), (None, None), (None, "null id"), (5, "a  b"), (5, "a  b")]
    rows += [(1000 + i, "".join(rnd.choices(alphabet, k=rnd.randint(1, 60)))) for i in range(150)]
    got = alignment.align_documents(texts(spark, rows).repartition(3), BYTE, PIECE, most=most).collect()
    assert got[0].__fields__ == [f.split()[0] for f in alignment.SCHEMA.split(", ")]
    assert sorted(map(tuple, got), key=str) == sorted(plain(rows), key=str)
    assert alignment.align_documents(texts(spark, []).where("false"), BYTE, PIECE).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab ,.\n\t\r\v 　▁é日{};'s1", max_size=60), st.sampled_from([1, 3, 7, 1 << 20]))
def test_segments_of_any_window_are_those_of_the_text(text, window):
    white, odd = alignment.cutting(BYTE, PIECE)
    assert set(white) == {" ", "\n", "\t"} and odd == "▁"
    found = [s for part in alignment.segmenter(white, odd, window)(text) for s in part]
    assert found == [s for part in alignment.segmenter(white, odd)(text) for s in part]
    assert "".join(found) == ("" if not text or odd in text else " " + text)
    assert all(s[0] in white for s in found)


@pytest.mark.parametrize("parts", [1, 50])
def test_every_segment_is_aligned_once(spark, parts):
    docs = texts(spark, [(i, f"common words {i % 7} and\nmore {i}") for i in range(200)]).repartition(parts)
    with common.scratch(spark):
        made = blocks.cut_blocks(docs, alignment.segmenter(*alignment.cutting(BYTE, PIECE)), 30)
        assert made.select("block").distinct().count() > 3
        distinct = blocks.units(made).groupBy("unit").agg(F.sum("times").alias("times"))
        rows = alignment.aligned_segments(distinct, BYTE, PIECE).collect()
        assert len(rows) == len({r.unit for r in rows}) and sum(r.times for r in rows) == 200 * 6
        assert {r.unit for r in rows} >= {" common", " words", "\nmore", " and", " 199"}


def test_packed_numbers_come_back():
    import numpy as np

    for x in ([], [0], [1 << 32 - 1, 0, 300], list(range(70_000))):
        assert blocks.unpack(blocks.pack(np.array(x, np.uint32)), len(x)).tolist() == x
