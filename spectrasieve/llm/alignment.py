"""Alignment of two tokenizers' tokens over distinct segments, composed to documents."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrasieve.llm import blocks, bpe, common

SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_MARK = "▁"  # how pieces write a space
_SEGMENTS = "unit string, times long, id long, n_a long, groups binary, pairs array<long>"


def _pieces(path: str):
    """The piece model of a file and the text of each of its ids, as bytes."""
    held = common.held(f"pieces {path}")
    if not held:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.vocab_size())]
        held["made"] = model, [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(names)]
    return held["made"]


@lru_cache(4)
def cutting(byte_path: str, piece_path: str) -> tuple[str, str]:
    """(white, odd): the characters before which texts may be cut, and those that pieces do not give back.

    A byte-level tokenizer with its usual pattern never joins white space to what is before it. Of pieces, none may hold a space
    behind another character (then a space may be cut at), or the character at all (for other white space);
    both are read off the vocabularies. Every code point is tried alone for ``odd``.
    """
    import json

    made = json.loads(bpe.load(byte_path).to_str())
    level = made["pre_tokenizer"] or {}
    usual = level.get("type") == "ByteLevel" and level.get("use_regex") and not level.get("add_prefix_space") and not made["normalizer"]
    model, text = _pieces(piece_path)
    own = [t.decode("utf-8", "ignore") for i, t in enumerate(text) if not model.is_byte(i) and not model.is_control(i) and not model.is_unknown(i)]
    white = [c for c in "\n\t\r\f\v" if not any(c in t for t in own)] if usual else []
    if usual and not any(" " in t.lstrip(" ") for t in own):
        white.append(" ")
    chars = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    odd = [c for c, ids in zip(chars, model.encode(chars, num_threads=1), strict=True) if b"".join([text[i] for i in ids]) != b" " + c.encode()]
    return "".join(white), "".join(odd)


def segmenter(white: str, odd: str, window: int = 1 << 20):
    """A function from a text to lists of the segments of space + text, windows of a long text one after the other.

    Segments begin before runs of white space whose first character is of ``white``. A text that is empty or holds a character of ``odd`` has none.
    """
    no = rf"[^\S{re.escape(white)}]" if white else r"\s"
    find = re.compile(rf"\s*\S+(?:{no}\s*\S*)*|\s+")
    strange = re.compile(f"[{re.escape(odd)}]") if odd else None

    def split(text: str) -> Iterator[list[str]]:
        if not text or strange and strange.search(text):
            return
        text = " " + text
        if len(text) <= window:
            yield find.findall(text)
            return
        at, size = 0, window
        while at + size < len(text):
            found = find.findall(text, at, at + size)[:-1]  # the last may go on
            if found:
                yield found
                at += sum(map(len, found))
                size = window
            else:
                size *= 2
        yield find.findall(text, at)

    return split


def align(a: list[int], b: list[int], ends_a: list[int], ends_b: list[int]) -> tuple[str, list[tuple[int, int]]]:
    """Groups of tokens between the places where both end, as text, and the pairs whose bytes overlap."""
    i = j = 0
    first_a = first_b = 0
    groups, pairs = [], []
    while i < len(a):
        pairs.append((a[i], b[j]))
        x, y = ends_a[i], ends_b[j]
        i += x <= y
        j += y <= x
        if x == y:
            groups.append(f"{','.join(map(str, a[first_a:i]))}|{','.join(map(str, b[first_b:j]))}")
            first_a, first_b = i, j
    return ";".join(groups), pairs


def aligned_segments(segments: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """(unit, times) with an id, each segment's tokens of A counted, its groups as text and its links as a * 2^32 + b."""

    def task(batches):
        import pyarrow as pa
        from tokenizers import Tokenizer

        held = common.held(f"alignment {byte_path} {piece_path}")
        if not held:
            tok = Tokenizer.from_file(byte_path)
            tok.no_truncation()
            tok.no_padding()
            tok.encode_special_tokens = True
            import sentencepiece

            held["made"] = tok, sentencepiece.SentencePieceProcessor(model_file=piece_path)
            byte = bpe._byte_of()
            size = [0] * tok.get_vocab_size()
            for piece, i in tok.get_vocab().items():
                size[i] = len(piece) if all(c in byte for c in piece) else len(piece.encode())
            model = held["made"][1]
            held["sizes"] = size, [1 if model.is_byte(i) else len(model.id_to_piece(i).replace(_MARK, " ").encode()) for i in range(model.vocab_size())]
        tok, model = held["made"]
        size_a, size_b = (s.__getitem__ for s in held["sizes"])
        space, number = model.piece_to_id(_MARK), TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                names = part.column("unit").to_pylist()
                a = [e.ids for e in tok.encode_batch_fast(names, add_special_tokens=False)]
                # A model adds a space in front; a segment that begins with one hands its own in.
                b = model.encode([s[1:] if s[0] == " " else s for s in names], num_threads=1)
                b = [([space] if s == " " else ids) if s[0] == " " else ids[1:] for s, ids in zip(names, b, strict=True)]
                cols = [[] for _ in range(4)]
                for name, x, y in zip(names, a, b, strict=True):
                    ends_x, ends_y = list(accumulate(map(size_a, x))), list(accumulate(map(size_b, y)))
                    if not x or not y or not ends_x[-1] == ends_y[-1] == len(name.encode()):
                        raise ValueError(f"tokens do not give {name[:100]!r} back")
                    text, pairs = align(x, y, ends_x, ends_y)
                    for c, v in zip(cols, (number, len(x), text.encode(), [p << 32 | q for p, q in pairs]), strict=True):
                        c.append(v)
                    number += 1
                types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column("unit"), part.column("times"), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], [f.split()[0] for f in _SEGMENTS.split(", ")])

    return common.by_batch(segments, task, _SEGMENTS, f"alignment {byte_path} {piece_path}")


def _weighed(segments: DataFrame) -> DataFrame:
    """(id, n_best, count_sum): of each segment's links those whose pair no other of the same b exceeds, and the sum of the counts.

    Links of segments are composed in the same way as segments of documents: a block's distinct pairs are counted, joined with
    the counts over all blocks and looked up by position.
    """
    made = blocks.cut_blocks(segments.select(F.col("id").alias("doc_id"), F.col("pairs").alias("text"), F.col("times").alias("weight")), lambda pairs: [list(map(str, pairs))])
    counts = common.cut(blocks.units(made).groupBy("unit").agg(F.sum("times").alias("c")))
    b = F.col("unit").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    top = counts.groupBy(b.alias("b")).agg(F.max("c").alias("most"))  # a row for each id of b's vocabulary at most
    counts = counts.join(F.broadcast(top), b == F.col("b")).select("unit", "c", (F.col("c") == F.col("most")).cast("long").alias("is_best"))
    return blocks.compose(made, counts, lambda t: np.stack([t.column(c).to_numpy() for c in ("is_best", "c")], 1), lambda ready, key, codes: (key, *ready[codes].sum(0).tolist()), "id long, n_best long, count_sum long")


_TAIL, _TAIL_BYTES = "<IIq", 16  # n_a, n_best, count_sum behind a segment's groups


def _payload(segments: DataFrame) -> DataFrame:
    """(unit, payload) of segments with their weights: what documents are composed of, as bytes."""

    def task(batches):
        import pyarrow as pa

        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("groups", "n_a", "n_best", "count_sum")), strict=True)
            yield pa.RecordBatch.from_arrays([b.column("unit"), pa.array([g + struct.pack(_TAIL, *numbers) for g, *numbers in rows], pa.binary())], ["unit", "payload"])

    return common.by_batch(segments.select("unit", "groups", "n_a", "n_best", "count_sum"), task, "unit string, payload binary")


def _prepare(table):
    """The numbers of a block's segments (n_a, n_b, n_groups, n_links, n_best, count_sum) and their groups."""
    begin, size, values = blocks.spread(table.column("entries"), False)
    data, end = values.tobytes(), begin + size - _TAIL_BYTES
    n_a, n_best, count_sum = _tails(values, end)
    bars, commas = (np.searchsorted(places, end) - np.searchsorted(places, begin) for c in b"|," for places in [np.flatnonzero(values == c)])
    n_groups, tokens = bars, commas + 2 * bars
    return np.stack([n_a, tokens - n_a, n_groups, tokens - n_groups, n_best, count_sum], 1), [data[i:j] for i, j in zip(begin.tolist(), end.tolist(), strict=True)]


def _tails(values: np.ndarray, end: np.ndarray):
    """The numbers behind each segment's groups."""
    tails = np.empty((len(end), _TAIL_BYTES), np.uint8)
    for k in range(_TAIL_BYTES):
        tails[:, k] = values[end + k]
    tails = tails.view([("n_a", "<u4"), ("n_best", "<u4"), ("count_sum", "<i8")])[:, 0]
    return (tails[c].astype(np.int64) for c in ("n_a", "n_best", "count_sum"))


def _document(ready, doc_id, codes: np.ndarray):
    numbers, groups = ready
    text = b";".join(map(groups.__getitem__, codes.tolist()))
    return doc_id, *numbers[codes].sum(0).tolist(), hashlib.sha256(text).hexdigest() if len(codes) else ""


def align_documents(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", most: int = 1_000_000) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is the byte-level tokenizer over space + text, B the piece model over the text; neither adds special tokens, and strings
    of special tokens are plain text. Places where tokens of both end cut a document into groups; tokens whose byte ranges
    overlap are linked. A pair of ids counts the links of all documents that hold it. n_best is the number of a document's links
    whose count is the highest of their B id, count_sum the sum of its links' counts; groups_sha256 digests the groups as "a1,a2|b1;a3|b2,b3".

    Texts are cut before runs of white space where neither vocabulary can join what stands on both sides, see :func:`cutting`; a
    distinct segment is tokenised and aligned once, and its row joins back to the blocks of documents that hold
    it (``most`` distinct segments or little more a block). Whole texts are composed of their segments.

    Texts that are null or empty, or hold a character that pieces do not give back (U+2581, which stands for a space), have no tokens: zeros and
    an empty digest. Null ids stay null; repeated rows give repeated results and count again; other columns are ignored; an empty table gives no rows.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with common.scratch(docs.sparkSession):
        made = common.keep(blocks.cut_blocks(d, segmenter(*cutting(byte_path, piece_path)), most))
        distinct = blocks.units(made).groupBy("unit").agg(F.sum("times").alias("times"))
        segments = common.cut(aligned_segments(distinct, byte_path, piece_path), "zstd")
        table = common.keep(common.cut(_payload(segments.join(_weighed(segments), "id")), "zstd"))
    found = blocks.packed(blocks.units(made).join(table, "unit").select("block", "at", "payload"), "payload")
    return blocks.assemble(made, found, _prepare, _document, SCHEMA)
