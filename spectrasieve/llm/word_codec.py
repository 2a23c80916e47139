"""Encoding and decoding through distinct words."""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrasieve.llm import blocks, bpe, common, hashing

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded string"
# White space that every tokenizer here drops and never looks across. Other white space
# stays inside a word, where the tokenizer itself treats it.
_SPACES = str.maketrans("\t\n\r\f\v", "     ")
_SPACE = hashing.spaces(b" \t\n\r\f\v")


def _words(text: str) -> list[str]:
    return [w for w in text.translate(_SPACES).split(" ") if w]


def _parcels(units: DataFrame, parts: int, rows: int = 100_000) -> DataFrame:
    """(part, n, words, at, block) of blocks.units: a task's words of a part of the hash space together, compressed; words hold no newline."""

    def task(batches):
        import pyarrow as pa

        held, size = [], 0

        def out():
            t = pa.Table.from_batches(held).combine_chunks()
            words = t.column("unit").combine_chunks()
            part = (hashing.word_hashes(*hashing.raw(words), _SPACE)[0] % np.uint64(parts)).astype(np.int64)
            block, at = t.column("block").to_numpy(), t.column("at").to_numpy()
            order = np.lexsort((at, block, part))
            part, names = part[order], words.take(pa.array(order)).to_pylist()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]).tolist()
            pairs = list(itertools.pairwise(cuts))
            block, at = block[order], at[order]
            columns = [part[cuts[:-1]], [j - i for i, j in pairs], [blocks.squeeze("\n".join(names[i:j]).encode()) for i, j in pairs], [blocks.pack(at[i:j]) for i, j in pairs], [blocks.squeeze(block[i:j].tobytes()) for i, j in pairs]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), *[pa.binary()] * 3), strict=True)], ["part", "n", "words", "at", "block"])

        for b in batches:
            held.append(b)
            size += len(b)
            if size >= rows:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return common.by_batch(units.select("unit", "block", "at"), task, "part long, n long, words binary, at binary, block binary")


def encoded_words(units: DataFrame, tokenizer: str, counter=None, per_part: int = 500_000) -> DataFrame:
    """(block, at, entries) of blocks.units: every distinct word encoded once, its ids packed for the blocks that hold it.

    All rows of a word meet in one part of the hash space, of about ``per_part`` rows, where distinct words are encoded and their ids go to all rows; a block holds
    a word once, so no word has many. ``counter`` (an accumulator) counts encoded words. A row of the result holds the words of a block that a part has, see blocks.entries.
    """

    def task(table):
        import pyarrow as pa

        rows = table.to_pylist()
        words = pa.array([w for r in rows for w in blocks.unsqueeze(r["words"]).decode().split("\n")], pa.string()).dictionary_encode()
        at = np.concatenate([blocks.unpack(r["at"], r["n"]) for r in rows])
        block = np.concatenate([np.frombuffer(blocks.unsqueeze(r["block"]), np.int64) for r in rows])
        tok, made = bpe.load(tokenizer), []
        distinct = words.dictionary.to_pylist()
        for k in range(0, len(distinct), 5000):
            made += [np.array(e.ids, np.uint32) for e in tok.encode_batch_fast(distinct[k : k + 5000], add_special_tokens=False)]
        if counter is not None:
            counter.add(len(made))
        place = words.indices.to_numpy()
        n = np.fromiter(map(len, made), np.int64, len(made))
        flat, begin = np.concatenate(made), (np.cumsum(n) - n)[place]
        n = n[place]
        got = blocks.entries(block, at.astype(np.int64), n, flat[np.arange(n.sum()) + np.repeat(begin - np.cumsum(n) + n, n)])
        common.trim()
        return pa.Table.from_batches([got])

    parts = max(1, -(-units.count() // per_part))
    return _parcels(units, parts).groupBy("part").applyInArrow(task, "block long, at long, entries binary")


class _Pieces:
    """Decoding as flat text: without a decoder the tokenizer joins pieces with one space."""

    def __init__(self, piece: dict[int, str]):
        text = [(piece.get(i, "") + " ").encode() for i in range(max(piece, default=0) + 1)]
        self.size = np.array([len(t) for t in text], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.text = np.frombuffer(b"".join(text), np.uint8)

    def row(self, ids: np.ndarray, full: bool) -> tuple:
        """What SCHEMA holds for a document's ids."""
        n = self.size[ids]
        ends = np.cumsum(n)
        decoded = self.text[np.arange(ends[-1] if len(ids) else 0) + np.repeat(self.start[ids] - ends + n, n)].tobytes()[:-1]
        digests = (hashlib.sha256(x).hexdigest() for x in (ids.astype("<u4").tobytes(), decoded))
        return len(ids), *digests, ids.astype(np.int32) if full else None, decoded.decode() if full else None


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", full: bool = True, most: int = 1_000_000, counter=None) -> DataFrame:
    """Ids of every whole text and their decoding, through distinct words.

    Texts are split into words in blocks of documents (``most`` distinct words or little more each), where documents become sequences of the numbers of their words. Every
    distinct word of all blocks is encoded once; its ids return to the blocks that hold it, by the number it has there, and documents
    gather the ids by position. Ids are decoded by a look-up in the id-to-piece table, which is as small as the vocabulary. Neither texts nor anything
    that grows reaches the driver; see :mod:`spectrasieve.llm.blocks`.

    A null or empty text has no ids and decodes to an empty text; a null id stays null;
    repeated rows give repeated results; other columns are ignored; an empty table gives
    no rows. ``full=False`` leaves the columns ids and decoded null and keeps the digests.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with common.scratch(docs.sparkSession):
        made = common.keep(blocks.cut_blocks(d, lambda t: [_words(t)], most))
    owner = f"pieces of {tokenizer}"

    def each(ready, doc_id, codes):
        held = common.held(owner)
        if not held:
            from tokenizers import Tokenizer

            held["pieces"] = _Pieces({i: p for p, i in Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).items()})
        begin, count, ids = ready
        n = count[codes]
        ends = np.cumsum(n)
        own = ids[np.arange(ends[-1] if len(n) else 0) + np.repeat(begin[codes] - ends + n, n)]
        return doc_id, *held["pieces"].row(own, full)

    return blocks.assemble(made, encoded_words(blocks.units(made), tokenizer, counter), lambda table: blocks.spread(table.column("entries"), True), each, SCHEMA, owner)
