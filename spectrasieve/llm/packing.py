"""Sum-of-squares online packing of documents into fixed windows."""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
from pyspark.sql import DataFrame

from spectrasieve.llm import bpe, common

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Packs one partition's documents.

    Whole windows of a document become sequences of their own. What remains goes, online,
    to the fill level h for which the sum over levels of N(h)^2 is least, N(h) being the
    number of partly filled windows at level h in the level array. When the input ends, the
    windows still open are topped up from the emptiest ones, and the last is cut into
    sequences whose lengths are powers of two, so nothing needs padding.
    """

    def __init__(self, window: int, first_sequence: int):
        self.window, self.next = window, first_sequence
        self.count = np.zeros(window + 1, np.int64)  # N(h)
        self.open: list[list] = [[] for _ in range(window)]  # windows at level h
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        w, n = self.window, len(ids)
        whole = n - n % w
        for at in range(0, whole, w):
            self._emit([(doc_id, at, ids[at : at + w], n)])
        r = n - whole
        if not r:
            return
        piece = (doc_id, whole, ids[whole:], n)
        # Taking a window from level h to h + r adds 2 N(h + r) - 2 N(h) + 2 to the sum of
        # squares; opening one adds 2 N(r) + 1, closing one adds 1 - 2 N(h).
        gain = 2 * self.count[r : w + 1] - 2 * self.count[: w - r + 1] + 2
        gain[0] = 2 * self.count[r] + 1
        gain[w - r] = 1 - 2 * self.count[w - r]
        gain[1:][self.count[1 : w - r + 1] == 0] = np.iinfo(np.int64).max
        h = int(gain.argmin())
        pieces = self.open[h].pop() if h else []
        if h:
            self.count[h] -= 1
        pieces.append(piece)
        if h + r == w:
            self._emit(pieces)
        else:
            self.open[h + r].append(pieces)
            self.count[h + r] += 1

    def _emit(self, pieces) -> None:
        at = 0
        for doc_id, start, ids, n in pieces:
            crc = zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
            self.rows.append((doc_id, start, len(ids), crc, n, self.next, at))
            at += len(ids)
        self.next += 1

    def _take(self, pieces: deque, n: int) -> list:
        """The first n ids' worth of pieces, cutting the last of them."""
        out = []
        while n:
            doc_id, start, ids, total = pieces.popleft()
            if len(ids) > n:
                pieces.appendleft((doc_id, start + n, ids[n:], total))
                ids = ids[:n]
            out.append((doc_id, start, ids, total))
            n -= len(ids)
        return out

    def finish(self) -> None:
        left = [(h, deque(p)) for h in range(self.window - 1, 0, -1) for p in self.open[h]]
        left = deque(left)
        while left:
            h, pieces = left.popleft()
            while left and h < self.window:
                g, last = left.pop()
                n = min(self.window - h, g)
                pieces += self._take(last, n)
                h += n
                if last:
                    left.append((g - n, last))
            if h == self.window:
                self._emit(pieces)
            else:
                for bit in reversed(range(h.bit_length())):
                    if h >> bit & 1:
                        self._emit(self._take(pieces, 1 << bit))


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, eos: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents, packed per partition without any shuffle.

    Each document is encoded whole and followed by ``eos``. A null text counts as empty
    (one token, ``eos``); a null id stays null; rows with equal ids are documents of their
    own; other columns are ignored; an empty table gives no rows. sequence_id holds the
    partition in its upper bits, so that partitions never share a sequence and a task that
    is run again gives the same rows. Memory: an Arrow batch, the chunk table and the open
    windows, whose number sum-of-squares packing keeps small.
    """
    if window < 1 or eos < 0:
        raise ValueError("window must be positive and eos not negative")

    def task(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        packer = Packer(window, TaskContext.get().partitionId() << 40)
        encoder = bpe.byte_encoder(tokenizer)
        types = [pa.int64()] * 7
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def flush():
            cols = list(zip(*packer.rows, strict=True)) or [[]] * 7
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        for b in batches:
            ids_of = b.column(0).to_pylist()
            for at in range(0, len(ids_of), 1000):
                texts = [t or "" for t in b.column(1).slice(at, 1000).to_pylist()]
                for doc_id, ids in zip(ids_of[at : at + 1000], encoder.encode(texts), strict=True):
                    packer.add(doc_id, np.append(ids, np.uint32(eos)))
                yield flush()
        packer.finish()
        yield flush()

    return common.by_batch(docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text"), task, SCHEMA, bpe.owner(tokenizer))
