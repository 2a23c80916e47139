"""Texts as sequences of distinct units, so that each distinct unit is worked on once.

A scan deals texts into blocks, as they come, and numbers the distinct units of each block; a document becomes the
packed sequence of its units' numbers. The distinct units of all blocks form a table, made once; its rows are
joined back to the blocks that hold them, and there documents are composed by position. Within
a block a unit stands once, so no frequent unit is a hot key, and texts never move.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from spectrasieve.llm import common

_FIELDS = ["block", "doc_id", "n", "codes", "at", "unit", "times"]
_SCHEMA = "block long, doc_id long, n long, codes binary, at long, unit string, times long"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
_ROWS = 50_000  # units of a batch that a task hands on
_FEW = 16  # numbers that are not worth compression


def pack(codes: np.ndarray) -> bytes:
    """Numbers below 2^32, many of them compressed: their first bytes, then their second ones and so on."""
    codes = codes.astype("<u4")
    if len(codes) < _FEW:
        return codes.tobytes()
    planes = np.ascontiguousarray(codes.view(np.uint8).reshape(-1, 4).T)
    return pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def unpack(data: bytes, n: int) -> np.ndarray:
    if n < _FEW:
        return np.frombuffer(data, "<u4")
    planes = np.frombuffer(pa.Codec("zstd").decompress(data, 4 * n, asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def squeeze(data: bytes) -> bytes:
    """Bytes compressed, behind their length."""
    return len(data).to_bytes(4, "little") + pa.Codec("zstd", 1).compress(data, asbytes=True)


def unsqueeze(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[4:], int.from_bytes(data[:4], "little"), asbytes=True)


def _squeezed(values: np.ndarray) -> bytes:
    """Bytes as they are or, many of them, compressed; numbers by :func:`pack`."""
    if values.dtype != np.uint8:
        return pack(values)
    return values.tobytes() if len(values) < 4 * _FEW else pa.Codec("zstd", 1).compress(values.tobytes(), asbytes=True)


def _spread(data: bytes, n: int, numbers: bool) -> np.ndarray:
    if numbers:
        return unpack(data, n)
    return np.frombuffer(data if n < 4 * _FEW else pa.Codec("zstd").decompress(data, n, asbytes=True), np.uint8)


def _reordered(order: np.ndarray, n: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of ``n`` values each in another order."""
    ends = np.cumsum(n)
    new = n[order]
    return new, values[np.arange(len(values)) + np.repeat((ends - n)[order] - (np.cumsum(new) - new), new)]


def entries(block: np.ndarray, at: np.ndarray, n: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """(block, at, entries): a row a block for stretches of ``n`` values (bytes or 32-bit numbers) each, of the units ``at`` of blocks."""
    order = np.lexsort((at, block))
    n, values = _reordered(order, n, values)
    block, at = block[order], at[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]]) if len(block) else np.zeros(1, np.int64)
    to = np.concatenate([[0], np.cumsum(n)])[cuts]
    blobs = []
    for i, j, k, m in zip(cuts, cuts[1:], to, to[1:], strict=False):
        parts = [pack(np.diff(at[i:j], prepend=0)), pack(n[i:j]), _squeezed(values[k:m])]
        blobs.append(np.array([j - i, m - k, *map(len, parts)], "<u4").tobytes() + b"".join(parts))
    return pa.RecordBatch.from_arrays([pa.array(block[cuts[:-1]], pa.int64()), pa.array(at[cuts[:-1]], pa.int64()), pa.array(blobs, pa.binary())], ["block", "at", "entries"])


def spread(column, numbers: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each unit's values begin, by its number, how many they are, and all values, of a block's column of entries."""
    found = []
    for data in column.to_pylist():
        count, many, *sizes = np.frombuffer(data, "<u4", 5).tolist()
        edges = np.cumsum([20, *sizes]).tolist()
        parts = [data[i:j] for i, j in itertools.pairwise(edges)]
        found.append((np.cumsum(unpack(parts[0], count), dtype=np.int64), unpack(parts[1], count).astype(np.int64), _spread(parts[2], many, numbers)))
    at, n, values = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    begin, size = np.zeros((2, int(at.max(initial=-1)) + 1), np.int64)
    begin[at], size[at] = np.cumsum(n) - n, n
    return begin, size, values


def packed(found: DataFrame, column: str, rows: int = 100_000) -> DataFrame:
    """(block, at, entries) of (block, at, a binary column): a task's rows of a block together, ``rows`` rows at a time."""

    def task(batches):
        held, size = [], 0

        def out():
            data = pa.Table.from_batches(held).combine_chunks()
            bytes_ = data.column(column).combine_chunks().cast(pa.large_binary())
            bytes_ = bytes_.chunk(0) if isinstance(bytes_, pa.ChunkedArray) else bytes_
            edges = np.frombuffer(bytes_.buffers()[1], np.int64)[bytes_.offset : bytes_.offset + len(bytes_) + 1]
            values = np.frombuffer(bytes_.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
            return entries(data.column("block").to_numpy(), data.column("at").to_numpy(), np.diff(edges), values)

        for b in batches:
            held.append(b)
            size += len(b)
            if size >= rows:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return common.by_batch(found.select("block", "at", column), task, "block long, at long, entries binary")


def cut_blocks(docs: DataFrame, split: Callable[[str], Iterable[list[str]]], most: int = 1_000_000) -> DataFrame:
    """The blocks of (doc_id, text) or (doc_id, text, weight), written: rows of documents (unit null) and rows of units.

    ``split`` gives a text's units in lists, in order; a null text has none. An occurrence counts ``weight`` times (once without
    that column). A block ends with the stretch of documents (of a hundred thousand units, and a document) after which it holds ``most`` distinct units or more.
    """
    weighted = "weight" in docs.columns

    def task(batches):
        base, made = TaskContext.get().partitionId() << 32, 0
        index: defaultdict[str, int] = defaultdict(itertools.count().__next__)
        times = np.zeros(1 << 16, np.int64)

        def batch(**columns):
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([pa.array(columns[f], t) if f in columns else pa.nulls(n, t) for f, t in zip(_FIELDS, _TYPES, strict=True)], _FIELDS)

        def units():
            nonlocal index, made
            names = list(index)
            for at in range(0, len(names), _ROWS):
                part = names[at : at + _ROWS]
                yield batch(block=np.full(len(part), base + made), at=np.arange(at, at + len(part)), unit=part, times=times[at : at + len(part)])
            made += 1
            index = defaultdict(itertools.count().__next__)
            times[:] = 0

        def documents(ids, n, flat, weights):
            nonlocal times
            codes = np.fromiter(map(index.__getitem__, flat), np.uint32, len(flat))
            if len(index) > len(times):
                times = np.concatenate([times, np.zeros(len(index), np.int64)])
            own = np.bincount(codes, None if weights is None else np.repeat(weights, n).astype(float), len(index))
            times[: len(index)] += own.astype(np.int64)
            raw, ends = codes.tobytes(), np.cumsum(n).tolist()
            packed = [raw[4 * (e - k) : 4 * e] if k < _FEW else pack(codes[e - k : e]) for k, e in zip(n, ends, strict=True)]
            return batch(block=np.full(len(ids), base + made), doc_id=ids, n=n, codes=packed)

        for b in batches:
            ids, n, flat = [], [], []
            weights = b.column("weight").to_numpy() if weighted else None
            done = 0
            for key, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                before = len(flat)
                for found in split(text.as_py() or ""):
                    flat += found
                ids.append(key)
                n.append(len(flat) - before)
                if len(flat) >= min(most, 2 * _ROWS) or done + len(ids) == len(b):
                    yield documents(ids, n, flat, None if weights is None else weights[done : done + len(ids)])
                    done += len(ids)
                    ids, n, flat = [], [], []
                    if len(index) >= most:
                        yield from units()
        yield from units()

    return common.cut(common.by_batch(docs.select("doc_id", "text", *["weight"] * weighted), task, _SCHEMA), "zstd")


def units(blocks: DataFrame) -> DataFrame:
    """(block, at, unit, times): the distinct units of each block, their numbers and occurrences."""
    return blocks.where("unit is not null").select("block", "at", "unit", "times")


def compose(blocks: DataFrame, table: DataFrame, prepare: Callable, each: Callable, schema: str, owner: str = "") -> DataFrame:
    """One row of ``schema`` per document, composed of rows of ``table`` (unit and other columns; every unit once) by position."""
    columns = [c for c in table.columns if c != "unit"]
    return assemble(blocks, units(blocks).join(table, "unit").select("block", "at", *columns), prepare, each, schema, owner)


def assemble(blocks: DataFrame, found: DataFrame, prepare: Callable, each: Callable, schema: str, owner: str = "") -> DataFrame:
    """One row of ``schema`` per document, of what ``found`` (block, at and other columns) holds for its block.

    ``prepare(table)`` turns a block's rows of ``found``, an Arrow table in order of ``at``, into what
    ``each(prepared, doc_id, codes)`` takes to return a row. A task holds the rows of one block at a time.
    """
    columns, target = [c for c in found.columns if c not in ("block", "at")], to_arrow_schema(StructType.fromDDL(schema))
    kinds = dict(found.dtypes)
    found = found.select("block", "at", *columns, F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("binary").alias("codes"))
    docs = blocks.where("unit is null").select("block", F.lit(None).cast("long").alias("at"), *[F.lit(None).cast(kinds[c]).alias(c) for c in columns], "doc_id", "n", "codes")
    rows = found.unionByName(docs).repartition("block").sortWithinPartitions("block", F.col("at").asc_nulls_last())

    def pieces(batches) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
        """Stretches of rows of one block, either of units or of documents."""
        for b in batches:
            block, doc = b.column("block").to_numpy(), b.column("at").is_null().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((block[1:] != block[:-1]) | (doc[1:] != doc[:-1])) + 1
            for lo, hi in itertools.pairwise([0, *cuts.tolist(), len(block)] if len(block) else []):
                yield int(block[lo]), bool(doc[lo]), b.slice(lo, hi - lo)

    def task(batches):
        last, held, ready = None, [], None
        for block, is_doc, part in pieces(batches):
            if block != last:
                last, held, ready = block, [], None
            if not is_doc:
                held.append(part.select(columns))
                continue
            if ready is None:
                ready = prepare(pa.Table.from_batches(held, held[0].schema if held else part.select(columns).schema))
                held = []
            for at in range(0, len(part), 256):
                step = part.slice(at, 256)
                got = [each(ready, i, unpack(c, n)) for i, n, c in zip(*(step.column(c).to_pylist() for c in ("doc_id", "n", "codes")), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), target.types, strict=True)], schema=target)

    return common.by_batch(rows, task, schema, owner)
