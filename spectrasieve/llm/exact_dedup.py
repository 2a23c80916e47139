"""Exact deduplication by content-defined chunk recipes."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrasieve.llm import common, hashing

WINDOW = 16  # bytes that decide whether a chunk ends


def chunk_ends(buf: np.ndarray, edges: np.ndarray, mean: int, least: int, most: int) -> list[np.ndarray]:
    """Ends of the chunks of each row of ``buf``, which is cut at ``edges``.

    A chunk ends where a rolling hash of the last WINDOW bytes has its low bits clear, at
    least ``least`` and at most ``most`` bytes after it began, and at the row's end. Ends
    depend on content alone, so equal texts have equal chunks.
    """
    h, span = hashing.byte_values()[buf], 1
    while span < WINDOW:  # doubling: hash of 2 s bytes from two hashes of s bytes
        h = h.copy()
        h[span:] += h[:-span] * np.uint64(pow(hashing.BASE, span, 1 << 64))
        span *= 2
    marks = np.flatnonzero((h >> np.uint64(40)) % np.uint64(mean) == 0) + 1
    out = []
    at = np.searchsorted(marks, edges, "right")
    for r in range(len(edges) - 1):
        begin, end = int(edges[r]), int(edges[r + 1])
        ends, last = [], begin
        for m in marks[at[r] : at[r + 1]].tolist():
            # A window that reaches before the row would depend on the row before it.
            if m - begin < WINDOW or m - last < least or m >= end:
                continue
            while m - last > most + least:
                last += most
                ends.append(last)
            ends.append(m)
            last = m
        while end - last > most + least:
            last += most
            ends.append(last)
        if end > last:
            ends.append(end)
        out.append(np.array(ends, np.int64) - begin)
    return out


def recipes(docs: DataFrame, mean: int = 2048, least: int = 512, most: int = 16384) -> DataFrame:
    """(doc_id, chunks, strong, text_sha256) of (doc_id, text).

    ``chunks`` is the ordered list of the chunks' identifiers, a 64-bit hash and the length one after the
    other; ``strong`` holds 128 bits of each chunk's SHA-256, by which identifiers are verified.
    """

    def task(batches):
        import pyarrow as pa
        import xxhash

        longs = pa.list_(pa.int64())
        for b in batches:
            for at, part in hashing.slices(b.column(1)):
                buf, edges = hashing.raw(part)
                view = memoryview(buf)
                cols = [b.column(0).slice(at, len(part)).to_pylist(), [], [], []]
                for begin, end, ends in zip(edges[:-1].tolist(), edges[1:].tolist(), chunk_ends(buf, edges, mean, least, most), strict=True):
                    chunks, strong, last = [], bytearray(), begin
                    for e in (ends + begin).tolist():
                        chunks += (xxhash.xxh3_64_intdigest(view[last:e]) - (1 << 63), e - last)
                        strong += hashlib.sha256(view[last:e]).digest()[:16]
                        last = e
                    cols[1].append(chunks)
                    cols[2].append(np.frombuffer(bytes(strong), "<i8"))
                    cols[3].append(hashlib.sha256(view[begin:end]).hexdigest())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), longs, longs, pa.string()), strict=True)], ["doc_id", "chunks", "strong", "text_sha256"])

    return common.by_batch(docs, task, "doc_id long, chunks array<long>, strong array<long>, text_sha256 string")


def unverified(made: DataFrame) -> DataFrame:
    """Chunk identifiers that stand for more than one content, over all chunks of all texts.

    Chunks are deduplicated before the shuffle by partial aggregation, so a chunk that a
    third of all texts hold crosses the network once a task.
    """
    each = F.transform(F.sequence(F.lit(0), F.expr("size(chunks) div 2 - 1")), lambda i: F.struct(*[F.element_at(c, (i * 2 + k).cast("int")).alias(n) for n, c, k in (("hash", F.col("chunks"), 1), ("length", F.col("chunks"), 2), ("high", F.col("strong"), 1), ("low", F.col("strong"), 2))]))
    chunks = made.where("size(chunks) > 0").select(F.inline(each))
    seen = chunks.groupBy("hash", "length").agg(*[f(c).alias(f"{n}_{c}") for c in ("high", "low") for n, f in (("least", F.min), ("most", F.max))])
    return seen.where("least_high <> most_high or least_low <> most_low").select("hash", "length")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mean: int = 2048, least: int = 512, most: int = 16384) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty. Each text is cut into
    content-defined chunks and becomes the ordered list of its chunks' identifiers. All chunks are
    deduplicated and their identifiers verified by SHA-256; should one stand for two
    contents, the verified digests take the identifiers' place. Then whole lists are compared.
    Texts never move: only identifiers are shuffled.

    Of equal texts the largest doc_id stays; rows that repeat its id and text stay with it. A null id
    stays only where its group has no other id. An empty table gives no rows; other columns are
    ignored. Groups are aggregated before the shuffle; in the join back AQE splits a hot group.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = common.cut(recipes(d, mean, least, most))
    if not unverified(made).isEmpty():
        made = made.withColumn("chunks", F.col("strong"))
    made = made.drop("strong")
    groups = made.groupBy("chunks").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    repeated = common.cut(groups.where("group_size > 1"))
    got = made.join(repeated.hint("merge"), "chunks", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    got = got.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), "text_sha256")
    return got.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, with the columns it came with: that of the largest id, any one of rows that repeat it or that all lack an id."""
    key = F.col(id_col).cast("long")
    sha = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256)
    with common.scratch(docs.sparkSession):
        found = common.cut(deduplicate(docs, id_col, text_col).select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"), "kept"))
        gone = common.keep(common.cut(found.where("not kept").select("__id", "__sha").distinct()))
        again = common.keep(common.cut(found.where("kept").groupBy("__id", "__sha").agg(F.count("*").alias("c")).where("c > 1").drop("c")))
        repeats = not again.isEmpty()
    same = key.eqNullSafe(F.col("__id")) & (sha == F.col("__sha"))
    left = docs.join(common.sized(gone), same, "left_anti")
    if not repeats:
        return left
    one = left.join(common.sized(again), same, "inner").dropDuplicates(["__id", "__sha"]).select(*[F.col(f"`{c}`") for c in docs.columns])
    return left.join(common.sized(again), same, "left_anti").unionByName(one)
