"""Exact top-k search by integer inner product over norm-sorted blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectrasieve.llm import common

RESULT = "query_id long, vec_id long, score long"
_ROWS = "vec_id long, norm double, size int, v binary, query boolean"
_BLOCK = "block long, most double, n long, ids binary, sole binary, v binary"
_MOST = 2**63 - 1


def quantised(vectors: DataFrame, queries: Column, scale: float, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, norm, size, v, query): floor(scale * x) of each valid vector, packed as 32-bit integers or, where these do not suffice, as doubles."""

    def task(batches):
        import pyarrow as pa

        for b in batches:
            key, x, asks = b.column(0), b.column(1), b.column(2)
            size = np.diff(x.offsets.to_numpy()) if len(x) else np.zeros(0, np.int64)
            at = x.offsets.to_numpy()[:-1] - x.offsets[0].as_py() if len(x) else size
            flat = x.flatten() if x.null_count == 0 else None
            if flat is None or flat.null_count:  # lists with nulls: their values are made non-finite
                lists = [None if v is None or None in v else v for v in x.to_pylist()]
                size = np.array([len(v) if v is not None else 1 for v in lists], np.int64)
                at = np.cumsum(size) - size
                flat = np.array([c for v in lists for c in (v if v is not None else [np.nan])], np.float64)
            else:
                flat = flat.to_numpy(zero_copy_only=False).astype(np.float64)
            v = np.floor(scale * flat)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(v))])
            wide = np.concatenate([[0], np.cumsum(np.abs(v) >= 2**31)])
            ok = (bad[at + size] == bad[at]) & ~np.asarray(key.is_null())
            rows = np.flatnonzero(ok)
            blobs = [v[a : a + n].astype("<i4" if wide[a] == wide[a + n] else "<f8").tobytes() for a, n in zip(at[rows].tolist(), size[rows].tolist(), strict=True)]
            norm = [float(np.sqrt(v[a : a + n] @ v[a : a + n])) for a, n in zip(at[rows].tolist(), size[rows].tolist(), strict=True)]
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([key.take(take), pa.array(norm, pa.float64()), pa.array(size[rows].astype(np.int32)), pa.array(blobs, pa.binary()), asks.take(take)], ["vec_id", "norm", "size", "v", "query"])

    d = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("query"))
    return common.by_batch(d, task, _ROWS)


def _matrix(blobs: list[bytes], sizes: list[int], dim: int) -> np.ndarray:
    """Rows of packed vectors, as integers if all are; missing trailing components are 0."""
    small = all(len(b) == 4 * n for b, n in zip(blobs, sizes, strict=True))
    if small and all(n == dim for n in sizes):
        return np.frombuffer(b"".join(blobs), "<i4").reshape(len(blobs), dim)
    out = np.zeros((len(blobs), dim), "<i4" if small else "<f8")
    for row, b, n in zip(out, blobs, sizes, strict=True):
        row[:n] = np.frombuffer(b, "<i4" if len(b) == 4 * n else "<f8")
    return out


def _unpacked(blob: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(blob, "<i4" if len(blob) == 4 * n * dim else "<f8").reshape(n, dim)


def rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of all vectors, from the sum of their outer products, the strongest first.

    Each task sends one matrix of dim x dim; they are added in groups, and one matrix reaches the driver.
    """

    def task(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        total = np.zeros((dim, dim))
        for b in batches:
            m = _matrix(b.column("v").to_pylist(), b.column("size").to_pylist(), dim).astype(np.float64)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 16], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["slot", "m"])

    def add(table):
        import pyarrow as pa

        total = np.zeros(dim * dim)
        for x in table.column("m"):
            total += np.frombuffer(x.as_buffer(), np.float64)
        return pa.table({"slot": pa.array([0], pa.int64()), "m": pa.array([total.tobytes()], pa.binary())})

    got = common.by_batch(rows.select("v", "size"), task, "slot long, m binary")
    for _ in range(2):
        got = got.groupBy("slot").applyInArrow(add, "slot long, m binary")
    total = np.frombuffer(got.first().m, np.float64).reshape(dim, dim)
    return np.ascontiguousarray(np.linalg.eigh(total)[1][:, ::-1])


def blocks(rows: DataFrame, size: int, count: int, dim: int) -> DataFrame:
    """Rows in descending order of length, packed into blocks of at most ``size``. ``sole`` tells whose id no other row has."""

    def task(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 32, []

        def pack(part):
            nonlocal number
            number += 1
            ids, norm, n, v, sole = zip(*part, strict=True)
            cols = ([number], [norm[0]], [len(part)], [np.array(ids, "<i8").tobytes()], [np.array(sole, bool).tobytes()], [_matrix(v, n, dim).tobytes()])
            types = (pa.int64(), pa.float64(), pa.int64(), *[pa.binary()] * 3)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [c.split()[0] for c in _BLOCK.split(", ")])

        for b in batches:
            held += zip(*(b.column(c).to_pylist() for c in ("vec_id", "norm", "size", "v", "sole")), strict=True)
            while len(held) >= size:
                yield pack(held[:size])
                held = held[size:]
        if held:
            yield pack(held)

    order = [F.col("norm").desc(), F.col("vec_id")]
    dealt = rows.select("vec_id", "norm", "size", "v", "sole").repartitionByRange(max(1, -(-count // size)), *order).sortWithinPartitions(*order)
    return common.by_batch(dealt, task, _BLOCK)


def heads(dim: int) -> list[int]:
    """How many rotated components each partial sum takes: quarters of all."""
    return sorted({max(1, dim * i // 4) for i in (1, 2, 3)})


def search_block(q_ids, q, ids, sole, x, floor, rotate, k, step=128, counts=None):
    """The k best of a block for each query, pruned by Cauchy-Schwarz bounds.

    ``floor`` holds scores that k candidates of each query are known to reach. The rows of ``x`` come by
    descending length, in steps of ``step`` rows, so that early rows raise the floors for later ones. A step of rows is skipped for a query if the product of lengths lies below
    its floor; of the rest a pair goes as soon as its sum over the first quarter, half or three quarters of the rotated
    components and the product of the residual lengths do. What remains is scored by its whole vectors. Bounds are
    widened by more than rounding can move them and equal scores are never pruned, so the result is exact; sums
    of products are taken in doubles where these are exact, else as Python's integers, and clipped to 64 bits.
    Only rows that are ``sole`` count towards a query's k best; others of at least that score come besides.
    Returns (query, row, score, best scores); ``counts`` gathers the pairs at the start and after each bound.
    """
    qf, xf = q.astype(np.float64), x.astype(np.float64)
    cuts, floor = heads(q.shape[1]), floor.copy()
    qr, xr = qf @ rotate, xf @ rotate
    q_norm, x_norm = np.sqrt((qr**2).sum(1)), np.sqrt((xr**2).sum(1))
    q_rest, x_rest = ([np.sqrt((r[:, h:] ** 2).sum(1)) for h in cuts] for r in (qr, xr))
    best = np.full((len(q), k), -np.inf)
    exact = float(np.abs(qf).max(initial=0)) * float(np.abs(xf).max(initial=0)) * q.shape[1] < 2**52
    found = []
    for at in range(0, len(x), step):
        part = slice(at, at + step)
        top = x_norm[part].max(initial=0)
        slack = 1e-9 * q_norm * top + 1e-3
        live = np.flatnonzero(q_norm * top + slack >= floor)
        if counts is not None:
            counts[0] += len(q) * len(x_norm[part])
            counts[1] += len(live) * len(x_norm[part])
        if not len(live):
            continue
        limit = floor[live] - slack[live]
        limit = np.minimum(limit, _MOST * (1 - 1e-9))
        total = np.zeros((len(live), len(x_norm[part])))
        li = ci = None
        if np.isfinite(limit).all():
            left, h0 = None, 0
            for i, h in enumerate(cuts):
                if left is None:
                    total += qr[live, h0:h] @ xr[part, h0:h].T
                    keep = total + np.outer(q_rest[i][live], x_rest[i][part]) >= limit[:, None]
                    if keep.mean() < 0.1:
                        li, ci = np.nonzero(keep)
                        left = total[li, ci]
                elif len(left):
                    left = left + np.einsum("ij,ij->i", qr[live[li], h0:h], xr[at + ci, h0:h])
                    stay = left + q_rest[i][live[li]] * x_rest[i][at + ci] >= limit[li]
                    li, ci, left = li[stay], ci[stay], left[stay]
                if counts is not None:
                    counts[2 + i] += int(keep.sum()) if li is None else len(li)
                h0 = h
            if li is None:
                li, ci = np.nonzero(keep)
        else:  # a query without k known scores takes all, and keeps the k best
            dense = qf[live] @ xf[part].T
            seen = np.where(sole[part] & (q_ids[live][:, None] != ids[part]), dense, -np.inf)
            if seen.shape[1] > k:
                limit = np.maximum(limit, np.partition(seen, -k, axis=1)[:, -k] - slack[live])
            limit = np.minimum(limit, _MOST * (1 - 1e-9))
            li, ci = np.nonzero(dense >= limit[:, None])
            if counts is not None:
                counts[2:] += len(live) * len(x_norm[part])
        own = q_ids[live[li]] != ids[at + ci]
        qi, ci = live[li[own]], at + ci[own]
        score = np.empty(len(qi), np.int64)
        for a in range(0, len(qi), 1 << 16):
            u, w = qf[qi[a : a + (1 << 16)]], xf[ci[a : a + (1 << 16)]]
            if exact:
                score[a : a + (1 << 16)] = np.einsum("ij,ij->i", u, w)
            else:
                score[a : a + (1 << 16)] = [max(-_MOST, min(_MOST, sum(int(m) * int(n) for m, n in zip(r, s, strict=True)))) for r, s in zip(u.tolist(), w.tolist(), strict=True)]
        qi, ci, score, rank = _ranked(qi, ci, score, ids, sole, k)
        found.append((qi, ci, score))
        counted = rank >= 0
        new = np.full((len(q), k), -np.inf)
        new[qi[counted], rank[counted]] = score[counted]
        best = -np.sort(-np.hstack([best, new]), axis=1)[:, :k]
        floor = np.maximum(floor, best[:, -1])
    qi, ci, score = (np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    qi, ci, score, _ = _ranked(qi, ci, score, ids, sole, k)
    return qi, ci, score, best


def _ranked(qi, ci, score, ids, sole, k):
    """Pairs by query and falling score: the k best of sole rows, whose rank comes too, and all others no worse than these."""
    order = np.lexsort((ids[ci], -score, qi))
    qi, ci, score = qi[order], ci[order], score[order]
    alone = sole[ci]
    before = np.cumsum(alone) - alone  # sole rows before each pair
    rank = before - before[np.searchsorted(qi, qi, "left")] if len(qi) else before
    keep = np.where(alone, rank < k, rank <= k)
    return qi[keep], ci[keep], score[keep], np.where(alone, rank, -1)[keep]


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding", query_block: int = 1024, block: int = 16_384, seeds: int = 128) -> DataFrame:
    """For each row where ``queries`` holds, the k rows of highest score: query_id, rank, vec_id, score.

    The score is the inner product of the vectors of floor(scale * x), clipped to 64 bits. Ties go to the
    smaller vec_id; rows with the query's own vec_id are no candidates; with fewer candidates all are returned. Vectors that are null,
    or hold a null or a non-finite component, and rows without an id take no part; shorter vectors count as if
    filled with 0. Rows that repeat an id are one query and one candidate: a pair of ids has the
    highest score of any of their vectors. An empty table gives no rows; other columns are ignored.

    All rows are rotated by their singular vectors and packed into blocks by descending length. Each block of queries first meets
    the ``seeds`` longest rows, which give scores that k candidates reach; then it
    meets those blocks whose longest row could still reach them. Both sides move as packed blocks; a block of rows
    moves once for 64 blocks of queries. Blocks hold at most 8 MB (rows) and 2 MB (queries). The driver gets one matrix of dim x dim and nothing that grows.
    """
    spark = vectors.sparkSession
    with common.scratch(spark):
        rows = common.cut(quantised(vectors, queries, scale, id_col, vec_col))
        count, asked, dim, longest = rows.agg(F.count("*"), F.count_if("query"), F.max("size"), F.max("norm")).first()
        dim = max(1, dim or 0)
        if not asked:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        repeated = common.cut(rows.groupBy("vec_id").agg(F.count("*").alias("c")).where("c > 1").select("vec_id", F.lit(False).alias("sole")))
        rows = rows.join(common.sized(repeated), "vec_id", "left").withColumn("sole", F.coalesce("sole", F.lit(True)))
        block, query_block = (max(1, min(n, (mb << 20) // (8 * dim))) for n, mb in ((block, 8), (query_block, 2)))
        rotate = rotation(rows, dim)
        cand = common.cut(blocks(rows, block, count, dim))
        asks = common.cut(blocks(rows.where("query"), query_block, asked, dim).select(F.col("block").alias("q_block"), F.col("most").alias("q_most"), F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("v").alias("q")))
        first = cand.agg(F.min("block")).first()[0]  # numbers rise as lengths fall

        def floors(batches):
            import pyarrow as pa

            for b in batches:
                for r in b.to_pylist():
                    x, q = _unpacked(r["v"], r["n"], dim)[:seeds], _unpacked(r["q"], r["q_n"], dim)
                    *_, best = search_block(np.frombuffer(r["q_ids"], "<i8"), q, np.frombuffer(r["ids"], "<i8")[:seeds], np.frombuffer(r["sole"], bool)[:seeds], x, np.full(len(q), -np.inf), rotate, k)
                    yield pa.RecordBatch.from_arrays([pa.array([r["q_block"]]), pa.array([best[:, -1].tobytes()], pa.binary()), pa.array([float(best[:, -1].min())])], ["q_block", "floor", "least"])

        met = asks.withColumn("block", F.lit(first)).join(F.broadcast(cand.where(F.col("block") == first)), "block")
        known = common.cut(common.by_batch(met.select("q_block", "q_n", "q_ids", "q", "n", "ids", "sole", "v"), floors, "q_block long, floor binary, least double"))
        asks = common.cut(asks.join(known, "q_block"))

        # Pairs of blocks, from numbers and lengths alone: they meet in classes of length, each dealt
        # so that one holds about 256 blocks.
        deals = max(1, -(-count // block) // 256)
        class_of = lambda c: F.floor(8 * F.log2(c))
        least = (F.col("least") - 1e-3) / (1 + 1e-9) / F.greatest("q_most", F.lit(1e-9))
        reach = F.when(least > 1, F.least(class_of(least), class_of(F.lit(max(longest, 1.0))))).otherwise(0)
        wanted = asks.select("q_block", least.alias("reach"), F.explode(F.sequence(reach, class_of(F.lit(max(longest, 1.0))))).alias("class")).withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
        there = cand.select("block", "most", class_of(F.greatest("most", F.lit(1.0))).alias("class"), F.pmod(F.xxhash64("block"), F.lit(deals)).cast("int").alias("deal"))
        pairs = wanted.join(there, ["class", "deal"]).where((F.col("most") >= F.col("reach")) | (F.col("reach") <= 1)).select("q_block", "block")
        pairs = common.cut(pairs.join(pairs.groupBy("block").agg(F.count("*").alias("c")), "block").select("q_block", "block", F.pmod(F.xxhash64("q_block"), F.ceil(F.col("c") / 64)).alias("deal")))

        def task(batches):
            import pyarrow as pa

            held = None
            for b in batches:
                for i in range(len(b)):
                    r = {c: b.column(c)[i].as_py() for c in b.schema.names}
                    x, own = _unpacked(r["v"], r["n"], dim), np.frombuffer(r["ids"], "<i8")
                    if r["floor"] is None:  # the rows' block comes before its queries
                        held = (own, np.frombuffer(r["sole"], bool), x)
                        continue
                    qi, ci, score, _ = search_block(own, x, *held, np.frombuffer(r["floor"], np.float64), rotate, k)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (own[qi], held[0][ci], score)], ["query_id", "vec_id", "score"])

        none = F.lit(None).cast("binary")
        left = pairs.select("block", "deal").distinct().join(cand, "block").select("block", "deal", "n", "ids", "sole", none.alias("floor"), "v")
        right = pairs.join(asks, "q_block").select("block", "deal", F.col("q_n").alias("n"), F.col("q_ids").alias("ids"), none.alias("sole"), "floor", F.col("q").alias("v"))
        both = left.unionByName(right).repartition("block", "deal").sortWithinPartitions("block", "deal", F.col("floor").asc_nulls_first())
        found = common.keep(common.cut(common.by_batch(both.select("n", "ids", "sole", "floor", "v"), task, RESULT)))
    # The filter on row_number keeps k rows of a query in each task before the shuffle too.
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
