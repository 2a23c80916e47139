"""N-gram Jaccard join by prefix filters under several global token orders."""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrasieve.llm import blocks, common, hashing
from spectrasieve.llm.hashing import mix

_SPACE = hashing.spaces(b" \t\n\x0b\x0c\r")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0xA0761D6478BD642F)
_BITS = 20  # log2 of the counters of a sketch row
_PART = 1 << 14  # counters of a sketch row that travel together
_DRAWN = 26_214  # of 2^16 tokens those that are counted exactly, two fifths
_PARTS = 512  # parts of the token space in which they are counted
_BLOCK, _DOCS = 500_000, 4096  # drawn tokens, and documents, of a block
_SEEDS = [np.uint64(0x2545F4914F6CDD1D * (2 * i + 1) & (1 << 64) - 1) for i in range(16)]


def shingle_sets(column, words: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each row's shingles of ``words`` words.

    Words are runs of bytes outside space and \\t to \\r, with A-Z lower-cased. A row of fewer words has one
    shingle, the whole sequence; a row without words has none.
    """
    buf, edges = hashing.raw(column)
    h, _, _, at = hashing.word_hashes(_LOWER[buf], edges, _SPACE)
    n = len(h)
    s = np.zeros(max(0, n - words + 1), np.uint64)
    for k in range(words):
        s = s * _STEP + h[k : k + len(s)]
    s = mix(s)
    out = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if hi - lo >= words:
            out.append(np.unique(s[lo : hi - words + 1]))
        elif hi > lo:
            whole = np.uint64(hi - lo)
            for w in h[lo:hi]:
                whole = np.uint64((int(whole) * int(_STEP) + int(w)) & (1 << 64) - 1)
            out.append(mix(np.array([whole])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def orders(sketch: np.ndarray, s: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the rank of the tokens ``s`` and their counts: rarest first by that order's own row of counters, then by its own hash."""
    out = []
    for k, row in enumerate(sketch):
        own = mix(s ^ _SEEDS[k])
        count = np.minimum(row[own >> np.uint64(64 - _BITS)], (1 << 28) - 1).astype(np.uint64)
        out.append((count << np.uint64(36) | (own & np.uint64((1 << 36) - 1)), count.astype(np.int64)))
    return out


def prefix_length(n: int, percent: int) -> int:
    """Tokens of which a partner must hold one: n - ceil(percent n / 100) + 1."""
    return n - -(-percent * n // 100) + 1


def _scan(docs: DataFrame, words: int) -> DataFrame:
    """Document rows (kind 0: their place ``at`` in a block) and the drawn tokens of each block by part of the token space (kind 1: how many each document has).

    The same ``_DRAWN`` of 2^16 of all tokens are drawn in all documents; within a part 32 bits stand for a token.
    """

    def task(batches):
        import pyarrow as pa
        import xxhash

        fields = ("kind", "doc_id", "n", "key", "block", "at", "part", "tokens", "counts")
        types = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        block, made, size, held = TaskContext.get().partitionId() << 32, 0, 0, []

        def batch(*columns):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], fields)

        def flush():
            s, doc = np.concatenate(held), np.repeat(np.arange(len(held)), list(map(len, held)))
            part = ((s >> np.uint64(16)) % np.uint64(_PARTS)).astype(np.int64)
            counts = np.bincount(part * len(held) + doc, minlength=_PARTS * len(held)).reshape(_PARTS, -1)
            tokens = np.split((s >> np.uint64(32)).astype("<u4")[np.argsort(part, kind="stable")], np.cumsum(counts.sum(1))[:-1])
            some = [k for k, t in enumerate(tokens) if len(t)]
            none = [None] * len(some)
            return batch([1] * len(some), none, [len(held)] * len(some), none, [block + made] * len(some), none, some, [tokens[k].tobytes() for k in some], [blocks.pack(counts[k]) for k in some])

        for b in batches:
            for first, part in hashing.slices(b.column(1)):
                sets = shingle_sets(part, words)
                n, none = len(sets), [None] * len(sets)
                at = []
                for s in sets:
                    if size > _BLOCK or len(held) == _DOCS:
                        yield flush()
                        made, size, held = made + 1, 0, []
                    at.append((block + made, len(held)))
                    held.append(s[(s & np.uint64(0xFFFF)) < np.uint64(_DRAWN)])
                    size += len(held[-1])
                if n:
                    yield batch([0] * n, b.column(0).slice(first, n).to_pylist(), list(map(len, sets)), [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], *map(list, zip(*at, strict=True)), none, none, none)
        if size:
            yield flush()

    return common.by_batch(docs, task, "kind int, doc_id long, n long, key binary, block long, at long, part long, tokens binary, counts binary")


def _shared(scanned: DataFrame, percent: int) -> DataFrame:
    """(doc_id, n): documents that can link. Others hold so many drawn tokens that no other row holds, that what is left of their set cannot be shared enough."""

    def singles(table):
        import pyarrow as pa

        tokens = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in table.column("tokens")])
        order = np.argsort(tokens, kind="stable")
        by = tokens[order]
        differs = np.concatenate([[True], by[1:] != by[:-1], [True]])
        single = np.zeros(len(tokens), bool)
        single[order] = differs[1:] & differs[:-1]
        found, lo = [], 0
        for n, counts in zip(table.column("n").to_pylist(), table.column("counts").to_pylist(), strict=True):
            doc = np.repeat(np.arange(n), blocks.unpack(counts, n))
            found.append(blocks.pack(np.bincount(doc[single[lo : lo + len(doc)]], minlength=n)))
            lo += len(doc)
        common.trim()
        return pa.table({"block": table.column("block"), "n": table.column("n"), "counts": pa.array(found, pa.binary())})

    def left(table):
        import pyarrow as pa

        doc = table.column("counts").is_null().to_numpy()
        rows, at = table.filter(pa.array(doc)), table.filter(pa.array(doc)).column("at").to_numpy()
        own = np.zeros(len(rows), np.int64)
        for n, counts in zip(*(table.filter(pa.array(~doc)).column(c).to_pylist() for c in ("n", "counts")), strict=True):
            own[:n] += blocks.unpack(counts, n)
        n = rows.column("n").to_numpy()
        return rows.filter(pa.array((n > 0) & (own[at] < prefix_length(n, percent)))).select(["doc_id", "n"])

    null = F.lit(None).cast
    counted = scanned.where("kind = 1").select("part", "block", "n", "tokens", "counts").groupBy("part").applyInArrow(singles, "block long, n long, counts binary")
    rows = scanned.where("kind = 0").select("block", "doc_id", "n", "at", null("binary").alias("counts"))
    rows = rows.unionByName(counted.select("block", null("long").alias("doc_id"), "n", null("long").alias("at"), "counts"))
    return rows.groupBy("block").applyInArrow(left, "doc_id long, n long").where("doc_id is not null")


def _sketch(docs: DataFrame, words: int, n_orders: int) -> np.ndarray:
    """The counters of the tokens of all documents (text); their number is fixed, whatever the corpus."""

    def task(batches):
        import pyarrow as pa

        total = np.zeros((n_orders, 1 << _BITS), np.uint32)
        for b in batches:
            for _, part in hashing.slices(b.column(0)):
                held = np.concatenate(shingle_sets(part, words))
                for k in range(n_orders):
                    total[k] += np.bincount((mix(held ^ _SEEDS[k]) >> np.uint64(64 - _BITS)).astype(np.int64), minlength=1 << _BITS).astype(np.uint32)
        for k in range(n_orders):
            for p in range((1 << _BITS) // _PART):
                c = total[k, p * _PART : (p + 1) * _PART]
                if c.any():
                    blob = bytes([kind := np.min_scalar_type(c.max()).itemsize]) + c.astype(f"<u{kind}").tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([k * (1 << _BITS) + p * _PART], pa.int64()), pa.array([pa.Codec("zstd", 1).compress(blob, asbytes=True)], pa.binary()), pa.array([len(blob)], pa.int64())], ["part", "counts", "size"])

    def add(table):
        import pyarrow as pa

        total = np.zeros(_PART, np.int64)
        for data, size in zip(table.column("counts").to_pylist(), table.column("size").to_pylist(), strict=True):
            blob = pa.Codec("zstd").decompress(data, size, asbytes=True)
            total += np.frombuffer(blob, f"<u{blob[0]}", offset=1)
        return pa.table({"part": table.column("part")[:1], "counts": pa.array([np.minimum(total, (1 << 32) - 1).astype("<u4").tobytes()], pa.binary())})

    out = np.zeros(n_orders << _BITS, np.uint32)
    for r in common.by_batch(docs.select("text"), task, "part long, counts binary, size long").groupBy("part").applyInArrow(add, "part long, counts binary").collect():
        out[r.part : r.part + _PART] = np.frombuffer(r.counts, "<u4")
    return out.reshape(n_orders, 1 << _BITS)


def components(edges: DataFrame, u: str = "a", v: str = "b") -> DataFrame:
    """(node, label): the least node that each node of ``edges`` reaches, for nodes that have an edge.

    Each round takes the least label among a node's neighbours and then follows the label's own label, so
    a path of n nodes takes about log n rounds. Every round is a written table.
    """
    edges = common.cut(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct())
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    labels = common.cut(both.groupBy(F.col("u").alias("node")).agg(F.min(F.least("u", "v")).alias("label")))
    while True:
        near = both.join(labels, both.v == labels.node).groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        # A node also hands its least label to the node it is labelled by, so that trees hook together.
        up = labels.join(near, "node").select(F.col("label").alias("node"), "near")
        best = near.unionByName(up).groupBy("node").agg(F.min("near").alias("near"))
        new = labels.join(best, "node", "left").select("node", F.least("label", "near").alias("label"))
        jump = new.select(F.col("node").alias("at"), F.col("label").alias("beyond"))
        new = common.cut(new.join(jump, new.label == jump["at"], "left").select("node", F.least("label", "beyond").alias("label")))
        changed = new.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").isEmpty()
        common.drop_cut(labels)
        labels = new
        if changed:
            common.drop_cut(edges)
            return labels


def _fetch(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` with an id of ``ids``: by broadcast while ids are few, else by a join."""
    return docs.join(common.sized(ids), "doc_id", "left_semi")


def _reaches(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets' Jaccard similarity is ``percent`` or more."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)) or not len(x):
        return False
    at = np.searchsorted(x, y)
    same = int((x[np.minimum(at, len(x) - 1)] == y).sum())
    return same > 0 and 100 * same >= percent * (len(x) + len(y) - same)


def verified(docs: DataFrame, pairs: DataFrame, words: int, percent: int, group: int = 512) -> DataFrame:
    """The pairs (a, b) whose whole texts' shingle sets reach the threshold.

    Pairs of one ``a`` meet one copy of its text for about ``group`` partners, which stream past it.
    """
    with common.scratch(docs.sparkSession):
        ids = common.cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
        texts = common.cut(_fetch(docs, ids))
        many = pairs.groupBy("a").agg(F.count("*").alias("c"))
        dealt = common.cut(pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("c") / group)).alias("deal")))

        def task(batches):
            import pyarrow as pa

            last, own, opening = None, [], False
            for b in batches:
                keep = []
                of, deal = b.column("a").to_pylist(), b.column("deal").to_pylist()
                first = b.column("b").is_null().to_pylist()
                for at, part in hashing.slices(b.column("text")):
                    for i, y in enumerate(shingle_sets(part, words), at):
                        if first[i]:  # rows that repeat an id are one node with several texts
                            own = [*own, y] if opening and (of[i], deal[i]) == last else [y]
                            last, opening = (of[i], deal[i]), True
                            continue
                        opening = False
                        if (of[i], deal[i]) == last and any(_reaches(x, y, percent) for x in own):
                            keep.append(i)
                yield b.select(["a", "b"]).take(pa.array(keep, pa.int64()))

        left = dealt.select("a", "deal").distinct().join(texts.withColumnRenamed("doc_id", "a"), "a").select("a", "deal", F.lit(None).cast("long").alias("b"), "text")
        right = dealt.join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "deal", "b", "text")
        rows = left.unionByName(right).repartition("a", "deal").sortWithinPartitions("a", "deal", F.col("b").asc_nulls_first())
        return common.keep(common.cut(common.by_batch(rows, task, "a long, b long")))


def _grid(excess: np.ndarray, doc: int, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """(which token, cell): the cells of each token's list that a document goes to.

    A token that more than ``hot`` documents may hold has its documents dealt into s rows; a document of row r goes
    to the cells (r, j) and (j, r) of a triangle, so that any two meet and no cell holds more than about 2 hot of them.
    """
    s = np.maximum(1, -(-excess // hot))
    which = np.repeat(np.arange(len(s)), s)
    j = np.arange(len(which)) - np.repeat(np.cumsum(s) - s, s)
    r = (doc * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 20
    r = np.repeat(r % s, s)
    return which, (np.minimum(r, j) << 32) + np.maximum(r, j)


def _postings(docs: DataFrame, sketch, words: int, percent: int, parts: int, hot: int, few: int = 0) -> DataFrame:
    """Prefix tokens of (doc_id, label, text) under each order, packed by part of the token space.

    With ``few``, of longer prefixes those tokens alone whose hash is divisible by a power of two, the same ones in all documents, so that about ``few`` are left.

    A very frequent token's list is split into cells, see :func:`_grid`.

    A row holds (part, tokens, docs, labels, sizes, places in the order, scores) as arrays; within a part 32 bits stand for a token,
    so different tokens may meet, which adds candidates but loses none. Tokens that tie with the last of a prefix belong to it, at
    the first place that any order of the tie gives them. A document's score is the mean logarithm of its tokens' counts: among near copies the one whose tokens most others share has the highest.
    """

    def task(batches):
        import pyarrow as pa

        rows = sketch.value
        usual = [int(r.mean()) for r in rows]
        held, size = [], 0

        def flush():
            part, *columns = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.argsort(part, kind="stable")
            part = part[order]
            cuts = np.flatnonzero(np.diff(part)) + 1
            cols = [[int(p) for p in part[np.concatenate([[0], cuts])]]] + [[x.tobytes() for x in np.split(c[order], cuts)] for c in columns]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), *[pa.binary()] * 6), strict=True)], ["part", "tokens", "docs", "labels", "sizes", "places", "scores"])

        for b in batches:
            ids, labels = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("label").to_numpy(zero_copy_only=False)
            for at, text in hashing.slices(b.column("text")):
                sets = shingle_sets(text, words)
                all_ranks = orders(rows, np.concatenate(sets)) if sets else []
                edges = np.cumsum([0, *map(len, sets)]).tolist()
                for k, (ranks, counts) in enumerate(all_ranks):
                    for i, s in enumerate(sets):
                        if not len(s):
                            continue
                        p = prefix_length(len(s), percent)
                        r = ranks[edges[i] : edges[i + 1]]
                        own = counts[edges[i] : edges[i + 1]]
                        at_rank = np.flatnonzero(r <= np.partition(r, p - 1)[p - 1])
                        at_rank = at_rank[np.argsort(r[at_rank])]
                        r = r[at_rank]
                        t, place = mix(s[at_rank]), np.searchsorted(r, r).astype("<u4")
                        score = int(1000 * np.log2(1.0 + own).mean())
                        if few and len(t) >= 2 * few:
                            some = np.flatnonzero((t >> np.uint64(16)) % np.uint64(1 << (len(t) // few).bit_length() - 1) == 0)
                            t, place, at_rank = t[some], place[some], at_rank[some]
                        if not len(t):
                            continue
                        p = len(t)
                        excess = own[at_rank] - usual[k]
                        if int(excess.max()) > hot:
                            which, cell = _grid(excess, int(ids[at + i]), hot)
                            dealt = excess[which] > hot  # others keep the key that documents without a frequent token give them
                            t, place, p = np.where(dealt, mix(t[which] ^ mix(cell.astype(np.uint64))), t[which]), place[which], len(which)
                        part = k * parts + ((t >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
                        held.append((part, t.astype(np.uint32), np.full(p, ids[at + i], "<i8"), np.full(p, labels[at + i], "<i8"), np.full(p, len(s), "<u4"), place, np.full(p, score, "<u4")))
                        size += p
                if size > 250_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return common.by_batch(docs.select("doc_id", "label", "text"), task, "part long, tokens binary, docs binary, labels binary, sizes binary, places binary, scores binary")


def _part(table, parts: int):
    """A part's order and its entries of lists with more than one label, in order of token, size and document: token, document, label, size, place, score."""
    k = table.column("part")[0].as_py() // parts if len(table) else 0
    token, doc, label, n, place, score = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in table.column(c)] or [np.zeros(0, t)]) for c, t in (("tokens", "<u4"), ("docs", "<i8"), ("labels", "<i8"), ("sizes", "<u4"), ("places", "<u4"), ("scores", "<u4")))
    order = np.argsort(token, kind="stable")
    by, of = token[order], label[order]
    begin = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]])) if len(by) else np.zeros(0, np.int64)
    if len(begin):  # lists whose documents all have one label are settled
        mixed = np.minimum.reduceat(of, begin) != np.maximum.reduceat(of, begin)
        order = order[np.repeat(mixed, np.diff(np.append(begin, len(by))))]
    order = order[np.lexsort((doc[order], n[order], token[order]))]
    return k, token[order], doc[order], label[order], n[order].astype(np.int64), place[order].astype(np.int64), score[order].astype(np.int64)


def _room(n: np.ndarray, place: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether the entries x and y, which share a token, can be of documents that link: by their sizes, and by the tokens left after the places of this one."""
    both, lo, hi = n[x] + n[y], np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
    least = -(-percent * both // (100 + percent))
    return (100 * lo >= percent * hi) & (n[x] - place[x] >= least) & (n[y] - place[y] >= least)


def _candidates(postings: DataFrame, parts: int, percent: int) -> DataFrame:
    """(a, b, k): pairs with different labels that share a token of their prefixes under order k and whose sizes allow the threshold."""

    def task(table):
        import pyarrow as pa

        k, token, doc, label, n, place, _ = _part(table, parts)
        left = np.arange(len(token))
        found, size, d = [], 0, 0
        done = []
        while len(left):
            d += 1
            left = left[left + d < len(token)]
            left = left[(token[left] == token[left + d]) & (100 * n[left] >= percent * n[left + d])]
            hit = left[label[left] != label[left + d]]
            hit = hit[_room(n, place, hit, hit + d, percent)]
            a, b = doc[hit], doc[hit + d]
            found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
            size += len(hit)
            if size > 2_000_000:
                done = [np.unique(np.concatenate(done + found), axis=0)]
                found, size = [], 0
        pairs = np.unique(np.concatenate(done + found), axis=0) if done or found else np.zeros((0, 2), np.int64)
        common.trim()
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64()), "k": pa.array(np.full(len(pairs), k), pa.int64())})

    return postings.groupBy("part").applyInArrow(task, "a long, b long, k long")


def _stars(postings: DataFrame, parts: int, percent: int, n_orders: int) -> DataFrame:
    """(a, b): for each document b the candidate a of another label, of those that are the most central of a list of b's prefix tokens under every order, that most lists name.

    These are candidates of the prefix filters, one a list and document instead of all pairs of a list.
    """

    def task(table):
        import pyarrow as pa

        k, *columns = _part(table, parts)
        order = np.lexsort((columns[1], -columns[5], columns[0]))  # of each list the most central first
        token, doc, label, n, place, score = (c[order] for c in columns)
        begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
        hub = np.repeat(begin, np.diff(np.append(begin, len(token))))
        x = np.flatnonzero(label != label[hub])
        x = x[_room(n, place, x, hub[x], percent)]
        pairs, first, votes = np.unique(np.stack([doc[hub[x]], doc[x]], 1), axis=0, return_index=True, return_counts=True) if len(x) else (np.zeros((0, 2), np.int64), x, x)
        common.trim()
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64()), "k": pa.array(np.full(len(pairs), k), pa.int64()), "score": pa.array(score[hub[x]][first], pa.int64()), "votes": pa.array(votes, pa.int64())})

    named = postings.groupBy("part").applyInArrow(task, "a long, b long, k long, score long, votes long")
    named = named.groupBy("a", "b").agg(F.countDistinct("k").alias("k"), F.max("score").alias("score"), F.sum("votes").alias("votes")).where(F.col("k") == n_orders)
    return named.groupBy("b").agg(F.max(F.struct("votes", "score", (-F.col("a")).alias("a"))).alias("best")).select((-F.col("best.a")).alias("a"), "b")


def link(docs: DataFrame, words: int = 5, percent: int = 75, n_orders: int = 2, hot: int = 16_384, few: int = 16, rounds: int = 2, per_part: int = 500_000, id_col: str = "doc_id", text_col: str = "text", report: dict | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    A document's set holds its distinct shingles of ``words`` words over the whole text (fewer words: the whole sequence; no words
    or a null text: empty, linked with nothing). Two documents link when 100 * intersection >= percent * union;
    component_id is the least doc_id reachable by links. Shingles are compared by 64-bit hashes.

    1. One scan gives each document's set key and two fifths of the token space, whose tokens are counted exactly by a shuffle.
    2. Equal sets become one representative. A document with so many tokens of its own that no other can reach the threshold is settled; tokens of the others are counted in sketches of fixed size.
    3. Under each of ``n_orders`` global orders (rarest token first, counters of their own) documents are listed by the tokens of their
       prefixes. A pair that links shares a prefix token under every order, so candidates of all orders are intersected. The
       list of a token that more than ``hot`` documents may hold is dealt over a grid of cells.
    4. First, ``rounds`` times, lists give the pairs of their most central document alone, and of long prefixes about ``few`` tokens do; one candidate a document is
       verified on the whole texts, and what links is contracted to a component. So a large group of near copies does not give all its pairs.
    5. Then all lists give all pairs of documents of different components, and all candidates are verified, so no link is lost.
    6. Components of all links are spread back to the documents.

    ``report`` takes the number of documents that are listed, and those of candidates and links of steps 4 and 5. Null ids stay null and link through nothing but equal sets; rows that repeat an id count as
    one node; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with common.scratch(spark):
        scanned = common.keep(common.cut(_scan(d, words)))
        rows = scanned.where("kind = 0")
        classes = common.cut(rows.where("n > 0").groupBy("n", "key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("rep is not null"))
        # For the rows of a set one document stands.
        copies = rows.where("n > 0").select("doc_id", "n", "key").join(classes.where("copies > 1").select("n", "key", "rep").hint("merge"), ["n", "key"]).where("doc_id <> rep").select("doc_id")
        copies = common.cut(copies.distinct())
        near = common.cut(_shared(scanned, percent).join(common.sized(copies), "doc_id", "left_anti").groupBy("doc_id").agg(F.sum("n").alias("n")))
        tokens = near.agg(F.sum("n")).first()[0] or 0
        parts = max(1, -(-tokens * (100 - percent) // 100 // per_part))
        sketch = spark.sparkContext.broadcast(_sketch(_fetch(d, near.select("doc_id")), words, n_orders))

        def listed(marks: DataFrame, few: int = 0) -> DataFrame:
            """Lists of the documents of ``marks`` (doc_id, label)."""
            return _postings(d.join(common.sized(marks), "doc_id"), sketch, words, percent, parts if not few else max(1, parts // 4), hot, few)

        marks, links, n_stars = near.select("doc_id", F.col("doc_id").alias("label")), None, 0
        for _ in range(rounds):
            stars = common.cut(_stars(listed(marks, few), max(1, parts // 4), percent, n_orders))
            more = verified(d, stars, words, percent)
            links = more if links is None else links.unionByName(more)
            n_stars += stars.count() if report is not None else 0
            first = components(links)
            marks = near.select("doc_id").join(common.sized(first), F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("label", "doc_id").alias("label"))
            marks = common.cut(marks)
        pairs = _candidates(listed(marks), parts, percent)
        pairs = common.cut(pairs.groupBy("a", "b").agg(F.countDistinct("k").alias("k")).where(F.col("k") == n_orders).select("a", "b"))
        sketch.destroy()
        more = verified(d, pairs, words, percent)
        if report is not None:
            report |= {"listed": near.count(), "first candidates": n_stars, "first links": links.count(), "candidates": pairs.count(), "links": more.count()}

        label = first.select(F.col("node").alias("x"), "label")
        named = more.join(label, more.a == label.x, "left").select(F.coalesce("label", "a").alias("a"), "b")
        named = named.join(label, named.b == label.x, "left").select("a", F.coalesce("label", "b").alias("b"))
        second = components(named).withColumnRenamed("label", "root")
        final = first.join(second, first.label == second.node, "full").select(F.coalesce(first.node, second.node).alias("node"), F.coalesce("root", "label").alias("label"))
        final = common.keep(common.cut(final.unionByName(second.select("node", F.col("root").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))))
        of = common.keep(common.cut(classes.where("copies > 1").join(final, classes.rep == final.node, "left").select("n", "key", F.coalesce("label", "rep").alias("of"))))
    got = rows.select("doc_id", "n", "key").join(of.hint("merge"), ["n", "key"], "left")
    got = got.join(final.hint("merge"), got.doc_id == final.node, "left")
    return got.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("of", "label", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one document of each component, that of the least id, and the columns they came with."""
    with common.scratch(docs.sparkSession):
        found = link(docs, words, percent, id_col=id_col, text_col=text_col)
        gone = common.keep(common.cut(found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()))
    return docs.join(common.sized(gone), F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
