"""SimHash near-duplicates: an index of positional bytes with a count filter."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrasieve.llm import common, meeting
from spectrasieve.llm.ngram_join import components

_LOWER = bytes(i + 32 if 65 <= i < 91 else i for i in range(256))
_ALL_BUT_TOP = np.uint64(0x7F7F7F7F7F7F7F7F)
_STEP = 1 << 16  # shingles that are counted at a time


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The bits that more than half of the shingles' XXH64 values have; 0 without words."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # of bytes: at 0x20 and 0x09 to 0x0D
    if not found:
        return 0
    joined = b" ".join(found)
    size = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(size + 1) - 1
    starts, n = ends - size, max(1, len(found) - words + 1)
    ends = ends[min(words, len(found)) - 1 :]
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _STEP):
        pieces = [joined[i:j] for i, j in zip(starts[at : min(n, at + _STEP)].tolist(), ends[at : at + _STEP].tolist(), strict=True)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, pieces, itertools.repeat(seed)), np.uint64, len(pieces))
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp) of (doc_id, text): the fingerprint as a signed long."""

    def task(batches):
        import pyarrow as pa

        for b in batches:
            made = np.array([fingerprint(t.as_py(), words) for t in b.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(made)], ["doc_id", "fp"])

    return common.by_batch(docs.select("doc_id", "text"), task, "doc_id long, fp long")


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """How many of the eight bytes of each value are zero: of a ^ b, the positional bytes that a and b share."""
    some = ((x & _ALL_BUT_TOP) + _ALL_BUT_TOP) | x | _ALL_BUT_TOP
    return np.bitwise_count(~some)


def covering(least: int) -> list[tuple[int, ...]]:
    """Sets of positions such that whichever ``least`` of the eight bytes agree, all bytes of one set do.

    The positions are dealt into groups around a circle. For least = 4 the sets are the triples within one of three groups and
    those of two from a group with one from the next: 20 sets, the fewest there are. For other counts, all sets
    of least - 1 positions (least at most 1: the empty set, under which all meet).
    """
    if least != 4:
        return list(itertools.combinations(range(8), max(0, least - 1)))
    group = [0, 0, 0, 1, 1, 1, 2, 2]
    out = []
    for t in itertools.combinations(range(8), 3):
        n = [sum(group[i] == g for i in t) for g in range(3)]
        if 3 in n or any(n[g] == 2 and n[(g + 1) % 3] == 1 for g in range(3)):
            out.append(t)
    return out


def _links(table, bits: int, least: int):
    """(fp, label) of the fingerprints of a part that link: the least of those they reach within it."""
    import pyarrow as pa

    fp = table.column("fp").to_numpy().view(np.uint64)
    names, node = np.unique(fp, return_inverse=True)
    spot, cell, which = (table.column(c).to_numpy() for c in ("key", "cell", "which"))
    order = np.lexsort((node, cell, spot, which))
    fp, node = fp[order], node[order]
    spot, cell, which = spot[order], cell[order], which[order]
    new = np.ones(len(fp), bool)
    new[1:] = (spot[1:] != spot[:-1]) | (cell[1:] != cell[:-1]) | (which[1:] != which[:-1])
    end = meeting.runs(np.cumsum(new))
    forest = meeting.Forest(len(names))
    left, d, found, size = np.arange(len(fp)), 0, [], 0
    while len(left):
        d += 1
        left = left[left + d < end[left]]
        x = fp[left] ^ fp[left + d]
        near = np.flatnonzero(shared_bytes(x) >= least)  # the count filter
        near = left[near[np.bitwise_count(x[near]) <= bits]]  # the check
        near = near[forest.label[node[near]] != forest.label[node[near + d]]]
        found.append((node[near], node[near + d]))
        size += len(near)
        if size > 500_000 or not len(left):
            forest.add(*(np.concatenate(c) for c in zip(*found, strict=True)))
            found, size = [], 0
    label = names[forest.label]
    keep = label != names
    common.trim()
    return pa.table({"fp": pa.array(names[keep].view(np.int64)), "label": pa.array(label[keep].view(np.int64))})


def link_fingerprints(fps: DataFrame, bits: int = 4, hot: int = 16_384, per_part: int = 1_000_000) -> DataFrame:
    """(node, label) over the distinct fingerprints ``fp`` that link with another: the least (as a signed number) each one reaches.

    Fingerprints that differ in at most ``bits`` bits share 8 - bits positional bytes or more. Each is listed in the index under the
    bytes of every set of positions of :func:`covering`, so such pairs meet in a list. Where two meet, the positional bytes they
    share are counted, pairs that reach the guaranteed number are kept and their bits compared. What links within
    a part of the index leaves it as a forest, so a family of m fingerprints makes no m * m rows. A list of more than ``hot`` is dealt over cells.
    """
    least = max(0, 8 - bits)
    byte = lambda i: F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255))
    entries = []
    for k, t in enumerate(covering(least)):
        key = F.lit(0).cast("long")
        for i in t:
            key = key * F.lit(256) + byte(i)
        entries.append(F.struct(F.lit(k).alias("which"), key.alias("key")))
    postings = fps.select("fp", F.inline(F.array(*entries)))
    postings = meeting.dealt(postings, ["which", "key"], "fp", hot).withColumn("spot", F.xxhash64("which", "key", "cell"))
    n = max(1, -(-fps.count() * len(entries) // per_part))
    found = postings.withColumn("part", F.pmod("spot", F.lit(n))).groupBy("part").applyInArrow(lambda t: _links(t, bits, least), "fp long, label long")
    return components(common.cut(found), "fp", "label")


def link(docs: DataFrame, words: int = 4, bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 lowercase hex digits), component_id.

    Words are runs of bytes outside space and \\t to \\r of the whole text, with A-Z lower-cased; a shingle is ``words`` of them
    joined by one space (fewer words: the whole sequence), repeats included. A bit of the fingerprint is 1 if it is set in over half
    of the shingles' XXH64 values (seed 42). Without words or text the fingerprint is zero, linked like any other.
    Two documents link if their fingerprints differ in at most ``bits`` bits; component_id is the least doc_id reachable.

    Equal fingerprints are one node. Null ids stay null and take the component of their fingerprint (null if it has no id);
    rows that repeat an id are linked by their fingerprints alone; other columns are ignored; an empty table gives no rows.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with common.scratch(docs.sparkSession):
        made = common.keep(common.cut(fingerprints(d, words)))
        nodes = common.cut(made.groupBy("fp").agg(F.min("doc_id").alias("least")))
        label = link_fingerprints(nodes.select("fp"), bits)
        rooted = nodes.join(label, nodes.fp == label.node, "left").select("fp", "least", F.coalesce("label", "fp").alias("root"))
        rooted = common.cut(rooted)
        roots = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        of = common.keep(common.cut(rooted.join(roots.hint("merge"), "root").select(F.col("fp").alias("node"), "component_id")))
    got = made.join(of.hint("merge"), made.fp == of.node)
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
