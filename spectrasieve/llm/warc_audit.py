"""WARC records and Merkle fixity audits of their replicas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrasieve.llm import common


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A page as the text of a WARC response record. Nulls count as empty."""
    body = F.coalesce(html.cast("string"), F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url.cast("string"), F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def _digest(parts: Column) -> Column:
    return F.sha2(F.concat_ws(",", parts), 256)


def leaves(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", segment_size: int = 1024, by: tuple[str, ...] = ()) -> DataFrame:
    """(segment, pos, page_id, length, digest): one leaf for each id of a segment, apart for each value of the columns ``by``.

    A segment holds the records whose ids share page_id div segment_size, in the order of ids;
    pos is the id's place in it. Rows that repeat an id form one leaf over their ordered digests. Rows without
    an id are filed under a hash of their record. Records are hashed where they are read; only digests move.
    """
    page_id = F.col(id_col).cast("long")
    text = record(page_id, F.col(url_col), F.col(html_col))
    rows = pages.select(*by, page_id.alias("page_id"), F.octet_length(text).cast("long").alias("n"), F.sha2(text.cast("binary"), 256).alias("sha"))
    key = F.coalesce("page_id", F.shiftrightunsigned(F.xxhash64("sha"), 1))
    rows = rows.withColumn("segment", F.floor(key / F.lit(segment_size)) if segment_size & (segment_size - 1) else F.shiftright(key, segment_size.bit_length() - 1)).withColumn("pos", F.pmod(key, F.lit(segment_size)))
    # A leaf of thousands of repeats is folded by digest before its own is taken.
    part = rows.groupBy(*by, "segment", "pos", "page_id", "sha").agg(F.count("*").alias("times"), F.max("n").alias("n"))
    made = part.groupBy(*by, "segment", "pos", "page_id").agg(F.sum(F.col("n") * F.col("times")).alias("length"), F.sort_array(F.collect_list(F.struct("sha", "times"))).alias("all"))
    return made.select(*by, "segment", "pos", "page_id", "length", F.when((F.size("all") == 1) & (F.col("all")[0].times == 1), F.col("all")[0].sha).otherwise(_digest(F.transform("all", lambda x: F.concat_ws("*", x.sha, x.times)))).alias("digest"))


def levels(leaf: DataFrame, fan: int, segment_size: int, by: tuple[str, ...] = ()) -> list[DataFrame]:
    """The tree's nodes from the leaves to the segments' roots, a table a level: (segment, pos, length, digest).

    A node covers the byte range of at most ``fan`` children in order: its digest is over their positions, lengths and digests.
    """
    nodes = leaf.groupBy(*by, "segment", "pos").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("digest", "length"))).alias("all"))
    out = [common.cut(nodes.select(*by, "segment", "pos", "length", _digest(F.transform("all", lambda x: F.concat_ws(":", x.length, x.digest))).alias("digest")))]
    width = segment_size
    while width > 1:
        width = -(-width // fan)
        up = out[-1].groupBy(*by, "segment", F.floor(F.col("pos") / fan).alias("pos")).agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("pos", "length", "digest"))).alias("all"))
        out.append(common.cut(up.select(*by, "segment", "pos", "length", _digest(F.transform("all", lambda x: F.concat_ws(":", x.pos, x.length, x.digest))).alias("digest"))))
    return out


def root(pages: DataFrame, fan: int = 16, segment_size: int = 1024, **columns) -> DataFrame:
    """(segment, length, digest) of every segment's root."""
    with common.scratch(pages.sparkSession):
        top = common.keep(levels(leaves(pages, segment_size=segment_size, **columns), fan, segment_size)[-1])
    return top.drop("pos")


def _mismatches(nodes: DataFrame) -> DataFrame:
    """(segment, pos) of nodes that are not equal in both replicas or are in one alone."""
    of = lambda k: F.max(F.when(F.col("replica") == k, F.col("digest")))
    return nodes.groupBy("segment", "pos").agg(of(0).alias("a"), of(1).alias("b")).where(~F.col("a").eqNullSafe(F.col("b"))).select("segment", "pos")


def audit(original: DataFrame, replica: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", fan: int = 16, segment_size: int = 1024) -> DataFrame:
    """Records in which two replicas differ: page_id, segment, start, length, kind, digest, replica_digest.

    Both are hashed into one tree a segment; roots are compared, and only children of nodes that mismatch
    are compared further, down to records. ``kind`` is changed, missing (not in the replica) or added; ``start`` and ``length`` are
    the record's bytes in the original segment (null if added). Equal replicas, and two empty tables, give no rows. Rows that
    repeat an id count as one record of all their bytes; nulls count as empty and texts of any length are hashed whole; other columns
    are ignored. Nothing but DataFrame operations runs; each level, and each level's mismatches, are a written table.
    """
    by, columns = ("replica",), [F.col(c) for c in dict.fromkeys((id_col, url_col, html_col))]
    with common.scratch(original.sparkSession):
        rows = original.select(*columns, F.lit(0).alias("replica")).unionByName(replica.select(*columns, F.lit(1).alias("replica")))
        leaf = common.keep(common.cut(leaves(rows, id_col, url_col, html_col, segment_size, by)))
        tree = levels(leaf, fan, segment_size, by)
        wrong = common.cut(_mismatches(tree[-1]))
        for nodes in reversed(tree[:-1]):
            above = common.sized(wrong.withColumnRenamed("pos", "up"))
            wrong = common.cut(_mismatches(nodes.withColumn("up", F.floor(F.col("pos") / fan)).join(above, ["segment", "up"], "left_semi")))
        wrong = common.keep(wrong)
    # Byte ranges only of segments that hold a mismatch; a segment's size is bounded.
    order = "sum(length) over (partition by replica, segment order by pos, page_id rows between unbounded preceding and current row) - length"
    near = leaf.join(common.sized(wrong.select("segment").distinct()), "segment", "left_semi").withColumn("start", F.expr(order)).join(common.sized(wrong), ["segment", "pos"], "left_semi")
    of = lambda k, c: F.max(F.when(F.col("replica") == k, F.col(c)))
    got = near.groupBy("segment", "pos", "page_id").agg(of(0, "start").alias("start"), of(0, "length").alias("length"), of(0, "digest").alias("digest"), of(1, "digest").alias("replica_digest"))
    kind = F.when(F.col("replica_digest").isNull(), "missing").when(F.col("digest").isNull(), "added").otherwise("changed")
    return got.where(~F.col("digest").eqNullSafe(F.col("replica_digest"))).select("page_id", "segment", "start", "length", kind.alias("kind"), "digest", "replica_digest")
