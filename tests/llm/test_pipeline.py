import hashlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from spectrasieve.llm import bpe, quality

from .test_text_operators import BYTE, brute


def test_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names}
    assert "pipeline" not in __spark_entry__.oracle_sql()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "ngram_join", "packing"]


def test_pipeline_equals_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{data}/labels.parquet"))
    good = {r.doc_id for r in quality.classify(docs, model).collect() if r.predicted}
    rows = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id in good}
    best = {}
    for i, t in rows.items():
        best[t] = max(best.get(t, i), i)
    rows = {i: rows[i] for i in best.values()}
    kept = sorted({c for _, _, c in brute(list(rows.items()))})
    tok = bpe.load(BYTE)
    want = {i: len(tok.encode(rows[i], add_special_tokens=False).ids) + 1 for i in kept}
    got: dict = {}
    for r in corpus_pipeline.run(spark, data).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert {i: sum(r.length for r in p) for i, p in got.items()} == want
    assert len(kept) < docs.count() and all(r.doc_tokens == want[i] for i, p in got.items() for r in p)


def test_stages_keep_columns(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns, name
        before = {(r.doc_id, hashlib.md5((r.text or "").encode()).hexdigest()) for r in docs.collect()}
        docs = spark.createDataFrame(out.collect(), docs.schema)
        assert {(r.doc_id, hashlib.md5((r.text or "").encode()).hexdigest()) for r in docs.collect()} <= before


@pytest.mark.parametrize("name", ["op1_html_extract", "op2_bpe_codec", "op3_token_counts", "op6_packing", "op10_quality"])
def test_queries_cover_their_tables(spark, data, name):
    source, key = ("pages", "page_id") if name.startswith("op1_") else ("documents", "doc_id")
    want = {r[0] for r in spark.read.parquet(f"{data}/{source}.parquet").select(key).collect()}
    assert {r[0] for r in __spark_entry__.queries()[name](spark, data).select(key).collect()} == want


def test_pipeline_with_odd_rows(spark, data, tmp_path):
    """Null and empty texts, null and repeated ids and rows, a very long text, clashing names and empty tables."""
    base = spark.read.parquet(f"{data}/documents.parquet").limit(40).select("doc_id", "text", "lang")
    long = " ".join(f"word{i}" for i in range(60_000))
    odd = spark.createDataFrame([(9001, None, "x"), (9002, "", None), (9003, long, "y"), (9003, long, "y"), (9004, long + " end", None), (None, "no id at all but words", None), (None, "no id at all but words", None), (None, None, None)], "doc_id long, text string, lang string")
    docs = base.unionByName(base.limit(5)).unionByName(odd)
    for c in ("label", "score", "key", "n", "component_id", "kept", "times"):
        docs = docs.withColumn(c, F.lit(1))
    labels = spark.read.parquet(f"{data}/labels.parquet")
    for name, rows in (("odd", docs), ("none", docs.limit(0))):
        at = f"{tmp_path}/{name}"
        rows.write.parquet(f"{at}/documents.parquet")
        labels.write.parquet(f"{at}/labels.parquet")
    made = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    size: dict = {}
    for r in made:
        size.setdefault(r.doc_id, set()).add(r.doc_tokens)
    assert all(len(v) == 1 for i, v in size.items() if i is not None)
    assert {9003, 9004} & set(size) in ({9003}, set()) and {9001, 9002} & set(size) in ({9002}, set())
    for i, n in size.items():
        if i is not None:
            assert sum(r.length for r in made if r.doc_id == i) == n.pop()  # each document is packed once
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, f"{tmp_path}/odd")
        assert kept.columns == docs.columns, name
