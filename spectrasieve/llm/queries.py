"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrasieve.llm import alignment, bpe, exact_dedup, html_extract, ngram_join, packing, quality, simhash, spelling, token_counts, url_filter, vector_search, warc_audit, word_codec


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page, by templates deduced per host."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every whole text and of their decoding."""
    done = word_codec.encode_decode(table(spark, sf_dir, "documents"), bpe.tokenizer_path("word_bpe_49k.json"), full=False)
    return done.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of each document, a crossing token counted where it begins."""
    return token_counts.section_counts(table(spark, sf_dir, "documents"), bpe.tokenizer_path("byte_bpe_50k.json"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts and the row of each that stays."""
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"))


URL_BLOCK = ["net/", "example.com/de/"]
URL_ALLOW = ["example.net/en/", "org/fr/"]
URL_WORDS = ["ads", "track", "tracker", "spam", "casino", "bets", "poker", "pills", "adult", "porn", "xxx"]
URL_GLOBS = [*url_filter.host_word_globs(URL_WORDS), "**/login**", "**/cart/**", "**.exe"]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_BLOCK, URL_ALLOW, URL_GLOBS).drop("url")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), bpe.tokenizer_path("byte_bpe_50k.json"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates on shingles of five words at a Jaccard similarity of 0.75."""
    return ngram_join.link(table(spark, sf_dir, "documents"))


def op8_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit of all pages against a replica in which set records are damaged or lost."""
    pages = table(spark, sf_dir, "pages")
    at = F.lit(1) + F.pmod(F.col("page_id"), F.greatest(F.length("html"), F.lit(1)))
    damaged = F.concat(F.expr("left(html, at - 1)"), F.lit("#"), F.expr("substring(html, at + 1)"))
    replica = pages.where("not coalesce(page_id % 211 = 5, false)").withColumn("at", at.cast("int")).withColumn("html", F.when(F.col("page_id") % 101 == 7, damaged).otherwise(F.col("html")))
    return warc_audit.audit(pages, replica)


def op9_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest inner products of each row whose id is divisible by 50."""
    return vector_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text, learnt from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, the words one edit away and the form each is a variant of."""
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers' tokens in every whole text."""
    return alignment.align_documents(table(spark, sf_dir, "documents"), bpe.tokenizer_path("byte_bpe_50k.json"), bpe.tokenizer_path("piece_bpe_32k.model"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components that 4 differing bits or fewer link."""
    return simhash.link(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html_extract, op2_bpe_codec, op3_token_counts, op4_exact_dedup, op5_url_filter, op6_packing, op7_ngram_join, op8_warc_audit, op9_vector_search, op10_quality, op11_spelling, op12_alignment, op13_simhash)}


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
  count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

OP5_SQL = """
WITH u AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's')) AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path,
    regexp_extract(coalesce(url, ''), '^.*?://[^?#]*([^#]*)', 1, 's') AS tail
  FROM pages
), r AS (
  SELECT *, CASE
    WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM u
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
  WHEN rule IS NOT NULL THEN 'allow'
  WHEN regexp_matches('.' || host || path || tail, '^[^/]*[.-](ads|track|tracker|spam|casino|bets|poker|pills|adult|porn|xxx)[.-]|/login|/cart/|[.]exe$') THEN 'block'
  ELSE 'allow' END AS verdict
FROM r
"""

OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

OP8_SQL = """
WITH w AS (
  SELECT page_id, page_id // 1024 AS segment, html, 'WARC/1.0\\r\\nWARC-Type: response\\r\\nWARC-Record-ID: <urn:page:' || page_id || '>\\r\\nWARC-Target-URI: ' || url || '\\r\\nContent-Length: ' AS head,
    CASE WHEN page_id % 101 = 7 THEN left(html, page_id % length(html)) || '#' || substr(html, page_id % length(html) + 2) ELSE html END AS body
  FROM pages
), r AS (
  SELECT *, head || strlen(html) || '\\r\\n\\r\\n' || html || '\\r\\n\\r\\n' AS a, head || strlen(body) || '\\r\\n\\r\\n' || body || '\\r\\n\\r\\n' AS b FROM w
), o AS (
  SELECT page_id, segment, strlen(a) AS length, CAST(sum(strlen(a)) OVER (PARTITION BY segment ORDER BY page_id) - strlen(a) AS BIGINT) AS start, sha256(a) AS digest, sha256(b) AS other
  FROM r
)
SELECT page_id, segment, start, length, CASE WHEN page_id % 211 = 5 THEN 'missing' ELSE 'changed' END AS kind, digest,
  CASE WHEN page_id % 211 = 5 THEN NULL ELSE other END AS replica_digest
FROM o WHERE page_id % 211 = 5 OR digest <> other
""".replace("\\r", "' || chr(13) || '").replace("\\n", "' || chr(10) || '")


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": OP4_SQL, "op5_url_filter": OP5_SQL, "op8_warc_audit": OP8_SQL, "op9_vector_search": OP9_SQL}
