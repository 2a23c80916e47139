"""Vocabularies in OBO text as relations, and the transitive closure of what is a kind of what."""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spectrasieve import shared


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(terms, parents) of an OBO file: terms (id, name, obsolete) and parents (child, parent, relation).

    A stanza is a row of the text, so a file is read in parallel. Relations are is_a and the relationships that terms state, as part_of.
    """
    stanzas = spark.read.option("lineSep", "\n\n").text(path)
    stanzas = stanzas.select(F.regexp_replace("value", "\r", "").alias("v")).where(F.trim("v").startswith("[Term]"))
    of = lambda tag: F.nullif(F.regexp_extract("v", rf"(?m)^{tag}: *(.*?) *$", 1), F.lit(""))
    terms = stanzas.select(of("id").alias("id"), of("name").alias("name"), F.coalesce(of("is_obsolete") == "true", F.lit(False)).alias("obsolete"), "v").where("id is not null")
    kinds = F.transform(F.regexp_extract_all("v", F.lit(r"(?m)^is_a: *(\S+)")), lambda p: F.struct(p.alias("parent"), F.lit("is_a").alias("relation")))
    others = F.arrays_zip(F.regexp_extract_all("v", F.lit(r"(?m)^relationship: *\S+ +(\S+)")).alias("parent"), F.regexp_extract_all("v", F.lit(r"(?m)^relationship: *(\S+) +\S+")).alias("relation"))
    parents = terms.select(F.col("id").alias("child"), F.inline(F.concat(kinds, others)))
    return terms.drop("v"), parents


def closure(edges: DataFrame) -> DataFrame:
    """(child, ancestor): the transitive closure of (child, parent), without the terms themselves.

    Each round joins the relation so far with itself, so chains of n steps take about log n rounds; a round is a
    written table. Cycles are harmless: a term is then its own ancestor.
    """
    spark = edges.sparkSession
    base = f"{shared.folder(spark)}/closure-{uuid.uuid4().hex}"

    def cut(df: DataFrame, n: int) -> DataFrame:
        df.write.parquet(f"{base}/{n}")
        return spark.read.parquet(f"{base}/{n}")

    known, n = cut(edges.select("child", F.col("parent").alias("ancestor")).where("child is not null and ancestor is not null").distinct(), 0), 0
    size = known.count()
    while True:
        n += 1
        beyond = known.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("beyond"))
        further = known.join(beyond, "ancestor").select("child", F.col("beyond").alias("ancestor"))
        known = cut(known.unionByName(further).distinct(), n)
        before, size = size, known.count()
        if size == before:
            return known


def below(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """(child, ancestor): the rows of :func:`closure` whose ancestor is in ``asked`` (column parent; few rows).

    Each round takes a step down from the terms that the round before found, so only what is below those asked for is made: rounds are
    as many as the steps to the farthest term, and each is a written table. Cycles are harmless.
    """
    spark = edges.sparkSession
    base = f"{shared.folder(spark)}/below-{uuid.uuid4().hex}"

    def cut(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return again(df, name)

    def again(df: DataFrame, *names: str) -> DataFrame:
        return spark.read.schema(df.schema).parquet(*[f"{base}/{n}" for n in names])

    steps = cut(edges.select("child", "parent").where("child is not null and parent is not null").distinct(), "steps")
    last, n = cut(steps.join(F.broadcast(asked.select("parent").distinct()), "parent").select("child", F.col("parent").alias("ancestor")), "0"), 0
    while not last.isEmpty():
        n += 1
        further = steps.join(last.select(F.col("child").alias("parent"), "ancestor"), "parent").select("child", "ancestor").distinct()
        last = cut(further.join(again(last, *map(str, range(n))), ["child", "ancestor"], "left_anti"), str(n))
    return again(last, *map(str, range(n + 1)))


def allowed(rules: DataFrame, ancestors: DataFrame) -> DataFrame:
    """``rules`` (parent and more; few rows) with a row for each accession that is a kind of the parent, or the parent itself: column accession."""
    own = rules.select("*", F.col("parent").alias("accession"))
    return own.unionByName(ancestors.join(F.broadcast(rules), rules.parent == ancestors.ancestor).select(*rules.columns, F.col("child").alias("accession"))).distinct()


def failures(resolved: DataFrame, rules: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(file, element, path, parent, label): elements (file, element, path, accessions) without any term below a rule's parent."""
    return failures_of_terms(resolved.select("file", "element", "path", F.explode_outer("accessions").alias("accession")), rules, ancestors)


BITS = 62  # rules a set


def failures_of_terms(terms: DataFrame, rules: DataFrame, ancestors: DataFrame, keys: tuple[str, ...] = ("file", "element")) -> DataFrame:
    """(``keys``, path, parent, label): the same, each once, of elements with a row a term (``keys``, path, accession), of which null is none.

    A path's rules are bits of a number, a set of at most ``BITS`` of them. Each term is joined with the rules of a set that it fulfils, and an element's are or-ed.
    """
    block = F.floor((F.row_number().over(Window.partitionBy("path").orderBy("parent", "label")) - 1) / BITS)
    numbered = rules.select("path", "parent", "label").distinct().withColumn("block", block)
    numbered = numbered.select("path", "parent", "label", F.dense_rank().over(Window.orderBy("path", "block")).alias("rule_set"), (F.row_number().over(Window.partitionBy("path", "block").orderBy("parent", "label")) - 1).alias("place"))
    numbered = numbered.select("path", "parent", "label", "rule_set", F.expr("shiftleft(1L, place)").alias("bit"))
    known = allowed(numbered.select("rule_set", "parent", "bit"), ancestors).groupBy("accession", "rule_set").agg(F.bit_or("bit").alias("met"))
    asked = terms.join(F.broadcast(numbered.select("path", "rule_set").distinct()), "path").select(*keys, "rule_set", "accession")
    met = F.bit_or(F.when(reduce(and_, [F.col(k).isNotNull() for k in keys]), F.col("met")))  # what has no key has no terms
    found = asked.join(known, ["accession", "rule_set"], "left").groupBy(*keys, "rule_set").agg(F.coalesce(met, F.lit(0)).alias("met"))
    return found.join(F.broadcast(numbered), "rule_set").where(F.col("met").bitwiseAND(F.col("bit")) == 0).select(*keys, "path", "parent", "label")
