"""Profile spectra out of ordinary tables.

Two shapes of one thing: ``spectra`` has a row a spectrum with parallel arrays, ``points`` a row
a point. The m/z axis is 200 + idx / 8.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VIEWS = ("emb", "evt", "li")


def with_axis(df: DataFrame) -> DataFrame:
    """(spectrum_id, ms_level, mz, intensity) of (spectrum_id, intensity array<float>)."""
    mz = F.transform("intensity", lambda _, i: F.lit(200.0) + i * F.lit(0.125))
    return df.select(F.col("spectrum_id").cast("long"), F.lit(2).cast("short").alias("ms_level"), mz.alias("mz"), "intensity")


def _rows(spark: SparkSession, sf_dir: str, view: str) -> tuple[DataFrame, str, list[str], Column]:
    """The table of a view with a row a point, its key, the columns that order a key's rows, and the value."""
    if view == "evt":
        t = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id is not null")
        return t, "user_id", ["ts", "event_id"], F.col("value")
    if view == "li":
        t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_suppkey is not null")
        return t, "l_suppkey", [c for c in t.columns if c != "l_suppkey"], F.col("l_extendedprice")
    raise ValueError(f"views are {VIEWS}")


def row_points(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """The points of ``evt`` or ``li`` without gathering a key's rows in an array."""
    t, key, order, value = _rows(spark, sf_dir, view)
    y = value.cast("float")
    idx = F.row_number().over(Window.partitionBy(key).orderBy(*order, y)) - 1
    return t.select(F.col(key).cast("long").alias("spectrum_id"), idx.alias("idx"), (F.lit(200.0) + idx * F.lit(0.125)).alias("mz"), y.cast("double").alias("intensity"))


def spectra(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """A row a spectrum. ``evt`` and ``li`` gather a key's rows in order, ``emb`` reads arrays without a shuffle."""
    if view == "emb":
        t = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
        return with_axis(t.select(F.col("vec_id").alias("spectrum_id"), F.transform("embedding", lambda x: (F.greatest(x.cast("double"), F.lit(0.0)) * 1000).cast("float")).alias("intensity")))
    t, key, order, value = _rows(spark, sf_dir, view)
    rows = t.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, value.cast("float").alias("y")))).alias("r"))
    return with_axis(rows.select(F.col(key).alias("spectrum_id"), F.transform("r", lambda r: r.y).alias("intensity")))


def points(spectra: DataFrame) -> DataFrame:
    """(spectrum_id, idx, mz, intensity double): a row a point."""
    return spectra.select("spectrum_id", F.posexplode(F.arrays_zip("mz", "intensity")).alias("idx", "p")).select("spectrum_id", "idx", "p.mz", F.col("p.intensity").cast("double").alias("intensity"))


# The same views for DuckDB.
SQL = {
    "emb": """SELECT vec_id AS spectrum_id, generate_subscripts(embedding, 1) - 1 AS idx,
  CAST(CAST(greatest(CAST(unnest(embedding) AS DOUBLE), CAST(0 AS DOUBLE)) * 1000 AS FLOAT) AS DOUBLE) AS intensity FROM embeddings""",
    "evt": """SELECT user_id AS spectrum_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id, value) - 1 AS idx,
  CAST(CAST(value AS FLOAT) AS DOUBLE) AS intensity FROM events WHERE user_id IS NOT NULL""",
    "li": """SELECT l_suppkey AS spectrum_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS idx,
  CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE) AS intensity FROM lineitem WHERE l_suppkey IS NOT NULL""",
}


def points_sql(view: str) -> str:
    """``p``: the points of a view, as a common table expression."""
    return f"p AS (SELECT spectrum_id, CAST(idx AS INTEGER) AS idx, CAST(200 AS DOUBLE) + idx * CAST(0.125 AS DOUBLE) AS mz, intensity FROM ({SQL[view]}))"
