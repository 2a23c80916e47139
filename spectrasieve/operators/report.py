"""Inspection, accuracy reports and ion selection over centroids and spectra."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectrasieve import shared
from spectrasieve.functions import order_stats

KEY = "spectrum_id"


def inspect(spectra: DataFrame) -> DataFrame:
    """Per spectrum: n_points, mz_first, mz_last, max_intensity, median_gap."""
    n = F.size("mz")
    return spectra.select(
        KEY,
        "ms_level",
        n.alias("n_points"),
        F.coalesce(F.get("mz", F.lit(0)), F.lit(0.0)).alias("mz_first"),
        F.coalesce(F.get("mz", n - 1), F.lit(0.0)).alias("mz_last"),
        F.coalesce(F.array_max("intensity"), F.lit(0.0)).cast("double").alias("max_intensity"),
        F.coalesce(order_stats.upper_median(order_stats.gaps(F.col("mz"))), F.lit(0.0)).alias("median_gap"),
    )


def summary(inspected: DataFrame) -> DataFrame:
    """One row: spectra, those of level 1 and of others, points."""
    return inspected.agg(F.count("*").alias("n_spectra"), F.count_if(F.col("ms_level") == 1).alias("n_ms1"), F.count_if(F.col("ms_level") != 1).alias("n_other"), F.sum("n_points").alias("n_points"))


def _maxima(spectra: DataFrame) -> DataFrame:
    y = F.col("intensity")
    inner = F.filter(F.sequence(F.lit(1), F.greatest(F.size(y) - 2, F.lit(1))), lambda i: (i < F.size(y) - 1) & (F.get(y, i) > F.get(y, i - 1)) & (F.get(y, i) > F.get(y, i + 1)))
    return spectra.where(F.size("intensity") >= 3).select(KEY, "mz", "intensity", F.explode_outer(inner).alias("idx")).where("idx is not null")


def local_maxima(spectra: DataFrame) -> DataFrame:
    """(spectrum_id, idx, mz, intensity): points above both neighbours, from the arrays alone."""
    return _maxima(spectra).select(KEY, "idx", F.get("mz", F.col("idx")).alias("mz"), F.get("intensity", F.col("idx")).cast("double").alias("intensity"))


def triples(spectra: DataFrame) -> DataFrame:
    """(spectrum_id, idx, x0, x1, x2, y0, y1, y2): local maxima with both neighbours' m/z and intensity."""
    at = lambda c, k: F.get(c, F.col("idx") + k).cast("double")
    return _maxima(spectra).select(KEY, "idx", *[at(c, k).alias(f"{n}{k + 1}") for n, c in (("x", "mz"), ("y", "intensity")) for k in (-1, 0, 1)])


def isolated(maxima: DataFrame, radius: int) -> DataFrame:
    """Maxima with no other within ``radius`` points: neighbours decide, so no self-join."""
    w = Window.partitionBy(KEY).orderBy("idx")
    near = F.least(F.coalesce(F.col("idx") - F.lag("idx").over(w), F.lit(1 << 30)), F.coalesce(F.lead("idx").over(w) - F.col("idx"), F.lit(1 << 30)))
    return maxima.withColumn("near", near).where(F.col("near") > radius).drop("near")


def nearest(centroids: DataFrame, targets: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """(spectrum_id, target, mz, intensity, delta): the centroid nearest to each target, the first at equal distance.

    Targets and centroids meet in bins of twice the tolerance: an equi-join, whatever their numbers.
    """
    width = 2 * tolerance
    t = targets.select("target").withColumn("bin", F.explode(F.array(*[F.floor(F.col("target") / width) + k for k in (-1, 0, 1)])))
    near = centroids.withColumn("bin", F.floor(F.col("mz") / width)).join(t, "bin").withColumn("delta", F.col("mz") - F.col("target")).where(F.abs("delta") <= tolerance)
    best = near.groupBy(KEY, "target").agg(F.min(F.struct(F.abs("delta").alias("d"), "mz", "intensity", "delta")).alias("b"))
    return best.select(KEY, "target", "b.mz", "b.intensity", "b.delta")


def counted_median(values: DataFrame, key: str, width: float) -> DataFrame:
    """(key, median): the exact median of v by key of (key, v, c), where c counts equal values; the mean of both middle values if the counts' sum is even.

    Counts in bins of ``width`` tell which bin holds the middle, and only that bin's values are put in order, so that no task takes
    all values of a large group.
    """
    values = values.withColumn("bin", F.floor(F.col("v") / width))
    before = F.sum("n").over(Window.partitionBy(key).orderBy("bin")) - F.col("n")
    bins = values.groupBy(key, "bin").agg(F.sum("c").alias("n")).withColumns({"before": before, "all": F.sum("n").over(Window.partitionBy(key))})
    low, high = F.floor((F.col("all") - 1) / 2), F.floor(F.col("all") / 2)
    middle = bins.where((F.col("before") <= high) & (F.col("before") + F.col("n") > low)).select(key, "bin", "before", low.alias("low"), high.alias("high"))
    end = F.col("before") + F.sum("c").over(Window.partitionBy(key, "bin").orderBy("v"))
    ranked = values.join(middle, [key, "bin"]).withColumn("end", end)
    at = lambda r: F.max(F.when((F.col("end") > F.col(r)) & (F.col("end") - F.col("c") <= F.col(r)), F.col("v")))
    return ranked.groupBy(key).agg(((at("low") + at("high")) / 2).alias("median"))


def median(rows: DataFrame, key: str, value: str, width: float) -> DataFrame:
    """(key, median): the exact median of a column by key; equal values are counted before the shuffle."""
    return counted_median(rows.where(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("v")).agg(F.count("*").alias("c")), key, width)


def delta_summary(deltas: DataFrame, by: list[str], width: float = 1e-3) -> DataFrame:
    """n, mean, median and MAD (the median distance from the median) of delta by the columns, with subtotals and a total (null keys).

    Deltas are counted once, by value and key, in a written table, of which all else is made.
    """
    kinds, spark = deltas.schema, deltas.sparkSession
    sets = [F.struct(F.lit(i).alias("depth"), *[(F.col(c) if k < len(by) - i else F.lit(None).cast(kinds[c].dataType)).alias(c) for k, c in enumerate(by)]) for i in range(len(by) + 1)]
    rows = deltas.groupBy(*by, F.col("delta").alias("v")).agg(F.count("*").alias("c")).select("v", "c", F.explode(F.array(*sets)).alias("g"))
    counted = rows.groupBy(F.to_json("g").alias("key"), "g", "v").agg(F.sum("c").alias("c"))
    counted.write.parquet(at := f"{shared.folder(spark)}/deltas-{uuid.uuid4().hex}")
    counted = spark.read.parquet(at)
    mean = F.sum(F.col("v") * F.col("c")) / F.sum(F.when(F.col("v").isNotNull(), F.col("c")))
    one = counted.groupBy("key", "g").agg(F.sum("c").alias("n"), mean.alias("mean"))
    known = counted.where("v is not null").select("key", "v", "c")
    mid = counted_median(known, "key", width)
    away = known.join(mid, "key").groupBy("key", F.abs(F.col("v") - F.col("median")).alias("v")).agg(F.sum("c").alias("c"))
    got = one.join(mid, "key", "left").join(counted_median(away, "key", width).withColumnRenamed("median", "mad"), "key", "left")
    return got.select(*[f"g.{c}" for c in by], "n", "mean", "median", "mad")


def compare_methods(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Deltas of two methods side by side; either may be missing."""
    left = a.select(*by, F.col("delta").alias("delta_a"))
    right = b.select(*by, F.col("delta").alias("delta_b"))
    return left.join(right, by, "full").select(*by, "delta_a", "delta_b", (F.abs("delta_a") - F.abs("delta_b")).alias("gain"))


def centroid_gaps(centroids: DataFrame, edges: tuple[float, float, int]) -> DataFrame:
    """(bucket, n, least): histogram of the distances of neighbouring centroids."""
    lo, hi, n = edges
    return _gaps(centroids).groupBy(F.width_bucket("gap", F.lit(float(lo)), F.lit(float(hi)), F.lit(n)).alias("bucket")).agg(F.count("*").alias("n"), F.min("gap").alias("least"))


def _gaps(centroids: DataFrame) -> DataFrame:
    gap = F.col("mz") - F.lag("mz").over(Window.partitionBy(KEY).orderBy("mz"))
    return centroids.select(KEY, gap.alias("gap")).where("gap is not null")


def gap_summary(centroids: DataFrame) -> DataFrame:
    """(spectrum_id, n, median_gap, least_gap, most_intensity): a spectrum's centroids and the distances of neighbours.

    A spectrum's gaps are few, so their exact percentile fits the aggregate; one centroid has no gap.
    """
    gaps = _gaps(centroids).groupBy(KEY).agg(F.percentile("gap", 0.5).alias("median_gap"), F.min("gap").alias("least_gap"))
    return centroids.groupBy(KEY).agg(F.count("*").alias("n"), F.max("intensity").alias("most_intensity")).join(gaps, KEY, "left").select(KEY, "n", "median_gap", "least_gap", "most_intensity")


def top_ions(centroids: DataFrame, k: int = 10) -> DataFrame:
    """(spectrum_id, mz, intensity, rank, half): the k strongest, and whether the ion lies in their lower or upper half by m/z."""
    strongest = Window.partitionBy(KEY).orderBy(F.desc("intensity"), "mz")
    top = centroids.select(KEY, "mz", "intensity").withColumn("rank", F.row_number().over(strongest)).where(F.col("rank") <= k)
    place = F.row_number().over(Window.partitionBy(KEY).orderBy("mz"))
    return top.withColumn("half", F.when(place <= k // 2, 1).otherwise(2))


def crop(spectra: DataFrame, lo: float, hi: float) -> DataFrame:
    """Spectra with only the points of lo <= mz <= hi, in both arrays."""
    z = F.filter(F.arrays_zip("mz", "intensity"), lambda p: (p.mz >= lo) & (p.mz <= hi))
    return spectra.withColumn("z", z).withColumns({"mz": F.transform("z", lambda p: p.mz), "intensity": F.transform("z", lambda p: p.intensity)}).drop("z")


def replace_range(kept: DataFrame, redone: DataFrame, ranges: DataFrame) -> DataFrame:
    """Centroids of ``kept`` outside all ``ranges`` (spectrum_id, mz_start, mz_end) of their spectrum, and all of ``redone``."""
    per = ranges.groupBy(KEY).agg(F.collect_list(F.struct("mz_start", "mz_end")).alias("r"))
    rest = kept.join(per, KEY, "left").where(F.col("r").isNull() | ~F.exists("r", lambda x: F.col("mz").between(x.mz_start, x.mz_end)))
    return rest.drop("r").unionByName(redone)


def in_scan_range(ions: DataFrame, spectra: DataFrame) -> DataFrame:
    """(spectrum_id, target): theoretical ions that lie within a spectrum's own m/z range."""
    ranges = spectra.where(F.size("mz") > 0).select(KEY, F.get("mz", F.lit(0)).alias("lo"), F.get("mz", F.size("mz") - 1).alias("hi"))
    listed = ions.groupBy().agg(F.array_sort(F.collect_set("target")).alias("all"))
    return ranges.join(F.broadcast(listed)).select(KEY, F.explode(F.filter("all", lambda t: (t >= F.col("lo")) & (t <= F.col("hi")))).alias("target"))
