"""Signal regions as gaps and islands over points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectrasieve.functions import order_stats
from spectrasieve.sources import views

KEY = "spectrum_id"


def noise_table(spectra: DataFrame) -> DataFrame:
    """(spectrum_id, n, baseline, noise_sigma): a row a spectrum, from its array alone."""
    noise = order_stats.rough_noise(F.col("intensity"))
    return spectra.select(KEY, F.size("intensity").alias("n"), noise.alias("s")).select(KEY, "n", "s.baseline", F.col("s.sigma").alias("noise_sigma"))


def with_noise(spectra: DataFrame) -> DataFrame:
    """Points with their spectrum's n, baseline and noise_sigma, without a join: each array is exploded beside its own noise."""
    noise = order_stats.rough_noise(F.col("intensity"))
    rows = spectra.select(KEY, F.size("intensity").alias("n"), noise.alias("s"), F.arrays_zip("mz", "intensity").alias("z"))
    return rows.select(KEY, "n", "s.baseline", F.col("s.sigma").alias("noise_sigma"), F.posexplode("z").alias("idx", "p")).select(KEY, "n", "baseline", "noise_sigma", "idx", "p.mz", F.col("p.intensity").cast("double").alias("intensity"))


def above(points: DataFrame, k: float = 3.0) -> DataFrame:
    """Points strictly above baseline + k sigma."""
    return points.where(F.col("intensity") > F.col("baseline") + F.lit(k) * F.col("noise_sigma"))


def segments(points: DataFrame, k: float = 3.0) -> DataFrame:
    """(spectrum_id, n, start_idx, end_idx): maximal runs of consecutive points above the threshold."""
    w = Window.partitionBy(KEY).orderBy("idx")
    runs = above(points, k).select(KEY, "n", "idx", (F.col("idx") - F.row_number().over(w)).alias("run"))
    return runs.groupBy(KEY, "n", "run").agg(F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx")).drop("run")


def merged(segs: DataFrame, gap: int = 2) -> DataFrame:
    """Segments joined where the next begins at most gap + 1 after the last end."""
    w = Window.partitionBy(KEY).orderBy("start_idx")
    new = F.coalesce((F.col("start_idx") > F.lag("end_idx").over(w) + gap + 1).cast("int"), F.lit(1))
    grouped = segs.withColumn("new", new).withColumn("island", F.sum("new").over(w))
    return grouped.groupBy(KEY, "n", "island").agg(F.min("start_idx").alias("start_idx"), F.max("end_idx").alias("end_idx")).drop("island")


def extended(islands: DataFrame, extension: int = 3, least_width: int = 3) -> DataFrame:
    """Islands widened on both sides, clamped to the spectrum; narrow ones go. They may overlap and stay so."""
    wide = islands.select(KEY, F.greatest(F.lit(0), F.col("start_idx") - extension).alias("start_idx"), F.least(F.col("n") - 1, F.col("end_idx") + extension).alias("end_idx"))
    return wide.where(F.col("end_idx") - F.col("start_idx") + 1 >= least_width)


def with_regions(spectra: DataFrame, k: float = 3.0, gap: int = 2, extension: int = 3, least_width: int = 3) -> DataFrame:
    """Spectra with ``regions array<struct<start_idx, end_idx>>``, found within the row: no shuffle.

    Of the indices above the threshold, those more than gap + 1 after the one before begin an island, those as far before the
    next end one.
    """

    def islands(up):
        begins = F.filter(up, lambda x, i: F.coalesce(x - F.get(up, i - 1) > gap + 1, F.lit(True)))
        ends = F.filter(up, lambda x, i: F.coalesce(F.get(up, i + 1) - x > gap + 1, F.lit(True)))
        wide = F.zip_with(begins, ends, lambda s, e: F.struct(F.greatest(F.lit(0), s - extension).alias("start_idx"), F.least(F.size("intensity") - 1, e + extension).alias("end_idx")))
        return F.filter(wide, lambda r: r.end_idx - r.start_idx + 1 >= least_width)

    def above(noise):
        limit = noise.baseline + F.lit(k) * noise.sigma
        return F.filter(F.transform("intensity", lambda y, i: F.when(y.cast("double") > limit, i)), lambda i: i.isNotNull())

    return spectra.withColumn("regions", order_stats.once(order_stats.once(order_stats.rough_noise(F.col("intensity")), above), islands))


def exploded(rows: DataFrame, *columns: str) -> DataFrame:
    """A row a region: the columns, region_idx and r. (The outer form keeps Spark from finding all regions twice, to filter empty lists.)"""
    return rows.select(*columns, F.posexplode_outer("regions").alias("region_idx", "r")).where("region_idx is not null")


def detect(spectra: DataFrame, k: float = 3.0, gap: int = 2, extension: int = 3, least_width: int = 3) -> DataFrame:
    """Signal regions: spectrum_id, region_idx, start_idx, end_idx, mz_start, mz_end, max_intensity, apex_idx.

    The same regions as segments, merged and extended give over points, without a shuffle; the apex is the first of the highest points.
    """
    rows = exploded(with_regions(spectra, k, gap, extension, least_width), KEY, "mz", "intensity")
    part = F.slice(F.col("intensity"), F.col("r.start_idx") + 1, F.col("r.end_idx") - F.col("r.start_idx") + 1)
    top = F.array_max(part)
    return rows.select(
        KEY,
        "region_idx",
        "r.start_idx",
        "r.end_idx",
        F.get("mz", F.col("r.start_idx")).alias("mz_start"),
        F.get("mz", F.col("r.end_idx")).alias("mz_end"),
        top.cast("double").alias("max_intensity"),
        (F.col("r.start_idx") + F.array_position(part, top).cast("int") - 1).alias("apex_idx"),
    )


def with_shape(regions: DataFrame) -> DataFrame:
    """Regions with width_points, width_mz and center_mz."""
    return regions.withColumns({"width_points": F.col("end_idx") - F.col("start_idx") + 1, "width_mz": F.col("mz_end") - F.col("mz_start"), "center_mz": (F.col("mz_start") + F.col("mz_end")) / 2})


def overlaps(regions: DataFrame) -> DataFrame:
    """Neighbouring regions of a spectrum that share points: (spectrum_id, left_idx, right_idx, shared)."""
    w = Window.partitionBy(KEY).orderBy("region_idx")
    nxt = regions.select(KEY, F.col("region_idx").alias("left_idx"), "end_idx", F.lead("region_idx").over(w).alias("right_idx"), F.lead("start_idx").over(w).alias("next_start"))
    return nxt.where("next_start <= end_idx").select(KEY, "left_idx", "right_idx", (F.col("end_idx") - F.col("next_start") + 1).alias("shared"))


def gap_points(spectra: DataFrame, regions: DataFrame) -> DataFrame:
    """Points in no region: each region's indices are listed and anti-joined, an equi-join."""
    inside = regions.select(KEY, F.explode(F.sequence("start_idx", "end_idx")).alias("idx"))
    return views.points(spectra).join(inside, [KEY, "idx"], "left_anti")


def gaps(spectra: DataFrame, **parameters) -> DataFrame:
    """Points in no region of their own spectrum, found within the row."""
    rows = with_regions(spectra, **parameters).select(KEY, "regions", F.posexplode(F.arrays_zip("mz", "intensity")).alias("idx", "p"))
    return rows.where(~F.exists("regions", lambda r: F.col("idx").between(r.start_idx, r.end_idx))).select(KEY, "idx", "p.mz", F.col("p.intensity").cast("double").alias("intensity"))


def coverage(spectra: DataFrame, regions: DataFrame) -> DataFrame:
    """(spectrum_id, n_points, n_covered, share): points in at least one region."""
    inside = regions.select(KEY, F.explode(F.sequence("start_idx", "end_idx")).alias("idx")).distinct().groupBy(KEY).agg(F.count("*").alias("c"))
    n = spectra.select(KEY, F.size("intensity").alias("n_points"))
    return n.join(inside, KEY, "left").select(KEY, "n_points", F.coalesce("c", F.lit(0)).alias("n_covered"), (F.coalesce("c", F.lit(0)) / F.col("n_points")).alias("share"))


def in_window(regions: DataFrame, lo: float, hi: float) -> DataFrame:
    """Regions that share any m/z with a window."""
    return regions.where((F.col("mz_end") >= lo) & (F.col("mz_start") <= hi))
