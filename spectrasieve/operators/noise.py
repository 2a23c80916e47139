"""Noise refinement over exploded points: sliding windows, smoothing, interpolation, refit test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "spectrum_id"


def windows(spectra: DataFrame, gap: DataFrame, window: float, step: float, least: int = 5, residuals: DataFrame | None = None) -> DataFrame:
    """(spectrum_id, w, center, n, rms): root mean square of gap points in windows sliding over m/z, with the residuals of regions
    (spectrum_id, mz, squares, n; see basis.residuals), each of which counts where its centre lies.

    A point lies in at most window / step + 1 windows; their numbers follow from its m/z, so a point is
    exploded to them and no range join is needed. Windows of fewer than ``least`` points or without signal are left out.
    """
    ends = spectra.select(KEY, F.get("mz", F.lit(0)).alias("first"), F.get("mz", F.size("mz") - 1).alias("last")).where("first is not null")
    parts = gap.select(KEY, "mz", (F.col("intensity") * F.col("intensity")).alias("squares"), F.lit(1).cast("long").alias("n"))
    p = (parts if residuals is None else parts.unionByName(residuals.select(KEY, "mz", "squares", "n"))).join(ends, KEY)
    lo = F.greatest(F.lit(0), F.ceil((F.col("mz") - F.col("first") - window) / step) - 1)
    hi = F.floor((F.col("mz") - F.col("first")) / step) + 1
    center = F.col("first") + F.lit(window / 2) + F.col("w") * F.lit(step)
    each = p.withColumn("w", F.explode(F.sequence(lo, F.greatest(lo, hi)))).withColumn("center", center)
    inside = each.where((F.col("center") <= F.col("last") - window / 2) & F.col("mz").between(F.col("center") - window / 2, F.col("center") + window / 2))
    got = inside.groupBy(KEY, "w", "center").agg(F.sum("n").alias("n"), F.sqrt(F.sum("squares") / F.sum("n")).alias("rms"))
    return got.where((F.col("n") >= least) & (F.col("rms") > 0))


def floored(win: DataFrame, noise: DataFrame) -> DataFrame:
    """(spectrum_id, w, center, noise): the windows' rms, at least a tenth of the spectrum's rough sigma."""
    return win.join(noise.select(KEY, "noise_sigma"), KEY).select(KEY, "w", "center", F.greatest("rms", F.col("noise_sigma") * 0.1).alias("noise"))


def smoothed(knots: DataFrame) -> DataFrame:
    """Knots with the upper median of each and its neighbours; fewer than three stay as they are."""
    w = Window.partitionBy(KEY).orderBy("center")
    near = F.array_sort(F.collect_list("noise").over(w.rowsBetween(-1, 1)))
    n = F.count("*").over(Window.partitionBy(KEY))
    return knots.withColumn("smooth", F.when(n < 3, F.col("noise")).otherwise(F.get(near, F.floor(F.size(near) / 2).cast("int"))))


def knots(smooth: DataFrame) -> DataFrame:
    """(spectrum_id, knots): a spectrum's knots as one sorted array, of bounded length."""
    return smooth.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("center", F.col("smooth").alias("noise")))).alias("knots"))


def at(knots: Column, mz: Column) -> Column:
    """Linear interpolation between the bracketing knots, clamped at both ends; null without knots."""
    below = F.filter(knots, lambda k: k.center < mz)
    above = F.filter(knots, lambda k: k.center >= mz)
    a, b = F.get(below, F.size(below) - 1), F.get(above, F.lit(0))
    line = a.noise + (b.noise - a.noise) * ((mz - a.center) / (b.center - a.center))
    return F.when(F.size(below) == 0, b.noise).when(F.size(above) == 0, a.noise).otherwise(line)


def needs_refit(rough: Column, refined: Column, threshold: float = 0.2) -> Column:
    """Whether lambda moved by more than ``threshold`` of itself; false where it was not positive."""
    return F.coalesce(F.when(rough > 0, F.abs(refined - rough) / rough > threshold), F.lit(False))


def rms(values: Column) -> Column:
    """Root mean square of an array, 0 if empty."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.when(F.size(values) > 0, F.sqrt(total / F.size(values))).otherwise(F.lit(0.0))
