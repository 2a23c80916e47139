"""Grid, design and first LASSO sweep of regions, as relational operators."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrasieve.functions import peaks
from spectrasieve.operators import regions

KEY = "spectrum_id"


def level_basis(spark, sigma: tuple[float, float], spacing: tuple[float, float]) -> DataFrame:
    """The two-row basis dimension: level_class (1 or 2), sigma, spacing, g0, gram array<double>."""
    rows = [(i + 1, s, h, float(peaks.gram_row(s, h)[0]), peaks.gram_row(s, h).tolist()) for i, (s, h) in enumerate(zip(sigma, spacing, strict=True))]
    return spark.createDataFrame(rows, "level_class int, sigma double, spacing double, g0 double, gram array<double>")


def with_basis(spectra: DataFrame, basis: DataFrame) -> DataFrame:
    """Spectra with their level's basis; levels above 2 use that of 2. The basis has two rows, so it is broadcast."""
    level = F.when(F.col("ms_level") == 1, 1).otherwise(2)
    return spectra.withColumn("level_class", level).join(F.broadcast(basis), "level_class")


def grid(found: DataFrame, spacing: float, offset: float = 0.0) -> DataFrame:
    """(spectrum_id, region_idx, j, grid_mz): grid points of each region."""
    g = peaks.grid_column(F.col("mz_start"), F.col("mz_end"), spacing, offset)
    return found.select(KEY, "region_idx", F.posexplode(g).alias("j", "grid_mz"))


def aty(spectra: DataFrame, sigma: float, spacing: float, offset: float = 0.0, **parameters) -> DataFrame:
    """(spectrum_id, region_idx, j, grid_mz, aty): inner products of each grid Gaussian with its region's points.

    Regions, their slices of the arrays and their grids stay in the spectrum's row, so nothing is joined or shuffled.
    """
    found = regions.exploded(regions.with_regions(spectra, **parameters), KEY, "mz", "intensity")
    part = lambda c: F.slice(F.col(c), F.col("r.start_idx") + 1, F.col("r.end_idx") - F.col("r.start_idx") + 1)
    ends = [F.get("mz", F.col(f"r.{e}_idx")) for e in ("start", "end")]
    rows = found.select(KEY, "region_idx", F.arrays_zip(part("mz").alias("x"), part("intensity").alias("y")).alias("p"), F.posexplode_outer(peaks.grid_column(*ends, spacing, offset)).alias("j", "grid_mz")).where("j is not null")
    scale = F.lit(-1 / (2 * sigma * sigma))
    dot = F.aggregate("p", F.lit(0.0), lambda a, p: a + p.y.cast("double") * F.exp((p.x - F.col("grid_mz")) * (p.x - F.col("grid_mz")) * scale))
    return rows.select(KEY, "region_idx", "j", "grid_mz", dot.alias("aty"))


def first_sweep(products: DataFrame, noise: DataFrame, sigma: float, spacing: float, lambda_factor: float = 3.0) -> DataFrame:
    """Products with beta = max(0, aty - lambda) / g0: what every coefficient would be alone."""
    g0 = sigma * math.sqrt(math.pi) / spacing
    lam = F.col("noise_sigma") * lambda_factor
    return products.join(noise.select(KEY, "noise_sigma"), KEY).select(KEY, "region_idx", "j", "grid_mz", "aty", (F.greatest(F.col("aty") - lam, F.lit(0.0)) / g0).alias("beta"))


def reconstruct(axis: DataFrame, centroids: DataFrame, sigma: float, reach: float = 6.0, near: float | None = None) -> DataFrame:
    """(spectrum_id, mz, value): the sum of Gaussians of (spectrum_id, mz, intensity) at the axis' points.

    A centroid counts within ``reach`` sigma, so both sides meet in m/z bins, by an equi-join; what is left out of each is below exp(-reach^2 / 2)
    of its intensity (1.6e-8 for 6). Points without any centroid within ``near`` are left out, or have the value 0 if it is None.
    """
    width = reach * sigma
    bins = max(width, near or 0.0) * 1.001  # a little wider, so that rounding parts no pair at the very end of the reach
    left = axis.select(KEY, F.col("mz").alias("x")).withColumn("bin", F.floor(F.col("x") / bins))
    right = centroids.select(KEY, F.col("mz").alias("c"), "intensity").withColumn("bin", F.explode(F.array(*[F.floor(F.col("c") / bins) + k for k in (-1, 0, 1)])))
    value = F.when(F.abs(F.col("x") - F.col("c")) <= width, F.col("intensity") * F.exp(-F.pow((F.col("x") - F.col("c")) / sigma, 2) / 2))
    met = left.join(right, [KEY, "bin"], "left") if near is None else left.join(right, [KEY, "bin"]).where(F.col("c").between(F.col("x") - near, F.col("x") + near))
    return met.groupBy(KEY, F.col("x").alias("mz")).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("value"))


def residuals(spectra: DataFrame, centroids: DataFrame, sigma: float, reach: float = 6.0, **parameters) -> DataFrame:
    """(spectrum_id, region_idx, mz, squares, n): the sum of squares of what the Gaussians of ``centroids`` leave of each region's points, their number, and the region's centre."""
    found = regions.exploded(regions.with_regions(spectra, **parameters), KEY, "mz", "intensity")
    part = lambda c: F.slice(F.col(c), F.col("r.start_idx") + 1, F.col("r.end_idx") - F.col("r.start_idx") + 1)
    center = (F.get("mz", F.col("r.start_idx")) + F.get("mz", F.col("r.end_idx"))) / 2
    points = found.select(KEY, "region_idx", center.alias("center"), F.inline(F.arrays_zip(part("mz").alias("mz"), part("intensity").alias("y"))))
    fit = reconstruct(points.select(KEY, "mz").distinct(), centroids, sigma, reach)
    rest = F.col("y").cast("double") - F.col("value")
    return points.join(fit, [KEY, "mz"]).groupBy(KEY, "region_idx", F.col("center").alias("mz")).agg(F.sum(rest * rest).alias("squares"), F.count("*").alias("n"))
