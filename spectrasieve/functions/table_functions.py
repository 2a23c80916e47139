"""Table functions for SQL: the regions and the centroids of spectra.

``register(spark)`` makes them known to a session:

    SELECT s.spectrum_id, r.* FROM spectra s, LATERAL signal_regions(s.mz, s.intensity, 3.0D) r
    SELECT * FROM centroids_of_points(TABLE(points), sigma => 0.34D, spacing => 0.125D)

The second takes a table of points (spectrum_id, mz, intensity and perhaps ms_level); it asks for its rows by spectrum and in order of m/z itself.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from spectrasieve import model
from spectrasieve.operators import centroid


def _number(name: str, given: AnalyzeArgument | None, default: float | None = None) -> float | None:
    """The value of a constant argument."""
    if given is None or given.isConstantExpression and given.value is None:
        return default
    if not given.isConstantExpression or isinstance(given.value, (str, bytes)):
        raise ValueError(f"{name} must be a constant number")
    return float(given.value)


class SignalRegions:
    """(region_idx, start_idx, end_idx, mz_start, mz_end) of a spectrum's arrays, at a threshold of k sigma. Null arrays have none."""

    def eval(self, mz, intensity, k):
        x, y = (np.asarray([] if v is None else v, float) for v in (mz, intensity))
        baseline, sigma = centroid.rough_noise(y)
        start, end = centroid.regions(y, baseline + float(k) * sigma, 2, 3, 3)
        for i, (a, b) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
            yield i, a, b, float(x[a]), float(x[b])


class Centroids:
    """(spectrum_id, centroid_idx, mz, intensity) of a table of points, a spectrum a partition.

    Constants: sigma, spacing, window and step of the noise windows, threshold (in sigma), sweeps (a set number of them; else to the optimum).
    """

    @staticmethod
    def analyze(points: AnalyzeArgument, sigma: AnalyzeArgument, spacing: AnalyzeArgument, window: AnalyzeArgument | None = None, step: AnalyzeArgument | None = None, threshold: AnalyzeArgument | None = None, sweeps: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not points.isTable:
            raise ValueError("centroids_of_points takes a TABLE argument")
        fields = {f.name: f for f in points.dataType.fields}
        for name in ("spectrum_id", "mz", "intensity"):
            if name not in fields:
                raise ValueError(f"the table of points has no column {name}")
        for name, given in (("sigma", sigma), ("spacing", spacing)):
            if not (_number(name, given) or 0) > 0:
                raise ValueError(f"{name} must be above 0")
        for name, given in (("window", window), ("step", step), ("threshold", threshold), ("sweeps", sweeps)):
            _number(name, given)
        schema = StructType([StructField("spectrum_id", fields["spectrum_id"].dataType), StructField("centroid_idx", IntegerType()), StructField("mz", DoubleType()), StructField("intensity", DoubleType())])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("spectrum_id")], orderBy=[OrderingColumn("mz")])

    def __init__(self):
        self.key, self.level, self.x, self.y, self.given = None, 2, [], [], None

    def eval(self, points, sigma, spacing, window=None, step=None, threshold=None, sweeps=None):
        if self.given is None:
            self.key, self.given = points["spectrum_id"], (sigma, spacing, window, step, threshold, sweeps)
            self.level = points["ms_level"] or 2 if "ms_level" in points.__fields__ else 2
        if points["mz"] is not None and points["intensity"] is not None:
            self.x.append(float(points["mz"]))
            self.y.append(float(points["intensity"]))

    def terminate(self):
        if self.given is None:
            return
        sigma, spacing, window, step, threshold, sweeps = (None if v is None else float(v) for v in self.given)
        named = {"noise_window_da": window, "noise_step_da": step, "signal_threshold_sigma": threshold}
        if sweeps is not None:
            named |= {"max_lasso_iter": int(sweeps), "lasso_tol": 0.0}
        config = model.Config(**{k: v for k, v in named.items() if v is not None})
        basis = centroid.Basis.of(sigma, spacing)
        mz, area, _ = centroid.centroid_batch([int(self.level)], [np.array(self.x)], [np.array(self.y)], (basis, basis), config, direct=sweeps is None)[0]
        for i, (m, a) in enumerate(zip(mz, area, strict=True)):
            yield self.key, i, float(m), float(a)


def register(spark: SparkSession) -> None:
    """Make signal_regions and centroids_of_points known to a session's SQL."""
    spark.udtf.register("signal_regions", udtf(SignalRegions, returnType="region_idx int, start_idx int, end_idx int, mz_start double, mz_end double"))
    spark.udtf.register("centroids_of_points", udtf(Centroids))
