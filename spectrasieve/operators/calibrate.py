"""Calibration of peak width and grid spacing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectrasieve import model
from spectrasieve.functions import order_stats, peaks

KEY = "spectrum_id"


def envelope(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greatest response over the scales at each point, at least 0, and the first scale that gives it."""
    s = np.maximum(peaks.scalogram(y), 0.0)
    return s.max(0), s.argmax(0)


def isolated(best: np.ndarray, threshold: float, radius: int) -> np.ndarray:
    """Local maxima above the threshold with no other within ``radius`` points."""
    up = np.flatnonzero((best[1:-1] > threshold) & (best[1:-1] > best[:-2]) & (best[1:-1] > best[2:])) + 1
    far = np.diff(up) > radius
    return up[np.concatenate([[True], far]) & np.concatenate([far, [True]])] if len(up) else up


def estimates(y: np.ndarray, spacing: float, fraction: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """(place, sigma) of each isolated peak of a spectrum, the width from the wavelet scale that answers most."""
    none = np.zeros(0, np.int64), np.zeros(0)
    if len(y) < 3:
        return none
    best, scale = envelope(y)
    least = fraction * np.sort(best)[min(len(best) * 99 // 100, len(best) - 1)]
    if least <= 0:
        return none
    at = isolated(best, least, round(1 / spacing))
    return at, np.array(model.SCALES)[scale[at]] * model.SCALE_TO_SIGMA * spacing


def sigma_estimates(spectra: DataFrame, spacing: float, fraction: float = 0.1) -> DataFrame:
    """(spectrum_id, idx, sigma): a width for each isolated peak, see :func:`estimates`."""

    def task(batches):
        import pyarrow as pa

        for b in batches:
            cols = [[], [], []]
            for key, y in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                at, sigma = estimates(np.asarray(y.values if y.is_valid else [], np.float64), spacing, fraction)
                cols[0] += [key] * len(at)
                cols[1] += at.tolist()
                cols[2] += sigma.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.float64()), strict=True)], [KEY, "idx", "sigma"])

    return spectra.select(F.col(KEY).cast("long"), "intensity").mapInArrow(task, f"{KEY} long, idx int, sigma double")


def mad_filter(estimates: DataFrame) -> DataFrame:
    """Estimates within two MADs of the upper median (the MAD is at least a hundredth of it).

    Estimates take one value a scale, so their distinct values with counts, which reach the driver, are as few.
    """
    counts = sorted((r.sigma, r.n) for r in estimates.groupBy("sigma").agg(F.count("*").alias("n")).collect())
    if not counts:
        return estimates

    def middle(pairs):
        rank, seen = sum(n for _, n in pairs) // 2, 0
        for value, n in sorted(pairs):
            seen += n
            if seen > rank:
                return value

    median = middle(counts)
    mad = middle([(abs(v - median), n) for v, n in counts])
    return estimates.where(F.abs(F.col("sigma") - F.lit(median)) <= 2 * max(mad, 0.01 * median))


def agreement(codes: DataFrame, first: int = 10, tolerance: float = 1e-6) -> DataFrame:
    """(ms_level, sigma, n): the sigma on which a level's first spectra agree by filter code, else null.

    ``codes`` has ms_level, scan_number and sigma; the first ``first`` spectra count whether or not they have a code.
    """
    w = Window.partitionBy("ms_level").orderBy("scan_number")
    head = codes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= first)
    got = head.groupBy("ms_level").agg(F.min("sigma").alias("lo"), F.max("sigma").alias("hi"), F.count("sigma").alias("n"))
    return got.select("ms_level", F.when(F.col("hi") - F.col("lo") < tolerance, F.col("lo")).alias("sigma"), "n")


def _middle(x: np.ndarray) -> float:
    return float(np.sort(x)[len(x) // 2])


CALIBRATION = "sigma_ms1 double, grid_spacing_ms1 double, n_peaks_ms1 long, sigma_ms2 double, grid_spacing_ms2 double, n_peaks_ms2 long"


def of_first(levels: list[int], codes: list[float | None], mzs: list[np.ndarray], ys: list[np.ndarray], config: model.Config, agree: int = 10) -> dict:
    """What :func:`calibrate` gives, from a file's first spectra in order: their levels, the widths of their filter codes, and arrays."""
    out: dict = {}
    for level, default in ((1, 1 / 15), (2, 0.125)):
        own = [i for i, v in enumerate(levels) if v == level]
        spacing = config.spacing()
        if spacing is None:
            gaps = np.diff(mzs[own[0]]) if own else np.zeros(0)
            spacing = (_middle(gaps) if len(gaps) else 0.125) if own else default
        known = [codes[i] for i in own[:agree] if codes[i] is not None]
        sigma, n = config.sigma_for(level), 0
        if sigma is None and not own:
            sigma = model.FALLBACK_SIGMA
        elif sigma is None and known and max(known) - min(known) < 1e-6:
            sigma, n = min(known), len(own)
        elif sigma is None:
            found = np.concatenate([np.zeros(0), *(estimates(ys[i], spacing)[1] for i in own)])
            n, sigma = len(found), model.FALLBACK_SIGMA
            if n >= 5:
                away = np.abs(found - _middle(found))
                kept = found[away <= 2 * max(_middle(away), 0.01 * _middle(found))]
                n, sigma = len(kept), float(kept.mean())
        out |= {f"sigma_ms{level}": float(sigma), f"grid_spacing_ms{level}": float(spacing), f"n_peaks_ms{level}": n}
    return out


def calibrate_files(spectra: DataFrame, config: model.Config | None = None, key: str = "file", order: str = "scan_number") -> DataFrame:
    """A row a file (or other ``key``): key and what :func:`calibrate` gives for it. A group holds a file's first spectra alone.

    ``spectra`` holds the key, ms_level, mz, intensity and perhaps filter_string; spectra without a key have a row of their own.
    """
    config = config or model.Config()
    s = spectra if "filter_string" in spectra.columns else spectra.withColumn("filter_string", F.lit(None).cast("string"))
    s = s.select(F.col(key).alias("key"), F.col(order).cast("long").alias("place"), "ms_level", "mz", "intensity", peaks.filter_code_sigma(F.col("filter_string")).alias("code"))
    head = s.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("place"))).where(F.col("rank") <= config.n_calibration_spectra)
    kind = dict(spectra.dtypes)[key]

    def one(table):
        import pyarrow as pa

        table = table.sort_by("place")
        arrays = [[np.asarray(v.values if v.is_valid else [], np.float64) for v in table.column(c)] for c in ("mz", "intensity")]
        got = of_first(table.column("ms_level").to_pylist(), table.column("code").to_pylist(), *arrays, config)
        return pa.table({"key": table.column("key")[:1]} | {k: [v] for k, v in got.items()})

    return head.groupBy("key").applyInArrow(one, f"key {kind}, {CALIBRATION}").withColumnRenamed("key", key)


def calibrate(spectra: DataFrame, config: model.Config | None = None, order: str = "scan_number") -> dict:
    """sigma, spacing and number of peaks (or spectra) of level 1 and of level 2, from the first spectra in order.

    A set value wins; then filter codes on which the level's first ten spectra agree; then wavelet
    estimates after the MAD filter, or the fallback with fewer than five. Only a bounded number of spectra is read.
    """
    config = config or model.Config()
    head = spectra.withColumn("filter_string", F.lit(None).cast("string")) if "filter_string" not in spectra.columns else spectra
    head = head.select(F.col(order).cast("long").alias("scan_number"), "ms_level", "mz", "intensity", peaks.filter_code_sigma(F.col("filter_string")).alias("sigma")).orderBy("scan_number").limit(config.n_calibration_spectra).persist()
    agreed = {r.ms_level: r.sigma for r in agreement(head).collect()}
    gap = order_stats.upper_median(order_stats.gaps(F.col("mz")))
    firsts = {r.ms_level: r for r in head.groupBy("ms_level").agg(F.count("*").alias("n"), F.min_by(gap, "scan_number").alias("gap")).collect()}
    out: dict = {}
    for level, default in ((1, 1 / 15), (2, 0.125)):
        first, spacing = firsts.get(level), config.spacing()
        if spacing is None:
            spacing = (0.125 if first.gap is None else first.gap) if first else default
        sigma, n = config.sigma_for(level), 0
        if sigma is None and not first:
            sigma = model.FALLBACK_SIGMA
        elif sigma is None and agreed[level] is not None:
            sigma, n = agreed[level], first.n
        elif sigma is None:
            found = sigma_estimates(head.where(F.col("ms_level") == level).withColumnRenamed("scan_number", KEY).drop("sigma"), spacing).persist()
            n, sigma = found.count(), model.FALLBACK_SIGMA
            if n >= 5:
                n, sigma = mad_filter(found).agg(F.count("*"), F.avg("sigma")).first()
            found.unpersist()
        out |= {f"sigma_ms{level}": float(sigma), f"grid_spacing_ms{level}": float(spacing), f"n_peaks_ms{level}": n}
    head.unpersist()
    return out
