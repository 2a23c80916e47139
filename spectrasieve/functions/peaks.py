"""Scalar functions of peaks, grids and scan rates."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrasieve import model


def scan_rates(spark: SparkSession) -> DataFrame:
    """(rate, code, word, fwhm, sigma, grid_spacing): the scan-rate dimension."""
    return spark.createDataFrame(list(model.SCAN_RATES), "rate double, code string, word string, fwhm double, sigma double, grid_spacing double")


def filter_code_sigma(filter_string: Column) -> Column:
    """Sigma by the character after the first ``NSI ``; case counts; null if none is known."""
    code = F.regexp_extract(filter_string, "NSI (.)", 1)
    out = F.lit(None).cast("double")
    for _, letter, _, _, sigma, _ in model.SCAN_RATES:
        out = F.when(code == letter, F.lit(sigma)).otherwise(out)
    return out


def scan_rate_code(name: Column) -> Column:
    """The code letter of a scan rate given as a letter or word in any case; null if unknown."""
    out = F.lit(None).cast("string")
    for _, letter, word, *_ in model.SCAN_RATES:
        out = F.when(F.lower(name).isin(letter, word), F.lit(letter)).otherwise(out)
    return out


def nearest_scan_rate(sigma: Column) -> Column:
    """struct(rate, fwhm, sigma) of the scan rate with the nearest sigma, the first at equal distance."""
    best = F.array(*[F.struct(F.abs(F.lit(s) - sigma).alias("d"), F.lit(i).alias("i"), F.lit(r).alias("rate"), F.lit(f).alias("fwhm"), F.lit(s).alias("sigma")) for i, (r, _, _, f, s, _) in enumerate(model.SCAN_RATES)])
    b = F.array_min(best)
    return F.struct(b.rate.alias("rate"), b.fwhm.alias("fwhm"), b.sigma.alias("sigma"))


def fwhm(sigma: Column) -> Column:
    return sigma * 2.355


def area_scale(sigma: Column, spacing: Column) -> Column:
    """What turns an amplitude into an integrated area: sigma sqrt(2 pi) / h."""
    return sigma * F.sqrt(F.lit(2 * math.pi)) / spacing


def gram_row(sigma: float, spacing: float, eps: float = 2.0**-52) -> np.ndarray:
    """Inner products of a Gaussian with its k-th neighbour on the grid, until they fall below eps of the first."""
    top = 64
    while True:
        k = np.arange(top)
        g = sigma * math.sqrt(math.pi) / spacing * np.exp(-((k * spacing) ** 2) / (4 * sigma**2))
        low = np.flatnonzero(g[1:] < g[0] * eps)
        if len(low):
            return g[: low[0] + 1]
        top *= 2


def grid_range(lo: np.ndarray, hi: np.ndarray, spacing: float, offset: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """The first and last numbers k of the grid points offset + k spacing of :func:`grid_positions`, for many ranges at once."""
    first, last = (np.floor((lo - offset) / spacing) - 1).astype(np.int64), (np.ceil((hi - offset) / spacing) + 2).astype(np.int64)
    for _ in range(3):
        first += offset + first * spacing < lo - spacing
        last -= offset + last * spacing > hi + spacing
    return first, last


def grid_positions(lo: float, hi: float, spacing: float, offset: float = 0.0) -> np.ndarray:
    """Grid points from one spacing below ``lo`` to one above ``hi``."""
    k = np.arange(math.floor((lo - offset) / spacing) - 1, math.ceil((hi - offset) / spacing) + 3)
    g = offset + k * spacing
    return g[(g >= lo - spacing) & (g <= hi + spacing)]


def grid_column(lo: Column, hi: Column, spacing: float, offset: float = 0.0) -> Column:
    """The same as an array expression."""
    first = F.floor((lo - offset) / spacing) - 1
    last = F.ceil((hi - offset) / spacing) + 2
    g = F.transform(F.sequence(first, last), lambda k: F.lit(offset) + k * F.lit(spacing))
    return F.filter(g, lambda x: (x >= lo - spacing) & (x <= hi + spacing))


def log_parabola(x: Column, h: Column, y0: Column, y1: Column, y2: Column) -> Column:
    """Vertex of the parabola through the logarithms of three neighbours, x where it is not within half a step."""
    a = (F.ln(y0) - 2 * F.ln(y1) + F.ln(y2)) / (2 * h * h)
    off = -((F.ln(y2) - F.ln(y0)) / (2 * h)) / (2 * a)
    fine = (y0 > 0) & (y1 > 0) & (y2 > 0) & (h > 1e-9)
    return F.when(fine & (a < 0) & (F.abs(off) <= 0.5 * h), x + off).otherwise(x)


def three_point_fit(x0: Column, x1: Column, x2: Column, y0: Column, y1: Column, y2: Column) -> Column:
    """struct(center, sigma) of the Gaussian through three neighbours; null where there is none within two steps."""
    h = ((x1 - x0) + (x2 - x1)) / 2
    a = (F.ln(y0) - 2 * F.ln(y1) + F.ln(y2)) / (2 * h * h)
    b = (F.ln(y2) - F.ln(y0)) / (2 * h)
    center = x1 - b / (2 * a)
    fine = (y0 > 0) & (y1 > 0) & (y2 > 0) & (h >= 1e-9) & (a < 0) & (F.abs(center - x1) <= 2 * h)
    return F.when(fine, F.struct(center.alias("center"), F.sqrt(F.lit(-1.0) / (2 * a)).alias("sigma")))


def ricker(scale: float) -> np.ndarray:
    """The Ricker wavelet of radius ceil(5 scale), less its mean."""
    r = math.ceil(5 * scale)
    t = np.arange(-r, r + 1) / scale
    k = 2 / (math.sqrt(3 * scale) * math.pi**0.25) * (1 - t**2) * np.exp(-(t**2) / 2)
    return k - k.mean()


def scalogram(y: np.ndarray, scales=model.SCALES) -> np.ndarray:
    """Responses [scale, point] of the zero-padded signal to each wavelet."""
    out = np.empty((len(scales), len(y)))
    for row, s in zip(out, scales, strict=True):
        k = ricker(s)
        row[:] = np.convolve(y, k)[len(k) // 2 : len(k) // 2 + len(y)]
    return out


def greedy_merge(centroids: Column, least: Column) -> Column:
    """Fold centroids in order of m/z: one nearer than ``least`` to the running weighted mean joins it.

    ``centroids`` is array<struct<mz, intensity>>. A pair of no intensity keeps the running one.
    """
    pair = "struct<mz:double,intensity:double>"
    ordered = F.array_sort(centroids.cast(f"array<{pair}>"))
    start = F.struct(F.array().cast(f"array<{pair}>").alias("done"), F.lit(None).cast(pair).alias("cur"))

    def step(acc, nxt):
        total = acc.cur.intensity + nxt.intensity
        mean = (acc.cur.mz * acc.cur.intensity + nxt.mz * nxt.intensity) / total
        joined = F.when(total > 0, F.struct(mean.alias("mz"), total.alias("intensity"))).otherwise(acc.cur)
        near = nxt.mz - acc.cur.mz < least
        return (
            F.when(acc.cur.isNull(), F.struct(acc.done.alias("done"), nxt.cast(pair).alias("cur")))
            .when(near, F.struct(acc.done.alias("done"), joined.cast(pair).alias("cur")))
            .otherwise(F.struct(F.concat(acc.done, F.array(acc.cur)).alias("done"), nxt.cast(pair).alias("cur")))
        )

    return F.aggregate(ordered, start, step, lambda acc: F.when(acc.cur.isNull(), acc.done).otherwise(F.concat(acc.done, F.array(acc.cur))))
