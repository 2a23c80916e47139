"""The two-pass centroiding of spectra, as a kernel over Arrow batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrasieve import model
from spectrasieve.functions import peaks
from spectrasieve.operators import lasso


@dataclass(frozen=True)
class Basis:
    """The Gaussian dictionary of one level."""

    sigma: float
    spacing: float
    offset: float
    gram: np.ndarray

    @classmethod
    def of(cls, sigma: float, spacing: float, offset: float = 0.0) -> Basis:
        return cls(sigma, spacing, offset, peaks.gram_row(sigma, spacing))

    def scale(self) -> float:
        return self.sigma * np.sqrt(2 * np.pi) / self.spacing


def rough_noise(y: np.ndarray) -> tuple[float, float]:
    """(baseline, sigma) by rank: see functions.order_stats.rough_noise."""
    n = len(y)
    if not n:
        return 0.0, 1.0
    p10, p25, p75 = np.partition(y, sorted({n // 10, n // 4, n * 3 // 4}))[[n // 10, n // 4, n * 3 // 4]]
    p10 = max(float(p10), 0.0)
    return p10, max(float(p75 - p25) / 1.349, p10 * 0.1, 1.0)


def regions(y: np.ndarray, threshold: float, gap: int, extension: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) inclusive: runs above the threshold, merged over small gaps, then widened."""
    up = np.flatnonzero(np.diff(np.concatenate([[0], (y > threshold).astype(np.int8), [0]])))
    start, end = up[::2], up[1::2] - 1
    if len(start):
        new = np.concatenate([[True], start[1:] > end[:-1] + gap + 1])
        first = np.flatnonzero(new)
        start, end = start[first], end[np.append(first[1:] - 1, len(end) - 1)]
    start, end = np.maximum(start - extension, 0), np.minimum(end + extension, len(y) - 1)
    wide = end - start + 1 >= least
    return start[wide], end[wide]


def noise_knots(mz, y, outside, centers, squares, counts, floor, window, step) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the refined noise: root mean square of gap points and residuals in sliding windows, smoothed by a median of three.

    ``squares`` and ``counts`` are the sums of squares and the numbers of the residuals of the regions at ``centers``.
    """
    if not len(mz):
        return np.zeros(0), np.zeros(0)
    gx, gy = mz[outside], y[outside]
    square = np.concatenate([[0.0], np.cumsum(gy * gy)])
    order = np.argsort(centers, kind="stable")
    cx = centers[order]
    rs, rn = (np.concatenate([[0], np.cumsum(np.asarray(c)[order])]) for c in (squares, counts))
    center = np.cumsum([mz[0] + window / 2, *[step] * max(0, int((mz[-1] - mz[0] - window) / step) + 2)])  # one sum after the other
    center = center[center <= mz[-1] - window / 2]
    a, b = np.searchsorted(gx, center - window / 2, "left"), np.searchsorted(gx, center + window / 2, "right")
    c, d = np.searchsorted(cx, center - window / 2, "left"), np.searchsorted(cx, center + window / 2, "right")
    n = b - a + rn[d] - rn[c]
    rms = np.where(n >= 5, np.sqrt(np.maximum(square[b] - square[a] + rs[d] - rs[c], 0.0) / np.maximum(n, 1)), 0.0)
    x, v = center[rms > 0], np.maximum(rms[rms > 0], floor * 0.1)
    if len(v) >= 3:
        low, high = np.minimum(v[:-2], v[1:-1]), np.maximum(v[:-2], v[1:-1])
        inner = np.maximum(low, np.minimum(high, v[2:]))
        v = np.concatenate([[max(v[0], v[1])], inner, [max(v[-2], v[-1])]])
    return x, v


def merge(mz: np.ndarray, area: np.ndarray, least: float) -> tuple[list[float], list[float]]:
    """Fold sorted centroids: one nearer than ``least`` to the running weighted mean joins it."""
    out_m, out_a = [], []
    for m, a in zip(mz.tolist(), area.tolist(), strict=True):
        if out_m and m - out_m[-1] < least:
            total = out_a[-1] + a
            if total > 0:
                out_m[-1] = (out_m[-1] * out_a[-1] + m * a) / total
                out_a[-1] = total
        else:
            out_m.append(m)
            out_a.append(a)
    return out_m, out_a


_NONE = np.zeros(0)


class _Region:
    __slots__ = ("area", "aty", "beta", "end", "first", "mz", "owner", "penalty", "size", "square", "start", "x", "y")


def _groups(batch: list[_Region], ratio: float, most: int, points: bool):
    """Regions in order of their grids' sizes, in groups of at most ``most`` entries (of grid or grid by points) and sizes alike by ``ratio``."""
    at = 0
    while at < len(batch):
        width, end, tall = batch[at].size, at, 1
        while end < len(batch) and batch[end].size <= width * ratio + 8:
            tall = max(tall, len(batch[end].x)) if points else 1
            if end > at and (end - at + 1) * tall * batch[end].size > most:
                break
            end += 1
        yield batch[at:end]
        at = end


def _padded(arrays: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(arrays), width))
    for i, a in enumerate(arrays):
        out[i, : len(a)] = a
    return out


def _grid(part: list[_Region], basis: Basis) -> np.ndarray:
    return basis.offset + (np.array([r.first for r in part])[:, None] + np.arange(max(r.size for r in part))) * basis.spacing


def _gaussians(x: np.ndarray, at: np.ndarray, sigma: float) -> np.ndarray:
    """[region, point, Gaussian]: the value at each point of a unit Gaussian around each place."""
    d = x[:, :, None] - at[:, None, :]
    d *= d
    d *= -1 / (2 * sigma**2)
    return np.exp(d, out=d)


def _project(batch: list[_Region], basis: Basis) -> None:
    """The inner products of each region's intensities with its Gaussians.

    From one grid point to the next a Gaussian's value changes by a factor that itself changes by a constant one; exponentials are
    taken anew every eight sigma, so neither rounding nor underflow adds up.
    """
    h, width = basis.spacing / basis.sigma, max(1, int(8 * basis.sigma / basis.spacing))
    for part in _groups(batch, 1.5, 1 << 20, True):
        points, grid = max(len(r.x) for r in part), _grid(part, basis)
        x, y = _padded([r.x for r in part], points), _padded([r.y for r in part], points)
        aty = np.empty_like(grid)
        for k0 in range(0, grid.shape[1], width):
            d = (x - grid[:, k0, None]) / basis.sigma
            e, ratio = np.exp(-0.5 * d * d), np.exp(np.clip(d, -40, 40) * h - 0.5 * h * h) if width > 1 else None
            for k in range(k0, min(k0 + width, grid.shape[1])):
                aty[:, k] = np.einsum("ij,ij->i", e, y)
                if width > 1:
                    e *= ratio
                    ratio *= np.exp(-h * h)
        for r, row in zip(part, aty, strict=True):
            r.aty = row[: r.size]


def _solve(batch: list[_Region], basis: Basis, config: model.Config, warm: bool, direct: bool) -> None:
    """Solve regions together; ``direct``: sweeps begin where solved active blocks end."""
    batch.sort(key=lambda r: (r.size, len(r.x)))
    if not warm:
        _project(batch, basis)
    for part in _groups(batch, 4.0, 4_000_000, False):
        size, penalty, grid = np.array([r.size for r in part]), np.array([r.penalty for r in part]), _grid(part, basis)
        aty, start = _padded([r.aty for r in part], grid.shape[1]), _padded([r.beta for r in part], grid.shape[1]) if warm else None
        if direct:
            start = lasso.direct(aty, size, basis.gram, penalty, start)
        beta, _, _ = lasso.solve(aty, size, basis.gram, penalty, start, config.max_lasso_iter, config.lasso_tol)
        row, mz, amplitude = lasso.refine(beta, grid)
        cuts = np.searchsorted(row, np.arange(len(part) + 1)).tolist()
        area = amplitude * basis.scale()
        for i, r in enumerate(part):
            r.mz, r.area, r.beta = mz[cuts[i] : cuts[i + 1]], area[cuts[i] : cuts[i + 1]], beta[i, : r.size]
    if not warm:
        _leave(batch, basis)


def _leave(batch: list[_Region], basis: Basis) -> None:
    """The sum of squares of what the fitted Gaussians leave of each region's intensities."""
    for part in _groups(batch, 1.5, 1 << 20, True):
        points, width = max(len(r.x) for r in part), max(r.size for r in part)
        x, y, beta = _padded([r.x for r in part], points), _padded([r.y for r in part], points), _padded([r.beta for r in part], width)
        on = beta > 0
        at = np.argsort(~on, axis=1, kind="stable")[:, : max(1, int(on.sum(1).max()))]
        fit = np.matmul(_gaussians(x, np.take_along_axis(_grid(part, basis), at, 1), basis.sigma), np.take_along_axis(beta, at, 1)[:, :, None])[:, :, 0]
        rest = np.where(np.arange(points) < np.array([len(r.x) for r in part])[:, None], y - fit, 0.0)
        for r, v in zip(part, np.einsum("ij,ij->i", rest, rest).tolist(), strict=True):
            r.square = v


def centroid_batch(levels: list[int], mzs: list[np.ndarray], ys: list[np.ndarray], bases: tuple[Basis, Basis], config: model.Config, direct: bool = True) -> list[tuple]:
    """(centroid m/z, area, statistics) of each spectrum. ``bases`` are those of level 1 and of all others; see :func:`centroid` for ``direct``."""
    state, todo = [], ([], [])
    for s, (level, mz, y) in enumerate(zip(levels, mzs, ys, strict=True)):
        which = 0 if level == 1 else 1
        basis = bases[which]
        if len(mz) < 3 or len(y) < 3:
            state.append(None)
            continue
        baseline, sigma = rough_noise(y)
        penalty = config.lambda_factor * sigma
        start, end = regions(y, baseline + config.signal_threshold_sigma * sigma, config.merge_gap_points, config.extension_points, config.min_region_width)
        first, last = peaks.grid_range(mz[start], mz[end], basis.spacing, basis.offset)
        own = []
        for a, b, lo, hi in zip(start.tolist(), end.tolist(), first.tolist(), last.tolist(), strict=True):
            r = _Region()
            r.owner, r.start, r.end, r.penalty = s, a, b, penalty
            r.x, r.y = mz[a : b + 1], y[a : b + 1]
            r.first, r.size = lo, hi - lo + 1 if b > a else 0
            r.beta = r.mz = r.area = _NONE
            own.append(r)
        todo[which].extend(r for r in own if r.size > 0)
        state.append((which, sigma, penalty, own))
    for which in (0, 1):
        _solve(todo[which], bases[which], config, False, direct)

    again = ([], [])
    first: list[list] = []
    refits = [0] * len(levels)
    for s, known in enumerate(state):
        first.append([])
        if known is None:
            continue
        which, sigma, penalty, own = known
        basis, mz, y = bases[which], mzs[s], ys[s]
        solved = [r for r in own if len(r.mz)]
        first[-1] = [(r.mz, r.area) for r in solved]
        if not solved:
            continue
        outside = np.ones(len(mz), bool)
        for r in own:
            outside[r.start : r.end + 1] = False
        centers = np.array([(mz[r.start] + mz[r.end]) / 2 for r in solved])
        knots, value = noise_knots(mz, y, outside, centers, [r.square for r in solved], [len(r.x) for r in solved], sigma, config.noise_window_da, config.noise_step_da)
        noise = np.interp(centers, knots, value) if len(knots) else np.full(len(centers), sigma)
        for r, v in zip(solved, noise, strict=True):
            new = config.lambda_factor * float(v)
            if penalty > 0 and abs(new - penalty) / penalty > config.lambda_change_threshold:
                r.penalty = new
                again[which].append(r)
                refits[s] += 1
    moved = [{id(r) for r in a} for a in again]
    for which in (0, 1):
        _solve(again[which], bases[which], config, True, direct)

    out = []
    for s, known in enumerate(state):
        if known is None:
            out.append(([], [], (0, 0, 0, 0, 0.0, 0.0)))
            continue
        which, _, penalty, own = known
        if config.by_region:  # each region keeps its own centroids
            found = [(r.mz, r.area) for r in own]
            m, a = (np.concatenate(c) if found else np.zeros(0) for c in (list(zip(*found, strict=True)) or ([], [])))
        else:  # a refitted region replaces every centroid within its range
            m, a = (np.concatenate([f[i] for f in first[s]] or [np.zeros(0)]) for i in (0, 1))
            for r in own:
                if id(r) in moved[which]:
                    lo, hi = mzs[s][r.start], mzs[s][r.end]
                    rest = (m < lo) | (m > hi)
                    m, a = np.concatenate([m[rest], r.mz]), np.concatenate([a[rest], r.area])
        order = np.argsort(m, kind="stable")
        least = bases[which].sigma if config.min_centroid_separation is None else config.min_centroid_separation
        m, a = merge(m[order], a[order], least)
        out.append((m, a, (len(own), len(own), refits[s], len(m), bases[which].sigma, penalty)))
    return out


def centroid(spectra: DataFrame, config: model.Config, sigma: tuple[float, float] | None, spacing: tuple[float, float] | None, keys: tuple[str, ...] = ("spectrum_id",), batch: int = 256, direct: bool = True) -> DataFrame:
    """Centroids and statistics of each spectrum: keys, centroids array<struct<mz, intensity>>, stats struct.

    ``spectra`` holds the keys, ms_level, mz and intensity; ``sigma`` and ``spacing`` are those of level 1 and of all
    others, or None: then each spectrum's columns sigma and spacing hold its own, see :func:`centroid_files`. With ``direct`` the LASSO's sweeps begin near the optimum, from solved active blocks, and confirm it; without, they begin at 0 and
    may end at the limit of sweeps before it. No shuffle; memory is ``batch`` spectra. Spectra with null or fewer than three points have no centroids.
    """
    offset = config.grid_offset or 0.0
    bases = tuple(Basis.of(s, h, offset) for s, h in zip(sigma, spacing, strict=True)) if sigma else None
    own = [] if sigma else ["sigma", "spacing"]
    named = [f for f in spectra.schema.fields if f.name in keys]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in named] + [f"centroids array<struct<{model.CENTROID.replace(' ', ':')}>>".replace(",:", ","), "stats struct<" + ", ".join(x.replace(" ", ":", 1) for x in model.STATS.split(", ")) + ">"])

    def task(batches):
        import pyarrow as pa

        pair = pa.struct([("mz", pa.float64()), ("intensity", pa.float64())])
        counts = [x.split()[0] for x in model.STATS.split(", ")]
        stat = pa.struct([(c, pa.int32() if i < 4 else pa.float64()) for i, c in enumerate(counts)])
        for whole in batches:
            for at in range(0, len(whole), batch):
                b = whole.slice(at, batch)
                arrays = [[np.asarray(v.values if v.is_valid else [], np.float64) for v in b.column(c)] for c in ("mz", "intensity")]
                levels = [v or 2 for v in b.column("ms_level").to_pylist()]
                if bases:
                    got = centroid_batch(levels, *arrays, bases, config, direct)
                else:
                    got = [None] * len(b)
                    pairs = list(zip(*(b.column(c).to_pylist() for c in own), strict=True))
                    for width in set(pairs):
                        mine = [i for i, p in enumerate(pairs) if p == width]
                        made = centroid_batch([levels[i] for i in mine], *([a[i] for i in mine] for a in arrays), (Basis.of(*width, offset),) * 2, config, direct)
                        for i, g in zip(mine, made, strict=True):
                            got[i] = g
                flat = [np.concatenate([np.asarray(g[i], np.float64) for g in got] or [np.zeros(0)]) for i in (0, 1)]
                offsets = np.cumsum([0, *(len(g[0]) for g in got)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(f) for f in flat], fields=list(pair)))
                stats = pa.array([dict(zip(counts, g[2], strict=True)) for g in got], stat)
                yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in named), lists, stats], [*(f.name for f in named), "centroids", "stats"])

    rows = spectra.select(*(f.name for f in named), "ms_level", F.col("mz"), F.col("intensity"), *own)
    return rows.mapInArrow(task, schema)


def centroid_files(spectra: DataFrame, calibrations: DataFrame, config: model.Config, keys: tuple[str, ...] = ("file", "scan_number"), key: str = "file", direct: bool = True) -> DataFrame:
    """Centroids of the spectra of many files as one job, each file's by its own row of ``calibrations`` (see calibrate.calibrate_files)."""
    first = F.col("ms_level") == 1
    cal = calibrations.withColumnRenamed(key, "__key")
    rows = spectra.join(cal, F.col(key).eqNullSafe(F.col("__key")))
    rows = rows.withColumns({c: F.when(first, F.col(f"{n}_ms1")).otherwise(F.col(f"{n}_ms2")) for c, n in (("sigma", "sigma"), ("spacing", "grid_spacing"))})
    return centroid(rows, config, None, None, keys, direct=direct)


def rows(centroided: DataFrame) -> DataFrame:
    """A row a centroid: keys, centroid_idx, mz, intensity."""
    keys = [c for c in centroided.columns if c not in ("centroids", "stats")]
    return centroided.select(*keys, F.posexplode("centroids").alias("centroid_idx", "c")).select(*keys, "centroid_idx", "c.mz", "c.intensity")
