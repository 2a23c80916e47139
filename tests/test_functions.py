import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spectrasieve import model
from spectrasieve.functions import order_stats, peaks
from spectrasieve.operators import basis, calibrate, centroid, lasso, noise


def spectrum(start, n, at, floor, h=0.125, s=0.34):
    mz = start + h * np.arange(n)
    y = np.full(n, float(floor))
    for c, a in at:
        y += a * np.exp(-((mz - c) ** 2) / (2 * s * s))
    return mz, y.astype(np.float32).astype(float)


def design(mz, grid, s):
    return np.exp(-((mz[:, None] - grid) ** 2) / (2 * s * s))


def test_gram_row():
    for s, h in ((0.25, 0.125), (0.34, 0.125), (0.212, 1 / 30)):
        g = peaks.gram_row(s, h)
        assert g[0] == pytest.approx(s * math.sqrt(math.pi) / h, abs=1e-12)
        assert (np.diff(g) < 0).all() and g[-1] >= g[0] * 2**-52
    mz = 500 + 0.125 * np.arange(200)
    a = design(mz, mz, 0.25)
    full = a.T @ a
    g = peaks.gram_row(0.25, 0.125)
    assert full[100, 100] == pytest.approx(g[0], rel=0.05) and full[100, 101] == pytest.approx(g[1], rel=0.05)


def test_design_and_products():
    a = design(np.array([500.0, 500.34]), np.array([500.0]), 0.34)
    assert a[0, 0] == 1 and a[1, 0] == pytest.approx(math.exp(-0.5))
    mz, y = spectrum(498, 32, [(500, 1e4)], 0)
    grid = np.array([499.0, 500.0, 501.0])
    assert int((y @ design(mz, grid, 0.34)).argmax()) == 1


def test_grid():
    g = peaks.grid_positions(500, 501, 0.125)
    assert g[0] <= 500 and g[-1] >= 501 and np.allclose(np.round(g / 0.125) * 0.125, g, atol=1e-9)


def test_scan_rates():
    assert model.scan_rate("T")[4] == 0.340 and model.scan_rate("Ultra")[5] is None
    with pytest.raises(model.ConfigError):
        model.scan_rate("x")


def test_filter_codes(spark):
    rows = [(f"ITMS + p NSI {c} Full ms",) for c in "nrtu"] + [("FTMS p ESI n",), (None,), ("NSI N",)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(peaks.filter_code_sigma(F.col("s"))).collect()]
    assert got == [0.212, 0.255, 0.340, 0.849, None, None, None]
    near = spark.createDataFrame([(0.34,), (0.2335,)], "s double").select(peaks.nearest_scan_rate(F.col("s")).alias("r")).select("r.*").collect()
    assert (near[0].rate, near[0].fwhm) == (125.0, 0.8) and near[1].rate in (33.0, 67.0)


def test_ricker_and_scalogram():
    k = peaks.ricker(5.1)
    assert abs(k.sum()) < 1e-10 and k[len(k) // 2] > 0 and k[len(k) // 2 - 12] < 0
    y = np.zeros(101)
    y[50] = 1
    assert np.allclose(peaks.scalogram(y, (3.5,))[0][50 - 17 : 50 + 19], peaks.ricker(3.5)[1:], atol=1e-12) or len(peaks.scalogram(y)[0]) == 101


def test_rough_noise(spark):
    ramp = [float(v) for v in np.linspace(0, 1000, 10_000).astype(np.float32)]
    rows = [(0, ramp), (1, [0.0] * 20), (2, []), (3, [5.0]), (4, [float(i) for i in range(10)])]
    df = spark.createDataFrame(rows, "k int, y array<float>").select("k", order_stats.rough_noise(F.col("y")).alias("n")).select("k", "n.*")
    got = {r.k: (r.baseline, r.sigma) for r in df.collect()}
    assert 280 < got[0][1] < 450 and got[1] == (0.0, 1.0) and got[2] == (0.0, 1.0) and got[3] == (5.0, 1.0)
    for k, y in rows:
        assert centroid.rough_noise(np.array(y)) == pytest.approx(got[k])


def test_order_stats(spark):
    df = spark.createDataFrame([([3.0, 1.0, 2.0, 4.0],), ([],), ([7.0],)], "v array<double>")
    assert [r[0] for r in df.select(order_stats.upper_median(F.col("v"))).collect()] == [3.0, None, 7.0]
    axis = spark.createDataFrame([([1.0, 1.125, 1.25],), ([1.0],), ([],)], "v array<double>")
    assert [r[0] for r in axis.select(order_stats.grid_spacing(F.col("v")).spacing).collect()] == [0.125, 0.125, 0.125]


def test_three_point_fit(spark):
    mz, y = spectrum(499, 17, [(500.03, 1000)], 0)
    i = int(y.argmax())
    row = tuple(float(v) for v in (*mz[i - 1 : i + 2], *y[i - 1 : i + 2]))
    df = spark.createDataFrame([row, (1.0, 2.0, 3.0, 1.0, 1.0, 1.0)], "x0 double, x1 double, x2 double, y0 double, y1 double, y2 double")
    got = df.select(peaks.three_point_fit(*[F.col(c) for c in df.columns]).alias("f")).collect()
    assert got[0].f.center == pytest.approx(500.03, abs=0.02) and got[0].f.sigma == pytest.approx(0.34, abs=0.03) and got[1].f is None


def test_lasso_cases():
    g = peaks.gram_row(0.34, 0.125)

    def solve(start, n, at, lam, warm=None):
        mz, y = spectrum(start, n, at, 0)
        grid = mz.copy()
        aty = (y @ design(mz, grid, 0.34))[None]
        b, it, ok = lasso.solve(aty, np.array([n]), g, np.array([float(lam)]), warm)
        return grid, b[0], int(it[0]), bool(ok[0])

    grid, b, _, ok = solve(498, 32, [(500, 1e4)], 100)
    assert ok and 1 <= (b > 0).sum() <= 3 and abs(grid[b.argmax()] - 500) < 1.5 * 0.125
    assert (solve(497, 48, [(500, 1e4), (500.75, 1e4)], 50)[1] > 0).sum() >= 2
    b, *_ = lasso.solve(np.full((1, 24), 6.0), np.array([24]), g, np.array([1000.0]))
    assert not b.any()
    mz = 498 + 0.125 * np.arange(32)
    y = np.where(np.arange(32) % 2 == 0, 1000.0, -100.0)
    b, *_ = lasso.solve((y @ design(mz, mz, 0.34))[None], np.array([32]), g, np.array([1.0]))
    assert (b >= 0).all()
    _, cold_b, _, _ = solve(498, 32, [(500.375, 5000)], 50)
    _, _, cold, _ = solve(498, 32, [(500.375, 5000)], 45)
    _, _, warm, _ = solve(498, 32, [(500.375, 5000)], 45, cold_b[None])
    assert warm <= cold
    assert lasso.solve(np.zeros((0, 0)), np.zeros(0, int), g, np.zeros(0))[0].shape == (0, 0)


def plain_lasso(aty, g, lam, max_iter=2000, tol=1e-6):
    """The solver for one problem, written out plainly."""
    n = len(aty)
    beta = [0.0] * n
    rho = lambda j: aty[j] - sum(g[abs(j - k)] * beta[k] for k in range(n) if abs(j - k) < len(g)) + g[0] * beta[j]
    active = [j for j in range(n) if aty[j] > lam]
    for it in range(max_iter):
        if it % 10 == 0:
            active += [j for j in range(n) if j not in active and rho(j) > lam]
        worst, stay = 0.0, []
        for j in active:
            r = rho(j)
            new = max(0.0, r - lam) / g[0]
            worst = max(worst, abs(new - beta[j]))
            beta[j] = new
            if new > 0 or r > lam:
                stay.append(j)
        active = stay
        if worst < tol:
            break
    return beta, it + 1


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.floats(498.5, 501), st.floats(100, 1e4)), min_size=1, max_size=3), st.floats(5, 300))
def test_lasso_batch_equals_plain(at, lam):
    g = peaks.gram_row(0.34, 0.125)
    problems = []
    for k in (18, 24):
        mz, y = spectrum(498, k, at, 1)
        problems.append(y @ design(mz, mz, 0.34))
    aty = np.zeros((2, 24))
    for i, p in enumerate(problems):
        aty[i, : len(p)] = p
    b, it, _ = lasso.solve(aty, np.array([18, 24]), g, np.array([lam, lam]), max_iter=300)
    for i, p in enumerate(problems):
        want, n = plain_lasso(p.tolist(), g.tolist(), lam, 300)
        assert abs(int(it[i]) - n) <= 2 and np.allclose(b[i, : len(p)], want, rtol=1e-3, atol=1e-2)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.floats(498.5, 504), st.floats(100, 1e5)), min_size=1, max_size=6), st.floats(5, 300), st.integers(0, 9))
def test_direct_start_is_the_optimum(at, lam, seed):
    g = peaks.gram_row(0.34, 0.125)
    mz, y = spectrum(498, 60, at, 1)
    y = y + np.random.default_rng(seed).normal(0, 20, 60)
    aty = np.stack([y @ design(mz, mz, 0.34), np.zeros(60)])
    aty[1, :24] = y[:24] @ design(mz[:24], mz[:24], 0.34)
    size, pen = np.array([60, 24]), np.array([lam, lam])
    full = lasso._full(g, 60)
    loss = lambda b: 0.5 * np.einsum("ij,ij->i", b @ full, b) - np.einsum("ij,ij->i", aty - pen[:, None], b)
    swept, _, done = lasso.solve(aty, size, g, pen)
    for warm in (None, swept):
        start = lasso.direct(aty, size, g, pen, warm)
        assert (start >= 0).all() and not start[1, 24:].any()
        b, sweeps, ok = lasso.solve(aty, size, g, pen, start)
        slope = aty - pen[:, None] - b @ full
        top = np.abs(aty).max() + 1
        assert ok.all() and (sweeps <= 11).all() and (slope[0] < 1e-6 * top).all() and (slope[1, :24] < 1e-6 * top).all()
        assert (loss(b) <= loss(swept) + 1e-9 * np.abs(loss(swept)) + 1e-6).all()
        assert np.allclose(b[done].sum(1), swept[done].sum(1), rtol=1e-2, atol=1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(100, 2000), st.floats(0, 20)), min_size=1, max_size=6), st.sampled_from([0.125, 1 / 15, 0.3]), st.floats(0, 0.2))
def test_grid_ranges_equal_grid_positions(at, spacing, offset):
    lo = np.array([a for a, _ in at])
    hi = lo + np.array([w for _, w in at])
    for x, y, a, b in zip(lo, hi, *peaks.grid_range(lo, hi, spacing, offset), strict=True):
        assert (peaks.grid_positions(x, y, spacing, offset) == offset + np.arange(a, b + 1) * spacing).all()


def test_refine_beats_the_grid():
    x = 499.875 + 0.125 * np.arange(5)
    b = 1000 * np.exp(-((x - 500.05) ** 2) / (2 * 0.34**2))
    _, mz, a = lasso.refine(b[None], x[None])
    i = int(a.argmax())
    assert abs(mz[i] - 500.05) < abs(x[i] - 500.05)


B = (centroid.Basis.of(0.34, 0.125),) * 2


def one(mz, y, **kw):
    m, a, s = centroid.centroid_batch([2], [mz], [y], B, model.Config(**kw))[0]
    return np.array(m), np.array(a), s


def test_pipeline_cases():
    m, a, _ = one(*spectrum(490, 160, [(500.25, 1e4)], 5))
    assert abs(m[a.argmax()] - 500.25) < 0.25
    m, a, _ = one(*spectrum(494, 160, [(500, 1e4), (500.625, 1e4)], 5))
    assert len(m) >= 2 and min(abs(m - 500)) < 0.2 and min(abs(m - 500.625)) < 0.2
    assert len(one(np.zeros(0), np.zeros(0))[0]) == 0
    assert len(one(*spectrum(490, 160, [], 5))[0]) <= 3
    m, _, _ = one(*spectrum(494, 160, [(500.0625, 1e4)], 5))
    near = m[abs(m - 500.0625) < 1]
    assert len(near) == 1 and abs(near[0] - 500.0625) < 0.125


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.floats(492, 508), st.floats(50, 1e5)), max_size=6), st.integers(0, 1000))
def test_pipeline_invariants(at, seed):
    mz, y = spectrum(490, 160, at, 5)
    y = np.abs(y + np.random.default_rng(seed).normal(0, 3, len(y)))
    m, a, s = one(mz, y, noise_window_da=2.0, noise_step_da=0.5)
    assert (np.diff(m) > 0).all() and (a > 0).all() and s[3] == len(m)
    both = centroid.centroid_batch([2, 1, 2], [mz, mz[:2], mz], [y, y[:2], y], B, model.Config(noise_window_da=2.0, noise_step_da=0.5))
    assert np.allclose(both[0][0], m) and np.allclose(both[2][0], m) and len(both[1][0]) == 0


def test_merge_conserves_area(spark):
    rng = np.random.default_rng(1)
    mz = np.sort(rng.uniform(200, 210, 60))
    a = rng.uniform(1, 100, 60)
    m, area = centroid.merge(mz, a, 0.34)
    assert sum(area) == pytest.approx(a.sum())
    df = spark.createDataFrame([([(float(x), float(v)) for x, v in zip(mz, a, strict=True)],), ([],)], "c array<struct<mz:double,intensity:double>>")
    got = df.select(peaks.greedy_merge(F.col("c"), F.lit(0.34)).alias("c")).collect()
    assert np.allclose([c.mz for c in got[0].c], m) and np.allclose([c.intensity for c in got[0].c], area) and got[1].c == []


def test_noise_interpolation_and_refit(spark):
    knots = [(300.0, 20.0), (500.0, 40.0), (700.0, 30.0)]
    df = spark.createDataFrame([(knots, x) for x in (400.0, 100.0, 900.0, 500.0)] + [([], 1.0)], "k array<struct<center:double,noise:double>>, x double")
    assert [r[0] for r in df.select(noise.at(F.col("k"), F.col("x"))).collect()] == [30.0, 20.0, 30.0, 40.0, None]
    f = spark.createDataFrame([(100.0, 125.0), (100.0, 115.0), (0.0, 5.0)], "a double, b double")
    assert [r[0] for r in f.select(noise.needs_refit(F.col("a"), F.col("b"))).collect()] == [True, False, False]
    assert spark.createDataFrame([([3.0, 4.0],), ([],)], "v array<double>").select(noise.rms(F.col("v"))).collect()[0][0] == pytest.approx(math.sqrt(12.5))


def test_calibration(spark):
    rows = []
    for i in range(6):
        mz, y = spectrum(300 + 100 * i - 40, 640, [(300 + 100 * i, 5e4)], 0)
        rows.append((i, 2, None, mz.tolist(), y.tolist()))
    mz, y = spectrum(350, 1000, [(600, 1000)], 0, h=1 / 15)
    rows.append((6, 1, "ITMS + p NSI r Full ms", mz.tolist(), y.tolist()))
    df = spark.createDataFrame(rows, "scan_number long, ms_level int, filter_string string, mz array<double>, intensity array<double>")
    got = calibrate.calibrate(df)
    assert 0.6 < got["sigma_ms2"] / 0.34 < 1.4 and got["n_peaks_ms2"] >= 3 and got["grid_spacing_ms2"] == pytest.approx(0.125, abs=1e-6)
    assert got["sigma_ms1"] == 0.255 and got["n_peaks_ms1"] == 1 and got["grid_spacing_ms1"] == pytest.approx(1 / 15, abs=1e-9)
    fixed = calibrate.calibrate(df, model.Config(sigma=0.5, sigma_ms1=0.4, grid_spacing=0.2))
    assert (fixed["sigma_ms1"], fixed["sigma_ms2"], fixed["grid_spacing_ms2"]) == (0.4, 0.5, 0.2)
    assert calibrate.calibrate(df.limit(0))["sigma_ms2"] == model.FALLBACK_SIGMA


def test_spike_is_narrow():
    y = np.zeros(200)
    y[100] = 1000
    best, scale = calibrate.envelope(y)
    at = calibrate.isolated(best, 0.1 * best.max(), 8)
    assert len(at) == 1 and model.SCALES[scale[at[0]]] * model.SCALE_TO_SIGMA <= 2.0


def test_config(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text("input: a.mzML\nlambda_factor: 2.5\nscan_rate: rapid\n")
    c = model.Config.load(str(p), lambda_factor=4.0)
    assert c.lambda_factor == 4.0 and c.input == ("a.mzML",) and c.sigma_for(2) == 0.255 and c.spacing() == 1 / 15
    p.write_text("nope: 1")
    with pytest.raises(model.ConfigError):
        model.Config.load(str(p))


def test_level_basis(spark):
    b = basis.level_basis(spark, (0.255, 0.34), (1 / 15, 0.125))
    s = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "spectrum_id long, ms_level int")
    assert {r.spectrum_id: r.sigma for r in basis.with_basis(s, b).collect()} == {1: 0.255, 2: 0.34, 3: 0.34}
