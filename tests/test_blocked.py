import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrasieve.functions import table_functions
from spectrasieve.operators import basis, blocked, noise, regions
from spectrasieve.sources import views

POINTS = "spectrum_id long, idx int, mz double, intensity double"


def several(seed=2):
    """Spectra of many ties, of none, of negatives, of one and of two points."""
    rng = np.random.default_rng(seed)
    out = [np.repeat(5.0, 40), np.arange(37) % 7 * 100.0, -np.arange(21.0), np.array([3.0]), np.array([1.0, 1e6])]
    for n in (16, 17, 333):
        y = np.round(np.abs(rng.normal(5, 5, n)), 1)
        y[rng.integers(0, n, n // 5)] += rng.integers(10, 5000, n // 5)
        out.append(y)
    return [np.float32(y).astype(float) for y in out]


@pytest.mark.parametrize("size", [1, 2, 5, 16, 1000])
def test_blocks_of_any_size_equal_whole_spectra(spark, size):
    ys = several()
    whole = spark.createDataFrame([(k, (200 + 0.125 * np.arange(len(y))).tolist(), y.tolist()) for k, y in enumerate(ys)], "spectrum_id long, mz array<double>, intensity array<float>")
    parts = blocked.blocks(views.points(whole), size)
    assert parts.agg(F.max(F.size("points"))).first()[0] <= size
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(blocked.noise_table(parts)) == key(regions.noise_table(whole))
    columns = ["spectrum_id", "region_idx", "start_idx", "end_idx", "mz_start", "mz_end", "max_intensity", "apex_idx"]
    for k in (0.5, 3.0):
        assert key(blocked.detect(parts, size, k).select(columns)) == key(regions.detect(whole, k).select(columns))
    assert blocked.detect(parts.where("false"), size).count() == 0


def test_table_functions(spark):
    table_functions.register(spark)
    got = spark.sql("SELECT * FROM VALUES (1, array(1D, 2D, 3D, 4D, 5D), array(1F, 1F, 90F, 1F, 1F)), (2, null, null) AS s(k, mz, y), LATERAL signal_regions(s.mz, s.y, 3.0D)").collect()
    assert [(r.k, r.start_idx, r.end_idx, r.mz_end) for r in got] == [(1, 0, 4, 5.0)]
    points = spark.createDataFrame([("b", 500 + 0.125 * i, float(1e4 * np.exp(-((0.125 * i - 5) ** 2) / (2 * 0.34**2)) + 5)) for i in range(80)] + [("a", 1.0, None), ("c", None, 1.0)], "spectrum_id string, mz double, intensity double")
    call = "SELECT * FROM centroids_of_points(TABLE(SELECT * FROM {p}), sigma => %s, spacing => 0.125D)"
    rows = spark.sql(call % "0.34D", p=points).collect()
    assert rows and {r.spectrum_id for r in rows} == {"b"} and min(abs(r.mz - 505) for r in rows) < 0.05
    for bad, frame in (("0.0D", points), ("'x'", points), ("0.34D", points.drop("mz"))):
        with pytest.raises(Exception, match="sigma|no column mz"):
            spark.sql(call % bad, p=frame).collect()


def test_residuals_without_centroids_are_the_points(spark):
    y = several()[-1]
    s = spark.createDataFrame([(1, (200 + 0.125 * np.arange(len(y))).tolist(), y.tolist()), (2, [], [])], "spectrum_id long, mz array<double>, intensity array<float>")
    none = spark.createDataFrame([], "spectrum_id long, mz double, intensity double")
    got = basis.residuals(s, none, 0.34).collect()
    want = {r.region_idx: y[r.start_idx : r.end_idx + 1] for r in regions.detect(s).collect()}
    assert {r.region_idx for r in got} == set(want)
    assert all(r.n == len(want[r.region_idx]) and r.squares == pytest.approx((want[r.region_idx] ** 2).sum()) for r in got)
    gaps = regions.gaps(s)
    alone, both = (noise.windows(s, gaps, 4.0, 1.0, residuals=r).agg(F.sum("n")).first()[0] or 0 for r in (None, basis.residuals(s, none, 0.34)))
    assert both > alone
