import numpy as np
import pytest

from spectrasieve.operators import centroid, regions, verify


def run(spark, y, k, **kw):
    df = spark.createDataFrame([(1, [200 + 0.125 * i for i in range(len(y))], [float(v) for v in y])], "spectrum_id long, mz array<double>, intensity array<float>")
    return df, regions.detect(df, k, **kw).orderBy("region_idx").collect()


def bumps(n, *at):
    i = np.arange(n)
    return np.float32(sum(1000 * np.exp(-((i - a) ** 2) / (2 * 2.72**2)) for a in at) if at else np.zeros(n))


@pytest.mark.parametrize(("n", "at", "want"), [(40, (20,), 1), (80, (20, 60), 2), (40, (16, 22), 1), (40, (), 0)])
def test_detect(spark, n, at, want):
    y = bumps(n, *at).astype(float)
    start, end = centroid.regions(y, 50, 2, 2, 3)
    assert len(start) == want
    if at == (20,):
        assert start[0] + y[start[0] : end[0] + 1].argmax() == 20
    _, got = run(spark, y, 1, extension=2)
    base, sigma = centroid.rough_noise(y)
    start, end = centroid.regions(y, base + sigma, 2, 2, 3)
    assert [(r.start_idx, r.end_idx) for r in got] == list(zip(start.tolist(), end.tolist(), strict=True))
    assert [r.apex_idx for r in got] == [s + int(y[s : e + 1].argmax()) for s, e in zip(start, end, strict=True)]


def test_array_and_exploded_agree(spark):
    rng = np.random.default_rng(0)
    rows = [(k, [200 + 0.125 * i for i in range(n)], [float(v) for v in np.float32(np.maximum(rng.normal(0, 1, n), 0) ** 3 * 100)]) for k, n in enumerate((3, 10, 64, 200))]
    df = spark.createDataFrame(rows, "spectrum_id long, mz array<double>, intensity array<float>")
    got = {}
    for r in regions.detect(df).collect():
        got.setdefault(r.spectrum_id, []).append((r.start_idx, r.end_idx))
    points = {}
    for r in regions.extended(regions.merged(regions.segments(regions.with_noise(df)))).collect():
        points.setdefault(r.spectrum_id, []).append((r.start_idx, r.end_idx))
    assert {k: sorted(v) for k, v in points.items()} == {k: sorted(v) for k, v in got.items()}
    for k, _, y in rows:
        y = np.array(y)
        base, sigma = centroid.rough_noise(y)
        s, e = centroid.regions(y, base + 3 * sigma, 2, 3, 3)
        assert sorted(got.get(k, [])) == list(zip(s.tolist(), e.tolist(), strict=True))


def test_overlap_gaps_and_coverage(spark):
    y = np.zeros(40)
    y[[10, 11, 12, 16, 17, 18]] = 1000
    df, got = run(spark, y, 3)
    assert [(r.start_idx, r.end_idx) for r in got] == [(7, 15), (13, 21)]
    found = regions.detect(df)
    assert regions.overlaps(found).collect()[0].shared == 3
    assert sorted(map(tuple, regions.gaps(df).collect())) == sorted(map(tuple, regions.gap_points(df, found).collect()))
    assert regions.gap_points(df, found).count() == 25 and regions.coverage(df, found).first().n_covered == 15


def test_ranges(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 3, 8), ("a", 8, 9), ("a", 20, 21), ("b", 1, 2)], "file string, begin long, end long")
    assert sorted(map(tuple, verify.union_ranges(df).collect())) == [("a", 0, 9), ("a", 20, 21), ("b", 1, 2)]
    spans = spark.createDataFrame([("a", 0, "x"), ("a", 10, "y")], "file string, begin long, id string")
    points = spark.createDataFrame([("a", 10), ("a", 9), ("a", 500), ("b", 3)], "file string, offset long")
    assert {(r.file, r.offset): r.id for r in verify.enclosing(points, spans, lookback=100).collect()} == {("a", 10): "y", ("a", 9): "x", ("a", 500): None, ("b", 3): None}
