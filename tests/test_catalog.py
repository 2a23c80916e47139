import duckdb
import pytest

from spectrasieve.plans import catalog, documents

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows(columns, found):
    return sorted((tuple(plain(r[c]) for c in columns) for r in found), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, data, name):
    df = catalog.queries()[name](spark, data)
    columns = sorted(df.columns)
    got = [r.asDict() for r in df.collect()]
    if name not in catalog.oracle_sql():
        assert got
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    rel = con.sql(catalog.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    assert rows(columns, got) == rows(columns, [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()])


def test_round_trip_and_stream_equal_the_table(spark, data):
    key = lambda df: sorted((r.spectrum_id, r.centroid_idx, round(r.mz, 6), round(r.intensity / 10)) for r in df.collect())
    want = key(catalog.queries()["centroids"](spark, data))
    assert key(catalog.queries()["stream_centroids"](spark, data)) == want
    assert [k[:3] for k in key(catalog.queries()["mzml_round_trip"](spark, data))] == [k[:3] for k in want]


def test_documents_grow_in_number(spark, data, monkeypatch):
    """Files hold a fixed number of ids, so more rows make more files, and each is repaired."""
    monkeypatch.setattr(documents, "SPECTRA", 50)
    ids = {r[0] // 50 for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id").collect()}
    assert len(ids) > 2 and documents.mzml_verify(spark, data).count() == len(ids)
    got = documents.mzml_repair(spark, data).collect()
    assert len(got) == len(ids) and all((r.restored, r.removed, r.errors) == (1, 0, 0) for r in got)


def test_points_far_from_all_maxima_are_left_out(spark, tmp_path):
    """One maximum in the middle, none on a slope, none without an id: as SQL has it."""
    peak = [float(32 - abs(i - 32)) for i in range(64)]
    made = [(1, peak), (2, [float(i) for i in range(64)]), (None, peak), (3, [0.0, 1.0] + [0.0] * 62)]
    spark.createDataFrame(made, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.queries()["gaussian_reconstruction"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    rel = con.sql(catalog.oracle_sql()["gaussian_reconstruction"])
    columns = ["spectrum_id", "mz", "value"]
    assert rows(columns, got) == rows(columns, [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()])
    assert {(r.spectrum_id, r.mz) for r in got} == {(1, 202 + i / 8) for i in range(33)} | {(3, 200 + i / 8) for i in range(18)}
