import hashlib
import os
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrasieve import cli, model
from spectrasieve.operators import calibrate, centroid, repair, verify
from spectrasieve.sources import mzml, mzml_sink
from spectrasieve.streaming import stream


def records(n=6, empty=()):
    for i in range(n):
        mz = 490 + 0.125 * np.arange(160)
        y = np.float32(1e4 * np.exp(-((mz - 495 - i) ** 2) / (2 * 0.34**2)) + 5)
        if i in empty:
            mz, y = mz[:0], y[:0]
        yield {"native_id": f"scan={i + 1}", "ms_level": 1 if i == 0 else 2, "retention_time_min": i / 10, "filter_string": "ITMS + p NSI t Full ms2", "mz": mz, "intensity": y, "mode": "profile", "injection_time": 1.5, "scan_windows": [{"lower": 490.0, "upper": 510.0}], "precursor": None if i == 0 else {"mz": 500.5, "intensity": 10.0, "charge": 2, "isolation_mz": 500.0, "lower": 1.0, "upper": 1.0, "activation": None, "energy": 30.0}}


@pytest.fixture
def doc(tmp_path):
    p = str(tmp_path / "run.mzML")
    mzml_sink.write_clean(p, records(), 6)
    return p


def checksum_holds(path):
    with open(path, "rb") as f:
        data = f.read()
    at = data.index(b"<fileChecksum>") + len(b"<fileChecksum>")
    return data[at : at + 40].decode() == hashlib.sha1(data[:at]).hexdigest()


def offsets_hold(path):
    with open(path, "rb") as f:
        data = f.read()
    found = mzml.index_of(path)["spectrum"]
    return all(data[o:].startswith(b"<spectrum ") and f'id="{i}"'.encode() in data[o : o + 200] for i, o in found)


def test_scan(spark, doc):
    for block in (700, 4000, mzml.BLOCK):
        rows = mzml.read(spark, doc, block=block).orderBy("scan_number").collect()
        assert [r.scan_number for r in rows] == list(range(6))
    r = rows[2]
    assert r.native_id == "scan=3" and r.ms_level == 2 and r.retention_time_min == pytest.approx(0.2) and r.precursor.charge == 2 and r.scan_windows[0].upper == 510.0 and r.injection_time == 1.5
    assert len(r.mz) == 160 and r.mz[1] == 490.125
    assert mzml.first(spark, doc, 2).count() == 2 and mzml.by_index(spark, doc, 4).first().native_id == "scan=5"
    assert mzml.count_hint(doc) == 6 and mzml.sniff(doc) == {"version": "1.1.0", "indexed": True}
    with pytest.raises(model.ConfigError):
        mzml.files_of(doc + "x*")


def test_filters_seek_by_the_index(spark, tmp_path, doc):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThan
    from pyspark.sql.types import StructType

    size, at = len(open(doc, "rb").read()), [o for _, o in mzml.index_of(doc)["spectrum"]]

    def pieces(path, *filters):
        r = mzml.MzmlFilterReader({"path": path}, StructType.fromDDL(mzml.SCHEMA))
        left = list(r.pushFilters(list(filters)))
        return [(p.lo, p.hi) for p in r.partitions()], left, [x["scan_number"] for p in r.partitions() for x in (r.rows(p) if p.path else ())]

    other = EqualTo(("filter_string",), "x")
    assert pieces(doc, EqualTo(("scan_number",), 3), other) == ([(at[3], at[3] + 1)], [other], [3])
    assert pieces(doc, GreaterThan(("scan_number",), 1), IsNotNull(("scan_number",)), LessThan(("scan_number",), 4)) == ([(at[2], at[3] + 1)], [], [2, 3])
    assert pieces(doc, In(("scan_number",), (1, 4)), EqualTo(("ms_level",), 2))[::2] == ([(at[1], at[4] + 1)], [1, 4])
    assert pieces(doc, EqualTo(("scan_number",), 77))[2] == [] and pieces(doc, EqualTo(("file",), "other"))[2] == []
    wrong = str(tmp_path / "wrong.mzML")  # an index that leads elsewhere is not trusted
    with open(wrong, "wb") as f:
        f.write(open(doc, "rb").read().replace(b">%d</offset>" % at[3], b">%d</offset>" % (at[3] + 1)))
    assert pieces(wrong, EqualTo(("scan_number",), 3))[::2] == ([(0, size)], [3])
    assert [r.scan_number for r in mzml.read(spark, doc, scans=(2, 4), ms_level=2).orderBy("scan_number").collect()] == [2, 3, 4]
    assert mzml.read(spark, doc, ms_level=1).first().native_id == "scan=1" and mzml.read(spark, wrong, scans=(5, 9)).count() == 1
    name = "spark.sql.python.filterPushdown.enabled"
    spark.conf.set(name, "true")
    try:
        spark.dataSource.register(mzml.Mzml)
        for condition, want in (("scan_number >= 2 and ms_level = 2 and retention_time_min < 0.35", [2, 3]), ("scan_number in (0, 5) or scan_number = 2", [0, 2, 5]), ("scan_number > 3 and filter_string is null", [])):
            frame = spark.read.format("mzml").option("path", doc).option("pushdown", "true").load().where(condition)
            assert sorted(r.scan_number for r in frame.collect()) == want
    finally:
        spark.conf.unset(name)
    some = mzml.read(spark, doc, mode="any", columns=["scan_number", "ms_level"])
    assert some.columns == ["scan_number", "ms_level"] and some.where("ms_level = 1").count() == 1
    r = mzml.read(spark, doc, window=(494.0, 496.0)).first()
    assert (r.mz[0], r.mz[-1], len(r.mz), len(r.intensity)) == (494.0, 496.0, 17, 17)


def test_long_header_is_read_or_refused(tmp_path, doc):
    assert mzml.head_of(doc) == open(doc, "rb").read()[: mzml.index_of(doc)["spectrum"][0][1]]
    with pytest.raises(model.MzmlError, match="no spectrum"):
        long = str(tmp_path / "long.mzML")
        with open(long, "wb") as f:
            f.write(b" " * (3 << 20))
        mzml.head_of(long, 2 << 20)


def test_stream_of_documents_restarts(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    taken = []
    for k, names in enumerate((["a", "b"], [], ["0", "c"])):
        for n in names:
            mzml_sink.write_clean(str(tmp_path / n), records(3 + k), 3 + k)
            (tmp_path / n).rename(inbox / f"{n}.mzML")
        stream.drain(mzml.arriving(spark, str(inbox), settle=0).select("file", "scan_number"), str(tmp_path / "out"), str(tmp_path / "state"))
        rows = spark.read.parquet(str(tmp_path / "out")).groupBy("file").count().collect()
        taken.append({r.file[-6]: r["count"] for r in rows})
    assert taken == [{"a": 3, "b": 3}, {"a": 3, "b": 3}, {"a": 3, "b": 3, "0": 5, "c": 5}]


def unlike(tmp_path):
    """Three documents of unlike widths and spacings: a filter code, wavelets, and too few peaks."""
    out = []
    for k, (h, sigma, text, n) in enumerate(((0.125, 0.34, "ITMS + p NSI t Full ms2", 6), (1 / 15, 0.3, None, 12), (0.1, 0.3, None, 2))):
        def rows(h=h, sigma=sigma, text=text, n=n):
            for i in range(n):
                mz = 400 + h * np.arange(int(40 / h))
                y = np.float32(sum(1e4 * np.exp(-((mz - c - i / 9) ** 2) / (2 * sigma**2)) for c in ((410, 425) if n > 2 else (410,))) + 5)
                yield {"native_id": f"scan={i}", "ms_level": 1 + (i % 3 > 0), "mz": mz, "intensity": y, "mode": "profile", "filter_string": text}
        out.append(str(tmp_path / f"u{k}.mzML"))
        mzml_sink.write_clean(out[-1], rows(), n)
    return out


def test_files_are_calibrated_each_and_centroided_at_once(spark, tmp_path):
    files = unlike(tmp_path)
    config = model.Config(n_calibration_spectra=9)
    cal = calibrate.calibrate_files(mzml.first(spark, files, 9), config)
    got = {r.file: r.asDict() for r in cal.collect()}
    want = {f: calibrate.calibrate(mzml.first(spark, f, 9), config) for f in files}
    for f in files:
        assert {k: pytest.approx(v, rel=1e-12) for k, v in want[f].items()} == {k: v for k, v in got[f].items() if k != "file"}
    assert len({(r["sigma_ms2"], r["grid_spacing_ms2"]) for r in got.values()}) == 3
    together = {(r.file, r.scan_number): r for r in centroid.centroid_files(mzml.read(spark, files), cal, config).collect()}
    for f in files:
        c = want[f]
        alone = centroid.centroid(mzml.read(spark, f), config, (c["sigma_ms1"], c["sigma_ms2"]), (c["grid_spacing_ms1"], c["grid_spacing_ms2"]), ("file", "scan_number")).collect()
        for r in alone:
            assert np.allclose([(x.mz, x.intensity) for x in r.centroids], [(x.mz, x.intensity) for x in together.pop((r.file, r.scan_number)).centroids])
    assert not together
    assert calibrate.calibrate_files(mzml.first(spark, files, 9).where("false"), config).count() == 0


def test_landing_takes_each_file_once(spark, tmp_path):
    files = unlike(tmp_path)
    inbox = tmp_path / "in"
    inbox.mkdir()
    for names in (files[:2], [], files[2:]):
        for f in names:
            os.rename(f, inbox / os.path.basename(f))
        stream.landing(spark, str(inbox), str(tmp_path / "out"), str(tmp_path / "state"), settle=0).awaitTermination()
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((os.path.basename(r.file), r["count"]) for r in back.groupBy("file").count().collect()) == [("u0.mzML", 6), ("u1.mzML", 12), ("u2.mzML", 2)]
    one = back.where("file like '%u1.mzML' and scan_number = 1").first()
    assert abs(one.stats.sigma_used - 0.3) < 0.1 and min(abs(c.mz - 410 - 1 / 9) for c in one.centroids) < 0.1


def test_interleaved_files_are_calibrated_by_state(spark, tmp_path):
    files = unlike(tmp_path)
    config = model.Config(n_calibration_spectra=5)
    rows = mzml.read(spark, files).select("file", "scan_number", "ms_level", "filter_string", "mz", "intensity").collect()
    schema = mzml.read(spark, files).select("file", "scan_number", "ms_level", "filter_string", "mz", "intensity").schema
    inbox = str(tmp_path / "in")
    rows.sort(key=lambda r: (r.scan_number, r.file))
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in (rows[:7], rows[7:12], rows[12:]):  # each run goes on with the state of the one before
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(inbox)
            stream.drain(stream.calibrated(spark.readStream.schema(schema).parquet(inbox), config), str(tmp_path / "out"), str(tmp_path / "state"))
        short = [r for r in rows if r.file == files[2]]
        spark.createDataFrame(short, schema).coalesce(1).write.parquet(str(tmp_path / "short"))
        made = stream.calibrated(spark.readStream.schema(schema).parquet(str(tmp_path / "short")), config, wait_ms=1)
        q = made.writeStream.format("parquet").option("path", str(tmp_path / "late")).option("checkpointLocation", str(tmp_path / "late_state")).start()
        late = []
        for _ in range(60):  # a file with too few spectra comes when none has followed
            time.sleep(0.5)
            late = spark.read.schema(made.schema).parquet(str(tmp_path / "late")).collect() if os.path.exists(tmp_path / "late" / "_spark_metadata") else []
            if len(late) == len(short):
                break
        q.stop()
    finally:
        spark.conf.unset(name)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r.file for r in got} == set(files[:2])  # the third still waits
    got = {(r.file, r.scan_number): r for r in got + late}
    cal = calibrate.calibrate_files(mzml.first(spark, files, 5), config)
    want = centroid.centroid_files(mzml.read(spark, files), cal, config).collect()
    assert len(got) == len(want) == len(rows)
    for r in want:
        mine = got[r.file, r.scan_number]
        assert np.allclose(mine.mz, [c.mz for c in r.centroids]) and np.allclose(mine.intensity, [c.intensity for c in r.centroids]) and mine.sigma == pytest.approx(r.stats.sigma_used)


def test_skips_and_errors(spark, tmp_path, doc):
    p = str(tmp_path / "e.mzML")
    mzml_sink.write_clean(p, records(empty=(3,)), 6)
    assert mzml.read(spark, p).count() == 5 and mzml.read(spark, p, mode="any").count() == 6
    c = str(tmp_path / "c.mzML")
    mzml_sink.write_clean(c, ({**r, "mode": "centroid"} for r in records()), 6)
    assert mzml.read(spark, c, mode="any").count() == 6
    with pytest.raises(Exception, match="centroided"):
        mzml.read(spark, c).count()


def test_write_back(spark, tmp_path):
    p = str(tmp_path / "e.mzML")
    mzml_sink.write_clean(p, records(empty=(2,)), 6)
    found = centroid.centroid(mzml.read(spark, p), model.Config(), (0.34, 0.34), (0.125, 0.125), ("file", "scan_number"))
    target = mzml_sink.write_centroided(found).first().target
    assert target == str(tmp_path / "e.centroid.mzML") and checksum_holds(target) and offsets_hold(target)
    back = {r.scan_number: r for r in mzml.read(spark, target, mode="any").collect()}
    assert len(back) == 6 and not back[2].mz and all(r.mode == "centroid" for r in back.values())
    for i in (0, 1, 3, 4, 5):  # each spectrum has its own peaks, also after the empty one
        assert min(abs(np.array(back[i].mz) - 495 - i)) < 0.25 and back[i].native_id == f"scan={i + 1}"
    dropped = mzml_sink.write_centroided(found, str(tmp_path), keep_empty=False).first().target
    assert mzml.count_hint(dropped) == 5 and [r.scan_number for r in mzml.read(spark, dropped, mode="any").orderBy("scan_number").collect()] == list(range(5)) and checksum_holds(dropped)


def test_ranges_are_rewritten_side_by_side(spark, tmp_path, monkeypatch):
    p = str(tmp_path / "r.mzML")
    mzml_sink.write_clean(p, records(12, empty=(2, 7)), 12)
    with open(p, "rb") as f:
        data = f.read().replace(b"</spectrum><spectrum", b"</spectrum>\n  <spectrum")
    with open(p, "wb") as f:
        f.write(data)
    repair.rebuild_index(p)
    found = centroid.centroid(mzml.read(spark, p), model.Config(), (0.34, 0.34), (0.125, 0.125), ("file", "scan_number", "start"))
    made = {}
    for keep in (True, False):
        for block in (300, 2500, mzml.BLOCK):
            out = tmp_path / f"{keep}{block}"
            out.mkdir()
            row = mzml_sink.write_centroided(found if block > 300 else found.drop("start"), str(out), keep, block).first()
            assert row.spectra == (12 if keep else 10) and checksum_holds(row.target) and offsets_hold(row.target)
            assert os.listdir(out) == ["r.centroid.mzML"]
            made[keep, block] = open(row.target, "rb").read()
        assert made[keep, 300] == made[keep, 2500] == made[keep, mzml.BLOCK]
    assert b"</spectrum>\n  <spectrum" in made[True, 300] and b'spectrumList count="10"' in made[False, 300]
    with open(p, "r+b") as f:  # null bytes that reach the copy leave no target
        f.seek(data.index(b"<softwareList"))
        f.write(bytes(600))
    (tmp_path / "bad").mkdir()
    with pytest.raises(Exception, match="null bytes"):
        mzml_sink.write_centroided(found, str(tmp_path / "bad"))
    assert not [n for n in os.listdir(tmp_path / "bad") if n.endswith(".mzML") or n.endswith(".part")]


def test_rewrite_terms():
    raw = b'<spectrum index="0" id="a" defaultArrayLength="4"><referenceableParamGroupRef ref="g"/><cvParam cvRef="MS" accession="MS:1000511" name="ms level" value="2"/><binaryDataArrayList count="3"><binaryDataArray encodedLength="0"><cvParam accession="MS:1000521"/><binary></binary></binaryDataArray></binaryDataArrayList></spectrum>'
    groups = {"g": [{"cvRef": "MS", "accession": mzml.PROFILE, "name": "profile spectrum", "value": ""}]}
    out = mzml_sink.rewrite(raw, np.array([1.0]), np.array([2.0]), groups)
    r = mzml.record(out, {})
    assert r["mode"] == "centroid" and r["mz"].tolist() == [1.0] and r["intensity"].tolist() == [2.0] and b'binaryDataArrayList count="2"' in out and b'defaultArrayLength="1"' in out


def test_identity_and_unindexed(tmp_path, doc):
    same = str(tmp_path / "same.mzML")
    mzml_sink.passthrough(doc, same)
    assert open(same, "rb").read() == open(doc, "rb").read()
    plain = str(tmp_path / "plain.mzML")
    data = open(doc, "rb").read()
    with open(plain, "wb") as f:
        f.write(re.search(rb"<mzML.*</mzML>", data, re.S)[0])
    out = str(tmp_path / "plain2.mzML")
    mzml_sink.passthrough(plain, out)
    assert open(out, "rb").read() == open(plain, "rb").read() and not mzml.sniff(out)["indexed"]


@pytest.mark.parametrize(("n", "at", "hit"), [(511, 10, False), (512, 10, True), (600, 262_144 - 300, True), (5000, (4 << 20) - 2500, True)])
def test_null_runs(tmp_path, n, at, hit):
    p = tmp_path / "x.bin"
    p.write_bytes(b"a" * at + b"\0" * n + b"b" * 10)
    assert verify.null_runs(str(p)) == ([(at, n)] if hit else [])


def test_validate(spark, tmp_path, doc):
    worst = lambda f: f.agg(F.max("severity")).first()[0]
    assert worst(verify.validate(spark, doc, "strict")) == verify.INFO
    bad = str(tmp_path / "bad.mzML")
    data = open(doc, "rb").read().replace(b'<spectrumList count="6"', b'<spectrumList count="7"').replace(b"MS:1000580", b"MS:1999999")
    with open(bad, "wb") as f:
        f.write(re.sub(rb"<softwareList.*?</softwareList>", b"", data, flags=re.S))
    got = verify.validate(spark, bad, "standard")
    assert {"count-mismatch", "missing-element", "index-offset", "cv-term"} <= {r.check for r in got.collect()}
    assert verify.severity_counts(got).first().worst == verify.ERROR
    cut = str(tmp_path / "cut.mzML")
    with open(cut, "wb") as f:
        f.write(data[: len(data) // 2])
    assert "not-well-formed" in {r.check for r in verify.validate(spark, cut, "minimal").collect()}
    assert verify.verify(spark, [doc]).first().ok


def test_repair(tmp_path, doc):
    broken = str(tmp_path / "b.mzML")
    data = bytearray(open(doc, "rb").read())
    at = data.index(b"<binary>", 9000) + 20
    data[at : at + 90] = bytes(90)
    with open(broken, "wb") as f:
        f.write(data)
    assert repair.repair(broken, dry_run=True)["runs"] == 1
    got = repair.repair(broken, doc)
    assert got["restored"] == 1 and got["errors"] == 0 and open(broken, "rb").read() == open(doc, "rb").read()
    with open(broken, "wb") as f:
        f.write(data)
    assert repair.strip_damaged(broken) == 1 and mzml.count_hint(broken) == 5 and checksum_holds(broken) and offsets_hold(broken)
    clean = str(tmp_path / "clean.mzML")
    mzml_sink.write_clean(broken, records(empty=(1,)), 6)
    assert mzml_sink.rewrite_clean(broken, clean) == 5 and mzml_sink.rewrite_clean(broken, clean, keep_empty=True) == 6


@pytest.mark.parametrize("array", [0, 1])
def test_repair_across_header_and_array(tmp_path, doc, array):
    """A run from the XML into base64 that the source doesn't hold keeps its spectrum, by the source's XML."""
    broken = str(tmp_path / "c.mzML")
    mzml_sink.write_clean(broken, ({**r, "mz": r["mz"][40:90], "intensity": r["intensity"][40:90]} for r in records()), 6)
    with open(broken, "rb") as f:
        whole = f.read()
    begin = whole.index(b'id="scan=4"')
    for _ in range(array + 1):
        begin = whole.index(b"<binary>", begin + 1)
    data = bytearray(whole)
    data[begin - 70 : begin + 30] = bytes(100)
    with open(broken, "wb") as f:
        f.write(data)
    got = repair.repair(broken, doc)
    assert got["runs"] == got["restored"] == 1 and got["removed"] == 0
    assert mzml.count_hint(broken) == 6 and checksum_holds(broken) and offsets_hold(broken) and not verify.null_runs(broken)
    with open(broken, "rb") as f:
        assert f.read()[: begin + 8] == whole[: begin + 8]


def test_cli(spark, tmp_path, doc, capsys):
    stats, more = str(tmp_path / "stats"), unlike(tmp_path)
    assert cli.main(["run", "--input", *more, doc, "--output", str(tmp_path), "--stats-output", stats, "--no-quiet"]) == 0
    assert spark.read.option("header", True).option("sep", "\t").csv(stats).count() == 26
    assert capsys.readouterr().out.split() == [str(tmp_path / f"{os.path.basename(f)[:-5]}.centroid.mzML") for f in (*more, doc)]
    assert cli.main(["run", "--input", doc, "--output", str(tmp_path), "--quiet", "--verbose", "--threads", "2"]) == 0
    said = capsys.readouterr()
    assert not said.out and "1 files in" in said.err
    assert cli.main(["run", "--input", doc, "--threads", "0"]) == 2
    for args in (["calibrate", doc], ["inspect", doc], ["centroid-test", doc, "--n", "3"], ["verify", doc], ["validate", doc]):
        assert cli.main(args) == 0
    assert "MS2: sigma 0.3400" in capsys.readouterr().out
    assert cli.main(["verify", doc + "x"]) == 2
