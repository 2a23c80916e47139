"""mzML sinks: passthrough rewriting of a source document, and clean documents."""

from __future__ import annotations

import hashlib
import os
import re
import shutil
import uuid
import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator
from xml.sax.saxutils import quoteattr

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrasieve.sources import mzml


def output_name(path: str, folder: str | None = None, tag: str = "centroid") -> str:
    """<stem>.<tag>.mzML beside the input or in a folder."""
    stem = re.sub(r"(?i)\.mzml$", "", os.path.basename(path))
    return os.path.join(folder or os.path.dirname(path), f"{stem}.{tag}.mzML")


def _cv(accession: str, name: str) -> str:
    return f'<cvParam cvRef="MS" accession="{accession}" name="{name}" value=""/>'


def _array(values: np.ndarray, kind: str) -> str:
    text = mzml.encode(values, kind)
    bits = _cv(mzml.F64, "64-bit float") if kind == mzml.MZ else _cv(mzml.F32, "32-bit float")
    name = '<cvParam cvRef="MS" accession="MS:1000514" name="m/z array" value="" unitCvRef="MS" unitAccession="MS:1000040" unitName="m/z"/>' if kind == mzml.MZ else '<cvParam cvRef="MS" accession="MS:1000515" name="intensity array" value="" unitCvRef="MS" unitAccession="MS:1000131" unitName="number of detector counts"/>'
    return f'<binaryDataArray encodedLength="{len(text)}">{bits}{_cv(mzml.ZLIB, "zlib compression")}{name}<binary>{text}</binary></binaryDataArray>'


def arrays_xml(mz: np.ndarray, intensity: np.ndarray) -> str:
    return f'<binaryDataArrayList count="2">{_array(mz, mzml.MZ)}{_array(intensity, mzml.INTENSITY)}</binaryDataArrayList>'


def rewrite(raw: bytes, mz: np.ndarray, intensity: np.ndarray, groups: dict) -> bytes:
    """A spectrum element with other arrays: its length, representation and arrays change, all else stays byte for byte.

    Terms always tell what is written, whatever the input's width and compression were; arrays of other kinds go and the count
    tells so; a profile term that comes from a group is replaced by expanding that group in place.
    """
    end = raw.index(b">")
    head = re.sub(rb'(\bdefaultArrayLength=)"\d*"', rb'\1"%d"' % len(mz), raw[:end], count=1)
    body = raw[end:]

    def expand(m):
        terms = groups.get(m[1].decode(), [])
        if not any(t.get("accession") == mzml.PROFILE for t in terms):
            return m[0]
        return "".join("<cvParam " + " ".join(f"{k}={quoteattr(v)}" for k, v in t.items()) + "/>" for t in terms).encode()

    cut = re.search(rb"<(scanList|precursorList|productList|binaryDataArrayList)\b|</spectrum>|$", body)
    own, rest = body[: cut.start()], body[cut.start() :]
    own = re.sub(rb'<referenceableParamGroupRef\s+ref="([^"]*)"\s*/>', expand, own)
    own = re.sub(rb'<cvParam\b[^>]*accession="%s"[^>]*/>' % mzml.PROFILE.encode(), _cv(mzml.CENTROID, "centroid spectrum").encode(), own)
    made = arrays_xml(mz, intensity).encode()
    rest, n = re.subn(rb"<binaryDataArrayList\b.*?</binaryDataArrayList>|<binaryDataArrayList\b[^>]*/>", lambda _: made, rest, count=1, flags=re.S)
    if not n and len(mz):
        rest = rest.replace(b"</spectrum>", made + b"</spectrum>")
    return head + own + rest


class IndexedWriter:
    """Counts and hashes what is written, and ends an indexed document with its index, offset and checksum."""

    def __init__(self, file):
        self.file, self.at, self.sha = file, 0, hashlib.sha1()
        self.spectra: list[tuple[str, int]] = []
        self.chromatograms: list[tuple[str, int]] = []

    def write(self, data: bytes) -> None:
        self.file.write(data)
        self.sha.update(data)
        for m in re.finditer(rb'<chromatogram\s[^>]*?\bid="([^"]*)"', data):
            self.chromatograms.append((m[1].decode(), self.at + m.start()))
        self.at += len(data)

    def spectrum(self, data: bytes, native_id: str) -> None:
        self.spectra.append((native_id, self.at))
        self.write(data)

    def finish(self) -> None:
        lists = [("spectrum", self.spectra)] + [("chromatogram", self.chromatograms)] * bool(self.chromatograms)
        at = self.at
        out = [f'<indexList count="{len(lists)}">']
        for name, found in lists:
            out += [f'<index name="{name}">', *(f"<offset idRef={quoteattr(i)}>{o}</offset>" for i, o in found), "</index>"]
        self.write(("".join(out) + f"</indexList><indexListOffset>{at}</indexListOffset><fileChecksum>").encode())
        self.file.write(f"{self.sha.hexdigest()}</fileChecksum></indexedmzML>\n".encode())


def _native_id(raw: bytes) -> str:
    m = re.search(rb'\bid="([^"]*)"', raw[: raw.index(b">")])
    return m[1].decode() if m else ""


def passthrough(source: str, target: str, replace=None) -> int:
    """Copy a document, passing each spectrum element through ``replace(number, raw)`` (None drops it).

    Bytes around spectra are copied; an index is made anew, an unindexed document stays so. The target appears only when whole: it
    is written beside itself, then renamed. Returns the number of spectra.
    """
    indexed = mzml.sniff(source)["indexed"]
    part, n = f"{target}.part", 0
    with open(source, "rb") as f, open(part, "wb") as out:
        w = IndexedWriter(out)
        last = 0
        for start, raw in mzml.elements(source, 0, os.path.getsize(source)):
            f.seek(last)
            w.write(f.read(start - last))
            made = raw if replace is None else replace(n, raw)
            if made is not None:
                w.spectrum(made, _native_id(made))
            last, n = start + len(raw), n + 1
        f.seek(last)
        tail = f.read()
        if indexed:
            m = re.search(rb"<indexList\b|</indexedmzML>", tail)
            w.write(tail[: m.start()] if m else tail)
            w.finish()
        else:
            w.write(tail)
    os.replace(part, target)
    return n


def copy(source: str, target: str) -> None:
    """An identical copy of a document."""
    shutil.copyfile(source, target)


_MANIFEST = "file string, piece long, path string, spectra long, first long, last long"


def write_centroided(centroided: DataFrame, folder: str | None = None, keep_empty: bool = True, block: int = mzml.BLOCK, files: list[str] | None = None) -> DataFrame:
    """Write (file, scan_number, centroids and, if there, start) back over each source document; (file, target, spectra) of what was written.

    Tasks rewrite ranges of ``block`` bytes of a document side by side, each with the centroids of the spectra that begin there,
    into files beside the target; then a task a document only strings them together, counts offsets, hashes and looks for null bytes, and renames
    the whole to its target. So no task holds a document, and one that fails leaves no target. Spectra without
    a row are written empty, so their number stays, unless ``keep_empty`` is off. ``files`` names the documents (else those that have rows).
    This runs at once; a row a document reaches the driver.
    """
    spark = centroided.sparkSession
    files = files or [r.file for r in centroided.select("file").distinct().collect()]
    work = f".parts-{uuid.uuid4().hex}"
    rows = centroided.select("file", F.col("scan_number").cast("long"), "centroids", *["start"] * ("start" in centroided.columns))
    if "start" not in rows.columns and files:
        rows = rows.join(mzml.read(spark, files, "any", columns=["file", "scan_number", "start"]), ["file", "scan_number"])
    rows = rows.select("file", F.floor(F.col("start") / block).cast("long").alias("piece"), "scan_number", "centroids")
    ranges = [(f, k) for f in files for k in range(-(-os.path.getsize(f) // block))]
    every = spark.createDataFrame(ranges, "file string, piece long").select("file", "piece", F.lit(None).cast("long").alias("scan_number"), F.lit(None).cast(dict(rows.dtypes)["centroids"]).alias("centroids"))

    def stitch(table):
        return _rewritten(table, work, folder, keep_empty, block)

    made = rows.unionByName(every).groupBy("file", "piece").applyInArrow(stitch, _MANIFEST)
    try:
        out = made.groupBy("file").applyInArrow(lambda table: _strung(table, folder, keep_empty), "file string, target string, spectra long").collect()
    finally:
        for f in files:
            shutil.rmtree(_work(f, folder, work), ignore_errors=True)
    return spark.createDataFrame(out, "file string, target string, spectra long")


def _work(source: str, folder: str | None, name: str) -> str:
    return os.path.join(os.path.dirname(output_name(source, folder)), name + os.path.basename(source))


def _rewritten(table, work: str, folder: str | None, keep_empty: bool, block: int):
    """The manifest row of a range: its spectra rewritten into a file, with the bytes between them, and their ids and offsets in another."""
    import pyarrow as pa

    source, piece = table.column("file")[0].as_py(), table.column("piece")[0].as_py()
    of = {k: c for k, c in zip(table.column("scan_number").to_pylist(), table.column("centroids"), strict=True) if k is not None}
    groups = mzml.param_groups(mzml.head_of(source))
    os.makedirs(at := _work(source, folder, work), exist_ok=True)
    path = os.path.join(at, f"{piece}-{uuid.uuid4().hex}")  # a task that runs again writes another file
    first, last, n, place = -1, -1, 0, 0
    with open(source, "rb") as f, open(path, "wb") as out, open(path + ".ids", "w") as ids:
        for start, raw in mzml.elements(source, piece * block, (piece + 1) * block):
            if first < 0:
                first = start
            else:
                f.seek(last)
                place += out.write(f.read(start - last))
            m = re.search(rb'\bindex="(\d+)"', raw[: raw.index(b">")])
            c = of.get(int(m[1])) if m else None
            c = c.values if c is not None and c.is_valid else None
            mz, y = (c.field(i).to_numpy() if c is not None else np.zeros(0) for i in (0, 1))
            if len(mz) or keep_empty:
                new = rewrite(raw, mz, y, groups)
                ids.write(f"{place}\t{_native_id(new)}\n")
                place += out.write(new)
                n += 1
            last = start + len(raw)
        if first >= 0:
            out.write(_until_next(f, last))
    return pa.table({"file": [source], "piece": pa.array([piece], pa.int64()), "path": [path], "spectra": pa.array([n], pa.int64()), "first": pa.array([first], pa.int64()), "last": pa.array([last], pa.int64())})


def _until_next(f, at: int) -> bytes:
    """The bytes from ``at`` to the next spectrum; none if no other follows."""
    f.seek(at)
    data = b""
    while more := f.read(1 << 16):
        data += more
        m = re.search(rb"<spectrum\s|</spectrumList", data)
        if m:
            return data[: m.start()] if m[0][:2] == b"<s" else b""
    return b""


def _strung(table, folder: str | None, keep_empty: bool):
    """A document of its rewritten ranges: (file, target, spectra)."""
    import pyarrow as pa

    from spectrasieve import model
    from spectrasieve.operators import verify

    parts = sorted((r for r in table.to_pylist() if r["first"] >= 0), key=lambda r: r["piece"])
    source = table.column("file")[0].as_py()
    target, total = output_name(source, folder), sum(r["spectra"] for r in parts)
    half, number = f"{target}.{uuid.uuid4().hex}.part", 0
    with open(source, "rb") as f, open(half, "wb") as out:
        w = IndexedWriter(out)
        head = f.read(parts[0]["first"]) if parts else f.read()
        if not keep_empty:
            head = re.sub(rb'(<spectrumList\s[^>]*?\bcount=)"\d+"', rb'\1"%d"' % total, head, count=1)
        if parts:
            w.write(head)
        for r in parts:
            with open(r["path"] + ".ids") as ids:
                entries = [line.rstrip("\n").split("\t", 1) for line in ids]
            edges = [int(o) for o, _ in entries] + [os.path.getsize(r["path"])]
            with open(r["path"], "rb") as part:
                w.write(part.read(edges[0]))
                for (_, native), lo, hi in zip(entries, edges, edges[1:], strict=False):
                    raw = part.read(hi - lo)
                    if not keep_empty:
                        raw = re.sub(rb'(<spectrum\b[^>]*?\bindex=)"\d*"', rb'\1"%d"' % number, raw, count=1)
                    w.spectrum(raw, native)
                    number += 1
        f.seek(parts[-1]["last"] if parts else 0)
        tail = f.read()
        m = re.search(rb"<indexList\b|</indexedmzML>", tail) if mzml.sniff(source)["indexed"] else None
        w.write(tail[: m.start()] if m else tail)
        if m:
            w.finish()
    if bad := verify.null_runs(half):
        os.remove(half)
        raise model.MzmlError(f"{target}: {bad[0][1]} null bytes at byte {bad[0][0]}")
    os.replace(half, target)
    return pa.table({"file": [source], "target": [target], "spectra": pa.array([total], pa.int64())})


_HEAD = """<?xml version="1.0" encoding="UTF-8"?>
<indexedmzML xmlns="http://psi.hupo.org/ms/mzml" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"><mzML xmlns="http://psi.hupo.org/ms/mzml" id={id} version="1.1.0"><cvList count="2"><cv id="MS" fullName="Proteomics Standards Initiative Mass Spectrometry Ontology" URI="https://raw.githubusercontent.com/HUPO-PSI/psi-ms-CV/master/psi-ms.obo"/><cv id="UO" fullName="Unit Ontology" URI="http://purl.obolibrary.org/obo/uo.obo"/></cvList><fileDescription><fileContent><cvParam cvRef="MS" accession="MS:1000580" name="MSn spectrum" value=""/></fileContent></fileDescription><softwareList count="1"><software id="spectrasieve" version="1"><cvParam cvRef="MS" accession="MS:1000799" name="custom unreleased software tool" value="spectrasieve"/></software></softwareList><instrumentConfigurationList count="1"><instrumentConfiguration id="IC1"><cvParam cvRef="MS" accession="MS:1000031" name="instrument model" value=""/></instrumentConfiguration></instrumentConfigurationList><dataProcessingList count="1"><dataProcessing id="DP1"><processingMethod order="0" softwareRef="spectrasieve"><cvParam cvRef="MS" accession="MS:1000544" name="Conversion to mzML" value=""/></processingMethod></dataProcessing></dataProcessingList><run id="run" defaultInstrumentConfigurationRef="IC1"><spectrumList count="{count}" defaultDataProcessingRef="DP1">"""


def spectrum_xml(index: int, r: dict) -> str:
    """A clean spectrum element of a record of mzml.SCHEMA."""
    param = lambda a, n, v, unit="": f'<cvParam cvRef="MS" accession="{a}" name="{n}" value={quoteattr(str(v))}{unit}/>' if v is not None else ""
    minute = ' unitCvRef="UO" unitAccession="UO:0000031" unitName="minute"'
    mode = _cv(mzml.CENTROID, "centroid spectrum") if r.get("mode") == "centroid" else _cv(mzml.PROFILE, "profile spectrum")
    windows = "".join(f'<scanWindow>{param("MS:1000501", "scan window lower limit", w["lower"])}{param("MS:1000500", "scan window upper limit", w["upper"])}</scanWindow>' for w in r.get("scan_windows") or [])
    windows = windows and f'<scanWindowList count="{len(r["scan_windows"])}">{windows}</scanWindowList>'
    scan = f'<scanList count="1">{_cv("MS:1000795", "no combination")}<scan>{param("MS:1000016", "scan start time", r.get("retention_time_min"), minute)}{param("MS:1000512", "filter string", r.get("filter_string"))}{param("MS:1000927", "ion injection time", r.get("injection_time"))}{windows}</scan></scanList>'
    p, pre = r.get("precursor"), ""
    if p:
        ion = param("MS:1000744", "selected ion m/z", p["mz"]) + param("MS:1000041", "charge state", p["charge"]) + param("MS:1000042", "peak intensity", p["intensity"])
        window = param("MS:1000827", "isolation window target m/z", p["isolation_mz"]) + param("MS:1000828", "isolation window lower offset", p["lower"]) + param("MS:1000829", "isolation window upper offset", p["upper"])
        act = _cv("MS:1000133", p["activation"] or "collision-induced dissociation") + param("MS:1000045", "collision energy", p["energy"])
        pre = f'<precursorList count="1"><precursor><isolationWindow>{window}</isolationWindow><selectedIonList count="1"><selectedIon>{ion}</selectedIon></selectedIonList><activation>{act}</activation></precursor></precursorList>'
    mz, y = np.asarray(r["mz"], float), np.asarray(r["intensity"], float)
    native = quoteattr(r.get("native_id") or f"scan={index + 1}")
    return f'<spectrum index="{index}" id={native} defaultArrayLength="{len(mz)}">{param("MS:1000511", "ms level", r.get("ms_level"))}{_cv("MS:1000580", "MSn spectrum")}{mode}{scan}{pre}{arrays_xml(mz, y)}</spectrum>'


def write_clean(target: str, records: Iterable[dict], count: int, run_id: str = "run") -> int:
    """A clean indexed document of records, in order and renumbered."""
    part, n = f"{target}.part", 0
    with open(part, "wb") as f:
        w = IndexedWriter(f)
        w.write(_HEAD.format(id=quoteattr(run_id), count=count).encode())
        for n, r in enumerate(records, 1):
            raw = spectrum_xml(n - 1, r).encode()
            w.spectrum(raw, _native_id(raw))
        w.write(b"</spectrumList></run></mzML>")
        w.finish()
    if n != count:
        os.remove(part)
        raise ValueError(f"{n} records where {count} were announced")
    os.replace(part, target)
    return n


def records_of(path: str, mode: str = "any") -> Iterator[dict]:
    groups = mzml.param_groups(mzml.head_of(path))
    for start, raw in mzml.elements(path, 0, os.path.getsize(path)):
        try:
            r = mzml.record(raw, groups, path, start)
        except ET.ParseError:
            r = None
        if r is not None:
            r |= {"mz": np.zeros(0) if r["mz"] is None else r["mz"], "intensity": np.zeros(0) if r["intensity"] is None else r["intensity"]}
        yield r


def rewrite_clean(source: str, target: str, keep_empty: bool = False) -> int:
    """Re-emit a document cleanly, without spectra that are broken or (unless kept) empty. Two passes, one to count."""
    kept = lambda: (r for r in records_of(source) if r is not None and (keep_empty or len(r["mz"])))
    return write_clean(target, kept(), sum(1 for _ in kept()), os.path.basename(source))
