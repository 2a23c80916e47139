"""mzML documents as a Spark data source, and the byte-level pieces that sinks and checks share."""

from __future__ import annotations

import base64
import glob
import os
import re
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema

from spectrasieve import model

# Accessions of the PSI-MS vocabulary.
PROFILE, CENTROID, MZ, INTENSITY = "MS:1000128", "MS:1000127", "MS:1000514", "MS:1000515"
F64, F32, ZLIB, PLAIN = "MS:1000523", "MS:1000521", "MS:1000574", "MS:1000576"
LEVEL, START_TIME, FILTER, MINUTE = "MS:1000511", "MS:1000016", "MS:1000512", "UO:0000031"

SCHEMA = "file string, " + model.SPECTRUM + ", mode string, start long, length long, precursor struct<mz:double,intensity:double,charge:int,isolation_mz:double,lower:double,upper:double,activation:string,energy:double>, injection_time double, scan_windows array<struct<lower:double,upper:double>>"
SPECTRUM = re.compile(rb"<spectrum[\s>].*?</spectrum>|<spectrum[\s>][^>]*/>", re.S)
_OPEN = re.compile(rb"<spectrum\s")
BLOCK = 64 << 20


def files_of(patterns) -> list[str]:
    """The files that paths or globs name; a pattern without a file is an error."""
    out: dict[str, None] = {}
    for p in [patterns] if isinstance(patterns, str) else patterns:
        found = sorted(glob.glob(p)) if glob.has_magic(p) else [p] * os.path.exists(p)
        if os.path.isdir(p):
            found = sorted(glob.glob(os.path.join(p, "*.mzML")))
        if not found:
            raise model.ConfigError(f"no file matches {p!r}")
        out |= dict.fromkeys(found)
    return list(out)


def param_groups(head: bytes) -> dict[str, list[dict]]:
    """The cvParams of each referenceable group of a document's head."""
    out = {}
    for m in re.finditer(rb"<referenceableParamGroup\s.*?</referenceableParamGroup>", head, re.S):
        e = ET.fromstring(m[0])
        out[e.get("id", "")] = [dict(c.attrib) for c in e.iter("cvParam")]
    return out


def params(e: ET.Element, groups: dict) -> dict[str, dict]:
    """The cvParams that stand directly in an element or in a group that it refers to, by accession."""
    out = {}
    for c in e:
        if c.tag == "cvParam":
            out[c.get("accession", "")] = dict(c.attrib)
        elif c.tag == "referenceableParamGroupRef":
            out |= {p.get("accession", ""): p for p in groups.get(c.get("ref", ""), [])}
    return out


def decode(e: ET.Element, groups: dict) -> tuple[str | None, np.ndarray | None]:
    """(accession of its kind, values) of a binaryDataArray; no values if it cannot be decoded."""
    p = params(e, groups)
    kind = next((k for k in (MZ, INTENSITY) if k in p), None)
    text = e.findtext("binary") or ""
    try:
        data = base64.b64decode(text, validate=False)
        if ZLIB in p and data:
            data = zlib.decompress(data)
        return kind, np.frombuffer(data, "<f4" if F32 in p else "<f8").astype(np.float64)
    except (ValueError, zlib.error):
        return kind, None


def encode(values: np.ndarray, kind: str) -> str:
    """m/z as 64-bit, intensity as 32-bit little-endian floats, compressed, in base64."""
    return base64.b64encode(zlib.compress(np.asarray(values, "<f8" if kind == MZ else "<f4").tobytes())).decode()


def _number(p: dict | None) -> float | None:
    try:
        return float(p["value"]) if p else None
    except (KeyError, ValueError):
        return None


def arrays_of(e: ET.Element, groups: dict) -> dict[str | None, np.ndarray | None]:
    """The values of a spectrum's arrays by the accession of their kind; None where they cannot be decoded."""
    return dict(decode(a, groups) for a in e.iterfind("binaryDataArrayList/binaryDataArray"))


def record(raw: bytes, groups: dict, file: str = "", start: int = 0) -> dict:
    """One spectrum element as a row of SCHEMA. Arrays are None where missing or not decodable."""
    e = ET.fromstring(raw)
    arrays = arrays_of(e, groups)
    return described(e, groups, file, start, len(raw)) | {"mz": arrays.get(MZ), "intensity": arrays.get(INTENSITY)}


def described(e: ET.Element, groups: dict, file: str = "", start: int = 0, length: int = 0) -> dict:
    """What a spectrum element of ``length`` bytes tells besides its arrays, which are None."""
    p = params(e, groups)
    scan = e.find("scanList/scan")
    s = params(scan, groups) if scan is not None else {}
    time = _number(s.get(START_TIME))
    if time is not None and s[START_TIME].get("unitAccession") not in (MINUTE, None):
        time /= 60
    precursor = None
    if (pre := e.find("precursorList/precursor")) is not None:
        ion = pre.find("selectedIonList/selectedIon")
        i = params(ion, groups) if ion is not None else {}
        win = pre.find("isolationWindow")
        w = params(win, groups) if win is not None else {}
        act = pre.find("activation")
        a = params(act, groups) if act is not None else {}
        charge = _number(i.get("MS:1000041"))
        precursor = {"mz": _number(i.get("MS:1000744")), "intensity": _number(i.get("MS:1000042")), "charge": None if charge is None else int(charge), "isolation_mz": _number(w.get("MS:1000827")), "lower": _number(w.get("MS:1000828")), "upper": _number(w.get("MS:1000829")), "activation": next((x.get("name") for k, x in a.items() if k != "MS:1000045"), None), "energy": _number(a.get("MS:1000045"))}
    windows = [{"lower": _number(q.get("MS:1000501")), "upper": _number(q.get("MS:1000500"))} for q in (params(x, groups) for x in e.iterfind("scanList/scan/scanWindowList/scanWindow"))]
    return {
        "file": file,
        "native_id": e.get("id"),
        "scan_number": int(e.get("index", -1)),
        "ms_level": int(_number(p.get(LEVEL)) or 0),
        "retention_time_min": time,
        "filter_string": s[FILTER].get("value") if FILTER in s else None,
        "mz": None,
        "intensity": None,
        "mode": "centroid" if CENTROID in p else "profile" if PROFILE in p else "unknown",
        "start": start,
        "length": length,
        "precursor": precursor,
        "injection_time": _number(s.get("MS:1000927")),
        "scan_windows": windows,
    }


def head_of(path: str, most: int = 16 << 20) -> bytes:
    """A document's bytes before its first spectrum; more than ``most`` are an error."""
    with open(path, "rb") as f:
        data, m = f.read(1 << 20), None
        while not (m := _OPEN.search(data)) and (more := f.read(1 << 20)):
            data += more
            if len(data) > most:
                raise model.MzmlError(f"{path}: no spectrum within the first {most} bytes")
    return data[: m.start()] if m else data


def elements(path: str, lo: int, hi: int) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the spectrum elements that begin within [lo, hi)."""
    with open(path, "rb") as f:
        f.seek(lo)
        data, base = b"", lo
        while True:
            more = f.read(min(4 << 20, max(1 << 16, hi - lo)))
            data += more
            at = 0
            for m in SPECTRUM.finditer(data):
                if base + m.start() >= hi:
                    return
                yield base + m.start(), m[0]
                at = m.end()
            if not more:
                return
            begun = _OPEN.search(data, at)
            if begun is None and base + len(data) >= hi + 16:
                return
            keep = begun.start() if begun else max(at, len(data) - 16)
            data, base = data[keep:], base + keep


def index_of(path: str) -> dict[str, list[tuple[str, int]]]:
    """A document's index: (id, offset) by list name; empty if there is none."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        f.seek(max(0, size - (1 << 16)))
        m = re.search(rb"<indexListOffset>\s*(\d+)\s*<", f.read())
        if not m or int(m[1]) >= size:
            return {}
        f.seek(int(m[1]))
        data = f.read()
    return {k[1].decode(): [(o[1].decode(), int(o[2])) for o in re.finditer(rb'<offset\s+idRef="([^"]*)"[^>]*>\s*(\d+)\s*</offset>', k[2])] for k in re.finditer(rb'<index\s+name="([^"]*)"\s*>(.*?)</index>', data, re.S)}


def _index_at(path: str, offset: int) -> int | None:
    """The index attribute of the spectrum that begins at an offset; None if none begins there."""
    with open(path, "rb") as f:
        f.seek(offset)
        m = re.match(rb"<spectrum\s[^>]*?\bindex=\"(\d+)\"", f.read(4096))
    return int(m[1]) if m else None


def seek(path: str, lo: int, hi: int) -> tuple[int, int] | None:
    """The bytes of the spectra with indices lo to hi by the document's own index; None if that cannot be trusted.

    It is trusted if its offsets ascend and the first and the last of the range lead to spectra of those indices.
    """
    offsets = [o for _, o in index_of(path).get("spectrum", [])]
    if not offsets or offsets != sorted(offsets):
        return None
    lo, hi = max(lo, 0), min(hi, len(offsets) - 1)
    if lo > hi:
        return 0, 0
    if _index_at(path, offsets[lo]) != lo or _index_at(path, offsets[hi]) != hi or _index_at(path, offsets[-1]) != len(offsets) - 1:
        return None
    return offsets[lo], offsets[hi] + 1  # elements that begin within


_TESTS = {EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v}


@dataclass
class Piece(InputPartition):
    path: str
    lo: int
    hi: int


class MzmlReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.options, self.schema = dict(options), schema
        self.mode = options.get("mode", "profile")
        self.most = int(options["max_spectra"]) if "max_spectra" in options else None
        self.block = int(options.get("block", BLOCK))
        self.window = tuple(float(options.get(k, d)) for k, d in (("mz_lo", -np.inf), ("mz_hi", np.inf)))
        self.tests: list[tuple[str, type, object]] = [(c, kind, int(options[k])) for k, c, kind in (("scan_lo", "scan_number", GreaterThanOrEqual), ("scan_hi", "scan_number", LessThanOrEqual), ("ms_level", "ms_level", EqualTo)) if k in options]

    def wanted(self) -> tuple[int, float]:
        """The least and greatest scan numbers that the filters let pass."""
        lo, hi = 0, np.inf
        for column, kind, v in self.tests:
            if column == "scan_number":
                some = list(v) if kind is In else [v]
                if kind in (EqualTo, In, GreaterThan, GreaterThanOrEqual):
                    lo = max(lo, min(some) + (kind is GreaterThan))
                if kind in (EqualTo, In, LessThan, LessThanOrEqual):
                    hi = min(hi, max(some) - (kind is LessThan))
        return lo, hi

    def passes(self, r: dict) -> bool:
        return all(r[c] is not None and _TESTS[kind](r[c], v) for c, kind, v in self.tests)

    def pieces_of(self, path: str) -> list[Piece]:
        if any(c == "file" and not _TESTS[kind](path, v) for c, kind, v in self.tests):
            return []
        begin, end = 0, os.path.getsize(path)
        step = end + 1 if self.most is not None else self.block
        lo, hi = self.wanted()
        if self.most is None and (lo > 0 or hi < np.inf):
            begin, end = seek(path, lo, int(min(hi, 1 << 62))) or (begin, end)
        return [Piece(path, at, min(at + step, end)) for at in range(begin, end, step)]

    def partitions(self):
        out = [p for path in files_of(self.options["path"].split(";")) for p in self.pieces_of(path)]
        return out or [Piece("", 0, 0)]

    def rows(self, piece: Piece) -> Iterator[dict]:
        """The records of a piece that pass; arrays are decoded for those alone, and not at all if no column needs them."""
        groups = param_groups(head_of(piece.path))
        decoded = self.mode == "profile" or {"mz", "intensity"} & set(self.schema.names)
        seen, (lo, hi) = 0, self.window
        for start, raw in elements(piece.path, piece.lo, piece.hi):
            if self.most is not None and seen >= self.most:
                return
            try:
                e = ET.fromstring(raw)
            except ET.ParseError as error:
                raise model.MzmlError(f"{piece.path}: spectrum at byte {start} is not well formed: {error}") from error
            r = described(e, groups, piece.path, start, len(raw))
            passed = self.passes(r)
            if not passed and self.most is None:
                continue
            if decoded:
                arrays = arrays_of(e, groups)
                r["mz"], r["intensity"] = arrays.get(MZ), arrays.get(INTENSITY)
            if self.mode == "profile":
                if r["mz"] is None or not len(r["mz"]) or r["intensity"] is None:
                    continue
                if r["mode"] == "centroid":
                    raise model.NotProfileError(f"{piece.path}: spectrum {r['native_id']} is centroided")
            seen += 1
            if not passed:
                continue
            mz, y = (np.zeros(0) if r[c] is None else r[c] for c in ("mz", "intensity"))
            if (lo > -np.inf or hi < np.inf) and len(mz) == len(y):
                keep = (mz >= lo) & (mz <= hi)
                mz, y = mz[keep], y[keep]
            r["mz"], r["intensity"] = mz, y.astype(np.float32)
            yield r

    def read(self, piece: Piece):
        import pyarrow as pa

        target = to_arrow_schema(self.schema)
        held: list[dict] = []
        size = 0

        def batch():
            return pa.RecordBatch.from_arrays([_column([r[f.name] for r in held], f.type) for f in target], schema=target)

        for r in self.rows(piece) if piece.path else ():
            held.append(r)
            size += 12 * len(r["mz"]) + 200
            if size > 4 << 20:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()


def _column(values: list, kind):
    """An Arrow column; lists of numbers are taken from numpy without a detour."""
    import pyarrow as pa

    if pa.types.is_list(kind) and pa.types.is_floating(kind.value_type):
        offsets = pa.array(np.cumsum([0, *map(len, values)]), pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(values), kind.value_type), type=kind)
    return pa.array(values, kind)


class MzmlFilterReader(MzmlReader):
    """Takes filters on what a spectrum tells besides its arrays; a range of scan numbers is sought by a document's own index."""

    def pushFilters(self, filters: list[Filter]):
        simple = {"file", "scan_number", "ms_level", "retention_time_min", "native_id", "mode", "injection_time"} & set(self.schema.names)
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in simple and type(f) in _TESTS:
                self.tests.append((column, type(f), f.value))
            if not (column in simple and (type(f) in _TESTS or isinstance(f, IsNotNull) and any(c == column for c, *_ in self.tests))):
                yield f


class MzmlStreamReader(MzmlReader, DataSourceStreamReader):
    """Documents as they arrive in folders. The offset is the change time and the path of the last document taken.

    A document counts as arrived once it has not changed for ``settle`` seconds (1), so that no other can
    appear before an offset already taken; it must not change after. Documents are split by bytes as in a batch.
    """

    def initialOffset(self) -> dict:
        return {"changed": 0, "path": ""}

    def _arrived(self) -> list[tuple[int, str]]:
        import time

        until = time.time_ns() - int(1e9 * float(self.options.get("settle", 1)))
        out = []
        for p in self.options["path"].split(";"):
            for name in glob.glob(os.path.join(p, "*.mzML")) if os.path.isdir(p) else glob.glob(p):
                if (changed := os.stat(name).st_ctime_ns) <= until:
                    out.append((changed, name))
        return sorted(out)

    def latestOffset(self) -> dict:
        found = self._arrived()
        return {"changed": found[-1][0], "path": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict):
        lo, hi = ((o["changed"], o["path"]) for o in (start, end))
        return [p for x in self._arrived() if lo < x <= hi for p in self.pieces_of(x[1])] or [Piece("", 0, 0)]

    def commit(self, end: dict) -> None:
        """Nothing is held for offsets that are done."""


class Mzml(DataSource):
    """format("mzml"): options path (";" between), mode (profile or any), max_spectra (a file), block (bytes a task), scan_lo and scan_hi (scan numbers
    within, sought by a document's index), ms_level, mz_lo and mz_hi (points within).

    Large files are split by bytes, a task reading the elements that begin in its range. In mode ``profile`` spectra that are
    empty or cannot be decoded are skipped and centroided ones are an error; ``any`` keeps all. A schema of fewer columns reads only
    these, without arrays if it names none (and the mode is ``any``). With option ``pushdown`` a frame's filters reach the reader, if
    spark.sql.python.filterPushdown.enabled is set; such a frame is good for one query, as Spark 4.1 keeps what a query pushed
    for the next query on the same frame. The same format is read as a stream of arriving documents.
    """

    @classmethod
    def name(cls):
        return "mzml"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        kind = MzmlFilterReader if self.options.get("pushdown", "false") == "true" else MzmlReader
        return kind(self.options, schema)

    def streamReader(self, schema):
        return MzmlStreamReader(self.options, schema)


def read(spark: SparkSession, paths, mode: str = "profile", max_spectra: int | None = None, block: int = BLOCK, columns: list[str] | None = None, scans: tuple[int, int] | None = None, ms_level: int | None = None, window: tuple[float, float] | None = None) -> DataFrame:
    """Spectra of mzML files (paths or globs on storage that all executors mount).

    ``columns`` reads those alone, ``scans`` a range of scan numbers (both ends included; only their bytes, where a document has an index),
    ``ms_level`` spectra of that level, ``window`` the points of a range of m/z.
    """
    spark.dataSource.register(Mzml)
    r = spark.read.format("mzml").option("path", ";".join(files_of(paths))).option("mode", mode).option("block", block)
    lo, hi = scans or (None, None)
    for name, value in (("max_spectra", max_spectra), ("scan_lo", lo), ("scan_hi", hi), ("ms_level", ms_level), *zip(("mz_lo", "mz_hi"), window or (), strict=False)):
        r = r if value is None else r.option(name, value)
    if columns:
        from pyspark.sql.types import StructType

        whole = StructType.fromDDL(SCHEMA)
        r = r.schema(StructType([whole[c] for c in columns]))
    return r.load()


def arriving(spark: SparkSession, folder: str, mode: str = "profile", settle: float = 1.0) -> DataFrame:
    """A stream of the spectra of mzML files that arrive in a folder."""
    spark.dataSource.register(Mzml)
    return spark.readStream.format("mzml").option("path", folder).option("mode", mode).option("settle", settle).load()


def first(spark: SparkSession, paths, n: int) -> DataFrame:
    """The first n spectra of each file; reading stops after them."""
    return read(spark, paths, max_spectra=n)


def by_index(spark: SparkSession, paths, index: int, mode: str = "profile") -> DataFrame:
    """The spectrum of an index of each file, read without the rest of the file where it has an index."""
    return read(spark, paths, mode, scans=(index, index))


def count_hint(path: str) -> int | None:
    """What the document says of its number of spectra."""
    m = re.search(rb"<spectrumList\s[^>]*?\bcount=\"(\d+)\"", head_of(path))
    return int(m[1]) if m else None


def sniff(path: str) -> dict:
    """version (of the first 16 KiB) and whether the document is indexed (of the first 4 KiB)."""
    with open(path, "rb") as f:
        head = f.read(16 << 10)
    m = re.search(rb"<mzML\s[^>]*?\bversion=\"([^\"]+)\"", head)
    return {"version": m[1].decode() if m else None, "indexed": b"<indexedmzML" in head[: 4 << 10]}
