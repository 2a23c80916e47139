"""Verification and validation of mzML documents, as findings."""

from __future__ import annotations

import os
import re
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spectrasieve.operators import ontology, schema
from spectrasieve.sources import mzml

INFO, WARNING, ERROR = 0, 1, 2
FINDING = "file string, severity int, check string, message string, location string"

# Elements that a document must have, below mzML.
REQUIRED = (".", "cvList", "fileDescription", "fileDescription/fileContent", "softwareList", "instrumentConfigurationList", "dataProcessingList", "run", "run/spectrumList")
# Fixed values: (element path, parent term, label): the element needs a term below the parent.
STANDARD = (
    ("fileDescription/fileContent", "MS:1000524", "data file content"),
    ("instrumentConfigurationList/instrumentConfiguration", "MS:1000031", "instrument model"),
    ("softwareList/software", "MS:1000531", "software"),
    ("dataProcessingList/dataProcessing/processingMethod", "MS:1000452", "data transformation"),
    ("run/spectrumList/spectrum", "MS:1000559", "spectrum type"),
    ("run/spectrumList/spectrum", "MS:1000525", "spectrum representation"),
    ("run/spectrumList/spectrum/binaryDataArrayList/binaryDataArray", "MS:1000513", "binary data array"),
    ("run/spectrumList/spectrum/binaryDataArrayList/binaryDataArray", "MS:1000518", "binary data type"),
    ("run/spectrumList/spectrum/binaryDataArrayList/binaryDataArray", "MS:1000572", "binary data compression type"),
)
STRICT = STANDARD + (
    ("instrumentConfigurationList/instrumentConfiguration/componentList/source", "MS:1000008", "ionization type"),
    ("instrumentConfigurationList/instrumentConfiguration/componentList/analyzer", "MS:1000443", "mass analyzer type"),
    ("instrumentConfigurationList/instrumentConfiguration/componentList/detector", "MS:1000026", "detector type"),
    ("run/spectrumList/spectrum/scanList", "MS:1000570", "spectra combination"),
    ("run/spectrumList/spectrum/scanList/scan/scanWindowList/scanWindow", "MS:1000500", "scan window upper limit"),
    ("run/spectrumList/spectrum/scanList/scan/scanWindowList/scanWindow", "MS:1000501", "scan window lower limit"),
    ("run/spectrumList/spectrum/precursorList/precursor/selectedIonList/selectedIon", "MS:1000455", "ion selection attribute"),
    ("run/spectrumList/spectrum/precursorList/precursor/activation", "MS:1000044", "dissociation method"),
    ("run/chromatogramList/chromatogram", "MS:1000626", "chromatogram type"),
    ("run/chromatogramList/chromatogram/binaryDataArrayList/binaryDataArray", "MS:1000513", "binary data array"),
    ("run/chromatogramList/chromatogram/binaryDataArrayList/binaryDataArray", "MS:1000518", "binary data type"),
    ("run/chromatogramList/chromatogram/binaryDataArrayList/binaryDataArray", "MS:1000572", "binary data compression type"),
)
# Terms of the PSI-MS vocabulary below each parent that common documents use.
DESCENDANTS = {
    "MS:1000524": "MS:1000579 MS:1000580 MS:1000294 MS:1000235 MS:1000810 MS:1000127 MS:1000128 MS:1000582 MS:1000581",
    "MS:1000031": "MS:1000031 MS:1000449 MS:1000483 MS:1000556 MS:1001911 MS:1002732 MS:1003028 MS:1003378 MS:1003409",
    "MS:1000531": "MS:1000531 MS:1000532 MS:1000615 MS:1000799 MS:1001456 MS:1002205 MS:1003145",
    "MS:1000452": "MS:1000543 MS:1000544 MS:1000035 MS:1000033 MS:1000592 MS:1000593 MS:1000780 MS:1001486",
    "MS:1000559": "MS:1000294 MS:1000579 MS:1000580 MS:1000582 MS:1000581 MS:1000806 MS:1000804 MS:1000805",
    "MS:1000525": "MS:1000127 MS:1000128",
    "MS:1000513": "MS:1000514 MS:1000515 MS:1000516 MS:1000517 MS:1000595 MS:1000617 MS:1000786",
    "MS:1000518": "MS:1000519 MS:1000520 MS:1000521 MS:1000522 MS:1000523",
    "MS:1000572": "MS:1000574 MS:1000576 MS:1002312 MS:1002313 MS:1002314",
    "MS:1000008": "MS:1000073 MS:1000398 MS:1000070 MS:1000071 MS:1000075 MS:1000389",
    "MS:1000443": "MS:1000264 MS:1000079 MS:1000084 MS:1000484 MS:1000081 MS:1000083 MS:1000291",
    "MS:1000026": "MS:1000253 MS:1000624 MS:1000114 MS:1000107 MS:1000108",
    "MS:1000570": "MS:1000795 MS:1000571 MS:1000573 MS:1000575",
    "MS:1000500": "MS:1000500",
    "MS:1000501": "MS:1000501",
    "MS:1000455": "MS:1000744 MS:1000041 MS:1000042 MS:1000040 MS:1000633",
    "MS:1000044": "MS:1000133 MS:1000422 MS:1000435 MS:1000598 MS:1000599 MS:1000250 MS:1000262",
    "MS:1000626": "MS:1000235 MS:1000627 MS:1000628 MS:1000810 MS:1000811 MS:1000812 MS:1000813",
}


def null_runs(path: str, least: int = 512) -> list[tuple[int, int]]:
    """(offset, length) of runs of at least ``least`` null bytes; runs may cross any read boundary."""
    out, at, begun = [], 0, None
    with open(path, "rb") as f:
        while data := f.read(4 << 20):
            pos = 0
            if begun is not None:
                m = re.compile(rb"[^\0]").search(data)
                if m is None:
                    at += len(data)
                    continue
                if at + m.start() - begun >= least:
                    out.append((begun, at + m.start() - begun))
                begun, pos = None, m.start()
            for m in re.compile(rb"\0+").finditer(data, pos):
                if m.end() == len(data):
                    begun = at + m.start()
                elif len(m[0]) >= least:
                    out.append((at + m.start(), len(m[0])))
            at += len(data)
    if begun is not None and at - begun >= least:
        out.append((begun, at - begun))
    return out


def counts(path: str) -> dict | None:
    """declared, actual and indexed numbers of spectra; None without a spectrum list."""
    declared = mzml.count_hint(path)
    if declared is None and b"<spectrumList" not in mzml.head_of(path):
        return None
    actual = sum(1 for _ in mzml.elements(path, 0, os.path.getsize(path)))
    return {"declared": declared, "actual": actual, "indexed": len(mzml.index_of(path).get("spectrum", [])) or None}


def empty_spectra(path: str) -> list[tuple[int, str, int, int]]:
    """(number, id, begin, end) of spectra with a default array length of 0."""
    out = []
    for n, (start, raw) in enumerate(mzml.elements(path, 0, os.path.getsize(path))):
        head = raw[: raw.index(b">")]
        if re.search(rb'\bdefaultArrayLength="0"', head):
            m = re.search(rb'\bid="([^"]*)"', head)
            out.append((n, m[1].decode() if m else "", start, start + len(raw)))
    return out


def _strip(tag: str) -> str:
    return tag.rpartition("}")[2]


def element_rows(path: str) -> list[tuple[str, int, str, list[str], list[str]]]:
    """(file, number, path below mzML, accessions, referenced groups) of every element that a rule may name; raises ParseError."""
    named = {p for p, _, _ in STRICT} | set(REQUIRED)
    stack: list[ET.Element] = []
    rows = []
    for event, e in ET.iterparse(path, events=("start", "end")):
        if event == "start":
            stack.append(e)
            continue
        names = [_strip(x.tag) for x in stack]
        stack.pop()
        names = names[1:] if names and names[0] == "indexedmzML" else names
        if not names or names[0] != "mzML":
            continue
        at = "/".join(names[1:]) or "."
        if at in named or names[-1] == "referenceableParamGroup":
            key = at if names[-1] != "referenceableParamGroup" else f"group:{e.get('id', '')}"
            rows.append((path, len(rows), key, [c.get("accession", "") for c in e if _strip(c.tag) == "cvParam"], [c.get("ref", "") for c in e if _strip(c.tag) == "referenceableParamGroupRef"]))
        if names[-1] in ("spectrum", "chromatogram") and stack:
            e.clear()
    return rows


def accessions(elements: DataFrame, groups: DataFrame) -> DataFrame:
    """Elements with all accessions, their own and those of the groups that they refer to.

    elements: (file, element, path, own array<string>, refs array<string>); groups: (file, id, terms array<string>).
    """
    refs = elements.select("file", "element", F.explode_outer("refs").alias("id"))
    more = refs.join(groups, ["file", "id"], "left").groupBy("file", "element").agg(F.flatten(F.collect_list(F.coalesce("terms", F.array().cast("array<string>")))).alias("more"))
    return elements.join(more, ["file", "element"], "left").select("file", "element", "path", F.array_union("own", F.coalesce("more", F.array().cast("array<string>"))).alias("accessions"))


def rules(spark: SparkSession, level: str = "standard") -> DataFrame:
    """(path, parent, label, allowed): the strict rules are the standard ones and more."""
    rows = [(p, a, label, DESCENDANTS[a].split()) for p, a, label in (STRICT if level == "strict" else STANDARD)]
    return spark.createDataFrame(rows, "path string, parent string, label string, allowed array<string>")


def rule_failures(resolved: DataFrame, rules: DataFrame) -> DataFrame:
    """Elements without any term that a rule allows: (file, element, path, parent, label). Rules are few and broadcast."""
    return resolved.join(F.broadcast(rules), "path").where(~F.arrays_overlap("accessions", "allowed")).select("file", "element", "path", "parent", "label")


def samples(failures: DataFrame, k: int = 3) -> DataFrame:
    """A finding a rule and file: how many elements failed and the first k of them."""
    w = Window.partitionBy("file", "path", "parent").orderBy("element")
    head = failures.withColumn("r", F.row_number().over(w))
    got = head.groupBy("file", "path", "parent", "label").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("r") <= k, F.col("element")))).alias("first"))
    return got.select("file", F.lit(WARNING).alias("severity"), F.lit("cv-term").alias("check"), F.format_string("%d elements without a term of %s (%s), first %s", "n", "parent", "label", F.concat_ws(", ", "first")).alias("message"), F.col("path").alias("location"))


def byte_findings(path: str) -> list[tuple]:
    """Findings on a file's bytes, counts, version and required attributes, and on whether it parses."""
    out = []
    add = lambda s, c, m, at="": out.append((path, s, c, m, at))
    for at, n in null_runs(path):
        add(ERROR, "null-bytes", f"{n} null bytes", f"byte {at}")
    sniffed = mzml.sniff(path)
    add(INFO if sniffed["version"] else ERROR, "version", f"mzML version {sniffed['version']}, {'indexed' if sniffed['indexed'] else 'not indexed'}")
    if sniffed["version"] not in (None, "1.1.0", "1.1.1"):
        add(WARNING, "version", "checked by the rules of 1.1.1")
    c = counts(path)
    if c:
        for name in ("declared", "indexed"):
            if c[name] is not None and c[name] != c["actual"]:
                add(ERROR, "count-mismatch", f"{name} {c[name]}, found {c['actual']}")
    if sniffed["indexed"]:
        index, real = mzml.index_of(path), {}
        if "spectrum" not in index:
            add(ERROR, "index-offset", "there is no index where indexListOffset tells")
        for start, raw in mzml.elements(path, 0, os.path.getsize(path)):
            head = raw[: raw.index(b">")]
            m = re.search(rb'\bid="([^"]*)"', head)
            real[m[1].decode() if m else ""] = start
            for a in (b"id", b"index", b"defaultArrayLength"):
                if not re.search(rb"\b%s=" % a, head):
                    add(ERROR, "missing-attribute", f"spectrum without {a.decode()}", f"byte {start}")
        wrong = [i for i, o in index.get("spectrum", []) if real.get(i) != o]
        if wrong:
            add(ERROR, "index-offset", f"{len(wrong)} offsets are wrong, first of {wrong[0]}")
    if empty := empty_spectra(path):
        first = ", ".join(f"{n} ({i})" for n, i, _, _ in empty[:3])
        add(WARNING, "empty-spectrum", f"{len(empty)} spectra are empty, first {first}", f"byte {empty[0][2]}")
    try:
        found = {r[2] for r in element_rows(path)}
        for p in REQUIRED:
            if p not in found:
                add(ERROR, "missing-element", f"no {'mzML' if p == '.' else p}", p)
    except ET.ParseError as e:
        add(ERROR, "not-well-formed", str(e))
    return out


def schema_findings(faults: DataFrame, k: int = 3) -> DataFrame:
    """A finding a file, element name, kind of fault and subject: how many elements have it and the first k of them."""
    w = Window.partitionBy("file", "name", "fault", "subject").orderBy("element")
    got = faults.withColumn("r", F.row_number().over(w)).groupBy("file", "name", "fault", "subject").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("r") <= k, F.col("element")))).alias("first"))
    return got.select("file", F.lit(ERROR).alias("severity"), F.lit("schema").alias("check"), F.format_string("%d times %s: %s, first in element %s", "n", "fault", "subject", F.concat_ws(", ", "first")).alias("message"), F.col("name").alias("location"))


def validate(spark: SparkSession, paths, level: str = "standard", vocabulary: str | None = None) -> DataFrame:
    """Findings of mzML files: minimal checks bytes and structure, standard and strict also vocabulary rules, strict the schema's too.

    A task checks a file; elements then meet rules as relations. ``vocabulary`` names an OBO file whose closure tells which
    terms are below a rule's; without it a table of common terms does.
    """
    files = mzml.files_of(paths)
    at = spark.createDataFrame([(f,) for f in files], "file string").repartition(len(files))

    def check(batches):
        import pandas as pd

        for b in batches:
            rows = [x for f in b["file"] for x in byte_findings(f)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FINDING.split(", ")])

    found = at.mapInPandas(check, FINDING)
    if level == "minimal":
        return found

    def listed(batches):
        import pandas as pd

        for b in batches:
            for f in b["file"]:
                try:
                    yield pd.DataFrame(element_rows(f), columns=["file", "element", "path", "own", "refs"])
                except ET.ParseError:
                    pass

    rows = at.mapInPandas(listed, "file string, element long, path string, own array<string>, refs array<string>")
    group = F.col("path").startswith("group:")
    groups = rows.where(group).select("file", F.expr("substring(path, 7)").alias("id"), F.col("own").alias("terms"))
    resolved = accessions(rows.where(~group), groups)
    if vocabulary:
        ancestors = ontology.closure(ontology.read(spark, vocabulary)[1].where("relation = 'is_a'").select("child", "parent"))
        failed = ontology.failures(resolved, rules(spark, level), ancestors)
    else:
        failed = rule_failures(resolved, rules(spark, level))
    found = found.unionByName(samples(failed))
    return found.unionByName(schema_findings(schema.faults(schema.elements_of(spark, files)))) if level == "strict" else found


def verify(spark: SparkSession, paths) -> DataFrame:
    """(file, bytes, ok, null_offset, null_length): the first run of null bytes of each file, if any."""
    files = mzml.files_of(paths)

    def check(batches):
        import pandas as pd

        for b in batches:
            runs = [(null_runs(f) or [(None, None)])[0] for f in b["file"]]
            yield pd.DataFrame({"file": b["file"], "bytes": [os.path.getsize(f) for f in b["file"]], "ok": [r[0] is None for r in runs], "null_offset": pd.array([r[0] for r in runs], "Int64"), "null_length": pd.array([r[1] for r in runs], "Int64")})

    return spark.createDataFrame([(f,) for f in files], "file string").repartition(len(files)).mapInPandas(check, "file string, bytes long, ok boolean, null_offset long, null_length long")


def severity_counts(findings: DataFrame) -> DataFrame:
    """(file, worst, infos, warnings, errors)."""
    return findings.groupBy("file").agg(F.max("severity").alias("worst"), *[F.count_if(F.col("severity") == s).alias(n) for s, n in ((INFO, "infos"), (WARNING, "warnings"), (ERROR, "errors"))])


def union_ranges(ranges: DataFrame, key: str = "file") -> DataFrame:
    """(key, begin, end): the union of half-open ranges that overlap or touch."""
    w = Window.partitionBy(key).orderBy("begin", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("begin") > reach).cast("int"), F.lit(1))
    return ranges.withColumn("new", new).withColumn("island", F.sum("new").over(w)).groupBy(key, "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("island")


def enclosing(points: DataFrame, spans: DataFrame, key: str = "file", lookback: int = 200_000) -> DataFrame:
    """(key, offset, id): the span that begins last at or before each offset and no more than ``lookback`` before it.

    Both sides are merged in one window of a key in order of offset; the last span's begin is carried forward, so nothing is joined.
    """
    p = points.select(key, F.col("offset").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("id"))
    s = spans.select(key, F.col("begin").alias("at"), F.lit(0).alias("kind"), F.col("id").cast("string").alias("id"))
    w = Window.partitionBy(key).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("kind") == 0, F.struct("at", "id")), ignorenulls=True).over(w)
    got = p.unionByName(s).withColumn("last", last).where("kind = 1")
    return got.select(key, F.col("at").alias("offset"), F.when(F.col("at") - F.col("last.at") <= lookback, F.col("last.id")).alias("id"))


def match_sources(corrupt: DataFrame, sources: DataFrame) -> DataFrame:
    """(file, source) of (file) and (source): the first source whose stem is the file's without a centroid suffix."""
    stem = lambda c: F.regexp_replace(F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"(?i)\.mzml$", ""), r"\.(centroid|centroided|peaks)$", "")
    s = sources.groupBy(stem("source").alias("stem")).agg(F.min("source").alias("source"))
    return corrupt.withColumn("stem", stem("file")).join(s, "stem", "left").select("file", "source")
