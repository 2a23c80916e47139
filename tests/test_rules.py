import glob
import re

import duckdb
import pyarrow.parquet as pq
import pytest

from spectrasieve import shared
from spectrasieve.operators import ontology, schema, verify
from spectrasieve.plans import catalog
from spectrasieve.sources import mzml, mzml_sink
from tests.test_mzml import records

OBO = """format-version: 1.2

[Term]
id: X:1
name: top

[Term]
id: X:2
name: below
is_a: X:1 ! top

[Term]
id: X:3
name: deep
is_a: X:2 ! below
relationship: part_of X:9 ! other
is_obsolete: true

[Typedef]
id: part_of
"""


@pytest.fixture
def doc(tmp_path):
    p = str(tmp_path / "run.mzML")
    mzml_sink.write_clean(p, records(), 6)
    return p


def faulty(tmp_path, doc, *changes):
    data = open(doc).read()
    for old, new in changes:
        assert re.search(old, data)
        data = re.sub(old, new, data, count=1)
    p = str(tmp_path / "faulty.mzML")
    with open(p, "w") as f:
        f.write(data)
    return p


def test_clean_documents_follow_the_schema(spark, doc):
    elements = schema.elements_of(spark, [doc])
    assert schema.faults(elements).count() == 0
    rows = elements.orderBy("element").collect()
    assert rows[0].parent is None and [r.element for r in rows] == list(range(len(rows))) and sum(r.name == "spectrum" for r in rows) == 6
    assert [r.position for r in rows if r.name == "spectrum"] == list(range(6))


@pytest.mark.parametrize(("changes", "want"), [
    ([(r"<scanList.*?</scanList>", ""), (r"</spectrum>", '<scanList count="1"><scan/></scanList></spectrum>')], {("spectrum", "order", "scanList")}),
    ([(r"<cvList.*?</cvList>", "")], {("mzML", "too few", "cvList")}),
    ([(r"(<dataProcessingList.*?</dataProcessingList>)", r"\1\1")], {("mzML", "too many", "dataProcessingList")}),
    ([(r"<software ", "<hardware/><software ")], {("softwareList", "unknown child", "hardware")}),
    ([(r'(<spectrum [^>]*)defaultArrayLength="\d+"', r'\1defaultArrayLength="many"'), (r'<spectrum index="\d+"', "<spectrum"), (r'<spectrumList ', '<spectrumList x="1" ')], {("spectrum", "attribute type", "defaultArrayLength"), ("spectrum", "missing attribute", "index"), ("spectrumList", "unknown attribute", "x")}),
    ([(r"<binaryDataArray .*?</binaryDataArray>", "")], {("binaryDataArrayList", "too few", "binaryDataArray")}),
])
def test_schema_faults(spark, tmp_path, doc, changes, want):
    got = schema.faults(schema.elements_of(spark, [faulty(tmp_path, doc, *changes)]))
    assert {(r.name, r.fault, r.subject) for r in got.collect()} == want


def test_strict_validation_counts_schema_faults(spark, tmp_path, doc):
    bad = faulty(tmp_path, doc, (r"<cvList.*?</cvList>", ""))
    found = [r for r in verify.validate(spark, [doc, bad], "strict").collect() if r.check == "schema"]
    assert [(r.file, r.severity, r.location) for r in found] == [(bad, verify.ERROR, "mzML")] and found[0].message.startswith("1 times too few: cvList")
    assert not [r for r in verify.validate(spark, bad, "standard").collect() if r.check == "schema"]


def test_empty_spectra_are_one_counted_warning(spark, tmp_path):
    p = str(tmp_path / "e.mzML")
    mzml_sink.write_clean(p, records(40, empty=range(5, 35)), 40)
    found = [r for r in verify.validate(spark, p, "minimal").collect() if r.check == "empty-spectrum"]
    assert len(found) == 1 and found[0].severity == verify.WARNING and found[0].message.startswith("30 spectra are empty, first 5 (scan=6)")


def test_vocabulary(spark, tmp_path):
    path = str(tmp_path / "v.obo")
    for text in (OBO, OBO.replace("\n", "\r\n").replace("\r\n\r\n", "\n\n")):
        with open(path, "w", newline="") as f:
            f.write(text)
        terms, parents = ontology.read(spark, path)
        assert sorted(map(tuple, terms.collect())) == [("X:1", "top", False), ("X:2", "below", False), ("X:3", "deep", True)]
        assert sorted(map(tuple, parents.collect())) == [("X:2", "X:1", "is_a"), ("X:3", "X:2", "is_a"), ("X:3", "X:9", "part_of")]
    above = ontology.closure(parents.where("relation = 'is_a'").select("child", "parent"))
    assert sorted(map(tuple, above.collect())) == [("X:2", "X:1"), ("X:3", "X:1"), ("X:3", "X:2")]
    elements = spark.createDataFrame([("f", 1, "p", ["X:3", "Y:1"]), ("f", 2, "p", ["X:1"]), ("f", 3, "p", ["Y:1"]), ("f", 4, "p", []), ("f", 5, "q", [])], "file string, element long, path string, accessions array<string>")
    rules = spark.createDataFrame([("p", "X:1", "top")], "path string, parent string, label string")
    assert sorted(r.element for r in ontology.failures(elements, rules, above).collect()) == [3, 4]
    chain = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(70, 0)], "child long, parent long")
    assert ontology.closure(chain).count() == 71 * 71 and ontology.closure(chain.where("false")).count() == 0


def test_validation_by_a_vocabulary_file(spark, tmp_path, doc):
    level = "MS:1000511"
    path = str(tmp_path / "v.obo")
    with open(path, "w") as f:
        f.write("\n\n".join(f"[Term]\nid: {c}\nis_a: {p}" for c, p in (("MS:1000580", "MS:1000559"), ("MS:1000128", "MS:1000525"), (mzml.MZ, "MS:1000513"))))
    by_table = verify.validate(spark, doc, "standard").where("check = 'cv-term'").collect()
    by_file = verify.validate(spark, doc, "standard", path).where("check = 'cv-term'").collect()
    assert level and {r.message.split(" (")[1] for r in by_table} <= {r.message.split(" (")[1] for r in by_file}
    assert not any("spectrum type" in r.message or "spectrum representation" in r.message for r in by_file)


def test_what_is_below_the_terms_asked_for(spark):
    edges = [(i, i // 2) for i in range(1, 40)] + [(i, i - 7) for i in range(10, 40, 3)] + [(3, 30), (50, None), (None, 4), (7, 3)]
    df = spark.createDataFrame(edges, "child long, parent long")
    for asked in ([3, 12, 99], [30], [99], []):
        got = ontology.below(df, spark.createDataFrame([(a,) for a in asked * 2], "parent long")).collect()
        assert sorted(map(tuple, got)) == sorted(tuple(r) for r in ontology.closure(df).collect() if r.ancestor in asked)


@pytest.mark.parametrize("bits", [62, 2])
def test_failures_by_sets_of_rules(spark, monkeypatch, bits):
    """Of more rules than a set holds; elements without terms or keys fail all of their path."""
    monkeypatch.setattr(ontology, "BITS", bits)
    rules = [("p", f"X:{i}", f"r{i}") for i in range(5)] + [("q", "X:1", "r"), ("q", "X:1", "s"), ("q", None, "none"), ("unused", "X:2", "u")]
    above = [("Y:1", "X:1"), ("Y:1", "X:3"), ("Y:4", "X:4")]
    elements = [("f", 1, "p", ["Y:1", "Y:9", "Y:1"]), ("f", 2, "p", ["X:0", "Y:4", None]), ("g", 2, "p", []), ("g", 2, "q", ["Y:1"]), ("g", 3, "q", None), (None, 4, "q", ["X:1"]), ("f", None, "p", ["X:0"]), ("f", 5, "other", ["X:1"]), ("f", 6, None, [])]
    resolved = spark.createDataFrame(elements, "file string, element long, path string, accessions array<string>")
    met = lambda terms, parent: parent in terms or any((t, parent) in above for t in terms)
    want = {(f, e, p, parent, label) for f, e, p, terms in elements for q, parent, label in rules if p == q and (f is None or e is None or parent is None or not met(terms or [], parent))}
    got = ontology.failures(resolved, spark.createDataFrame(rules, "path string, parent string, label string"), spark.createDataFrame(above, "child string, ancestor string")).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_failures_need_only_what_is_below_the_rules(spark, tmp_path):
    """The query equals its SQL, and of its vocabulary it writes the steps and what is below the rules' terms, no more."""
    part = [(i, i % 9 * 5 if i % 10 else 3) for i in range(1, 601)] + [(None, 5), (610, None)]
    spark.createDataFrame(part, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(o, o * 37 % 620 + o % 3 * k) for o in range(150) for k in range(1 + o % 3)] + [(None, 5), (None, 12), (900, None), (901, 5), (901, 12)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    folder = shared.folder(spark).removeprefix("file://")
    files = lambda: set(glob.glob(f"{folder}/**/*.parquet", recursive=True))
    before = files()
    got = catalog.queries()["vocabulary_failures"](spark, str(tmp_path)).collect()
    written = sum(pq.read_metadata(f).num_rows for f in files() - before)
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.sql(catalog.oracle_sql()["vocabulary_failures"]).fetchall()))
    count = lambda what: con.sql(re.sub("SELECT 'x' AS file.*", what, catalog.oracle_sql()["vocabulary_failures"], flags=re.S)).fetchall()[0][0]
    assert written == count("SELECT count(*) FROM e") + count("SELECT count(*) FROM c WHERE ancestor IN (5, 12)") and got
