"""Queries on documents: vocabulary rules, counts, offsets, ranges and mzML round trips."""

from __future__ import annotations

import os
import re
import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from spectrasieve import model, shared
from spectrasieve.operators import centroid, ontology, repair, schema, verify
from spectrasieve.plans import catalog
from spectrasieve.plans.catalog import query
from spectrasieve.sources import mzml, mzml_sink, views
from spectrasieve.streaming import stream

ELEMENTS = """el AS (SELECT 'f' || l_linenumber % 3 AS file, row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS element, 'run/spectrumList/spectrum' AS path,
  CASE WHEN l_returnflag = 'A' THEN ['MS:1000580', 'MS:1000128'] WHEN l_returnflag = 'N' THEN ['MS:1000580'] ELSE ['MS:1000511'] END AS own,
  CASE WHEN l_linestatus = 'O' THEN ['g1'] ELSE CAST([] AS VARCHAR[]) END AS refs FROM lineitem),
gr AS (SELECT DISTINCT file, 'g1' AS id, CASE WHEN file = 'f1' THEN ['MS:1000128', 'MS:1000580'] ELSE ['MS:1000127'] END AS terms FROM el),
ac AS (SELECT el.file, element, path, list_distinct(list_concat(own, coalesce(terms, CAST([] AS VARCHAR[])))) AS accessions FROM el LEFT JOIN gr ON gr.file = el.file AND list_contains(refs, gr.id))"""


def _elements(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    own = F.when(F.col("l_returnflag") == "A", F.array(F.lit("MS:1000580"), F.lit("MS:1000128"))).when(F.col("l_returnflag") == "N", F.array(F.lit("MS:1000580"))).otherwise(F.array(F.lit("MS:1000511")))
    refs = F.when(F.col("l_linestatus") == "O", F.array(F.lit("g1"))).otherwise(F.array().cast("array<string>"))
    rows = li.select(F.concat(F.lit("f"), (F.col("l_linenumber") % 3).cast("string")).alias("file"), F.xxhash64(*li.columns).alias("element"), F.lit("run/spectrumList/spectrum").alias("path"), own.alias("own"), refs.alias("refs"), "l_returnflag", "l_linestatus")
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("element").orderBy("file"))).withColumn("element", F.concat_ws("-", "element", "copy"))
    terms = F.when(F.col("file") == "f1", F.array(F.lit("MS:1000128"), F.lit("MS:1000580"))).otherwise(F.array(F.lit("MS:1000127")))
    return rows, rows.select("file").distinct().select("file", F.lit("g1").alias("id"), terms.alias("terms"))


@query(f"WITH {ELEMENTS} SELECT file, list_sort(accessions) AS accessions, count(*) AS n FROM ac GROUP BY ALL")
def param_group_accessions(spark, sf_dir):
    rows, groups = _elements(spark, sf_dir)
    got = verify.accessions(rows, groups)
    return got.groupBy("file", F.array_sort("accessions").alias("accessions")).agg(F.count("*").alias("n"))


@query(f"""WITH {ELEMENTS}, ru AS (SELECT * FROM (VALUES ('MS:1000559', 'spectrum type', {verify.DESCENDANTS['MS:1000559'].split()}), ('MS:1000525', 'spectrum representation', {verify.DESCENDANTS['MS:1000525'].split()})) t(parent, label, allowed))
SELECT file, parent, label, count(*) AS n FROM ac, ru WHERE NOT list_has_any(accessions, allowed) GROUP BY ALL""")
def cv_rule_failures(spark, sf_dir):
    rows, groups = _elements(spark, sf_dir)
    failed = verify.rule_failures(verify.accessions(rows, groups), verify.rules(spark))
    return failed.groupBy("file", "parent", "label").agg(F.count("*").alias("n"))


RANGES = "rg AS (SELECT l_suppkey AS file, l_orderkey AS begin, l_orderkey + CAST(l_quantity AS BIGINT) AS \"end\" FROM lineitem)"


def _ranges(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select(F.col("l_suppkey").alias("file"), F.col("l_orderkey").alias("begin"), (F.col("l_orderkey") + F.col("l_quantity").cast("long")).alias("end"))


@query(f"""WITH {RANGES}, a AS (SELECT *, max("end") OVER (PARTITION BY file ORDER BY begin, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM rg),
b AS (SELECT *, sum(CASE WHEN begin > reach OR reach IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY begin, "end" ROWS UNBOUNDED PRECEDING) AS island FROM a)
SELECT file, min(begin) AS begin, max("end") AS "end" FROM b GROUP BY file, island""")
def null_ranges_union(spark, sf_dir):
    return verify.union_ranges(_ranges(spark, sf_dir))


@query("""WITH sp AS (SELECT o_custkey AS file, o_orderkey AS begin, CAST(max(o_orderstatus) AS VARCHAR) AS id FROM orders GROUP BY 1, 2), pt AS (SELECT o_custkey AS file, o_orderkey + 7 AS "offset" FROM orders)
SELECT pt.file, "offset", CASE WHEN "offset" - begin <= 100 THEN id END AS id FROM pt ASOF LEFT JOIN sp ON pt.file = sp.file AND sp.begin <= "offset" """)
def null_enclosing_spectrum(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    spans = o.groupBy(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("begin")).agg(F.max("o_orderstatus").alias("id"))
    return verify.enclosing(o.select(F.col("o_custkey").alias("file"), (F.col("o_orderkey") + 7).alias("offset")), spans, lookback=100)


@query("""WITH c AS (SELECT 'x/run' || c_custkey % 40 || CASE c_custkey % 3 WHEN 0 THEN '.centroid' WHEN 1 THEN '.peaks' ELSE '' END || '.mzML' AS file FROM customer),
s AS (SELECT 'raw' || s_suppkey % 2 || '/run' || s_suppkey % 50 || '.mzML' AS source FROM supplier)
SELECT c.file, (SELECT min(source) FROM s WHERE regexp_extract(source, '/(run[0-9]+)[.]', 1) = regexp_extract(c.file, '/(run[0-9]+)[.]', 1)) AS source FROM c""")
def matched_sources(spark, sf_dir):
    k = F.col("c_custkey")
    tag = F.when(k % 3 == 0, ".centroid").when(k % 3 == 1, ".peaks").otherwise("")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("x/run"), k % 40, tag, F.lit(".mzML")).alias("file"))
    s = F.col("s_suppkey")
    return verify.match_sources(c, spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("raw"), s % 2, F.lit("/run"), s % 50, F.lit(".mzML")).alias("source")))


SPECTRA = 500  # consecutive ids a document


def _documents(spark, sf_dir, empty: str | None = None) -> str:
    """The embedding view as mzML files of at most ``SPECTRA`` consecutive ids each in a new folder; spectra for which ``empty`` holds have no points."""
    folder = shared.new_files(spark)
    rows = views.spectra(spark, sf_dir, "emb")
    if empty:
        rows = rows.withColumns({c: F.when(F.expr(empty), F.slice(c, 1, 0)).otherwise(F.col(c)) for c in ("mz", "intensity")})

    def write(table):
        import pyarrow as pa

        part = table.column("part")[0].as_py()
        records = ({"native_id": f"scan={r['spectrum_id']}", "ms_level": r["ms_level"], "retention_time_min": r["spectrum_id"] / 60, "filter_string": "ITMS + p NSI t Full ms2", "mz": r["mz"], "intensity": r["intensity"], "mode": "profile"} for r in sorted(table.to_pylist(), key=lambda r: r["spectrum_id"]))
        target = f"{folder}/part{part}.mzML"
        return pa.table({"file": [target], "n": pa.array([mzml_sink.write_clean(target, records, len(table))], pa.int64())})

    rows.withColumn("part", F.floor(F.col("spectrum_id") / SPECTRA)).groupBy("part").applyInArrow(write, "file string, n long").collect()
    return folder


def _each(spark, folder: str, found, schema: str):
    """The rows (part, ...) that ``found`` gives for each file, a task a file."""

    def task(batches):
        import pandas as pd

        for b in batches:
            for path in b["path"]:
                part = int(re.search(r"part(\d+)", path)[1])
                yield pd.DataFrame([(part, *r) for r in found(path, part)], columns=[c.split()[0] for c in schema.split(", ")])

    paths = mzml.files_of(folder)
    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths)).mapInPandas(task, schema)


PARTS = "sp AS (SELECT vec_id, vec_id // 500 AS part, vec_id % 7 = 3 AS gone FROM embeddings WHERE vec_id IS NOT NULL)"


@query(f"WITH {PARTS} SELECT part, count(*) + (part + 1) % 2 AS declared, count(*) AS actual, count(*) AS indexed, part % 2 = 0 AS mismatch FROM sp GROUP BY part")
def count_mismatch(spark, sf_dir):
    """Documents of which every second declares one spectrum too many."""

    def found(path, part):
        have = verify.counts(path)
        repair.declare(path, have["actual"] + (part + 1) % 2)
        c = verify.counts(path)
        yield c["declared"], c["actual"], c["indexed"], c["declared"] != c["actual"]

    return _each(spark, _documents(spark, sf_dir), found, "part long, declared long, actual long, indexed long, mismatch boolean")


@query(f"WITH {PARTS}, n AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS number FROM sp) SELECT part, number, 'scan=' || vec_id AS id FROM n WHERE gone")
def empty_spectra(spark, sf_dir):
    return _each(spark, _documents(spark, sf_dir, "spectrum_id % 7 = 3"), lambda path, _: [r[:2] for r in verify.empty_spectra(path)], "part long, number long, id string")


@query(f"WITH {PARTS} SELECT part, 'scan=' || vec_id AS id, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS new_index FROM sp WHERE NOT gone")
def renumber(spark, sf_dir):
    """The numbers of spectra after the empty ones were removed."""

    def found(path, _):
        repair.remove_empty(path)
        for _, raw in mzml.elements(path, 0, os.path.getsize(path)):
            head = raw[: raw.index(b">")]
            yield re.search(rb'\sid="([^"]*)"', head)[1].decode(), int(re.search(rb'\sindex="(\d+)"', head)[1])

    return _each(spark, _documents(spark, sf_dir, "spectrum_id % 7 = 3"), found, "part long, id string, new_index long")


@query(f"WITH {PARTS} SELECT part, 'scan=' || vec_id AS id, true AS holds FROM sp")
def byte_offsets(spark, sf_dir):
    """Whether each offset of an index is where its spectrum begins."""

    def found(path, _):
        with open(path, "rb") as f:
            data = f.read()
        for i, at in mzml.index_of(path)["spectrum"]:
            yield i, data.startswith(b"<spectrum ", at) and f'id="{i}"'.encode() in data[at : data.index(b">", at)]

    return _each(spark, _documents(spark, sf_dir), found, "part long, id string, holds boolean")


def _key(df):
    return df.withColumn("spectrum_id", F.regexp_extract("native_id", "scan=(.*)", 1).cast("long"))


CONFIG = model.Config(noise_window_da=2.0, noise_step_da=0.5)


@query(f"WITH {views.points_sql('emb')} SELECT spectrum_id, 2 AS ms_level, CAST(count(*) AS INTEGER) AS n, round(sum(intensity), 3) AS total FROM p GROUP BY 1")
def mzml_scan(spark, sf_dir):
    """What was written as mzML, read again."""
    got = _key(mzml.read(spark, _documents(spark, sf_dir), block=1 << 18))
    return got.select("spectrum_id", "ms_level", F.size("mz").alias("n"), F.aggregate("intensity", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("total")).withColumn("total", F.round("total", 3))


@query(f"WITH {views.points_sql('emb')}, n AS (SELECT *, spectrum_id % 500 AS number FROM p) SELECT spectrum_id, CAST(number AS BIGINT) AS scan_number, CAST(count(*) AS INTEGER) AS n, round(sum(intensity), 3) AS total FROM n WHERE number BETWEEN 120 AND 131 AND mz BETWEEN 201 AND 205 GROUP BY 1, 2")
def mzml_seek(spark, sf_dir):
    """A range of spectra of each document, sought by its index, and of their points a range of m/z."""
    got = _key(mzml.read(spark, _documents(spark, sf_dir), scans=(120, 131), window=(201.0, 205.0)))
    return got.select("spectrum_id", F.col("scan_number").cast("long"), F.size("mz").alias("n"), F.aggregate("intensity", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("total")).withColumn("total", F.round("total", 3))


@query("SELECT vec_id AS spectrum_id, 2 AS ms_level, CAST(vec_id AS DOUBLE) / 60 AS retention_time_min, 'ITMS + p NSI t Full ms2' AS filter_string, 'profile' AS mode FROM embeddings WHERE vec_id IS NOT NULL")
def mzml_headers(spark, sf_dir):
    """What spectra tell besides their arrays, read without them, also of spectra without points."""
    folder = _documents(spark, sf_dir, "spectrum_id % 7 = 3")
    got = _key(mzml.read(spark, folder, mode="any", columns=["native_id", "ms_level", "retention_time_min", "filter_string", "mode"]))
    return got.select("spectrum_id", "ms_level", "retention_time_min", "filter_string", "mode")


@query(f"WITH {PARTS} SELECT vec_id AS spectrum_id FROM sp WHERE NOT gone QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= 40")
def mzml_first(spark, sf_dir):
    """The first 40 spectra with points of each document."""
    return _key(mzml.first(spark, _documents(spark, sf_dir, "spectrum_id % 7 = 3"), 40)).select("spectrum_id")


@query(f"WITH {views.points_sql('emb')} SELECT spectrum_id, CAST(count(*) AS INTEGER) AS n, round(sum(intensity), 3) AS total FROM p GROUP BY 1")
def mzml_stream(spark, sf_dir):
    """Documents read as a stream: half of them arrive, then the rest; each is read once."""
    folder, work = _documents(spark, sf_dir), shared.new_files(spark)
    os.makedirs(f"{work}/landing")
    names = mzml.files_of(folder)
    for part in (names[::2], names[1::2]):
        for name in part:
            os.rename(name, f"{work}/landing/{os.path.basename(name)}")
        made = mzml.arriving(spark, f"{work}/landing", settle=0.1)
        time.sleep(0.2)
        stream.drain(made.select("native_id", F.size("mz").alias("n"), F.aggregate("intensity", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("total")), f"{work}/out", f"{work}/state")
    return _key(spark.read.parquet(f"{work}/out")).select("spectrum_id", "n", F.round("total", 3).alias("total"))


def _round_trip(spark, sf_dir, config, **kw):
    folder = _documents(spark, sf_dir)
    found = centroid.centroid(mzml.read(spark, folder), config, (0.34, 0.34), (0.125, 0.125), ("file", "scan_number"), **kw)
    targets = [r.target for r in mzml_sink.write_centroided(found, shared.new_files(spark)).collect()]
    back = _key(mzml.read(spark, targets, mode="any"))
    return back.select("spectrum_id", "mode", F.posexplode(F.arrays_zip("mz", "intensity")).alias("centroid_idx", "c")).select("spectrum_id", "mode", "centroid_idx", "c.mz", "c.intensity")


@query()
def mzml_round_trip(spark, sf_dir):
    """Centroids written back over their documents and read again."""
    return _round_trip(spark, sf_dir, CONFIG)


SWEPT = catalog.own("emb", catalog.SWEPT)


@query(f"WITH RECURSIVE {SWEPT} SELECT spectrum_id, 'centroid' AS mode, centroid_idx, round(mz, 6) AS mz, round(CAST(intensity AS FLOAT), 2) AS intensity FROM ct")
def mzml_round_trip_swept(spark, sf_dir):
    """The same with a set number of sweeps, which SQL can follow."""
    got = _round_trip(spark, sf_dir, catalog._swept_config(), direct=False)
    return got.withColumns({"mz": F.round("mz", 6), "intensity": F.round(F.col("intensity").cast("float"), 2)})


@query()
def mzml_verify(spark, sf_dir):
    return verify.verify(spark, _documents(spark, sf_dir)).select("bytes", "ok", "null_offset", "null_length")


@query()
def mzml_validate(spark, sf_dir):
    found = verify.validate(spark, _documents(spark, sf_dir), "strict")
    return found.select("severity", "check", "message", "location")


REPAIRED = ("runs", "restored", "removed", "declared", "actual", "errors")


@query()
def mzml_repair(spark, sf_dir):
    """A damaged copy of each document, repaired from its source, a task a document; what was done and the number of errors left."""
    folder, work = _documents(spark, sf_dir), shared.new_files(spark)

    def task(batches):
        import pyarrow as pa

        for b in batches:
            for path in b.column("path").to_pylist():
                broken = os.path.join(work, os.path.basename(path))
                with open(path, "rb") as f:
                    data = bytearray(f.read())
                at = max(data.find(b"<binary>", len(data) // 2), data.rfind(b"<binary>", 0, len(data) // 2)) + 8
                data[at : at + 80] = bytes(80)
                with open(broken, "wb") as f:
                    f.write(data)
                yield pa.RecordBatch.from_pylist([repair.repair(broken, path)], schema=pa.schema([(c, pa.int64()) for c in REPAIRED]))

    paths = mzml.files_of(folder)
    each = spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths))
    return each.mapInArrow(task, ", ".join(f"{c} long" for c in REPAIRED))


def _streamed(spark, sf_dir, config, **kw):
    folder = shared.new_files(spark)
    views.spectra(spark, sf_dir, "emb").write.mode("overwrite").parquet(f"{folder}/in")
    return stream.centroid_all(spark, f"{folder}/in", f"{folder}/out", f"{folder}/state", config, (0.34, 0.34), (0.125, 0.125), **kw)


@query()
def stream_centroids(spark, sf_dir):
    """The embedding view centroided as a stream of files."""
    return _streamed(spark, sf_dir, CONFIG)


@query(f"WITH RECURSIVE {SWEPT} SELECT spectrum_id, centroid_idx, round(mz, 6) AS mz, round(intensity, 3) AS intensity FROM ct")
def stream_centroids_swept(spark, sf_dir):
    """The same with a set number of sweeps, which SQL can follow."""
    got = _streamed(spark, sf_dir, catalog._swept_config(), direct=False)
    return got.withColumns({"mz": F.round("mz", 6), "intensity": F.round("intensity", 3)})


KINDS = {"spectrum": ("cvParam", "scanList", "precursorList", "productList", "binaryDataArrayList", "extra"), "precursor": ("isolationWindow", "selectedIonList", "activation", "activation", "cvParam", "isolationWindow")}
_PICK = {k: "[" + ", ".join(f"'{x}'" for x in v) + "]" for k, v in KINDS.items()}
_RULES = ", ".join(f"('{p}', '{name}', {i}, {least}, {'NULL' if most is None else most})" for p in KINDS for i, (name, least, most) in enumerate(map(schema.bounds, schema.CONTENT[p].split())))
TREE = f"""par AS (SELECT DISTINCT o_orderkey AS parent, 'f' || o_orderkey % 4 AS file, CASE WHEN o_orderkey % 3 = 0 THEN 'precursor' ELSE 'spectrum' END AS parent_name FROM orders),
kid0 AS (SELECT l_orderkey AS parent, l_linenumber, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 5 END AS turn, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag) - 1 AS position FROM lineitem),
kid AS (SELECT par.*, position, CASE WHEN parent_name = 'precursor' THEN {_PICK['precursor']} ELSE {_PICK['spectrum']} END[(l_linenumber + turn - 1) % 6 + 1] AS name FROM kid0 JOIN par USING (parent)),
ru AS (SELECT * FROM (VALUES {_RULES}) t(parent_name, name, place, least, most)),
pl AS (SELECT kid.*, place, lag(place) OVER (PARTITION BY parent ORDER BY position) AS last FROM kid LEFT JOIN ru USING (parent_name, name)),
ct AS (SELECT par.file, parent, ru.parent_name, ru.name, least, most, (SELECT count(*) FROM kid WHERE kid.parent = par.parent AND kid.name = ru.name) AS n FROM par JOIN ru USING (parent_name)),
fa AS (SELECT DISTINCT file, parent, parent_name, 'unknown child' AS fault, name FROM pl WHERE place IS NULL
  UNION ALL SELECT file, parent, parent_name, 'order', name FROM pl WHERE place < last
  UNION ALL SELECT file, parent, parent_name, 'too few', name FROM ct WHERE n < least UNION ALL SELECT file, parent, parent_name, 'too many', name FROM ct WHERE n > most)"""


def _tree(spark, sf_dir):
    """Orders as elements and their lines as children, of kinds that are often out of order."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("element"), "o_orderstatus", "o_totalprice")
    name = F.when(F.col("element") % 3 == 0, "precursor").otherwise("spectrum")
    file = F.concat(F.lit("f"), (F.col("element") % 4).cast("string"))
    price = F.col("o_totalprice")
    attributes = F.map_filter(F.create_map(F.lit("index"), F.when(price > 200_000, F.lit("-1")).otherwise(F.col("element").cast("string")), F.lit("id"), F.when(F.col("o_orderstatus") != "F", F.lit("x")), F.lit("defaultArrayLength"), F.lit(" 12 "), F.lit("level"), F.when(price < 50_000, F.lit("2"))), lambda _, v: v.isNotNull())
    top = o.groupBy("element").agg(F.min("o_orderstatus").alias("o_orderstatus"), F.min("o_totalprice").alias("o_totalprice"))
    top = top.select(file.alias("file"), "element", F.lit(None).cast("long").alias("parent"), name.alias("name"), F.lit(0).cast("long").alias("position"), attributes.alias("attributes"))
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")) - 1
    kind = (F.col("l_linenumber") + F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(5) - 1) % 6
    pick = F.when(F.col("l_orderkey") % 3 == 0, F.get(F.array(*map(F.lit, KINDS["precursor"])), kind)).otherwise(F.get(F.array(*map(F.lit, KINDS["spectrum"])), kind))
    kids = li.select(F.concat(F.lit("f"), (F.col("l_orderkey") % 4).cast("string")).alias("file"), (-F.col("l_orderkey") * 1000 - place).alias("element"), F.col("l_orderkey").alias("parent"), pick.alias("name"), place.cast("long").alias("position"), F.lit(None).cast("map<string,string>").alias("attributes"))
    return top.unionByName(kids)


@query(f"WITH {TREE} SELECT file, parent AS element, parent_name AS name, fault, name AS subject FROM fa")
def schema_content_faults(spark, sf_dir):
    return schema.content_faults(_tree(spark, sf_dir), schema.content_rules(spark, {k: schema.CONTENT[k] for k in KINDS}))


@query("""WITH o AS (SELECT o_orderkey AS element, min(o_orderstatus) AS st, min(o_totalprice) AS price FROM orders GROUP BY 1), s AS (SELECT *, 'f' || element % 4 AS file FROM o WHERE element % 3 <> 0)
SELECT file, element, 'spectrum' AS name, 'attribute type' AS fault, 'index' AS subject FROM s WHERE price > 200000 OR element < 0
UNION ALL SELECT file, element, 'spectrum', 'missing attribute', 'id' FROM s WHERE st = 'F' UNION ALL SELECT file, element, 'spectrum', 'unknown attribute', 'level' FROM s WHERE price < 50000""")
def schema_attribute_faults(spark, sf_dir):
    return schema.attribute_faults(_tree(spark, sf_dir).where("name = 'spectrum' and attributes is not null"), schema.attribute_rules(spark))


VOCABULARY = """e AS (SELECT DISTINCT p_partkey AS child, p_partkey // 3 AS parent FROM part WHERE p_partkey > 2 UNION SELECT p_partkey, p_partkey - p_size FROM part WHERE p_partkey > p_size AND p_size > 0 AND p_partkey % 5 = 0),
c AS (SELECT child, parent AS ancestor FROM e UNION SELECT c.child, e.parent FROM c JOIN e ON c.ancestor = e.child)"""


def _vocabulary(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    tree = p.where("p_partkey > 2").select(F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 3).alias("parent"))
    return tree.unionByName(p.where("p_partkey > p_size and p_size > 0 and p_partkey % 5 = 0").select(F.col("p_partkey").alias("child"), (F.col("p_partkey") - F.col("p_size")).alias("parent"))).distinct()


@query(f"WITH RECURSIVE {VOCABULARY} SELECT child, ancestor FROM c")
def vocabulary_closure(spark, sf_dir):
    return ontology.closure(_vocabulary(spark, sf_dir))


@query(f"""WITH RECURSIVE {VOCABULARY}, el AS (SELECT DISTINCT l_orderkey AS element, l_partkey AS term FROM lineitem), ids AS (SELECT DISTINCT element FROM el), ru AS (SELECT * FROM (VALUES (5, 'five'), (12, 'twelve')) t(parent, label))
SELECT 'x' AS file, element, 'spectrum' AS path, CAST(parent AS VARCHAR) AS parent, label FROM ids, ru WHERE NOT EXISTS (SELECT 1 FROM el WHERE el.element = ids.element AND (term = parent OR EXISTS (SELECT 1 FROM c WHERE child = term AND ancestor = parent)))""")
def vocabulary_failures(spark, sf_dir):
    """Orders as elements with their parts as terms, of which one must be below a rule's."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    terms = li.select(F.col("l_orderkey").alias("element"), F.lit("spectrum").alias("path"), F.col("l_partkey").alias("accession"))
    rules = spark.createDataFrame([("spectrum", 5, "five"), ("spectrum", 12, "twelve")], "path string, parent long, label string")
    failed = ontology.failures_of_terms(terms, rules, ontology.below(_vocabulary(spark, sf_dir), rules), keys=("element",))
    return failed.select(F.lit("x").alias("file"), "element", "path", F.col("parent").cast("string").alias("parent"), "label")
