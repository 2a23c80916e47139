"""Rules of the document schema as relations: order and number of an element's children, attributes and their types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What elements of mzML 1.1 hold, in order; ? at most one, * any number, + one or more, 2+ two or more.
PARAMS = "referenceableParamGroupRef* cvParam* userParam*"
CONTENT = {
    "indexedmzML": "mzML indexList indexListOffset fileChecksum?",
    "indexList": "index+",
    "index": "offset+",
    "mzML": "cvList fileDescription referenceableParamGroupList? sampleList? softwareList scanSettingsList? instrumentConfigurationList dataProcessingList run",
    "cvList": "cv+",
    "fileDescription": "fileContent sourceFileList? contact*",
    "fileContent": PARAMS,
    "sourceFileList": "sourceFile+",
    "sourceFile": PARAMS,
    "referenceableParamGroupList": "referenceableParamGroup+",
    "referenceableParamGroup": "cvParam* userParam*",
    "sampleList": "sample+",
    "softwareList": "software+",
    "software": PARAMS,
    "instrumentConfigurationList": "instrumentConfiguration+",
    "instrumentConfiguration": f"{PARAMS} componentList? softwareRef?",
    "dataProcessingList": "dataProcessing+",
    "dataProcessing": "processingMethod+",
    "processingMethod": PARAMS,
    "run": f"{PARAMS} spectrumList? chromatogramList?",
    "spectrumList": "spectrum*",
    "spectrum": f"{PARAMS} scanList? precursorList? productList? binaryDataArrayList?",
    "scanList": f"{PARAMS} scan+",
    "scan": f"{PARAMS} scanWindowList?",
    "scanWindowList": "scanWindow+",
    "scanWindow": PARAMS,
    "precursorList": "precursor+",
    "precursor": "isolationWindow? selectedIonList? activation",
    "isolationWindow": PARAMS,
    "selectedIonList": "selectedIon+",
    "selectedIon": PARAMS,
    "activation": PARAMS,
    "productList": "product+",
    "product": "isolationWindow?",
    "binaryDataArrayList": "binaryDataArray2+",
    "binaryDataArray": f"{PARAMS} binary",
    "chromatogramList": "chromatogram+",
    "chromatogram": f"{PARAMS} precursor? product? binaryDataArrayList",
}
# Attributes of elements; ! one that must be there.
ATTRIBUTES = {
    "mzML": "version!:string id:string accession:string",
    "cvList": "count!:count",
    "cv": "id!:string fullName!:string URI!:string version:string",
    "cvParam": "cvRef!:string accession!:string name!:string value:string unitCvRef:string unitAccession:string unitName:string",
    "userParam": "name!:string type:string value:string unitCvRef:string unitAccession:string unitName:string",
    "referenceableParamGroupRef": "ref!:string",
    "softwareList": "count!:count",
    "run": "id!:string defaultInstrumentConfigurationRef!:string defaultSourceFileRef:string sampleRef:string startTimeStamp:time",
    "spectrumList": "count!:count defaultDataProcessingRef!:string",
    "spectrum": "index!:count id!:string defaultArrayLength!:count dataProcessingRef:string sourceFileRef:string spotID:string",
    "scanList": "count!:count",
    "scanWindowList": "count!:count",
    "precursorList": "count!:count",
    "selectedIonList": "count!:count",
    "binaryDataArrayList": "count!:count",
    "binaryDataArray": "encodedLength!:count arrayLength:count dataProcessingRef:string",
    "offset": "idRef!:string spotID:string scanTime:number",
}
# Patterns of simple types.
TYPES = {"count": r"\s*\+?[0-9]+\s*", "number": r"\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*|\s*[+-]?INF\s*|\s*NaN\s*", "time": r"\s*-?[0-9]{4,}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?\s*", "string": r"(?s).*"}
FAULT = "file string, element long, name string, fault string, subject string"
ELEMENT = "file string, element long, parent long, name string, position long, attributes map<string,string>"


def bounds(child: str) -> tuple[str, int, int | None]:
    """A child's name, and how many of it there must and may be."""
    for sign, least, most in (("2+", 2, None), ("?", 0, 1), ("*", 0, None), ("+", 1, None)):
        if child.endswith(sign):
            return child[: -len(sign)], least, most
    return child, 1, 1


def content_rules(spark: SparkSession, content: dict[str, str] = CONTENT) -> DataFrame:
    """(parent_name, name, place, least, most): the children that an element holds, in order."""
    rows = [(parent, name, i, least, most) for parent, model in content.items() for i, (name, least, most) in enumerate(map(bounds, model.split()))]
    return spark.createDataFrame(rows, "parent_name string, name string, place int, least long, most long")


def attribute_rules(spark: SparkSession, attributes: dict[str, str] = ATTRIBUTES) -> DataFrame:
    """(name, attribute, required, pattern)."""
    rows = [(name, a.partition(":")[0].rstrip("!"), "!" in a, TYPES[a.partition(":")[2]]) for name, text in attributes.items() for a in text.split()]
    return spark.createDataFrame(rows, "name string, attribute string, required boolean, pattern string")


def content_faults(elements: DataFrame, rules: DataFrame) -> DataFrame:
    """FAULT rows of elements whose children are unknown, out of order, too few or too many, one a kind of child (order: a child).

    ``elements`` has the columns of ELEMENT; positions of an element's children are consecutive. Children meet the one before
    by position and are counted by name, so an element with very many is no hot group. Rules are few and broadcast.
    """
    rules, named = F.broadcast(rules), elements.select("file", F.col("element").alias("parent"), F.col("name").alias("parent_name"))
    known = rules.select("parent_name").distinct()
    own = elements.select("file", "parent", "name", "position").join(named, ["file", "parent"]).join(F.broadcast(known), "parent_name")
    placed = own.join(rules.select("parent_name", "name", "place"), ["parent_name", "name"], "left")
    fault = lambda df, kind, subject: df.select("file", F.col("parent").alias("element"), F.col("parent_name").alias("name"), F.lit(kind).alias("fault"), F.col(subject).alias("subject"))
    strange = fault(placed.where("place is null").select("file", "parent", "parent_name", "name").distinct(), "unknown child", "name")
    before = placed.select("file", "parent", (F.col("position") + 1).alias("position"), F.col("place").alias("last"))
    order = fault(placed.join(before, ["file", "parent", "position"]).where("place < last"), "order", "name")
    counts = own.groupBy("file", "parent", "name").agg(F.count("*").alias("n"))
    asked = named.join(rules, "parent_name").join(counts, ["file", "parent", "name"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    few, many = fault(asked.where("n < least"), "too few", "name"), fault(asked.where("n > most"), "too many", "name")
    return strange.unionByName(order).unionByName(few).unionByName(many)


def attribute_faults(elements: DataFrame, rules: DataFrame) -> DataFrame:
    """FAULT rows of attributes that are missing, unknown or not of their type."""
    rules = F.broadcast(rules)
    fault = lambda df, kind: df.select("file", "element", "name", F.lit(kind).alias("fault"), F.col("attribute").alias("subject"))
    met = elements.select("file", "element", "name", "attributes").join(rules, "name")
    value = F.col("attributes")[F.col("attribute")]
    missing = fault(met.where(F.col("required") & value.isNull()), "missing attribute")
    wrong = fault(met.where(~F.regexp(value, F.concat(F.lit("^(?:"), "pattern", F.lit(")$")))), "attribute type")
    known = rules.groupBy("name").agg(F.collect_set("attribute").alias("known"))
    strange = elements.select("file", "element", "name", F.explode(F.map_keys("attributes")).alias("attribute")).join(F.broadcast(known), "name").where(~F.array_contains("known", F.col("attribute")))
    return missing.unionByName(wrong).unionByName(fault(strange.where("attribute not like '%:%' and attribute not like '{%'"), "unknown attribute"))


def faults(elements: DataFrame) -> DataFrame:
    """All FAULT rows of ELEMENT rows by the rules of mzML 1.1."""
    spark = elements.sparkSession
    return content_faults(elements, content_rules(spark)).unionByName(attribute_faults(elements, attribute_rules(spark)))


def elements_of(spark: SparkSession, files: list[str]) -> DataFrame:
    """The ELEMENT rows of documents, a task a document, elements numbered in order; a document that does not parse ends there."""

    def task(batches):
        import xml.etree.ElementTree as ET

        import pyarrow as pa

        names = [c.split()[0] for c in ELEMENT.split(", ")]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.map_(pa.string(), pa.string())]
        for b in batches:
            for path in b.column("file").to_pylist():
                stack: list[list] = []  # (number, element, children so far)
                held, n = [], 0
                try:
                    for event, e in ET.iterparse(path, events=("start", "end")):
                        if event == "end":
                            stack.pop()
                            e.clear()
                            if stack:
                                stack[-1][1].remove(e)
                            continue
                        parent, position = (stack[-1][0], stack[-1][2]) if stack else (None, 0)
                        if stack:
                            stack[-1][2] += 1
                        held.append((path, n, parent, e.tag.rpartition("}")[2], position, list(e.attrib.items())))
                        stack.append([n, e, 0])
                        n += 1
                        if len(held) >= 20_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
                            held = []
                except ET.ParseError:
                    pass
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    return spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, len(files))).mapInArrow(task, ELEMENT)
