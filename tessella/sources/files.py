"""JSON lines, run directories, dimension files, logs and Turtle vocabularies."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tessella import storage


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None, limit: int | None = None, order: str | None = None) -> DataFrame:
    """Rows of JSON lines; with a limit the first ones by ``order``, or else by file and place in it."""
    reader = spark.read.schema(schema) if schema else spark.read
    if limit is None:
        return reader.json(path)
    out = reader.json(path).withColumns({"_file": F.input_file_name(), "_place": F.monotonically_increasing_id()})
    return out.orderBy(*([order] if order else ["_file", "_place"])).limit(limit).drop("_file", "_place")


def _run_number() -> Column:
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(F.input_file_name(), r"run(\d+)", 1), F.lit("")), F.lit("999999")).cast("int"), F.lit(1))


def read_runs(spark: SparkSession, path: str, suffix: str = ".extracted.jsonl", schema: str | None = None) -> DataFrame:
    """All runN files of a directory, or one file, with run_id; a directory without such files gives all its JSON lines."""
    reader = spark.read.schema(schema) if schema else spark.read
    if not path.endswith(".jsonl"):
        found = reader.option("pathGlobFilter", f"run*{suffix}")
        try:
            return found.json(path).withColumn("run_id", _run_number())
        except AnalysisException:
            reader = (spark.read.schema(schema) if schema else spark.read).option("pathGlobFilter", "*.jsonl")
    return reader.json(path).withColumn("run_id", _run_number())


def read_mapped(spark: SparkSession, path: str, suffix: str, schema: str | None = None) -> DataFrame:
    """The mapped runs of a directory, or one file, which must have the suffix of its stage; with run_id."""
    reader = spark.read.schema(schema) if schema else spark.read
    if path.endswith(".jsonl"):
        if not path.endswith(suffix):
            raise ValueError(f"{path} is not a file of the stage that writes *{suffix}")
        return reader.json(path).withColumn("run_id", _run_number())
    return reader.option("pathGlobFilter", f"*{suffix}").json(path).withColumn("run_id", _run_number())


def read_pages(spark: SparkSession, path: str, registry: list[str]) -> DataFrame:
    """source and html of saved pages of regulations. They are fetched out of band; the source is the registry key in a file's name."""
    return spark.read.text(path, wholetext=True).select(source_of(registry).alias("source"), F.col("value").alias("html"))


def read_routing(spark: SparkSession, path: str) -> DataFrame:
    """slot, regulation, vocab, by, value and sequence of a routing file: slot -> regulation -> list of selectors with values."""
    text = spark.read.text(path, wholetext=True)
    slots = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("slot", "body")).where(~F.col("slot").startswith("_"))
    regs = slots.select("slot", F.explode(F.from_json("body", "map<string,string>")).alias("regulation", "body")).where(~F.col("regulation").startswith("_"))
    each = regs.select("slot", "regulation", F.posexplode(F.from_json("body", "array<struct<vocab:string,by:string,values:array<string>>>")).alias("sequence", "s"))
    return each.select("slot", "regulation", "s.vocab", "s.by", F.explode_outer("s.values").alias("value"), "sequence")


def read_map(spark: SparkSession, path: str, key: str = "key", value: str = "value") -> DataFrame:
    """Rows of a JSON object with string values."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias(key, value))


def read_aliases(spark: SparkSession, path: str, under: str = "aliases", key: str = "alias") -> DataFrame:
    """key, iri and place of a file of synonyms or aliases: an object with, ``under`` a name, an object of lists of identifiers; null lists have no rows."""
    text = spark.read.text(path, wholetext=True)
    each = text.select(F.explode(F.from_json(F.get_json_object("value", f"$['{under}']"), "map<string,array<string>>")).alias(key, "iris"))
    return each.select(key, F.posexplode("iris").alias("place", "iri")).select(key, "iri", "place")


def read_corpora(spark: SparkSession, paths: dict[str, str], schema: str | None = None, tag: str = "source") -> DataFrame:
    """Rows of several corpora or evaluation sets with the name of theirs; a column that some lack is null there, and one called as the tag is replaced."""
    parts = [read_jsonl(spark, path, schema).withColumn(tag, F.lit(name)) for name, path in paths.items()]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def source_of(registry: list[str]) -> Column:
    """The first registry key in the file name, or an error."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    out = F.raise_error(F.concat(F.lit("no known source in "), name)).cast("string")
    for key in reversed(registry):
        out = F.when(F.contains(name, F.lit(key)), F.lit(key)).otherwise(out)
    return out


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.withColumn("ts", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")).write.mode("append").json(path)


def append_review(results: DataFrame, path: str) -> None:
    """Appends the results whose verdict is that too little is known to a review queue."""
    append_log(results.where("verdict.verdict = 'INSUFFICIENT'"), path)


def write_document(df: DataFrame, path: str) -> None:
    """Writes a result, such as metrics or a worksheet, as one JSON document, an array of its rows in their order.

    Each task writes its own rows; the files, one after another by name, are the document. A small result is one file.
    """
    rows = storage.cut(df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row")).withColumn("at", F.monotonically_increasing_id()))
    ends = rows.agg(F.min("at").alias("first"), F.max("at").alias("last")).first()
    if ends["first"] is None:
        lines = df.sparkSession.createDataFrame([("[]",)], "value string")
    else:
        lines = rows.select(F.concat(F.when(F.col("at") == ends["first"], "[").otherwise(","), "row", F.when(F.col("at") == ends["last"], "]").otherwise("")).alias("value"))
    lines.write.mode("overwrite").option("lineSep", " ").text(path)


def write_index(vectors: DataFrame, version: str, path: str) -> None:
    """Stores vectors below their version, by which later runs know whether they are still those of the entries."""
    vectors.write.mode("overwrite").parquet(f"{path}/version={version}")


def read_index(spark: SparkSession, version: str, path: str) -> DataFrame | None:
    """The vectors stored for a version, or None where there are none and they have to be made anew."""
    try:
        return spark.read.parquet(f"{path}/version={version}")
    except AnalysisException:
        return None


_TOKEN = re.compile(r'"""(?P<long>.*?)"""(?:@[\w-]+|\^\^\S+)?|"(?P<text>(?:[^"\\]|\\.)*)"(?:@[\w-]+|\^\^[^\s;,.]+)?|<(?P<iri>[^>]*)>|(?P<mark>[;,.\[\]()])(?=\s|$|[\[\]();,])|#[^\n]*|(?P<name>[^\s;,\[\]()"<]+)', re.S)


def triples(text: str | None) -> Iterator[tuple[str, str, str, str]]:
    """Triples of a Turtle file: names, IRIs and literals, with lists by ';' and ','; nested nodes are passed over."""
    subject = predicate = None
    depth = directive = 0
    for m in _TOKEN.finditer(text or ""):
        kind, value = m.lastgroup, m[m.lastgroup] if m.lastgroup else None
        if kind is None:
            continue
        if kind == "name" and value.endswith(".") and not value.endswith(".."):
            value, ends = value[:-1], True
        else:
            ends = False
        if kind == "mark" and value in "[(":
            depth += 1
        elif kind == "mark" and value in "])":
            depth -= 1
        elif depth:
            continue
        elif kind == "mark":
            if value == ".":
                subject = predicate = None
                directive = 0
            elif value == ";":
                predicate = None
        elif value in ("@prefix", "@base", "PREFIX", "BASE"):
            directive = 1
        elif directive:
            pass
        elif subject is None:
            subject = value
        elif predicate is None:
            predicate = "rdf:type" if value == "a" else value
        else:
            yield subject, predicate, value, "literal" if kind in ("text", "long") else "name"
        if ends:
            subject = predicate = None
            directive = 0


def _read_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column(0).to_pylist():
            rows = list(triples(text))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows, strict=True)], names=["subject", "predicate", "object", "kind"])


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """subject, label, types and parents of the classes and concepts of Turtle files, properties left out."""
    found = spark.read.text(path, wholetext=True).mapInArrow(_read_triples, "subject string, predicate string, object string, kind string")
    p, o = F.col("predicate"), F.col("object")
    terms = found.groupBy("subject").agg(
        F.max(F.when(p == "skos:prefLabel", o)).alias("pref"),
        F.max(F.when(p == "rdfs:label", o)).alias("name"),
        F.array_sort(F.collect_set(F.when(p == "rdf:type", o))).alias("types"),
        F.array_sort(F.collect_set(F.when(p.isin("rdfs:subClassOf", "skos:broader") & (F.col("kind") == "name"), o))).alias("parents"),
        F.max(F.when(p == "skos:inScheme", o)).alias("scheme"),
    )
    kinds, properties = ["rdfs:Class", "owl:Class", "skos:Concept"], ["rdf:Property", "owl:ObjectProperty", "owl:DatatypeProperty", "owl:AnnotationProperty"]
    has = lambda names: F.arrays_overlap("types", F.array(*map(F.lit, names)))
    return terms.where(has(kinds) & ~has(properties)).select("subject", F.coalesce("pref", "name").alias("label"), "scheme", "types", "parents")
