"""Readers of files that hold records, logs, texts, dimensions and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions.text import file_key, trim_all
from lexloom.functions.vectors import vector_fault

# Fields of the award files; {award}_lecture_file has the award's name in it.
_LAUREATE = ("full_name", "gender", "country", "date_of_birth", "date_of_death", "place_of_birth", "prize_motivation", "life_blurb", "work_blurb", "language")
AWARDS = T.StructType(
    [
        T.StructField("year_awarded", T.IntegerType()),
        T.StructField("category", T.StringType()),
        T.StructField(
            "laureates",
            T.ArrayType(
                T.StructType(
                    [T.StructField(n, T.StringType()) for n in _LAUREATE]
                    + [T.StructField(n, T.BooleanType()) for n in ("declined", "specific_work_cited", "lecture_delivered")]
                    + [T.StructField(n, T.StringType()) for n in ("cited_work", "lecture_file", "lecture_title", "lecture_absence_reason", "ceremony_file", "acceptance_file", "last_updated")]
                )
            ),
        ),
    ]
)

# Weights of the words and phrases of each intent.
INTENT_WEIGHTS = {
    "factual": {
        "keyword": {"what": 0.3, "when": 0.4, "who": 0.4, "where": 0.3, "how many": 0.5, "quote": 0.9, "summarize": 0.7, "give me the speech": 0.8},
        "phrase": {"who won": 0.8, "when did": 0.6, "what year": 0.7},
    },
    "thematic": {
        "keyword": {
            "theme": 0.6, "themes": 0.6, "pattern": 0.7, "patterns": 0.7, "compare": 0.7, "comparison": 0.7, "similarities": 0.8,
            "differences": 0.8, "evolution": 0.9, "trend": 0.6, "common": 0.5, "typical": 0.6, "recurring": 0.8, "across": 0.5, "motif": 0.8,
            "motifs": 0.8, "topics": 0.6, "changed": 0.5, "time": 0.3, "justice": 0.6, "laureates": 0.4,
        },
        "phrase": {"what are": 0.5, "what do": 0.5, "how does": 0.6, "how do": 0.6, "how have": 0.6, "describe the": 0.7, "say about": 0.6, "talk about": 0.6},
    },
    "generative": {
        "keyword": {"write": 0.8, "compose": 0.9, "mimic": 0.8, "generate": 0.7, "paraphrase": 0.6, "rewrite": 0.6, "draft": 0.8, "emulate": 0.8},
        "phrase": {"in the style of": 0.95, "like a laureate": 0.9, "as if you were": 0.8, "write me": 0.8},
    },
}

# A template for each kind of answer, with its chunk count and citation style.
TEMPLATES = (
    ("qa_factual", "qa", 5, "inline"), ("qa_analytical", "qa", 8, "footnote"), ("qa_comparative", "qa", 10, "inline"),
    ("generative_email", "generative", 10, "inline"), ("generative_speech", "generative", 12, "inline"), ("generative_reflection", "generative", 8, "inline"),
    ("thematic_exploration", "thematic", 12, "inline"), ("thematic_cross_cultural", "thematic", 15, "footnote"),
    ("thematic_synthesis_clean", "thematic", 12, "inline"), ("thematic_enumerative", "thematic", 10, "inline"),
    ("thematic_comparative", "thematic", 12, "inline"), ("thematic_contextual", "thematic", 10, "inline"), ("thematic_temporal", "thematic", 12, "inline"),
    ("scoped_laureate", "scoped", 6, "inline"), ("scoped_work", "scoped", 8, "footnote"),
)
DEFAULT_TEMPLATE = "Question: {query}\n\nContext:\n{context}\n\nAnswer from the context and cite it."


def read_awards(spark: SparkSession, path: str, prefix: str = "award") -> DataFrame:
    """Nested records, one JSON array or object in a file. The files call lecture_file and lecture_title
    {prefix}_lecture_file and {prefix}_lecture_title; files in which no record has the first are an error."""
    renamed = {n: f"{prefix}_{n}" for n in ("lecture_file", "lecture_title")}
    year, category, people = AWARDS.fields
    stored = T.StructType([T.StructField(renamed.get(f.name, f.name), f.dataType) for f in people.dataType.elementType])
    found = spark.read.json(path, multiLine=True).schema
    inside = found["laureates"].dataType.elementType.names if "laureates" in found.names else []
    if renamed["lecture_file"] not in inside:
        raise ValueError(f"no record has the field {renamed['lecture_file']}: is {prefix!r} the right prefix?")
    rows = spark.read.schema(T.StructType([year, category, T.StructField(people.name, T.ArrayType(stored))])).json(path, multiLine=True)
    return rows.withColumn(people.name, F.col(people.name).cast(people.dataType))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON record a line; lines that don't parse are dropped."""
    bad = "_corrupt"
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField(bad, T.StringType())])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).json(path)
    return rows.where(F.col(bad).isNull()).drop(bad)


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON or JSONL by the file's suffix."""
    if path.endswith(".jsonl"):
        return read_jsonl(spark, path, schema)
    if path.endswith(".json"):
        return spark.read.schema(schema).json(path, multiLine=True)
    raise ValueError(f"neither .json nor .jsonl: {path}")


def read_text_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """year, last_name, text of files `{year}_{lastname}.txt` and `{year}.txt` (last_name null); empty ones and other names
    give no rows."""
    files = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True).select(trim_all(F.col("value")).alias("text"), F.col("_metadata.file_name").alias("file"))
    year, name = file_key(F.col("file"))
    return files.select(year.alias("year"), name.alias("last_name"), "text").where("year is not null and text <> ''")


def parse_query_log(lines: DataFrame, start: str | None = None) -> DataFrame:
    """ts, source, query of tab-separated lines (value); lines with fewer fields or a bad time are dropped."""
    f = F.split("value", "\t")
    rows = lines.where(F.size(f) >= 3).select(F.coalesce(F.try_to_timestamp(F.get(f, 0)), F.try_to_timestamp(F.get(f, 0), F.lit("yyyy-MM-dd HH:mm:ss"))).alias("ts"), F.get(f, 1).alias("source"), F.get(f, 2).alias("query"))
    rows = rows.where("ts is not null")
    return rows.where(F.col("ts") >= F.lit(start).cast("timestamp")) if start else rows


def read_query_log(spark: SparkSession, path: str, start: str | None = None) -> DataFrame:
    return parse_query_log(spark.read.text(path), start)


def read_service_log(spark: SparkSession, path: str) -> DataFrame:
    """value and ts of the lines that begin with a timestamp."""
    lines = spark.read.text(path).where(F.col("value").startswith("20"))
    return lines.withColumn("ts", F.try_to_timestamp(F.substring("value", 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))).where("ts is not null")


def read_dimension(spark: SparkSession, kind: str, path: str | None = None) -> DataFrame:
    """A small table: themes (theme, keyword), intents (intent, kind, term, weight) or templates (name,
    intent, chunk_count, citation_style, template).

    themes come from a JSON object of lists; a theme named twice counts with its last list, as JSON
    parsers do. intents and templates have built-in rows where no path is given.
    """
    if kind == "themes":
        if path is None:
            raise ValueError("themes need a path")
        text = spark.read.text(path, wholetext=True)
        themes = text.select(F.explode(F.from_json("value", "map<string, array<string>>", {"mode": "FAILFAST"})).alias("theme", "ks"))
        return themes.select("theme", F.explode("ks").alias("keyword")).select("theme", F.lower(F.trim("keyword")).alias("keyword")).distinct()
    if kind == "intents":
        if path is None:
            rows = [(i, k, t, w) for i, kinds in INTENT_WEIGHTS.items() for k, ts in kinds.items() for t, w in ts.items()]
            return spark.createDataFrame(rows, "intent string, kind string, term string, weight double")
        shape = "struct<intents: map<string, struct<keywords: map<string, double>, phrases: map<string, double>>>>"
        parsed = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", shape)["intents"]).alias("intent", "w"))
        long = [parsed.select("intent", F.lit(k).alias("kind"), F.explode(f"w.{k}s").alias("term", "weight")) for k in ("keyword", "phrase")]
        return long[0].unionByName(long[1])
    if kind == "templates":
        if path is None:
            rows = [(*t, DEFAULT_TEMPLATE) for t in TEMPLATES]
            return spark.createDataFrame(rows, "name string, intent string, chunk_count int, citation_style string, template string")
        shape = "map<string, struct<template: string, intent: string, chunk_count: int, citation_style: string>>"
        parsed = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", shape)).alias("name", "t"))
        return parsed.select("name", "t.intent", "t.chunk_count", "t.citation_style", "t.template")
    raise ValueError(f"no dimension of this kind: {kind}")


def read_embeddings(spark: SparkSession, path: str, dim: int, col: str = "embedding") -> DataFrame:
    """Rows with a usable vector of this dimension; the others are in embedding_faults()."""
    return spark.read.parquet(path).where(vector_fault(col, dim).isNull())


def embedding_faults(spark: SparkSession, path: str, dim: int, col: str = "embedding") -> DataFrame:
    return spark.read.parquet(path).withColumn("fault", vector_fault(col, dim)).where("fault is not null")


def jsonl_counts(lines: DataFrame, required: list[str], col: str = "value") -> DataFrame:
    """One row over lines of JSON: total, blank, malformed, missing a required key, valid."""
    v = F.col(col)
    blank = F.coalesce(F.trim(v), F.lit("")) == ""
    keys = F.json_object_keys(v)
    # parsers stop behind the first value of a line; in brackets what follows it counts too
    broken = ~blank & (F.coalesce(F.json_array_length(F.concat(F.lit("["), v, F.lit("]"))), F.lit(0)) != 1)
    lacks = ~blank & ~broken & ~F.coalesce(F.forall(F.array(*map(F.lit, required)), lambda k: F.array_contains(keys, k)), F.lit(False))
    return lines.agg(F.count(F.lit(1)).alias("total"), F.count_if(blank).alias("blank"), F.count_if(broken).alias("malformed"), F.count_if(lacks).alias("missing_field"), F.count_if(~blank & ~broken & ~lacks).alias("valid"))


def validate_jsonl(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    return jsonl_counts(spark.read.text(path), required)


def parse_variants(lines: DataFrame, fields: dict[str, str], col: str = "value") -> DataFrame:
    """Log lines of unlike and changing shapes by one plan: lines (col and others) as VARIANT, read field by field.

    fields: name -> type. Adds a column for each field (null where it is missing, null or of another type) and
    malformed (no JSON), missing (names that are not there) and drifted (names that are there, not null, and
    can't be read as their type). Blank and null lines are malformed.
    """
    v = F.col("_v")
    read = lines.withColumn("_v", F.try_parse_json(F.when(F.trim(col) != "", F.col(col))))
    there = {n: F.try_variant_get(v, f"$.{n}", "variant") for n in fields}
    cast = {n: F.try_variant_get(v, f"$.{n}", t) for n, t in fields.items()}
    names = lambda tests: F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in tests.items()]), lambda x: x.isNotNull())
    missing = names({n: v.isNotNull() & c.isNull() for n, c in there.items()})
    drifted = names({n: c.isNotNull() & ~F.is_variant_null(c) & cast[n].isNull() for n, c in there.items()})
    rest = [c for c in lines.columns if c != col]
    return read.select(*rest, *[c.alias(n) for n, c in cast.items()], v.isNull().alias("malformed"), missing.alias("missing"), drifted.alias("drifted"))


def shape_counts(parsed: DataFrame, *by: str) -> DataFrame:
    """Lines, malformed ones, and how often each field is missing or drifted: one row for each kind of trouble
    (what, field, n), and one of all lines (what = lines)."""
    each = lambda kind: F.transform(kind, lambda n: F.struct(F.lit(kind).alias("what"), n.alias("field")))
    trouble = F.concat(
        F.array(F.struct(F.lit("lines").alias("what"), F.lit(None).cast("string").alias("field"))),
        F.when(F.col("malformed"), F.array(F.struct(F.lit("malformed").alias("what"), F.lit(None).cast("string").alias("field")))).otherwise(F.array().cast("array<struct<what:string,field:string>>")),
        each("missing"),
        each("drifted"),
    )
    return parsed.select(*by, F.explode(trouble).alias("t")).groupBy(*by, "t.what", "t.field").agg(F.count(F.lit(1)).alias("n"))
