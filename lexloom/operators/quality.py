"""Checks of chunks, corpora and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import words


def chunk_size_audit(df: DataFrame, text_col: str, limits: tuple[int, ...] = (256, 384, 512)) -> DataFrame:
    n = F.size(words(F.col(text_col)))
    sized = df.select(n.alias("w"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("c"))
    r = lambda c: F.round(c, 4)
    return sized.agg(
        F.count(F.lit(1)).alias("chunks"), F.min("w").alias("min_words"), F.max("w").alias("max_words"), r(F.avg("w")).alias("avg_words"), F.min("c").alias("min_chars"), F.max("c").alias("max_chars"), r(F.avg("c")).alias("avg_chars"),
        *[F.count_if(F.col("w") > k).alias(f"over_{k}") for k in limits],
    )


def chunk_audit(df: DataFrame, text_col: str, type_col: str, least: int = 10, most: int = 512) -> DataFrame:
    """For each type (missing: unknown): chunks, those over `most` words and those under `least`."""
    sized = df.select(F.coalesce(F.nullif(F.col(type_col), F.lit("")), F.lit("unknown")).alias("type"), F.size(words(F.col(text_col))).alias("w"))
    return sized.groupBy("type").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("w") > most).alias("too_long"), F.count_if(F.col("w") < least).alias("too_short"))


def missing_fields(df: DataFrame, id_col: str, cols: list[str]) -> DataFrame:
    """id and the names of the columns that are null or empty; complete rows don't appear."""
    lacks = F.filter(F.array(*[F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit(c)) for c in cols]), lambda x: x.isNotNull())
    return df.select(id_col, lacks.alias("missing")).where(F.size("missing") > 0)


def corpus_summary(counts: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """A row for each named frame: name, n (its aggregate)."""
    rows = [df.agg(agg.cast("long").alias("n")).select(F.lit(name).alias("name"), "n") for name, (df, agg) in counts.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
