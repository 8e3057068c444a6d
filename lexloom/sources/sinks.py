"""Writers: chunks, metadata, vectors with stable ids, CSV and JSON reports, the daily audit table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import truncated
from lexloom.functions.vectors import uuid5
from lexloom.operators.buckets import upsert_buckets


# Columns of the audit report, of its short form, and of the analysis.
AUDIT_COLUMNS = (
    "query_id", "timestamp", "user_query", "intent", "confidence", "thematic_subtype", "subtype_confidence", "retrieval_method", "top_k",
    "score_threshold", "chunk_count", "prompt_tokens", "completion_tokens", "total_tokens", "estimated_cost_usd", "total_processing_time_ms",
    "retrieval_time_ms", "llm_time_ms", "llm_model", "llm_temperature", "answer_type", "answer_length", "error_occurred", "error_message",
    "environment", "source",
)
FOCUSED_COLUMNS = ("user_query", "intent", "prompt_template", "final_prompt", "final_answer", "error_occurred", "error_message", "timestamp", "query_id")
ANALYSIS_COLUMNS = (
    "query_id", "timestamp", "user_query", "intent", "confidence", "chunk_count", "prompt_length", "total_tokens", "estimated_cost_usd",
    "total_processing_time_ms", "error_occurred", "error_type", "answer_length",
)


def with_columns(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Exactly these columns; those that df lacks are null."""
    return df.select(*[F.col(n) if n in df.columns else F.lit(None).cast("string").alias(n) for n in names])


def without_keys(c: Column, keys: list[str]) -> Column:
    """A map without some of its keys."""
    return F.map_filter(c, lambda k, _: ~k.isin(*keys))


def write_chunks(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_metadata(df: DataFrame, path: str, vector_col: str = "embedding") -> None:
    """All columns but the vector; it is pruned from the scan."""
    df.drop(vector_col).write.mode("overwrite").parquet(path)


def with_point_id(df: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    return df.withColumn("point_id", uuid5(F.col(id_col).cast("string")))


def publish_vectors(df: DataFrame, path: str, id_col: str = "chunk_id", buckets: int = 64) -> list[int]:
    """Put vectors into the table at path under ids that derive from id_col, once each; gives the buckets rewritten.

    A vector that is there already is replaced, others stay, and only buckets with a published id are rewritten (see
    upsert_buckets); writing again gives the same table."""
    return upsert_buckets(with_point_id(df, id_col).dropDuplicates(["point_id"]), path, ["point_id"], buckets)


def yes_no(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), "Yes").otherwise("No")


def audit_export(df: DataFrame) -> DataFrame:
    """The report's form of audit columns: booleans as Yes or No, lists joined by a comma, length of the answer."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        c = F.col(f.name)
        out.append(yes_no(c).alias(f.name) if kind == "boolean" else F.array_join(c.cast("array<string>"), ", ").alias(f.name) if kind == "array" else c)
    frame = df.select(*out)
    return frame.withColumn("answer_length", F.coalesce(F.length("final_answer"), F.lit(0))) if "final_answer" in df.columns else frame


def focused_export(df: DataFrame, cols: list[str], text_cols: list[str], flag_cols: list[str] = (), longest: int = 500) -> DataFrame:
    return df.select(*[truncated(F.col(c), longest).alias(c) if c in text_cols else yes_no(F.col(c)).alias(c) if c in flag_cols else F.col(c) for c in cols])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def audit_rows(df: DataFrame) -> DataFrame:
    """The columns of the audit report from audit records; answer_length is that of final_answer where there is one."""
    known = "answer_length" in df.columns
    whole = audit_export(df.withColumnRenamed("answer_length", "_stated") if known else df)
    if known and "final_answer" in df.columns:
        whole = whole.withColumn("answer_length", F.when(F.length("final_answer") > 0, F.col("answer_length")).otherwise(F.col("_stated")))
    elif known:
        whole = whole.withColumnRenamed("_stated", "answer_length")
    return with_columns(whole, AUDIT_COLUMNS)


def focused_rows(df: DataFrame, longest: int = 500) -> DataFrame:
    """The columns of the short report: long texts cut, the error as Yes or No."""
    return focused_export(with_columns(df, FOCUSED_COLUMNS), list(FOCUSED_COLUMNS), ["final_prompt", "final_answer"], ["error_occurred"], longest)


def analysis_rows(df: DataFrame) -> DataFrame:
    """The columns of the analysis; a missing error flag counts as no error."""
    return with_columns(df, ANALYSIS_COLUMNS).withColumn("error_occurred", F.coalesce(F.col("error_occurred").cast("boolean"), F.lit(False)))


def export_audit_csv(df: DataFrame, path: str) -> None:
    write_csv(audit_rows(df), path)


def export_focused_csv(df: DataFrame, path: str) -> None:
    write_csv(focused_rows(df), path)


def export_analysis_csv(df: DataFrame, path: str) -> None:
    write_csv(analysis_rows(df), path)


def write_report(df: DataFrame, path: str) -> None:
    """Rows as JSON documents, one a line."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def append_audit(df: DataFrame, path: str, ts_col: str = "ts") -> None:
    """Append rows under their day: dt=yyyy-MM-dd."""
    df.withColumn("dt", F.to_date(ts_col)).write.mode("append").partitionBy("dt").json(path)
