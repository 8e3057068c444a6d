"""Tables in folders by a hash of their key, of which a change rewrites only the folders it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.session import materialize, path_exists

from .merge import upsert

BUCKET = "bucket"


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _write(df: DataFrame, path: str, buckets: int, mode: str) -> None:
    # one file for each bucket: its rows come together in one task
    df.repartition(buckets, BUCKET).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def create_buckets(df: DataFrame, path: str, keys: list[str], buckets: int = 16) -> None:
    """Write df as a new table of so many buckets, which later changes must use too."""
    _write(df.withColumn(BUCKET, bucket_of(keys, buckets)), path, buckets, "overwrite")


def upsert_buckets(changes: DataFrame, path: str, keys: list[str], buckets: int = 16) -> list[int]:
    """Merge changes (keys unique and not null; other nulls change nothing) into the table at path and give the buckets rewritten.

    Only buckets with a changed key are read and replaced, so small changes cost what they touch. The merged rows are
    written aside first, as they come from the files that go. Buckets are replaced when all are written, but not all in
    one step: a job that breaks off there is mended by running the same changes again, which is always allowed and
    then changes nothing.
    """
    spark = changes.sparkSession
    marked = materialize(changes.withColumn(BUCKET, bucket_of(keys, buckets)))
    touched = sorted(r[0] for r in marked.select(BUCKET).distinct().collect())  # `buckets` numbers at most
    if touched and path_exists(spark, path):
        old = read_buckets(spark, path).where(F.col(BUCKET).isin(*touched))
        merged = materialize(upsert(old, marked, [*keys, BUCKET]))
        _write(merged, path, buckets, "overwrite")
    elif touched:
        _write(marked, path, buckets, "overwrite")
    return touched
