"""What the training-data operators share: table access, shared scratch tables, text constants."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define it: space and U+0009 to U+000D. (Java and RE2 syntax.)
WS = r"[\x20\x09-\x0D]"
NOT_WS = r"[^\x20\x09-\x0D]"

#: Paths of scratch tables to be deleted at the end of the innermost scratch_freed block.
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only where that setting is missing and driver and executors are one process (local tests) a temporary
    folder takes its place; on a cluster its absence is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-lexloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lexloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def unused(docs: DataFrame, name: str) -> str:
    """name, lengthened until no column of docs bears it (Spark ignores case)."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


@contextmanager
def _shuffles_freed(spark: SparkSession):
    """Shuffle files of the writes inside are removed when each write has ended."""
    before = spark.conf.get(_CLEANUP, None)
    try:
        spark.conf.set(_CLEANUP, "true")
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again.

    This cuts the lineage like checkpoint(), survives the loss of any executor, and keeps the
    columns compressed. The folder carries the application's id, so it can be dropped afterwards.
    """
    spark = df.sparkSession
    path = scratch_dir(spark)
    if (passing := _passing.get()) is not None:
        passing.append(path)
    schema = df.schema
    with _shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


@contextmanager
def scratch_freed(spark: SparkSession):
    """Scratch tables written inside are deleted at the end. Gives a function that materializes a result to
    stay; frames made inside must go through it to be read afterwards, as their scratch tables are gone."""
    outer, paths = _passing.get(), []

    def stored(df: DataFrame) -> DataFrame:
        inner = _passing.set(outer)
        try:
            return materialize(df)
        finally:
            _passing.reset(inner)

    token = _passing.set(paths)
    try:
        yield stored
    finally:
        _passing.reset(token)
        for p in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs, written once with a number of its own for each row in the column name."""
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()))
