"""Sessions with the settings that the operators rely on."""

from __future__ import annotations

import re
import tempfile
import uuid
from html import unescape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import CURLY, PLAIN


def session(app: str = "lexloom", **conf: str) -> SparkSession:
    """UTC, AQE with skew handling; everything else comes from the cluster or from conf."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return SparkSession.builder.appName(app).config(map=base | conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, kind: str = "tables") -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; a temporary one only where that
    is unset and both are one process, as in local tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-lexloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{kind}-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """df written once as Parquet into the shared folder and read again: for frames that several branches use."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def make_path(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.mkdirs(p)


def expect_long_rows(spark: SparkSession) -> None:
    """Parquet first looks at what it holds after 100 rows; of rows of many megabytes each a task would hold gigabytes
    until then. From now on this session looks after each row, and then as often as the rows seen ask for."""
    for what in ("page", "block"):
        spark.conf.set(f"parquet.{what}.size.row.check.min", "1")


def drop_scratch(spark: SparkSession) -> None:
    """Delete the tables that materialize() has written in this application; frames that read them can't be used
    afterwards."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        delete_path(spark, f"{base.rstrip('/')}/tables-{spark.sparkContext.applicationId}")


#: A dimension of more rows than this is joined by a shuffle.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame) -> DataFrame:
    """df marked for broadcast if it is small: its rows and their bytes (as JSON) are measured first, by one job that
    stops behind the bound of rows. Beyond either bound it stays as it is and Spark chooses the join."""
    width = F.coalesce(F.octet_length(F.to_json(F.struct("*"))), F.lit(0))
    rows, size = df.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _clean_sql() -> str:
    """The body of clean_text() in SQL."""
    body = r"regexp_replace(regexp_replace(regexp_replace(t, r'^\s+|\s+$', ''), r'(?is)\*Translated.*?Source:.*', ''), r'\[[^\]]{0,80}\]', '')"
    body = f"replace(translate({body}, {_literal(CURLY)}, {_literal(PLAIN)}), '…', '...')"
    for pattern, to in ((r"[ \t]+", "' '"), (r"\n{3,}", r"'\n\n'"), (r" +\n", r"'\n'"), (r"\n +", r"'\n'")):
        body = f"regexp_replace({body}, r'{pattern}', {to})"
    return rf"regexp_replace({body}, r'^\s+|\s+$', '')"


# Scalar functions for SQL: name, parameters, result, body.
SQL_FUNCTIONS = (
    ("lex_dot", "a ARRAY<FLOAT>, b ARRAY<FLOAT>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), CAST(0 AS DOUBLE), (s, x) -> s + x)"),
    ("lex_norm", "v ARRAY<FLOAT>", "DOUBLE", "sqrt(aggregate(v, CAST(0 AS DOUBLE), (s, x) -> s + CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))"),
    ("lex_l2", "v ARRAY<FLOAT>", "ARRAY<FLOAT>", "CASE WHEN lex_norm(v) > 0 THEN transform(v, x -> CAST(CAST(x AS DOUBLE) / lex_norm(v) AS FLOAT)) END"),
    ("lex_clean_text", "t STRING", "STRING", _clean_sql()),
    ("lex_words", "t STRING", "INT", r"size(filter(split(coalesce(t, ''), '\\s+'), w -> w <> ''))"),
    ("lex_squeeze", "t STRING", "STRING", r"trim(regexp_replace(t, '\\s+', ' '))"),
)


class ChunkText:
    """lex_chunk(text, most, overlap, para_pattern): a row for each chunk of a text, as chunk() gives them."""

    def eval(self, text: str, most: int, overlap: int, para_pattern: str):
        from lexloom.operators.chunking import cut_words

        paragraphs = [re.split(r"\s+", p, flags=re.ASCII) for p in re.split(para_pattern, text or "", flags=re.ASCII)]
        yield from enumerate(cut_words([[w for w in p if w] for p in paragraphs], most, overlap))


class PageLinks:
    """lex_links(html): a row for each anchor of a page with an address: position, href, text (white space squeezed)."""

    def eval(self, html: str):
        at = 0
        for found in re.finditer(r"""<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a\s*>""", html or "", re.I | re.S):
            yield at, unescape(found[1]), re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", "", found[2]))).strip()
            at += 1


#: Table functions for SQL: name, class, columns. They are called by LATERAL joins, row by row, in Arrow batches.
TABLE_FUNCTIONS = (("lex_chunk", ChunkText, "chunk_index int, chunk string"), ("lex_links", PageLinks, "position int, href string, text string"))


def register_sql(spark: SparkSession) -> list[str]:
    """Make the scalar and table functions available to SQL in this session; gives their names."""
    for name, parameters, result, body in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    for name, kind, columns in TABLE_FUNCTIONS:
        spark.udtf.register(name, F.udtf(kind, returnType=columns, useArrow=True))
    return [f[0] for f in (*SQL_FUNCTIONS, *TABLE_FUNCTIONS)]
