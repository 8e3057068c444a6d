"""Vector functions as column expressions, and text to vector jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once for a row, however often and wherever use refers to it."""
    return F.get(F.transform(F.array(value), use), 0)


def l2_normalize(v: Column | str) -> Column:
    """The vector over its norm; null for a zero vector."""
    v = F.col(v) if isinstance(v, str) else v
    scaled = lambda x, size: F.when(size > 0, F.transform(x, lambda e: (e.cast("double") / size).cast("float")))
    return let(v, lambda x: let(norm(x), lambda size: scaled(x, size)))


def vector_fault(v: Column | str, dim: int) -> Column:
    """Why a vector is unusable: null, dim, nan, inf, zero; null if it is fine."""
    v = F.col(v) if isinstance(v, str) else v
    return (
        F.when(v.isNull(), "null")
        .when(F.size(v) != dim, "dim")
        .when(F.exists(v, lambda x: x.isNull() | F.isnan(x)), "nan")
        .when(F.exists(v, lambda x: F.abs(x) == float("inf")), "inf")
        .when(F.forall(v, lambda x: F.abs(x) <= 1e-8), "zero")
    )


def uuid5(name: Column, namespace_hex: str = NAMESPACE_URL) -> Column:
    """UUID version 5 of a name, by its definition: SHA-1 of namespace and name, version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    digit = F.conv(F.substring(h, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex((digit.bitwiseAND(3) + 8).cast("long")))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


#: Embedders by model id: (dimension, factory). The factory is called once in a task and gives a function
#: from a list of texts to a float32 matrix.
EMBEDDERS: dict[str, tuple[int, Callable[[], Callable[[list[str]], np.ndarray]]]] = {}


def register_embedder(model: str, dim: int, factory: Callable[[], Callable[[list[str]], np.ndarray]]) -> None:
    EMBEDDERS[model] = (dim, factory)


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """Counts of tokens hashed into dim slots, normalised: deterministic and native."""
    slots = F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: w != ""), lambda w: F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("int") % dim)
    count = lambda own: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(own, lambda s: s == i)).cast("float"))
    return l2_normalize(let(slots, count))


def embedding_counts(embedded: DataFrame, *by: str, col: str = "embedding") -> DataFrame:
    """Rows and failures (rows without a vector) of embed_table()."""
    return embedded.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(col).isNull()).alias("failed"))


def embed_table(df: DataFrame, text_col: str, model: str | None = None, batch: int = 50, dim: int = 64) -> DataFrame:
    """df with an embedding column; rows whose text gives no usable vector keep a null there.

    Without a model the native hashed embedding is used. With one, each task loads it once and embeds
    Arrow batches of at most `batch` texts; a batch that fails is tried row by row.
    """
    if model is None:
        return df.withColumn("embedding", hashed_embedding(F.col(text_col), dim))
    width, factory = EMBEDDERS[model]
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]):
        embed = factory()

        def one(texts: list[str]) -> list:
            try:
                return [v if np.isfinite(v).all() and len(v) == width else None for v in np.asarray(embed(texts), np.float32)]
            except Exception:
                return [None] if len(texts) == 1 else [one([t])[0] for t in texts]

        for rows in batches:
            for k in range(0, rows.num_rows, batch):
                part = rows.slice(k, batch)
                texts = part.column(at).to_pylist()
                good = [i for i, t in enumerate(texts) if t]
                out: list = [None] * len(texts)
                for i, v in zip(good, one([texts[i] for i in good]) if good else [], strict=True):
                    out[i] = v
                vectors = pa.array([None if v is None else v.tolist() for v in out], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*part.columns, vectors], [*part.schema.names, "embedding"])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("embedding", ArrayType(FloatType()))]))
