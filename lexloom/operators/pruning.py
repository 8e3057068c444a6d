"""Exact top k that leaves out blocks of the corpus: rows around pivots, an upper bound of each block's scores."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.vectors import vector_fault
from lexloom.session import materialize

from .retrieval import DIGITS, _ids, _matrix, ranked, top_k

#: Pivots at most, and vectors of a batch that are compared with them at a time.
PIVOTS, ROWS_AT_ONCE = 4096, 4096
#: Scores are rounded, and sums in another order differ in the last digits: a bound so little below a score doesn't exclude.
MARGIN = 2 * 10.0**-DIGITS


@dataclass
class BlockIndex:
    """blocks: the corpus with `pivot`, the block of each row; pivots: pivot, center, radius, n."""

    blocks: DataFrame
    pivots: DataFrame
    dim: int


def index_corpus(corpus: DataFrame, dim: int = 64, pivots: int | None = None) -> BlockIndex:
    """Deal the rows of corpus (chunk_id, vec and others) to blocks, each row to its nearest pivot.

    Pivots are the rows with the least digests of their ids, about the square root of all rows and PIVOTS at
    most; their vectors are all that the driver sees. A block's radius is the largest distance of its rows from the
    pivot. Unusable vectors are left out. The blocks are written once; the corpus is not shuffled.
    """
    rows = corpus.where(vector_fault("vec", dim).isNull())
    pivots = pivots or max(1, min(PIVOTS, round(rows.count() ** 0.5)))
    chosen = rows.select("vec", F.xxhash64("chunk_id").alias("u")).orderBy("u", "vec").limit(pivots).toArrow()
    centers = _matrix(chosen.column("vec").combine_chunks(), dim)
    spark, others = corpus.sparkSession, [c for c in corpus.columns if c != "vec"]
    shared = spark.sparkContext.broadcast(centers)

    def near(batches):
        own = shared.value
        half = (own * own).sum(1) / 2
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                m = _matrix(part.column(part.num_columns - 1), dim)
                pivot = (m @ own.T - half).argmax(1)
                away = np.sqrt(((m - own[pivot]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pivot.astype(str)), pa.array(away)], [*part.schema.names, "pivot", "away"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*others, "vec").schema.fields)
    dealt = materialize(rows.select(*others, "vec").mapInArrow(near, f"{kinds}, pivot string, away double"))
    sizes = dealt.groupBy("pivot").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n"))
    held = spark.createDataFrame([(str(i), c.tolist()) for i, c in enumerate(centers)], "pivot string, center array<double>")
    return BlockIndex(dealt.drop("away"), materialize(held.join(sizes, "pivot")), dim)


def _visits(queries: DataFrame, index: BlockIndex, probe: int, again: bool) -> DataFrame:
    """queries (query_id, vec, k) with `pivot`, the blocks to visit: at first the `probe` ones with the highest bounds;
    again, with `least` (the k-th score so far), all others whose bound reaches it. A row x of a block with center c and
    radius r has q x = q c + q (x - c), which is at most q c + |q| r."""
    dim = index.dim
    held = index.pivots.orderBy("pivot").toArrow()  # PIVOTS rows at most
    shared = index.blocks.sparkSession.sparkContext.broadcast((_matrix(held.column("center").combine_chunks(), dim), _ids(held.column("radius")), held.column("pivot").to_pylist()))

    def run(batches):
        centers, radius, names = shared.value
        names = np.array(names, object)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                m = _matrix(part.column(1), dim)
                bound = m @ centers.T + np.sqrt((m * m).sum(1))[:, None] * radius
                order = np.argsort(-bound, axis=1, kind="stable")
                if not again:
                    lists = [names[o].tolist() for o in order[:, :probe]]
                else:
                    least = _ids(part.column(3))
                    lists = [names[o[probe:]][b[o[probe:]] + MARGIN >= t].tolist() for o, b, t in zip(order, bound, least, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(lists, pa.list_(pa.string()))], ["query_id", "vec", "k", "pivot"])

    columns = ["query_id", "vec", "k", *(["least"] if again else [])]
    return queries.select(*columns).mapInArrow(run, "query_id bigint, vec array<float>, k int, pivot array<string>").where(F.size("pivot") > 0)


def top_k_pruned(queries: DataFrame, index: BlockIndex, k: int, probe: int = 8) -> tuple[DataFrame, DataFrame]:
    """The rows of top_k(queries, corpus, k), and a report of one row: pairs, scored, skipped (a share).

    Each query first visits the `probe` blocks with the highest bounds, which gives it a k-th score to beat; then only
    the blocks whose bound reaches that. Queries go to the blocks they visit, so the corpus is never copied for them as
    a whole, and no row of a block that is left out could be among the best: the result is exact. How much is skipped
    depends on the data: rows in clusters leave out most blocks, evenly spread ones of many dimensions few.
    """
    good = vector_fault("vec", index.dim).isNull()
    asked = queries.where(good).select("query_id", F.col("vec").cast("array<float>").alias("vec"), F.lit(k).cast("int").alias("k"))
    first = materialize(_visits(asked, index, probe, False))
    found = materialize(top_k(first, index.blocks, None, None, index.dim, "pivot").select("query_id", "chunk_id", "score"))
    kth = found.groupBy(F.col("query_id").alias("_q")).agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_s"))
    least = F.when(F.col("_n") >= k, F.col("_s")).otherwise(F.lit(float("-inf")))
    second = asked.join(kth, F.col("query_id") == F.col("_q"), "left").withColumn("least", F.coalesce(least, F.lit(float("-inf"))))
    second = materialize(_visits(second, index, probe, True))
    more = top_k(second, index.blocks, None, None, index.dim, "pivot").select("query_id", "chunk_id", "score")
    best = ranked(found.unionByName(more), ["query_id"], "chunk_id").where(F.col("rank") < k)
    visited = first.unionByName(second).select(F.explode("pivot").alias("pivot")).groupBy("pivot").agg(F.count(F.lit(1)).alias("visits"))
    scored = visited.join(index.pivots.select("pivot", "n"), "pivot").agg(F.coalesce(F.sum(F.col("visits") * F.col("n")), F.lit(0)).alias("scored")).withColumn("_k", F.lit(1))
    pairs = asked.agg(F.count(F.lit(1)).alias("_asked")).withColumn("_k", F.lit(1)).join(index.pivots.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_rows")).withColumn("_k", F.lit(1)), "_k")
    report = pairs.withColumn("pairs", F.col("_asked") * F.col("_rows")).join(scored, "_k").select("pairs", "scored", F.round(1 - F.col("scored") / F.nullif(F.col("pairs"), F.lit(0)), 4).alias("skipped"))
    return best, report
