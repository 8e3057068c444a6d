"""Exact deduplication by skew-safe combining, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, materialize, table

#: Repeated digests up to this number are broadcast; beyond it only the hot ones are, and the others meet their rows by
#: a shuffle.
BROADCAST_DIGESTS = 400_000
#: A digest is hot from this share of all rows on, so that there are at most so many hot ones.
HOT_DIGESTS = 100_000


def _normalised(docs: DataFrame, id_col: str, text_col: str, carried: Column) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        carried.alias("doc"),
        F.col(id_col).alias("id"),
        F.length(text).cast("long").alias("n_cp"),
        F.regexp_replace(text, WS + "+", "").alias("norm"),
    ).select("doc", "id", "n_cp", "norm", F.coalesce(F.sha2(F.col("norm"), 256), F.lit("")).alias("digest"))


def _salted(rows: DataFrame, repeated: DataFrame, hot: DataFrame, rare: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Of rows (digest) those with a repeated digest, with its salts, and the others.

    Hot digests are broadcast, so their rows are not moved to be told apart. Of the rest no digest has more rows than
    one in HOT_DIGESTS of all; where they are too many to be broadcast, they meet their rows by digest, and the rows
    of hot digests, which need no partner there, are dealt out by a number of their own.
    """
    if rare is None:
        return rows.join(F.broadcast(repeated), "digest"), rows.join(F.broadcast(repeated), "digest", "left_anti")
    told = rows.join(F.broadcast(hot.select("digest", F.col("salts").alias("_hot"))), "digest", "left")
    told = told.withColumn("_key", F.when(F.col("_hot").isNull(), F.col("digest")).otherwise(F.concat(F.lit("hot "), F.monotonically_increasing_id().cast("string"))))
    met = told.join(rare.select(F.col("digest").alias("_key"), F.col("salts").alias("_rare")), "_key", "left")
    met = met.withColumn("salts", F.coalesce("_hot", "_rare")).drop("_key", "_hot", "_rare")
    cold = rows.join(F.broadcast(hot), "digest", "left_anti").join(rare, "digest", "left_anti")
    return met.where("salts is not null"), cold


def _judged(docs: DataFrame, id_col: str, text_col: str, rows_per_salt: int, carried: Column, slim: bool = False) -> DataFrame:
    """doc (what is carried of the row), keep_id, group_size, kept, equal, digest for each row of docs.

    equal marks the row that is kept and those with its id and length. Rows that share a digest are
    written once with a number of their own, so a verdict belongs to its row and not to all rows with its id.
    A digest is never null (the coalesce says so to the optimizer, which would else test and compute it twice).
    If little is carried of a row (slim), digests are written once and texts are read again only for comparing.
    """
    base = _normalised(docs, id_col, text_col, carried)
    digests = materialize(base.select("doc", "id", "digest")) if slim else base
    salts = (F.lit(1) + F.floor(F.col("n") / rows_per_salt)).cast("int").alias("salts")
    counted = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    repeated = materialize(counted.where("n > 1").select("digest", "n", salts))
    n = repeated.agg(F.count(F.lit(1)), F.sum("n")).first()
    hot_from = max(rows_per_salt, -(-(n[1] or 0) // HOT_DIGESTS))
    hot, rare = (repeated.where(F.col("n") >= hot_from), repeated.where(F.col("n") < hot_from)) if n[0] > BROADCAST_DIGESTS else (repeated, None)
    repeated, hot, rare = (None if x is None else x.drop("n") for x in (repeated, hot, rare))

    members = materialize(_salted(base, repeated, hot, rare)[0].withColumn("row", F.monotonically_increasing_id()))
    members = members.withColumn("salt", F.pmod(F.hash("row"), F.col("salts")))
    rank = F.struct((-F.col("n_cp")).alias("neg_cp"), F.col("id").isNull().alias("no_id"), "id", "row")
    winners = (
        members.groupBy("digest", "norm", "salt")
        .agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("n"), F.max("salts").alias("salts"))
        .groupBy("digest", "norm")
        .agg(F.min("best").alias("best"), F.sum("n").alias("group_size"), F.max("salts").alias("salts"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        .drop("salts")
    )
    found = members.join(winners, ["digest", "salt", "norm"]).select(
        "doc",
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("n_cp") == -F.col("best.neg_cp"))).alias("equal"),
        "digest",
    )
    single = _salted(digests, repeated, hot, rare)[1].select(
        "doc", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lit(True).alias("equal"), "digest"
    )
    return single.unionByName(found)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_salt: int = 1000) -> DataFrame:
    """One row for each row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space; null counts as empty. Of equal texts the row
    with the most code points stays, then the one with the smallest id (a null id comes last). Of
    rows that repeat the winner's id and length one is marked as kept. An empty table gives no rows;
    further columns of docs are ignored, whatever their names.

    Digests that occur once need no comparison. For the others, each task first combines its own
    equal contents (Spark's partial aggregation), then (digest, content, salt) groups are merged, and
    at last the salt winners of each (digest, content). A digest has one salt for every rows_per_salt of
    its rows; rows of hot digests get theirs without a shuffle by digest. The members meet their winner by digest, salt and whole content, so a hot group of copies
    is spread over its salts in every shuffle, and small groups are not written more than once.
    """
    judged = _judged(docs, id_col, text_col, rows_per_salt, F.struct(F.col(id_col).alias("id")), slim=True)
    return judged.select(F.col("doc.id").alias(id_col), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_salt: int = 1000, repeats: bool = True) -> DataFrame:
    """docs without copies; same columns. Ids may be null, repeated or of any type; null texts are copies of
    empty ones, texts of any length are compared whole, and an empty table stays empty.

    Without `repeats` exactly the rows that exact_dedup keeps stay, one of each group. With it, rows that
    repeat the id and length of the kept row stay as well.
    """
    judged = _judged(docs, id_col, text_col, rows_per_salt, F.struct("*"))
    return judged.where("equal" if repeats else "kept").select("doc.*")


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
with t as (
  select doc_id, length(coalesce(text, '')) as n_cp,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as norm
  from documents)
select doc_id,
       first_value(doc_id) over w as keep_id,
       count(*) over (partition by norm) as group_size,
       row_number() over w = 1 as kept,
       sha256(norm) as text_sha256
from t
window w as (partition by norm order by n_cp desc, doc_id asc nulls last)
"""
