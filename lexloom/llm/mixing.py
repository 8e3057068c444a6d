"""Mixing sources to target weights by capped water-filling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_WS, materialize, numbered, table, unused


#: Up to this many rows one task adds up an order; more are ranged over the tasks.
ROWS_OF_TASK = 100_000


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], rows: int | None = None) -> DataFrame:
    """df with the sums (name: column) over all rows before each row in the order; rows is their number, if known.

    Spark ranges the rows over the tasks; each task adds up its own, and the totals of the tasks before, one row a
    task, are added. So no task sees all rows. Up to ROWS_OF_TASK rows, where their number is given, are one task's
    work, with the same sums.
    """
    if rows is not None and rows <= ROWS_OF_TASK:
        ahead = Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.select(*df.columns, *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(n) for n, c in sums.items()])
    part = unused(df, "_part")
    dealt = materialize(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(part).agg(*[F.sum(c).alias(f"{part}{n}") for n, c in sums.items()])
    ahead = before.orderBy(part)
    totals = totals.select(part, *[F.coalesce(F.sum(f"{part}{n}").over(ahead), F.lit(0)).alias(f"{part}{n}") for n in sums])
    within = before.partitionBy(part).orderBy(*order)
    met = dealt.join(F.broadcast(totals), part)
    return met.select(*df.columns, *[(F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"{part}{n}")).alias(n) for n, c in sums.items()])


def water_fill(sources: DataFrame, share_num: int = 3, share_den: int = 2, max_epochs: int = 2) -> DataFrame:
    """Targets of sources (source, source_size, weight): adds target.

    The mix holds share_num/share_den of all sizes. A source is clamped at max_epochs times its size;
    what it leaves is shared by weight among the others until none is above its cap. Sources clamp in
    the order of cap/weight, so the level after j clamped sources is what is left over the weight that
    is left, and the level that is feasible is the largest of these. All sums are whole numbers; one
    division gives the level. A table with one row for each source; empty in, empty out.
    """
    n = sources.agg(F.sum("source_size"), F.sum("weight"), F.count(F.lit(1))).first()
    if n[1] is None:
        return sources.withColumn("target", F.lit(0.0))
    capped = sources.withColumn("cap", F.lit(max_epochs) * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("weight"))
    placed = running(capped, [F.col("full_at"), F.col("source").asc_nulls_last()], {"cap_before": F.col("cap"), "weight_before": F.col("weight")}, n[2])
    whole = F.lit(share_num * n[0]).cast("long")  # a sum below 2**31 comes back as an int, whose product would overflow
    level = (whole - F.lit(share_den) * F.col("cap_before")).cast("double") / (F.lit(share_den) * (F.lit(n[1]) - F.col("weight_before"))).cast("double")
    feasible = placed.agg(F.max(level)).first()[0]
    return placed.select("source", "source_size", "weight", F.least(F.col("cap").cast("double"), F.lit(feasible) * F.col("weight")).alias("target"))


def plan_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    seed: str = "mix-1",
    rows_per_cell: int = 1_000_000,
) -> DataFrame:
    """How often each row of docs goes into the mix: id, size, source_size, target, repeats, taken.

    Size is the number of words (null text: 0). Sources by code point, null last, take the weights in
    turn. Each row is repeated floor(target / source_size) times; the rest of the target goes to rows in
    the order of a seeded digest of the id: a row is taken once more while the middle of its words lies
    within that rest. So a source misses its target by half a document at most, reruns agree, and no
    row is taken more than the cap allows. Rows without words are repeated zero times. Repeated rows
    are rows of their own. Ids may be of any type. An empty table gives no rows.

    No task sorts a source as a whole: rows are dealt out by ranges of source, digest, id and size, of about
    rows_per_cell rows at most (65536 ranges at most), so a hot source, and rows without an id, lie in many ranges.
    The sums of ranges are added up first, and how many there are doesn't change the order. Only (id, source, size,
    digest) is shuffled. Not split are rows that agree in source, id and size; mix() splits them by their number.
    """
    planned = _planned(docs, F.lit(None).cast("long"), id_col, text_col, source_col, weights, seed, rows_per_cell)
    return planned.drop("_row")


def _planned(
    docs: DataFrame, row: Column, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], seed: str, rows_per_cell: int
) -> DataFrame:
    """plan_mix with a column _row; it decides between rows of one id and size, and may be null where none is needed."""
    sized = materialize(
        docs.select(
            row.alias("_row"),
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(NOT_WS + "+")).cast("long").alias("size"),
            F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("u"),
        )
    )
    order = [F.substring("u", 3, 2), F.col("u"), F.col("id").asc_nulls_last(), F.col("size"), F.col("_row")]
    ranges = max(docs.sparkSession.sparkContext.defaultParallelism, min(65536, -(-sized.count() // rows_per_cell)))
    dealt = sized.repartitionByRange(ranges, F.col("source").asc_nulls_last(), *order)
    sized = materialize(dealt.withColumn("salt", F.spark_partition_id()))
    cells = sized.groupBy("source", "salt").agg(F.sum("size").alias("cell_size"))
    totals = materialize(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")))
    placed = running(totals, [F.col("source").asc_nulls_last()], {"place": F.lit(1)}, totals.count())
    weighted = placed.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))).drop("place")
    targets = water_fill(weighted)
    offset = Window.partitionBy("source").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("cell_before", F.coalesce(F.sum("cell_size").over(offset), F.lit(0))).select(
        F.col("source").alias("c_source"), F.col("salt").alias("c_salt"), "cell_before"
    )
    cells = cells.join(targets, F.col("c_source").eqNullSafe(F.col("source"))).drop("source")
    within = Window.partitionBy("source", "salt").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ordered = sized.withColumn("own_before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = ordered.join(cells, (F.col("salt") == F.col("c_salt")) & F.col("source").eqNullSafe(F.col("c_source")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    middle = F.col("cell_before") + F.col("own_before") + F.col("size") / F.lit(2.0)
    return (
        joined.withColumn("whole", whole)
        .withColumn("repeats", F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("whole") + (middle < rest).cast("long")).cast("long"))
        .select("_row", F.col("id").alias(id_col), "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    seed: str = "mix-1",
    rows_per_cell: int = 1_000_000,
) -> DataFrame:
    """The rows of docs, each as often as plan_mix says; same columns. Ids may be null or repeated.

    Each row has a number of its own, by which it meets its plan. Rows without words, null texts among
    them, are not in the mix; an empty table stays empty; texts of any length are carried whole.
    """
    row, times = unused(docs, "_mix_row"), unused(docs, "_mix_times")
    docs = numbered(docs, row)
    plan = _planned(docs, F.col(row), id_col, text_col, source_col, weights, seed, rows_per_cell)
    plan = plan.where("repeats > 0").select(F.col("_row").alias(row), F.col("repeats").alias(times))
    chosen = docs.join(plan, row).drop(row)
    return chosen.withColumn(times, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).drop(times)


def op4_mix_sources(spark, sf_dir):
    return plan_mix(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         md5('mix-1:' || coalesce(doc_id::varchar, '')) as u
  from documents),
s as (
  select source, sum(size)::bigint as source_size,
         case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 3 when 1 then 1 else 2 end as weight
  from d group by source),
b as (
  select *, coalesce(sum(2 * source_size) over o, 0) as cap_before, coalesce(sum(weight) over o, 0) as weight_before,
         sum(source_size) over () as all_size, sum(weight) over () as all_weight
  from s
  window o as (order by 2 * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding)),
l as (
  select *, max((3 * all_size - 2 * cap_before)::double / (2 * (all_weight - weight_before))::double) over () as level from b),
t as (select source, source_size, least((2 * source_size)::double, level * weight) as target from l),
j as (
  select d.doc_id, d.size, t.source_size, t.target,
         case when t.source_size > 0 then floor(t.target / t.source_size) else 0 end as whole,
         coalesce(sum(d.size) over (partition by d.source order by (('0x' || d.u[1:4])::bigint % 256), d.u, d.doc_id nulls last, d.size
                                    rows between unbounded preceding and 1 preceding), 0) as before
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       (case when size = 0 then 0 else whole + (before + size / 2.0::double < target - whole * source_size)::int end)::bigint as repeats,
       (size * case when size = 0 then 0 else whole + (before + size / 2.0::double < target - whole * source_size)::int end)::bigint as taken
from j
"""
