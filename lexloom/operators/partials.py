"""Reports from partial sums: one row for each hour and intent, made once, merged on reading.

A table of panes is thousands of times smaller than the records, and new hours are added to it without a look at the
old ones. Everything in a pane merges: counts and sums add up, extremes and sketches unite. Sums, counts and extremes
of a report from panes are those of a scan of all records; distinct counts and quantiles are estimates, with the
error of their sketches, whatever the number of panes they come from.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.session import materialize

from .audit import rate

#: Numbers of records that panes add up, and those of them that reports average without zeros.
SUMMED = ("total_time_ms", "cost_usd", "total_tokens", "chunk_count")


def audit_panes(df: DataFrame, by: tuple[str, ...] = ("intent",), users: str | None = None, pane: str = "hour") -> DataFrame:
    """Panes of audit records: start, by, n, bad, last_ts, for each number its sum, its count without zeros and nulls and
    its least and greatest value but zero, a KLL sketch of the times and, with a column of users, an HLL sketch.

    Records without a time are in a pane with start null, so that they are in totals over all panes. Missing columns
    count as null. An empty table gives no panes.
    """
    have = {c: F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double") for c in SUMMED}
    out = [F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("failed", F.lit(False))).alias("bad"), F.max("ts").alias("last_ts")]
    for name, c in have.items():
        some = F.nullif(c, F.lit(0.0))
        out += [F.sum(c).alias(f"{name}_sum"), F.count(some).alias(f"{name}_n"), F.min(some).alias(f"{name}_min"), F.max(some).alias(f"{name}_max")]
    out.append(F.kll_sketch_agg_double(F.nullif(have["total_time_ms"], F.lit(0.0))).alias("times"))
    if users:
        out.append(F.hll_sketch_agg(users).alias("users"))
    return df.groupBy(F.date_trunc(pane, "ts").cast("timestamp_ntz").alias("start"), *by).agg(*out)


def refresh_panes(records: DataFrame, path: str, days: list[str], by: tuple[str, ...] = ("intent",), users: str | None = None) -> None:
    """Make the panes of these days (yyyy-MM-dd) anew from the records and put them into the table at path, in the place
    of what it holds of these days. Only records of these days are read and other days stay as they are, so late records
    cost their days and running again changes nothing. A day left without records keeps its old panes."""
    wanted = F.to_date("ts").isin(*[F.lit(d).cast("date") for d in days])
    first, last = min(days), (datetime.fromisoformat(max(days)) + timedelta(days=1)).isoformat(sep=" ")
    span = (F.col("ts") >= F.lit(first).cast("timestamp_ntz")) & (F.col("ts") < F.lit(last).cast("timestamp_ntz"))  # reaches the scan
    made = materialize(audit_panes(records.where(span & wanted), by, users).withColumn("day", F.to_date("start")))
    made.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def read_panes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merged(panes: DataFrame, *by: str) -> DataFrame:
    """Panes put together by some of their columns, in the form of a pane; without columns one row of all."""
    out = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "bad")] + [F.max("last_ts").alias("last_ts")]
    for c in SUMMED:
        out += [F.sum(f"{c}_sum").alias(f"{c}_sum"), F.coalesce(F.sum(f"{c}_n"), F.lit(0)).alias(f"{c}_n"), F.min(f"{c}_min").alias(f"{c}_min"), F.max(f"{c}_max").alias(f"{c}_max")]
    out += [f.alias(c) for c, f in {"times": F.kll_merge_agg_double("times"), "users": F.hll_union_agg("users")}.items() if c in panes.columns]
    return panes.groupBy(*by).agg(*out)


def _mean(c: str) -> Column:
    return F.round(F.col(f"{c}_sum") / F.nullif(F.col(f"{c}_n"), F.lit(0)), 4)


def summary_from_panes(panes: DataFrame, *by: str) -> DataFrame:
    """The columns of audit_summary() without expansions, from panes: one row, or one for each value of by."""
    sums = {c: F.coalesce(f"{c}_sum", F.lit(0.0)) for c in SUMMED}
    return merged(panes, *by).select(
        *by,
        F.col("n").alias("total"),
        (F.col("n") - F.col("bad")).alias("successful"),
        F.col("bad").alias("failed_n"),
        rate(F.col("n") - F.col("bad"), F.col("n")).alias("success_rate"),
        _mean("total_time_ms").alias("avg_time_ms"),
        F.col("total_time_ms_min").alias("min_time_ms"),
        F.col("total_time_ms_max").alias("max_time_ms"),
        F.round(sums["cost_usd"], 4).alias("total_cost"),
        sums["total_tokens"].cast("long").alias("total_tokens"),
        F.round(F.coalesce(sums["total_tokens"] / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0)), 4).alias("tokens_per_query"),
        _mean("chunk_count").alias("avg_chunks"),
    )


def estimates(panes: DataFrame, *by: str, ranks: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """by, n, times_p50 and so on (null without a time), and users where panes have a sketch of them."""
    some = F.kll_sketch_get_n_double("times") > 0
    quantiles = [F.when(some, F.kll_sketch_get_quantile_double("times", F.lit(r))).alias(f"times_p{r * 100:g}") for r in ranks]
    users = [F.hll_sketch_estimate("users").alias("users")] if "users" in panes.columns else []
    return merged(panes, *by).select(*by, "n", *quantiles, *users)


def dashboard_from_panes(panes: DataFrame, records: DataFrame, now: str, hours: float = 24, n: int = 5, by: str = "intent") -> DataFrame:
    """The row of dashboard() over the last hours before now: whole hours come from panes (made by `by`), and only the
    piece of an hour at the start of the span is read from the records, by a filter that reaches their scan."""
    begin = datetime.fromisoformat(now) - timedelta(hours=hours)
    whole = begin.replace(minute=0, second=0, microsecond=0)
    whole += timedelta(hours=1)  # the records at the very start don't count, so the hour of begin is never whole
    at = lambda t: F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")
    edge = audit_panes(records.where((F.col("ts") > at(begin)) & (F.col("ts") < at(whole))), (by,))
    recent = panes.where(F.col("start") >= at(whole)).select(*edge.columns).unionByName(edge)
    each = merged(recent, by)
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), by))), 1, n)  # one entry for each value of by
    sums = {c: F.sum(f"{c}_sum") for c in SUMMED}
    return each.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        rate(F.coalesce(F.sum(F.col("n") - F.col("bad")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)), 1).alias("success_rate"),
        F.round(sums["total_time_ms"], 2).alias("sum_time_ms"),
        sums["total_tokens"].cast("long").alias("total_tokens"),
        F.round(sums["cost_usd"], 6).alias("total_cost"),
        F.max("last_ts").cast("string").alias("last_ts"),
        F.array_join(F.transform(top, lambda x: x[by]), ",").alias("top_intents"),
    )
