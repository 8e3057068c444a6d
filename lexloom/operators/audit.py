"""Reports on audit records, query logs and service logs.

Audit frames have the columns ts, intent, total_time_ms, cost_usd, total_tokens, chunk_count, failed and more
where a report names them. The missing test follows the source's truthiness: averages of times and scores
leave zeros out, sums take nulls as zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.session import materialize

from .filters import since

PRICE_PER_1K = 0.0015


def cost(prompt_tokens: Column, completion_tokens: Column) -> Column:
    """Cost in USD, rounded to six places."""
    return F.round((F.coalesce(prompt_tokens, F.lit(0)) + F.coalesce(completion_tokens, F.lit(0))) / 1000 * PRICE_PER_1K, 6)


def rate(part: Column, whole: Column, digits: int = 2) -> Column:
    """Percentage, 0 where the whole is 0."""
    return F.round(F.coalesce(100.0 * part / F.nullif(whole, F.lit(0)), F.lit(0.0)), digits)


def _nonzero(c: str) -> Column:
    return F.nullif(F.col(c).cast("double"), F.lit(0.0))


def audit_summary(df: DataFrame) -> DataFrame:
    """One row: totals, success rate, times, cost, tokens, chunks, and where df has expanded_terms, how many
    queries were expanded and their rate. One scan, one aggregate."""
    n, bad = F.count(F.lit(1)), F.count_if(F.coalesce("failed", F.lit(False)))
    r = lambda c: F.round(c, 4)
    expanded = F.count_if(F.size("expanded_terms") > 0)
    return df.agg(
        n.alias("total"),
        (n - bad).alias("successful"),
        bad.alias("failed_n"),
        rate(n - bad, n).alias("success_rate"),
        r(F.avg(_nonzero("total_time_ms"))).alias("avg_time_ms"),
        F.min(_nonzero("total_time_ms")).alias("min_time_ms"),
        F.max(_nonzero("total_time_ms")).alias("max_time_ms"),
        r(F.sum(F.coalesce("cost_usd", F.lit(0.0)))).alias("total_cost"),
        F.sum(F.coalesce("total_tokens", F.lit(0))).cast("long").alias("total_tokens"),
        r(F.coalesce(F.sum(F.coalesce("total_tokens", F.lit(0))) / F.nullif(n, F.lit(0)), F.lit(0.0))).alias("tokens_per_query"),
        r(F.avg(_nonzero("chunk_count"))).alias("avg_chunks"),
        *([expanded.alias("expanded"), rate(expanded, n).alias("expansion_rate")] if "expanded_terms" in df.columns else []),
    )


def distribution(df: DataFrame, col: str, missing: str = "unknown") -> DataFrame:
    """Rows for each value and their share; null and empty count as missing."""
    value = F.coalesce(F.nullif(F.col(col), F.lit("")), F.lit(missing))
    counted = df.groupBy(value.alias(col)).agg(F.count(F.lit(1)).alias("n"))
    total = F.broadcast(df.agg(F.count(F.lit(1)).alias("_total")).withColumn("_k", F.lit(1)))  # one row
    return counted.withColumn("_k", F.lit(1)).join(total, "_k").select(col, "n", F.round(F.col("n") / F.col("_total"), 6).alias("share"))


def error_stats(df: DataFrame, type_col: str) -> DataFrame:
    """For each type: rows, failed rows, failure rate, last failure."""
    bad = F.coalesce("failed", F.lit(False))
    return df.groupBy(type_col).agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("errors"), rate(F.count_if(bad), F.count(F.lit(1))).alias("error_rate"), F.max(F.when(bad, F.col("ts"))).cast("string").alias("last_error"))


def error_details(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.where(F.coalesce("failed", F.lit(False))).select(*cols)


def llm_stats(df: DataFrame) -> DataFrame:
    """Tokens, cost and answer length over all rows, zeros included."""
    r = lambda c: F.round(c, 4)
    t, c, a = F.coalesce("total_tokens", F.lit(0)), F.coalesce("cost_usd", F.lit(0.0)), F.coalesce("answer_length", F.lit(0))
    return df.agg(r(F.avg(t)).alias("avg_tokens"), F.max(t).alias("max_tokens"), r(F.sum(c)).alias("sum_cost"), r(F.avg(c)).alias("avg_cost"), r(F.max(c)).alias("max_cost"), r(F.avg(a)).alias("avg_length"), F.min(a).alias("min_length"), F.max(a).alias("max_length"))


def prompt_stats(df: DataFrame, by: str, length: Column, context: Column) -> DataFrame:
    r = lambda c: F.round(c, 4)
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), r(F.avg(length)).alias("avg_length"), F.min(length).alias("min_length"), F.max(length).alias("max_length"), r(F.avg(F.nullif(context, F.lit(0)))).alias("avg_context"))


def expansion_terms(df: DataFrame, terms: str, n: int = 20) -> DataFrame:
    """The n most frequent terms of an array column and in how many rows they stand; ties by term."""
    every = df.select(F.explode(terms).alias("term"))
    return every.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(n)


def expansion_summary(df: DataFrame, terms: str, scores: str | None = None) -> DataFrame:
    size = F.coalesce(F.size(terms), F.lit(0))
    used = F.count_if(size > 0)
    out = [used.alias("n_expanded"), F.sum(size).cast("long").alias("n_terms"), F.round(F.coalesce(F.sum(size) / F.nullif(used, F.lit(0)), F.lit(0.0)), 4).alias("terms_per_query"), rate(used, F.count(F.lit(1))).alias("expansion_rate")]
    if scores:
        mean = F.aggregate(F.col(scores), F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(scores), F.lit(0))
        out.append(F.round(F.avg(mean), 4).alias("avg_score"))
    return df.agg(*out)


def word_freq(df: DataFrame, col: str, n: int = 20) -> DataFrame:
    """The n most frequent lower-case words; ties by word."""
    words = df.select(F.explode(F.split(F.lower(F.coalesce(F.col(col), F.lit(""))), r"\s+")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(n)


def most_recent(df: DataFrame, ts_col: str, id_col: str, n: int = 10) -> DataFrame:
    return df.orderBy(F.desc(ts_col), F.desc(id_col)).limit(n)


def query_log_stats(df: DataFrame) -> DataFrame:
    """One row over query events (ts, status, query, chunk_count, total_tokens): status totals, success
    rate, time range, queries an hour, mean lengths."""
    n = F.count(F.lit(1))
    seconds = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    return df.agg(
        n.alias("total"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed_n"),
        rate(F.count_if(F.col("status") == "completed"), n, 1).alias("success_rate"),
        F.min("ts").cast("string").alias("first_ts"),
        F.max("ts").cast("string").alias("last_ts"),
        F.round(n / F.nullif(seconds / 3600, F.lit(0.0)), 2).alias("per_hour"),
        F.round(F.avg(F.length("query")), 1).alias("avg_query_length"),
        F.round(F.avg(_nonzero("chunk_count")), 1).alias("avg_chunks"),
        F.round(F.avg(_nonzero("total_tokens")), 1).alias("avg_tokens"),
        F.max("total_tokens").alias("max_tokens"),
    )


#: A log of more lines than this is cut into ranges of its order.
LINES_OF_TASK = 1_000_000


def pair_events(df: DataFrame, by: str, order: list[str], kind: str, payload: list[str]) -> DataFrame:
    """Ends (done, fail) right after a start of the same log, with the start's payload as start_*.

    A start overwrites one that is pending, the next end closes it, other ends and kinds are ignored. `order` must
    tell a log's lines apart; logs with a null in `by` are one log. While no log has more than LINES_OF_TASK lines,
    each is ordered by one task. Beyond that lines are dealt out by ranges of log and order, so that one log goes
    over all tasks: each range pairs its own lines, and what is pending at its end is carried to the next range that
    holds the log, from one row for each range and log.
    """
    kept = df.where(F.col(kind).isin("start", "done", "fail"))
    longest = kept.groupBy(by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    end = (F.col(kind) != "start") & (F.col("_before") == "start")
    status = F.when(F.col(kind) == "done", "completed").otherwise("failed")
    if longest <= LINES_OF_TASK:
        w = Window.partitionBy(by).orderBy(*order)
        tagged = kept.select("*", F.lag(kind).over(w).alias("_before"), *[F.lag(p).over(w).alias(f"start_{p}") for p in payload])
        return tagged.where(end).drop("_before").withColumn("status", status)
    ranges = materialize(kept.repartitionByRange(F.col(by).asc_nulls_first(), *order).withColumn("_range", F.spark_partition_id()))
    line = F.struct(F.col(kind).alias("_before"), *[F.col(p).alias(f"start_{p}") for p in payload])
    inside = Window.partitionBy("_range", by).orderBy(*order)
    tagged = ranges.withColumn("_last", F.lag(line).over(inside))
    ends = ranges.groupBy(F.col(by).alias("_by"), F.col("_range").alias("_at")).agg(F.max_by(line, F.struct(*order)).alias("_open"))
    carried = ends.select("_by", "_at", F.lag("_open").over(Window.partitionBy("_by").orderBy("_at")).alias("_carried")).where("_carried is not null")
    first = tagged.where("_last is null").drop("_last").join(carried, (F.col("_range") == F.col("_at")) & F.col(by).eqNullSafe(F.col("_by")))
    both = tagged.where("_last is not null").unionByName(first.withColumn("_last", F.col("_carried")).drop("_by", "_at", "_carried"))
    return both.select(*df.columns, "_last.*").where(end).drop("_before").withColumn("status", status)


def parse_service_log(lines: DataFrame, start: str, done: str, fail: str) -> DataFrame:
    """ts, kind and captures of log lines (value) that begin with a timestamp; other lines are dropped.

    The patterns have groups: start (query), done (chunk count, tokens), fail (error)."""
    v = F.col("value")
    stamped = lines.where(v.startswith("20")).withColumn("ts", F.try_to_timestamp(F.substring("value", 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))).where("ts is not null")
    group = lambda p, i: F.nullif(F.regexp_extract(v, p, i), F.lit(""))
    return stamped.select(
        "*",
        F.when(v.rlike(done), "done").when(v.rlike(fail), "fail").when(v.rlike(start), "start").alias("kind"),
        group(start, 1).alias("query"),
        group(done, 1).try_cast("int").alias("chunk_count"),
        group(done, 2).try_cast("int").alias("total_tokens"),
        group(fail, 1).alias("error"),
    ).where("kind is not null")


def dashboard(df: DataFrame, now: str, hours: float = 24, n: int = 5) -> DataFrame:
    """One row over the last hours before now: totals, success rate, times, tokens, cost, and the n most
    frequent intents (ties by name). Rows at the very start of the span don't count."""
    recent = since(df, "ts", hours=hours, now=now)
    totals = recent.agg(
        F.count(F.lit(1)).alias("total"),
        rate(F.count_if(~F.coalesce("failed", F.lit(False))), F.count(F.lit(1)), 1).alias("success_rate"),
        F.round(F.sum("total_time_ms"), 2).alias("sum_time_ms"),
        F.sum(F.coalesce("total_tokens", F.lit(0))).cast("long").alias("total_tokens"),
        F.round(F.sum("cost_usd"), 6).alias("total_cost"),
        F.max("ts").cast("string").alias("last_ts"),
    )
    counted = recent.groupBy("intent").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "intent").limit(n)
    listed = counted.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "intent"))), lambda x: x["intent"]), ",").alias("top_intents"))
    return totals.withColumn("_k", F.lit(1)).join(listed.withColumn("_k", F.lit(1)), "_k").drop("_k")
