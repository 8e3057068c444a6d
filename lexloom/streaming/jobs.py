"""Structured Streaming jobs: each takes a streaming DataFrame; run_available() drives one to its end."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from lexloom.operators.buckets import BUCKET, create_buckets, read_buckets, upsert_buckets
from lexloom.operators.intent import classify
from lexloom.operators.merge import upsert
from lexloom.session import delete_path, make_path, path_exists, shared_folder


def run_available(stream: DataFrame, mode: str = "append", partition_by: str | None = None, fmt: str = "parquet", folder: str | None = None) -> DataFrame:
    """Process all that is there into files and give them back as a table. Complete mode goes through foreachBatch.

    With a folder (shared by driver and executors) the job resumes: a later run goes on where the last one
    ended, state included, and the table holds what all runs wrote. Without one each run starts anew.
    """
    spark = stream.sparkSession
    folder = folder or shared_folder(spark, "streams")
    out = f"{folder}/out"
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint")
    if mode == "append":
        writer = writer.format(fmt).option("path", out)
        writer = writer.partitionBy(partition_by) if partition_by else writer
    else:  # the last batch holds the whole result
        writer = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out))
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).format(fmt if mode == "append" else "parquet").load(out)


def run_batches(stream: DataFrame, step: Callable[[DataFrame, int], None], folder: str | None = None) -> None:
    """foreachBatch over all that is there; with a folder a later run goes on with the batches that are new."""
    folder = folder or shared_folder(stream.sparkSession, "streams")
    stream.writeStream.foreachBatch(step).trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").start().awaitTermination()


def pair_live(events: DataFrame, idle: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Ends right after a start, log by log: columns key, ts, id, kind (start, done, fail) in; key, start_id,
    end_id, status out.

    State is the pending start of each log, dropped when the watermark is `idle` past the log's last line.
    Lines of a batch are taken in the order of their time; a log's batches arrive in order.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["ts", "id"])
        starts = rows["kind"] == "start"
        # the line before each line: a pending start stands before the first
        before = rows["id"].where(starts).astype("Int64").shift(1)
        if state.exists:
            before.iloc[0] = state.get[0]
        ends = ~starts & before.notna()
        if starts.iloc[-1]:
            state.update((int(rows["id"].iloc[-1]),))
            end = int(rows["ts"].iloc[-1].timestamp() * 1000) + int(pd.Timedelta(idle).total_seconds() * 1000)
            state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if ends.any():
            status = rows["kind"][ends].map({"done": "completed", "fail": "failed"})
            yield pd.DataFrame({"key": key[0], "start_id": before[ends].astype("int64"), "end_id": rows["id"][ends], "status": status})

    kept = events.where(F.col("kind").isin("start", "done", "fail")).withWatermark("ts", late)
    return kept.groupBy("key").applyInPandasWithState(step, "key long, start_id long, end_id long, status string", "pending long", "append", GroupStateTimeout.EventTimeTimeout)


def tail(lines: DataFrame, keywords: list[str], col: str = "value") -> DataFrame:
    """Only lines with one of the keywords."""
    return lines.where(F.lower(F.col(col)).rlike("|".join(k.lower() for k in keywords)))


def per_window(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "2 hours", by: tuple[str, ...] = ()) -> DataFrame:
    """Rows and total value of each (sliding) window: start, n, total_value.

    In append mode a window is given once, when the watermark (`late` behind the newest row) has passed its
    end; then its state goes, and rows that come later are dropped.
    """
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    counted = events.withWatermark("ts", late).groupBy(w, *by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total_value"))
    return counted.select(F.col("window.start").alias("start"), *by, "n", "total_value")


def drop_repeats(events: DataFrame, ids: list[str], late: str = "2 hours") -> DataFrame:
    """Each id once within the watermark, so that publishing again changes nothing."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(ids)


def score_questions(questions: DataFrame, weights: dict) -> DataFrame:
    """Intent of arriving questions: classify() has no state, so it is a plain projection of the stream."""
    return classify(questions, "question", weights)


#: Terms of a dimension of intents that the plan of a batch may hold.
MOST_TERMS = 10_000


def score_live(questions: DataFrame, dimension: Callable[[SparkSession], DataFrame], folder: str | None = None) -> DataFrame:
    """Intent of arriving questions by weights that may change while the stream runs.

    dimension(spark) gives the weights (intent, kind, term, weight) as they are now; it is called for each batch, so
    new weights count from the next batch on. Adds `version`, a digest of the weights that a row was scored with, and
    `batch`. A batch that is tried again replaces itself. The table of all runs with the same folder comes back.
    """
    spark = questions.sparkSession
    folder = folder or shared_folder(spark, "streams")

    def step(df: DataFrame, batch: int) -> None:
        rows = dimension(spark).select("intent", "kind", "term", F.col("weight").cast("double").alias("weight")).distinct().limit(MOST_TERMS + 1).collect()
        if len(rows) > MOST_TERMS:
            raise ValueError(f"the dimension of intents has more than {MOST_TERMS} terms")
        weights: dict = {}
        for r in sorted(rows):
            weights.setdefault(r["intent"], {}).setdefault(r["kind"], {})[r["term"]] = r["weight"]
        version = hashlib.sha256(repr(sorted(map(tuple, rows))).encode()).hexdigest()[:16]
        scored = classify(df, "question", weights).withColumn("version", F.lit(version))
        scored.write.mode("overwrite").parquet(f"{folder}/scored/batch={batch}")

    run_batches(questions, step, folder)
    return spark.read.parquet(f"{folder}/scored")


def pane_counts(events: DataFrame, pane: str, late: str, by: tuple[str, ...], users: str | None) -> DataFrame:
    sketch = [F.hll_sketch_agg(users).alias("users")] if users else []
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", pane), *by)
    return counted.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total_value"), *sketch)


def rolling(events: DataFrame, width: str, slide: str, late: str = "2 hours", by: tuple[str, ...] = ()) -> DataFrame:
    """per_window() for sliding windows, from panes: a row enters one pane of length `slide`, and the sums of the
    panes, not the rows, enter the windows that they belong to. width must be a multiple of slide. Append mode."""
    panes = pane_counts(events, slide, late, by, None)
    whole = panes.groupBy(F.window(F.window_time("window"), width, slide), *by).agg(F.sum("n").alias("n"), F.round(F.sum("total_value"), 4).alias("total_value"))
    return whole.select(F.col("window.start").alias("start"), *by, "n", "total_value")


def live_panes(events: DataFrame, pane: str = "1 hour", late: str = "2 hours", by: tuple[str, ...] = (), users: str | None = None, folder: str | None = None) -> DataFrame:
    """Tumbling panes as they stand now, closed or not: start, by, n, total_value and, with a column of users, a sketch
    of the distinct ones. Runs what is there; each batch writes the panes that it changed, the last one counts."""
    spark = events.sparkSession
    folder = folder or shared_folder(spark, "streams")
    stream = pane_counts(events, pane, late, by, users).withColumn("start", F.col("window.start")).drop("window")

    def step(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/panes/batch={batch}")

    stream.writeStream.outputMode("update").foreachBatch(step).trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").start().awaitTermination()
    fields = StructType([*stream.schema.fields, StructField("batch", LongType())])
    held = spark.read.schema(fields).parquet(f"{folder}/panes")
    rest = [c for c in stream.columns if c not in ("start", *by)]
    return held.groupBy("start", *by).agg(F.max_by(F.struct(*rest), "batch").alias("p")).select("start", *by, "p.*")


def over_panes(panes: DataFrame, hours: float, now: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Totals over the panes that begin within the last hours before now (the end of the newest pane by default is its
    start): by, n, total_value, users (an estimate). The sums are those of a full scan; so is what a sketch estimates."""
    last = F.lit(now).cast("timestamp") if now else None
    span = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(hours * 3600)))
    if last is None:
        newest = panes.agg(F.max("start").alias("_newest")).withColumn("_k", F.lit(1))
        panes, last = panes.withColumn("_k", F.lit(1)).join(newest, "_k"), F.col("_newest")
    recent = panes.where((F.col("start") > last - span) & (F.col("start") <= last))
    sketch = [F.hll_sketch_estimate(F.hll_union_agg("users")).alias("users")] if "users" in panes.columns else []
    return recent.groupBy(*by).agg(F.sum("n").alias("n"), F.round(F.sum("total_value"), 4).alias("total_value"), *sketch)


def upsert_stream(changes: DataFrame, start: DataFrame, keys: list[str], order: str, folder: str | None = None, fold_every: int = 32, buckets: int = 16) -> DataFrame:
    """Merge a stream of changes into a table; gives the table with all changes so far.

    Within a batch the last change of a key by `order` counts, and a later batch over an earlier one; a null
    changes nothing. The first run writes `start` into the folder, in buckets by key. Each batch writes only its own
    changes, under its number, so a batch that is tried again replaces itself, and reading merges them. After every
    `fold_every` batches their changes are folded into the buckets that they touch and deleted, so files stay
    bounded by buckets and batches between two folds. With a folder a later run resumes, with the same buckets.
    """
    spark = start.sparkSession
    folder = folder or shared_folder(spark, "streams")
    cols = [c for c in changes.columns if c not in keys and c != order]
    held, logged = f"{folder}/table", f"{folder}/changes"
    fields = StructType([*[changes.schema[c] for c in [*keys, *cols]], StructField("batch", LongType())])
    if not path_exists(spark, f"{folder}/started"):
        create_buckets(start, held, keys, buckets)
        make_path(spark, f"{folder}/started")  # only now, as a job that broke off before must write the table again

    def latest() -> DataFrame:
        log = spark.read.schema(fields).parquet(logged)
        return log.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("batch"))).alias(c) for c in cols])

    def step(df: DataFrame, batch: int) -> None:
        last = df.groupBy(*keys).agg(*[F.max_by(c, F.col(order)).alias(c) for c in cols])
        last.write.mode("overwrite").parquet(f"{logged}/batch={batch}")
        if batch % fold_every == fold_every - 1:
            # changes that were folded before a failure are folded again, which changes nothing
            upsert_buckets(latest(), held, keys, buckets)
            for b in range(batch - fold_every + 1, batch + 1):
                delete_path(spark, f"{logged}/batch={b}")

    run_batches(changes, step, folder)
    table = read_buckets(spark, held).drop(BUCKET)
    return upsert(table, latest(), keys) if path_exists(spark, logged) else table


def daily_sink(events: DataFrame, ts_col: str = "ts", folder: str | None = None) -> DataFrame:
    """Append rows under their day and give the table back."""
    return run_available(events.withColumn("dt", F.to_date(ts_col)), "append", "dt", "json", folder)
