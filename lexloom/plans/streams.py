"""Streaming queries: the tables are replayed as streams until nothing is left."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.session import table
from lexloom.streaming import jobs as S
from lexloom.streaming.ordered import pair_ordered, rocksdb

from .questions import WEIGHTS


def _stream(spark, sf, name):
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}.parque[t]")  # a pattern, as the table may be one file


def _events(spark, sf):
    return _stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def stream_hourly(spark, sf):
    out = S.run_available(S.per_window(_events(spark, sf), "1 hour"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "total_value")


def stream_rolling(spark, sf):
    out = S.run_available(S.rolling(_events(spark, sf), "24 hours", "6 hours", by=("event_type",)))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total_value")


def stream_live(spark, sf):
    """The last 24 hours as they stand at the end of the stream, from hourly panes."""
    return S.over_panes(S.live_panes(_events(spark, sf), by=("event_type",)), 24, by=("event_type",))


def stream_live_intent(spark, sf):
    """Weights are read anew for each batch."""
    q = _stream(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.col("text").alias("question"))
    rows = [(i, k, t, w) for i, kinds in WEIGHTS.items() for k, ts in kinds.items() for t, w in ts.items()]
    return S.score_live(q, lambda s: s.createDataFrame(rows, "intent string, kind string, term string, weight double")).select("question_id", "intent", "confidence")


def stream_tail(spark, sf):
    out = S.run_available(S.tail(_stream(spark, sf, "events").select("event_id", "event_type"), ["err", "SIGN"], "event_type"))
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def stream_pairing(spark, sf):
    return S.run_available(S.pair_live(_log_lines(spark, sf)))


def stream_pairing_ordered(spark, sf):
    """Pairs whose end the watermark has passed; lines are paired in the order of time, however they come."""
    with rocksdb(spark):
        return S.run_available(pair_ordered(_log_lines(spark, sf), idle="3650 days"))


def _log_lines(spark, sf):
    kind = F.when(F.col("event_type") == "click", "start").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "fail")
    return _events(spark, sf).select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), kind.alias("kind"))


def stream_dedup(spark, sf):
    e = _events(spark, sf).select("ts", "event_id").withColumn("event_id", F.explode(F.array("event_id", "event_id")))
    return S.run_available(S.drop_repeats(e, ["event_id"], "60 days")).groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def stream_intent(spark, sf):
    q = _stream(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.col("text").alias("question"))
    return S.run_available(S.score_questions(q, WEIGHTS).select("question_id", "intent", "confidence"))


def stream_upsert(spark, sf):
    c = table(spark, sf, "customer")
    start = c.where("c_custkey % 2 = 0").select("c_custkey", "c_mktsegment", "c_nationkey")
    changes = _stream(spark, sf, "customer").where("c_custkey % 3 = 0").select("c_custkey", F.concat(F.lit("new "), "c_mktsegment").alias("c_mktsegment"), F.lit(None).cast("bigint").alias("c_nationkey"), F.lit(1).alias("ord"))
    return S.upsert_stream(changes, start, ["c_custkey"], "ord")


def stream_daily(spark, sf):
    out = S.daily_sink(_events(spark, sf).select("event_id", "ts", "event_type"))
    return out.groupBy(F.col("dt").cast("string").alias("dt")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


QUERIES = {f.__name__: f for f in (stream_hourly, stream_rolling, stream_live, stream_live_intent, stream_tail, stream_pairing, stream_pairing_ordered, stream_dedup, stream_intent, stream_upsert, stream_daily)}
SQL = {
    "stream_hourly": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n, round(sum(value), 4) as total_value from events where date_trunc('hour', ts) + interval 1 hour <= (select max(ts) - interval 2 hours from events) group by 1",
    "stream_rolling": "with w as (select time_bucket(interval 6 hours, ts) - o * interval 6 hours as s, event_type, value from events, (select unnest([0, 1, 2, 3]) as o)) select strftime(s, '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(sum(value), 4) as total_value from w where s + interval 24 hours <= (select max(ts) - interval 2 hours from events) group by 1, 2",
    "stream_live": "select event_type, count(*) as n, round(sum(value), 4) as total_value from events where date_trunc('hour', ts) > (select date_trunc('hour', max(ts)) - interval 24 hours from events) group by 1",
    "stream_tail": "select event_type, count(*) as n from events where event_type in ('error', 'signup') group by 1",
    "stream_pairing": """with k as (select *, case event_type when 'click' then 'start' when 'purchase' then 'done' when 'error' then 'fail' end as kind from events where event_type in ('click', 'purchase', 'error')),
p as (select *, lag(kind) over w as before, lag(event_id) over w as start_id from k window w as (partition by user_id order by ts, event_id))
select user_id as key, start_id, event_id as end_id, case kind when 'done' then 'completed' else 'failed' end as status from p where kind <> 'start' and before = 'start'""",
    "stream_dedup": "select ts::date::varchar as day, count(*) as n from events group by 1",
    "stream_upsert": """with o as (select c_custkey, c_mktsegment, c_nationkey from customer where c_custkey % 2 = 0), n as (select c_custkey, 'new ' || c_mktsegment as seg from customer where c_custkey % 3 = 0)
select coalesce(o.c_custkey, n.c_custkey) as c_custkey, coalesce(n.seg, o.c_mktsegment) as c_mktsegment, o.c_nationkey from o full join n using (c_custkey)""",
    "stream_daily": "select ts::date::varchar as dt, count(*) as n, min(event_id) as first_id from events group by 1",
}
from .questions import SQL as _BATCH  # noqa: E402

SQL["stream_intent"] = _BATCH["intent_winner"].partition(" select question_id, intent,")[0] + " select question_id, intent, confidence from c"
SQL["stream_live_intent"] = SQL["stream_intent"]
SQL["stream_pairing_ordered"] = SQL["stream_pairing"] + " and epoch_ms(ts) <= (select epoch_ms(max(ts)) - 7200000 from k)"
