"""Audit and query-log reports: events stand for audit records and log lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.operators import audit as A
from lexloom.operators import partials as P
from lexloom.operators.filters import since
from lexloom.session import materialize, shared_folder, table
from lexloom.sources.readers import jsonl_counts, parse_variants, shape_counts
from lexloom.sources.sinks import ANALYSIS_COLUMNS, AUDIT_COLUMNS, FOCUSED_COLUMNS, analysis_rows, audit_export, audit_rows, focused_export, focused_rows


def _k():
    return F.get_json_object("props", "$.k").cast("int")


def events(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        "event_id", "ts", "user_id", F.col("event_type").alias("intent"), (F.col("event_type") == "error").alias("failed"), F.col("value").alias("total_time_ms"),
        _k().alias("total_tokens"), A.cost(_k(), F.col("user_id")).alias("cost_usd"), (_k() % 7).alias("chunk_count"), F.length("props").alias("answer_length"),
    )


def audit_summary(spark, sf):
    expanded = F.when(F.col("total_tokens") % 5 == 0, F.array("intent")).when(F.col("total_tokens") % 5 == 1, F.array().cast("array<string>"))
    return A.audit_summary(events(spark, sf).withColumn("expanded_terms", expanded))


def audit_intents(spark, sf):
    return A.distribution(events(spark, sf), "intent")


def audit_errors(spark, sf):
    return A.error_stats(events(spark, sf).withColumn("user_group", F.col("user_id") % 10), "user_group")


def audit_error_rows(spark, sf):
    return A.error_details(events(spark, sf), ["event_id", "user_id", "total_time_ms"])


def audit_llm_stats(spark, sf):
    return A.llm_stats(events(spark, sf))


def audit_cost(spark, sf):
    return events(spark, sf).select("event_id", "total_tokens", "cost_usd")


def audit_export_rows(spark, sf):
    shaped = events(spark, sf).select("event_id", "failed", F.array("intent", F.col("user_id").cast("string")).alias("terms"), F.concat(F.lit("answer "), "intent").alias("final_answer"))
    return audit_export(shaped)


def audit_focused(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text", (F.col("n_chars") > 2000).alias("long"))
    out = focused_export(docs, ["doc_id", "lang", "text", "long"], ["text"], ["long"])
    return out.select("doc_id", "lang", F.md5("text").alias("text_md5"), F.length("text").alias("length"), "long")


def _records(spark, sf):
    """Audit records as they are logged, from events."""
    return events(spark, sf).select(
        F.concat(F.lit("q"), "event_id").alias("query_id"), F.col("ts").cast("string").alias("timestamp"), F.concat(F.lit("about "), "intent").alias("user_query"), "intent",
        F.when(F.col("user_id") % 3 > 0, F.repeat(F.lit("answer "), (F.col("user_id") % 100).cast("int"))).alias("final_answer"), F.when(F.col("user_id") % 4 > 0, F.col("failed")).alias("error_occurred"),
        F.array("intent", F.lit("x")).alias("retrieval_method"), "chunk_count", "total_tokens", F.col("cost_usd").alias("estimated_cost_usd"), F.lit(0).alias("answer_length"), F.lit("batch").alias("environment"),
    )


def audit_report(spark, sf):
    return audit_rows(_records(spark, sf))


def audit_short(spark, sf):
    return focused_rows(_records(spark, sf))


def audit_analysis(spark, sf):
    return analysis_rows(_records(spark, sf))


def audit_lookback(spark, sf):
    recent = since(table(spark, sf, "events"), "ts", hours=24, now="2024-01-30 00:00:00")
    return recent.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("avg_value"), F.max("ts").cast("string").alias("last_ts"))


def dashboard(spark, sf):
    return A.dashboard(events(spark, sf), "2024-01-20 00:00:00", 48)


def audit_summary_panes(spark, sf):
    """The summary of each intent from a stored table of panes."""
    return P.summary_from_panes(materialize(P.audit_panes(events(spark, sf))), "intent")


def dashboard_panes(spark, sf):
    """The dashboard from panes, and from the records of the piece of an hour at the start of its span."""
    e = events(spark, sf)
    return P.dashboard_from_panes(materialize(P.audit_panes(e)), e, "2024-01-20 00:30:00", 48)


def log_pairing(spark, sf):
    kind = F.when(F.col("event_type") == "click", "start").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "fail")
    e = table(spark, sf, "events").withColumn("kind", kind)
    paired = A.pair_events(e, "user_id", ["ts", "event_id"], "kind", ["event_id", "value"])
    return paired.select("user_id", "event_id", "start_event_id", F.col("start_value"), "status")


def querylog_stats(spark, sf):
    e = events(spark, sf).withColumn("status", F.when(F.col("failed"), "failed").otherwise("completed")).withColumn("query", F.concat("intent", F.lit(" "), F.col("user_id").cast("string")))
    return A.query_log_stats(e)


def log_lines(spark, sf):
    """Events as JSON lines of three shapes, with other names, types and missing fields, and some that are broken."""
    e, n = table(spark, sf, "events"), F.col("event_id") % 4
    one = F.to_json(F.struct(F.col("event_type").alias("intent"), F.col("value").alias("ms"), F.col("user_id").alias("tokens")))
    two = F.to_json(F.struct(F.col("event_type").alias("intent"), F.concat(F.lit("about "), F.col("user_id").cast("string")).alias("tokens")))
    three = F.to_json(F.struct(F.col("user_id").alias("tokens"), F.array("value").alias("ms"), F.lit(None).cast("string").alias("intent")), {"ignoreNullFields": "false"})
    return e.select("event_id", F.when(n == 0, one).when(n == 1, two).when(n == 2, three).otherwise(F.when(F.col("event_id") % 8 == 3, F.lit('{"intent": ')).otherwise(F.lit(" "))).alias("value"))


_SHAPE = {"intent": "string", "ms": "double", "tokens": "bigint"}


def log_variants(spark, sf):
    return parse_variants(log_lines(spark, sf), _SHAPE).select("event_id", "intent", F.round("ms", 4).alias("ms"), "tokens", "malformed", F.array_join("missing", ",").alias("missing"), F.array_join("drifted", ",").alias("drifted"))


def log_shapes(spark, sf):
    return shape_counts(parse_variants(log_lines(spark, sf), _SHAPE))


def querylog_union(spark, sf):
    a = table(spark, sf, "events").select(F.col("event_type").alias("source"), "ts", "value")
    b = table(spark, sf, "conversations").select(F.col("role").alias("source"), F.length("text").alias("length"))
    both = a.unionByName(b, allowMissingColumns=True)
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("avg_value"), F.max("length").alias("max_length"), F.count("ts").alias("n_ts"))


def word_freq(spark, sf):
    return A.word_freq(table(spark, sf, "conversations"), "text", 20)


def recent_queries(spark, sf):
    return A.most_recent(table(spark, sf, "events"), "ts", "event_id", 10).select("event_id", F.col("ts").cast("string").alias("ts"), "event_type")


def prompt_stats(spark, sf):
    return A.prompt_stats(table(spark, sf, "conversations"), "role", F.length("text"), F.length("text") % 50)


def expansion_stats(spark, sf):
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) > 3))
    return A.expansion_terms(table(spark, sf, "documents").select(words.alias("terms")), "terms", 20)


def expansion_summary(spark, sf):
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(F.when(F.col("role") == "user", F.lit("u"))).alias("terms"), F.transform(F.array_sort(F.collect_list("turn")), lambda t: t.cast("double")).alias("scores"))
    return A.expansion_summary(turns, "terms", "scores")


def jsonl_validate(spark, sf):
    e = table(spark, sf, "events")
    line = F.when(F.col("event_id") % 11 == 0, F.lit(" ")).when(F.col("event_id") % 13 == 0, F.concat("props", F.lit("}{"))).when(F.col("event_id") % 17 == 0, F.lit('{"other": 1}')).otherwise(F.col("props"))
    return jsonl_counts(e.select(line.alias("value")), ["k"])


QUERIES = {f.__name__: f for f in (audit_summary, audit_intents, audit_errors, audit_error_rows, audit_llm_stats, audit_cost, audit_export_rows, audit_focused, audit_report, audit_short, audit_analysis, audit_lookback, dashboard, audit_summary_panes, dashboard_panes, log_pairing, querylog_stats, log_variants, log_shapes, querylog_union, word_freq, recent_queries, prompt_stats, expansion_stats, expansion_summary, jsonl_validate)}

_E = """
with e as (select event_id, ts, user_id, event_type as intent, event_type = 'error' as failed, value as total_time_ms, (props->>'$.k')::int as total_tokens,
                  round(((props->>'$.k')::int + user_id)::double / 1000 * 0.0015::double, 6) as cost_usd, (props->>'$.k')::int % 7 as chunk_count, length(props) as answer_length
           from events)"""
_R = (
    _E
    + """, a as (select 'q' || event_id as query_id, ts::varchar as timestamp, 'about ' || intent as user_query, intent, case when user_id % 3 > 0 then repeat('answer ', (user_id % 100)::int) end as final_answer,
  case when user_id % 4 > 0 then failed end as error_occurred, chunk_count, total_tokens, cost_usd as estimated_cost_usd, 0 as answer_length, 'batch' as environment from e)"""
)


def _columns(names: tuple[str, ...], **shown: str) -> str:
    there = ("query_id", "timestamp", "user_query", "intent", "final_answer", "error_occurred", "chunk_count", "total_tokens", "estimated_cost_usd", "answer_length", "environment")
    return ", ".join(f"{shown[n]} as {n}" if n in shown else n if n in there else f"null::varchar as {n}" for n in names)


_FLAG = "case when coalesce(error_occurred, false) then 'Yes' else 'No' end"
_LOG = """with p as (select event_id, case when event_id % 4 < 2 then event_type end as intent, case when event_id % 4 = 0 then round(value, 4) end as ms, case when event_id % 4 in (0, 2) then user_id end as tokens,
  event_id % 4 = 3 as malformed, case when event_id % 4 = 1 then 'ms' else '' end as missing, case event_id % 4 when 1 then 'tokens' when 2 then 'ms' else '' end as drifted from events)"""

SQL = {
    "audit_report": _R + " select " + _columns(AUDIT_COLUMNS, error_occurred=_FLAG, retrieval_method="intent || ', x'", answer_length="case when length(final_answer) > 0 then length(final_answer) else answer_length end::int") + " from a",
    "audit_short": _R + " select " + _columns(FOCUSED_COLUMNS, error_occurred=_FLAG, final_answer="case when length(final_answer) > 500 then final_answer[1:500] || '...' else final_answer end") + " from a",
    "audit_analysis": _R + " select " + _columns(ANALYSIS_COLUMNS, error_occurred="coalesce(error_occurred, false)") + " from a",
    "audit_summary": _E
    + """ select count(*) as total, count(*) filter (not failed) as successful, count(*) filter (failed) as failed_n, round(100.0::double * count(*) filter (not failed) / count(*), 2) as success_rate,
 round(avg(nullif(total_time_ms, 0)), 4) as avg_time_ms, min(nullif(total_time_ms, 0)) as min_time_ms, max(nullif(total_time_ms, 0)) as max_time_ms, round(sum(cost_usd), 4) as total_cost,
 sum(total_tokens)::bigint as total_tokens, round(sum(total_tokens)::double / count(*), 4) as tokens_per_query, round(avg(nullif(chunk_count, 0)), 4) as avg_chunks,
count(*) filter (total_tokens % 5 = 0) as expanded, round(100.0::double * count(*) filter (total_tokens % 5 = 0) / count(*), 2) as expansion_rate from e""",
    "audit_intents": _E + " select intent, count(*) as n, round(count(*)::double / sum(count(*)) over (), 6) as share from e group by 1",
    "audit_errors": _E + " select user_id % 10 as user_group, count(*) as n, count(*) filter (failed) as errors, round(100.0::double * count(*) filter (failed) / count(*), 2) as error_rate, (max(ts) filter (failed))::varchar as last_error from e group by 1",
    "audit_error_rows": _E + " select event_id, user_id, total_time_ms from e where failed",
    "audit_llm_stats": _E + " select round(avg(total_tokens), 4) as avg_tokens, max(total_tokens) as max_tokens, round(sum(cost_usd), 4) as sum_cost, round(avg(cost_usd), 4) as avg_cost, round(max(cost_usd), 4) as max_cost, round(avg(answer_length), 4) as avg_length, min(answer_length)::int as min_length, max(answer_length)::int as max_length from e",
    "audit_cost": _E + " select event_id, total_tokens, cost_usd from e",
    "audit_export_rows": "select event_id, case when event_type = 'error' then 'Yes' else 'No' end as failed, event_type || ', ' || user_id as terms, 'answer ' || event_type as final_answer, (7 + length(event_type))::int as answer_length from events",
    "audit_focused": "with t as (select doc_id, lang, case when length(text) > 500 then text[1:500] || '...' else text end as x, case when n_chars > 2000 then 'Yes' else 'No' end as long from documents) select doc_id, lang, md5(x) as text_md5, length(x)::int as length, long from t",
    "audit_lookback": "select event_type, count(*) as n, round(avg(value), 4) as avg_value, max(ts)::varchar as last_ts from events where ts > timestamp '2024-01-29 00:00:00' group by 1",
    "dashboard": _E
    + """, r as (select * from e where ts > timestamp '2024-01-18 00:00:00')
select count(*) as total, round(100.0::double * count(*) filter (not failed) / count(*), 1) as success_rate, round(sum(total_time_ms), 2) as sum_time_ms, sum(total_tokens)::bigint as total_tokens, round(sum(cost_usd), 6) as total_cost,
 max(ts)::varchar as last_ts, (select string_agg(intent, ',' order by n desc, intent) from (select intent, count(*) as n from r group by 1 order by n desc, intent limit 5)) as top_intents from r""",
    "log_pairing": """with k as (select *, case event_type when 'click' then 'start' when 'purchase' then 'done' when 'error' then 'fail' end as kind from events where event_type in ('click', 'purchase', 'error')),
p as (select *, lag(kind) over w as before, lag(event_id) over w as start_event_id, lag(value) over w as start_value from k window w as (partition by user_id order by ts, event_id))
select user_id, event_id, start_event_id, start_value, case kind when 'done' then 'completed' else 'failed' end as status from p where kind <> 'start' and before = 'start'""",
    "querylog_stats": _E
    + """ select count(*) as total, count(*) filter (not failed) as completed, count(*) filter (failed) as failed_n, round(100.0::double * count(*) filter (not failed) / count(*), 1) as success_rate,
 min(ts)::varchar as first_ts, max(ts)::varchar as last_ts, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts)))::double / 1e6::double / 3600), 2) as per_hour,
 round(avg(length(intent) + 1 + length(user_id::varchar)), 1) as avg_query_length, round(avg(nullif(chunk_count, 0)), 1) as avg_chunks, round(avg(nullif(total_tokens, 0)), 1) as avg_tokens, max(total_tokens) as max_tokens from e""",
    "log_variants": _LOG + " select * from p",
    "log_shapes": _LOG + """ select 'lines' as what, null as field, count(*) as n from p union all select 'malformed', null, count(*) from p where malformed having count(*) > 0
union all select 'missing', f, count(*) from (select unnest(string_split(missing, ',')) as f from p) where f <> '' group by 2
union all select 'drifted', f, count(*) from (select unnest(string_split(drifted, ',')) as f from p) where f <> '' group by 2""",
    "querylog_union": "select source, count(*) as n, round(avg(value), 4) as avg_value, max(length)::int as max_length, count(ts) as n_ts from (select event_type as source, ts, value, null as length from events union all select role, null, null, length(text) from conversations) group by 1",
    "word_freq": r"select word, count(*) as n from (select unnest(regexp_split_to_array(lower(coalesce(text, '')), '\s+')) as word from conversations) where word <> '' group by 1 order by n desc, word limit 20",
    "recent_queries": "select event_id, ts::varchar as ts, event_type from events order by events.ts desc, event_id desc limit 10",
    "prompt_stats": "select role, count(*) as n, round(avg(length(text)), 4) as avg_length, min(length(text))::int as min_length, max(length(text))::int as max_length, round(avg(nullif(length(text) % 50, 0)), 4) as avg_context from conversations group by 1",
    "expansion_stats": r"select term, count(*) as n from (select unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda w: length(w) > 3))) as term from documents) group by 1 order by n desc, term limit 20",
    "expansion_summary": """with t as (select conv_id, count(*) filter (role = 'user') as k, avg(turn) as s from conversations group by 1)
select count(*) filter (k > 0) as n_expanded, sum(k)::bigint as n_terms, round(sum(k)::double / count(*) filter (k > 0), 4) as terms_per_query, round(100.0::double * count(*) filter (k > 0) / count(*), 2) as expansion_rate, round(avg(s), 4) as avg_score from t""",
    "jsonl_validate": """with v as (select case when event_id % 11 = 0 then ' ' when event_id % 13 = 0 then props || '}{' when event_id % 17 = 0 then '{"other": 1}' else props end as value from events)
select count(*) as total, count(*) filter (trim(value) = '') as blank, count(*) filter (trim(value) <> '' and not json_valid(value)) as malformed,
 count(*) filter (json_valid(value) and not coalesce(try(json_exists(value, '$.k')), false)) as missing_field, count(*) filter (json_valid(value) and coalesce(try(json_exists(value, '$.k')), false)) as valid from v""",
}

_WHOLE = SQL["audit_summary"].partition("count(*) filter (total_tokens % 5 = 0) as expanded")[0].rstrip().rstrip(",")
SQL["audit_summary_panes"] = _WHOLE.replace("select count(*) as total,", "select intent, count(*) as total,") + " from e group by intent"
SQL["dashboard_panes"] = SQL["dashboard"].replace("2024-01-18 00:00:00", "2024-01-18 00:30:00")
