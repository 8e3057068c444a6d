"""Question scoring and routing: every turn of the conversations is a question."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.operators import intent as I
from lexloom.operators.filters import is_vague, query_fault
from lexloom.operators.retrieval import adaptive_k
from lexloom.session import table

WEIGHTS = {
    "factual": {"keyword": {"the": 0.3, "und": 0.9, "on that": 0.8}, "phrase": {"in the": 0.6}},
    "thematic": {"keyword": {"that": 0.6, "de": 0.5, "der": 0.3}, "phrase": {"of the": 0.7, "en la": 0.5}},
    "generative": {"keyword": {"la": 0.8, "die": 0.7}, "phrase": {"de la": 0.9}},
}
VAGUE = ("of the", "de la")


def _questions(spark, sf):
    return table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.col("text").alias("question"))


def question_validate(spark, sf):
    q = _questions(spark, sf).withColumn("question", F.when(F.col("question_id") % 7 == 0, F.lit(" ")).when(F.col("question_id") % 7 == 1, F.lit("?!")).when(F.col("question_id") % 7 == 2, F.lit(" 123 ")).when(F.col("question_id") % 7 == 3, F.lit("x")).otherwise(F.col("question")))
    return q.groupBy(F.coalesce(query_fault(F.col("question"), 500), F.lit("ok")).alias("fault")).agg(F.count(F.lit(1)).alias("n"))


def question_vague(spark, sf):
    return _questions(spark, sf).select("question_id", is_vague(F.col("question"), VAGUE).alias("vague"))


def intent_scores(spark, sf):
    s = I.intent_scores(_questions(spark, sf), "question", WEIGHTS)
    score = lambda i: F.coalesce(F.try_element_at("scores", F.lit(i)), F.lit(0.0)).alias(i)
    return s.select("question_id", *[score(i) for i in WEIGHTS])


def intent_winner(spark, sf):
    c = I.classify(_questions(spark, sf), "question", WEIGHTS)
    return c.select("question_id", "intent", "confidence", "gap", "too_vague", F.array_join("matched_terms", "|").alias("matched_terms"))


LEADS = ("Compare and contrast the trend: ", "List examples of ", "Why, and in what context: ", "How do winners think about ", "Overall narrative: ", "", "Search: ")


def _subtyped(spark, sf):
    """Cues are prefixed to most questions, as the invented prose holds few."""
    lead = F.element_at(F.array(*map(F.lit, LEADS)), (F.col("question_id") % len(LEADS) + 1).cast("int"))
    return I.subtype(_questions(spark, sf).withColumn("led", F.concat(lead, "question")), "led")


def subtype(spark, sf):
    s = _subtyped(spark, sf)
    return s.select("question_id", F.coalesce("subtype", F.lit("none")).alias("subtype"), F.round(F.coalesce("subtype_confidence", F.lit(0.0)), 6).alias("confidence"), F.coalesce(F.array_join("subtype_cues", "|"), F.lit("")).alias("cues"))


def route_config(spark, sf):
    r = I.route(I.classify(_subtyped(spark, sf), "question", WEIGHTS))
    return r.select("question_id", "intent", "top_k", "score_threshold", "low_confidence", I.template_name(F.col("intent"), F.col("subtype"), F.col("question")).alias("template"))


def question_top_k(spark, sf):
    return _questions(spark, sf).select("question_id", adaptive_k(F.col("question"), ("that", "und"), ("la", "die")).alias("k"))


QUERIES = {f.__name__: f for f in (question_validate, question_vague, intent_scores, intent_winner, subtype, route_config, question_top_k)}

_TOK = r"regexp_split_to_array(lower(question), '[^\p{L}\p{N}_]+')"
_Q = "with q as (select conv_id * 1000 + turn as question_id, text as question from conversations)"


def _score(kinds) -> str:
    terms = [f"case when list_contains({_TOK}, '{t}') then {w} else 0 end" for t, w in kinds["keyword"].items() if " " not in t]
    terms += [f"case when contains(lower(question), '{t}') then {w} else 0 end" for t, w in kinds["phrase"].items()]
    return "round((" + " + ".join(terms) + ")::double, 6)"


def _hit_terms(kinds) -> str:
    terms = [f"case when list_contains({_TOK}, '{t}') then '{t}' end" for t in kinds["keyword"] if " " not in t]
    terms += [f"case when contains(lower(question), '{t}') then '{t}' end" for t in kinds["phrase"]]
    return "array_to_string(list_filter([" + ", ".join(terms) + "], lambda x: x is not null), '|')"


_VAGUE = r"(contains(lower(question), 'of the') or contains(lower(question), 'de la') or len(list_filter(regexp_split_to_array(lower(question), '\s+'), lambda w: w <> '')) < 3 or not regexp_matches(question, '\p{L}'))"
_WIN = (
    _Q
    + ", s as (select question_id, question, "
    + ", ".join(f"{_score(k)} as {i}, {_hit_terms(k)} as {i}_terms" for i, k in WEIGHTS.items())
    + """ from q),
r as (select *, greatest(factual, thematic, generative) as s1, (factual > 0)::int + (thematic > 0)::int + (generative > 0)::int as k,
      list_sort([factual, thematic, generative])[2] as s2 from s),
g as (select *, case when k > 1 then round(s1 - s2, 6) end as gap from r),
w as (select *, case when k = 0 then 'factual' when k > 1 and gap <= 0.3::double then case when generative > 0 then 'generative' when thematic > 0 then 'thematic' else 'factual' end
                when factual = s1 then 'factual' when generative = s1 then 'generative' else 'thematic' end as intent,
      case when k < 2 or gap > 0.5::double then 0 when gap > 0.2::double then 0.2 when gap > 0.1::double then 0.5 else 0.8 end::double as penalty,
      (case when factual > 0 then 0.9 else 0 end + case when thematic > 0 then 0.6 else 0 end + case when generative > 0 then 0.8 else 0 end)::double as possible from g),
c as (select *, round(case when k = 0 then 0.1::double else least(1, greatest(0.1::double, s1 / possible * (1 - penalty))) end, 6) as confidence from w)"""
)
LEAD_CASES = " ".join(f"when {i} then '{x}'" for i, x in enumerate(LEADS))


def _subtype_sql() -> str:
    """question_id, best subtype, its score and cues, from q."""
    has = lambda w: f"contains(low, '{w}')"
    strong = " or ".join(map(has, I.STRONG))
    frame = f"regexp_matches(low, '({'|'.join(I.SUBJECTS)}) ({'|'.join(I.VERBS)})')"
    rows = []
    for i, (name, cues) in enumerate(I.SUBTYPE_CUES.items()):
        found = "list_filter([" + ", ".join(f"case when {has(c)} then '{c}' end" for c in cues) + "], lambda x: x is not null)"
        extra, more = (f"case when {frame} then 0.3 else 0 end", f"case when {frame} then ['synthesis_frame_match'] else [] end") if name == "synthesis" else ("0", "[]")
        rows.append(f"select question_id, {i} as ord, '{name}' as name, {found} as cues, {extra} as frame, {more} as framed, case when {strong} then 0.3 else 0 end as strong from l")
    return f"""l as (select question_id, lower((case question_id % {len(LEADS)} {LEAD_CASES} end) || question) as low from q), p as ({" union all ".join(rows)}),
b as (select question_id, ord, name, list_concat(cues, framed) as cues, (len(cues) * 0.3 + case when len(cues) > 1 then 0.2 else 0 end + strong + frame)::double as score from p),
k as (select question_id, case when score > 0 then name else 'none' end as subtype, round(least(1, score), 6)::double as confidence, case when score > 0 then array_to_string(cues, '|') else '' end as cues
      from b qualify row_number() over (partition by question_id order by round(score, 6) desc, ord) = 1)"""


SQL = {
    "question_validate": r"select case question_id % 7 when 0 then 'blank' when 1 then 'specials' when 2 then 'digits' when 3 then 'short' else case when length(question) > 500 then 'long' else 'ok' end end as fault, count(*) as n from (select conv_id * 1000 + turn as question_id, text as question from conversations) group by 1",
    "question_vague": _Q + f" select question_id, {_VAGUE} as vague from q",
    "intent_scores": _Q + " select question_id, " + ", ".join(f"{_score(k)} as {i}" for i, k in WEIGHTS.items()) + " from q",
    "intent_winner": _WIN + f" select question_id, intent, confidence, gap, k = 0 and {_VAGUE} as too_vague, case when k = 0 then '' when intent = 'factual' then factual_terms when intent = 'thematic' then thematic_terms else generative_terms end as matched_terms from c",
    "subtype": _Q + f", {_subtype_sql()} select * from k",
    "route_config": _WIN + f", {_subtype_sql()}" + " select question_id, intent, case intent when 'factual' then 5 when 'thematic' then 15 else 10 end as top_k, case intent when 'factual' then 0.25 else 0.2 end::double as score_threshold, c.confidence < 0.5::double as low_confidence, case intent when 'factual' then 'qa_factual' when 'thematic' then case subtype when 'enumerative' then 'thematic_enumerative' when 'analytical' then 'thematic_comparative' when 'exploratory' then 'thematic_contextual' else 'thematic_synthesis_clean' end else case when contains(lower(question), 'email') or contains(lower(question), 'accept') then 'generative_email' when contains(lower(question), 'speech') or contains(lower(question), 'inspirational') then 'generative_speech' when contains(lower(question), 'reflection') or contains(lower(question), 'personal') then 'generative_reflection' else 'generative_email' end end as template from c join k using (question_id)",
    "question_top_k": _Q + " select question_id, case when regexp_matches(lower(question), 'that|und') then 15 when regexp_matches(lower(question), 'la|die') then 10 else 5 end as k from q",
}
