"""Whole tables of questions answered at once: rules and facts, or retrieval, context and prompt."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.vectors import hashed_embedding
from lexloom.operators import facts as X
from lexloom.operators import intent as I
from lexloom.operators import prompts as P
from lexloom.operators import retrieval as R
from lexloom.operators.filters import query_fault
from lexloom.operators.themes import term_vectors
from lexloom.session import materialize, small, table
from lexloom.sources.readers import TEMPLATES, read_dimension

from .facts import _questions as facts_questions
from .facts import _spaced
from . import facts as facts_plans
from . import questions as question_plans
from .questions import WEIGHTS
from .texts import THEMES
from .vectors import EMBEDDED_SQL


def _by_terms(routed: DataFrame, corpus: DataFrame, terms: DataFrame, dim: int, last: str) -> DataFrame:
    """query_id, chunk_id, rank: each question is expanded to its nearest terms, these retrieve with their weights."""
    asked = routed.select(F.col("question_id").alias("query_id"), "vec", F.col("filter_names").alias("author"))
    near = R.expand_ranked(asked.select("query_id", "vec"), terms.select(F.col("keyword").alias("chunk_id"), F.col("embedding").alias("vec")), dim=dim)
    known = terms.select(F.col("keyword").alias("term_id"), F.col("embedding").alias("_vec"))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "term_id")
    wide = near.withColumn("term_rank", F.row_number().over(order) - 1).join(small(known), "term_id", "left").join(asked, "query_id")
    name = F.coalesce(F.concat(F.lit("term "), "term_id"), F.concat(F.lit("question "), F.col("query_id").cast("string")))
    own = wide.select("query_id", name.alias("term_id"), "term_rank", F.col("similarity").alias("weight"), F.coalesce("_vec", "vec").alias("vec"), "author")
    top, threshold, least, most = I.ROUTES["thematic"]
    return R.retrieve_terms(own, corpus, top, threshold, least, most, True, "kind", last, dim, "author").select("query_id", "chunk_id", "rank")


def answer_batch(
    questions: DataFrame, facts: DataFrame, corpus: DataFrame, templates: DataFrame, weights: dict, award: str = "prize", dim: int = 64,
    names: DataFrame | None = None, terms: DataFrame | None = None, scoped: tuple[str, ...] = tuple(I.ROUTES), last: str = "ceremony",
    form: Callable[[Column], Column] = lambda answer: answer, contexts: bool = True,
) -> DataFrame:
    """question_id, answer_type, rule, intent, template, answer for every question (question_id, question).

    answer_type: invalid (with the reason as answer), facts (answered by a rule), prompt (the filled
    template, context included, ready for a language model), with chunks, the ids of the chunks in the
    context by rank. Questions that a rule answers never reach the retrieval. corpus: chunk_id, text, vec
    (hashed_embedding of the text), author, year, kind, category; the text is joined to the chosen rows only
    after the top k. Each route has its own k, threshold, least and most rows.

    With names (full_name) a question that names some of them, of an intent in `scoped`, is answered from the
    chunks of these authors only. With terms (keyword, embedding; see term_vectors) thematic questions retrieve by
    their nearest terms, weighted and merged, chunks of kind `last` behind the others on ties; without, and for all
    other intents, by the question's own vector. A template gives how many chunks its context holds at most, and how
    they are cited. Questions, facts, questions that a rule matches, routes and chosen rows are written once, as several branches
    read them; the rules' answers, which may be long, are not.

    form: what is wanted of an answer, as its digest; answers that many questions share are brought into it once.
    Without contexts nothing is retrieved: the answer and the chunks of each prompt are null, all else is the same.
    """
    none = lambda n, kind="string": F.lit(None).cast(kind).alias(n)
    checked = materialize(questions.withColumn("_fault", query_fault(F.col("question"))))
    bad = checked.where("_fault is not null").select("question_id", F.lit("invalid").alias("answer_type"), none("rule"), none("intent"), none("template"), form(F.col("_fault")).alias("answer"), none("chunks", "array<bigint>"))
    good = checked.where("_fault is null").select("question_id", "question")
    facts = materialize(facts)  # each rule reads it
    matched = X.matched_questions(good, award)
    by_rule = X.answer_matched(matched, facts, award, form=form).select("question_id", F.lit("facts").alias("answer_type"), "rule", F.lit("factual").alias("intent"), none("template"), "answer", none("chunks", "array<bigint>"))
    rest = good.join(matched.select("question_id"), "question_id", "left_anti")
    rest = rest.join(X.scoped_entities(rest, names), "question_id", "left") if names is not None else rest.withColumn("entities", F.lit(None).cast("array<string>"))
    routed = I.route(I.classify(I.subtype(rest, "question"), "question", weights), "entities", scoped).withColumn("template", I.template_name(F.col("intent"), F.col("subtype"), F.col("question")))
    if not contexts:
        by_prompt = routed.select("question_id", F.lit("prompt").alias("answer_type"), none("rule"), "intent", "template", none("answer"), none("chunks", "array<bigint>"))
        return bad.unionByName(by_rule).unionByName(by_prompt)
    shapes = small(templates.select(F.col("name").alias("template"), F.coalesce("chunk_count", F.lit(5)).alias("_most"), F.coalesce("citation_style", F.lit("inline")).alias("_style")))
    routed = materialize(routed.withColumn("vec", hashed_embedding(F.col("question"), dim)).join(shapes, "template", "left"))
    themed = F.lit(terms is not None) & (F.col("intent") == "thematic")
    plain = routed.where(~themed).select(F.col("question_id").alias("query_id"), "vec", F.col("top_k").alias("k"), F.col("filter_names").alias("author"))
    found = R.top_k(plain, corpus, None, None, dim, "author")
    limits = routed.select(F.col("question_id").alias("query_id"), "score_threshold", "min_return", "max_return")
    picked = R.with_fallback(found.join(limits, "query_id"), F.col("score_threshold"), F.col("min_return"), F.col("max_return")).select("query_id", "chunk_id", "rank")
    if terms is not None:
        picked = picked.unionByName(_by_terms(routed.where(themed), corpus, terms, dim, last))
    fits = F.col("rank") < F.coalesce("_most", F.lit(5))
    chosen = materialize(picked.join(routed.select(F.col("question_id").alias("query_id"), "_most", "_style"), "query_id").where(fits).drop("_most"))
    by_rank = F.array_sort(F.collect_list(F.struct("rank", F.col("chunk_id").cast("long").alias("chunk_id"))))
    used = chosen.groupBy(F.col("query_id").alias("question_id")).agg(F.transform(by_rank, lambda x: x["chunk_id"]).alias("chunks"))
    lines = chosen.join(corpus.select("chunk_id", "text", "author", "year", "kind", "category"), "chunk_id").withColumnRenamed("query_id", "question_id")
    told = P.assemble_context(lines, "question_id", F.coalesce("_style", F.lit("inline")))
    prompts = P.build_prompts(routed.select("question_id", "question", "template"), told, templates)
    by_prompt = prompts.drop("template").join(routed.select("question_id", "intent", "template"), "question_id").join(used, "question_id", "left")
    by_prompt = by_prompt.select("question_id", F.lit("prompt").alias("answer_type"), none("rule"), "intent", "template", form(F.col("prompt")).alias("answer"), "chunks")
    return bad.unionByName(by_rule).unionByName(by_prompt)


def trace(answers: DataFrame, contexts: DataFrame | None = None, model: str = "none", environment: str = "batch") -> DataFrame:
    """Audit record of each answer, ready for append_audit()."""
    return answers.select(
        F.concat(F.lit("q"), F.col("question_id").cast("string")).alias("query_id"), F.current_timestamp().alias("ts"), "intent", "answer_type", F.col("template").alias("prompt_template"),
        F.when(F.col("answer_type") == "prompt", F.length("answer")).otherwise(0).alias("prompt_length"), F.when(F.col("answer_type") == "facts", F.col("answer")).alias("final_answer"),
        (F.col("answer_type") == "invalid").alias("error_occurred"), F.when(F.col("answer_type") == "invalid", F.col("answer")).alias("error_message"), F.lit(model).alias("model_id"), F.lit(environment).alias("environment"),
    )


#: Questions about one author: what stands before and behind the name (the second form gives the last name only).
ABOUT = (("How do winners think about that part of the sea in the work of ", "?"), ("What is und in the books of ", ", and why?"), ("Write la carta of ", ", please"), ("Compare that trend of the art of ", " over time"))
#: Templates whose contexts these queries cite in footnotes.
NOTED = ("thematic_comparative", "generative_email")


def _answers(spark, sf, **how):
    corpus = table(spark, sf, "documents").select(
        F.col("doc_id").alias("chunk_id"), "text", hashed_embedding(F.col("text")).alias("vec"), F.concat(F.lit("Kim "), "source").alias("author"), (F.lit(1901) + F.col("doc_id") % 100).alias("year"),
        F.when(F.col("doc_id") % 5 == 0, "ceremony").otherwise("lecture").alias("kind"), F.col("lang").alias("category"),
    )
    talk = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn") + 10_000_000).alias("question_id"), F.col("text").alias("question"))
    corpus = materialize(corpus) if how.get("contexts", True) else corpus
    names = corpus.where("author is not null").select(F.col("author").alias("full_name")).distinct()
    number = F.regexp_extract("full_name", r"(\d+)$", 1).cast("bigint")
    about = names.withColumn("n", number).select((F.col("n") + 20_000_000).alias("question_id"), "full_name", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(ABOUT)])).alias("f"))
    named = F.when(F.col("f.i") == 1, F.element_at(F.split("full_name", " "), -1)).otherwise(F.col("full_name"))
    about = about.select((F.col("question_id") + F.col("f.i") * 1000).alias("question_id"), F.concat("f.a", named, "f.b").alias("question"))
    asked = facts_questions(spark, sf).unionByName(talk).unionByName(about)
    templates = read_dimension(spark, "templates").withColumn("citation_style", F.when(F.col("name").isin(*NOTED), "footnote").otherwise(F.col("citation_style")))
    terms = term_vectors(spark.createDataFrame(THEMES, "theme string, keyword string"))
    return answer_batch(asked, _spaced(spark, sf), corpus, templates, WEIGHTS, names=names, terms=terms, **how)


def answers(spark, sf):
    a = _answers(spark, sf, form=F.md5)
    return a.select("question_id", "answer_type", "rule", "intent", "template", F.col("answer").alias("answer_md5"), F.array_join("chunks", ",").alias("chunks"))


def answer_types(spark, sf):
    a = trace(_answers(spark, sf, form=F.md5, contexts=False))  # no count of these looks at a context
    return a.groupBy("answer_type").agg(F.count(F.lit(1)).alias("n"), F.count("final_answer").alias("n_final"), F.count_if("error_occurred").alias("n_errors"))


def context_assembly(spark, sf):
    """Context of each query vector: its five nearest rows in footnote style."""
    corpus = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"), "label")
    found = R.top_k(corpus.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "vec"), corpus, 5)
    lines = found.join(corpus.select("chunk_id", "label"), "chunk_id").select("query_id", "rank", F.concat(F.lit("chunk "), F.col("chunk_id").cast("string")).alias("text"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("author"), F.when(F.col("label") > 3, 1900 + F.col("label")).alias("year"), F.when(F.col("label") % 2 == 0, "lecture").otherwise("ceremony").alias("kind"), F.lit("Literature").alias("category"))
    return P.assemble_context(lines, "query_id", "footnote")


def _answers_sql() -> str:
    """a: question_id, answer_type, rule, intent, template, answer, chunks."""
    facts = facts_plans._ANSWERS
    route, _, _ = question_plans.SQL["route_config"].removeprefix(question_plans._Q).rpartition(" select question_id, intent, case intent when")
    template = question_plans.SQL["route_config"].rpartition(" as low_confidence, ")[2].partition(" as template from")[0]
    quoted = lambda *xs: "(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in xs) + ")"
    abouts = ", ".join(quoted(i, a, b) for i, (a, b) in enumerate(ABOUT))
    shapes = ", ".join(quoted(name, most, "footnote" if name in NOTED else style) for name, _, most, style in TEMPLATES)
    keywords = ", ".join(quoted(k) for _, k in THEMES)
    blank = r"regexp_replace(question, '^\s+|\s+$', '', 'g')"
    return rf"""with fa as ({facts} select question_id, rule, answer from a),
form as ({facts} select ord as question_id, 'Please say something nice about ' || n || '.' as question from g where form = 12),
authors as (select distinct 'Kim ' || source as author, source as last from documents where source is not null),
asked as (select question_id, question from form union all select conv_id * 1000 + turn + 10000000, text from conversations
  union all select 20000000 + regexp_extract(last, '([0-9]+)$', 1)::bigint + i * 1000, a || case when i = 1 then last else author end || b from authors, (values {abouts}) t(i, a, b)),
judged as (select *, case when question is null or question = '' then 'empty' when {blank} = '' then 'blank' when length({blank}) < 2 then 'short'
  when regexp_matches({blank}, '^[^\p{{L}}\p{{N}}_\s]+$') then 'specials' when regexp_matches({blank}, '^[0-9]+$') then 'digits' when length(question) > 1000 then 'long' end as fault from asked),
q as (select question_id, question from judged where fault is null){route.replace("lower((case question_id % 7 " + question_plans.LEAD_CASES + " end) || question)", "lower(question)")},
scope as (select question_id, list(author) as names from (
  select question_id, author from q, authors where contains(lower(question), lower(author)) or (contains(lower(question), lower(last)) and contains(' ' || regexp_replace(lower(question), '[^\p{{L}}\p{{N}}_]', ' ', 'g') || ' ', ' ' || lower(last) || ' '))
  qualify row_number() over (partition by question_id order by contains(lower(question), lower(author)) desc, case when contains(lower(question), lower(author)) then length(author) else length(last) end desc, author) <= 3) group by 1),
shape(template, most_chunks, style) as (values {shapes}),
routed as (select r.*, most_chunks, style, names from (select question_id, c.question, intent, {template} as template, case intent when 'factual' then 5 when 'thematic' then 15 else 10 end as top, case intent when 'factual' then 0.25 else 0.2 end::double as least_score,
  case intent when 'thematic' then 5 else 3 end as least, case intent when 'thematic' then 12 else 10 end as most from c join k using (question_id)) r join shape using (template) left join scope using (question_id)),
docs as (select doc_id, text, 'Kim ' || source as author, lang, {EMBEDDED_SQL} as v from documents),
rv as (select *, {EMBEDDED_SQL} as v from (select *, question as text from routed)),
tv as (select keyword, {EMBEDDED_SQL} as v from (select distinct keyword, keyword as text from (values {keywords}) t(keyword))),
near as (select question_id, keyword, tv.v, round(list_dot_product(rv.v::double[], tv.v::double[]), 6) as weight from rv, tv where intent = 'thematic' and rv.v is not null and tv.v is not null and round(list_dot_product(rv.v::double[], tv.v::double[]), 6) >= 0.3
  qualify row_number() over (partition by question_id order by weight desc, keyword) <= 20),
wide as (select question_id, v, weight, row_number() over (partition by question_id order by weight desc, keyword) as term_rank from near
  union all select question_id, v, 1.0, 1 from rv where intent = 'thematic' and v is not null and question_id not in (select question_id from near)),
hit as (select question_id, doc_id, weight, term_rank, round(list_dot_product(wide.v::double[], docs.v::double[]), 6) as score from wide join routed using (question_id), docs where docs.v is not null and (names is null or list_contains(names, author))
  qualify row_number() over (partition by question_id, term_rank order by score desc, doc_id) <= 15),
merged as (select question_id, doc_id, round(score * exp(2 * weight), 6) as score from hit qualify row_number() over (partition by question_id, doc_id order by round(score * exp(2 * weight), 6) desc, term_rank) = 1),
themed as (select *, row_number() over (partition by question_id order by score desc, doc_id) - 1 as place, count(*) filter (score >= 0.2::double) over (partition by question_id) >= 5 as enough from merged),
scored as (select question_id, doc_id, least_score, least, most, round(list_dot_product(rv.v::double[], docs.v::double[]), 6) as score from rv, docs where intent <> 'thematic' and rv.v is not null and docs.v is not null and (names is null or list_contains(names, author))
  qualify row_number() over (partition by question_id order by score desc, doc_id) <= any_value(top) over (partition by question_id)),
placed as (select *, row_number() over (partition by question_id order by score desc, doc_id) - 1 as rank, count(*) filter (score >= least_score) over (partition by question_id) >= least as enough from scored),
picked as (select question_id, doc_id, rank from placed where rank < most and case when enough then score >= least_score else rank < least end
  union all select question_id, doc_id, row_number() over (partition by question_id order by score desc, doc_id % 5 = 0, doc_id) - 1 from themed where place < 12 and case when enough then score >= 0.2::double else place < 5 end),
chosen as (select question_id, doc_id, rank, style from picked join routed using (question_id) where rank < most_chunks),
line as (select *, 'Kim ' || source as author, case when doc_id % 5 = 0 then '[🏅 Ceremony' else '[🎓 Lecture' end || ' — ' || coalesce(nullif('Kim ' || source, ''), 'Unknown') || ', ' || (1901 + doc_id % 100) || '] ' || trim(coalesce(text, ''), ' ') as head from chosen join documents using (doc_id)),
told as (select question_id, string_agg(case when style = 'inline' then head || ' (' || coalesce(author, 'Unknown') || ', ' || (1901 + doc_id % 100) || ')' else head end, chr(10) || chr(10) order by rank)
  || case when any_value(style) = 'footnote' then chr(10) || chr(10) || chr(10) || '--- FOOTNOTES ---' || chr(10) || chr(10) || string_agg('[' || (rank + 1) || '] ' || coalesce(author, 'Unknown') || ', ' || coalesce(nullif(lang, ''), 'Unknown') || ' ' || (1901 + doc_id % 100), chr(10) || chr(10) order by rank) else '' end as context,
  string_agg(doc_id::varchar, ',' order by rank) as chunks from line group by 1),
a as (select question_id, 'invalid' as answer_type, null as rule, null as intent, null as template, fault as answer, null as chunks from judged where fault is not null
  union all select question_id, 'facts', rule, 'factual', null, answer, null from fa where rule <> 'none'
  union all select question_id, 'prompt', null, intent, template, 'Question: ' || question || chr(10) || chr(10) || 'Context:' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'Answer from the context and cite it.', chunks from routed left join told using (question_id))"""


QUERIES = {"answer_batch": answers, "answer_types": answer_types, "context_assembly": context_assembly}
_ANSWERS_SQL = _answers_sql()
SQL = {
    "answer_batch": _ANSWERS_SQL + " select question_id, answer_type, rule, intent, template, md5(answer) as answer_md5, chunks from a",
    "answer_types": _ANSWERS_SQL + " select answer_type, count(*) as n, count(*) filter (answer_type = 'facts') as n_final, count(*) filter (answer_type = 'invalid') as n_errors from a group by 1",
    "context_assembly": """with q as (select vec_id as query_id, embedding::double[] as v from embeddings where vec_id % 50 = 0),
s as (select q.query_id, e.vec_id as chunk_id, e.label, round(list_dot_product(q.v, e.embedding::double[]), 6) as score from q, embeddings e),
r as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rn from s qualify rn <= 5),
t as (select *, 'L' || label as a, case when label > 3 then (1900 + label)::varchar else 'Unknown' end as y, case when label % 2 = 0 then '[🎓 Lecture' else '[🏅 Ceremony' end as m from r)
select query_id, string_agg(m || ' — ' || a || ', ' || y || '] chunk ' || chunk_id, chr(10) || chr(10) order by rn) || chr(10) || chr(10) || chr(10) || '--- FOOTNOTES ---' || chr(10) || chr(10)
 || string_agg('[' || rn || '] ' || a || ', Literature ' || y, chr(10) || chr(10) order by rn) as context, count(*)::int as n_chunks from t group by 1""",
}
