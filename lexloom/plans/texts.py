"""Text, chunk, theme and quality queries over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import chunking as C
from lexloom.operators import quality as Q
from lexloom.operators import themes as H
from lexloom.session import table

STOP = ("the", "and", "der", "die", "que", "las")
THEMES = [("articles", "the"), ("articles", "der"), ("articles", "la"), ("joining", "and"), ("joining", "und"), ("joining", "et"), ("joining", "of the"), ("motion", "to"), ("motion", "zu"), ("motion", "in der")]
LEMMAS = {"den": "der", "las": "la", "los": "la", "les": "la"}
HEADER, NOT_FOUND = "The", "was"


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _themes(spark):
    return spark.createDataFrame(THEMES, "theme string, keyword string")


def _md5(expr):
    def query(spark, sf):
        return _docs(spark, sf).select("doc_id", F.md5(expr(F.col("text"))).alias("text_md5"))

    return query


text_clean = _md5(lambda c: T.clean_text(F.concat(F.lit("“ note [x y] – "), c)))
text_whitespace = _md5(lambda c: T.normalize_whitespace(F.replace(c, F.lit("."), F.lit(" .\n\n "))))
text_boilerplate = _md5(lambda c: T.drop_boilerplate(F.concat(F.lit("Prize lecture of\n"), c), (*T.BOILERPLATE, "the", "an"), "prize"))
text_ceremony = _md5(lambda c: T.cut_ceremony(c, "license", ("the", "die", "la")))
text_lecture = _md5(lambda c: T.clean_lecture(F.concat(F.lit("Prizes\n"), c), "prizes", ("the", "die")))
text_motivation = _md5(lambda c: T.clean_motivation(F.concat(F.lit('"work,A '), c)))
para_dedup = _md5(lambda c: T.distinct_paragraphs(F.concat(c, F.lit("\n"), c)))
text_key = _md5(T.folded_key)
text_content = _md5(lambda c: F.array_join(T.without_stop_words(c, STOP), " "))
text_lemmas = _md5(lambda c: F.array_join(H.lemmas(T.tokens(c), LEMMAS), " "))
focus_text = _md5(lambda c: H.focus_text(c, ["und", "that"], STOP))


def text_noise(spark, sf):
    reason = T.noise_reason(F.col("text"), HEADER, NOT_FOUND)
    return _docs(spark, sf).groupBy(F.coalesce(reason, F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def text_gender(spark, sf):
    g = T.gender_from_pronouns(F.col("text"), ("he", "his", "der"), ("she", "her", "la"))
    return _docs(spark, sf).select("doc_id", F.coalesce(g, F.lit("none")).alias("gender"))


def text_counts(spark, sf):
    return _docs(spark, sf).select("doc_id", F.size(T.words(F.col("text"))).alias("n_words"), F.length("text").alias("n_chars"))


def text_dates(spark, sf):
    o = table(spark, sf, "orders")
    shown = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "d MMMM yyyy")).otherwise(F.lit("31 Nonember 1999"))
    return o.select("o_orderkey", T.parse_date(F.concat(F.lit("on "), shown)).cast("string").alias("parsed"))


def text_places(spark, sf):
    p = table(spark, sf, "part")
    place = F.concat("p_name", F.lit(", "), "p_brand", F.lit(", now "), "p_type")
    return p.select("p_partkey", T.country_from_place(place).alias("country"), T.last_name(F.col("p_name")).alias("last_name"))


def chunk_fixed(spark, sf):
    c = C.split_fixed(_docs(spark, sf).select("doc_id", "source", "text"), "text", 100)
    return c.select(C.chunk_id(F.col("doc_id"), F.col("source"), F.col("chunk_index")).alias("chunk_id"), F.md5("chunk").alias("chunk_md5"))


def chunk_greedy(spark, sf):
    c = C.chunk(_docs(spark, sf).select("doc_id", "text"), "text", 120, 0, "\n")
    return c.select("doc_id", "chunk_index", F.size(T.words(F.col("chunk"))).alias("n_words"), F.md5("chunk").alias("chunk_md5"))


def chunk_overlapping(spark, sf):
    c = C.chunk(_docs(spark, sf).select("doc_id", "text"), "text", 120, 20, "\n")
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.max(F.size(T.words(F.col("chunk")))).alias("longest"))


def chunk_greedy_tokens(spark, sf):
    """Chunks hold every word once, in order: their join is the text's words."""
    c = C.chunk(_docs(spark, sf).select("doc_id", "text"), "text", 120, 0, "\n")
    whole = c.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk"))).alias("x"))
    return whole.select("doc_id", F.md5(F.array_join(F.transform("x", lambda x: x["chunk"]), " ")).alias("words_md5"))


def _year(key):
    return (F.lit(1901) + F.col(key) % 100).cast("int")


def corpus_build(spark, sf):
    """Entities of a hundred years with their own texts and the longest document of their year as its ceremony."""
    e = table(spark, sf, "customer").select(F.col("c_name").alias("full_name"), _year("c_custkey").alias("year_awarded"), F.col("c_mktsegment").alias("motivation"), F.concat_ws(" ", "c_name", "c_mktsegment", F.col("c_custkey")).alias("life"))
    docs = _docs(spark, sf)
    own = docs.select(_year("doc_id").alias("year_awarded"), F.concat(F.lit("customer#"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("lastname"), F.lit("lecture").alias("source_type"), "text")
    # the longest texts are found by length and id, so that no task sorts texts
    longest = docs.groupBy(_year("doc_id").alias("year_awarded")).agg(F.max(F.struct(F.length("text").alias("n"), (-F.col("doc_id")).alias("neg"))).alias("x"))
    shared = longest.select("year_awarded", (-F.col("x.neg")).alias("doc_id")).join(docs.select("doc_id", "text"), "doc_id").dropDuplicates(["year_awarded"]).select("year_awarded", F.lit("ceremony").alias("source_type"), "text")
    built = C.build_corpus(e, own, shared, {"motivation": False, "life": True}, 200, 0, "\n")
    return C.corpus_counts(built)


def chunk_sizes(spark, sf):
    return Q.chunk_size_audit(_docs(spark, sf), "text")


def chunk_audit(spark, sf):
    return Q.chunk_audit(_docs(spark, sf).withColumn("kind", F.when(F.col("doc_id") % 9 > 0, F.col("source"))), "text", "kind")


def corpus_summary(spark, sf):
    t = lambda n: table(spark, sf, n)
    return Q.corpus_summary({"documents": (t("documents"), F.count(F.lit(1))), "words": (t("documents"), F.sum(F.size(T.words(F.col("text"))))), "vectors": (t("embeddings"), F.count("embedding")), "dim": (t("embeddings"), F.max(F.size("embedding"))), "labels": (t("labels"), F.count(F.lit(1)))})


def missing_fields(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")).alias("c_name"), F.when(F.col("c_custkey") % 4 == 1, F.lit("")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), "c_nationkey")
    return Q.missing_fields(c, "c_custkey", ["c_name", "c_mktsegment", "c_nationkey"]).select("c_custkey", F.array_join("missing", ",").alias("missing"))


def theme_extract(spark, sf):
    return H.extract_themes(_docs(spark, sf), "doc_id", "text", _themes(spark), LEMMAS).select("doc_id", F.array_join("themes", ",").alias("themes"))


def keyword_expand(spark, sf):
    return H.expand_keywords(_docs(spark, sf), "doc_id", "text", _themes(spark)).select("doc_id", F.array_join("keywords", ",").alias("keywords"))


def expansion_debug(spark, sf):
    return H.expansion_debug(_docs(spark, sf), "doc_id", "text", _themes(spark), STOP)


_NAMES = (
    "text_clean", "text_whitespace", "text_boilerplate", "text_ceremony", "text_lecture", "text_motivation", "para_dedup", "text_key", "text_content", "text_lemmas", "focus_text", "text_noise", "text_gender", "text_counts",
    "text_dates", "text_places", "chunk_fixed", "chunk_greedy", "chunk_overlapping", "chunk_greedy_tokens", "corpus_build", "chunk_sizes", "chunk_audit", "corpus_summary", "missing_fields", "theme_extract", "keyword_expand", "expansion_debug",
)
QUERIES = {n: globals()[n] for n in _NAMES}


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _chain(x: str, *steps: tuple[str, str]) -> str:
    for pattern, to in steps:
        x = f"regexp_replace({x}, '{pattern}', {to}, 'g')"
    return x


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _prefix(words) -> str:
    return _q("^(" + "|".join(w.replace(".", r"\.") for w in words) + ")")


_NL = "chr(10)"
_CLEAN = _trim(
    _chain(
        "replace(translate(" + _chain(_trim("'“ note [x y] – ' || text"), (r"(?is)\*Translated.*?Source:.*", "''"), (r"\[[^\]]{0,80}\]", "''")) + f", '“”‘’–—' || chr(160), {_q(T.PLAIN)}), '…', '...')",
        (r"[ \t]+", "' '"), (r"\n{3,}", f"{_NL} || {_NL}"), (r" +\n", _NL), (r"\n +", _NL),
    )
)
_WHITE = _trim(_chain(f"replace(text, '.', ' .' || {_NL} || {_NL} || ' ')", (r"[ \t]+", "' '"), (r"\n{2,}", f"{_NL} || {_NL}"), (r" *\n *", _NL), (r" ([,.:;])", r"'\1'")))
_LINES = f"string_split(text, {_NL})"
_JOIN = "coalesce(array_to_string({}, chr(10)), '')"
_TOK = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda w: w <> '')"
_WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"
_STOPS = "[" + ", ".join(map(_q, STOP)) + "]"


def _sql_md5(expr: str) -> str:
    return f"select doc_id, md5({expr}) as text_md5 from documents"


_BOIL = "list_filter(list_transform(" + _LINES + ", lambda x: " + _trim("x") + "), lambda x: x <> '' and not regexp_matches(lower(x), " + _prefix((*T.BOILERPLATE, "the", "an")) + "))"
_CUT = f"(case when list_position(list_transform({_LINES}, lambda x: contains(lower(x), 'license')), true) > 0 then list_slice({_LINES}, 1, list_position(list_transform({_LINES}, lambda x: contains(lower(x), 'license')), true) - 1) else {_LINES} end)"
_THEME_VALUES = ", ".join(f"({_q(t)}, {_q(k)})" for t, k in THEMES)
_LEMMA_CASE = "case w " + " ".join(f"when {_q(k)} then {_q(v)}" for k, v in LEMMAS.items()) + " else w end"


def _hits_sql(lemma: bool) -> str:
    union = f" union select distinct doc_id, {_LEMMA_CASE} as w from t" if lemma else ""
    return f"""with th(theme, keyword) as (values {_THEME_VALUES}),
t as (select doc_id, unnest({_TOK}) as w from documents),
u as (select distinct doc_id, w from t{union}),
h as (select distinct doc_id, theme from u join th on u.w = th.keyword where not contains(keyword, ' ')
      union select doc_id, theme from documents, th where contains(keyword, ' ') and contains(lower(text), keyword))"""


#: Paragraphs p (doc_id, k, w) and their chunk f (doc_id, k, chunk c, words n of the chunk so far).
_GREEDY = """with recursive p as (
  select doc_id, row_number() over (partition by doc_id order by l, i) as k, list_slice(w, i * {most} + 1, i * {most} + {most}) as w
  from (select doc_id, l, w, unnest(range((len(w) - 1) // {most} + 1)) as i from (
    select doc_id, l, list_filter(regexp_split_to_array(line, '\\s+'), lambda x: x <> '') as w
    from (select doc_id, unnest({lines}) as line, generate_subscripts({lines}, 1) as l from documents)) where len(w) > 0)),
f as (
  select doc_id, k, 0 as c, len(w) as n from p where k = 1
  union all
  select p.doc_id, p.k, case when f.n + len(p.w) <= {most} then f.c else f.c + 1 end,
         case when f.n + len(p.w) <= {most} then f.n + len(p.w) when least({overlap}, f.n) + len(p.w) <= {most} then least({overlap}, f.n) + len(p.w) else len(p.w) end
  from f join p on p.doc_id = f.doc_id and p.k = f.k + 1)"""
_GREEDY_WORDS = f"select doc_id, md5(array_to_string({_WORDS}, ' ')) as words_md5 from documents where len({_WORDS}) > 0"
SQL = {
    "text_clean": _sql_md5(_CLEAN),
    "text_whitespace": _sql_md5(_WHITE),
    "text_boilerplate": _sql_md5(_JOIN.format(_BOIL)),
    "text_ceremony": _sql_md5(_JOIN.format(f"list_filter({_CUT}, lambda x: not regexp_matches(lower({_trim('x')}), '^(the|die|la)'))")),
    "text_lecture": _sql_md5(_JOIN.format(f"list_filter({_LINES}, lambda x: not regexp_matches(lower({_trim('x')}), '^(the|die)'))")),
    "text_motivation": _sql_md5(_trim(_chain("'\"work,A ' || text", ('["“”]', "''"), (",([A-Z])", r"', \1'")))),
    "para_dedup": "select doc_id, md5(coalesce(string_agg(x, chr(10) order by i), '')) as text_md5 from documents left join (select doc_id, x, min(i) as i from (select doc_id, unnest(list_transform(" + _LINES + ", lambda x: " + _trim("x") + ")) as x, generate_subscripts(" + _LINES + ", 1) as i from documents) where x <> '' group by 1, 2) using (doc_id) group by doc_id",
    "text_key": _sql_md5("regexp_replace(lower(strip_accents(text)), '[^a-z0-9]', '', 'g')"),
    "text_content": _sql_md5(f"coalesce(array_to_string(list_filter({_TOK}, lambda w: length(w) >= 3 and not list_contains({_STOPS}, w)), ' '), '')"),
    "text_lemmas": _sql_md5(f"coalesce(array_to_string(list_transform({_TOK}, lambda w: {_LEMMA_CASE}), ' '), '')"),
    "focus_text": _sql_md5(f"coalesce(nullif(array_to_string(list_filter({_TOK}, lambda w: w in ('und', 'that')), ' '), ''), nullif(array_to_string(list_filter({_TOK}, lambda w: length(w) >= 3 and not list_contains({_STOPS}, w)), ' '), ''), text)"),
    "text_noise": f"select case when x = '' then 'empty' when contains(x, '{HEADER}') and contains(x, '{NOT_FOUND}') then 'not_found' when x = '{HEADER}' then 'header_only' else 'ok' end as reason, count(*) as n from (select {_trim('text')} as x from documents) group by 1",
    "text_gender": f"select doc_id, case when list_has_any({_TOK}, ['he', 'his', 'der']) then 'Male' when list_has_any({_TOK}, ['she', 'her', 'la']) then 'Female' else 'none' end as gender from documents",
    "text_counts": f"select doc_id, len({_WORDS})::int as n_words, length(text)::int as n_chars from documents",
    "text_dates": "select o_orderkey, case when o_orderkey % 3 < 2 then o_orderdate::date::varchar end as parsed from orders",
    "text_places": "select p_partkey, 'now ' || p_type as country, string_split(p_name, ' ')[-1] as last_name from part",
    "chunk_fixed": f"select doc_id || '_' || source || '_' || i as chunk_id, md5(array_to_string(list_slice(w, i * 100 + 1, i * 100 + 100), ' ')) as chunk_md5 from (select doc_id, source, w, unnest(range((len(w) - 1) // 100 + 1)) as i from (select doc_id, source, {_WORDS} as w from documents) where len(w) > 0)",
    "chunk_greedy": _GREEDY.format(most=120, overlap=0, lines=_LINES) + """
select doc_id, c::int as chunk_index, sum(len(w))::int as n_words, md5(string_agg(array_to_string(w, ' '), ' ' order by k)) as chunk_md5
from f join p using (doc_id, k) group by 1, 2""",
    "chunk_overlapping": _GREEDY.format(most=120, overlap=20, lines=_LINES) + " select doc_id, max(c) + 1 as chunks, max(n)::int as longest from f group by 1",
    "corpus_build": _GREEDY.format(most=200, overlap=0, lines=_LINES) + """,
n as (select doc_id, max(c) + 1 as chunks from f group by 1),
l as (select doc_id % 100 as y, doc_id from documents qualify row_number() over (partition by doc_id % 100 order by length(text) desc nulls last, doc_id) = 1),
a as (select c_custkey, 'motivation' as source_type, 1 as chunks from customer union all select c_custkey, 'life', 1 from customer
      union all select c_custkey, 'lecture', chunks from customer join n on doc_id = c_custkey
      union all select c_custkey, 'ceremony', chunks from customer join l on y = c_custkey % 100 join n using (doc_id))
select source_type, sum(chunks)::bigint as chunks, sum(chunks)::bigint as ids, count(*) as entities from a group by 1""",
    "chunk_greedy_tokens": _GREEDY_WORDS,
    "chunk_sizes": f"select count(*) as chunks, min(w)::int as min_words, max(w)::int as max_words, round(avg(w), 4) as avg_words, min(c)::int as min_chars, max(c)::int as max_chars, round(avg(c), 4) as avg_chars, count(*) filter (w > 256) as over_256, count(*) filter (w > 384) as over_384, count(*) filter (w > 512) as over_512 from (select len({_WORDS}) as w, length(text) as c from documents)",
    "chunk_audit": f"select case when doc_id % 9 > 0 then source else 'unknown' end as type, count(*) as chunks, count(*) filter (len({_WORDS}) > 512) as too_long, count(*) filter (len({_WORDS}) < 10) as too_short from documents group by 1",
    "corpus_summary": f"select 'documents' as name, count(*) as n from documents union all select 'words', sum(len({_WORDS}))::bigint from documents union all select 'vectors', count(embedding) from embeddings union all select 'dim', max(len(embedding)) from embeddings union all select 'labels', count(*) from labels",
    "missing_fields": "select c_custkey, case when c_custkey % 3 = 0 then case when c_custkey % 4 = 1 then 'c_name,c_mktsegment' else 'c_name' end else 'c_mktsegment' end as missing from customer where c_custkey % 3 = 0 or c_custkey % 4 = 1",
    "theme_extract": _hits_sql(True) + " select doc_id, string_agg(theme, ',' order by theme) as themes from h group by 1",
    "keyword_expand": _hits_sql(False) + " select doc_id, string_agg(distinct keyword, ',' order by keyword) as keywords from h join th using (theme) group by 1",
    "expansion_debug": _hits_sql(False) + f", k as (select doc_id, count(distinct keyword) as n_keywords, count(distinct theme) as n_themes from h join th using (theme) group by 1) select doc_id, len({_TOK})::int as n_tokens, len(list_filter({_TOK}, lambda w: length(w) >= 3 and not list_contains({_STOPS}, w)))::int as n_content, coalesce(n_keywords, 0)::int as n_keywords, coalesce(n_themes, 0)::int as n_themes from documents left join k using (doc_id)",
}
