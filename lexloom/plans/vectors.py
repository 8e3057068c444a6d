"""Retrieval queries over the table of vectors: queries are the rows whose id is divisible by 50."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions.vectors import embed_table, embedding_counts, l2_normalize, norm, uuid5, vector_fault
from lexloom.operators import retrieval as R
from lexloom.operators.pruning import index_corpus, top_k_pruned
from lexloom.session import register_sql, table

DIM = 64


def _corpus(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"), "label")


def _queries(spark, sf):
    return _corpus(spark, sf).where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "vec")


def _terms(spark, sf):
    """Each query vector is a term of one of two questions, with a weight."""
    return _queries(spark, sf).select(
        (F.col("query_id") % 100).alias("query_id"),
        F.col("query_id").alias("term_id"),
        F.col("query_id").alias("term_rank"),
        ((F.col("query_id") % 7).cast("double") / 10).alias("weight"),
        F.concat(F.lit("t"), F.col("query_id").cast("string")).alias("term"),
        "vec",
    )


def vector_topk(spark, sf):
    return R.top_k(_queries(spark, sf), _corpus(spark, sf), 5)


def vector_topk_filtered(spark, sf):
    return R.top_k(_queries(spark, sf), _corpus(spark, sf), 5, {"label": 3})


def vector_topk_pruned(spark, sf):
    return top_k_pruned(_queries(spark, sf), index_corpus(_corpus(spark, sf)), 5)[0]


def vector_topk_scoped(spark, sf):
    """Each query has its own labels: two, one, none that exists, or all rows."""
    n = F.col("query_id") / 50 % 4
    scope = F.when(n == 0, F.array((F.col("query_id") % 7).cast("string"), F.lit("9"))).when(n == 1, F.array((F.col("query_id") % 10).cast("string"))).when(n == 2, F.array(F.lit("none")))
    return R.top_k(_queries(spark, sf).withColumn("label", scope), _corpus(spark, sf), 5, scope="label")


def vector_topk_fallback(spark, sf):
    return R.retrieve(_queries(spark, sf), _corpus(spark, sf), 15, None, 0.35, 3, 12)


def vector_topk_metadata(spark, sf):
    found = R.top_k(_queries(spark, sf), _corpus(spark, sf), 10).drop("rank")
    named = found.join(_corpus(spark, sf).select("chunk_id", "label"), "chunk_id")
    return R.ranked(named, ["query_id"], R.prefer("label", 0), "chunk_id").select("query_id", "chunk_id", "label", "score", "rank")


def vector_adaptive_k(spark, sf):
    asked = _queries(spark, sf).withColumn("k", F.when(F.col("query_id") % 3 == 0, 15).when(F.col("query_id") % 3 == 1, 10).otherwise(5))
    return R.top_k(asked, _corpus(spark, sf))


def term_weighted_retrieval(spark, sf):
    return R.retrieve_terms(_terms(spark, sf), _corpus(spark, sf), 15, 0.5, 5, 12, True, "label", 0)


def term_union_retrieval(spark, sf):
    return R.retrieve_terms(_terms(spark, sf), _corpus(spark, sf), 10, 0.35, 3, 10, False, "label", 0)


def retrieval_report(spark, sf):
    found = R.top_k(_queries(spark, sf), _corpus(spark, sf), 5)
    grouped = found.groupBy((F.col("query_id") % 100).alias("question"))
    return grouped.agg(F.count(F.lit(1)).alias("n_found"), F.count_distinct("chunk_id").alias("n_unique"), F.max("score").alias("best_score"))


def ranked_expansion(spark, sf):
    return R.expand_ranked(_queries(spark, sf), _corpus(spark, sf), 0.3, 20)


def score_stats(spark, sf):
    return R.score_stats(R.top_k(_queries(spark, sf), _corpus(spark, sf), 15))


def reason_counts(spark, sf):
    return vector_topk_fallback(spark, sf).groupBy("filtering_reason").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("query_id").alias("n_queries"))


def vector_norms(spark, sf):
    n = table(spark, sf, "embeddings").select("label", norm("embedding").alias("n"))
    r = lambda c: F.round(c, 6)
    return n.groupBy("label").agg(F.count("n").alias("vectors"), r(F.avg("n")).alias("mean_norm"), r(F.stddev_pop("n")).alias("std_norm"), r(F.min("n")).alias("min_norm"), r(F.max("n")).alias("max_norm"), F.count_if(F.col("n") <= 1e-8).alias("zero_vectors"))


def vector_normalized(spark, sf):
    longer = F.transform("embedding", lambda x, i: (x * (i + 1)).cast("float"))
    v = table(spark, sf, "embeddings").select("vec_id", l2_normalize(longer).alias("v"))
    return v.select("vec_id", F.round(norm("v"), 4).alias("unit_norm"), F.size("v").alias("dim"), F.round(F.get("v", 0).cast("double"), 5).alias("first"), F.round(F.get("v", 63).cast("double"), 5).alias("last"))


def vector_quality(spark, sf):
    fault = F.coalesce(vector_fault("embedding", DIM), F.lit("ok"))
    return table(spark, sf, "embeddings").groupBy(fault.alias("fault")).agg(F.count(F.lit(1)).alias("n"))


def vector_publish_ids(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", uuid5(F.concat(F.lit("chunk_"), F.col("vec_id").cast("string"))).alias("point_id"), "label")


def expansion_map(spark, sf):
    m = R.similarity_map(ranked_expansion(spark, sf))
    return m.select("query_id", F.array_join(F.transform(F.array_sort(F.map_keys("similarities")), lambda k: F.concat(k, F.lit("="), F.format_string("%.4f", F.element_at("similarities", k)))), "|").alias("terms"))


def expansion_intersection(spark, sf):
    scored = R.expand_ranked(_queries(spark, sf), _corpus(spark, sf), 0.3, 20).where("term_id is not null")
    same_label = _corpus(spark, sf).select(F.col("chunk_id").alias("term_id"), "label").where("label < 5")
    expanded = scored.select("query_id", "term_id").join(same_label, "term_id").select("query_id", "term_id")
    return R.ranked_intersection(expanded, scored, 10)


def text_vectors(spark, sf):
    """Every document embedded: its strongest slot and that slot's weight."""
    e = embed_table(table(spark, sf, "documents").select("doc_id", "text"), "text").where(F.col("embedding").isNotNull())
    most = F.array_max("embedding")
    return e.select("doc_id", F.array_position("embedding", most).cast("int").alias("slot"), F.round(most.cast("double"), 5).alias("weight"))


def text_retrieval(spark, sf):
    """Questions given as text (names of nations and regions) against the documents, embedded alike."""
    names = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), F.col("n_name").alias("question"))
    regions = table(spark, sf, "region").select((F.col("r_regionkey") + 1000).cast("long").alias("query_id"), F.col("r_name").alias("question"))
    corpus = embed_table(table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), "text").select("chunk_id", F.col("embedding").alias("vec"))
    return R.retrieve_texts(names.unionByName(regions), corpus, k=15, threshold=0.35, min_return=3, max_return=12)


def text_vector_counts(spark, sf):
    """Rows and failures of the embedding, by language; texts without a word fail."""
    docs = table(spark, sf, "documents").select("lang", F.when(F.col("doc_id") % 9 > 0, F.col("text")).otherwise("?!").alias("text"))
    return embedding_counts(embed_table(docs, "text"), "lang")


def sql_functions(spark, sf):
    register_sql(spark)
    table(spark, sf, "embeddings").createOrReplaceTempView("lex_embeddings")
    table(spark, sf, "documents").createOrReplaceTempView("lex_documents")
    return spark.sql("SELECT doc_id, round(lex_dot(embedding, reverse(embedding)), 4) AS crossed, round(lex_norm(slice(embedding, 1, 9)), 4) AS norm, lex_words(text) AS n_words, md5(lex_squeeze(text)) AS squeezed_md5 FROM lex_documents LEFT JOIN lex_embeddings ON doc_id = vec_id")


def sql_chunks(spark, sf):
    """chunk_greedy in SQL alone: a table function by a LATERAL join."""
    register_sql(spark)
    table(spark, sf, "documents").createOrReplaceTempView("lex_documents")
    return spark.sql(r"SELECT doc_id, chunk_index, lex_words(chunk) AS n_words, md5(chunk) AS chunk_md5 FROM lex_documents, LATERAL lex_chunk(text, 120, 0, r'\n')")


#: Hashed embedding of a column text: list of 64 floats, null without a word.
EMBEDDED_SQL = r"""(with w as (select list_transform(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+'), lambda w: w <> ''), lambda w: ('0x' || md5(w)[1:6])::int % 64) as slots),
 c as (select list_transform(range(64), lambda i: len(list_filter(slots, lambda s: s = i))::float) as v from w), n as (select v, sqrt(list_sum(list_transform(v, lambda x: x::double * x::double))) as s from c)
 select case when s > 0 then list_transform(v, lambda x: (x::double / s)::float) end from n)"""

_SCORES = """
with q as (select vec_id as query_id, embedding::double[] as v from embeddings where vec_id % 50 = 0),
s as (select q.query_id, e.vec_id as chunk_id, e.label, round(list_dot_product(q.v, e.embedding::double[]), 6) as score
      from q, embeddings e),
r as (select *, row_number() over (partition by query_id order by score desc, chunk_id) - 1 as rank from s)"""

_TEXT_SCORES = f"""
with t0 as (select n_nationkey::bigint as id, n_name as text from nation union all select r_regionkey + 1000, r_name from region),
q as (select id as query_id, {EMBEDDED_SQL}::double[] as v from t0), e as (select doc_id as chunk_id, {EMBEDDED_SQL}::double[] as v from documents),
s as (select query_id, chunk_id, round(list_dot_product(q.v, e.v), 6) as score from q, e where q.v is not null and e.v is not null),
r as (select *, row_number() over (partition by query_id order by score desc, chunk_id) - 1 as rank from s)"""

_FALLBACK = (
    _SCORES
    + """,
t as (select query_id, chunk_id, score, rank, count(*) filter (score >= 0.35::double) over (partition by query_id) >= 3 as enough from r where rank < 15),
f as (select query_id, chunk_id, score, rank, case when enough then 'threshold' else 'min_return_fallback' end as filtering_reason
      from t where case when enough then score >= 0.35::double else rank < 3 end and rank < 12)"""
)


def _terms_sql(boost: str, k: int, threshold: float, least: int, most: int) -> str:
    return f"""{_SCORES},
b as (select query_id % 100 as query_id, query_id as term_id, chunk_id, label, round({boost}, 6) as boost_factor, round(score * {boost}, 6) as score
      from r where rank < {k}),
d as (select * from b qualify row_number() over (partition by query_id, chunk_id order by score desc, term_id) = 1),
n as (select *, row_number() over (partition by query_id order by score desc, chunk_id) - 1 as rn,
             count(*) filter (score >= {threshold}::double) over (partition by query_id) >= {least} as enough from d)
select query_id, chunk_id, term_id, boost_factor, score,
       row_number() over (partition by query_id order by score desc, case when label = 0 then 1 else 0 end, chunk_id) - 1 as rank,
       case when enough then 'threshold' else 'min_return_fallback' end as filtering_reason
from n where case when enough then score >= {threshold}::double else rn < {least} end and rn < {most}"""


QUERIES = {f.__name__: f for f in (vector_topk, vector_topk_filtered, vector_topk_scoped, vector_topk_pruned, vector_topk_fallback, vector_topk_metadata, vector_adaptive_k, term_weighted_retrieval, term_union_retrieval, retrieval_report, ranked_expansion, expansion_map, expansion_intersection, text_vectors, text_retrieval, text_vector_counts, sql_functions, sql_chunks, score_stats, reason_counts, vector_norms, vector_normalized, vector_quality, vector_publish_ids)}

_NORM = "sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)))"
from .texts import SQL as _TEXTS  # noqa: E402

SQL = {
    "sql_chunks": _TEXTS["chunk_greedy"],
    "vector_topk": _SCORES + " select query_id, chunk_id, score, rank from r where rank < 5",
    "vector_topk_pruned": _SCORES + " select query_id, chunk_id, score, rank from r where rank < 5",
    "vector_topk_scoped": _SCORES.replace("from q, embeddings e", "from q, embeddings e where case query_id // 50 % 4 when 0 then e.label in (query_id % 7, 9) when 1 then e.label = query_id % 10 when 2 then false else true end") + " select query_id, chunk_id, score, rank from r where rank < 5",
    "vector_topk_filtered": _SCORES.replace("from q, embeddings e", "from q, embeddings e where e.label = 3") + " select query_id, chunk_id, score, rank from r where rank < 5",
    "text_retrieval": _FALLBACK.replace(_SCORES, _TEXT_SCORES) + " select * from f",
    "vector_topk_fallback": _FALLBACK + " select * from f",
    "vector_topk_metadata": _SCORES + " select query_id, chunk_id, label, score, row_number() over (partition by query_id order by score desc, case when label = 0 then 1 else 0 end, chunk_id) - 1 as rank from r where rank < 10",
    "vector_adaptive_k": _SCORES + " select query_id, chunk_id, score, rank from r where rank < case query_id % 3 when 0 then 15 when 1 then 10 else 5 end",
    "term_weighted_retrieval": _terms_sql("exp(2 * ((query_id % 7)::double / 10))", 15, 0.5, 5, 12),
    "term_union_retrieval": _terms_sql("1.0::double", 10, 0.35, 3, 10).replace("where vec_id % 50 = 0", "where vec_id % 50 = 0 and length('t' || vec_id) > 2", 1),
    "retrieval_report": _SCORES + " select query_id % 100 as question, count(*) as n_found, count(distinct chunk_id) as n_unique, max(score) as best_score from r where rank < 5 group by 1",
    "ranked_expansion": _SCORES + " select q.query_id, n.chunk_id as term_id, coalesce(n.score, 1.0::double) as similarity from q left join (select * from r where rank < 20 and score >= 0.3::double) n on n.query_id = q.query_id",
    "expansion_map": _SCORES + " select query_id, string_agg(chunk_id::varchar || '=' || printf('%.4f', round(score, 4)), '|' order by chunk_id::varchar) as terms from r where rank < 20 and score >= 0.3::double group by 1",
    "expansion_intersection": _SCORES + ", x as (select * from r where rank < 20 and score >= 0.3::double and label < 5) select query_id, chunk_id as term_id, score as similarity, row_number() over (partition by query_id order by score desc, chunk_id) - 1 as rank from x qualify row_number() over (partition by query_id order by score desc, chunk_id) <= 10",
    "sql_functions": r"""select doc_id, round(list_dot_product(embedding::double[], list_reverse(embedding::double[])), 4) as crossed, round(sqrt(list_sum(list_transform(embedding[1:9], lambda x: x::double * x::double))), 4) as norm,
 len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> ''))::int as n_words, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) as squeezed_md5 from documents left join embeddings on doc_id = vec_id""",
    "text_vectors": f"with e as (select doc_id, {EMBEDDED_SQL} as v from documents) select doc_id, list_position(v, list_max(v))::int as slot, round(list_max(v)::double, 5) as weight from e where v is not null",
    "text_vector_counts": "select lang, count(*) as n, count(*) filter (not regexp_matches(coalesce(text, ''), '[\\p{L}\\p{N}_]')) as failed from (select lang, case when doc_id % 9 > 0 then text else '?!' end as text from documents) group by 1",
    "score_stats": _SCORES + " select query_id, count(*) as n, round(avg(score), 6) as mean_score, round(stddev_pop(score), 6) as std_score, min(score) as min_score, max(score) as max_score, round(median(score), 6) as median_score from r where rank < 15 group by 1",
    "reason_counts": _FALLBACK + " select filtering_reason, count(*) as n, count(distinct query_id) as n_queries from f group by 1",
    "vector_norms": f"select label, count(*) as vectors, round(avg(n), 6) as mean_norm, round(stddev_pop(n), 6) as std_norm, round(min(n), 6) as min_norm, round(max(n), 6) as max_norm, count(*) filter (n <= 1e-8) as zero_vectors from (select label, {_NORM} as n from embeddings) group by 1",
    "vector_normalized": """with l as (select vec_id, list_transform(embedding, lambda x, i: (x * i)::float) as v from embeddings), n as (select vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x::double * x::double))) as s from l),
u as (select vec_id, list_transform(v, lambda x: (x::double / s)::float) as v from n)
select vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x::double * x::double))), 4) as unit_norm, len(v)::int as dim, round(v[1]::double, 5) as first, round(v[64]::double, 5) as last from u""",
    "vector_quality": f"select case when embedding is null then 'null' when len(embedding) <> {DIM} then 'dim' when len(list_filter(embedding, lambda x: x is null or isnan(x))) > 0 then 'nan' when len(list_filter(embedding, lambda x: isinf(x))) > 0 then 'inf' when len(list_filter(embedding, lambda x: abs(x) > 1e-8)) = 0 then 'zero' else 'ok' end as fault, count(*) as n from embeddings group by 1",
    "vector_publish_ids": """select vec_id, label,
 substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as point_id
from (select vec_id, label, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || ('chunk_' || vec_id)::blob) as h from embeddings)""",
}
