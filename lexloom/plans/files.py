"""Queries that go through files and whole pages: tables written in a source's format and read back by its reader."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions import html as W
from lexloom.functions.text import BOILERPLATE, file_key
from lexloom.operators import audit as A
from lexloom.operators.themes import refresh_term_vectors
from lexloom.session import shared_folder, table
from lexloom.sources import readers, sinks

from .vectors import EMBEDDED_SQL

_SALUTATION = "ladies and gentlemen"


def article_pages(spark, sf):
    """A page for each document: its lines as escaped paragraphs in a box of one of four classes, with headings, and for
    some a salutation or a note of absence."""
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    plain = F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, "[^A-Za-z0-9&<>,.]+", " ")))
    escaped = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.array_join(F.transform(F.filter(plain, lambda x: x != ""), lambda x: F.concat(F.lit("<p>"), escaped(x), F.lit("</p>"))), "\n")
    box = F.element_at(F.array(*map(F.lit, ("article-body", "content", "main-text", "other"))), (F.col("doc_id") % 4 + 1).cast("int"))
    name = F.col("doc_id").cast("string")
    page = F.concat(
        F.lit("<html><body><nav><p>menu</p></nav><h1>Doc "), name, F.lit("</h1><h2>Kind</h2><h2>Title "), name, F.lit('</h2><div class="'), box, F.lit('">'),
        F.when(F.col("doc_id") % 2 == 0, F.lit("<p>Ladies and Gentlemen</p>")).otherwise(""), lines,
        F.lit('</div><p class="citation">cite me</p><p>To cite this section</p><p>after</p>'),
        F.when(F.col("doc_id") % 7 == 0, F.lit("<p>Page not found</p>")).when(F.col("doc_id") % 7 == 1, F.lit("<p>They did not deliver it</p>")).otherwise(""),
        F.lit("</body></html>"),
    )
    return d.select("doc_id", page.alias("html"))


def html_articles(spark, sf):
    """Main text, article, speech, transcript and absence of the pages made from documents."""
    b = F.col("blocks")
    p = W.parse_pages(article_pages(spark, sf)).select(
        "doc_id", W.main_text(b).alias("main"), W.article(b).alias("a"), W.speech_span(b, (_SALUTATION,)).alias("span"), W.transcript(b, 40).alias("t"), W.absence(b).alias("d")
    )
    return p.select(
        "doc_id", F.md5("main").alias("main_md5"), "a.title", F.md5("a.body").alias("body_md5"), F.md5("span").alias("span_md5"),
        F.col("t.title").alias("heading"), F.md5("t.text").alias("text_md5"), "d.delivered", "d.reason",
    )


def service_log(spark, sf):
    """Events as a service log in a text file, read back: what each line says. Lines without a timestamp don't count."""
    e = table(spark, sf, "events")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    number = lambda c: F.col(c).cast("string")
    line = (
        F.when(F.col("event_type") == "click", F.concat(stamp, F.lit(" INFO query started: 'about "), number("user_id"), F.lit("' #"), number("event_id")))
        .when(F.col("event_type") == "purchase", F.concat(stamp, F.lit(" INFO query completed: chunks="), (F.col("user_id") % 9).cast("string"), F.lit(" tokens="), number("event_id")))
        .when(F.col("event_type") == "error", F.concat(stamp, F.lit(" ERROR query failed: code "), number("event_id")))
        .when(F.col("event_type") == "view", F.concat(stamp, F.lit(" DEBUG nothing "), number("event_id")))
        .otherwise(F.concat(F.lit("at "), stamp, F.lit(" query failed: code "), number("event_id")))
    )
    path = shared_folder(spark, "files")
    e.select(line.alias("value")).write.text(path)
    read = A.parse_service_log(readers.read_service_log(spark, path).select("value"), r"query started: '([^']*)'", r"query completed: chunks=(\d+) tokens=(\d+)", r"query failed: (.*)$")
    return read.select(F.md5("value").alias("line_md5"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "kind", "query", "chunk_count", "total_tokens", "error")


def query_log(spark, sf):
    """Events as tab-separated lines in a file, some with a bad time or too few fields, read back by day and source."""
    e, n = table(spark, sf, "events"), F.col("event_id")
    stamp = F.when(n % 10 == 3, F.lit("soon")).when(n % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    text = F.concat_ws("\t", stamp, "event_type", F.when(n % 10 != 4, F.concat(F.lit("q"), n.cast("string"))))
    path = shared_folder(spark, "files")
    e.select(text.alias("value")).write.text(path)
    read = readers.read_query_log(spark, path, "2024-01-03 00:00:00")
    return read.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "source").agg(F.count(F.lit(1)).alias("n"), F.min("query").alias("first_query"), F.max(F.date_format("ts", "HH:mm:ss")).alias("last_time"))


def chunk_files(spark, sf):
    """Turns as chunks in JSONL files, one in nine lines broken behind its end, read back whole."""
    c = table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("chunk_id"), "conv_id", "turn", "role", "text")
    path, again = shared_folder(spark, "files"), shared_folder(spark, "files")
    sinks.write_chunks(c, path)
    spoiled = spark.read.text(path).select(F.when(F.get_json_object("value", "$.conv_id").cast("long") % 9 == 4, F.concat(F.lit("{"), "value")).otherwise(F.col("value")).alias("value"))
    spoiled.write.text(f"{again}/chunks.jsonl")
    s, n = T.StringType(), T.LongType()
    schema = T.StructType([T.StructField(k, t) for k, t in (("chunk_id", s), ("turn", n), ("role", s), ("text", s))])
    read = readers.read_records(spark, f"{again}/chunks.jsonl", schema)
    return read.select("chunk_id", "turn", "role", F.md5("text").alias("text_md5"))


def metadata_files(spark, sf):
    """Rows of the vector table without their vector, written and read back."""
    path = shared_folder(spark, "files")
    sinks.write_metadata(table(spark, sf, "embeddings"), path)
    read = spark.read.parquet(path)
    return read.withColumn("names", F.lit(",".join(sorted(read.columns))))


def vector_files(spark, sf):
    """Vectors of which some are cut or zero, written and read back: the usable ones, and the faults of the others."""
    e, n = table(spark, sf, "embeddings"), F.col("vec_id")
    path = shared_folder(spark, "files")
    zero = F.transform("embedding", lambda x: (x * 0).cast("float"))
    e.withColumn("embedding", F.when(n % 10 == 1, F.slice("embedding", 1, 9)).when(n % 10 == 2, zero).when(n % 10 == 3, F.lit(None)).otherwise(F.col("embedding"))).write.parquet(path)
    good = readers.read_embeddings(spark, path, 64).select("vec_id", F.lit(None).cast("string").alias("fault"))
    bad = readers.embedding_faults(spark, path, 64).select("vec_id", "fault")
    return good.union(bad).select("vec_id", F.col("fault").isNull().alias("usable"))


def theme_vectors(spark, sf):
    """Words of the turns as keywords of their role; their vectors are computed once, stored, and read as a table."""
    words = F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) > 3)))
    themes = table(spark, sf, "conversations").select(F.col("role").alias("theme"), words.alias("keyword"))
    path = shared_folder(spark, "files")
    refresh_term_vectors(themes, path)
    most = F.array_max("embedding")
    return spark.read.parquet(path).select("keyword", F.array_position("embedding", most).cast("int").alias("slot"), F.round(most.cast("double"), 5).alias("weight"))


def file_keys(spark, sf):
    """Year and last name of the names of text files, some of which aren't such names."""
    o = table(spark, sf, "customer")
    year, name = F.col("c_custkey") % 200 + 1850, F.lower("c_mktsegment")
    file = F.when(F.col("c_custkey") % 5 == 0, F.concat(year.cast("string"), F.lit(".txt"))).when(F.col("c_custkey") % 5 == 1, F.concat(name, F.lit(".txt"))).otherwise(F.concat_ws("", year.cast("string"), F.lit("_"), name, F.lit(".txt")))
    key = file_key(file)
    return o.select("c_custkey", key[0].alias("year"), key[1].alias("last_name"))


def map_without(spark, sf):
    """A map of each event without two of its keys."""
    e = table(spark, sf, "events")
    m = F.map_from_arrays(F.array(F.lit("type"), "event_type", F.lit("user")), F.array(F.length("event_type").cast("bigint"), "event_id", "user_id"))
    left = sinks.without_keys(m, ["type", "error"])
    return e.select("event_id", F.array_join(F.array_sort(F.map_keys(left)), ",").alias("keys"), F.aggregate(F.map_values(left), F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"))


QUERIES = {f.__name__: f for f in (html_articles, service_log, query_log, chunk_files, metadata_files, vector_files, theme_vectors, file_keys, map_without)}

_DROPPED = "^(" + "|".join(p.replace(".", r"\.") for p in BOILERPLATE) + ")"
SQL = {
    "html_articles": rf"""with d as (select doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '[^A-Za-z0-9&<>,.]+', ' ', 'g'))), lambda x: x <> '') as l from documents),
b as (select doc_id, list_concat(case when doc_id % 2 = 0 then ['Ladies and Gentlemen'] else []::varchar[] end, l) as inner_ps,
  case doc_id % 7 when 0 then ['Page not found'] when 1 then ['They did not deliver it'] else []::varchar[] end as note from d),
p as (select doc_id, array_to_string(inner_ps, chr(10)) as boxed, list_concat(['menu'], inner_ps, ['cite me', 'To cite this section', 'after'], note) as ps,
  list_concat(inner_ps, ['To cite this section', 'after'], note) as body from b),
s as (select *, array_to_string(ps, chr(10)) as page, coalesce(list_position(list_transform(ps, lambda x: starts_with(lower(x), '{_SALUTATION}')), true), 0) as opens from p),
r as (select *, ps[greatest(opens, 1):] as rest from s),
z as (select *, coalesce(list_position(list_transform(rest, lambda x: regexp_matches(lower(x), 'to cite this section|copyright|back to top')), true), 0) as stop,
  array_to_string(list_filter(ps, lambda x: not regexp_matches(lower(x), '{_DROPPED}')), chr(10)) as kept from r)
select doc_id, md5(case when doc_id % 4 < 3 and len(regexp_split_to_array(boxed, '\s+')) > 50 then boxed when len(regexp_split_to_array(page, '\s+')) > 50 then page end) as main_md5,
  'Title ' || doc_id as title, md5(array_to_string(body, chr(10))) as body_md5, md5(array_to_string(case when stop > 0 then rest[:stop - 1] else rest end, chr(10))) as span_md5,
  'Doc ' || doc_id as heading, md5(case when len(regexp_split_to_array(kept, '\s+')) >= 40 then kept end) as text_md5,
  not (contains(lower(page), 'page not found') or contains(lower(page), 'did not deliver')) as delivered,
  case when contains(lower(page), 'page not found') then 'missing_page' when contains(lower(page), 'did not deliver') then 'not_delivered' end as reason from z""",
    "service_log": """with e as (select *, strftime(ts, '%Y-%m-%d %H:%M:%S') as t from events where event_type in ('click', 'purchase', 'error'))
select md5(case event_type when 'click' then t || ' INFO query started: ''about ' || user_id || ''' #' || event_id when 'purchase' then t || ' INFO query completed: chunks=' || (user_id % 9) || ' tokens=' || event_id
    else t || ' ERROR query failed: code ' || event_id end) as line_md5, t as ts, case event_type when 'click' then 'start' when 'purchase' then 'done' else 'fail' end as kind,
  case event_type when 'click' then 'about ' || user_id end as query, (case event_type when 'purchase' then user_id % 9 end)::int as chunk_count,
  (case event_type when 'purchase' then event_id end)::int as total_tokens, case event_type when 'error' then 'code ' || event_id end as error from e""",
    "query_log": """select strftime(ts, '%Y-%m-%d') as day, event_type as source, count(*) as n, min('q' || event_id) as first_query, max(strftime(ts, '%H:%M:%S')) as last_time
from events where event_id % 10 not in (3, 4) and ts >= timestamp '2024-01-03 00:00:00' group by 1, 2""",
    "chunk_files": "select conv_id || '-' || turn as chunk_id, turn, role, md5(text) as text_md5 from conversations where conv_id % 9 <> 4",
    "metadata_files": "select vec_id, label, 'label,vec_id' as names from embeddings",
    "vector_files": "select vec_id, vec_id % 10 not in (1, 2, 3) and embedding is not null and list_dot_product(embedding, embedding) > 0 as usable from embeddings",
    "theme_vectors": f"""with k as (select distinct unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 3)) as text from conversations),
e as (select text as keyword, {EMBEDDED_SQL} as v from k) select keyword, list_position(v, list_max(v))::int as slot, round(list_max(v)::double, 5) as weight from e where v is not null""",
    "file_keys": """select c_custkey, (case when c_custkey % 5 <> 1 then c_custkey % 200 + 1850 end)::int as year, case when c_custkey % 5 not in (0, 1) then lower(c_mktsegment) end as last_name from customer""",
    "map_without": """select event_id, array_to_string(list_sort(case when event_type = 'error' then ['user'] else [event_type, 'user'] end), ',') as keys, user_id + case when event_type = 'error' then 0 else event_id end as total from events""",
}
