"""Queries over fetched pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import html as W
from lexloom.session import table


def html_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", W.title_of(F.col("html")).alias("title"))


def html_links(spark, sf):
    links = table(spark, sf, "pages").select("page_id", F.posexplode(W.hrefs(F.col("html"))).alias("pos", "href"))
    return links.select("page_id", "pos", F.when(F.col("href").rlike("^https?://"), F.col("href")).otherwise(F.concat(F.lit("http://example.com"), F.col("href"))).alias("href"))


def _parsed(spark, sf):
    return W.parse_pages(table(spark, sf, "pages"))


def html_text(spark, sf):
    p = _parsed(spark, sf)
    return p.select("page_id", F.size("blocks").alias("n_blocks"), F.md5(W.main_text(F.col("blocks"))).alias("main_md5"), W.article(F.col("blocks")).alias("a")).select("page_id", "n_blocks", "main_md5", "a.title", F.md5("a.body").alias("body_md5"))


def html_speech(spark, sf):
    p = _parsed(spark, sf)
    return p.select("page_id", F.length(W.speech_span(F.col("blocks"), ("the ", "die ", "la "))).alias("span_chars"), W.transcript(F.col("blocks"), 10).alias("t"), W.absence(F.col("blocks")).alias("d")).select("page_id", "span_chars", "t.title", F.length("t.text").alias("text_chars"), "d.delivered", "d.reason")


def html_facts(spark, sf):
    """Facts pages made from customers: born, died, motivation and language paragraphs and two sections."""
    c = table(spark, sf, "customer")
    day = F.date_add(F.lit("1900-01-01"), F.col("c_custkey").cast("int"))
    page = F.concat(
        F.lit("<html><body><h2>Facts</h2><p>Born: "), F.date_format(day, "d MMMM yyyy"), F.lit(", Town "), F.col("c_custkey").cast("string"), F.lit(", "), F.col("c_mktsegment"), F.lit("</p><p>Prize motivation: &ldquo;for "),
        F.col("c_name"), F.lit("&rdquo;</p><p>Language: L"), F.col("c_nationkey").cast("string"), F.lit("</p><h3>Life</h3><p>one</p><p>two</p><p>one</p><h3>Work</h3><p>three</p></body></html>"),
    )
    p = W.parse_pages(c.select("c_custkey", page.alias("html")))
    return p.select("c_custkey", W.facts(F.col("blocks")).alias("f"), W.section(F.col("blocks"), "life").alias("life"), W.section(F.col("blocks"), "work").alias("work")).select("c_custkey", F.col("f.born").cast("string").alias("born"), F.col("f.died").cast("string").alias("died"), "f.country", "f.motivation", "f.language", "life", "work")


def html_anchor_links(spark, sf):
    p = _parsed(spark, sf).select("page_id", F.explode(W.pick_links(F.col("links"), "http://example.com", "", "/", "th")).alias("href"))
    return p.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (html_title, html_links, html_text, html_speech, html_facts, html_anchor_links)}
SQL = {
    "html_title": "select page_id, nullif(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '') as title from pages",
    "html_links": """with l as (select page_id, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) as hs from pages), x as (select page_id, unnest(range(len(hs))) as pos, unnest(hs) as h from l)
select page_id, pos::int as pos, case when regexp_matches(h, '^https?://') then h else 'http://example.com' || h end as href from x""",
    "html_facts": """select c_custkey, (date '1900-01-01' + c_custkey::int)::varchar as born, null::varchar as died, c_mktsegment as country, 'for ' || c_name as motivation, 'L' || c_nationkey as language, 'one' || chr(10) || 'two' as life, 'three' as work from customer""",
    "html_anchor_links": """with l as (select page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) as h, unnest(regexp_extract_all(html, '<a [^>]*href="[^"]*"[^>]*>([^<]*)</a>', 1)) as t from pages)
select page_id, count(*) as n from l where contains(lower(h), '/') and contains(lower(t), 'th') group by 1""",
}
