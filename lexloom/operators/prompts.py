"""Context and prompts: a question's chunks in order, cited, filled into its template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import fill_template
from lexloom.session import small


def _known(c: Column) -> Column:
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("Unknown"))


def marker(kind: Column) -> Column:
    return F.when(kind == "lecture", "🎓").when(kind == "ceremony", "🏅").otherwise("📚")


def citation(style: str, author: Column, year: Column, category: Column, number: Column, award: str = "Prize") -> Column:
    if style == "inline":
        return F.concat(F.lit("("), _known(author), F.lit(", "), _known(year), F.lit(")"))
    if style == "footnote":
        return F.concat(F.lit("["), number.cast("string"), F.lit("] "), _known(author), F.lit(", "), _known(category), F.lit(" "), _known(year))
    return F.concat(_known(author), F.lit(f", {award} in "), _known(category), F.lit(", "), _known(year))


def plain_line(text: Column, author: Column, year: Column, kind: Column) -> Column:
    return F.concat(F.coalesce(text, F.lit("")), F.lit(" (by "), _known(author), F.lit(", "), _known(year), F.lit(", "), _known(kind), F.lit(")"))


def cited_line(style: str | Column, text: Column, author: Column, year: Column, kind: Column, category: Column, number: Column) -> Column:
    head = F.concat(F.lit("["), marker(kind), F.lit(" "), F.initcap(F.coalesce(kind, F.lit("speech"))), F.lit(" — "), _known(author), F.lit(", "), _known(year), F.lit("] "), F.trim(F.coalesce(text, F.lit(""))))
    inline = F.concat(head, F.lit(" "), citation("inline", author, year, category, number))
    return F.when(style == "inline", inline).otherwise(head) if isinstance(style, Column) else inline if style == "inline" else head


def assemble_context(df: DataFrame, by: str, style: str | Column | None = None) -> DataFrame:
    """by, context, n_chunks: a question's chunks by rank, one blank line between them.

    df: rank, text, author, year, kind, category. Without a style each line is `text (by author, year,
    kind)`; with footnotes the notes follow the lines. The style may be a column, one value for each question.
    A question's chunks are few (its route's maximum).
    """
    number = F.col("rank") + 1
    cols = [F.col(c) for c in ("text", "author", "year", "kind")]
    line = plain_line(*cols) if style is None else cited_line(style, *cols, F.col("category"), number)
    note = citation("footnote", F.col("author"), F.col("year"), F.col("category"), number)
    noted = style == "footnote" if isinstance(style, Column) else F.lit(style == "footnote")
    rows = df.withColumn("_line", line).withColumn("_note", note).withColumn("_noted", F.coalesce(noted, F.lit(False)))
    got = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", "_line", "_note"))).alias("_x"), F.bool_or("_noted").alias("_noted"))
    lines = F.transform("_x", lambda x: x["_line"])
    notes = F.concat(lines, F.array(F.lit("\n--- FOOTNOTES ---")), F.transform("_x", lambda x: x["_note"]))
    return got.select(by, F.array_join(F.when(F.col("_noted"), notes).otherwise(lines), "\n\n").alias("context"), F.size("_x").alias("n_chunks"))


def build_prompts(questions: DataFrame, contexts: DataFrame, templates: DataFrame, by: str = "question_id") -> DataFrame:
    """by, template, prompt: the question's template (named in template) with query and context filled in."""
    joined = questions.join(contexts, by, "left").join(small(templates.select(F.col("name").alias("template"), F.col("template").alias("_body"))), "template", "left")
    return joined.select(by, "template", fill_template(F.col("_body"), query=F.col("question"), context=F.col("context")).alias("prompt"))
