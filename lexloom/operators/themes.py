"""Keyword and theme expansion: all keywords in each text by one automaton."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import tokens, without_stop_words
from lexloom.functions.vectors import embed_table
from lexloom.session import small

from .matching import find_labels


def lemmas(toks: Column, dictionary: dict[str, str]) -> Column:
    """Tokens with their lemma where the dictionary has one."""
    if not dictionary:
        return toks
    d = F.create_map(*[F.lit(x) for kv in dictionary.items() for x in kv])
    return F.transform(toks, lambda w: F.coalesce(F.try_element_at(d, w), w))


def _patterns(themes: DataFrame, dictionary: dict[str, str] | None) -> DataFrame:
    """pattern, bounded, label: keywords of one word count as tokens of a text, phrases anywhere in it; so does each
    word that the dictionary leads to a keyword. Labels are themes."""
    own = themes.where("keyword is not null and theme is not null").select(F.col("keyword").alias("pattern"), (~F.contains("keyword", F.lit(" "))).alias("bounded"), F.col("theme").alias("label"))
    if not dictionary:
        return own
    led = themes.sparkSession.createDataFrame(list(dictionary.items()), "word string, lemma string")
    led = small(led).join(own.where("bounded"), F.col("lemma") == F.col("pattern")).select(F.col("word").alias("pattern"), "bounded", "label")
    return own.unionByName(led)


def extract_themes(df: DataFrame, id_col: str, text_col: str, themes: DataFrame, dictionary: dict[str, str] | None = None) -> DataFrame:
    """id and the sorted themes of which a keyword is in the text; rows without any don't appear.

    themes (theme, keyword) is a dimension of any size, see find_labels(); ids may repeat, each row is one by itself.
    """
    found = find_labels(df.select(id_col, F.lower(text_col).alias("_t")), "_t", _patterns(themes, dictionary), "themes")
    return found.where(F.size("themes") > 0)


def expand_keywords(df: DataFrame, id_col: str, text_col: str, themes: DataFrame, dictionary: dict[str, str] | None = None) -> DataFrame:
    """id and all keywords, sorted, of the themes found in the text; see extract_themes()."""
    numbered = df.select(F.struct(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row")).alias("_key"), F.col(text_col).alias("_text"))
    found = extract_themes(numbered, "_key", "_text", themes, dictionary).select("_key", F.explode("themes").alias("theme"))
    members = themes.where("keyword is not null").groupBy("theme").agg(F.collect_set("keyword").alias("_ks"))
    wide = found.join(small(members), "theme").groupBy("_key").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("_ks")))).alias("keywords"))
    return wide.select(F.col("_key.id").alias(id_col), "keywords")


def expansion_debug(df: DataFrame, id_col: str, text_col: str, themes: DataFrame, stop: tuple[str, ...] = ()) -> DataFrame:
    """Counts before and after expansion: tokens, tokens without stop words, keywords, themes."""
    base = df.select(id_col, F.size(tokens(F.col(text_col))).alias("n_tokens"), F.size(without_stop_words(F.col(text_col), stop)).alias("n_content"))
    k = expand_keywords(df, id_col, text_col, themes).select(id_col, F.size("keywords").alias("n_keywords"))
    t = extract_themes(df, id_col, text_col, themes).select(id_col, F.size("themes").alias("n_themes"))
    return base.join(k, id_col, "left").join(t, id_col, "left").na.fill(0, ["n_keywords", "n_themes"])


def focus_text(text: Column, keywords: list[str], stop: tuple[str, ...]) -> Column:
    """What an expansion looks at: the keywords in the text, else the text without stop words, else all of it."""
    hit = F.array_join(F.filter(tokens(text), lambda w: w.isin(*keywords)), " ")
    rest = F.array_join(without_stop_words(text, stop), " ")
    return F.coalesce(F.nullif(hit, F.lit("")), F.nullif(rest, F.lit("")), text)


def term_vectors(themes: DataFrame, model: str | None = None, dim: int = 64) -> DataFrame:
    """keyword and embedding of every distinct keyword; keywords without a vector are left out."""
    return embed_table(themes.select("keyword").distinct(), "keyword", model, dim=dim).where(F.col("embedding").isNotNull())


def refresh_term_vectors(themes: DataFrame, path: str, model: str | None = None, dim: int = 64) -> None:
    """Write the term vectors anew; retrieval then reads them as a table."""
    term_vectors(themes, model, dim).write.mode("overwrite").parquet(path)
