"""Quality rules: base counts and distribution divergence, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_WS, WS, materialize, table

# Common function words of English, German, French and Spanish.
COMMON_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "on",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "ein", "für",
    "de", "la", "le", "et", "les", "un", "une", "que", "est", "pour", "en", "du",
    "el", "y", "los", "se", "las", "con", "por", "su", "al", "lo",
)

SYMBOLS = r"[#*$%&|<>]"
#: Character classes that are counted by pattern; white space, symbols and the rest complete them.
CLASSES = (r"[a-z]", r"[A-Z]", r"[0-9]", r"[.,;:!?'\x22()-]")

#: Largest Jensen-Shannon distances (base 2, 0 to 1) to the nearest language reference.
MAX_CHAR_DISTANCE = 0.28
MAX_WORD_DISTANCE = 0.27
#: Shorter texts are not judged by the distance.
MIN_CHARS = 200
MIN_WORDS = 120


def _without(col: Column, cls: str) -> Column:
    return F.length(F.regexp_replace(col, f"[^{cls[1:-1]}]+", "")).cast("long")


def text_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Base counts and histograms of each row's whole text: null counts as no text.

    Every step after the split works on arrays of the row itself, so nothing is shuffled. Repeated
    3-word windows are found by their 64-bit digests: if any occurs twice, (digest, position) pairs are
    sorted and neighbours compared, so long texts cost n log n.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    split = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), text.alias("t")).select(
        "id", "lang", "t", F.filter(F.split("t", WS + "+"), lambda w: w != "").alias("words")
    )
    n = F.size("words")
    first = split.select(
        "id",
        "lang",
        F.length("t").cast("long").alias("n_chars"),
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", WS + "+", "")).cast("long").alias("word_chars"),
        _without(F.col("t"), SYMBOLS).alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(NOT_WS)).alias("lines"),
        F.array(*[_without(F.col("t"), c) for c in CLASSES]).alias("matched"),
        F.filter(F.transform("words", F.lower), lambda w: w.isin(*COMMON_WORDS)).alias("common"),
        F.when(
            n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))
        ).alias("windows"),
    )
    pairs = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    second = first.withColumn("pairs", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), pairs))
    same = F.filter(
        "pairs",
        lambda p, j: F.coalesce(F.get("pairs", j - 1)["h"] == p["h"], F.lit(False)) | F.coalesce(F.get("pairs", j + 1)["h"] == p["h"], F.lit(False)),
    )
    third = second.withColumn("at", F.sort_array(F.transform(same, lambda p: p["i"])))
    steps = F.zip_with("at", F.slice("at", 2, F.size("at")), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
    matched = [F.get("matched", i) for i in range(len(CLASSES))]
    blank = F.col("n_chars") - F.col("word_chars")
    return third.select(
        "id",
        "lang",
        "n_chars",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("at") > 0, F.aggregate(steps, F.lit(0), lambda s, x: s + x)).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.array(*matched, blank, F.col("n_symbols"), F.col("word_chars") - F.col("n_symbols") - sum(matched[1:], matched[0])).alias("classes"),
        F.concat(
            F.transform(F.array(*map(F.lit, COMMON_WORDS)), lambda v: F.size(F.filter("common", lambda w: w == v)).cast("long")),
            F.array((F.col("n_words") - F.size("common")).cast("long")),
        ).alias("word_hist"),
    )


def language_references(features: DataFrame) -> list[tuple[list[float], list[float]]]:
    """Per language, the shares of the character classes and of the common words over all its texts.

    One aggregate over all rows; what reaches the driver is a row of some 50 sums for each language.
    """
    n_cls, n_hist = len(CLASSES) + 3, len(COMMON_WORDS) + 1
    sums = [F.sum(F.get("classes", i)).alias(f"c{i}") for i in range(n_cls)] + [F.sum(F.get("word_hist", i)).alias(f"w{i}") for i in range(n_hist)]
    rows = features.where(F.col("lang").isNotNull()).groupBy("lang").agg(*sums).orderBy("lang").collect()
    out = []
    for r in rows:
        c, w = [r[f"c{i}"] for i in range(n_cls)], [r[f"w{i}"] for i in range(n_hist)]
        if sum(c) and sum(w):
            out.append(([x / sum(c) for x in c], [x / sum(w) for x in w]))
    return out


def _distance(hist: str, total: str, reference: list[float]) -> Column:
    """Jensen-Shannon distance of a histogram column to a reference."""

    def term(x: Column, q: Column) -> Column:
        p = x / F.col(total)
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

    terms = F.zip_with(hist, F.array(*map(F.lit, reference)), term)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2))


def _nearest(hist: str, total: str, references: list[list[float]]) -> Column:
    found = [_distance(hist, total, r) for r in references]
    nearest = F.least(*found) if len(found) > 1 else found[0] if found else F.lit(0.0)
    return F.when(F.col(total) > 0, nearest)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each row of docs: base counts, base_failed, both distances, kept.

    A text is kept if its base rules hold and the character classes and common words of texts that are
    long enough lie near at least one language reference; the references are the corpus's own shares by
    lang_col, over all rows. Null and empty texts have no words and fail the base rules. With no
    language known nothing is judged by distance. Repeated rows are judged alike; an empty table gives
    no rows; further columns are ignored.
    """
    features = materialize(text_features(docs, id_col, text_col, lang_col))
    references = language_references(features)
    judged = features.withColumn("char_distance", _nearest("classes", "n_chars", [c for c, _ in references])).withColumn(
        "word_distance", _nearest("word_hist", "n_words", [w for _, w in references])
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    odd = ((F.col("n_chars") >= MIN_CHARS) & (F.col("char_distance") > MAX_CHAR_DISTANCE)) | (
        (F.col("n_words") >= MIN_WORDS) & (F.col("word_distance") > MAX_WORD_DISTANCE)
    )
    return judged.select(
        F.col("id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & ~F.coalesce(odd, F.lit(False))).alias("kept"),
        "char_distance",
        "word_distance",
    )


def op2_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


def _sql() -> str:
    words = ", ".join("'" + w + "'" for w in COMMON_WORDS)
    counted = ", ".join(f"length(regexp_replace(t, '[^{c[1:-1].replace(chr(39), chr(39) * 2)}]+', '', 'g'))" for c in CLASSES)

    def distance(hist: str, total: str, ref: str) -> str:
        p, q = f"({hist}[i] / {total}::double)", f"{ref}[i]"
        m = f"(({p} + {q}) / 2)"
        term = f"case when {p} > 0 then {p} * log2({p} / {m}) else 0 end + case when {q} > 0 then {q} * log2({q} / {m}) else 0 end"
        return f"sqrt(greatest(0, list_sum(list_transform(range(1, len({hist}) + 1), lambda i: {term})) / 2))"

    return f"""
with d as (
  select row_number() over () as rid, doc_id, lang, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '{NOT_WS}+') as words
  from documents),
g as (
  select rid, i, count(*) over (partition by rid, w) as n
  from (select rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as w
        from (select rid, words, unnest(range(1, len(words) - 1)) as i from d))),
r as (
  select rid, count(distinct i + o) as n_repeat_words
  from g, (select unnest([0, 1, 2]) as o) where n > 1 group by rid),
f as (
  select d.rid, doc_id, lang, length(t) as n_chars, len(words) as n_words,
         length(regexp_replace(t, '{WS}+', '', 'g')) as word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{NOT_WS}')) as lines,
         coalesce(n_repeat_words, 0) as n_repeat_words,
         [{counted}] as matched,
         list_filter(list_transform(words, lambda w: lower(w)), lambda w: list_contains([{words}], w)) as common
  from d left join r using (rid)),
h as (
  select *, len(lines) - len(list_distinct(lines)) as n_dup_lines,
         list_concat(matched, [n_chars - word_chars, n_symbols, word_chars - n_symbols - list_sum(matched)::bigint]) as classes,
         list_concat(list_transform([{words}], lambda v: len(list_filter(common, lambda w: w = v))), [n_words - len(common)]) as word_hist
  from f),
s as (
  select lang, list(share order by i) filter (kind = 0) as cref, list(share order by i) filter (kind = 1) as wref
  from (select lang, kind, i, sum(v) / sum(sum(v)) over (partition by lang, kind) as share
        from (select lang, 0 as kind, unnest(range(1, len(classes) + 1)) as i, unnest(classes) as v from h where lang is not null
              union all
              select lang, 1 as kind, unnest(range(1, len(word_hist) + 1)) as i, unnest(word_hist) as v from h where lang is not null)
        group by lang, kind, i) group by lang),
j as (
  select h.rid, min({distance("classes", "n_chars", "cref")}) as char_distance,
         min({distance("word_hist", "n_words", "wref")}) as word_distance
  from h, s where n_chars > 0 and n_words > 0 group by h.rid)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words)
       and not coalesce(n_chars >= {MIN_CHARS} and char_distance > {MAX_CHAR_DISTANCE}
                        or n_words >= {MIN_WORDS} and word_distance > {MAX_WORD_DISTANCE}, false) as kept
from h left join j using (rid)
"""


OP2_SQL = _sql()
