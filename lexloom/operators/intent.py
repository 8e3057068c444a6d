"""Intent scoring, thematic subtype, routing: column expressions over tables of questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import tokens

from .filters import is_vague

PRECEDENCE = ("generative", "thematic", "factual")

# Cues of each subtype, the strong ones, and subjects and verbs of the synthesis frame.
SUBTYPE_CUES = {
    "synthesis": ("synthesize", "synthesis", "connect", "unify", "coherent", "narrative", "draw together", "overall", "in general", "unified", "cohesive", "integrated", "holistic"),
    "enumerative": ("list", "examples", "which speeches", "show me", "enumerate", "what are the", "give me", "find", "search", "locate", "specific", "instances", "cases", "occurrences"),
    "analytical": ("compare", "contrast", "difference", "evolution", "change over time", "versus", "vs", "against", "similar", "different", "trend", "development", "progression", "transformation", "shift"),
    "exploratory": ("context", "background", "significance", "history", "meaning", "explain", "why", "what is", "how did", "when", "where", "circumstances", "situation", "environment", "setting"),
}
STRONG = ("synthesize", "compare", "list", "context")
SUBJECTS = ("laureates", "winners", "recipients", "authors", "they", "these voices")
VERBS = ("think", "feel", "say", "reflect", "talk about", "treat", "explore", "approach", "address")

# Top k, threshold, least and most rows returned for each intent.
ROUTES = {"factual": (5, 0.25, 3, 10), "thematic": (15, 0.2, 5, 12), "generative": (10, 0.2, 3, 10)}


def _some(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words], F.lit(False))


def intent_scores(df: DataFrame, text_col: str, weights: dict[str, dict[str, dict[str, float]]]) -> DataFrame:
    """Adds scores (map intent to sum) and matched (map intent to terms) for intents with a score.

    Keywords of one word count once if they are a token of the text; phrases count if the text contains
    them; keywords of several words never match. The weights are literals: no join, one pass.
    """
    low, toks = F.lower(F.coalesce(F.col(text_col), F.lit(""))), tokens(F.col(text_col))
    held = df.withColumn("_low", low).withColumn("_toks", toks)
    out = []
    for intent, kinds in weights.items():
        terms = [(F.array_contains("_toks", t), t, w) for t, w in kinds.get("keyword", {}).items() if " " not in t]
        terms += [(F.contains("_low", F.lit(t)), t, w) for t, w in kinds.get("phrase", {}).items()]
        hits = F.filter(F.array(*[F.when(c, F.struct(F.lit(t).alias("term"), F.lit(float(w)).alias("w"))) for c, t, w in terms]), lambda x: x.isNotNull())
        out.append(F.struct(F.lit(intent).alias("intent"), hits.alias("hits")))
    scored = held.withColumn("_hits", F.filter(F.array(*out), lambda x: F.size(x["hits"]) > 0)).drop("_low", "_toks")
    total = lambda x: F.round(F.aggregate(x["hits"], F.lit(0.0), lambda s, h: s + h["w"]), 6)
    return scored.select(
        *df.columns,
        F.map_from_entries(F.transform("_hits", lambda x: F.struct(x["intent"], total(x)))).alias("scores"),
        F.map_from_entries(F.transform("_hits", lambda x: F.struct(x["intent"], F.transform(x["hits"], lambda h: h["term"])))).alias("matched"),
    )


def classify(df: DataFrame, text_col: str, weights: dict[str, dict[str, dict[str, float]]]) -> DataFrame:
    """Adds intent, confidence, matched_terms, gap and too_vague.

    The best score wins; within a gap of 0.3 of the second the order generative, thematic, factual decides.
    Confidence is the best score over the sum of the greatest keyword weights of the intents that scored,
    less a penalty for a small gap, within 0.1 and 1. Without a score: too_vague, or factual with 0.1.
    """
    scored = intent_scores(df, text_col, weights)
    ranked = F.array_sort(F.transform(F.map_entries("scores"), lambda e: F.struct((-e["value"]).alias("neg"), e["key"].alias("intent"))))
    most = {i: max(k.get("keyword", {}).values(), default=0.0) for i, k in weights.items()}
    step = scored.withColumn("_r", ranked)
    s1, s2 = -F.get("_r", 0)["neg"], -F.get("_r", 1)["neg"]
    gap = F.round(s1 - s2, 6)
    present = lambda i: F.array_contains(F.map_keys("scores"), i)
    close = F.coalesce(*[F.when(present(i), F.lit(i)) for i in PRECEDENCE[:2]], F.get("_r", 0)["intent"])
    winner = F.when(F.size("_r") == 0, "factual").when((F.size("_r") > 1) & (gap <= 0.3), close).otherwise(F.get("_r", 0)["intent"])
    penalty = F.when(F.size("_r") < 2, 0.0).when(gap > 0.5, 0.0).when(gap > 0.2, 0.2).when(gap > 0.1, 0.5).otherwise(0.8)
    possible = sum((F.when(present(i), m).otherwise(0.0) for i, m in most.items()), F.lit(0.0))
    sure = F.least(F.lit(1.0), F.greatest(F.lit(0.1), s1 / possible * (1 - penalty)))
    return step.select(
        *df.columns,
        winner.alias("intent"),
        F.round(F.when(F.size("_r") == 0, 0.1).otherwise(sure), 6).alias("confidence"),
        F.coalesce(F.try_element_at("matched", winner), F.array().cast("array<string>")).alias("matched_terms"),
        gap.alias("gap"),
        ((F.size("_r") == 0) & is_vague(F.col(text_col))).alias("too_vague"),
    )


def subtype(df: DataFrame, text_col: str) -> DataFrame:
    """Adds subtype, subtype_confidence, subtype_cues: 0.3 for each cue, 0.2 for more than one, 0.3 for any
    strong cue in the text, 0.3 for a subject and verb of the synthesis frame; the first best wins."""
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    held = df.withColumn("_low", low)
    strong = F.when(_some(F.col("_low"), STRONG), 0.3).otherwise(0.0)
    frame = F.col("_low").rlike("(" + "|".join(SUBJECTS) + ") (" + "|".join(VERBS) + ")")
    parts = []
    for i, (name, cues) in enumerate(SUBTYPE_CUES.items()):
        found = F.filter(F.array(*[F.when(F.contains("_low", F.lit(c)), F.lit(c)) for c in cues]), lambda x: x.isNotNull())
        score = F.size(found) * 0.3 + F.when(F.size(found) > 1, 0.2).otherwise(0.0) + strong
        if name == "synthesis":
            score = score + F.when(frame, 0.3).otherwise(0.0)
            found = F.when(frame, F.array_append(found, F.lit("synthesis_frame_match"))).otherwise(found)
        parts.append(F.struct((-F.round(score, 6)).alias("neg"), F.lit(i).alias("ord"), F.lit(name).alias("name"), found.alias("cues")))
    best = held.withColumn("_best", F.array_min(F.array(*parts)))
    some = F.col("_best.neg") < 0
    return best.select(
        *df.columns,
        F.when(some, F.col("_best.name")).alias("subtype"),
        F.when(some, F.least(F.lit(1.0), -F.col("_best.neg"))).alias("subtype_confidence"),
        F.when(some, F.col("_best.cues")).alias("subtype_cues"),
    )


def route(df: DataFrame, entities: str | None = None, scoped: tuple[str, ...] = tuple(ROUTES)) -> DataFrame:
    """Adds top_k, score_threshold, min_return, max_return, low_confidence and, from a column of entities,
    filter_names: the names whose texts a question of an intent in `scoped` is answered from; null for all texts.
    df: intent, confidence."""
    pick = lambda i: reduce(lambda a, kv: a.when(F.col("intent") == kv[0], kv[1][i]), ROUTES.items(), F.when(F.lit(False), ROUTES["factual"][i])).otherwise(ROUTES["factual"][i])
    out = df.select("*", pick(0).alias("top_k"), pick(1).alias("score_threshold"), pick(2).alias("min_return"), pick(3).alias("max_return"), (F.col("confidence") < 0.5).alias("low_confidence"))
    return out.withColumn("filter_names", F.when((F.size(entities) > 0) & F.col("intent").isin(*scoped), F.col(entities))) if entities else out


def template_name(intent: Column, subtype_: Column, text: Column) -> Column:
    """Which template an answer is built with."""
    low = F.lower(text)
    creative = F.when(_some(low, ("email", "accept")), "generative_email").when(_some(low, ("speech", "inspirational")), "generative_speech").when(_some(low, ("reflection", "personal")), "generative_reflection").otherwise("generative_email")
    themed = F.when(subtype_ == "enumerative", "thematic_enumerative").when(subtype_ == "analytical", "thematic_comparative").when(subtype_ == "exploratory", "thematic_contextual").otherwise("thematic_synthesis_clean")
    return F.when(intent == "generative", creative).when(intent == "thematic", themed).otherwise("qa_factual")
