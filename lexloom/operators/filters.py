"""Filters, look-ups and row checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases that make a question too vague.
VAGUE = (
    "tell me about", "information on", "details about", "something about", "tell me something", "give me information",
    "what can you tell me", "what do you know",
)


def flatten(df: DataFrame, array_col: str, parent_cols: list[str]) -> DataFrame:
    """A row for each element, with the parent's columns; ord is the element's place."""
    return df.select(*parent_cols, F.posexplode(array_col).alias("ord", "_item")).select(*parent_cols, "ord", "_item.*")


def apply_filters(df: DataFrame, filters: dict) -> DataFrame:
    """Rows that match all of {column: value or list of values}. A column that df lacks counts as null,
    and null equals null."""

    def test(name: str, value) -> Column:
        c = F.col(name) if name in df.columns else F.lit(None)
        if isinstance(value, list | tuple | set):
            known = [v for v in value if v is not None]
            inside = F.coalesce(c.isin(*known), F.lit(False)) if known else F.lit(False)
            return inside | c.isNull() if None in value else inside
        return c.eqNullSafe(F.lit(value))

    return df.where(reduce(lambda a, b: a & b, [test(k, v) for k, v in filters.items()], F.lit(True)))


def apply_score_threshold(df: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    return df.where(F.col(score) >= threshold)


def search(df: DataFrame, col: str, needle: str) -> DataFrame:
    """Rows whose text contains the needle, whatever its case."""
    return df.where(F.contains(F.lower(F.col(col)), F.lit(needle.lower())))


def since(df: DataFrame, ts_col: str, hours: float | None = None, start: str | None = None, now: str | None = None) -> DataFrame:
    """Rows after `start`, or within the last hours before now (the clock by default). `7d` style spans:
    pass hours=24 * 7."""
    if start is not None:
        return df.where(F.col(ts_col) >= F.lit(start).cast("timestamp_ntz"))
    end = F.lit(now).cast("timestamp_ntz") if now else F.localtimestamp()
    return df.where(F.col(ts_col) > end - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(hours or 0) * 3600)))


def get_by_id(df: DataFrame, id_col: str, value, order_col: str | None = None) -> DataFrame:
    """The first row with this id."""
    return df.where(F.col(id_col) == value).orderBy(order_col or id_col).limit(1)


def entity_lookup(df: DataFrame, name_col: str, needle: str, order_col: str) -> DataFrame:
    """The first row, by order_col, whose name contains the needle; no row if none does."""
    hit = df.where(F.contains(F.lower(F.col(name_col)), F.lit(needle.lower())))
    best = hit.agg(F.min_by(F.struct(*hit.columns), F.col(order_col)).alias("_row"))
    return best.where(F.col("_row").isNotNull()).select("_row.*")


def query_fault(c: Column, longest: int = 1000) -> Column:
    """Why a question is unusable: empty, blank, short, specials, digits, long; null if it is fine."""
    body = F.regexp_replace(c, r"^\s+|\s+$", "")
    return (
        F.when(c.isNull() | (c == ""), "empty")
        .when(body == "", "blank")
        .when(F.length(body) < 2, "short")
        .when(body.rlike(r"^[^\p{L}\p{N}_\s]+$"), "specials")
        .when(body.rlike(r"^[0-9]+$"), "digits")
        .when(F.length(c) > longest, "long")
    )


def is_vague(c: Column, phrases: tuple[str, ...] = VAGUE) -> Column:
    """True for a vague phrase, fewer than three words, or no letter."""
    low = F.lower(F.coalesce(c, F.lit("")))
    some = reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in phrases])
    count = F.size(F.filter(F.split(low, r"\s+"), lambda w: w != ""))
    return some | (count < 3) | ~low.rlike(r"\p{L}")
