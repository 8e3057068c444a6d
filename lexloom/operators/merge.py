"""Upserts, overrides and reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], stamp: Column | None = None, key_exprs: dict[str, Column] | None = None) -> DataFrame:
    """old with new merged in by keys: new values win unless null, old rows without a match stay as they
    are, new keys are added. With stamp, last_updated is set on rows that new has.

    key_exprs gives the compared form of a key (such as lower(trim(name))); keys are unique on both sides.
    """
    forms = key_exprs or {}
    k = [f"_k{i}" for i in range(len(keys))]
    values = [c for c in old.columns if c not in keys and c != "last_updated"]
    left = old.select(*[forms.get(c, F.col(c)).alias(a) for c, a in zip(keys, k, strict=True)], *[F.col(c).alias(f"_o_{c}") for c in old.columns])
    right = new.select(*[forms.get(c, F.col(c)).alias(a) for c, a in zip(keys, k, strict=True)], *[F.col(c).alias(f"_n_{c}") for c in new.columns], F.lit(True).alias("_has"))
    both = left.join(right, k, "full_outer")
    pick = lambda c: F.coalesce(f"_n_{c}", f"_o_{c}") if c in new.columns else F.col(f"_o_{c}")
    kept = lambda c: F.coalesce(f"_o_{c}", f"_n_{c}")
    out = [kept(c).alias(c) for c in keys] + [pick(c).alias(c) for c in values]
    if stamp is not None:
        before = F.col("_o_last_updated") if "last_updated" in old.columns else F.lit(None).cast("string")
        out.append(F.when(F.col("_has"), stamp).otherwise(before).alias("last_updated"))
    return both.select(*out)


def upsert_conflicts(old: DataFrame, new: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """keys, field, old_value, new_value wherever a value that isn't null would change."""
    o = old.select(*keys, *[F.col(c).cast("string").alias(f"_o_{c}") for c in cols])
    n = new.select(*keys, *[F.col(c).cast("string").alias(f"_n_{c}") for c in cols])
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"_o_{c}").alias("old_value"), F.col(f"_n_{c}").alias("new_value")) for c in cols])
    changed = F.filter(pairs, lambda p: p["old_value"].isNotNull() & p["new_value"].isNotNull() & (p["old_value"] != p["new_value"]))
    return o.join(n, keys).select(*keys, F.explode(changed).alias("c")).select(*keys, "c.*")


def with_overrides(df: DataFrame, overrides: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """df with cols replaced where a small table of overrides has a value for the keys."""
    o = overrides.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in cols])
    joined = df.join(o, keys, "left")
    return joined.select(*[F.coalesce(f"_o_{c}", c).alias(c) if c in cols else F.col(c) for c in df.columns])


def enrich(df: DataFrame, side: DataFrame, keys: list[str], col: str, force: bool = False) -> DataFrame:
    """df with col taken from side where it differs (or always, with force); changed says where."""
    s = side.select(*keys, F.col(col).alias("_new"))
    changed = F.col("_new").isNotNull() & (F.lit(force) | ~F.col(col).eqNullSafe(F.col("_new")))
    return df.join(s, keys, "left").withColumn("changed", changed).withColumn(col, F.when(F.col("changed"), F.col("_new")).otherwise(F.col(col))).drop("_new")


def zip_sources(df: DataFrame, keys: list[str], items: str, scores: str) -> DataFrame:
    """A row for each item with the score at the same place (null if there are fewer); a row without items
    gives one row with nulls."""
    pairs = F.transform(F.col(items), lambda x, i: F.struct(x.alias("item"), F.get(F.col(scores), i).alias("score")))
    return df.select(*keys, F.posexplode_outer(pairs).alias("pos", "p")).select(*keys, "pos", "p.item", "p.score")


def reconcile(frames: dict[str, DataFrame], id_col: str) -> DataFrame:
    """One row: rows of each frame, whether all agree, and how many ids not all of them hold."""
    marked = [f.select(F.col(id_col).alias("_id"), F.lit(name).alias("_t")) for name, f in frames.items()]
    every = reduce(DataFrame.unionByName, marked)
    per_id = every.groupBy("_id").agg(F.count_distinct("_t").alias("k"), *[F.count_if(F.col("_t") == n).alias(n) for n in frames])
    counts = [F.coalesce(F.sum(n), F.lit(0)).alias(f"n_{n}") for n in frames]
    out = per_id.agg(*counts, F.count_if(F.col("k") < len(frames)).alias("n_unmatched"))
    first = f"n_{next(iter(frames))}"
    return out.withColumn("consistent", reduce(lambda a, b: a & b, [F.col(first) == F.col(f"n_{n}") for n in frames]) & (F.col("n_unmatched") == 0))
