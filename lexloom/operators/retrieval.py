"""Exact retrieval for tables of queries: blocks of query vectors against all rows, ranked and selected."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.vectors import embed_table, vector_fault
from lexloom.session import materialize, small

from .filters import apply_filters

#: So many queries at most are broadcast, and so many bytes of their vectors; more of them meet the corpus by a
#: shuffle, in groups of this size.
BROADCAST_QUERIES, BROADCAST_BYTES = 16_384, 1 << 26
#: Pairs of a query and a row that a tile holds at most, and tiles for each shuffle partition below that.
PAIRS_OF_TILE, TILES_PER_TASK = 1 << 32, 2
#: Queries and rows of one matrix product, and candidates that a task holds before it cuts them to the best k.
QUERIES_AT_ONCE, ROWS_AT_ONCE, CANDIDATES = 512, 512, 1 << 18
DIGITS = 6
#: Terms of so many characters or less are not retrieved by, unless they have weights.
SHORT_TERM = 2


class _Best:
    """The k best rows of each query among all rows seen: by score, then by id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, ks: np.ndarray):
        self.ids, self.vectors, self.ks = ids, vectors, ks
        self.least = np.full(len(ids), -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = self.kept = 0

    def add(self, chunk_ids: np.ndarray, rows: np.ndarray, which: np.ndarray | None = None) -> None:
        """Score rows with the queries at the places `which`, with all if it is None."""
        which = np.arange(len(self.ids)) if which is None else which
        for i in range(0, len(rows), ROWS_AT_ONCE):
            for j in range(0, len(which), QUERIES_AT_ONCE):
                asked = which[j : j + QUERIES_AT_ONCE]
                scores = rows[i : i + ROWS_AT_ONCE] @ self.vectors[asked].T
                np.round(scores, DIGITS, out=scores)
                good, k = scores >= self.least[asked], int(self.ks[asked].max())
                if k < len(scores) and np.count_nonzero(good) > 2 * k * len(asked):  # the k best of these rows, and their ties, will do
                    good &= scores >= np.partition(scores, len(scores) - k, axis=0)[len(scores) - k]
                at, own = np.nonzero(good)
                self.held.append((asked[own], scores[at, own], chunk_ids[at + i]))
                self.n += len(at)
                if self.n > CANDIDATES + 2 * self.kept:
                    self._cut()

    def _cut(self) -> None:
        own, score, chunk = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((chunk, -score, own))
        own, score, chunk = own[order], score[order], chunk[order]
        starts = np.searchsorted(own, np.arange(len(self.ids)))
        place = np.arange(len(own)) - starts[own]
        last = place == self.ks[own] - 1
        self.least[own[last]] = score[last]
        keep = place < self.ks[own]
        self.held = [(own[keep], score[keep], chunk[keep])]
        self.n = self.kept = int(keep.sum())

    def rows(self, chunk_type: pa.DataType):
        if self.held:
            self._cut()
            own, score, chunk = self.held[0]
            for k in range(0, len(own), 1 << 16):
                part = slice(k, k + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(self.ids[own[part]]), pa.array(chunk[part], chunk_type), pa.array(score[part])], ["query_id", "chunk_id", "score"])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _ids(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _near_few(corpus: DataFrame, asked: pa.Table, dim: int, scoped: bool) -> DataFrame:
    """Few queries: their vectors are broadcast and the corpus is not shuffled. Of a batch only the rows with a
    value that some query asks for are scored, value by value, each with the queries that ask for it."""
    values = asked.column("value").to_pylist()
    names = sorted({v for v in values if v is not None})
    code = {v: i for i, v in enumerate(names)}
    codes = np.array([-1 if v is None else code[v] for v in values], np.int64)
    queries = [np.flatnonzero(codes == c) for c in range(-1, len(names))] if len(names) < 64 else np.split(np.argsort(codes, kind="stable"), np.searchsorted(np.sort(codes), np.arange(len(names))))
    held = (_ids(asked.column("query_id")), _matrix(asked.column("vec").combine_chunks(), dim), _ids(asked.column("k")).astype(np.int64))
    shared = corpus.sparkSession.sparkContext.broadcast((held, queries, names))

    def run(batches):
        (ids, vectors, ks), queries, names = shared.value
        best, kind, known = _Best(ids, vectors, ks), pa.int64(), pa.array(names, pa.string())
        for batch in batches:
            kind = batch.schema.field(0).type
            chunk_ids = _ids(batch.column(0))
            if len(queries[0]):
                best.add(chunk_ids, _matrix(batch.column(1), dim), queries[0])
            if names:
                own = _ids(pc.fill_null(pc.index_in(batch.column(2), value_set=known), -1))
                order = np.argsort(own, kind="stable")
                order = order[own[order] >= 0]
                rows = _matrix(batch.column(1).take(pa.array(order)), dim)
                edges = np.flatnonzero(np.diff(own[order], prepend=-1, append=-1))
                for a, b in zip(edges, edges[1:], strict=False):
                    best.add(chunk_ids[order[a:b]], rows[a:b], queries[own[order[a]] + 1])
        yield from best.rows(kind)

    columns = ["chunk_id", "vec", "value"] if scoped else ["chunk_id", "vec"]
    return corpus.select(*columns).mapInArrow(run, f"query_id bigint, chunk_id {corpus.schema['chunk_id'].dataType.simpleString()}, score double")


def _tile_plan(rows: DataFrame, asked: DataFrame, most: int) -> DataFrame:
    """For each value that is asked for: code, groups of queries and parts of rows.

    Every query goes to the parts, every row to the groups of its value, so asks * parts + held * groups rows are
    shuffled; with a given number of tiles that is least when groups / parts = asks / held. A value has tiles by its
    pairs, so that one with a third of all rows is split like any other.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = rows.groupBy("value").agg(F.count(F.lit(1)).cast("double").alias("held"))
    asks = asked.groupBy(F.col("value").alias("_value")).agg(F.count(F.lit(1)).cast("double").alias("asks"))
    plan = materialize(asks.join(held, F.col("value").eqNullSafe(F.col("_value"))).select("value", "asks", "held", F.monotonically_increasing_id().alias("code")))
    pairs = plan.agg(F.sum(F.col("asks") * F.col("held"))).first()[0] or 1.0
    size = max(1.0, min(float(PAIRS_OF_TILE), pairs / (TILES_PER_TASK * tasks)))
    tiles = F.ceil(F.col("asks") * F.col("held") / size).cast("double")
    groups = F.greatest(F.ceil(F.col("asks") / most).cast("double"), F.round(F.sqrt(tiles * F.col("asks") / F.col("held"))), F.lit(1.0))
    plan = plan.withColumn("groups", F.least(groups, "asks").cast("int"))
    return plan.withColumn("parts", F.least(F.ceil(tiles / F.col("groups")).cast("double"), F.col("held")).cast("int"))


def _near_many(rows: DataFrame, asked: DataFrame, most: int, dim: int) -> DataFrame:
    """Many queries: each pair of a group of queries and a part of the rows of one value is a tile. A task holds
    one group and streams one part, and the queries never pass the driver."""
    kind = rows.schema["chunk_id"].dataType
    plan = _tile_plan(rows, asked, most)
    small_plan = small(plan.withColumnRenamed("value", "_value"))
    q = asked.join(small_plan, F.col("value").eqNullSafe(F.col("_value"))).withColumn("g", F.pmod(F.xxhash64("query_id"), F.col("groups")).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    c = rows.join(small_plan, F.col("value").eqNullSafe(F.col("_value"))).withColumn("p", F.pmod(F.xxhash64("chunk_id", "vec"), F.col("parts")).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    tile = ["code", "g", "p"]
    met = q.select(*tile, F.lit(0).alias("row"), "query_id", "k", F.lit(None).cast(kind).alias("chunk_id"), "vec").unionByName(
        c.select(*tile, F.lit(1).alias("row"), F.lit(0).cast("long").alias("query_id"), F.lit(0).alias("k"), "chunk_id", "vec")
    )

    def run(batches):
        now, asks, best, chunk_type = None, [], None, pa.int64()
        for batch in batches:
            chunk_type = batch.schema.field(6).type
            if not batch.num_rows:
                continue
            keys = np.stack([_ids(batch.column(i)).astype(np.int64) for i in range(4)])
            edges = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)])).tolist()
            for a, b in zip(edges, [*edges[1:], batch.num_rows], strict=True):
                part, here = batch.slice(a, b - a), tuple(keys[:3, a])
                if here != now:
                    if best is not None:
                        yield from best.rows(chunk_type)
                    now, asks, best = here, [], None
                if keys[3, a] == 0:
                    asks.append((_ids(part.column(4)), _matrix(part.column(7), dim), _ids(part.column(5)).astype(np.int64)))
                elif asks:
                    best = best or _Best(*(np.concatenate(x) for x in zip(*asks, strict=True)))
                    best.add(_ids(part.column(6)), _matrix(part.column(7), dim))
        if best is not None:
            yield from best.rows(chunk_type)

    dealt = met.repartition(*tile).sortWithinPartitions(*tile, "row")
    return dealt.mapInArrow(run, f"query_id bigint, chunk_id {kind.simpleString()}, score double")


def ranked(scored: DataFrame, by: list[str], *ties: Column | str) -> DataFrame:
    """Adds rank, from 0, by score descending and then the ties."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), *ties)
    return scored.withColumn("rank", F.row_number().over(order) - 1)


def top_k(queries: DataFrame, corpus: DataFrame, k: int | None = None, filters: dict | None = None, dim: int = 64, scope: str | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank of the k best rows of each query.

    queries: query_id (long, unique), vec, and k where k is not given; corpus: chunk_id, vec and the columns of
    filters and scope. Rows are filtered before they are scored; vectors that are unusable, and queries with a k
    below 1, are left out. With a scope, queries hold an array of strings in the column of that name, and a query is
    only scored with the corpus rows that have one of its values there; a null or empty array asks for all rows, and
    nulls within it for none.

    Each task keeps its k best rows per query over all its batches, ties cut by id, and only these are ranked. Up
    to BROADCAST_QUERIES queries (BROADCAST_BYTES of vectors) are broadcast; more of them meet the corpus in tiles by
    one shuffle and never pass the driver. Either way the rows of other values are never scored.
    """
    limit = (F.lit(k) if k is not None else F.col("k")).cast("int").alias("k")
    asked = queries.where(vector_fault("vec", dim).isNull()).select("query_id", "vec", limit, *([scope] if scope else [])).where("k > 0")
    rows = apply_filters(corpus, filters or {}).where(vector_fault("vec", dim).isNull()).select("chunk_id", "vec", (F.col(scope).cast("string") if scope else F.lit(None).cast("string")).alias("value"))
    limits = asked.select(F.col("query_id").alias("_q"), F.col("k").alias("_k"))
    values = F.array_distinct(F.filter(F.col(scope).cast("array<string>"), lambda v: v.isNotNull())) if scope else None
    every = F.array(F.lit(None).cast("string"))
    asked = asked.select("query_id", "vec", "k", F.explode(F.when(F.size(scope) > 0, values).otherwise(every)).alias("value")) if scope else asked.withColumn("value", F.lit(None).cast("string"))
    most = max(1, min(BROADCAST_QUERIES, BROADCAST_BYTES // (8 * dim)))
    few = asked.limit(most + 1).toArrow()
    if few.num_rows <= most:
        scored = _near_few(rows, few, dim, scope is not None)
    else:
        asked = materialize(asked)
        whole, own = (asked.where(c) for c in ("value is null", "value is not null"))
        scored = _near_many(rows.withColumn("value", F.lit(None).cast("string")), whole, most, dim)
        if scope:
            scored = scored.unionByName(_near_many(rows.where("value is not null"), own, most, dim))
    best = ranked(scored, ["query_id"], "chunk_id")
    if k is not None:
        return best.where(F.col("rank") < k)
    return best.join(limits, F.col("query_id") == F.col("_q")).where(F.col("rank") < F.col("_k")).drop("_q", "_k")


def with_fallback(scored: DataFrame, threshold: float | Column, min_return: int | Column = 3, max_return: int | Column | None = None, by: str = "query_id") -> DataFrame:
    """Rows at or above the threshold; of queries with fewer than min_return of them the best min_return
    rows; never more than max_return. Limits may be columns, as each query's route has its own. Adds rank and
    filtering_reason. One window, one filter."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), "chunk_id")
    whole = Window.partitionBy(by)
    least = 3 if isinstance(min_return, int) and not min_return else min_return
    passed = F.count_if(F.col("score") >= threshold).over(whole)
    rows = scored.withColumn("rank", F.row_number().over(order) - 1).withColumn("_enough", passed >= least)
    keep = F.when(F.col("_enough"), F.col("score") >= threshold).otherwise(F.col("rank") < least)
    if max_return is not None:
        keep = keep & (F.col("rank") < max_return)
    return rows.where(keep).withColumn("filtering_reason", F.when(F.col("_enough"), "threshold").otherwise("min_return_fallback")).drop("_enough")


def retrieve(queries: DataFrame, corpus: DataFrame, k: int = 5, filters: dict | None = None, threshold: float = 0.2, min_return: int = 3, max_return: int | None = None, dim: int = 64) -> DataFrame:
    """The whole retrieval: filter, score, top k, threshold with fallback."""
    if k <= 0 or threshold < 0 or (max_return is not None and max_return < min_return) or min_return > k:
        raise ValueError("k must be positive, threshold not negative, and min_return within k and max_return")
    return with_fallback(top_k(queries, corpus, k, filters, dim), threshold, min_return, max_return)


def keep_best(scored: DataFrame, by: list[str], *ties: Column | str) -> DataFrame:
    """One row for each key: the one with the best score, then the ties; keys that are null or empty go."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), *ties)
    known = scored.where(F.col(by[-1]).isNotNull() & (F.col(by[-1]).cast("string") != ""))
    return known.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def prefer(kind: str, last: str) -> Column:
    """Sort key that puts one kind of source behind the others."""
    return F.when(F.col(kind) == last, 1).otherwise(0)


def retrieve_terms(
    terms: DataFrame, corpus: DataFrame, k: int, threshold: float, min_return: int, max_return: int | None, weighted: bool, kind: str, last: str, dim: int = 64, scope: str | None = None
) -> DataFrame:
    """Retrieval by several terms of each query, merged.

    terms: query_id, term_id, term_rank, weight, vec, and perhaps term, the words themselves: terms of two
    characters or less fetch nothing without weights. A term_id stands for one vector. Each term fetches its k best
    rows (of the values in its scope, see top_k), once for all queries that ask for it with the same scope; with
    weights a score is boosted by exp(2 weight). Of a row found by several terms the best score stays, the earlier
    term on a tie. Rows go by score, then those of kind `last` come last, then by id; the threshold and its
    fallback apply to the merged (boosted) scores.
    """
    if not weighted and "term" in terms.columns:
        terms = terms.where(F.length("term") > SHORT_TERM)
    scoped = [F.array_sort(scope).alias("_scope")] if scope else []
    own = materialize(terms.select("query_id", F.col("term_id").alias("_id"), "term_rank", "weight", "vec", *scoped))
    keys = ["_id", *(["_scope"] if scope else [])]
    lists = materialize(own.groupBy(*keys).agg(F.first("vec").alias("vec")).withColumn("_list", F.monotonically_increasing_id()))
    asked = lists.select(F.col("_list").alias("query_id"), "vec", *([F.col("_scope").alias(scope)] if scope else []))
    found = top_k(asked, corpus, k, None, dim, scope).drop("rank").withColumnRenamed("query_id", "_list")
    same = F.col("o._id") == F.col("l._id")
    same = same & F.col("o._scope").eqNullSafe(F.col("l._scope")) if scope else same
    listed = own.drop("vec").alias("o").join(lists.drop("vec").alias("l"), same).select("query_id", F.col("o._id").alias("term_id"), "term_rank", "weight", "_list")
    boost = F.exp(2 * F.col("weight")) if weighted else F.lit(1.0)
    scored = found.join(listed, "_list").drop("_list").withColumn("boost_factor", F.round(boost, DIGITS)).withColumn("score", F.round(F.col("score") * boost, DIGITS))
    best = keep_best(scored, ["query_id", "chunk_id"], "term_rank")
    picked = with_fallback(best, threshold, min_return, max_return).drop("rank")
    kinds = corpus.select(F.col("chunk_id").alias("_c"), F.col(kind))
    named = picked.join(kinds, F.col("chunk_id") == F.col("_c")).drop("_c")
    return ranked(named, ["query_id"], prefer(kind, last), "chunk_id").select("query_id", "chunk_id", "term_id", "boost_factor", "score", "rank", "filtering_reason")


def expand_ranked(queries: DataFrame, terms: DataFrame, threshold: float = 0.3, n: int = 20, dim: int = 64) -> DataFrame:
    """The n best terms of each query at or above the threshold; a query without any stands for itself with
    similarity 1. queries: query_id, vec; terms: chunk_id (the term's id), vec. Gives query_id, term_id, similarity."""
    near = top_k(queries, terms, n, None, dim).where(F.col("score") >= threshold).select("query_id", F.col("chunk_id").alias("term_id"), F.col("score").alias("similarity"))
    every = queries.select("query_id")
    return every.join(near, "query_id", "left").select("query_id", F.col("term_id"), F.coalesce("similarity", F.lit(1.0)).alias("similarity"))


def score_stats(scored: DataFrame, by: str = "query_id") -> DataFrame:
    s = F.col("score")
    r = lambda c: F.round(c, DIGITS)
    return scored.groupBy(by).agg(
        F.count(s).alias("n"), r(F.avg(s)).alias("mean_score"), r(F.stddev_pop(s)).alias("std_score"), F.min(s).alias("min_score"), F.max(s).alias("max_score"), r(F.median(s)).alias("median_score")
    )


def adaptive_k(question: Column, broad: tuple[str, ...], creative: tuple[str, ...] = (), k: tuple[int, int, int] = (15, 10, 5)) -> Column:
    """How many rows a question asks for, by trigger words anywhere in it."""
    low = F.lower(question)
    some = lambda ws: F.coalesce(low.rlike("|".join(ws)), F.lit(False)) if ws else F.lit(False)
    return F.when(some(broad), k[0]).when(some(creative), k[1]).otherwise(k[2])


def retrieve_texts(questions: DataFrame, corpus: DataFrame, model: str | None = None, dim: int = 64, **options) -> DataFrame:
    """retrieve() for questions given as text (query_id, question): they are embedded like the corpus was."""
    asked = embed_table(questions.select("query_id", "question"), "question", model, dim=dim).withColumnRenamed("embedding", "vec")
    return retrieve(asked.select("query_id", "vec"), corpus, dim=dim, **options)


def similarity_map(expansions: DataFrame, digits: int = 4) -> DataFrame:
    """query_id and a map from term to similarity, for the audit record. Similarities are rounded in binary arithmetic,
    as numpy and SQL engines do: F.round takes their shortest decimals, which turns more of the halves up."""
    near = F.round(F.col("similarity") * 10**digits, 0) / 10**digits
    pairs = F.array_sort(F.collect_list(F.struct(F.col("term_id").cast("string").alias("term"), near.alias("s"))))
    known = expansions.where(F.col("term_id").isNotNull())
    return known.groupBy("query_id").agg(F.map_from_entries(pairs).alias("similarities"))


def ranked_intersection(expanded: DataFrame, scored: DataFrame, n: int | None = None) -> DataFrame:
    """The terms of an expansion (query_id, term_id) that were also scored (query_id, term_id, similarity), best first."""
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "term_id")
    both = scored.join(expanded.select("query_id", "term_id").distinct(), ["query_id", "term_id"], "left_semi")
    out = both.withColumn("rank", F.row_number().over(order) - 1)
    return out.where(F.col("rank") < n) if n is not None else out
