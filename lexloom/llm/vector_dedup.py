"""Embedding near-duplicates by cross-polytope hashing: rotations, probed buckets, verified pairs."""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table
from .components import components
from .simhash import _join_labels

#: Hash tables, and alternatives of each hash function that probes choose among.
TABLES, ALTERNATIVES = 6, 6
#: A bucket with more vectors than this is dealt out as pairs of parts.
PART = 2048
#: Rows and columns of one product of vectors, and rows of a bucket whose pairs are listed instead.
TILE, FEW = 1024, 64
#: Vectors hashed at a time.
VECTORS_AT_ONCE = 1024
#: Cosines so close to the threshold are computed once more, in the order of the components.
CLOSE = 1e-9
SEED = 7


def width_for(n: int, dim: int) -> int:
    """Hash functions in a bucket's key: so many that there are more buckets than vectors, 2 at least and 4 at most."""
    return next((k for k in (2, 3) if (2 * dim) ** k >= 2 * n), 4)


def probes_for(width: int) -> int:
    """Buckets of a vector in each table, its own included; each further hash function takes three times as many."""
    return 4 * 3 ** (width - 2)


def _padded(dim: int) -> int:
    return 1 << max(0, dim - 1).bit_length()


def rotate(v: np.ndarray, table_: int, function: int) -> np.ndarray:
    """Pseudo-random rotation of each row: three times random signs and a fast Hadamard transform. Columns must be a power
    of two. Only sums and products of single numbers, so a vector has the same result in whatever batch it comes."""
    n, dim = v.shape
    draw = np.random.default_rng([SEED, table_, function, dim])
    for _ in range(3):
        v = v * draw.choice([-1.0, 1.0], dim)
        half = 1
        while half < dim:
            pairs = v.reshape(n, -1, 2, half)
            v = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(n, dim)
            half *= 2
        v = v / np.sqrt(dim)
    return v


def bucket_keys(unit: np.ndarray, width: int, tables: int = TABLES, probes: int | None = None) -> np.ndarray:
    """Keys of the buckets of each row, (rows, tables, probes), its own bucket first.

    A hash function gives the vertex of the cross-polytope next to the rotated vector: the largest coordinate and
    its sign. A key joins `width` of them and the table. Probes exchange vertices for the next largest ones, those
    first that lose the least in squared size.
    """
    n, dim = len(unit), _padded(unit.shape[1])
    probes = probes or probes_for(width)
    v = np.zeros((n, dim))
    v[:, : unit.shape[1]] = unit
    most = min(ALTERNATIVES, dim)
    choices = np.array(list(product(range(most), repeat=width)))
    choices = choices[np.argsort(choices.sum(1), kind="stable")]
    probes = min(probes, len(choices))
    keys = np.zeros((n, tables, probes), np.int64)
    for t in range(tables):
        lost, vertex = np.zeros((n, len(choices))), np.full((n, len(choices)), t, np.int64)
        for k in range(width):
            r = rotate(v, t, k)
            size = np.abs(r)
            top = np.argsort(-size, axis=1, kind="stable")[:, :most]
            best = np.take_along_axis(size, top, 1)
            own = 2 * top + (np.take_along_axis(r, top, 1) < 0)
            lost += (best[:, :1] ** 2 - best**2)[:, choices[:, k]]
            vertex = vertex * (2 * dim) + own[:, choices[:, k]]
        chosen = np.argsort(lost, axis=1, kind="stable")[:, :probes]
        keys[:, t] = np.take_along_axis(vertex, chosen, 1)
    return keys


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)  # keeps squares within range
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _by_length(column: pa.ListArray):
    """(rows, matrix) of the vectors of each length."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        yield at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), n)


def _keys(reps: DataFrame, width: int) -> DataFrame:
    """rep, dim, key, home: a row for each bucket of each vector; home marks its own bucket of each table."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, VECTORS_AT_ONCE):
                part = batch.slice(at, VECTORS_AT_ONCE)
                ids = part.column(0).to_numpy()
                for rows, vectors in _by_length(part.column(1)):
                    keys = bucket_keys(_unit(vectors), width)
                    each = keys.shape[1] * keys.shape[2]
                    home = np.zeros(keys.shape, bool)
                    home[:, :, 0] = True
                    columns = (np.repeat(ids[rows], each), np.full(keys.size, vectors.shape[1], np.int32), keys.ravel(), home.ravel())
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["rep", "dim", "key", "home"])

    return reps.select("rep", "vec").mapInArrow(run, "rep bigint, dim int, key bigint, home boolean")


class _Cells:
    """Rows of whole cells, sorted: their vectors and what is needed to count each linked pair once."""

    def __init__(self, t: pa.Table, threshold: float, width: int):
        self.rep, self.key, self.times = (t.column(c).to_numpy() for c in ("rep", "key", "times"))
        self.home, self.part = t.column("home").to_numpy(), t.column("part").to_numpy()
        vectors = t.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(self.rep), -1)
        self.unit, self.threshold, self.width = _unit(vectors), threshold, width
        i, j = (t.column(c).to_numpy() for c in ("i", "j"))
        self.across = i != j  # only pairs of the one part with the other count
        change = np.any([k[1:] != k[:-1] for k in (self.key, i, j)], axis=0)
        self.begin = np.concatenate([[0], np.flatnonzero(change) + 1, [len(self.rep)]])

    def pairs(self):
        """Index pairs with a home in the cell and a cosine at or above the threshold, in parts of bounded size."""
        sizes = np.diff(self.begin)
        few = np.repeat(sizes <= FEW, sizes)
        cell = np.repeat(np.arange(len(sizes)), sizes)
        for step in range(1, min(FEW, int(sizes.max(initial=0)))):
            counted = ~self.across[:-step] | (self.part[:-step] != self.part[step:])
            a = np.flatnonzero(few[:-step] & (cell[:-step] == cell[step:]) & counted & (self.home[:-step] | self.home[step:]))
            for at in range(0, len(a), 1 << 16):
                x = a[at : at + (1 << 16)]
                yield self._close(x, x + step, (self.unit[x] * self.unit[x + step]).sum(1))
        for c in np.flatnonzero(sizes > FEW):
            own = np.arange(self.begin[c], self.begin[c + 1])
            first = own[self.part[own] == self.part[own[0]]]
            second = own[len(first) :]  # sorted by part
            if not self.across[own[0]]:
                tiles = [(first[i : i + TILE], first[j : j + TILE]) for i in range(0, len(first), TILE) for j in range(i, len(first), TILE)]
            else:
                tiles = [(first[i : i + TILE], second[j : j + TILE]) for i in range(0, len(first), TILE) for j in range(0, len(second), TILE)]
            for x, y in tiles:
                cosines = self.unit[x] @ self.unit[y].T
                near = (cosines >= self.threshold - CLOSE) & (self.home[x][:, None] | self.home[y][None, :])
                a, b = np.nonzero(near)
                value = cosines[a, b]
                a, b = x[a], y[b]
                yield self._close(a[a < b], b[a < b], value[a < b])

    def _close(self, a, b, cosines):
        keep = cosines >= self.threshold - CLOSE
        a, b, cosines = a[keep], b[keep], cosines[keep]
        edge = np.flatnonzero(np.abs(cosines - self.threshold) < CLOSE)
        if len(edge):
            cosines = cosines.copy()
            cosines[edge] = reduce(np.add, (self.unit[a[edge]] * self.unit[b[edge]]).T)
        keep = cosines >= self.threshold
        return a[keep], b[keep]

    def first_met(self, a, b):
        """Of linked pairs those that meet here for the first time, by table and then by key."""
        rows, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        keys = np.concatenate([bucket_keys(self.unit[rows[i : i + VECTORS_AT_ONCE]], self.width) for i in range(0, len(rows), VECTORS_AT_ONCE)]) if len(rows) else np.zeros((0, 1, 1), np.int64)
        x, y, here = at[: len(a)], at[len(a) :], self.key[a]
        first = np.ones(len(a), bool)
        table_here = here // (2 * _padded(self.unit.shape[1])) ** self.width
        for t in range(keys.shape[1]):
            for p, q in ((x, y), (y, x)):
                met = (keys[q, t] == keys[p, t, :1]).any(1)  # in p's own bucket
                first &= ~(met & ((t < table_here) | ((t == table_here) & (keys[p, t, 0] < here))))
        return a[first], b[first]

    def links(self) -> pa.RecordBatch:
        """a, b, n: of each row with a link its root in the cell, and how many rows it is linked with first here."""
        labels, n = np.arange(len(self.rep)), np.zeros(len(self.rep), np.int64)
        for a, b in self.pairs():
            _join_labels(labels, a, b)
            for at in range(0, len(a), 1 << 17):
                x, y = self.first_met(a[at : at + (1 << 17)], b[at : at + (1 << 17)])
                np.add.at(n, x, self.times[y])
                np.add.at(n, y, self.times[x])
        while not np.array_equal(labels, labels[labels]):
            labels = labels[labels]
        linked = np.flatnonzero((labels != np.arange(len(labels))) | (n > 0))
        return pa.RecordBatch.from_arrays([pa.array(self.rep[linked]), pa.array(self.rep[labels[linked]]), pa.array(n[linked])], ["a", "b", "n"])


def similar_vectors(reps: DataFrame, threshold: float, width: int) -> DataFrame:
    """a, b, n of reps (rep, vec, times): for each vector with a link in a cell the root of its links there, and the
    rows (times) it is linked with for the first time there.

    Buckets are counted by their keys alone. Vectors join only the buckets where they can be compared: two or more
    vectors, and one of them at home. A pair is compared where one is at home. Buckets above PART are dealt out as
    pairs of parts, so that no task holds more than two parts and no pair is left out; pairs never leave their task.
    """
    keys = materialize(_keys(reps, width))
    crowds = keys.groupBy("dim", "key").agg(F.count(F.lit(1)).alias("members"), F.count_if("home").alias("homes")).where("members > 1 and homes > 0")
    met = keys.join(materialize(crowds), ["dim", "key"]).where(F.col("home") | (F.col("homes") > 0))
    parts = F.ceil(F.col("members") / PART).cast("int")
    met = met.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    cells = met.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.select("rep", "dim", "key", "home", "part", F.least("part", "q").alias("i"), F.greatest("part", "q").alias("j"))
    placed = cells.join(reps, "rep")

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < 1 << 13:
                continue
            t = pa.Table.from_batches(held)
            names = [t.column(c).to_numpy() for c in ("dim", "key", "i", "j")]
            ends = np.flatnonzero(np.any([k[1:] != k[:-1] for k in names], axis=0))
            if len(ends):  # all cells but the last are whole
                cut = int(ends[-1]) + 1
                yield from judged(t.slice(0, cut))
                held, rows = t.slice(cut).to_batches(), t.num_rows - cut
        if held:
            yield from judged(pa.Table.from_batches(held))

    def judged(t: pa.Table):
        dims = t.column("dim").to_numpy()
        edges = [0, *(np.flatnonzero(dims[1:] != dims[:-1]) + 1).tolist(), len(dims)]
        for a, b in zip(edges, edges[1:], strict=False):
            yield _Cells(t.slice(a, b - a), threshold, width).links()

    ordered = placed.repartition("dim", "key", "i", "j").sortWithinPartitions("dim", "key", "i", "j", "part", "rep")
    return ordered.mapInArrow(run, "a bigint, b bigint, n bigint")


def usable(vec: Column) -> Column:
    """Not null, not empty, all components finite and not all of them zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vec.isNotNull() & F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, width: int | None = None) -> DataFrame:
    """id_col, n_links, component_id, kept of each row of vectors.

    Two rows are linked if their cosine, in double precision, is at least threshold (above 0). n_links counts the
    other rows linked directly; component_id is the smallest id reachable by links, the own one included (null only
    where no reachable row has an id); kept says that it equals the own id. Vectors that are null, empty, zero or
    hold null or non-finite components are linked with nothing, nor are vectors of different lengths.

    Equal vectors stand for one another in all comparisons, so groups of copies of any size cost one. Others are
    candidates when one probes the other's own bucket in one of TABLES tables. All candidates are verified, so no
    link is wrong; pairs at the very threshold are missed with a probability of some 6 in 100,000 at 64 components,
    closer ones far less often. Repeated ids are rows of their own; an empty table gives no rows; other columns
    are not read. width: hash functions in a key, by the number of vectors if not given.
    """
    vec = F.col("vec")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).withColumn("vec", F.when(usable(vec), vec))
    reps = rows.where("vec is not null").groupBy("vec").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("times"))
    reps = materialize(reps.withColumn("rep", F.monotonically_increasing_id()))
    size = reps.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    width = width or width_for(size[0], _padded(size[1] or 1))
    found = materialize(similar_vectors(reps.select("rep", "vec", "times"), threshold, width))
    roots = materialize(components(found.select("a", "b")))
    linked = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    rooted = reps.join(roots, F.col("rep") == F.col("node"), "left").select("rep", "vec", "least_id", "times", F.coalesce("root", "rep").alias("root"))
    least = materialize(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")))
    judged = rooted.join(least, "root").join(linked, "rep", "left")
    judged = judged.select("vec", "component_id", (F.col("times") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    good = rows.where("vec is not null").join(judged, "vec").select("id", "n_links", "component_id")
    alone = rows.where("vec is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return good.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op12_vector_dedup(spark, sf_dir):
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


OP12_SQL = """
with recursive v as (
  select row_number() over () as row, vec_id, embedding::double[] as e,
         embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
           and len(list_filter(embedding, lambda x: x <> 0)) > 0 as good
  from embeddings),
p as materialized (
  select a.row as a, b.row as b, b.vec_id from v a join v b on a.row <> b.row and a.good and b.good and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.95),
r(row, reached) as (select row, row from v union select r.row, p.b from r join p on r.reached = p.a),
c as (select r.row, min(v.vec_id) as component_id from r join v on v.row = r.reached group by 1)
select vec_id, (select count(*) from p where p.a = v.row) as n_links, component_id, vec_id is not distinct from component_id as kept
from v join c using (row)
"""
