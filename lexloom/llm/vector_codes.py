"""Product codes of integer vectors; nearest entries by Walsh-Hadamard coefficients, without floating point."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table
from .vector_dedup import usable

#: Components become whole multiples of 1 / SCALE.
SCALE = 1024
#: Whole components below this stay exact in 64 bits through the transform, the squares and their sum, for parts of up to 64 components.
LARGEST = 1 << 21
#: Vectors compared with a codebook at a time, and coefficients after which entries are eliminated.
VECTORS_AT_ONCE, STEP = 1024, 2
#: Label sums up to this number are broadcast.
BROADCAST_LABELS = 100_000


def sequency_transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of whole rows, zero-padded to a power of two, in the order of sign changes. Squared
    distances of transformed rows are those of the rows times the padded length."""
    n, dim = x.shape
    size = 1 << max(0, dim - 1).bit_length()
    v = np.zeros((n, size), np.int64)
    v[:, :dim] = x
    half = 1
    while half < size:
        pairs = v.reshape(n, -1, 2, half)
        v = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(n, size)
        half *= 2
    row = np.arange(size)
    # row r of the transform changes its sign between columns c and c + 1 if the bits of r meet an odd number of changed bits
    changes = sum((np.bitwise_count(row & (c ^ (c + 1))) & 1).astype(np.int64) for c in range(size - 1)) if size > 1 else row
    return v[:, np.argsort(changes, kind="stable")]


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each point (ties: the lower one) and the squared distance.

    Both are transformed. Squared differences of the first coefficients rank all entries; the full distance of
    the leading one bounds the search. Then coefficient after coefficient is added for the pairs that are left,
    and pairs above the bound are eliminated. All numbers are whole, so ties are exact.
    """
    p, e = sequency_transform(points), sequency_transform(entries)
    size = p.shape[1]
    index, distance = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
    for at in range(0, len(p), VECTORS_AT_ONCE):
        x = p[at : at + VECTORS_AT_ONCE]
        so_far = np.zeros((len(x), len(e)), np.int64)
        done = min(STEP, size)
        for c in range(done):
            so_far += np.square(x[:, c, None] - e[None, :, c])
        bound = np.square(x - e[so_far.argmin(1)]).sum(1)
        row, entry = np.nonzero(so_far <= bound[:, None])
        total = so_far[row, entry]
        while done < size:
            for c in range(done, min(done + STEP, size)):
                total = total + np.square(x[row, c] - e[entry, c])
            done += STEP
            left = total <= bound[row]
            row, entry, total = row[left], entry[left], total[left]
        first = np.searchsorted(row, np.arange(len(x)))  # rows ascend, and entries within a row
        least = np.minimum.reduceat(total, first)
        best = np.flatnonzero(total == least[row])
        index[at : at + len(x)] = entry[best[np.searchsorted(row[best], np.arange(len(x)))]]
        distance[at : at + len(x)] = least // size
    return index, distance


def _whole(vec: Column) -> Column:
    """Components as whole numbers; floor() of a double's product with a power of two is exact."""
    return F.transform(vec, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _sums(coded: DataFrame, books: np.ndarray) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry) -> number and componentwise sums of the vectors' parts assigned to it: one row for each entry."""
    parts, _, width = books.shape
    shared = coded.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        own = shared.value
        sums, counts = np.zeros(own.shape, np.int64), np.zeros(own.shape[:2], np.int64)
        for batch in batches:
            m = _matrix(batch.column(0), parts * width)
            for k in range(parts):
                piece = m[:, k * width : (k + 1) * width]
                entry, _ = nearest(piece, own[k])
                np.add.at(sums[k], entry, piece)
                counts[k] += np.bincount(entry, minlength=own.shape[1])
        k, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(entry), pa.array(counts[k, entry]), pa.array(list(sums[k, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    each = coded.select("v").mapInArrow(run, "part bigint, entry bigint, n bigint, sums array<bigint>")
    total = each.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
    return {(r["part"], r["entry"]): (r["n"], r["sums"]) for r in total.collect()}


def learn_codebooks(whole: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> np.ndarray:
    """(parts, entries, width) from whole (id, v): the vectors of the smallest ids (null last, then by components),
    then rounds of assigning all vectors and replacing each entry by the floor of the mean of what it was assigned."""
    start = whole.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    m = np.array([r["v"] for r in start], np.int64)
    books = np.ascontiguousarray(m.reshape(len(m), parts, -1).transpose(1, 0, 2))
    for _ in range(rounds):
        for (k, entry), (n, sums) in _sums(whole, books).items():
            books[k, entry] = np.array(sums) // n
    return books


def encode(whole: DataFrame, books: np.ndarray) -> DataFrame:
    """id, label, code (two hex digits a part), error (squared distances summed over the parts) of each row of whole."""
    parts, _, width = books.shape
    shared = whole.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        own = shared.value
        for batch in batches:
            m = _matrix(batch.column(2), parts * width)
            got = [nearest(m[:, k * width : (k + 1) * width], own[k]) for k in range(parts)]
            digits = np.stack([g[0] for g in got], 1).astype(np.uint8).tobytes().hex()
            codes = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(sum(g[1] for g in got))], ["id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in whole.schema.fields}
    return whole.select("id", "label", "v").mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error bigint")


def compress(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
) -> DataFrame:
    """id_col, code, error, label_error, codebooks_sha256 of each row of vectors that can be coded.

    Components become floor(1024 x); vectors are cut into equal consecutive parts, and each part is replaced by
    the index of its nearest codebook entry (256 at most, so that two hex digits hold it). Codebooks start with the
    vectors of the smallest ids (null last, ties by components; fewer rows: fewer entries), are learned over all rows
    in `rounds` passes and never hold a fraction. error is the squared distance to the final entries, label_error its
    sum over the rows of the same label (nulls together), codebooks_sha256 the digest of all final components.

    Left out are vectors that are null, empty or hold null or non-finite components, and, as codebooks need one
    length, those of another length than the first row's by id. That length must be a multiple of `parts`, and
    components must be below 2048 in size, as 64 bits would not hold their distances: anything else raises an error.
    A row is assigned by its vector alone, so repeated rows and ids agree. An empty table gives no rows; other columns
    are not read. Each pass sends a row for each entry and task; the driver holds codebooks only.
    """
    if entries > 256:
        raise ValueError("two hex digits hold 256 entries")
    v = F.col(vec_col)
    fine = usable(v) | (v.isNotNull() & (F.size(v) > 0) & F.coalesce(F.forall(v, lambda x: x == 0), F.lit(False)))
    whole = vectors.where(fine).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), _whole(v).alias("v"))
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    first = whole.orderBy(F.col("id").asc_nulls_last(), "v").first()
    if first is None:
        return vectors.sparkSession.createDataFrame([], f"`{id_col}` {kinds[id_col]}, code string, error bigint, label_error bigint, codebooks_sha256 string")
    dim = len(first["v"])
    if dim % parts or dim // parts > 64:
        raise ValueError(f"vectors of {dim} components can't be cut into {parts} parts of 64 components at most")
    in_range = F.forall("v", lambda x: F.abs(x) < LARGEST)
    whole = materialize(whole.where(F.size("v") == dim).withColumn("v", F.when(in_range, F.col("v")).otherwise(F.raise_error(F.lit("a component is 2048 or more in size")))))
    books = learn_codebooks(whole, parts, entries, rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = materialize(encode(whole, books))
    labels = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    labels = F.broadcast(labels) if labels.count() <= BROADCAST_LABELS else labels
    met = coded.join(labels, F.col("label").eqNullSafe(F.col("_label")))
    return met.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_vector_codes(spark, sf_dir):
    return compress(table(spark, sf_dir, "embeddings"))


def _op13_sql(rounds: int = 4) -> str:
    """Whole numbers below 2 ** 53 are exact in double, so distances by inner products are too."""
    nearest_ = """a{r} as materialized (
  select p.row, p.k, p.v, b.j, list_dot_product(p.v, p.v) - 2 * list_dot_product(p.v, b.e) + list_dot_product(b.e, b.e) as d
  from p join b{r} b using (k) qualify row_number() over (partition by p.row, p.k order by d, b.j) = 1)"""
    update = """b{n} as materialized (
  select b.k, b.j, coalesce(m.e, b.e) as e from b{r} b left join (
    select k, j, list(c order by i) as e from (
      select k, j, i, floor(sum(x::hugeint)::double / count(*)) as c from (select k, j, unnest(v) as x, generate_subscripts(v, 1) as i from a{r}) group by k, j, i) group by k, j) m using (k, j))"""
    steps = [part for r in range(rounds) for part in (nearest_.format(r=r), update.format(r=r, n=r + 1))]
    return f"""with w as (
  select row_number() over (order by vec_id nulls last, list_transform(embedding, lambda x: floor(x::double * 1024))) as row, vec_id, label, list_transform(embedding, lambda x: floor(x::double * 1024)) as v
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as materialized (select row, k, v[k * (len(v) // 4) + 1 : (k + 1) * (len(v) // 4)] as v from w, range(4) t(k)),
b0 as materialized (select k, row - 1 as j, v as e from p where row <= 256),
{", ".join([*steps, nearest_.format(r=rounds)])},
h as (select sha256(string_agg(x::bigint::varchar, ',' order by k, j, i)) as digest from (select k, j, unnest(e) as x, generate_subscripts(e, 1) as i from b{rounds})),
c as (select row, string_agg(printf('%02x', j::int), '' order by k) as code, sum(d)::bigint as error from a{rounds} group by row)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, digest as codebooks_sha256 from w join c using (row), h"""


OP13_SQL = _op13_sql()
