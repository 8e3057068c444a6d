"""SimHash near-duplicates: fingerprints, bit-sliced comparison within blocks, components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, numbered, table, unused
from .components import components

SEED = 42
#: Shingles whose bits are counted at a time.
SHINGLES_AT_ONCE = 1 << 16
#: A bucket with more fingerprints than this is dealt out as pairs of parts.
PART = 8192
#: (row, word) entries compared at a time, and planes between two looks at what can be abandoned.
ENTRIES_AT_ONCE = 1 << 15
PLANES_AT_ONCE = 8


def _shingle_hashes(text: str, size: int) -> list[int]:
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, the same white space
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist(), strict=True)]


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """id, fp (long, two's complement) of each row's whole text; texts without words have fp 0."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                out = np.zeros(len(part), np.uint64)
                held: list[int] = []
                owners: list[tuple[int, int]] = []  # (row, hashes)

                def flush(out=out, held=held, owners=owners):
                    if owners:
                        n = np.array([x for _, x in owners])
                        bits = _bit_counts(np.array(held, np.uint64))
                        counts = np.add.reduceat(bits, np.cumsum(n) - n, axis=0, dtype=np.int64)
                        packed = np.packbits(counts * 2 > n[:, None], axis=1, bitorder="little")
                        out[[r for r, _ in owners]] = packed.view(np.uint64).ravel()
                    held.clear(), owners.clear()

                for row, text in enumerate(part.column(1)):
                    hashes = _shingle_hashes(text.as_py(), size)
                    if len(hashes) > SHINGLES_AT_ONCE:
                        all_h = np.array(hashes, np.uint64)
                        counts = sum(_bit_counts(all_h[i : i + SHINGLES_AT_ONCE]).sum(0, dtype=np.int64) for i in range(0, len(all_h), SHINGLES_AT_ONCE))
                        out[row] = np.packbits(counts * 2 > len(all_h), bitorder="little").view(np.uint64)[0]
                    elif hashes:
                        held += hashes
                        owners.append((row, len(hashes)))
                        if len(held) > SHINGLES_AT_ONCE:
                            flush()
                flush()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out.view(np.int64))], ["id", "fp"])

    id_type = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return chosen.mapInArrow(run, f"id {id_type}, fp bigint")


def _join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Make labels (each pointing at its root or on the way there) agree for all pairs a, b."""
    while len(a):
        while True:
            nxt = labels[labels]
            if np.array_equal(nxt, labels):
                break
            labels[:] = nxt
        ra, rb = labels[a], labels[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        labels[np.maximum(ra, rb)] = np.minimum(ra, rb)


def _csa(a, b, c):
    """Carry-save adder: sum and carry of three bit vectors."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def link_groups(fps: np.ndarray, group: np.ndarray, part: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint the position of its root among the linked ones of its group.

    group must be ascending. part holds 0 or 1, or 2 for groups in which all pairs count; otherwise only
    pairs of part 0 with part 1 do. Up to 64 fingerprints of a group make one word of each of 64 bit
    planes. For a row and a word, XOR of the planes with the row's bits gives the differing bits of up to
    64 pairs; carry-save adders count them, and a word whose 64 distances all exceed the radius is
    abandoned. radius is at most 7.
    """
    n = len(fps)
    labels = np.arange(n)
    if n < 2:
        return labels
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.concatenate([begin, [n]]))
    words_of = (sizes + 63) // 64
    word_begin = np.cumsum(words_of) - words_of
    gi = np.repeat(np.arange(len(begin)), sizes)  # group number of each row
    pos = np.arange(n) - begin[gi]
    n_words = int(words_of.sum())
    padded = np.zeros(n_words * 64, np.uint64)
    where = (word_begin[gi] + pos // 64) * 64 + pos % 64
    padded[where] = fps
    row_at = np.full(n_words * 64, -1)
    row_at[where] = np.arange(n)
    planes = np.empty((64, n_words), np.uint64)
    step = 1 << 14
    for k in range(0, n_words, step):
        bits = np.unpackbits(padded[k * 64 : (k + step) * 64].view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
        packed = np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")  # of a single word it is not in C order
        planes[:, k : k + step] = np.ascontiguousarray(packed).view(np.uint64)[:, :, 0]

    own_word = where // 64
    n_later = word_begin[gi] + words_of[gi] - own_word  # words from the row's own to the group's last
    ends = np.cumsum(n_later)
    full = np.uint64(2**64 - 1)
    for low in range(0, int(ends[-1]), ENTRIES_AT_ONCE):
        entry = np.arange(low, min(low + ENTRIES_AT_ONCE, int(ends[-1])))
        row = np.searchsorted(ends, entry, side="right")
        word = own_word[row] + entry - (ends[row] - n_later[row])
        ones = twos = fours = over = np.zeros(len(entry), np.uint64)
        mine = fps[row]
        for b in range(0, 64, 4):
            x = [planes[b + i][word] ^ (np.uint64(0) - ((mine >> np.uint64(b + i)) & np.uint64(1))) for i in range(4)]
            ones, t1 = _csa(ones, x[0], x[1])
            ones, t2 = _csa(ones, x[2], x[3])
            twos, f1 = _csa(twos, t1, t2)
            over = over | (fours & f1)
            fours = fours ^ f1
            if b % PLANES_AT_ONCE == 4 and b >= 12:
                alive = (over | _exceeds(ones, twos, fours, radius)) != full
                if not alive.all():
                    row, word, mine, ones, twos, fours, over = (y[alive] for y in (row, word, mine, ones, twos, fours, over))
                if not len(row):
                    break
        if not len(row):
            continue
        hits = ~(over | _exceeds(ones, twos, fours, radius))
        some = np.flatnonzero(hits)
        for k in range(0, len(some), 4096):
            s = some[k : k + 4096]
            e, bit = np.nonzero(np.unpackbits(hits[s].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            a, b = row[s][e], row_at[word[s][e] * 64 + bit]
            good = (b > a) & ((part[a] == 2) | (part[a] != part[np.maximum(b, 0)]))
            _join_labels(labels, a[good], b[good])
    _join_labels(labels, np.arange(n), labels.copy())
    return labels


def _exceeds(ones: np.ndarray, twos: np.ndarray, fours: np.ndarray, radius: int) -> np.ndarray:
    """Where the count ones + 2 twos + 4 fours is above the radius (0 to 7)."""
    above, equal = np.zeros_like(ones), np.full_like(ones, np.uint64(2**64 - 1))
    for digit, value in ((fours, radius >> 2 & 1), (twos, radius >> 1 & 1), (ones, radius & 1)):
        if value:
            equal = equal & digit
        else:
            above, equal = above | (equal & digit), equal & ~digit
    return above


def block_masks(n_blocks: int, radius: int) -> list[int]:
    """Bit masks of which at least one is untouched by any `radius` differing bits."""
    edges = [64 * i // n_blocks for i in range(n_blocks + 1)]
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, n_blocks - radius)]


def similar_links(distinct: DataFrame, radius: int = 4, n_blocks: int = 0) -> DataFrame:
    """Links a, b between fingerprints (fp, no repeats) that connect all pairs within the radius.

    The bits are cut into n_blocks blocks; two fingerprints within the radius agree on n_blocks - radius
    of them at least, so they meet in a bucket of such a choice. n_blocks follows the number of
    fingerprints, to keep buckets small; every choice finds all pairs. A bucket of more than PART
    fingerprints is dealt out as pairs of parts, so no task takes more than two parts of a bucket. A
    bucket gives a spanning forest of its links, never its pairs.
    """
    n = distinct.count()
    n_blocks = n_blocks or radius + (1 if n < 2_000_000 else 2 if n < 200_000_000 else 3)
    masks = block_masks(n_blocks, radius)
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("t", "key"))
    large = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PART)
    large = materialize(large.select("t", "key", F.ceil(F.col("n") / PART).cast("int").alias("parts")))
    side = F.broadcast(large) if large.count() < 100_000 else large
    dealt = keyed.join(side, ["t", "key"], "left").withColumn("own", F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int"))
    other = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = dealt.withColumn("other", F.explode(other)).select(
        "fp",
        "t",
        "key",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("int").alias("part"),
    )

    def run(batches):
        held: list[pa.RecordBatch] = []

        def link(t: pa.Table):
            keys = [t.column(c).to_numpy() for c in ("t", "key", "i", "j")]
            new = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])
            fps = t.column("fp").to_numpy()
            root = link_groups(fps.view(np.uint64), np.cumsum(new), t.column("part").to_numpy(), radius)
            linked = np.flatnonzero(root != np.arange(len(fps)))
            return pa.RecordBatch.from_arrays([pa.array(fps[linked]), pa.array(fps[root[linked]])], ["a", "b"])

        rows = 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < 1 << 16:
                continue
            t = pa.Table.from_batches(held)
            keys = [t.column(c).to_numpy() for c in ("t", "key", "i", "j")]
            last = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0))
            if len(last):  # all groups but the last are whole
                cut = int(last[-1]) + 1
                yield link(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                rows = t.num_rows - cut
        if held:
            yield link(pa.Table.from_batches(held))

    ordered = dealt.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j", "fp")
    return ordered.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, radius: int = 4) -> DataFrame:
    """id_col, fingerprint (16 hex digits), component_id for each row of docs.

    Texts are lower-cased (A-Z), cut into words and word shingles; null counts as empty, and texts
    without words share the fingerprint zero. Rows whose fingerprints differ in at most `radius` bits are
    linked; component_id is the smallest id reachable (null only where no linked row has an id). Equal
    fingerprints are compared once, so repeated rows and large groups of copies cost nothing; an empty
    table gives no rows; other columns are ignored. Ids may be of any type. A text is hashed whole; a task
    needs some 20 bytes for each byte of its longest text.
    """
    marked = materialize(fingerprints(docs, id_col, text_col, size))
    nodes = materialize(marked.groupBy("fp").agg(F.min("id").alias("least_id")))
    links = materialize(similar_links(nodes.select("fp"), radius))
    roots = materialize(components(links))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component of near-duplicates; same columns.

    The row with the smallest id stays (a null id comes last), and one of those that share this id. Ids may
    be null, repeated or of any type: each row has a number of its own, which takes part in the order and in
    the filter. Null texts and texts without words are near copies of each other; an empty table stays empty.
    """
    row = unused(docs, "_row")
    docs = numbered(docs, row)
    order = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col(row).alias("row"))
    judged = near_duplicates(docs.select(order.alias("key"), F.col(text_col).alias("text")), "key", "text")
    dropped = materialize(judged.where("key.row != component_id.row").select(F.col("key.row").alias(row)))
    side = F.broadcast(dropped) if dropped.count() < 1_000_000 else dropped
    return docs.join(side, row, "left_anti").drop(row)


def op9_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
