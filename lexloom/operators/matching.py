"""Texts against tables of patterns: which labels' patterns occur in each text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lexloom.functions.automaton import BYTES_PER_CHARACTER, Automaton
from lexloom.functions.sieve import Sieve, bits_for, pattern_places
from lexloom.session import materialize

#: Bytes of an automaton that is broadcast; texts meet a larger table of patterns by a join.
SHARD_BYTES = 1 << 26
#: Characters of text that are searched at a time, by an automaton and by a sieve.
TEXT_CHARS, WINDOW_CHARS = 1 << 20, 1 << 18


class _Finder:
    """An automaton and the labels of its patterns."""

    def __init__(self, rows: list[tuple[str, bool, list[str]]]):
        self.automaton = Automaton([r[0] for r in rows], [r[1] for r in rows])
        self.labels = [r[2] for r in rows]

    def __call__(self, texts: list[str | None]) -> list[list[str]]:
        out: list[set[str]] = [set() for _ in texts]
        begin = size = 0
        for i in range(len(texts) + 1):
            if i == len(texts) or (i > begin and size + len(texts[i] or "") > TEXT_CHARS):
                for t, p in zip(*(x.tolist() for x in self.automaton.find([x or "" for x in texts[begin:i]])), strict=True):
                    out[begin + t].update(self.labels[p])
                begin, size = i, 0
            if i < len(texts):
                size += len(texts[i] or "")
        return [sorted(x) for x in out]


def _held(patterns: DataFrame) -> DataFrame:
    known = patterns.where(F.col("pattern").isNotNull() & (F.col("pattern") != "") & F.col("label").isNotNull())
    return known.groupBy("pattern", F.coalesce("bounded", F.lit(False)).alias("bounded")).agg(F.collect_set("label").alias("labels"))


def _sieve(held: DataFrame, n: int, sizes: list[int]) -> Sieve:
    """The sieve of n patterns; of the patterns only its bits pass the driver."""
    bits = bits_for(n)

    def places(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(pattern_places(batch.column(0).to_pylist(), batch.column(1).to_pylist(), bits))], ["at"])

    at = held.select("pattern", "bounded").mapInArrow(places, "at long")
    rows = at.groupBy((F.col("at") / 64).cast("int").alias("i")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("word")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[rows.column("i").to_numpy()] = rows.column("word").to_numpy().view(np.uint64)
    return Sieve(words, sizes)


def find_labels(df: DataFrame, text_col: str, patterns: DataFrame, out: str) -> DataFrame:
    """df without text_col, and in `out` the sorted labels of the patterns in each row's text (an array, empty for none).

    patterns: pattern, bounded, label (strings and a boolean). A pattern counts wherever it occurs, a bounded one only
    between word boundaries, whatever characters it holds itself. Case matters. Null texts hold nothing; null and
    empty patterns are found nowhere; a pattern may have several labels and a label several patterns; rows need no
    id and may repeat.

    The patterns' characters are summed up first. Up to SHARD_BYTES the automaton is broadcast, and rows are matched
    where they are, without a shuffle. Of a larger table only bits of digests are broadcast, at most MOST_BITS of them:
    the windows of a text whose bits are set meet the patterns by a join on the characters, so the result is exact,
    each text is read once however many patterns there are, and the labels of a row are put together by its number.
    """
    spark, rest = df.sparkSession, [c for c in df.columns if c != text_col]
    held = materialize(_held(patterns))
    n, characters, sizes = held.agg(F.count(F.lit(1)), F.sum(F.length("pattern")), F.collect_set(F.length("pattern"))).first()
    size = BYTES_PER_CHARACTER * (characters or 0)
    labelled = StructType([*[f for f in df.schema.fields if f.name != text_col], StructField(out, ArrayType(StringType()))])
    if size <= SHARD_BYTES:
        find = _Finder([(r["pattern"], r["bounded"], r["labels"]) for r in held.toArrow().to_pylist()])
        shared = spark.sparkContext.broadcast(find)

        def near(batches):
            for batch in batches:
                found = shared.value(batch.column(len(rest)).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(pa.string()))], [*rest, out])

        return df.select(*rest, text_col).mapInArrow(near, labelled)

    numbered = materialize(df.withColumn("_row", F.monotonically_increasing_id()))
    sieve = spark.sparkContext.broadcast(_sieve(held, n, sizes))

    def far(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            begin = count = 0
            for i, text in enumerate(texts):
                count += len(text)
                if count > WINDOW_CHARS or i + 1 == len(texts):
                    found = sieve.value.windows(texts[begin : i + 1])
                    windows = [w for _, w in found]
                    yield pa.RecordBatch.from_arrays([pa.array([ids[begin + t] for t, _ in found], pa.int64()), pa.array(windows, pa.string()), pa.array(found.values(), pa.bool_())], ["_row", "pattern", "_free"])
                    begin, count = i + 1, 0

    passed = numbered.where(F.col(text_col).isNotNull()).select("_row", text_col).mapInArrow(far, "_row long, pattern string, _free boolean")
    found = passed.join(held.hint("merge"), "pattern").where(F.col("_free") | ~F.col("bounded")).select("_row", F.col("labels").alias(out))
    joint = found.groupBy("_row").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list(out)))).alias(out))
    empty = F.array().cast("array<string>")
    return numbered.join(joint, "_row", "left").select(*rest, F.coalesce(F.col(out), empty).alias(out))
