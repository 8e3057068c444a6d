"""Importance resampling towards a target distribution over hashed word n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table
from .hashing import runs, small_parts
from .mixing import running

#: Words of lower-cased UTF-8; every byte of a character beyond ASCII belongs to one.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Stands between the texts of a batch: no word holds it, so none reaches from one text into the next.
SENTINEL = b"\n"
#: Bytes of text that are joined at a time; a longer text is a batch by itself.
BATCH_BYTES = 1 << 20
BUCKETS = 10_000
LONGEST = 3


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


_CRC = _crc_table()


def _spaced(crc: np.ndarray) -> np.ndarray:
    """crc32 of the same bytes and one space."""
    register = ~crc
    return ~(_CRC[(register ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (register >> np.uint32(8)))


def ngram_buckets(texts: list[bytes], longest: int = LONGEST, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n from 1 to longest: the buckets of all runs of n words in the texts, and the number of the text of each.

    The texts are joined with sentinels and one pass finds all words. A word's text is found by a binary search
    among the offsets, and runs that reach from one text into another are masked out. A run's crc32 goes on from
    that of the run without its last word.
    """
    data = SENTINEL.join(texts).lower()  # of bytes: A-Z only
    spans = np.fromiter(chain.from_iterable(m.span() for m in WORD.finditer(data)), np.int64).reshape(-1, 2)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + len(SENTINEL))
    text = np.searchsorted(ends, spans[:, 0], side="right")
    words = [data[a:b] for a, b in spans.tolist()]
    crc = np.fromiter(map(crc32, words), np.uint32, len(words))
    yield (crc % np.uint32(buckets)).astype(np.int64), text
    for n in range(2, longest + 1):
        crc = np.fromiter(map(crc32, words[n - 1 :], _spaced(crc[:-1]).tolist()), np.uint32, max(0, len(words) - n + 1))
        within = text[n - 1 :] == text[: len(crc)]
        yield (crc[within] % np.uint32(buckets)).astype(np.int64), text[: len(crc)][within]


def _bytes_of(docs: DataFrame, text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")


def feature_counts(docs: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n of all features of all rows: at most `buckets` rows. Null texts have no features.

    Each task counts by bincount over all its rows and gives its buckets once, so what is shuffled depends on
    the number of tasks and not on the text.
    """

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in small_parts(batch):
                texts = part.column(0).to_pylist()
                for a, b in runs(texts, BATCH_BYTES):
                    for bucket, _ in ngram_buckets(texts[a:b], longest, buckets):
                        total += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    counted = docs.select(_bytes_of(docs, text_col).alias("text")).mapInArrow(run, "bucket bigint, n bigint")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln(target share / raw share)) of each bucket, one added to every count. raw and target as
    feature_counts() gives them; a table without rows or features has equal shares. `buckets` numbers reach the driver."""
    counts = np.zeros((2, buckets), np.float64)
    for k, df in enumerate((raw, target)):
        for r in df.collect():
            counts[k, r["bucket"]] = r["n"]
    s, t = counts
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """id, n_words, n_features, weight (sum of the gains of its features) of each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # one number for each bucket
    buckets = len(gains)

    def run(batches):
        own = shared.value
        for batch in batches:
            for part in small_parts(batch):
                texts = part.column(1).to_pylist()
                for a, b in runs(texts, BATCH_BYTES):
                    words = features = weight = np.zeros(b - a, np.int64)
                    for k, (bucket, text) in enumerate(ngram_buckets(texts[a:b], longest, buckets)):
                        n = np.bincount(text, minlength=b - a)
                        words = n if k == 0 else words
                        features = features + n
                        sums = np.concatenate([[0], np.cumsum(own[bucket])])  # text is ascending
                        weight = weight + np.diff(sums[np.concatenate([[0], np.cumsum(n)])])
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(a, b - a), pa.array(words), pa.array(features), pa.array(weight)], ["id", "n_words", "n_features", "weight"])

    id_type = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("id"), _bytes_of(docs, text_col).alias("text"))
    return chosen.mapInArrow(run, f"id {id_type}, n_words bigint, n_features bigint, weight bigint")


def gumbel_noise(id_: Column, seed: int) -> Column:
    """floor(1000 g) with g a standard Gumbel number fixed by seed and id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    percent: int = 5,
    min_words: int = 20,
    seed: int = 42,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
) -> DataFrame:
    """id_col, n_features, weight, score, rank of each row of docs, whose text is judged whole.

    Features are all runs of 1 to `longest` words, hashed into `buckets`. A row's weight sums the gains of its
    features: how much more of the target's features than of docs' features fall into their buckets. Its score
    adds seeded Gumbel noise, so that the highest scores are a sample without replacement in proportion to
    exp(weight / 1000). Of the rows with at least min_words words the best percent (rounded down) get the ranks
    1, 2, 3...; ties go to the smaller id, a null id last. All other ranks are null.

    Null texts have no words. Rows that repeat an id have the same noise and are ranked each by itself, those
    alike in all in any order. An empty target is one of equal shares; an empty table gives no rows; other columns
    are not read. Texts are read twice, for the counts and for the weights, and never shuffled; ranks come from a
    range sort of (score, id), so no task sees all rows. A task needs some 40 bytes for each byte of its longest text.
    """
    gains = bucket_gains(feature_counts(docs, text_col, longest, buckets), feature_counts(target, target_text_col, longest, buckets), buckets)
    scored = weigh(docs, gains, id_col, text_col, longest).withColumn("score", F.col("weight") + gumbel_noise(F.col("id"), seed))
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()))
    able = scored.where(F.col("n_words") >= min_words)
    drawn = able.count() * percent // 100
    ranked = running(able, [F.desc("score"), F.col("id").asc_nulls_last(), F.col("row")], {"before": F.lit(1).cast("long")})
    rank = F.when(F.col("before") < drawn, F.col("before") + 1).cast("long")
    out = lambda df, r: df.select(F.col("id").alias(id_col), "n_features", "weight", "score", r.alias("rank"))
    return out(ranked, rank).unionByName(out(scored.where(F.col("n_words") < min_words), F.lit(None).cast("long")))


def op11_target_resampling(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Features by their text and number in each document, their crc32 by a table made by the shift rule, byte by byte.
OP11_SQL = r"""
with d as (
  select row_number() over () as row, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w, false as goal from documents
  union all
  select -row_number() over (), null, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> ''), true from benchmark),
f as materialized (
  select row, goal, f, count(*) as n from (
    select row, goal, unnest(list_concat(w, list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))) as f from d)
  group by all),
t as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as crc),
k as materialized (
  select f, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::bigint)), lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 as bucket
  from (select f, hex(encode(f)) as h from (select distinct f from f)), t),
b as (select bucket, coalesce(sum(n) filter (not goal), 0) as s, coalesce(sum(n) filter (goal), 0) as t from f join k using (f) group by 1),
g as (select bucket, floor(1000 * ln((t + 1)::double * (sum(s) over () + 10000)::double / ((s + 1)::double * (sum(t) over () + 10000)::double)))::bigint as gain from b),
x as (select row, sum(n)::bigint as n_features, sum(n * gain)::bigint as weight from f join k using (f) join g using (bucket) where not goal group by 1),
y as (
  select row, doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(doc_id::varchar, ''))[1:8])::bigint + 0.5::double) / 4294967296::double)))::bigint as score
  from d left join x using (row) where not goal),
z as (select row, row_number() over (order by score desc, doc_id nulls last, row) as place, count(*) over () as n from y where n_words >= 20)
select doc_id, n_features, weight, score, case when place <= 5 * n // 100 then place end as rank from y left join z using (row)
"""
