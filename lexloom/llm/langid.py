"""Language identification by language-bitmask n-gram filters."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table
from .hashing import joined, runs, scatter, small_parts, sums, windows

NGRAM = 5
#: Bounds of the training: documents of each language, n-grams kept of each language.
TRAIN_DOCS = 2500
NGRAMS = 25_000
#: Slots of the filters (2 ** BITS) and probes of each n-gram.
BITS, PROBES = 19, 3
UNKNOWN = "und"


def bucket_of(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; 0 for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n)), F.lit(0))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _prepared(text: str) -> bytes:
    """Lower case, with a space at either end, and long enough for one n-gram."""
    return f" {text.lower()} ".encode("utf-8", "replace").ljust(NGRAM)


@dataclass
class Filters:
    """One Bloom filter for each language, bit-sliced: bit l % 64 of a slot of table l // 64 belongs to language l."""

    languages: list[str]
    slots: list[np.ndarray]
    false_rate: np.ndarray

    @staticmethod
    def build(grams: dict[str, np.ndarray]) -> Filters:
        languages = sorted(grams)
        tables, rates = [], []
        for low in range(0, len(languages), 64):
            some = languages[low : low + 64]
            kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if np.dtype(t).itemsize * 8 >= len(some))
            slots = np.zeros(1 << BITS, kind)
            for bit, lang in enumerate(some):
                for probe in range(PROBES):
                    slots[scatter(grams[lang], BITS, probe + 1)] |= kind(1 << bit)
                rates.append(float(((slots >> kind(bit)) & kind(1)).mean()) ** PROBES)
            tables.append(slots)
        return Filters(languages, tables, np.array(rates))

    def masks(self, grams: np.ndarray) -> list[np.ndarray]:
        """For each n-gram the set of languages that contain it, as bits: one word for every 64 languages."""
        at = [scatter(grams, BITS, probe + 1) for probe in range(PROBES)]
        return [reduce(np.bitwise_and, (slots[i] for i in at)) for slots in self.slots]

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of each text, and how many of them each language has, without expected false hits."""
        data, begin, end = joined([_prepared(x) for x in texts])
        masks = self.masks(windows(data, NGRAM))
        n = end - begin - NGRAM + 1
        bit = lambda l: (masks[l // 64] >> masks[l // 64].dtype.type(l % 64)) & masks[l // 64].dtype.type(1)
        found = np.stack([sums(bit(l), begin, begin + n) for l in range(len(self.languages))], 1)
        return n, np.maximum(0, (found - n[:, None] * self.false_rate) / (1 - self.false_rate))

    def decide(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: the score is the winner's share of all corrected counts."""
        letters = np.array(list(map(has_letter, texts)), bool)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        _, counts = self.counts(texts)
        best, total = counts.argmax(1), counts.sum(1)
        score = np.where(letters & (total > 0), counts.max(1) / np.maximum(total, 1e-9), 0.0)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)], np.clip(score, 0, 1)


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Filters of the NGRAMS most frequent n-grams of each language.

    They are learned from about TRAIN_DOCS whole texts of each language, chosen by a digest of the id.
    What reaches the driver is bounded by these parameters and by the number of languages, of which there
    may be any number; without a labelled text there are none.
    """
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id")
    )
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Filters([], [], np.zeros(0))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, TRAIN_DOCS / n))])
    draw = F.pmod(F.xxhash64("id", F.lit("langid")), F.lit(1_000_000)) / 1_000_000
    chosen = known.where(draw < share[F.col("lang")])

    def grams(batches):
        for batch in batches:
            for part in small_parts(batch):
                langs = np.array(part.column(0).to_pylist(), object)
                texts = part.column(1).to_pylist()
                for lang in sorted(set(langs)):
                    data, begin, end = joined([_prepared(t) for t, l in zip(texts, langs, strict=True) if l == lang])
                    inside = np.ones(len(data), bool)
                    for e in end:
                        inside[max(0, e - NGRAM + 1) : e] = False
                    g, n = np.unique(windows(data, NGRAM)[inside[: max(0, len(data) - NGRAM + 1)]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counted = chosen.select("lang", "text").mapInArrow(grams, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counted.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= NGRAMS)
    got = top.select("lang", "gram").toPandas()
    return Filters.build({lang: np.sort(x.to_numpy(np.int64)).view(np.uint64) for lang, x in got.groupby("lang")["gram"]})


def predict(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score for each row's whole text.

    Null texts and texts without a letter are `und` with score 0, and so are all texts where no language
    was learned; a text with letters of which no n-gram is known gets the first language with score 0.
    Repeated rows get the same answer; an empty table gives no rows; other columns are not read. A text
    is judged whole; a task needs some 60 bytes for each byte of its longest text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # its size is fixed by BITS

    def run(batches):
        f = shared.value
        for batch in batches:
            for part in small_parts(batch):
                texts = part.column(1).to_pylist()
                for a, b in runs(texts):
                    langs, score = f.decide(texts[a:b])
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(a, b - a), pa.array(langs, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    id_type = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return chosen.mapInArrow(run, f"id {id_type}, lang_pred string, score double").withColumnRenamed("id", id_col)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5) -> DataFrame:
    """Train on the rows whose crc32 of the id modulo `folds` is not 0, predict all rows."""
    filters = train(docs.where(bucket_of(id_col, folds) != 0), id_col, text_col, lang_col)
    found = predict(docs, filters, id_col, text_col)
    return found.select(id_col, (bucket_of(id_col, folds) == 0).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the rows for which no language is found: null texts and texts without a letter. Same columns.

    Where no language was learned (no labels, or all in the held-out fold), only the letters decide, so
    missing labels cost no document. Ids may be null, repeated or of any type; an empty table stays empty.
    """
    filters = train(docs.where(bucket_of(id_col, 5) != 0), id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    at = docs.columns.index(text_col)

    def run(batches):
        f = shared.value
        for batch in batches:
            for part in small_parts(batch):
                texts = [x or "" for x in part.column(at).to_pylist()]
                keep = []
                for a, b in runs(texts):
                    keep += [x != UNKNOWN for x in f.decide(texts[a:b])[0]] if f.languages else list(map(has_letter, texts[a:b]))
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_language_id(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))
