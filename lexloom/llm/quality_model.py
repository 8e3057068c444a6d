"""Quality classifier: supervised subword embeddings, trained by numpy stochastic gradient descent."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .hashing import joined, runs, scatter, small_parts, sums, windows
from .langid import bucket_of

#: Vectors: 2 ** BITS of DIM numbers. Bucket 0 is kept for a word that repeats the one before.
BITS, DIM = 18, 12
CHAR_NGRAMS = (3, 5)
#: Bounds of the training sample: documents and characters.
TRAIN_DOCS, TRAIN_CHARS = 4000, 16_000_000
EPOCHS, RATE, BATCH = 6, 0.4, 16
THRESHOLD = 0.7
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS = np.cumprod(np.full(4096, 0x100000001B3, np.uint64))


def _families(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each family of features: bucket of each feature in text order, begin and end of each text.

    Families: words, pairs of neighbouring words, and the byte n-grams of CHAR_NGRAMS.
    """
    data, begin, end = joined([x + b" " for x in texts])
    out = []
    space = _SPACE[data]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]])) if len(data) else np.zeros(0, np.int64)
    stops = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]])) if len(data) else np.zeros(0, np.int64)
    place = np.arange(len(data))
    offset = place - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(data)]])))
    coded = (data.astype(np.uint64) + np.uint64(1)) * _POWERS[offset & 4095]
    coded[space] = 0
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(coded)])
    words = total[stops] - total[starts]
    first, last = np.searchsorted(starts, begin), np.searchsorted(starts, end)
    bucket = scatter(words, BITS, 1)
    out.append((np.maximum(bucket, 1), first, last))
    pairs = np.maximum(scatter(words[:-1] * np.uint64(31) + words[1:], BITS, 2), 1)
    pairs[words[:-1] == words[1:]] = 0
    out.append((pairs, first, np.maximum(first, last - 1)))
    for n in CHAR_NGRAMS:
        out.append((np.maximum(scatter(windows(data, n), BITS, 2 + n), 1), begin, np.maximum(begin, end - n + 1)))
    return out


@dataclass
class Model:
    """Per bucket its vector's part of the logit of label 1, and the bias: the model is linear in the averages."""

    logits: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        for bucket, begin, end in _families([x.encode("utf-8", "replace") for x in texts]):
            z += sums(self.logits[bucket], begin, end) / np.maximum(1, end - begin)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: list[str], labels: np.ndarray, seed: int = 7) -> Model:
    """Vectors averaged in each family and summed over families, softmax over two labels, SGD."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-0.5, 0.5, (1 << BITS, DIM)).astype(np.float32) / DIM
    out, bias = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    rows = []
    for a, b in runs(texts, 1 << 18):
        families = _families([x.encode("utf-8", "replace") for x in texts[a:b]])
        for i in range(b - a):
            parts = [bucket[begin[i] : end[i]] for bucket, begin, end in families]
            ids = np.concatenate(parts)
            weight = np.concatenate([np.full(len(p), 1 / len(p)) for p in parts if len(p)] or [np.zeros(0)])
            ids, at = np.unique(ids, return_inverse=True)
            rows.append((ids.astype(np.int32), np.bincount(at, weight, len(ids)).astype(np.float32)))
    steps, done = EPOCHS * max(1, -(-len(rows) // BATCH)), 0
    for _ in range(EPOCHS if len(rows) else 0):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            rate = RATE * (1 - done / steps)
            done += 1
            part = order[k : k + BATCH]
            ids = np.concatenate([rows[i][0] for i in part])
            weight = np.concatenate([rows[i][1] for i in part])
            owner = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
            if not len(ids):
                continue
            hidden = np.stack([np.bincount(owner, weight * vectors[ids, d], len(part)) for d in range(DIM)], 1).astype(np.float32)
            z = hidden @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), labels[part]] -= 1
            back = p @ out.T
            norm = np.bincount(owner, weight * weight, len(part))  # step length in the average, not in each vector
            step = (rate * weight / np.maximum(norm, 1e-9)[owner])[:, None] * back[owner]
            np.subtract.at(vectors, ids, np.clip(step, -0.5, 0.5).astype(np.float32))
            out -= rate * hidden.T @ p / len(part)
            bias -= rate * p.mean(0)
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 4, out_fold: int = 2) -> Model:
    """Learn from a bounded sample of labelled rows whose crc32 of the id modulo `folds` is not out_fold.

    Ids are drawn by a digest, some more than TRAIN_DOCS in expectation. Of their texts, in the order of a
    digest of id and text, up to TRAIN_DOCS are taken whole; one that would exceed TRAIN_CHARS is left out and the
    next ones are tried. Only their lengths and then these texts reach the driver. An id that is labelled both ways
    teaches nothing; rows repeated in full count once. Without labels the score is 0.5 for all; labels of which
    every text is too long for TRAIN_CHARS are an error.
    """
    usable = labels.where((bucket_of(id_col, folds) != out_fold) & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    usable = usable.groupBy(id_col).agg(F.max(label_col).cast("int").alias("_label"), F.min(label_col).cast("int").alias("_other")).where("_label = _other")
    n = usable.count()
    if n == 0:
        return Model(np.zeros(1 << BITS), 0.0)
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("quality")), F.lit(1_000_000)) / 1_000_000
    chosen = usable.where(draw < min(1.0, 1.25 * TRAIN_DOCS / n)).select(F.col(id_col).alias("id"), "_label")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    drawn = texts.join(F.broadcast(chosen), "id").withColumn("u", F.xxhash64("id", "text"))
    first = drawn.groupBy("u").agg(F.max(F.length("text")).alias("n")).orderBy("u").limit(TRAIN_DOCS).collect()
    if not first:
        return Model(np.zeros(1 << BITS), 0.0)
    taken, size = [], 0
    for r in first:
        if size + r["n"] <= TRAIN_CHARS:
            taken.append((r["u"],))
            size += r["n"]
    if not taken:
        raise ValueError(f"every labelled text has more than {TRAIN_CHARS} characters")
    taken = docs.sparkSession.createDataFrame(taken, "u bigint")  # TRAIN_DOCS rows at most
    got = drawn.join(F.broadcast(taken), "u").dropDuplicates(["u"]).select("id", "text", "_label")
    rows = sorted((r["id"], r["text"], r["_label"]) for r in got.collect())
    return fit([r[1] for r in rows], np.array([r[2] for r in rows], np.int64))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score (probability of label 1) of each row's whole text; null is scored as empty.

    Every row is scored by its text alone, so repeated rows agree; an empty table gives no rows; other
    columns are not read. A text is scored whole; a task needs some 150 bytes for each byte of its longest.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by BITS

    def run(batches):
        m = shared.value
        for batch in batches:
            for part in small_parts(batch):
                texts = part.column(1).to_pylist()
                for a, b in runs(texts):
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(a, b - a), pa.array(m.scores(texts[a:b]))], ["id", "score"])

    id_type = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return chosen.mapInArrow(run, f"id {id_type}, score double").withColumnRenamed("id", id_col)


def op10_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", (bucket_of("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
