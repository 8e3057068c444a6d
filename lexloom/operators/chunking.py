"""Chunks of texts: greedy paragraph packing, fixed windows, ids, and the corpus build."""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lexloom.functions.text import last_name, words


#: Texts of a batch that are packed at a time.
ROWS_AT_ONCE = 256


def _ends(sizes: list[int], most: int, overlap: int) -> list[int]:
    """Begin and end, in words of the text, of each chunk of pieces with these sizes (each within most).

    Word counts are summed up once; where a chunk ends is then found by a binary search, so the work grows with the
    number of chunks and not with its square.
    """
    ends, out, i, lead = list(accumulate(sizes)), [], 0, 0
    while i < len(ends):
        begin = ends[i] - sizes[i] - lead
        i = bisect_right(ends, begin + most, lo=i)
        out += (begin, ends[i - 1])
        if i < len(ends):
            lead = min(overlap, ends[i - 1] - begin)
            lead = lead if lead + sizes[i] <= most else 0
    return out


def cut_words(paragraphs: list[list[str]], most: int, overlap: int = 0) -> list[str]:
    """The chunks of one text from the words of its paragraphs."""
    pieces = [min(most, n - i) for n in map(len, paragraphs) for i in range(0, n, most)]
    ends, own = _ends(pieces, most, overlap), list(chain.from_iterable(paragraphs))
    return [" ".join(own[a:b]) for a, b in zip(ends[::2], ends[1::2], strict=True)]


def _joined(texts: pa.ListArray, most: int, overlap: int) -> pa.ListArray:
    """cut_words() for a column of texts (lists of paragraphs, lists of words): the words of all chunks are joined at once."""
    paragraphs = texts.flatten()
    sizes = paragraphs.value_lengths().to_numpy(zero_copy_only=False)
    last = np.cumsum(texts.value_lengths().to_numpy(zero_copy_only=False))
    ends: list[int] = []
    counts, base, at = [], 0, 0
    for k in last.tolist():
        pieces = [min(most, n - i) for n in sizes[at:k].tolist() for i in range(0, n, most)]
        own = _ends(pieces, most, overlap)
        ends += [base + x for x in own]
        counts.append(len(own) // 2)
        base, at = base + sum(pieces), k
    begin, end = (np.array(ends[i::2], np.int64) for i in range(2))
    words_, lengths = paragraphs.flatten(), end - begin
    if overlap:  # else each word is in one chunk, in order
        words_ = words_.take(pa.array(np.repeat(end - np.cumsum(lengths), lengths) + np.arange(lengths.sum())))
    offset = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
    return pa.ListArray.from_arrays(offset(counts), pc.binary_join(pa.ListArray.from_arrays(offset(lengths), words_), " "))


def packed(df: DataFrame, text_col: str, out: str, max_tokens: int = 500, overlap: int = 0, para_pattern: str = r"\n\s*\n") -> DataFrame:
    """df with an array of chunks in `out` instead of text_col: paragraphs packed in order up to max_tokens words.

    When the next paragraph doesn't fit, the chunk is closed and the new one begins with its last `overlap`
    words. A paragraph longer than max_tokens is cut into windows; its rest goes on as the current chunk.
    Without overlap the chunks hold the text's words once each, in order. Null and blank texts give none.

    Words are split by Spark; a chunk is a run of them, joined in Arrow batches, so the work grows with the text.
    Nothing is shuffled.
    """
    if max_tokens <= overlap:
        raise ValueError("the overlap must be below max_tokens")

    rest = [c for c in df.columns if c != text_col]
    paragraphs = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), para_pattern), words)
    sized = df.select(*rest, F.filter(paragraphs, lambda p: F.size(p) > 0).alias("_paragraphs"))

    def cut(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                chunks = _joined(part.column(len(rest)), max_tokens, overlap)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], chunks], [*rest, out])

    kept = [f for f in df.schema.fields if f.name != text_col]
    return sized.mapInArrow(cut, StructType([*kept, StructField(out, ArrayType(StringType()))]))


def chunk(df: DataFrame, text_col: str, max_tokens: int = 500, overlap: int = 0, para_pattern: str = r"\n\s*\n") -> DataFrame:
    """A row for each chunk with the columns of df but the text: chunk_index, chunk; see packed()."""
    rest = [c for c in df.columns if c != text_col]
    return packed(df, text_col, "_chunks", max_tokens, overlap, para_pattern).select(*rest, F.posexplode("_chunks").alias("chunk_index", "chunk"))


def split_fixed(df: DataFrame, text_col: str, n: int) -> DataFrame:
    """A row for each window of n words: chunk_index, chunk."""
    rest = [c for c in df.columns if c != text_col]
    tokened = df.select(*rest, words(F.col(text_col)).alias("_w")).where(F.size("_w") > 0)
    windows = F.transform(F.sequence(F.lit(0), F.floor((F.size("_w") - 1) / n).cast("int")), lambda i: F.array_join(F.slice("_w", i * n + 1, n), " "))
    return tokened.select(*rest, F.posexplode(windows).alias("chunk_index", "chunk"), F.size("_w").alias("_size")).drop("_size")


def chunk_id(*parts: Column) -> Column:
    return F.concat_ws("_", *[p.cast("string") for p in parts])


def build_corpus(entities: DataFrame, texts: DataFrame, shared: DataFrame, fields: dict[str, bool], max_tokens: int = 500, overlap: int = 0, para_pattern: str = r"\n\s*\n") -> DataFrame:
    """Chunks of everything that belongs to an entity, with its metadata and a stable id.

    entities: full_name, year_awarded and the text columns of `fields` (True: split, False: one chunk);
    texts: year_awarded, lastname, source_type, text; shared: year_awarded, source_type, text.
    """
    named = entities.withColumn("lastname", last_name(F.col("full_name")))
    meta = [c for c in named.columns if c not in fields]
    own = named.select(*meta).join(texts, ["year_awarded", "lastname"])
    split = [own] + [named.select(*meta, F.lit(f).alias("source_type"), F.col(f).alias("text")) for f, cut in fields.items() if cut]
    whole = [named.select(*meta, F.lit(f).alias("source_type"), F.col(f).alias("text")) for f, cut in fields.items() if not cut]
    parts = [chunk(d.where("trim(text) <> ''"), "text", max_tokens, overlap, para_pattern) for d in split]
    # a shared text is cut once and its chunks meet the entities of its year
    common = chunk(shared.where("trim(text) <> ''"), "text", max_tokens, overlap, para_pattern)
    parts.append(named.select(*meta).join(common, ["year_awarded"]))
    parts += [d.where("trim(text) <> ''").select(*meta, "source_type", F.lit(0).alias("chunk_index"), F.col("text").alias("chunk")) for d in whole]
    every = reduce(DataFrame.unionByName, parts)
    return every.withColumn("chunk_id", chunk_id(F.col("year_awarded"), F.col("lastname"), F.col("source_type"), F.col("chunk_index")))


def corpus_counts(built: DataFrame) -> DataFrame:
    """source_type, chunks, ids, entities of a build_corpus(): its rows, distinct chunk_ids and distinct full_names.

    Chunks of a text are numbered from 0 on and an id ends with the number, so of the texts with the same rest of the id
    the longest has all ids. Rows are first summed up to one for each text: no task holds the ids of all chunks.
    """
    rest = F.concat_ws("_", "year_awarded", "lastname", "source_type")
    texts = built.groupBy("source_type", "full_name", rest.alias("_rest")).agg(F.count(F.lit(1)).alias("chunks"), (F.max("chunk_index") + 1).cast("long").alias("ids"))
    # a row for each rest of an id (0), one for each name (1)
    rows = texts.select("source_type", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("_rest").alias("of"), "chunks", "ids"), F.struct(F.lit(1).alias("kind"), F.col("full_name").alias("of"), F.lit(0).cast("long").alias("chunks"), F.lit(0).cast("long").alias("ids")))).alias("x")).select("source_type", "x.*")
    each = rows.groupBy("source_type", "kind", "of").agg(F.sum("chunks").alias("chunks"), F.max("ids").alias("ids"))
    named = F.count_if((F.col("kind") == 1) & F.col("of").isNotNull())
    return each.groupBy("source_type").agg(F.sum("chunks").alias("chunks"), F.sum("ids").alias("ids"), named.alias("entities"))
