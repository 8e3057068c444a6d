"""Byte-level BPE over tables: encoding on length-bucketed numpy matrices, and decoding."""

from __future__ import annotations

import base64
import hashlib
import heapq
from itertools import batched, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .hashing import runs, small_parts

NONE = np.int32(2**31 - 1)
#: Pieces of more bytes than this are merged by a heap of pairs, with the same result.
MATRIX_BYTES = 256
#: Cells of a matrix, characters of text and pieces at a time.
MATRIX_CELLS = 1 << 19
TEXT_CHARS = 1 << 19
PIECES_AT_ONCE = 1 << 16
#: What a task remembers: pieces, and their characters in all.
MEMORY_PIECES, MEMORY_CHARS = 300_000, 4 << 20


class Merges:
    """Ranks of byte strings with a hashed table (left id, right id) -> merged id."""

    def __init__(self, lines: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) if a}
        self.spell = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.spell[rank] = token
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, to = [], [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), to.append(rank)
        keys = np.array(left, np.uint64) << np.uint64(32) | np.array(right, np.uint64)
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.to = np.full(1 << self.bits, NONE, np.int32)
        slot, rest = self._slot(keys), np.arange(len(keys))
        while len(rest):  # open addressing: whoever finds its slot free stays, the others move on
            free = rest[self.keys[slot[rest]] == np.uint64(2**64 - 1)]
            self.keys[slot[free]] = keys[free]
            won = free[self.keys[slot[free]] == keys[free]]
            self.to[slot[won]] = np.array(to, np.int32)[won]
            rest = np.setdiff1d(rest, won, assume_unique=True)
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NONE where a pair doesn't merge. A negative id is padding."""
        shape = left.shape
        left, right = left.ravel(), right.ravel()
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64) & np.uint64(2**32 - 1)
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.to[slot], NONE)
        rest = np.flatnonzero((found != keys) & (found != np.uint64(2**64 - 1)) & (left >= 0) & (right >= 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = self.to[slot[rest[hit]]]
            rest = rest[~hit & (found != np.uint64(2**64 - 1))]
        return out.reshape(shape)

    def merge_matrix(self, ids: np.ndarray) -> list[np.ndarray]:
        """Ids of each row. ids: one row for each piece, padded with -1.

        Each round merges the leftmost pair of least rank in every row: the column of the pair's right
        half is squeezed out of the row, only the pairs beside the merge are looked up again, and rows
        without a pair that merges leave the matrix.
        """
        out: list = [None] * len(ids)
        rows, ranks = np.arange(len(ids)), self.pairs(ids[:, :-1], ids[:, 1:])
        while len(rows):
            if ranks.shape[1] == 0:
                at, best = np.zeros(len(rows), np.int64), np.full(len(rows), NONE)
            else:
                at = ranks.argmin(1)
                best = ranks[np.arange(len(rows)), at]
            done = best == NONE
            if done.any():
                for r, x in zip(rows[done], ids[done], strict=True):
                    out[r] = x[x >= 0]
                rows, ids, ranks, at, best = rows[~done], ids[~done], ranks[~done], at[~done], best[~done]
                if not len(rows):
                    break
            n, width = ids.shape
            line = np.arange(n)
            ids[line, at] = best
            keep = np.ones((n, width), bool)
            keep[line, at + 1] = False
            ids = ids[keep].reshape(n, width - 1)
            keep = np.ones((n, width - 1), bool)
            keep[line, at] = False
            ranks = ranks[keep].reshape(n, width - 2)
            has_left, has_right = np.flatnonzero(at > 0), np.flatnonzero(at < width - 2)
            ranks[has_left, at[has_left] - 1] = self.pairs(ids[has_left, at[has_left] - 1], ids[has_left, at[has_left]])
            ranks[has_right, at[has_right]] = self.pairs(ids[has_right, at[has_right]], ids[has_right, at[has_right] + 1])
            used = int((ids >= 0).sum(1).max())
            if used < ids.shape[1]:  # columns that are only padding by now
                ids, ranks = ids[:, :used], ranks[:, : max(0, used - 1)]
        return out

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same for one long piece: a heap of (rank, position) over a linked list."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.pairs(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        spell = self.spell

        def push(i: int, j: int) -> None:
            r = self.ranks.get(spell[ids[i]] + spell[ids[j]])
            if r is not None:
                heapq.heappush(heap, (r, i, ids[i], ids[j]))

        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece; pieces are dealt into matrices by length, in steps of a quarter."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out: list = [None] * len(pieces)
        low = 0
        while low < MATRIX_BYTES:
            high = min(MATRIX_BYTES, max(low + 2, low * 5 // 4))
            chosen = np.flatnonzero((lengths > low) & (lengths <= high))
            step = max(1, MATRIX_CELLS // high)
            for k in range(0, len(chosen), step):
                part = chosen[k : k + step]
                ids = np.full((len(part), high), -1, np.int32)
                ids[np.arange(high) < lengths[part][:, None]] = self.byte_ids[np.frombuffer(b"".join([pieces[i] for i in part]), np.uint8)]
                for i, x in zip(part, self.merge_matrix(ids), strict=True):
                    out[i] = x
            low = high
        for i in np.flatnonzero(lengths > MATRIX_BYTES):
            out[i] = self.merge_long(pieces[i])
        return out


class Encoder:
    """Encodes texts piece by piece and remembers pieces that it has seen, up to a bound."""

    def __init__(self, merges: Merges, pattern: str):
        self.merges, self.pattern = merges, regex.compile(pattern)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.held = np.zeros(0, np.int32), np.zeros(1, np.int64), 0

    def _learn(self, pieces: set[str]) -> None:
        new = list(pieces)
        ids = self.merges.encode_pieces([x.encode() for x in new])
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.flat = np.concatenate([self.flat, *ids])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum([len(x) for x in ids], dtype=np.int64)])
        self.held += sum(map(len, new))

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the pieces, and where the ids of each piece end."""
        if new := set(pieces).difference(self.known):
            self._learn(new)
        at = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        first = self.starts[at]
        n = self.starts[at + 1] - first
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.arange(total) + np.repeat(first - (ends - n), n)]
        if len(self.known) > MEMORY_PIECES or self.held > MEMORY_CHARS:
            self._forget()
        return ids, ends

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Short texts are encoded together, long ones in blocks of their pieces."""
        out: list[np.ndarray] = []
        for a, b in runs(texts, TEXT_CHARS):
            if b - a == 1:
                pieces = map(regex.Match.group, self.pattern.finditer(texts[a]))
                out.append(np.concatenate([np.zeros(0, np.int32), *(self._ids(list(block))[0] for block in batched(pieces, PIECES_AT_ONCE))]))
                continue
            split = [self.pattern.findall(x) for x in texts[a:b]]
            ids, ends = self._ids([p for x in split for p in x])
            edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(x) for x in split])])]
            out += [ids[i:j] for i, j in pairwise(edges.tolist())]
        return out


def read_ranks(spark: SparkSession, path: str):
    """The vocabulary file as a broadcast: its size is that of the vocabulary, not of the data."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def _encoded(batches, encoder: Encoder):
    """Keys and ids of runs of rows; a run has about TEXT_CHARS characters, or one longer text."""
    for batch in batches:
        for part in small_parts(batch):
            texts = part.column(1).to_pylist()
            for a, b in runs(texts, TEXT_CHARS):
                yield part.column(0).slice(a, b - a), encoder.encode(texts[a:b])


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and ids (array of int) of each row's whole text: null is encoded as empty, giving no ids.

    Each match of the pattern is encoded separately, without special tokens. Rows, repeated or not, keep
    to themselves: nothing is shuffled, batches are cut by text length, and a text is never split. Ids may
    be of any type. A task holds its batch, the ids of one long text (4 bytes each) and about 100 bytes a
    byte of its longest piece. An empty table gives no rows; other columns are ignored.
    """
    lines = read_ranks(docs.sparkSession, ranks_path)

    def run(batches):
        for keys, ids in _encoded(batches, Encoder(Merges(lines.value), pattern)):
            offsets = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
            yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids)))], ["id", "ids"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return _texts(docs, id_col, text_col).mapInArrow(run, f"id {id_type}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col, ids_col and decoded (binary): the bytes of the ids joined; null ids give no bytes.

    An id outside the vocabulary fails the task. Rows leave in batches of about TEXT_CHARS ids, or one by
    one where they are longer.
    """
    lines = read_ranks(encoded.sparkSession, ranks_path)

    def run(batches):
        spelling = Spelling(Merges(lines.value).spell)
        for batch in batches:
            lists = batch.column(1)
            counts = [x or 0 for x in lists.value_lengths().to_pylist()]
            for a, b in runs(counts, TEXT_CHARS, int):
                part = lists.slice(a, b - a)
                ids, ends = part.flatten().to_numpy(zero_copy_only=False), np.cumsum(counts[a:b])
                decoded = [b"".join(spelling.bytes_of(ids[i:j])) for i, j in zip([0, *ends[:-1]], ends, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), part, pa.array(decoded, pa.binary())], ["id", "ids", "decoded"])

    id_type = encoded.schema[id_col].dataType.simpleString()
    chosen = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return chosen.mapInArrow(run, f"id {id_type}, ids array<int>, decoded binary").withColumnsRenamed({"id": id_col, "ids": ids_col})


class Spelling:
    """The bytes of ids, and their decimal numbers, in blocks."""

    def __init__(self, spell: list[bytes]):
        self.spell, self.decimal = spell, [b"%d" % i for i in range(len(spell))]

    def _blocks(self, ids: np.ndarray, words: list[bytes]):
        for k in range(0, len(ids), PIECES_AT_ONCE):
            yield [words[i] for i in ids[k : k + PIECES_AT_ONCE].tolist()]

    def bytes_of(self, ids: np.ndarray):
        """Decoded bytes, block by block."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.spell)):
            raise ValueError("an id is not in the vocabulary")
        for words in self._blocks(ids, self.spell):
            if not all(words):
                raise ValueError("an id is not in the vocabulary")
            yield b"".join(words)

    def numbers(self, ids: np.ndarray):
        """The ids in decimal, joined by commas, block by block."""
        for k, words in enumerate(self._blocks(ids, self.decimal)):
            yield (b"," if k else b"") + b",".join(words)


def _sha256(blocks) -> str:
    digest = hashlib.sha256()
    for x in blocks:
        digest.update(x)
    return digest.hexdigest()


def token_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256 and decoded_sha256 of each row's whole text.

    The ids are those of encode() and the bytes those of decode(); both happen in one pass, so a task
    needs one worker and no ids leave it. Nulls, repeated rows and memory are as in encode().
    """
    lines = read_ranks(docs.sparkSession, ranks_path)

    def run(batches):
        merges = Merges(lines.value)
        spelling = Spelling(merges.spell)
        for keys, ids in _encoded(batches, Encoder(merges, pattern)):
            columns = [[len(x) for x in ids], [_sha256(spelling.numbers(x)) for x in ids], [_sha256(spelling.bytes_of(x)) for x in ids]]
            yield pa.RecordBatch.from_arrays([keys, *map(pa.array, columns)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return _texts(docs, id_col, text_col).mapInArrow(run, f"id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_byte_bpe(spark, sf_dir):
    return token_digests(table(spark, sf_dir, "documents"), *default_vocabulary())
