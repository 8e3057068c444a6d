"""Vectorised hashes of byte windows and words over many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Characters of text that are handled at a time.
TEXT_CHARS = 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)


def runs(texts: list, most: int = TEXT_CHARS, size_of=len):
    """Begin and end of runs of texts with about `most` characters; a longer text is a run by itself."""
    begin = size = 0
    for i, n in enumerate(map(size_of, texts)):
        if i > begin and size + n > most:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def small_parts(batch: pa.RecordBatch, rows: int = 256):
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes in a row, and begin and end of each text."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    return np.frombuffer(b"".join(texts), np.uint8), ends - lengths, ends


def windows(data: np.ndarray, n: int) -> np.ndarray:
    """The n bytes (at most 8) from each position on as a number; the last n - 1 positions have none."""
    if len(data) < n:
        return np.zeros(0, np.uint64)
    out = data[: len(data) - n + 1].astype(np.uint64)
    for i in range(1, n):
        out |= data[i : len(data) - n + 1 + i].astype(np.uint64) << np.uint64(8 * i)
    return out


def scatter(x: np.ndarray, bits: int, salt: int = 0) -> np.ndarray:
    """A number of `bits` bits from each number."""
    y = (x + np.uint64(salt)) * _MIX
    y ^= y >> np.uint64(29)
    y *= np.uint64(0xBF58476D1CE4E5B9)
    return (y >> np.uint64(64 - bits)).astype(np.int64)


def sums(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum of values[begin:end] for each pair; empty ranges give 0."""
    kind = np.float64 if values.dtype.kind == "f" else np.int64
    total = np.concatenate([np.zeros(1, kind), np.cumsum(values, dtype=kind)])
    begin = np.minimum(begin, len(values))
    return total[np.clip(end, begin, len(values))] - total[begin]
