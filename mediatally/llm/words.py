"""Words of Arrow text columns as numpy arrays: no Python string per word.

A word is a run of bytes other than blank and tab to carriage return. UTF-8 bytes of other characters never
have these values, so working on bytes gives the words of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

# letters, roughly: everything but the ASCII bytes that are no letters
NO_LETTER = np.array([b < 0x80 and not chr(b).isalpha() for b in range(256)])
# letters and digits
NO_TOKEN = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])

CHUNK_BYTES = 2 << 20
U64 = np.uint64


def free_name(columns: list[str], wish: str) -> str:
    """`wish`, with underscores in front until no column has that name; Spark's names know no case."""
    taken = {c.lower() for c in columns}
    while wish.lower() in taken:
        wish = "_" + wish
    return wish


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets of the rows in them) of a text column; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    at = np.frombuffer(where, dtype=np.int64)[column.offset: column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8)[at[0]: at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that one slice's texts hold `most` bytes or the slice is a single row."""
    for batch in batches:
        size = np.diff(text_bytes(batch.column(batch.schema.get_field_index(column)))[1])
        start, held = 0, 0
        for i, s in enumerate(size.tolist()):
            if held and held + s > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += s
        if start < batch.num_rows:
            yield batch.slice(start)


@dataclass
class Words:
    """`data` with one word after another: word i is data[start[i]:start[i] + length[i]]; row r has words first[r]:first[r + 1]."""

    data: np.ndarray
    start: np.ndarray
    length: np.ndarray
    first: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words_of(column: pa.Array, blank: np.ndarray = BLANK) -> Words:
    """Words of every row; `blank` marks the byte values that separate words."""
    data, at = text_bytes(column)
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(at), np.int64))
    inside = ~blank[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = at[:-1][at[:-1] < len(data)]
    begins[heads] = inside[heads]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    tails = at[1:][at[1:] > 0] - 1
    ends[tails] = inside[tails]
    start = np.flatnonzero(begins)
    length = np.flatnonzero(ends) + 1 - start
    return Words(data, start, length, np.searchsorted(start, at))


def spread(counts: np.ndarray) -> np.ndarray:
    """0..counts[0]-1, 0..counts[1]-1, … in one array."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _weights(n: int, seed: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=U64) + U64(seed)) * U64(0x9E3779B97F4A7C15)) | U64(1)


SHORT = 32


def span_hashes(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of non-empty byte spans: bytes times fixed random weights by place, summed and mixed."""
    if len(start) == 0:
        return np.zeros(0, U64)
    weights = _weights(int(length.max()), seed)
    # place by place over the first bytes, longest spans first, so that those which have a place stand in front
    short = np.minimum(length, SHORT + 1).astype(np.uint8)
    order = np.argsort(short, kind="stable")[::-1]
    have = len(start) - np.cumsum(np.bincount(short, minlength=SHORT + 2))
    at, sums = start[order], np.zeros(len(start), U64)
    for k in range(min(SHORT, int(short.max()))):
        value = data.take(at[: have[k]]).astype(U64)
        value += U64(1)
        value *= weights[k]
        sums[: have[k]] += value
        at[: have[k]] += 1
    total = np.empty(len(start), U64)
    total[order] = sums
    long = np.flatnonzero(length > SHORT)
    if len(long):
        rest = length[long] - SHORT
        place = spread(rest)
        value = data[np.repeat(start[long] + SHORT, rest) + place].astype(U64) + U64(1)
        value *= weights[place + SHORT]
        total[long] += np.add.reduceat(value, np.cumsum(rest) - rest)
    return mix(total + length.astype(U64) * U64(0x632BE59BD9B4E019))


def word_hashes(words: Words, seed: int = 0) -> np.ndarray:
    return span_hashes(words.data, words.start, words.length, seed)


def run_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive word hashes (runs across rows too: the caller leaves those out)."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, U64)
    out = np.zeros(count, U64)
    for k, w in enumerate(_weights(n, 7)):
        out += hashes[k: k + count] * w
    return mix(out)
