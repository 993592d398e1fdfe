"""Texts of an Arrow batch as flat numpy arrays: bytes, words, and hashes of runs of words.

Words are maximal runs of bytes other than the space and 0x09-0x0D; only A-Z are lowered.
Nothing here loops over words or bytes in Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE, END = 0x20, 0x0A
#: Text bytes worked on at once in one Python worker; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_FOLD[0x09:0x0E] = SPACE


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts on end, and the offsets of each (one more than texts). A null is an empty text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data else np.empty(0, np.uint8)
    return data, off - off[0]


@dataclass
class Folded:
    """buf: every word followed by one separator, END after a document's last word, else SPACE."""

    buf: np.ndarray
    start: np.ndarray
    size: np.ndarray
    words: np.ndarray  # per document
    first: np.ndarray  # per document and one more: number of the first word
    begin: np.ndarray  # of each word in the texts as they came, all on end

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.words)), self.words)


def fold(texts: pa.Array) -> Folded:
    data, off = raw_bytes(texts)
    b = _FOLD[data]
    token = b != SPACE
    begins, ends = token.copy(), token.copy()
    begins[1:] &= ~token[:-1]
    ends[:-1] &= ~token[1:]
    inner = off[(off > 0) & (off < len(b))]
    begins[inner] = token[inner]
    ends[inner - 1] = token[inner - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(starts, off)
    size = stops - starts
    after = np.cumsum(size + 1)
    buf = np.empty(int(after[-1]) if len(after) else 0, np.uint8)
    sep = after - 1
    hold = np.ones(len(buf), bool)
    hold[sep] = False
    buf[hold] = b[token]
    buf[sep] = SPACE
    words = np.diff(first)
    buf[sep[first[1:][words > 0] - 1]] = END
    return Folded(buf, sep - size, size, words, first, starts)


def word_strings(f: Folded) -> pa.Array:
    """All words in lower case."""
    keep = np.ones(len(f.buf), bool)
    keep[f.start + f.size] = False
    ends = np.append(0, np.cumsum(f.size)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(f.size), [None, pa.py_buffer(ends), pa.py_buffer(f.buf[keep])])


def word_runs(f: Folded, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of k words, or of all words of a shorter document: byte start, byte length, runs per document."""
    runs = np.where(f.words >= k, f.words - k + 1, np.minimum(f.words, 1))
    at = ragged(f.first[:-1], runs)
    last = np.minimum(at + k, np.repeat(f.first[1:], runs)) - 1
    return f.start[at], f.start[last] + f.size[last] - f.start[at], runs


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... count[0] of them, then those of start[1], and so on."""
    count = np.asarray(count, np.int64)
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) - np.repeat(ends - count - np.asarray(start, np.int64), count)


def sum_by(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups; counts may hold zeros."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


# The primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _mix(x: np.ndarray) -> np.ndarray:
    return _rotl(x * P2, 31) * P1


def xxh64(buf: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of buf[start:start+size] for each pair, strings of like shape together."""
    out = np.empty(len(start), np.uint64)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    lane8 = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))
    lane4 = np.ndarray(len(buf) + 5, "<u4", padded, strides=(1,))
    order = np.argsort(size, kind="stable")
    shape = size[order]
    cut = np.flatnonzero(np.diff(shape)) + 1
    with np.errstate(over="ignore"):
        s = np.uint64(seed)
        for rows in np.split(order, cut):
            if not len(rows):
                continue
            at, n = start[rows].copy(), int(size[rows[0]])
            left = n
            if n >= 32:
                v = [np.full(len(rows), x, np.uint64) for x in (s + P1 + P2, s + P2, s, s - P1)]
                while left >= 32:
                    for i in range(4):
                        v[i] = _rotl(v[i] + lane8[at + 8 * i] * P2, 31) * P1
                    at += 32
                    left -= 32
                h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
                for x in v:
                    h = (h ^ _mix(x)) * P1 + P4
            else:
                h = np.full(len(rows), s + P5, np.uint64)
            h = h + np.uint64(n)
            while left >= 8:
                h = _rotl(h ^ _mix(lane8[at]), 27) * P1 + P4
                at += 8
                left -= 8
            if left >= 4:
                h = _rotl(h ^ (lane4[at].astype(np.uint64) * P1), 23) * P2 + P3
                at += 4
                left -= 4
            while left:
                h = _rotl(h ^ (buf[at].astype(np.uint64) * P5), 11) * P1
                at += 1
                left -= 1
            h = (h ^ (h >> np.uint64(33))) * P2
            h = (h ^ (h >> np.uint64(29))) * P3
            out[rows] = h ^ (h >> np.uint64(32))
    return out


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts together have about that many bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def slice_bytes() -> int:
    """SLICE_BYTES as the driver has it now; functions sent to the executors carry it."""
    return SLICE_BYTES


def map_slices(df: DataFrame, make: Callable, schema: str, parts: int = 1) -> DataFrame:
    """df through mapInArrow, a slice at a time. make() is called once a task and gives the function from slice to output batches. parts: slices are that much smaller."""
    most = max(1, slice_bytes() // parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, most=most):
                yield from work(part)

    return df.mapInArrow(run, schema)


def id_text(docs: DataFrame) -> DataFrame:
    """Only the two columns that operators on texts read, so other columns can have any names."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
