"""Vectorised hashing of words, grams and windows over many documents at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
A1, A2, A3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER_TABLE = np.arange(256, dtype=np.uint8)
LOWER_TABLE[65:91] += 32
MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def mix(v: np.ndarray) -> np.ndarray:
    """Scrambles v in place."""
    v ^= v >> U(30)
    v *= A2
    v ^= v >> U(27)
    v *= A3
    v ^= v >> U(31)
    return v


def join_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts, each followed by a blank, as one array of bytes, and where each begins (and the end)."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1, out=begins[1:])
    return data, begins


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in data; data ends with white space."""
    space = IS_SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edges = np.concatenate([[0], edges])
    return edges[::2], edges[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes at a time."""
    whole = np.zeros((len(data) + 23) // 8 * 8, np.uint8)
    whole[: len(data)] = data
    blocks = whole.view("<u8")
    left = ends - starts
    out = left.astype(np.uint64) * A1
    who, at, now = slice(None), starts, out
    while True:
        shift = (at & 7).astype(np.uint64) << U(3)
        block = blocks[at >> 3] >> shift
        block |= (blocks[(at >> 3) + 1] << (U(63) - shift)) << U(1)
        block &= MASKS[np.minimum(left, 8)]
        block *= A1
        now = mix(now ^ block)
        out[who] = now
        more = np.flatnonzero(left > 8)
        if not len(more):
            return out
        who = more if isinstance(who, slice) else who[more]
        at, left, now = at[more] + 8, left[more] - 8, now[more]


def fold(v: np.ndarray) -> np.ndarray:
    """A lighter mix, in place."""
    v ^= v >> U(32)
    v *= A3
    return v


def grams(x: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive values of x, by doubling."""
    out, at, power, size = None, 0, x, 1
    while True:
        if k & 1:
            if out is None:
                out = power
            else:
                n = len(x) - at - size + 1
                out = mix(out[:n] * A1 + power[at : at + n])
            at += size
        k >>= 1
        if not k:
            return out
        power = fold(power[:-size] * A2 + power[size:]) if len(power) > size else power[:0]
        size *= 2


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while 2 * size <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def sliced(batch: pa.RecordBatch, most: int = 1_000_000, column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Consecutive parts of a batch of about `most` bytes of text, with the texts as bytes (null: empty); a longer text comes alone."""
    texts = [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]
    start = size = 0
    for i, t in enumerate(texts):
        if len(t) >= most and start < i:
            yield batch.slice(start, i - start), texts[start:i]
            start, size = i, 0
        size += len(t)
        if size >= most:
            yield batch.slice(start, i + 1 - start), texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield batch.slice(start), texts[start:]
