"""Whole Arrow batches of text as flat numpy arrays: words, word hashes, shingles.

A word is a maximal run of letters, digits, underscores and bytes from 0x80 on,
after lower-casing. Arithmetic is modulo 2**64 throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5  # words in a shingle
SIMILARITY = 0.8
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SLICE_BYTES = 2_000_000

_WORD_BYTE = np.zeros(256, bool)
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_":
    _WORD_BYTE[_c] = True
_WORD_BYTE[128:] = True

_power_cache: dict[bool, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE**0 .. BASE**(n-1), or those of its inverse."""
    held = _power_cache.get(inverse)
    if held is None or len(held) < n:
        steps = np.full(1 << max(n - 1, 1).bit_length(), INVERSE if inverse else BASE, np.uint64)
        steps[0] = 1
        held = np.multiply.accumulate(steps)
        if len(held) <= 4 * SLICE_BYTES:  # longer ones are rare
            _power_cache[inverse] = held
    return held[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all 64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of values[t] * BASE**t for i <= t < j."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], wherever it stands."""
    inv = powers(len(prefix), inverse=True)
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(np.uint64))


def byte_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as UTF-8; null as empty) in runs of about limit bytes, whole texts each."""
    first, held, size = 0, [], 0
    for i, scalar in enumerate(column):
        buffer = scalar.as_buffer()
        raw = b"" if buffer is None else buffer.to_pybytes()
        if held and size + len(raw) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield first, held


def joined(texts: list[bytes], gap: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, each followed by gap; the start of each text and the end of the last."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + len(gap) for t in texts], out=starts[1:])
    return np.frombuffer(gap.join(texts) + gap, np.uint8), starts


def lower(raw: bytes) -> bytes:
    return raw.lower() if raw.isascii() else raw.decode("utf-8", "replace").lower().encode("utf-8", "replace")


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the lower-cased texts, in order, and where each text's words begin (one more at the end)."""
    data, starts = joined([lower(t) for t in texts])
    inside = _WORD_BYTE[data]
    change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        change = np.concatenate(([0], change))
    begin, end = change[0::2], change[1::2]  # the last byte is a gap, so each word has an end
    hashes = span_hash(prefix_hash(data.astype(np.uint64)), begin, end)
    return hashes, np.searchsorted(begin, starts)


def shingles(hashes: np.ndarray, bounds: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of each text and where each text's begin.

    A text of fewer words, but not of none, has one shingle: all its words.
    """
    count = np.diff(bounds)
    many = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    out_bounds = np.zeros(len(many) + 1, np.int64)
    np.cumsum(many, out=out_bounds[1:])
    offset = np.arange(out_bounds[-1]) - np.repeat(out_bounds[:-1], many)
    start = np.repeat(bounds[:-1], many) + offset
    end = np.minimum(start + words, np.repeat(bounds[1:], many))
    return span_hash(prefix_hash(hashes), start, end), out_bounds


def text_shingles(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    return shingles(*word_hashes(texts), words)
