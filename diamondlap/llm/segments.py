"""Cutting texts by content, so that equal strings of a given length are cut alike.

Every window of `length` bytes is owned by the k-gram in it with the least hash
(the leftmost of equal ones). Neighbouring windows with the same owner make a
segment. Two equal windows, wherever they stand, have owners of equal content at
the same place in them, so grouping segments by owner brings them together.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from diamondlap.llm.text import mix, powers, prefix_hash, span_hash

GRAM = 32
CHUNK = 1 << 20  # positions told apart; longer texts are cut with an overlap
_POSITION = np.uint64(CHUNK - 1)


class Segments(NamedTuple):
    """Of some texts: text, first window, number of windows, key of the owner, key of the segment."""

    text: np.ndarray
    first: np.ndarray
    windows: np.ndarray
    owner: np.ndarray
    segment: np.ndarray


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of x[i : i + width] for each i."""
    out, reach = x, 1
    while reach * 2 <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...] | None:
    """Segments of data, whose texts are data[starts[i] : ends[i]]; at most CHUNK bytes."""
    if len(data) < length:
        return None
    prefix = prefix_hash(data.astype(np.uint64) + np.uint64(1))
    n = len(data) - gram + 1
    grams = mix((prefix[gram:] - prefix[:-gram]) * powers(n, inverse=True))
    least = sliding_min((grams & ~_POSITION) | np.arange(n, dtype=np.uint64), length - gram + 1)
    place = (least & _POSITION).astype(np.int64)
    count = np.maximum(ends - starts - length + 1, 0)  # windows of each text
    begin = np.repeat(starts, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    if not len(begin):
        return None
    text = np.repeat(np.arange(len(starts)), count)
    owner = place[begin]
    new = np.ones(len(begin), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    windows = np.diff(np.concatenate((head, [len(begin)])))
    first, at = begin[head], owner[head]
    segment = span_hash(prefix, first, first + windows + (length - 1)) ^ mix((at - first).astype(np.uint64))
    return text[head], first, windows, grams[at], segment


def segments(texts: list[bytes], length: int, gram: int = GRAM) -> Segments:
    """Segments of all texts; a text longer than CHUNK is cut into overlapping parts."""
    parts: list[Segments] = []
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def flush():
        nonlocal held, size
        if held:
            data = np.frombuffer(b"".join(h[2] for h in held), np.uint8)
            ends = np.cumsum([len(h[2]) for h in held])
            starts = ends - np.array([len(h[2]) for h in held])
            found = _cut(data, starts, ends, length, gram)
            if found:
                which, first, windows, owner, segment = found
                text, offset = np.array([h[0] for h in held]), np.array([h[1] for h in held])
                parts.append(Segments(text[which], first - starts[which] + offset[which], windows, owner, segment))
        held, size = [], 0

    for i, raw in enumerate(texts):
        step = CHUNK - length
        for offset in range(0, max(len(raw) - length + 1, 0), step):
            piece = raw[offset : offset + CHUNK - 1]
            if size + len(piece) >= CHUNK:
                flush()
            held.append((i, offset, piece))
            size += len(piece)
    flush()
    if not parts:
        none = np.zeros(0, np.int64)
        return Segments(none, none, none, none.view(np.uint64), none.view(np.uint64))
    return Segments(*(np.concatenate(c) for c in zip(*parts)))
