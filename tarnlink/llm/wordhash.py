"""Words and word shingles of many texts at once, as 64-bit hashes, with numpy over one byte buffer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ISWORD = np.ones(256, dtype=bool)
_ISWORD[[32, 9, 10, 11, 12, 13]] = False
_BASE = 0x9E3779B97F4A7C15
_pow = np.ones(1, dtype=U)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def powers(n: int) -> np.ndarray:
    global _pow
    if len(_pow) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        steps = np.full(size, _BASE, dtype=U)
        steps[0] = 1
        _pow = np.multiply.accumulate(steps)
    return _pow


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end, and where each begins (one more entry: the end). Nulls are empty."""
    a = texts.cast(pa.large_string()).fill_null("")
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    offsets = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2] or b"", dtype=np.uint8)
    return data, offsets


def slabs(offsets: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `size` bytes in all; a longer text is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, j
        i = j


@dataclass
class Words:
    data: np.ndarray  #: bytes, lower case
    starts: np.ndarray  #: of each word in data
    lengths: np.ndarray
    first: np.ndarray  #: number of each text's first word; one more entry: the number of words
    hashes: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = _ISWORD) -> Words:
    """Words of the texts data[offsets[i]:offsets[i + 1]], A-Z in lower case: runs of the bytes where kind holds, by
    default the non-white ones."""
    base = int(offsets[0])
    offsets = offsets - base
    data = _LOWER[data[base : base + int(offsets[-1])]]
    n = len(data)
    inside = kind[data]
    fresh = np.ones(n + 1, dtype=bool)  # no word goes on over this byte's left edge
    if n:
        fresh[1:n] = ~inside[:-1]
    fresh[offsets] = True
    starts = np.flatnonzero(inside & fresh[:-1])
    after = fresh[1:].copy()
    after[: n - 1] |= ~inside[1:]
    ends = np.flatnonzero(inside & after) + 1
    lengths = ends - starts
    if len(starts):
        at = np.flatnonzero(inside)
        rel = at - np.repeat(starts, lengths)
        value = (data[at].astype(U) + U(1)) * powers(int(lengths.max()) + 1)[rel]
        hashes = mix(np.add.reduceat(value, np.cumsum(lengths) - lengths) + lengths.astype(U))
    else:
        hashes = np.zeros(0, dtype=U)
    return Words(data, starts, lengths, np.searchsorted(starts, offsets), hashes)


def chain(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of several in their order."""
    h = parts[0]
    for p in parts[1:]:
        h = mix(h * U(0xD6E8FEB86659FD93) + p)
    return h


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles. A text with fewer words has one shingle,
    the whole sequence; one without words has none."""
    w = words(data, offsets)
    h = w.hashes
    runs = chain([h[i : len(h) - k + 1 + i] for i in range(k)]) if len(h) >= k else h[:0]
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(runs[a : b - k + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
            out.append(s)
        elif b > a:
            out.append(chain([np.full(1, b - a, dtype=U), *(h[i : i + 1] for i in range(a, b))]))
        else:
            out.append(h[:0])
    return out
