"""Hashes of words and shingles of whole Arrow columns of texts, by numpy over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are taken in groups of about so many bytes (or one longer text), so that temporary arrays stay small.
CHUNK = 1 << 20

_RNG = np.random.default_rng(20240501)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_PLACE = _RNG.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = []

#: ASCII lower case, byte by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: all but ASCII white space; or letters only: ASCII letters and all of longer UTF-8 sequences.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n + 1:
        size = max(n + 1, CHUNK + (1 << 18))
        grown = []
        for base in (_BASE, _INVERSE):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            grown.append(np.multiply.accumulate(x))
        _POWERS[:] = grown
    return _POWERS[0], _POWERS[1]


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets of the texts in them); null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type)
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_edges(data: np.ndarray, offsets: np.ndarray, part: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end, none reaching into the next text."""
    inside = part[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the bytes between starts and ends, case and all."""
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def words(data: np.ndarray, offsets: np.ndarray, part: np.ndarray = NOT_SPACE, prefixes: tuple[int, ...] = ()):
    """(hashes of all lower-cased words in order, where each text's words begin: one more than texts).

    With prefixes, one more value: for each number of bytes, (places of the longer words, hashes of their beginnings).
    """
    if not len(data):
        return (np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)) + ([],) * bool(prefixes)
    starts, ends = word_edges(data, offsets, part)
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[LOWER[data]] * up[: len(data)], out=sums[1:])
    hashes, begins = mix((sums[ends] - sums[starts]) * down[starts]), np.searchsorted(starts, offsets)
    if not prefixes:
        return hashes, begins
    cut = []
    for k in prefixes:
        longer = np.flatnonzero(ends - starts > k)
        at = starts[longer]
        cut.append((longer, mix((sums[at + k] - sums[at]) * down[at] + np.uint64(k))))
    return hashes, begins, cut


def shingles(hashes: np.ndarray, begins: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; a shorter text is one shingle, an empty one none."""
    n = len(hashes)
    whole = np.zeros(max(0, n - k + 1), np.uint64)
    for i in range(k):
        whole += hashes[i : n - k + 1 + i] * _PLACE[i] if n >= k else np.uint64(0)
    whole = mix(whole)
    out = []
    for b, e in zip(begins[:-1].tolist(), begins[1:].tolist()):
        if e - b >= k:
            x = np.sort(whole[b : e - k + 1])
            keep = np.empty(len(x), bool)
            keep[0] = True
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            out.append(x[keep])
        elif e > b:
            out.append(mix(np.sum(hashes[b:e] * _PLACE[: e - b], keepdims=True, dtype=np.uint64) + np.uint64(e - b)))
        else:
            out.append(whole[:0])
    return out
