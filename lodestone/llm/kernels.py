"""Vectorised hashing of words and of runs of words.

A word is a run of bytes outside ASCII white space. Its hash takes in eight bytes at a time, all words of a buffer side by side,
and mixes after each step; no two words of up to eight bytes and the same length share one. Words beyond ``LONG`` bytes,
which are few, go through BLAKE2. Hashes of k words are built from those of halves.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

PIECE = 1 << 21  # bytes looked at together, which bounds the temporary arrays; a longer word stays whole, at a few bytes for each of its own
LONG = 64

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SPACES = re.compile(rb"[\x20\x09-\x0D]")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_C1 = _U(0xC2B2AE3D27D4EB4F)
_SEEDS = [_U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)]
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of x over 64 bits (an invertible finaliser)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _eights(raw: bytes) -> np.ndarray:
    """The eight bytes from each place of raw on; raw ends with eight spare ones."""
    return np.ndarray((len(raw) - 7,), "<u8", buffer=raw, strides=(1,))


def _hashes(raw: bytes, starts: np.ndarray, sizes: np.ndarray, lane: int) -> np.ndarray:
    h = mix(sizes.astype(_U) * _C1 + _SEEDS[lane])
    eights, own = _eights(raw), np.arange(len(starts))
    for at in range(0, LONG, 8):
        own = own[sizes[own] > at]
        if not len(own):
            break
        h[own] = mix(h[own] ^ (eights[starts[own] + at] & _MASKS[np.minimum(sizes[own] - at, 8)]))
    for i in np.flatnonzero(sizes > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : starts[i] + sizes[i]], digest_size=8, salt=bytes([lane])).digest(), "little")
    return h


def agree(raw: bytes, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which words of raw, which ends with eight spare bytes, have the bytes of the words whose numbers are in other."""
    sizes = ends - starts
    same = sizes == sizes[other]
    eights, own = _eights(raw), np.flatnonzero(same)
    for at in range(0, LONG, 8):
        own = own[sizes[own] > at]
        if not len(own):
            break
        mask = _MASKS[np.minimum(sizes[own] - at, 8)]
        same[own] &= ((eights[starts[own] + at] ^ eights[starts[other[own]] + at]) & mask) == 0
    for i in np.flatnonzero(same & (sizes > LONG)).tolist():
        j = other[i]
        same[i] = raw[starts[i] : ends[i]] == raw[starts[j] : ends[j]]
    return same


def word_spans(texts: list[bytes], lower: bool = False, lane: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """As words(), and each word's start and end in the joined texts, which come last, with eight spare bytes."""
    joined = b"\n".join(texts) + b"\n" + bytes(8)
    if lower:
        joined = joined.translate(_LOWER)
    size = len(joined) - 8
    buf = np.frombuffer(joined, np.uint8)
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
    found, at = [], 0
    while at < size:
        stop = _SPACES.search(joined, min(at + PIECE, size) - 1).end()
        space = _SPACE[buf[at:stop]]
        before = np.empty_like(space)
        before[0] = True
        before[1:] = space[:-1]
        starts, ends = np.flatnonzero(before & ~space) + at, np.flatnonzero(space & ~before) + at
        found.append((_hashes(joined, starts, ends - starts, lane), starts, ends))
        at = stop
    hashes, starts, ends = (np.concatenate(x) for x in zip(*found))
    return hashes, np.searchsorted(starts, begins), starts, ends, joined


def words(texts: list[bytes], lower: bool = False, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, one after the other, and where each text's words begin, with the end."""
    return word_spans(texts, lower, lane)[:2]


def runs(sizes, most: int = 4 << 20):
    """(from, to) of runs that come to a bounded size together, unless they are of one thing."""
    start, size, i = 0, 0, -1
    for i, n in enumerate(sizes):
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if i >= 0:
        yield start, i + 1


def slices(texts: list[bytes], most: int = 4 << 20):
    """(from, to) of runs of texts that are of bounded size together."""
    return runs(map(len, texts), most)


def batch_slices(batch: pa.RecordBatch, text: int, most: int = 2 << 20):
    """Slices of a batch whose texts, in the column of that number, are of bounded size together."""
    for a, z in runs(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist(), most):
        yield batch.slice(a, z - a)


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of sequences from those of their two parts; the order counts."""
    return mix(a * _C1 + b)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on; len(h) - k + 1 of them."""
    if k == 1:
        return h
    if len(h) < k:
        return h[:0]
    if k % 2:
        return join(grams(h, k - 1)[:-1], h[k - 1 :])
    half = grams(h, k // 2)
    return join(half[: -(k // 2)], half[k // 2 :])


def whole(begins: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the n places start a run of k words inside one text."""
    left = np.repeat(begins[1:], np.diff(begins))[:n] - np.arange(n)
    return left >= k


def squeeze(a: np.ndarray) -> bytes:
    """Numbers as bytes: like bytes together, then compressed."""
    raw = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(raw.view(np.uint8).reshape(-1, raw.itemsize).T.tobytes())


def unsqueeze(blob: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(dtype.itemsize, -1).T).view(dtype).ravel()


def pack(rising: np.ndarray) -> bytes:
    """Rising 64-bit numbers by their differences."""
    steps = rising.copy()
    steps[1:] -= rising[:-1]
    return squeeze(steps)


def unpack(blob: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(blob, _U), dtype=_U)


def member(values: np.ndarray, rising: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are among the rising ones, and where."""
    if not len(rising):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(rising, values), len(rising) - 1)
    return rising[at] == values, at
