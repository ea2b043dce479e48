"""The same encoding as bpe.py for many words at once, in NumPy: each distinct word of a batch is encoded once.

Words and pieces are told apart by their bytes: hashes only group them, and each is compared with the one that stands for its group.
A worker keeps words it has seen, up to ``KEPT`` bytes, and when these are used up those that came in several batches; that changes the
speed only.

All pieces of like length are merged side by side: in each round every piece merges its neighbours of lowest rank, of
equal ranks the leftmost. Pieces that are very long go to the scalar encoder.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
import regex

from . import kernels as K
from .bpe import SPLIT, Encoder, encoder

WIDTHS = (2, 4, 8, 12, 16, 24, 40)
BATCH_BYTES = 2 << 20
KEPT = 24 << 20
KEPT_WORD = 64  # bytes that a word in memory takes besides its own and its ids
NONE = np.int32(1 << 30)
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of flat that index names, one after the other, and their sizes."""
    n = sizes[index]
    ends = np.cumsum(n)
    return flat[np.repeat(starts[index] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], n


def alike(h: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups of words of raw of the same bytes: the first word of each, and each word's group. Equal words have equal h."""
    group, firsts = _groups(h)
    if K.agree(raw, starts, ends, firsts[group]).all():
        return firsts, group
    number: dict[bytes, int] = {}  # words that share a hash: group by their bytes
    return _groups([number.setdefault(raw[a:z], len(number)) for a, z in zip(starts.tolist(), ends.tolist())])[::-1]


def _groups(keys) -> tuple[np.ndarray, np.ndarray]:
    group, found = pd.factorize(np.asarray(keys))
    firsts = np.empty(len(found), np.int64)
    firsts[group[::-1]] = np.arange(len(group) - 1, -1, -1)
    return group, firsts


class Bulk:
    def __init__(self, path: str):
        self.scalar: Encoder = encoder(path)
        merges = self.scalar.merges
        self.shift = np.int64(max(self.scalar.strings) + 2)
        keys = np.array([a * int(self.shift) + b for a, b in merges], np.int64)
        ranks = np.array([r for r, _ in merges.values()], np.int32)
        self.of_rank = np.zeros(len(ranks) + 1, np.int32)
        self.of_rank[ranks] = [m for _, m in merges.values()]
        # tables of pairs by hash: what finds its place taken goes to the next, smaller one
        self.tables = []
        while len(keys):
            bits = max(8, (4 * len(keys)).bit_length())
            held, rank = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
            slot = self._slots(keys, bits)
            held[slot], rank[slot] = keys, ranks
            left = held[slot] != keys
            rank[slot[~left]] = ranks[~left]
            self.tables.append((bits, held, rank))
            keys, ranks = keys[left], ranks[left]
        self.plain = np.array([-1 if x is None else x for x in self.scalar.plain], np.int32)
        self.last = np.array([-1 if x is None else x for x in self.scalar.last], np.int32)
        self.split = regex.compile(rf"{SPLIT}|\n")
        self.total = bool((self.plain >= 0).all() and (self.last >= 0).all())
        self._forget()

    @staticmethod
    def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
        x = keys.view(np.uint64) * MIX[bits % 2]
        return (x >> np.uint64(64 - bits)).view(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = np.where((a >= 0) & (b >= 0), a.astype(np.int64) * self.shift + b, -2).ravel()
        out, own = np.full(len(keys), NONE, np.int32), np.flatnonzero(keys >= 0)
        keys = keys[own]
        for bits, held, rank in self.tables:
            slot = self._slots(keys, bits)
            hit = held[slot] == keys
            out[own[hit]] = rank[slot[hit]]
            own, keys = own[~hit], keys[~hit]
        return out.reshape(a.shape)

    def merge(self, symbols: np.ndarray) -> np.ndarray:
        """Rows of symbols, -1 after their ends, with all merges made."""
        done = symbols.copy()
        rows = np.arange(len(symbols))
        rank = np.full(symbols.shape, NONE, np.int32)
        rank[:, :-1] = self.rank(symbols[:, :-1], symbols[:, 1:])
        columns = np.arange(symbols.shape[1])
        while len(rows):
            at = rank.argmin(1)
            best = rank[np.arange(len(rows)), at]
            live = best < NONE
            done[rows[~live]] = symbols[~live]
            rows, symbols, rank, at, best = rows[live], symbols[live], rank[live], at[live], best[live]
            if not len(rows):
                break
            every = np.arange(len(rows))
            source = np.minimum(columns + (columns > at[:, None]), len(columns) - 1)
            symbols, rank = np.take_along_axis(symbols, source, 1), np.take_along_axis(rank, source, 1)
            symbols[:, -1], rank[:, -1] = -1, NONE
            symbols[every, at] = self.of_rank[best]
            after = np.minimum(at + 1, len(columns) - 1)
            right = np.where(at + 1 < len(columns), symbols[every, after], -1)
            rank[every, at] = self.rank(symbols[every, at], right)
            inner = np.flatnonzero(at > 0)
            rank[inner, at[inner] - 1] = self.rank(symbols[inner, at[inner] - 1], symbols[inner, at[inner]])
        return done

    def pieces(self, raw: bytes, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pieces, which are parts of raw (flat, starts, sizes)."""
        lengths, buf = ends - begins, np.frombuffer(raw, np.uint8)
        flats, starts, sizes = [], np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        done = 0
        for low, width in zip((0, *WIDTHS), WIDTHS):
            own = np.flatnonzero((lengths > low) & (lengths <= width))
            if not len(own):
                continue
            n, columns = lengths[own], np.arange(width)
            bytes_ = buf[np.minimum(begins[own][:, None] + columns, len(buf) - 1)]
            symbols = np.where(columns < n[:, None], self.plain[bytes_], -1)
            symbols[np.arange(len(own)), n - 1] = self.last[bytes_[np.arange(len(own)), n - 1]]
            found = self.merge(symbols)
            full = found >= 0
            sizes[own] = full.sum(1)
            starts[own] = done + np.cumsum(sizes[own]) - sizes[own]
            flats.append(found[full])
            done += len(flats[-1])
        for i in np.flatnonzero(lengths > WIDTHS[-1]).tolist():
            piece = raw[begins[i] : ends[i]]
            ids = self.scalar.merged([self.scalar.plain[b] for b in piece[:-1]] + [self.scalar.last[piece[-1]]])
            starts[i], sizes[i] = done, len(ids)
            flats.append(np.array(ids, np.int32))
            done += len(ids)
        return np.concatenate([np.zeros(0, np.int32), *flats]), starts, sizes

    def _words(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words of raw, each followed by a byte of white space, one after the other, and how many each has."""
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        lines, n = ragged(np.frombuffer(raw, np.uint8), starts, ends - starts + 1, np.arange(len(starts)))
        edges = np.cumsum(n)
        lines[edges - 1] = 10
        blob = lines.tobytes()
        special = np.unique(np.searchsorted(edges, [m.start() for m in re.finditer(rb"<\|", blob)], "right")).astype(np.int64)
        if len(special):  # the scalar encoder looks for special tokens
            found = [np.frombuffer(self.scalar.encode(raw[a:z]), "<u4").astype(np.int32) for a, z in zip(starts[special].tolist(), ends[special].tolist())]
            rest = np.delete(np.arange(len(starts)), special)
            flat, sizes = self._words(raw, starts[rest], ends[rest])
            order = np.argsort(np.append(rest, special))
            n = np.append(sizes, [len(x) for x in found]).astype(np.int64)
            return ragged(np.concatenate([flat, *found]), np.cumsum(n) - n, n, order)
        # normalised as by split_pieces: no letter of one line acts on another's
        found = " ".join(self.split.findall(self.scalar.normal(blob.decode("utf-8", "replace")))).encode()
        h, _, begins, ends, joined = K.word_spans([found])
        firsts, group = alike(h, joined, begins, ends)
        flat, sizes = ragged(*self.pieces(joined, begins[firsts], ends[firsts]), group)
        # ids by word: the sums of its pieces' sizes
        upto = np.searchsorted(begins, np.flatnonzero(np.frombuffer(found, np.uint8) == 10))
        return flat, np.diff(np.append(0, np.cumsum(sizes))[upto], prepend=0)

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # rising, each one once; the rest in the order of these
        self.flat, self.at, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.raw, self.word_at, self.word_size = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.used = np.zeros(0, np.int32)  # in how many batches

    @property
    def held(self) -> int:
        return len(self.raw) + 4 * len(self.flat) + KEPT_WORD * len(self.hashes)

    def _recall(self, h: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The places in the memory of words of raw, -1 for new ones."""
        there, place = K.member(h, self.hashes)
        own = np.flatnonzero(there)
        place = place[own]
        both = raw + self.raw.tobytes() + bytes(8)
        begins = np.concatenate([starts[own], self.word_at[place] + len(raw)])
        same = K.agree(both, begins, np.concatenate([ends[own], begins[len(own) :] + self.word_size[place]]), np.append(np.arange(len(own)) + len(own), np.arange(len(own)) + len(own)))
        found = np.full(len(h), -1, np.int64)
        found[own] = np.where(same[: len(own)], place, -1)
        return found

    def _keep(self, index: np.ndarray, used: np.ndarray) -> None:
        """Keeps the words of the memory that index names."""
        self.hashes, self.used = self.hashes[index], used
        self.flat, self.size = ragged(self.flat, self.at, self.size, index)
        self.at = np.cumsum(self.size) - self.size
        self.raw, self.word_size = ragged(self.raw, self.word_at, self.word_size, index)
        self.word_at = np.cumsum(self.word_size) - self.word_size

    def _trim(self) -> None:
        """Forgets words of one batch, and of the others those of the fewest, until half of the memory is free."""
        order = np.argsort(-self.used, kind="stable")
        size = np.cumsum(self.word_size[order] + 4 * self.size[order] + KEPT_WORD)
        index = np.sort(order[(size <= KEPT // 2) & (self.used[order] > 1)])
        self._keep(index, self.used[index] // 2)

    def _store(self, h: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        """Puts new words into the memory; of those that share a hash, also with known ones, one is kept."""
        words, n = ragged(np.frombuffer(raw, np.uint8), starts, ends - starts, np.arange(len(starts)))
        self.at, self.size = np.append(self.at, np.cumsum(sizes) - sizes + len(self.flat)), np.append(self.size, sizes)
        self.word_at, self.word_size = np.append(self.word_at, np.cumsum(n) - n + len(self.raw)), np.append(self.word_size, n)
        self.flat, self.raw = np.append(self.flat, flat), np.append(self.raw, words)
        self.used = np.append(self.used, np.ones(len(h), np.int32))
        self.hashes, index = np.unique(np.append(self.hashes, h), return_index=True)
        for name in ("at", "size", "word_at", "word_size", "used"):
            setattr(self, name, getattr(self, name)[index])

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        if not self.total:
            return [np.frombuffer(self.scalar.encode(t), "<u4") for t in texts]
        h, begins, starts, ends, joined = K.word_spans(texts)
        firsts, group = alike(h, joined, starts, ends)
        h, starts, ends = h[firsts], starts[firsts], ends[firsts]
        place = self._recall(h, joined, starts, ends)
        new, known = np.flatnonzero(place < 0), np.flatnonzero(place >= 0)
        self.used[place[known]] += 1
        flat, sizes = self._words(joined, starts[new], ends[new])
        # of each word, its ids in the memory or among the new ones
        at, size = np.empty(len(h), np.int64), np.empty(len(h), np.int64)
        at[known], size[known] = self.at[place[known]], self.size[place[known]]
        at[new], size[new] = np.cumsum(sizes) - sizes + len(self.flat), sizes
        every, n = ragged(np.append(self.flat, flat), at, size, group)
        self._store(h[new], joined, starts[new], ends[new], flat, sizes)
        if self.held > KEPT:
            self._trim()
        edges = np.append(0, np.cumsum(n))[begins]
        return [every[a:z] for a, z in zip(edges[:-1].tolist(), edges[1:].tolist())]


@lru_cache(maxsize=2)
def bulk(path: str) -> Bulk:
    return Bulk(path)


def encode_all(path: str, texts: list[bytes]):
    """Ids of each text, in batches of bounded size."""
    own = bulk(path)
    for a, z in K.slices(texts, BATCH_BYTES):
        yield from own.encode(texts[a:z])
