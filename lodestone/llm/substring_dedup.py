"""Removal of passages that occur earlier in the corpus, by fixed-block anchors.

1. Every document is cut into non-overlapping blocks of half a window. Those reference blocks are indexed, and every
   rolling window of that length, at every place of every document, probes the index. A window of ``words`` words
   holds a whole reference block wherever it lies, so a passage that repeats is hit at both of its places.
2. Around hits, and only there, hits extend to whole windows: each candidate window is compared over all its words
   (by 96 bits of two independent hashes) with the other candidates, and the earliest of equal windows is found.
3. Adjoining windows that have an earlier equal make up the maximal exact repeats; their words go.

A block or window, however common, is sent once by a chunk of documents, so that common lines and large groups of
copies add no more than one entry for each chunk to a task.

Defined results: a null text has no words; rows that repeat an id count one after the other, and a null id comes before
all others; documents of fewer words than a window keep all; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import hashlib
import math
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from . import chunks as C
from . import kernels as K
from .common import documents

WORDS = 20


def _blocks(texts: list[bytes], size: int, shift: int) -> tuple[np.ndarray, ...]:
    """Word hashes, text begins, the rolling windows' hashes without shift low bits, and which windows are whole."""
    h, begins = K.words(texts)
    rolling = K.grams(h, size) >> np.uint64(shift)
    return h, begins, rolling, K.whole(begins, size, len(rolling))


def _windows(h: np.ndarray, texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every window, 64 and 32 bits."""
    other, _ = K.words(texts, lane=1)
    return K.grams(h, words), (K.grams(other, words) >> np.uint64(32)).astype(np.uint32)


def repeats(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", texts_out: bool = False) -> DataFrame:
    """One row (id, n_words, n_removed, kept_sha256[, spans, kept]) a document; spans are [from, to) in words."""
    plan = C.layout(docs, id_col, text_col)
    chunks = C.chunked(docs, plan, id_col, text_col)
    number = plan.parts(docs.sparkSession)
    size = words // 2
    # Hits may be false at a rate of 1 in 2**17, which costs a few candidates; fewer bits make smaller probes.
    shift = max(0, 64 - 17 - math.ceil(math.log2(max(2, plan.raw_bytes))))

    def probe(chunk: int, rows: pd.DataFrame) -> list[tuple]:
        _, begins, rolling, ok = _blocks(C.texts(rows)[1], size, shift)
        place = np.arange(len(rolling)) - np.repeat(begins[:-1], np.diff(begins))[: len(rolling)]
        indexed = (place % size == 0)[ok]
        rolling = rolling[ok]
        if not len(rolling):
            return []
        order = np.argsort(rolling, kind="stable")
        rolling, indexed = rolling[order], indexed[order]
        first = np.flatnonzero(np.append(True, rolling[1:] != rolling[:-1]))
        twice = np.diff(np.append(first, len(rolling))) > 1
        code = np.logical_or.reduceat(indexed, first).astype(np.uint8) + 2 * twice.astype(np.uint8)
        return C.send(chunk, rolling[first], number, code, shift=shift)

    def hit(rows: pd.DataFrame):
        hashes, chunk, code, first = C.gather(rows, np.uint8)
        n = np.diff(np.append(first, len(hashes)))
        shared = (np.bitwise_or.reduceat(code, first) & 1 > 0) & ((n > 1) | (np.bitwise_or.reduceat(code, first) & 2 > 0))
        return C.answer(hashes, chunk, np.repeat(shared, n))

    def extend(chunk: int, rows: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
        (known,) = C.received(hits)
        out: list[tuple] = []
        if len(known):
            texts = C.texts(rows)[1]
            h, begins, rolling, ok = _blocks(texts, size, shift)
            struck = np.zeros(len(h) + 1, np.int32)
            struck[1 : len(rolling) + 1] = K.member(rolling, known)[0] & ok
            sums = np.cumsum(struck)
            n = len(h) - words + 1
            if n > 0:
                near = (sums[words - size + 1 : words - size + 1 + n] - sums[:n] > 0) & K.whole(begins, words, n)
                a, b = _windows(h, texts, words)
                a, b = a[near], b[near]
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                if len(a):
                    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
                    twice = (np.diff(np.append(first, len(a))) > 1).astype(np.uint8)
                    out = C.send(chunk, a[first], number, b[first], twice)
        return C.frame(out, ["part", "chunk"], 2)

    def earliest(rows: pd.DataFrame) -> pd.DataFrame:
        hashes, chunk, b, twice, _ = C.gather(rows, np.uint32, np.uint8)
        order = np.lexsort((chunk, b, hashes))
        hashes, chunk, b, twice = hashes[order], chunk[order], b[order], twice[order]
        new = np.append(True, (hashes[1:] != hashes[:-1]) | (b[1:] != b[:-1]))
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(hashes)))
        again = np.repeat((n > 1) | (twice[first] > 0), n)
        # new: this chunk has the earliest window, so all but its own first one go
        return C.frame(list(C.answer(hashes, chunk, again, b, new.astype(np.uint8))), ["chunk"], 2)

    def remove(chunk: int, rows: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        ids, texts = C.texts(rows)
        hashes, b, first = C.received(got, np.uint32, np.uint8)
        h, begins = K.words(texts)
        gone = np.zeros(len(h), bool)
        n = len(h) - words + 1
        if n > 0 and len(hashes):
            wa, wb = _windows(h, texts, words)
            maybe = np.flatnonzero(K.member(wa, hashes)[0] & K.whole(begins, words, n))
            at = np.searchsorted(hashes, wa[maybe])
            known = np.full(len(maybe), -1)
            same = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
            for step in range(int(np.diff(np.append(same, len(hashes))).max())):  # once, unless 64 bits agree by chance
                i = np.minimum(at + step, len(hashes) - 1)
                agree = (hashes[i] == wa[maybe]) & (b[i] == wb[maybe])
                known[agree] = i[agree]
            maybe, known = maybe[known >= 0], known[known >= 0]
            # of equal windows that this chunk has first, the first place stays
            lead = np.zeros(len(maybe), bool)
            lead[np.unique(known, return_index=True)[1]] = True
            earlier = ~(lead & (first[known] > 0))
            edge = np.zeros(len(h) + 1, np.int64)
            np.add.at(edge, maybe[earlier], 1)
            np.add.at(edge, maybe[earlier] + words, -1)
            gone = np.cumsum(edge)[:-1] > 0
        sums = np.append(0, np.cumsum(gone))
        removed = sums[begins[1:]] - sums[begins[:-1]]
        shas, kept_texts, spans = [], [], []
        for text, a, z, less in zip(texts, begins[:-1].tolist(), begins[1:].tolist(), removed.tolist()):
            split = text.split()
            kept = b" ".join(compress(split, (~gone[a:z]).tolist()) if less else split)
            shas.append(hashlib.sha256(kept).hexdigest())
            if texts_out:
                kept_texts.append(kept.decode("utf-8", "replace"))
                turns = np.flatnonzero(np.diff(np.concatenate(([False], gone[a:z], [False])).astype(np.int8)))
                spans.append(turns.reshape(-1, 2).tolist())
        out = pd.DataFrame({"id": C.id_column(ids), "n_words": np.diff(begins), "n_removed": removed, "kept_sha256": shas})
        return out.assign(spans=spans, kept=kept_texts) if texts_out else out

    hits = C.compare(chunks, probe, hit, 1, 0)
    told = C.with_answers(chunks, hits, extend, C.schema("part int, chunk int", 2))
    known = told.groupBy("part").applyInPandas(earliest, C.schema("chunk int", 2))
    more = ", spans array<array<long>>, kept string" if texts_out else ""
    return C.with_answers(chunks, known, remove, "id long, n_words long, n_removed long, kept_sha256 string" + more)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
