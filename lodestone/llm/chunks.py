"""Documents in chunks, and what chunks tell each other about hashes.

Corpus-wide facts about hashes of words or shingles (how many documents hold one, which holds it first) are found
without a row for each word: a chunk of some megabytes of text sends its sorted distinct hashes, packed, to the parts
of the hash space; a part compares what all chunks sent and answers each chunk. A hash, however common, is sent
once by each chunk, so no part gets more than one entry for each chunk and hash. Chunks follow the order of ids: no id of a
chunk is above one of the next. They are laid out by bytes; an id whose rows hold more than a chunk is spread over several,
in an order of its own.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import parts, ready

CHUNK_BYTES = 8 << 20
PART_BYTES = 16 << 20  # text for each part of the hash space
STEPS = 1 << 16  # counts of ids and bytes in a pass of the layout, whatever the input
CELLS = 4096  # the least share of all bytes that the layout looks into
NO_ID = -(1 << 63)  # stands for a null id, before all others


@dataclass
class Layout:
    """Where ids go. A cell is a range of ids; at is the place, in chunks, where it begins, and span how many chunks it fills."""

    first: np.ndarray
    last: np.ndarray
    at: np.ndarray
    span: np.ndarray
    chunks: int
    raw_bytes: int
    rows: int

    def chunk(self, ids: np.ndarray, texts: list[bytes], seen: Counter) -> np.ndarray:
        """Ids count as evenly spread in a cell; the rows of a cell of one id go by hash and, where they are alike, by turn."""
        if self.chunks == 1 or not len(ids):
            return np.zeros(len(ids), np.int32)
        cell = np.searchsorted(self.first, ids, side="right") - 1
        unsigned = lambda x: x.view(np.uint64)  # noqa: E731  differences of any two ids fit
        share = (unsigned(ids) - unsigned(self.first[cell])) / ((unsigned(self.last[cell]) - unsigned(self.first[cell])).astype(np.float64) + 1)
        for i in np.flatnonzero((self.first[cell] == self.last[cell]) & (self.span[cell] > 1)).tolist():
            key = (int(ids[i]), zlib.crc32(texts[i]), len(texts[i]))
            share[i] = zlib.crc32(repr((*key, seen[key])).encode()) / (1 << 32)
            seen[key] += 1
        return np.minimum(self.at[cell] + self.span[cell] * share, self.chunks - 1).astype(np.int32)

    def parts(self, spark: SparkSession) -> int:
        """Parts of the hash space, of bounded size."""
        return 2 * max(parts(spark), math.ceil(self.raw_bytes / PART_BYTES))


def _counts(rows: DataFrame, ranges: list[tuple[int, int]], steps: int) -> dict[tuple[int, int], tuple[int, int]]:
    """Bytes and rows of each step that has any, of ranges of ids cut into equal steps."""
    first, last = (np.array(x, np.int64) for x in zip(*ranges))
    width = np.array([(z - a) // steps + 1 for a, z in ranges], np.uint64)

    def add(batches):
        for batch in batches:
            ids, size = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            at = np.searchsorted(first, ids, side="right") - 1
            inside = (at >= 0) & (ids <= last[at])
            ids, size, at = ids[inside], size[inside], at[inside]
            step = at * steps + ((ids.view(np.uint64) - first[at].view(np.uint64)) // width[at]).astype(np.int64)
            found, place, n = np.unique(step, return_inverse=True, return_counts=True)
            total = np.bincount(place, weights=size, minlength=len(found)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total), pa.array(n.astype(np.int64))], ["step", "bytes", "n"])

    found = rows.mapInArrow(add, "step long, bytes long, n long").groupBy("step").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).collect()
    return {divmod(r["step"], steps): (r["bytes"], r["n"]) for r in found}


def layout(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> Layout:
    """Cells from counts in equal steps between the least and the largest id; steps that hold much are counted again in finer ones."""
    ready(docs.sparkSession)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    rows = docs.select(key.alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("size"))
    ends = rows.where(F.col("id") != NO_ID).agg(F.min("id").alias("lo"), F.max("id").alias("hi")).first()
    open_ranges = [(NO_ID, NO_ID)] + ([(ends["lo"], ends["hi"])] if ends["lo"] is not None else [])
    cells, most = [], None
    while open_ranges:
        steps = max(16, STEPS // len(open_ranges))
        counts = _counts(rows, open_ranges, steps)
        if most is None:
            most = max(chunk_bytes, sum(b for b, _ in counts.values()) / CELLS)
        finer = []
        for (i, step), (size, n) in counts.items():
            a, z = open_ranges[i]
            width = (z - a) // steps + 1
            a, z = a + step * width, min(z, a + (step + 1) * width - 1)
            if size > most and a < z:
                finer.append((a, z))
            else:
                cells.append((a, z, size, n))
        open_ranges = sorted(finer)
    cells.sort()
    first, last = (np.array([c[i] for c in cells], np.int64) for i in range(2))
    raw, total = sum(c[2] for c in cells), sum(c[3] for c in cells)
    chunks = max(1, math.ceil(raw / chunk_bytes))
    weight = np.array([c[2] + 1 for c in cells], np.float64)
    span = weight / max(weight.sum(), 1) * chunks
    return Layout(first, last, np.cumsum(span) - span, span, chunks, raw, total)


def chunked(docs: DataFrame, plan: Layout, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (chunk, ids, lens, body), several for each chunk, dealt out by chunk. Read it through texts()."""
    ready(docs.sparkSession)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, seen = zstandard.ZstdCompressor(level=3), Counter()
        for whole in batches:
            for batch in K.batch_slices(whole, 1, 2 * CHUNK_BYTES):
                ids = batch.column(0).cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)
                texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
                chunk = plan.chunk(ids, texts, seen)
                order = np.argsort(chunk, kind="stable")
                rows = []
                for run in np.split(order, np.flatnonzero(np.diff(chunk[order])) + 1):
                    own = [texts[i] for i in run]
                    rows.append((int(chunk[run[0]]), K.squeeze(ids[run]), K.squeeze(np.array([len(t) for t in own], np.int64)), packer.compress(b"".join(own))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["chunk", "ids", "lens", "body"])

    dealt = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(deal, "chunk int, ids binary, lens binary, body binary")
    return dealt.repartition(parts(docs.sparkSession), "chunk")


def texts(rows: pd.DataFrame) -> tuple[np.ndarray, list[bytes]]:
    """Ids and texts of a chunk, in the order of (id, text)."""
    ids, out = [], []
    for i, n, body in zip(rows["ids"], rows["lens"], rows["body"]):
        ids.append(K.unsqueeze(i, np.int64))
        raw, at = zstandard.ZstdDecompressor().decompress(body), 0
        for size in K.unsqueeze(n, np.int64).tolist():
            out.append(raw[at : at + size])
            at += size
    ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    order = sorted(range(len(out)), key=lambda i: (ids[i], out[i]))
    return ids[order], [out[i] for i in order]


def id_column(ids: np.ndarray) -> pd.Series:
    """Ids for output, null where there was none."""
    out = pd.Series(ids, dtype="Int64")
    out[ids == NO_ID] = pd.NA
    return out


def bounds(number: int) -> np.ndarray:
    """First hash of each part of the hash space, as a share of 2**64."""
    return np.array([(i << 64) // number for i in range(number)], np.uint64)


def send(chunk: int, hashes: np.ndarray, number: int, *more: np.ndarray, shift: int = 0) -> list[tuple]:
    """Rows (part, chunk, hashes, more...) of a chunk's rising hashes, cut by part. shift: low bits that were dropped."""
    cuts = np.searchsorted(hashes, bounds(number) >> np.uint64(shift))
    ends = np.append(cuts[1:], len(hashes))
    return [(p, chunk, K.pack(hashes[a:b]), *(K.squeeze(m[a:b]) for m in more)) for p, (a, b) in enumerate(zip(cuts, ends)) if b > a]


def gather(rows: pd.DataFrame, *dtypes) -> tuple[np.ndarray, ...]:
    """All entries that reached a part, sorted by hash then chunk: hashes, chunks, more..., and first entry of each hash."""
    hashes = [K.unpack(b) for b in rows["hashes"]]
    sizes = [len(h) for h in hashes]
    columns = [np.concatenate(hashes), np.repeat(rows["chunk"].to_numpy(np.int32), sizes)]
    columns += [np.concatenate([K.unsqueeze(b, t) for b in rows[f"more{i}"]]) for i, t in enumerate(dtypes)]
    order = np.lexsort((columns[1], columns[0]))
    columns = [c[order] for c in columns]
    first = np.flatnonzero(np.append(True, columns[0][1:] != columns[0][:-1]))
    return (*columns, first)


def answer(hashes: np.ndarray, chunks: np.ndarray, keep: np.ndarray, *more: np.ndarray) -> Iterator[tuple]:
    """Rows (chunk, hashes, more...) for the entries to keep, each chunk's in rising order."""
    picked = np.flatnonzero(keep)
    picked = picked[np.argsort(chunks[picked], kind="stable")]
    if not len(picked):
        return
    for run in np.split(picked, np.flatnonzero(np.diff(chunks[picked])) + 1):
        yield (int(chunks[run[0]]), K.pack(hashes[run]), *(K.squeeze(m[run]) for m in more))


def received(rows: pd.DataFrame, *dtypes) -> tuple[np.ndarray, ...]:
    """What the parts answered to a chunk, in rising order of hashes."""
    if not len(rows):
        return (np.zeros(0, np.uint64), *(np.zeros(0, t) for t in dtypes))
    columns = [np.concatenate([K.unpack(b) for b in rows["hashes"]])]
    columns += [np.concatenate([K.unsqueeze(b, t) for b in rows[f"more{i}"]]) for i, t in enumerate(dtypes)]
    order = np.argsort(columns[0], kind="stable")
    return tuple(c[order] for c in columns)


def schema(key: str, more: int) -> str:
    return f"{key}, hashes binary" + "".join(f", more{i} binary" for i in range(more))


def frame(rows: list[tuple], key: list[str], more: int) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[*key, "hashes", *(f"more{i}" for i in range(more))])


def compare(chunks: DataFrame, tell: Callable, decide: Callable, sent: int, answered: int) -> DataFrame:
    """Answers (chunk, hashes, more...) to all chunks.

    tell(chunk, rows of the chunk) makes rows for send(); decide(rows of a part) makes rows of answer().
    """

    def told(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return frame(tell(int(key[0]), rows), ["part", "chunk"], sent)

    def decided(rows: pd.DataFrame) -> pd.DataFrame:
        return frame(list(decide(rows)), ["chunk"], answered)

    out = chunks.groupBy("chunk").applyInPandas(told, schema("part int, chunk int", sent))
    return out.groupBy("part").applyInPandas(decided, schema("chunk int", answered))


def with_answers(chunks: DataFrame, answers: DataFrame, f: Callable, out: str) -> DataFrame:
    """f(chunk, rows of the chunk, answers to it) for every chunk; only the answers are shuffled."""

    def both(key: tuple, rows: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        return f(int(key[0]), rows, got)

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(both, out)
