"""Cost-balanced packing of documents into training sequences.

Attention makes a piece of n tokens cost n + n * n / LENGTH, linear plus quadratic. Documents are dealt into buckets of
bounded size by hash (rows alike by their number too), and each bucket is packed alone: whole lengths of a document become sequences of their own; what is
left goes, dearest first, to the cheapest sequence with room for it; where no sequence has the room, the document is cut to fill
the roomiest one and its rest is placed in its turn. A bucket has as many sequences as its tokens need, so its padding is
under one sequence.

Defined results: a null or empty text is its end id alone; rows that repeat an id are packed as documents of their own,
one after the other; an empty table gives an empty result; other columns take no part. A longer document than a bucket
is packed like any other, in the task of its bucket.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .bpe import encoder, vocabulary_path
from .bulk_bpe import BATCH_BYTES, encode_all
from .chunks import NO_ID, id_column
from .common import documents, ready

LENGTH = 4096
END = 2
BUCKET_BYTES = 4 << 20


def cost(n, length: int = LENGTH):
    return n + n * n / length


def assign(sizes: list[int], length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """Pieces (document, start, size, sequence) of documents of these sizes."""
    out, sequences, queue = [], 0, []
    for i, n in enumerate(sizes):
        full = n // length
        out += [(i, k * length, length, sequences + k) for k in range(full)]
        sequences += full
        if n % length:
            queue.append((-(n % length), i, full * length))
    left = math.ceil(-sum(q[0] for q in queue) / length)
    room, spent = np.full(left, length), np.zeros(left)
    heapq.heapify(queue)
    while queue:
        n, i, start = heapq.heappop(queue)
        n = -n
        fits = np.where(room >= n, spent, np.inf)
        at = int(fits.argmin())
        if not np.isfinite(fits[at]):
            at = int(room.argmax())
            cut = int(room[at])
            heapq.heappush(queue, (cut - n, i, start + cut))
            n = cut
        out.append((i, start, n, sequences + at))
        room[at] -= n
        spent[at] += cost(n, length)
    return out


def packed(df: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END, id_col: str = "doc_id", text_col: str = "text", ids_out: bool = False) -> DataFrame:
    """Pieces (id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids])."""
    spark = ready(df.sparkSession)
    path = path or vocabulary_path()
    total = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(1, math.ceil(total / BUCKET_BYTES))

    def tokens(batches):
        seen: Counter = Counter()
        for whole in batches:
            for batch in K.batch_slices(whole, 1, BATCH_BYTES):
                texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
                row = K.mix(batch.column(0).to_numpy().view(np.uint64) + K.mix(np.array([zlib.crc32(t) + 1 for t in texts], np.uint64)))
                # rows alike go to buckets by how many of them this task has had
                turn = []
                for x in row.tolist():
                    turn.append(seen[x])
                    seen[x] += 1
                bucket = (K.mix(row + np.array(turn, np.uint64)) % np.uint64(buckets)).astype(np.int32)
                blobs = [K.squeeze(np.append(ids, end).astype(kind)) for ids in encode_all(path, texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bucket), pa.array(blobs, pa.binary())], ["id", "bucket", "ids"])

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ids = rows["id"].to_numpy(np.int64)
        blobs = rows["ids"].tolist()
        order = sorted(range(len(blobs)), key=lambda i: (ids[i], blobs[i]))
        ids, held = ids[order], [K.unsqueeze(blobs[i], kind) for i in order]
        pieces = sorted(assign([len(x) for x in held], length), key=lambda p: (p[3], -p[2], p[0], p[1]))
        out, last, offset = [], None, 0
        for i, start, n, sequence in pieces:
            offset = 0 if sequence != last else offset
            part = held[i][start : start + n].astype("<u4")
            out.append((ids[i], start, n, zlib.crc32(part.tobytes()), len(held[i]), (int(key[0]) << 32) + sequence, offset, *([part.astype(np.int32)] if ids_out else [])))
            offset, last = offset + n, sequence
        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if ids_out else [])]
        out = pd.DataFrame(out, columns=names)
        out["id"] = id_column(out["id"].to_numpy(np.int64))
        return out

    kind = np.uint16 if max(*encoder(path).strings, end) < 1 << 16 else np.uint32
    text = F.col(text_col)
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), text.alias("text")).mapInArrow(tokens, "id long, bucket int, ids binary")
    more = ", ids array<int>" if ids_out else ""
    return rows.groupBy("bucket").applyInPandas(pack, "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + more)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
