"""Exact deduplication by skew-safe combining.

Texts are equal when identical after each run of ASCII white space has become one space. Rows are combined in three
stages, and each compares full contents, never only digests:

1. in each task, by the partial aggregation of stage 2 (before anything is shuffled);
2. by (digest, salt, content), so that a group holding a third of all rows is spread over ``SALTS`` tasks;
3. the salts' winners by (digest, content).

The content travels compressed. Equal contents give equal compressed bytes and the reverse, so comparing these
compares the contents.

Defined results: a null text counts as empty; a text of white space only is one space; ties in doc_id keep every such
row marked (``deduplicate`` then keeps one of them); a null doc_id stays only if its whole group has none. Other columns,
whatever their names, take no part. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import documents, free_prefix, ready

SALTS = 16
SPACE = b" \t\n\x0b\x0c\r"


def normalised(text: bytes) -> bytes:
    """One space for each run of ASCII white space, at the ends too."""
    out = b" ".join(text.split())
    if not text:
        return b""
    if not out:
        return b" "
    return (b" " if text[:1] in SPACE else b"") + out + (b" " if text[-1:] in SPACE else b"")


def _digests(batches):
    packer = zstandard.ZstdCompressor(level=3)
    for whole in batches:
        for batch in K.batch_slices(whole, 1):
            shas, packed = [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                content = normalised(text or b"")
                shas.append(hashlib.sha256(content).digest())
                packed.append(packer.compress(content))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shas, pa.binary()), pa.array(packed, pa.binary())], ["id", "sha", "content"])


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, sha, keep_id, group_size) for each row of df."""
    spark = ready(df.sparkSession)
    kind = df.select(id_col).schema[0].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_digests, f"id {kind}, sha binary, content binary")
    salted = rows.groupBy("sha", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"), "content").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = salted.groupBy("sha", "content").agg(F.min("first").alias("keep_id"), F.sum("n").alias("group_size"))
    # A second digest of the content tells apart contents that share the first one.
    mark = F.xxhash64("content").alias("mark")
    spark_side = rows.select("id", "sha", mark)
    return spark_side.join(whole.select("sha", mark, "keep_id", "group_size"), ["sha", "mark"]).select("id", "sha", "keep_id", "group_size")


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay, with df's columns; of rows that tie in id and content one stays."""
    found = groups(df, id_col, text_col)
    own = free_prefix(df)  # names that df doesn't have
    stays = found.where(F.col("id").eqNullSafe(F.col("keep_id"))).select(F.col("id").alias(f"{own}id"), F.lower(F.hex("sha")).alias(f"{own}stay")).distinct()
    sha = F.sha2(F.regexp_replace(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), r"[\x20\x09-\x0D]+", " "), 256)
    rows = df.withColumn(f"{own}sha", sha)
    kept = rows.join(stays, F.col(f"`{id_col}`").eqNullSafe(F.col(f"{own}id")) & (F.col(f"{own}sha") == F.col(f"{own}stay")), "left_semi")
    return kept.dropDuplicates([id_col, f"{own}sha"]).select(*[F.col(f"`{c}`") for c in df.columns])


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


ORACLE = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""
