"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again as the next stage's docs. All
but the last return the columns of documents.

* quality: documents that the co-trained classifier rejects go.
* exact_dedup: of documents with equal texts the one with the smallest id stays.
* near_dedup: documents whose sets of 5-word shingles reach a Jaccard similarity of 0.8 link; of each group of linked
  documents the one with the smallest id stays (a null id is the smallest; of equal ids one row stays). Rows count one by one, also
  those that share an id or have none. Documents without words stay.
* secrets: secrets are replaced by a mark in their texts; every document stays.
* packing: pieces of sequences of at most 4096 tokens.

An empty table passes through every stage; null texts are kept as empty ones by the classifier's verdict on them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import exact_dedup, ngram_join, packing, quality, secrets
from lodestone.llm.common import documents, settle


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.kept(docs, model)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # rows are told apart by dense numbers of their own: ids may repeat or be null
    rows = settle(docs.select("*", F.monotonically_increasing_id().alias("__at"), F.xxhash64("text").alias("__tie")), "rows")
    part, low = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r["part"], r["n"]) for r in rows.groupBy(part.alias("part")).agg((F.max(low) + 1).alias("n")).collect())
    firsts = [(p, sum(n for _, n in sizes[:i])) for i, (p, _) in enumerate(sizes)]
    firsts = F.broadcast(spark.createDataFrame(firsts, "__part long, __first long"))  # a row for each part
    rows = rows.withColumn("__part", part).join(firsts, "__part").withColumn("__row", F.col("__first") + low)
    found = ngram_join.join(rows.select("__row", "text"), k=5, percent=80, id_col="__row")
    found = found.join(rows.select(F.col("__row").alias("id"), "doc_id", "__tie"), "id")
    stays = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "__tie", "id")).alias("first")).select(F.col("first.id").alias("id"))
    # only the rows that go are joined: they are few
    gone = found.select("id").join(stays, "id", "left_anti").select(F.col("id").alias("__row"))
    return rows.join(gone, "__row", "left_anti").select(docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs).withColumnRenamed("id", "doc_id")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: The classifier and the tokenizer have no SQL; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
