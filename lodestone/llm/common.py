"""What several operators share: shipping code to workers, settled tables, text columns."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: For Python workers: Arrow uses the C library's allocator, and that one keeps little of what is free.
WORKER_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": str(2 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20)}


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package, wherever the driver was started, and bounds what they hold."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(8 << 20))
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH")) if x)
    # what a worker frees goes back to the system, also between tasks
    for k, v in WORKER_MEMORY.items():
        env.setdefault(k, v)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset and Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = f"file:///tmp/lodestone-{os.getuid()}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, so that lost executors don't undo the work behind it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes a settled table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if path.startswith(shared_dir(spark).replace("file://", "file:")) or path.startswith(shared_dir(spark)):
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which its owner sizes to the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def looked_up(rows: DataFrame, key: str, table: DataFrame, salt: str = "salt") -> DataFrame:
    """rows and what table, with one row for a key, has for their keys, which are not null; the column salt goes.

    The rows of a key ask in a part for each salt, so that they don't meet in one task, however many they are.
    """
    asked = rows.select(key, salt).distinct().join(table, key, "left")
    return rows.join(asked, [key, salt]).drop(salt)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(name: str = "text"):
    """The text column, null counting as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def free_prefix(df: DataFrame, start: str = "__own") -> str:
    """A beginning of names that no column of df has."""
    while any(c.lower().startswith(start) for c in df.columns):
        start += "_"
    return start
