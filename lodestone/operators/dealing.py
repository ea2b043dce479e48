"""Joins whose common keys are dealt out over tasks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 2_048  # rows of a key on one side that stay together
KEYS = 5_000  # so many keys, those with the most rows, are dealt out; any other then has less than a part in KEYS of all rows
PAIRS = 1 << 24  # pairs of rows for a task, about, where nothing gathers them
GATHERED = 1 << 21  # rows read and pairs made for a task, about, where it also makes them distinct


def dealt(lhs: DataFrame, rhs: DataFrame, shared: list[str], gathered: bool = False) -> DataFrame:
    """The join of lhs and rhs. A key's rows on both sides are cut into parts, and each two parts meet by themselves.

    A row is copied once for each part on the other side, which is less than a row for ROWS pairs that the join has anyway.
    """
    spark = lhs.sparkSession
    sides = lhs.select(*shared, F.lit(1).alias("l"), F.lit(0).alias("r")).union(rhs.select(*shared, F.lit(0), F.lit(1)))
    counts = sides.groupBy(*shared).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))  # also keys of one side: their rows are sorted all the same
    common = counts.where(F.greatest("l", "r") > ROWS).orderBy(F.greatest("l", "r").desc()).limit(KEYS).withColumn("pairs", F.lit(None).cast("double"))
    work = F.col("l").cast("double") * F.col("r") + (F.col("l") + F.col("r") if gathered else 0)
    total = counts.agg(F.sum(work).alias("pairs"))
    total = total.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in counts.schema], "pairs")
    *common, total = sorted(common.unionByName(total).collect(), key=lambda r: r["l"] is None)
    tasks = math.ceil((total["pairs"] or 0) / (GATHERED if gathered else PAIRS))
    if not common and tasks < 2:
        return lhs.join(rhs, shared)
    parts = [(*r[: len(shared)], max(1, -(-r["l"] // ROWS)), max(1, -(-r["r"] // ROWS))) for r in common]
    parts = F.broadcast(spark.createDataFrame(parts, counts.select(*shared, F.col("l").alias("lefts"), F.col("r").alias("rights")).schema))  # KEYS rows
    own = lambda df: F.xxhash64(*[c for c in df.columns if c not in shared])
    one = lambda c: F.coalesce(F.col(c), F.lit(1))
    a, b = lhs.join(parts, shared, "left"), rhs.join(parts, shared, "left")
    a = a.withColumn("at_l", F.pmod(own(lhs), one("lefts"))).withColumn("at_r", F.explode(F.sequence(F.lit(0).cast("long"), one("rights") - 1)))
    b = b.withColumn("at_r", F.pmod(own(rhs), one("rights"))).withColumn("at_l", F.explode(F.sequence(F.lit(0).cast("long"), one("lefts") - 1)))
    on = [*shared, "at_l", "at_r"]
    a, b = a.drop("lefts", "rights"), b.drop("lefts", "rights")
    if tasks > 1:  # the rows to join are few beside what comes of them: left alone, Spark would give them to few tasks
        n = max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))
        a, b = a.repartition(n, *on), b.repartition(n, *on)
    return a.join(b, on).drop("at_l", "at_r")
