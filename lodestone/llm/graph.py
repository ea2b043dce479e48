"""Connected components of links between ids, without collecting any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, looked_up, parts, settle


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links (a, b); a component is named by its smallest id.

    Labels spread to neighbours and then jump to their label's label, so the rounds grow with the logarithm of the longest
    path. Hubs are harmless: minima are combined before they are shuffled, and the join of links with labels may be split where it is
    skewed. Nor do the ids of one label meet in one task: they ask for its label in as many parts as there are shuffle partitions.
    """
    salt = F.pmod(F.xxhash64("u"), F.lit(parts(links.sparkSession))).alias("salt")
    both = settle(links.select("a", "b").union(links.select("b", "a")).distinct().toDF("u", "v"), "links")
    labels = settle(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).withColumn("changed", F.lit(True)), "labels")
    while labels.where("changed").limit(1).count():
        old = labels.select(F.col("u").alias("v"), F.col("label").alias("near"))
        spread = both.join(old, "v").groupBy("u").agg(F.min("near").alias("near"))
        spread = labels.select("u", "label").join(spread, "u").select("u", "label", F.least("label", "near").alias("next"))
        jump = spread.select(F.col("u").alias("next"), F.col("next").alias("far"))
        jumped = looked_up(spread.select("*", salt), "next", jump).select("u", F.least("next", F.coalesce("far", "next")).alias("new"), "label")
        new = settle(jumped.select("u", F.col("new").alias("label"), (F.col("new") != F.col("label")).alias("changed")), "labels")
        forget(labels)
        labels = new
    forget(both)
    return labels.select(F.col("u").alias("id"), F.col("label").alias("component"))
