"""What must hold between decisions: one pass over all bodies, after all possible facts are known.

implies: one row (fact, relation, cond) for each way to derive a fact that isn't basic.
terms: one row (cid, group, cond) for each distinct condition that a constraint counts in a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import ir
from .body import Runner, fact_id, head
from .fixpoint import facts_frame, normalised

EMPTY = "cast(array() as array<string>)"


def _with_ids(df: DataFrame, relation: ir.Relation) -> DataFrame:
    return df.withColumn("id", fact_id(relation.name, [F.col(f"c{i}") for i in range(len(relation.columns))]))


def circuit(spark: SparkSession, program: ir.Program, known: dict[str, DataFrame], inputs: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The frames implies and terms."""
    scan = lambda name, _: known[name] if program.relations[name].kind == "Basic" else _with_ids(known[name], program.relations[name])
    rows = [spark.createDataFrame([], "fact string, relation string, cond array<string>")]
    for name, relation in program.relations.items():
        if relation.kind == "Basic":
            continue
        free = [facts_frame(spark, relation)] if relation.facts else []
        free += [normalised(inputs[name], relation)] if name in inputs else []
        derived = [df.withColumn("cond", F.expr(EMPTY)) for df in free]
        derived += [head(Runner(program, r.body, scan, r.head, True).run(), r.head, True) for r in relation.rules]
        for df in derived:
            rows.append(_with_ids(df, relation).select(F.col("id").alias("fact"), F.lit(name).alias("relation"), "cond"))
    implies = reduce(DataFrame.unionByName, rows).distinct()

    groups = [spark.createDataFrame([], "cid int, `group` string, cond array<string>")]
    for cid, c in enumerate(program.constraints):
        df = Runner(program, c.body, scan, c.head, True).run()
        # conditions that always hold are not counted
        key = F.to_json(F.struct(*[F.col(f"v{i}").alias(f"k{n}") for n, i in enumerate(c.head)])) if c.head else F.lit("{}")
        groups.append(df.where(F.size("cond") > 0).select(F.lit(cid).alias("cid"), key.alias("group"), "cond"))
    return implies, reduce(DataFrame.unionByName, groups).distinct()


def support(implies: DataFrame) -> DataFrame:
    """(fact, relation, uncond, ders): whether a fact has an unconditional derivation, and all its derivations' conditions."""
    return implies.groupBy("fact", "relation").agg(F.bool_or(F.size("cond") == 0).alias("uncond"), F.collect_set("cond").alias("ders"))


def constraint_groups(program: ir.Program, terms: DataFrame) -> DataFrame:
    """(kind, threshold, weight, terms): groups with the same terms, weight and kind are one."""
    spark = terms.sparkSession
    about = spark.createDataFrame([(i, c.kind, c.threshold, c.weight) for i, c in enumerate(program.constraints)], "cid int, kind string, threshold long, weight long")
    found = terms.groupBy("cid", "group").agg(F.sort_array(F.collect_set("cond")).alias("terms"))
    return found.join(F.broadcast(about), "cid").select("kind", "threshold", "weight", "terms").distinct()
