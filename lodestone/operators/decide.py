"""Choosing decisions: components of the circuit, each solved alone and in parallel, and the outputs that come of it."""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans import ir
from ..plans.validate import ProgramError
from .body import fact_id
from .circuit import circuit, constraint_groups, support
from .fixpoint import possible
from .solver import Problem, solve
from .storage import settle

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@dataclass
class Outcome:
    """What a program came to. status: SAT (the optimum), UNSAT, and with a bounded search also FEASIBLE (the best model found, at
    cost) and UNKNOWN (none found). outputs holds the frames of output relations, empty where there is no model."""

    status: str
    cost: int
    known: dict[str, DataFrame]
    outputs: dict[str, DataFrame]
    truth: DataFrame | None = None
    implies: DataFrame | None = None
    terms: DataFrame | None = None

    def rows(self, name: str) -> list[tuple]:
        return sorted(tuple(r) for r in self.outputs[name].collect())


def _components(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component) for every node; labels spread along pairs (a, b) until they stay."""
    both = settle(pairs.select("a", "b").union(pairs.select("b", "a")).distinct(), "pairs")
    labels = settle(nodes.select("node", F.col("node").alias("component")), "labels")
    while True:
        spread = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(spread, F.col("node") == F.col("a"), "left").select("node", F.least("component", "near").alias("next"), "component")
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("far"))
        new = settle(step.join(jump, "next", "left").select("node", F.least("next", "far").alias("to"), "component"), "labels")
        if not new.where("to != component").limit(1).count():
            return new.select("node", "component")
        labels = new.select("node", F.col("to").alias("component"))


def _quick(program: ir.Program, implies: DataFrame, terms: DataFrame) -> DataFrame | None:
    """Truth without search, where all is free: every fact is a free decision in at most one hard group of single positive terms.

    The first k facts of a group stay (all of them for "at least"). None where that doesn't hold, or a group is too small. Works on
    rows alone, so that a group may be of any size.
    """
    spark = terms.sparkSession
    if terms.where("size(cond) != 1 or left(cond[0], 1) != 'F'").limit(1).count():
        return None
    decisions = [n for n, r in program.relations.items() if r.kind == "Decision"]
    facts = implies.groupBy("fact", "relation").agg(F.bool_or(F.size("cond") == 0).alias("uncond"))
    if facts.where(~F.col("relation").isin(decisions) | ~F.col("uncond")).limit(1).count():
        return None
    about = spark.createDataFrame([(i, c.kind, c.threshold, c.weight) for i, c in enumerate(program.constraints)], "cid int, kind string, threshold long, weight long")
    sizes = terms.groupBy("cid", "group").agg(F.count(F.lit(1)).alias("n"))
    if sizes.join(F.broadcast(about), "cid").where("weight is not null or (kind != 'AtMost' and threshold > n)").limit(1).count():  # a row for each constraint
        return None
    members = terms.select("cid", "group", F.substring(F.element_at("cond", 1), 3, 64).alias("fact"))
    if members.groupBy("fact").count().where("count > 1").limit(1).count():
        return None
    kept = {}
    for i, c in enumerate(program.constraints):
        kept.setdefault(None if c.kind == "AtLeast" else c.threshold, []).append(i)
    picked = []
    for k, cids in kept.items():
        own = members.where(F.col("cid").isin(cids))
        if k is None:
            picked.append(own.select("fact"))
        elif k == 1:  # combined before it is shuffled, however large the group
            picked.append(own.groupBy("cid", "group").agg(F.min("fact").alias("fact")).select("fact"))
        elif k > 1:
            picked.append(own.withColumn("rank", F.row_number().over(Window.partitionBy("cid", "group").orderBy("fact"))).where(F.col("rank") <= k).select("fact"))
    free = facts.select("fact").join(members.select("fact"), "fact", "left_anti")
    return reduce(DataFrame.unionByName, picked, free).withColumn("holds", F.lit(True))


def decide(spark: SparkSession, program: ir.Program, inputs: dict[str, DataFrame] | None = None, conflicts: int | None = None) -> Outcome:
    """Solves a program over its inputs. conflicts bounds the search of each component; without it the search ends with the optimum."""
    inputs = inputs or {}
    for name in inputs:
        if name not in program.relations or program.relations[name].io != "Input":
            raise ProgramError("NoSuchRelation", name)
    known = possible(spark, program, inputs)
    outputs = {n: known[n] for n, r in program.relations.items() if r.io == "Output"}
    if all(r.kind == "Basic" for r in program.relations.values()):
        return Outcome("SAT", 0, known, outputs)
    implies, terms = (settle(df, name) for df, name in zip(circuit(spark, program, known, inputs), ("implies", "terms")))
    truth = _quick(program, implies, terms)
    status, cost = "SAT", 0
    if truth is None:
        kinds = spark.createDataFrame([(n, r.kind) for n, r in program.relations.items()], "relation string, kind string")
        facts = settle(support(implies).join(F.broadcast(kinds), "relation").select("fact", "kind", "uncond", "ders"), "facts")  # a row for each relation
        groups = settle(constraint_groups(program, terms), "groups")
        solved = _search(spark, facts, groups, conflicts)
        told = solved.where("fact is null").groupBy("status").agg(F.sum("cost").alias("cost")).collect()
        states = {r["status"] for r in told}
        status = next((x for x in ("UNSAT", "UNKNOWN", "FEASIBLE") if x in states), "SAT")
        cost = sum(r["cost"] for r in told)
        truth = solved.where("fact is not null").select("fact", F.lit(True).alias("holds"))
    chosen = {}
    for n, df in outputs.items():
        relation = program.relations[n]
        if relation.kind != "Basic":
            held = truth.where("holds").select("fact")
            ids = df.withColumn("fact", fact_id(n, [F.col(f"c{i}") for i in range(len(relation.columns))]))
            df = ids.join(held, "fact", "left_semi").drop("fact")
        chosen[n] = df if status in ("SAT", "FEASIBLE") else df.limit(0)
    return Outcome(status, cost, known, chosen, truth, implies, terms)


def _search(spark: SparkSession, facts: DataFrame, groups: DataFrame, conflicts: int | None) -> DataFrame:
    """(status, cost, fact): one row without fact for each component, and its true facts."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH")) if x)
    groups = groups.withColumn("gid", F.concat(F.lit("g"), F.sha2(F.to_json(F.struct("kind", "threshold", "weight", "terms")), 256)))
    uses = lambda c: F.transform(F.flatten(c), lambda x: F.substring(x, 3, 64))
    in_groups = groups.select(F.col("gid").alias("a"), F.explode(F.array_distinct(uses(F.col("terms")))).alias("b"))
    in_facts = facts.select(F.col("fact").alias("a"), F.explode(F.array_distinct(uses(F.col("ders")))).alias("b"))
    nodes = facts.select(F.col("fact").alias("node")).union(groups.select(F.col("gid").alias("node")))
    home = _components(reduce(DataFrame.union, [in_groups, in_facts]), nodes)
    rows = facts.select(F.col("fact").alias("node"), "kind", F.col("uncond").alias("free"), F.lit(None).cast("long").alias("threshold"), F.lit(None).cast("long").alias("weight"), F.col("ders").alias("conds"))
    rows = rows.unionByName(groups.select(F.col("gid").alias("node"), "kind", F.lit(None).cast("boolean").alias("free"), "threshold", "weight", F.col("terms").alias("conds")))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        lists = [[list(c) for c in x] for x in part["conds"]]
        problem = Problem([], [])
        for node, kind, free, k, w, conds in zip(part["node"], part["kind"], part["free"], part["threshold"], part["weight"], lists):
            if kind in ir.BOUNDS:
                problem.groups.append((kind, int(k), None if pd.isna(w) else int(w), conds))
            else:
                problem.facts.append((node, kind, bool(free), [c for c in conds if c]))
        found = solve(problem, conflicts)
        return pd.DataFrame({"status": found.status, "cost": [found.cost] + [0] * len(found.true), "fact": [None, *found.true]})

    solved = rows.join(home, "node").groupBy("component").applyInPandas(run, "status string, cost long, fact string")
    return settle(solved, "solved")
