"""All possible facts of a program: components of relations in order, recursive ones to their fixpoint.

Conditions play no part in what is possible: a decision may hold, and a denial of a decision or of what depends on one may hold too.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import SPARK
from ..plans import ir
from ..plans.stratify import components
from . import small
from .body import Runner, head, tells_all
from .storage import settle

ROUNDS = 10_000
SMALL = 2_000  # rows of input up to which a recursive component runs in the driver
SMALL_OUT = 20_000  # rows it may come to
MANY = 1 << 20  # rows of a recursive component from which its joins deal out common keys


def frame_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(f"c{i}", SPARK[t], True) for i, t in enumerate(columns)])


def facts_frame(spark: SparkSession, relation: ir.Relation) -> DataFrame:
    return spark.createDataFrame([tuple(v.value for v in f) for f in relation.facts], frame_schema(relation.columns))


def normalised(df: DataFrame, relation: ir.Relation) -> DataFrame:
    """A table as a relation: columns by place, cast to its types, without nulls. Timestamps count as microseconds."""
    out = []
    for i, (c, t) in enumerate(zip(df.columns, relation.columns)):
        col = F.col(f"`{c}`")
        kind = df.schema[i].dataType
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            col = F.unix_micros(col.cast("timestamp"))
        out.append(col.cast(SPARK[t]).alias(f"c{i}"))
    if len(df.columns) != len(relation.columns):
        raise TypeError(f"{relation.name} has {len(relation.columns)} columns, the table {len(df.columns)}")
    # NaN is a value like any other; only null has no place in a relation
    return df.select(*out).where(reduce(Column.__and__, [F.col(f"c{i}").isNotNull() for i in range(len(out))], F.lit(True)))


def possible(spark: SparkSession, program: ir.Program, inputs: dict[str, DataFrame], rounds: int = ROUNDS) -> dict[str, DataFrame]:
    """A frame of distinct rows for each relation."""
    known: dict[str, DataFrame] = {}
    reads = Counter(b.loaded[x.relation] for b in _bodies(program) for x in ir.walk(b.instructions) if isinstance(x, (ir.FromQuery, ir.Antijoin)))
    for names in components(program):
        base = {}
        for n in names:
            relation = program.relations[n]
            parts = [normalised(inputs[n], relation)] if n in inputs else []
            if relation.facts or not parts and not relation.rules:
                parts.append(facts_frame(spark, relation))
            base[n] = parts
        recursive = len(names) > 1 or any(n in rule.body.loaded for n in names for rule in program.relations[n].rules)
        if recursive:
            known |= _recursive(spark, program, names, base, known, rounds)
        else:
            (n,) = names
            rules = program.relations[n].rules
            rows = base[n] + [head(Runner(program, r.body, lambda x, _: known[x], r.head).run(), r.head) for r in rules]
            # rows that are distinct by themselves are not brought together: there may be many more than in the tables they come from
            alone = not base[n] and len(rules) == 1 and tells_all(rules[0].body, rules[0].head)
            known[n] = rows[0] if alone else reduce(DataFrame.unionByName, rows).distinct()
            # what several bodies, or a body and the circuit, read is derived once
            if program.relations[n].rules and reads[n] + (program.relations[n].kind != "Basic") > 1:
                known[n] = settle(known[n], n)
    return known


def _bodies(program: ir.Program) -> list[ir.Body]:
    return [r.body for x in program.relations.values() for r in x.rules] + [c.body for c in program.constraints]


def _recursive(spark: SparkSession, program: ir.Program, names: list[str], base: dict, known: dict[str, DataFrame], rounds: int) -> dict[str, DataFrame]:
    empty = {n: spark.createDataFrame([], frame_schema(program.relations[n].columns)) for n in names}
    start = {n: reduce(DataFrame.unionByName, base[n], empty[n]).distinct() for n in names}
    needs = {x for n in names for r in program.relations[n].rules for x in r.body.loaded} - set(names)
    tables = _few(needs, names, start, known)
    if tables is not None:
        try:
            found = small.fixpoint(program, names, tables, SMALL_OUT, rounds)
            return {n: spark.createDataFrame(sorted(found[n]), frame_schema(program.relations[n].columns)) for n in names}
        except small.TooLarge:
            pass
    # What the loop reads again and again is computed once.
    fixed = {x: settle(known[x], x) for x in needs}
    scan = lambda x, _: fixed[x]
    rules = [(n, r, [x for x in ir.walk(r.body.instructions) if isinstance(x, ir.FromQuery)]) for n in names for r in program.relations[n].rules]
    for n, r, reads in rules:
        if not any(r.body.loaded[x.relation] in names for x in reads):
            start[n] = start[n].unionByName(head(Runner(program, r.body, scan, r.head).run(), r.head)).distinct()
    delta = {n: settle(start[n], n) for n in names}
    every, rows = dict(delta), sum(df.count() for df in delta.values())
    for _ in range(rounds):
        new: dict[str, list[DataFrame]] = {n: [] for n in names}
        for n, r, reads in rules:
            mine = [i for i, x in enumerate(reads) if r.body.loaded[x.relation] in names]
            for turn in mine:  # one occurrence reads what the last round found, the others all there is
                at = lambda x, place, turn=turn: (delta if place == turn else every)[x] if x in names else fixed[x]
                new[n].append(head(Runner(program, r.body, at, r.head, deal=rows > MANY).run(), r.head))
        found = {n: settle(reduce(DataFrame.unionByName, dfs).distinct().join(every[n], every[n].columns, "left_anti"), n) if dfs else empty[n] for n, dfs in new.items()}
        came = sum(df.count() for df in found.values())
        if not came:
            return every
        rows += came
        delta = found
        # unions of settled tables stay shallow: they are rewritten every few rounds
        every = {n: every[n].unionByName(delta[n]) for n in names}
        if _ % 8 == 7:
            every = {n: settle(df, n) for n, df in every.items()}
    raise RecursionError(f"{', '.join(names)}: no fixpoint within {rounds} rounds")


def _few(needs: set, names: list[str], start: dict, known: dict) -> dict[str, set] | None:
    """All rows that a component reads, if they are few."""
    tables, total = {}, 0
    for n, df in [*((n, start[n]) for n in names), *((x, known[x]) for x in sorted(needs))]:
        rows = df.limit(SMALL + 1 - total).collect()
        total += len(rows)
        if total > SMALL:
            return None
        tables[n] = {tuple(r) for r in rows}
    return tables
