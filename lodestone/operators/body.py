"""Instructions as DataFrames.

A body's frame has a column v0, v1, ... for each assigned variable. With conditions, column cond holds the ordered literals
("F:id" a fact holds, "N:id" it doesn't) that a row depends on; an empty array is unconditional.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import column, literal
from ..plans import ir
from ..plans.planner import assigned, variables
from .dealing import dealt

Scan = Callable[[str, int], DataFrame]


def name(i: int) -> str:
    return f"v{i}"


def fact_id(relation: str, columns: list[Column]) -> Column:
    """A name for a fact that its relation and values alone decide."""
    return F.sha2(F.concat_ws("\x1f", F.lit(relation), *[F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")) for c in columns]), 256)


class Runner:
    """Runs bodies. scan(relation, occurrence) gives a relation's frame (c0, c1, ...), once for each place that reads it.

    wanted: the terms whose variables the frame must have; of the others only those that come along, and a row may come once only
    however many values they take. deal: joins deal common keys out over tasks; those of a relation with itself always do.
    """

    def __init__(self, program: ir.Program, body: ir.Body, scan: Scan, wanted: tuple, conditions: bool = False, deal: bool = False):
        self.program, self.body, self.scan, self.conditions, self.deal = program, body, scan, conditions, deal
        self.wanted = {t for t in wanted if not isinstance(t, ir.Value)}
        self.places = 0

    def run(self) -> DataFrame:
        return self._run(self.body.instructions, self.wanted)

    def _column(self, e: Any, at: Callable[[int], Column] = lambda i: F.col(name(i))) -> Column:
        return column(e, at, self.body.vars)

    def _query(self, df: DataFrame, terms: tuple) -> DataFrame:
        """Constants as filters, which reach the files; then only the bound columns."""
        for i, t in enumerate(terms):
            if isinstance(t, ir.Value):
                df = df.where(F.col(f"c{i}") == literal(t))
        return df

    def _run(self, node: Any, wanted: set[int]) -> DataFrame:
        tests = []
        while isinstance(node, ir.Filter):
            tests.insert(0, node.test)
            node = node.rest
        if tests or isinstance(node, ir.Join):
            return self._filtered(node, tests, wanted)
        match node:
            case ir.FromQuery():
                return self._from(node)
            case ir.Let():
                return self._run(node.rest, wanted - {node.var} | variables(node.expr)).withColumn(name(node.var), self._column(node.expr))
            case ir.Merge():
                lhs, rhs = self._run(node.lhs, assigned(node)), self._run(node.rhs, assigned(node))
                return lhs.unionByName(rhs)
            case ir.Antijoin():
                return self._antijoin(node, wanted)
        raise TypeError(f"{type(node).__name__} can't be run")

    def _filtered(self, node: Any, tests: list, wanted: set[int]) -> DataFrame:
        """The rows of node that pass tests. A join's side that adds nothing wanted only has to hold a row for each of the other's."""
        inner = wanted.union(*map(variables, tests))
        if isinstance(node, ir.Join):
            sides = assigned(node.lhs), assigned(node.rhs)
            for i in (1, 0):
                own = sides[i] - sides[1 - i]
                mine = [t for t in tests if variables(t) & own]
                extreme = _extreme(mine[0], own) if len(mine) == 1 else None
                if own and not own & wanted and (sides[0] & sides[1] or extreme is not None) and self._unconditional((node.lhs, node.rhs)[i]):
                    df = self._exists(node, i, mine, extreme, inner)
                    tests = [t for t in tests if t not in mine]
                    break
            else:
                df = self._join(node, inner)
        else:
            df = self._run(node, inner)
        return reduce(lambda x, t: x.where(self._column(t)), tests, df)

    def _unconditional(self, node: Any) -> bool:
        """Whether the rows of node depend on no decision."""
        return not self.conditions or all(self.program.relations[self.body.loaded[x.relation]].kind == "Basic" for x in ir.walk(node) if isinstance(x, (ir.FromQuery, ir.Antijoin)))

    def _exists(self, node: ir.Join, i: int, tests: list, extreme: int | None, wanted: set[int]) -> DataFrame:
        """The rows of a join's one side for which side i has a row that passes tests; by its least and largest values where they tell."""
        shared = assigned(node.lhs) & assigned(node.rhs)
        both = self._run(node.lhs, wanted | shared), self._run(node.rhs, wanted | shared)
        kept, other = both[1 - i], both[i].drop("cond")
        keys = [name(v) for v in sorted(shared)]
        if extreme is not None:
            ends = other.groupBy(*keys).agg(F.min(name(extreme)).alias("least"), F.max(name(extreme)).alias("most"))
            passes = [self._column(tests[0], lambda v, c=c: F.col(c if v == extreme else name(v))) for c in ("least", "most")]
            return (kept.join(ends, keys) if keys else kept.crossJoin(ends)).where(passes[0] | passes[1]).select(*kept.columns)
        if not tests:
            return kept.join(other, keys, "left_semi")
        own = set(other.columns)
        other = other.select(*[F.col(c).alias(f"o_{c}") for c in other.columns])
        match = [F.col(k) == F.col(f"o_{k}") for k in keys] + [self._column(t, lambda v: F.col(f"o_{name(v)}" if name(v) in own and name(v) not in keys else name(v))) for t in tests]
        return kept.join(other, reduce(Column.__and__, match), "left_semi")

    def _from(self, node: ir.FromQuery) -> DataFrame:
        relation = self.body.loaded[node.relation]
        place, self.places = self.places, self.places + 1
        df = self._query(self.scan(relation, place), node.terms)
        out = [F.col(f"c{i}").alias(name(t)) for i, t in enumerate(node.terms) if not isinstance(t, ir.Value)]
        if self.conditions:
            basic = self.program.relations[relation].kind == "Basic"
            out.append((F.array().cast("array<string>") if basic else F.array(F.concat(F.lit("F:"), F.col("id")))).alias("cond"))
        return df.select(*out) if out else df.select(F.lit(1).alias("one"))

    def _join(self, node: ir.Join, wanted: set[int]) -> DataFrame:
        shared = assigned(node.lhs) & assigned(node.rhs)
        lhs, rhs = self._run(node.lhs, wanted | shared), self._run(node.rhs, wanted | shared)
        if self.conditions:
            lhs, rhs = lhs.withColumnRenamed("cond", "l"), rhs.withColumnRenamed("cond", "r")
        shared = [c for c in lhs.columns if c in rhs.columns]
        needed = [c for c in rhs.columns if c not in shared and c != "one"]
        if not needed and shared:
            out = lhs.join(rhs, shared, "left_semi")
        elif shared and (self.deal or self._of_itself(node)):
            out = dealt(lhs, rhs, shared, gathered=self.deal)
        elif shared:
            out = lhs.join(rhs, shared)
        else:
            out = lhs.drop("one").crossJoin(rhs.drop("one"))
        return out.withColumn("cond", F.concat("l", "r")).drop("l", "r") if self.conditions else out

    def _of_itself(self, node: ir.Join) -> bool:
        """Whether a relation is joined with itself by the same columns, so that a key's rows all meet each other."""
        a, b = node.lhs, node.rhs
        if not (isinstance(a, ir.FromQuery) and isinstance(b, ir.FromQuery) and a.relation == b.relation):
            return False
        return all(a.terms.index(v) == b.terms.index(v) for v in assigned(a) & assigned(b))

    def _antijoin(self, node: ir.Antijoin, wanted: set[int]) -> DataFrame:
        rest = self._run(node.rest, wanted | {t for t in node.terms if not isinstance(t, ir.Value)})
        relation = self.body.loaded[node.relation]
        basic = self.program.relations[relation].kind == "Basic"
        if not basic and not self.conditions:
            return rest  # a decision may be left out, so every row stays possible
        df = self._query(self.scan(relation, -1), node.terms)
        on = [(name(t), f"c{i}") for i, t in enumerate(node.terms) if not isinstance(t, ir.Value)]
        right = df.select(*[F.col(c).alias(f"a_{v}") for v, c in on], *([] if basic else [F.col("id").alias("a_id")])).distinct()
        if not on:
            right = right if not basic else df.select(F.lit(1).alias("a_one")).limit(1)
        match = F.lit(True)
        for v, _ in on:
            match = match & (F.col(v) == F.col(f"a_{v}"))
        if basic:
            return rest.join(right, match, "left_anti")
        out = rest.join(right, match, "left")
        cond = F.when(F.col("a_id").isNull(), F.col("cond")).otherwise(F.concat("cond", F.array(F.concat(F.lit("N:"), F.col("a_id")))))
        return out.withColumn("cond", cond).drop(*[c for c in out.columns if c.startswith("a_")])


def head(df: DataFrame, terms: tuple, conditions: bool = False) -> DataFrame:
    """A rule's rows: its head's variables and constants as c0, c1, ..."""
    out = [(literal(t) if isinstance(t, ir.Value) else F.col(name(t))).alias(f"c{i}") for i, t in enumerate(terms)]
    return df.select(*out, *([F.col("cond")] if conditions else []))


def _extreme(test: Any, own: set[int]) -> int | None:
    """The variable of own in a comparison that some value of it passes if, and only if, the least or the largest does."""
    negated = isinstance(test, ir.Unary) and test.op == "Not"
    e = test.term if negated else test
    if isinstance(e, ir.Binary) and (e.op in ("Lt", "Le") or e.op == "Eq" and negated):
        for a, b in ((e.lhs, e.rhs), (e.rhs, e.lhs)):
            if isinstance(a, ir.Var) and a.index in own and not variables(b) & own:
                return a.index
    return None


def tells_all(body: ir.Body, terms: tuple) -> bool:
    """Whether a body's rows, distinct as those of its relations are, stay distinct with the terms of a head alone."""
    told = {t for t in terms if not isinstance(t, ir.Value)}
    nodes = list(ir.walk(body.instructions))
    # reals are left out: a computed one may be -0.0, which distinct makes 0.0
    if any(isinstance(n, ir.Merge) for n in nodes) or any(body.vars[t] == "Real" if isinstance(t, int) else t.type == "Real" for t in terms):
        return False
    while True:
        more = {n.var for n in nodes if isinstance(n, ir.Let) and variables(n.expr) <= told}
        for n in nodes:
            if isinstance(n, ir.Filter) and isinstance(e := n.test, ir.Binary) and e.op == "Eq" and isinstance(e.lhs, ir.Var) and isinstance(e.rhs, ir.Var) and {e.lhs.index, e.rhs.index} & told:
                more |= {e.lhs.index, e.rhs.index}
        if more <= told:
            return assigned(body.instructions) <= told
        told |= more
