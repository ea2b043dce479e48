"""Programs: relations with facts and rules, constraints, and the instructions that bodies are made of."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

# The closed lists of types, operators and kinds; their names are fixed by the interchange formats.
TYPES = ("Boolean", "Integer", "Real", "Symbol", "String")
BINARY = ("Add", "Mul", "Div", "Concat", "And", "Or", "Eq", "Lt", "Le")
UNARY = ("Not", "Negate")
KINDS = ("Basic", "Conditional", "Decision")
IOS = ("None", "Input", "Output")
BOUNDS = ("Only", "AtMost", "AtLeast")

Type = str | tuple  # a name of TYPES, or a tuple of types


def flat(ty: Type) -> list[str]:
    """The columns of a type: nested tuples are laid out in a row."""
    return [ty] if isinstance(ty, str) else [x for part in ty for x in flat(part)]


@dataclass(frozen=True)
class Value:
    type: str
    value: Any


Term = int | Value  # a variable's number, or a value


@dataclass(frozen=True)
class Var:
    index: int


@dataclass(frozen=True)
class Load:
    """Whether a tuple exists; only in logical plans."""

    relation: int
    terms: tuple


@dataclass(frozen=True)
class Unary:
    op: str
    term: Any


@dataclass(frozen=True)
class Binary:
    op: str
    lhs: Any
    rhs: Any


@dataclass(frozen=True)
class Noop:
    pass


@dataclass(frozen=True)
class Sink:
    vars: tuple
    rest: Any


@dataclass(frozen=True)
class FromQuery:
    relation: int
    terms: tuple


@dataclass(frozen=True)
class Filter:
    test: Any
    rest: Any


@dataclass(frozen=True)
class Let:
    var: int
    expr: Any
    rest: Any


@dataclass(frozen=True)
class Join:
    lhs: Any
    rhs: Any


@dataclass(frozen=True)
class Merge:
    lhs: Any
    rhs: Any


@dataclass(frozen=True)
class Antijoin:
    relation: int
    terms: tuple
    rest: Any


@dataclass(frozen=True)
class Body:
    vars: tuple
    loaded: tuple
    instructions: Any


@dataclass(frozen=True)
class Rule:
    head: tuple
    body: Body


@dataclass(frozen=True)
class Constraint:
    head: tuple
    body: Body
    kind: str
    threshold: int
    weight: int | None = None  # None: hard


@dataclass
class Relation:
    name: str
    ty: Type
    kind: str = "Basic"
    io: str = "None"
    facts: list[tuple] = field(default_factory=list)
    rules: list[Rule] = field(default_factory=list)
    stratum: int = 0

    @property
    def columns(self) -> list[str]:
        return flat(self.ty)


@dataclass
class Program:
    relations: dict[str, Relation] = field(default_factory=dict)
    constraints: list[Constraint] = field(default_factory=list)

    def merge(self, other: Program) -> Program:
        """The union of both programs' rules, facts and constraints."""
        out = Program({k: Relation(r.name, r.ty, r.kind, r.io, list(r.facts), list(r.rules), r.stratum) for k, r in self.relations.items()}, list(self.constraints))
        for key, r in other.relations.items():
            if key not in out.relations:
                out.relations[key] = Relation(r.name, r.ty, r.kind, r.io, list(r.facts), list(r.rules), r.stratum)
                continue
            own = out.relations[key]
            own.facts += [f for f in r.facts if f not in own.facts]
            own.rules += [x for x in r.rules if x not in own.rules]
        out.constraints += [c for c in other.constraints if c not in out.constraints]
        return out

    def map_relations(self, f: Callable[[str], str]) -> Program:
        """The same program with other relation names."""
        body = lambda b: Body(b.vars, tuple(map(f, b.loaded)), b.instructions)
        relations = {f(k): Relation(f(k), r.ty, r.kind, r.io, list(r.facts), [Rule(x.head, body(x.body)) for x in r.rules], r.stratum) for k, r in self.relations.items()}
        return Program(relations, [Constraint(c.head, body(c.body), c.kind, c.threshold, c.weight) for c in self.constraints])


def walk(node: Any) -> Iterator[Any]:
    """An instruction and all below it."""
    yield node
    for child in ("rest", "lhs", "rhs"):
        if isinstance(node, (Filter, Let, Join, Merge, Antijoin, Sink)) and hasattr(node, child):
            yield from walk(getattr(node, child))


def uses(body: Body) -> tuple[set[str], set[str]]:
    """Names of the relations that a body reads, and of those that it denies."""
    reads = {body.loaded[n.relation] for n in walk(body.instructions) if isinstance(n, FromQuery)}
    denies = {body.loaded[n.relation] for n in walk(body.instructions) if isinstance(n, Antijoin)}
    return reads, denies
