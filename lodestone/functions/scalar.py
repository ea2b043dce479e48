"""Scalar expressions as columns, and as plain Python for small inputs."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import ir

SPARK = {"Boolean": T.BooleanType(), "Integer": T.LongType(), "Real": T.DoubleType(), "Symbol": T.StringType(), "String": T.StringType()}


def literal(v: ir.Value) -> Column:
    return F.lit(v.value).cast(SPARK[v.type])


def type_of(e: Any, types: tuple) -> str:
    if isinstance(e, ir.Var):
        return types[e.index]
    if isinstance(e, ir.Value):
        return e.type
    if isinstance(e, ir.Unary):
        return type_of(e.term, types)
    return "Boolean" if e.op in ("Eq", "Lt", "Le", "And", "Or") else type_of(e.lhs, types)


def column(e: Any, name: Callable[[int], Column], types: tuple) -> Column:
    """The column of an expression; integers overflow with an error, and reals divide as in IEEE 754."""
    if isinstance(e, ir.Var):
        return name(e.index)
    if isinstance(e, ir.Value):
        return literal(e)
    if isinstance(e, ir.Unary):
        inner = column(e.term, name, types)
        return ~inner if e.op == "Not" else -inner
    a, b = column(e.lhs, name, types), column(e.rhs, name, types)
    match e.op:
        case "Add":
            return a + b
        case "Mul":
            return a * b
        case "Div" if type_of(e.lhs, types) == "Integer":
            return F.call_function("div", a, b)
        case "Div":
            zero = F.when((a == 0) | F.isnan(a), F.lit(math.nan)).when((a > 0) == (F.atan2(F.lit(0.0), b) == 0), F.lit(math.inf)).otherwise(F.lit(-math.inf))
            return F.when(b == 0, zero).otherwise(a / F.when(b != 0, b))
        case "Concat":
            return F.concat(a, b)
        case "And":
            return a & b
        case "Or":
            return a | b
        case "Eq":
            return a == b
        case "Lt":
            return a < b
        case _:
            return a <= b


def same(a, b) -> bool:
    """Equality with NaN equal to itself."""
    return a == b or a != a and b != b


def canonical(v):
    """The value, NaN as one object, so that sets and joins find it again."""
    return math.nan if v != v else v


def divide(a, b, ty: str):
    if ty == "Integer":
        if b == 0:
            raise ZeroDivisionError("integer division by zero")
        return abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
    if b == 0:
        return math.nan if a == 0 or a != a else math.copysign(math.inf, a) * math.copysign(1, b)
    return a / b


def evaluate(e: Any, row: dict[int, Any], types: tuple) -> Any:
    """The value of an expression over a row of variables; NaN equals itself and is the largest real."""
    if isinstance(e, ir.Var):
        return row[e.index]
    if isinstance(e, ir.Value):
        return canonical(e.value)
    if isinstance(e, ir.Unary):
        inner = evaluate(e.term, row, types)
        return not inner if e.op == "Not" else canonical(-inner)
    a, b = evaluate(e.lhs, row, types), evaluate(e.rhs, row, types)
    match e.op:
        case "Add" | "Mul":
            out = a + b if e.op == "Add" else a * b
            if isinstance(out, int) and not -(1 << 63) <= out < 1 << 63:
                raise OverflowError("integer overflow")
            return canonical(out)
        case "Div":
            return canonical(divide(a, b, type_of(e.lhs, types)))
        case "Concat":
            return a + b
        case "And":
            return a and b
        case "Or":
            return a or b
        case "Eq":
            return same(a, b)
        case "Lt":
            return a < b or a == a and b != b
        case _:
            return a <= b or b != b
