"""Text lines of output relations: ``Name value.`` or ``Name(a, (b, c)).``"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import ir


def _value(c: Column, ty: str) -> Column:
    if ty == "Boolean":
        return F.when(c, "True").otherwise("False")
    return F.concat(F.lit('"'), c, F.lit('"')) if ty == "String" else c.cast("string")


def _part(ty: ir.Type, columns: list[Column]) -> Column:
    if isinstance(ty, str):
        return _value(columns.pop(0), ty)
    parts = [_part(t, columns) for t in ty]
    return F.concat(F.lit("("), F.concat_ws(", ", *parts), F.lit(",)" if len(parts) == 1 else ")"))


def lines(df: DataFrame, relation: ir.Relation) -> DataFrame:
    """One line (column line) for each row of a relation's frame."""
    body = _part(relation.ty, [F.col(c) for c in df.columns])
    gap = "" if isinstance(relation.ty, tuple) else " "
    return df.select(F.concat(F.lit(relation.name + gap), body, F.lit(".")).alias("line"))
