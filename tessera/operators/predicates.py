"""Predicates on one column against literals, with the null rules of the engine.

`!=` also holds for nulls; every other comparison, LIKE, IN and their negations are false for nulls. A string column
never equals a number, nor a number column a string. Conditions are trees of And and Or over Pred and compile to one
Column, so Catalyst pushes what it can into the scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BadArgs, BadSchema
from ..types import coerce, literal_type


class Op(Enum):
    EQ = "="
    NE = "!="
    LT = "<"
    GT = ">"
    LE = "<="
    GE = ">="
    LIKE = "LIKE"
    NOT_LIKE = "NOT LIKE"
    IN = "IN"
    NOT_IN = "NOT IN"
    BETWEEN = "BETWEEN"
    IS_NULL = "IS NULL"
    IS_NOT_NULL = "IS NOT NULL"


@dataclass(frozen=True)
class Pred:
    """column op value; column is a name or, in HAVING, an aggregate; value is a literal, a tuple of literals for IN and BETWEEN, nothing for the null tests."""

    column: object
    op: Op
    value: object = None


@dataclass(frozen=True)
class And:
    parts: tuple

    @staticmethod
    def of(*parts: Cond) -> Cond:
        return parts[0] if len(parts) == 1 else And(parts)


@dataclass(frozen=True)
class Or:
    parts: tuple

    @staticmethod
    def of(*parts: Cond) -> Cond:
        return parts[0] if len(parts) == 1 else Or(parts)


Cond = Pred | And | Or
_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _operand(value: object, kind: T.DataType) -> Column | None:
    """The literal to compare a column of this type with; None if they never match."""
    if isinstance(kind, _NUMBERS):
        if isinstance(value, str):
            return None
        if isinstance(kind, T.FloatType) and isinstance(value, (int, float)):
            return F.lit(float(value))
        return F.lit(value)
    if isinstance(kind, T.StringType):
        return F.lit(value) if isinstance(value, str) else None
    return F.lit(value).cast(kind)


def _compare(col: Column, kind: T.DataType, op: Op, value: object) -> Column:
    if value is None:
        raise BadArgs(f"{op.value} NULL: use IS NULL or IS NOT NULL")
    x = _operand(value, kind)
    if x is None:
        return F.lit(True) if op is Op.NE else F.lit(False)
    match op:
        case Op.EQ:
            return col == x
        case Op.NE:
            return (col != x) | col.isNull()
        case Op.LT:
            return col < x
        case Op.GT:
            return col > x
        case Op.LE:
            return col <= x
        case Op.GE:
            return col >= x
    raise BadArgs(f"not a comparison: {op}")


def predicate(p: Pred, col: Column, kind: T.DataType) -> Column:
    """The condition of one predicate on a column of this type."""
    match p.op:
        case Op.IS_NULL:
            return col.isNull()
        case Op.IS_NOT_NULL:
            return col.isNotNull()
        case Op.LIKE | Op.NOT_LIKE:
            if not isinstance(kind, T.StringType) or not isinstance(p.value, str):
                return F.lit(False)
            like = col.like(p.value.replace("\\", "\\\\"))
            return like if p.op is Op.LIKE else ~like
        case Op.IN | Op.NOT_IN:
            known = [x for v in p.value if v is not None and (x := _operand(v, kind)) is not None]
            if p.op is Op.IN:
                return col.isin(*known) if known else F.lit(False)
            return col.isNotNull() & ~col.isin(*known) if known else col.isNotNull()
        case Op.BETWEEN:
            low, high = p.value
            return _compare(col, kind, Op.GE, low) & _compare(col, kind, Op.LE, high)
    return _compare(col, kind, p.op, p.value)


def condition(cond: Cond, resolve) -> Column:
    """The Column of a condition tree; resolve: name -> (Column, type)."""
    if isinstance(cond, Pred):
        return predicate(cond, *resolve(cond.column))
    parts = [condition(c, resolve) for c in cond.parts]
    return reduce(lambda a, b: a & b, parts) if isinstance(cond, And) else reduce(lambda a, b: a | b, parts)


def resolver(schema: T.StructType):
    """Name -> (Column, type) over a schema: exact, case-sensitive names; unknown names are errors."""
    kinds = {f.name: f.dataType for f in schema}

    def resolve(name: str) -> tuple[Column, T.DataType]:
        if name not in kinds:
            raise BadSchema(f"unknown column: {name}")
        return F.col(f"`{name.replace('`', '``')}`"), kinds[name]

    return resolve


def stored(value: object, field: T.StructField) -> Column:
    """A literal as it is stored in a column."""
    if value is None:
        if not field.nullable:
            raise BadSchema(f"column {field.name} is NOT NULL")
        return F.lit(None).cast(field.dataType)
    return coerce(F.lit(value).cast(literal_type(value)), literal_type(value), field.dataType)
