"""Scalar and aggregate functions. Case mapping is ASCII only and length counts bytes, so both stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BadArgs

LOWER_CASE = "abcdefghijklmnopqrstuvwxyz"
UPPER_CASE = LOWER_CASE.upper()
SCALARS = ("UPPER", "LOWER", "LENGTH")
AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")


def scalar(name: str, col: Column, kind: T.DataType) -> Column:
    """UPPER, LOWER and LENGTH of a string column; columns of other types stay as they are."""
    if not isinstance(kind, T.StringType):
        return col
    match name:
        case "UPPER":
            return F.translate(col, LOWER_CASE, UPPER_CASE)
        case "LOWER":
            return F.translate(col, UPPER_CASE, LOWER_CASE)
        case "LENGTH":
            return F.octet_length(col).cast("bigint")
    raise BadArgs(f"unknown function: {name}")


def aggregate(name: str, col: Column | None, distinct: bool = False) -> Column:
    """COUNT, SUM, AVG, MIN and MAX; col None is COUNT(*). Nulls are left out; groups of nulls only give null."""
    if name == "COUNT":
        return F.count(F.lit(1)) if col is None else F.count_distinct(col) if distinct else F.count(col)
    if col is None:
        raise BadArgs(f"{name}(*)")
    match name:
        case "SUM":
            return F.sum_distinct(col) if distinct else F.sum(col)
        case "AVG":
            return F.call_function("avg", col) if not distinct else F.sum_distinct(col.cast("double")) / F.count_distinct(col)
        case "MIN":
            return F.min(col)
        case "MAX":
            return F.max(col)
    raise BadArgs(f"unknown aggregate: {name}")
