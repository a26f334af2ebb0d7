"""The five column types, their SQL spellings, literals and the coercion between them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class ColumnType:
    name: str
    spark: T.DataType

    @property
    def numeric(self) -> bool:
        return self.name != "STRING"

    @property
    def integral(self) -> bool:
        return self.name in ("I32", "I64")


I32 = ColumnType("I32", T.IntegerType())
I64 = ColumnType("I64", T.LongType())
F32 = ColumnType("F32", T.FloatType())
F64 = ColumnType("F64", T.DoubleType())
STRING = ColumnType("STRING", T.StringType())
TYPES = (I32, I64, F32, F64, STRING)

# The spellings that SQL accepts for each type.
SPELLINGS = {
    "I32": I32, "INT": I32, "INTEGER": I32,
    "I64": I64, "BIGINT": I64,
    "F32": F32, "FLOAT": F32,
    "F64": F64, "DOUBLE": F64,
    "STRING": STRING, "TEXT": STRING, "VARCHAR": STRING,
}

# The encodings that a column may declare.
ENCODINGS = ("PLAIN", "DICT", "BIT_PACKED", "DELTA", "RLE")


def spelled(word: str) -> ColumnType | None:
    return SPELLINGS.get(word.upper())


def of_spark(kind: T.DataType) -> ColumnType | None:
    """The column type of a Spark type; None for types that only pass through."""
    return next((t for t in TYPES if t.spark == kind), None)


def field(name: str, kind: ColumnType, nullable: bool = True, encoding: str = "PLAIN") -> T.StructField:
    return T.StructField(name, kind.spark, nullable, {"encoding": encoding})


def coerce(col: Column, source: T.DataType, target: T.DataType) -> Column:
    """col in the target type, null where it has no such value.

    Strings become numbers through a double, so '12.7' is 12 as an integer, unless they are plain integers, which keep
    all digits; fractions are cut towards zero. Integers become their digits, floats six decimals.
    """
    if source == target:
        return col
    if isinstance(target, T.StringType):
        return F.format_string("%.6f", col.cast("double")) if isinstance(source, (T.FloatType, T.DoubleType)) else col.cast("string")
    if isinstance(source, T.StringType) and isinstance(target, (T.IntegerType, T.LongType)):
        whole = F.trim(col).try_cast(target.simpleString())
        return F.coalesce(whole, F.trim(col).try_cast("double").try_cast(target.simpleString()))
    if isinstance(source, T.StringType):
        return F.trim(col).try_cast(target.simpleString())
    return col.try_cast(target.simpleString())


def literal_type(value: object) -> T.DataType:
    """The Spark type of a Python literal; text that is quoted in SQL is always a string."""
    if isinstance(value, bool) or value is None:
        raise TypeError(f"not a literal of the five types: {value!r}")
    if isinstance(value, int):
        return T.IntegerType() if -(2**31) <= value < 2**31 else T.LongType()
    if isinstance(value, float):
        return T.DoubleType()
    if isinstance(value, str):
        return T.StringType()
    raise TypeError(f"not a literal of the five types: {value!r}")


def literal(value: object, target: T.DataType) -> Column:
    """A literal in the target type; null stays null."""
    if value is None:
        return F.lit(None).cast(target)
    return coerce(F.lit(value).cast(literal_type(value)), literal_type(value), target)
