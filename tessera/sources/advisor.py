"""Encoding advice: what each encoding of a column would take, from one distributed pass in a given row order.

The order matters for DELTA and RLE. Rows are range-partitioned and sorted by the order column; each partition gives one
row with its first and last value, runs and steps, and these few rows are joined end to end. So no task sees all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BadSchema


@dataclass(frozen=True)
class Profile:
    """n non-null values of `width` bytes; steps: the least and greatest difference of neighbours."""

    n: int
    width: int
    least: int
    most: int
    runs: int
    least_step: int
    most_step: int

    @property
    def bits(self) -> int:
        return (self.most - self.least).bit_length()

    @property
    def delta_bits(self) -> int:
        """Bits of the greatest step of a monotonic column, else 0."""
        if self.n < 2 or (self.least_step < 0 < self.most_step):
            return 0
        return max(abs(self.least_step), abs(self.most_step)).bit_length()

    @property
    def sizes(self) -> dict[str, int | None]:
        """Bytes by encoding; None where it does not apply."""
        n, w = self.n, self.width
        return {
            "PLAIN": n * w,
            "BIT_PACKED": w + 1 + -(-n * self.bits // 8),
            "DELTA": 2 + w + -(-n * self.delta_bits // 8) if self.delta_bits else None,
            "RLE": 4 + self.runs * (w + 4) if self.runs < n else None,
        }

    def choice(self, requested: str = "PLAIN") -> str:
        """The smallest of the requested encoding, DELTA and RLE; of equal sizes the earlier. Other requests stay PLAIN."""
        if requested not in ("PLAIN", "BIT_PACKED"):
            return "PLAIN"
        best = requested
        for e in ("DELTA", "RLE"):
            if self.sizes[e] is not None and self.sizes[e] < self.sizes[best]:
                best = e
        return best


def profile(df: DataFrame, column: str, order: str) -> Profile:
    """The profile of an integer column in the order of a unique column; nulls are left out."""
    kind = df.schema[column].dataType
    if not isinstance(kind, (T.IntegerType, T.LongType)):
        raise BadSchema(f"{column}: not an integer column")
    width = 4 if isinstance(kind, T.IntegerType) else 8

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, runs, last = 0, 0, None
        out: dict[str, int] = {}
        for b in batches:
            x = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(x):
                continue
            steps = np.diff(x if last is None else np.concatenate(([last], x)))
            if last is None:
                out = {"at": b.column(0)[0].as_py(), "first": int(x[0]), "least": int(x[0]), "most": int(x[0]), "least_step": 0, "most_step": 0}
                runs = 1
            n, last = n + len(x), int(x[-1])
            runs += int((steps != 0).sum())
            out["least"], out["most"] = min(out["least"], int(x.min())), max(out["most"], int(x.max()))
            if len(steps):
                out["least_step"], out["most_step"] = min(out["least_step"], int(steps.min())), max(out["most_step"], int(steps.max()))
        if n:
            row = out | {"n": n, "last": last, "runs": runs}
            yield pa.RecordBatch.from_pylist([{k: row[k] for k in names}], pa.schema([(k, pa.int64()) for k in names]))

    names = ["at", "first", "last", "n", "runs", "least", "most", "least_step", "most_step"]
    rows = df.where(F.col(column).isNotNull()).select(F.col(order).cast("long").alias("o"), F.col(column).cast("long").alias("v"))
    parts = sorted(rows.repartitionByRange("o").sortWithinPartitions("o").mapInArrow(of, ", ".join(f"{k} long" for k in names)).collect(), key=lambda r: r["at"])  # a row for each partition
    if not parts:
        return Profile(0, width, 0, 0, 0, 0, 0)
    seams = [b["first"] - a["last"] for a, b in zip(parts, parts[1:])]
    return Profile(
        sum(p["n"] for p in parts), width, min(p["least"] for p in parts), max(p["most"] for p in parts), sum(p["runs"] for p in parts) - seams.count(0),
        min([p["least_step"] for p in parts] + seams), max([p["most_step"] for p in parts] + seams),
    )


def profile_rows(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """A row for each column: its profile, the size of each encoding and the choice."""
    made = []
    for c in columns:
        p = profile(df, c, order)
        made.append((c, *asdict(p).values(), p.bits, p.delta_bits, *p.sizes.values(), p.choice()))
    schema = "column string, n long, width int, least long, most long, runs long, least_step long, most_step long, bits int, delta_bits int, plain long, bit_packed long, delta long, rle long, choice string"
    return df.sparkSession.createDataFrame(made, schema)


def checkpoint_choice(df: DataFrame) -> DataFrame:
    """column, encoding: DICT for strings with 2 to n/4 distinct values, BIT_PACKED for integers of 1 to 24 range bits, else PLAIN."""
    strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    ints = [f.name for f in df.schema if isinstance(f.dataType, (T.IntegerType, T.LongType))]
    q = lambda n: F.col(f"`{n}`")
    row = df.agg(
        F.count(F.lit(1)).alias("n"), *(F.count_distinct(q(c)).alias(f"d{i}") for i, c in enumerate(strings)),
        *(x.alias(f"{k}{i}") for i, c in enumerate(ints) for k, x in (("l", F.min(q(c))), ("m", F.max(q(c))))),
    ).first()
    choice = {f.name: "PLAIN" for f in df.schema}
    for i, c in enumerate(strings):
        if 1 < row[f"d{i}"] <= row["n"] / 4:
            choice[c] = "DICT"
    for i, c in enumerate(ints):
        if row[f"l{i}"] is not None and 1 <= (row[f"m{i}"] - row[f"l{i}"]).bit_length() <= 24:
            choice[c] = "BIT_PACKED"
    return df.sparkSession.createDataFrame(list(choice.items()), "column string, encoding string")
