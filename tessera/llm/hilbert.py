"""Sharding along a Hilbert curve: documents close in language, source and length get close ranks.

Each dimension is quantised to 2**BITS cells whose bounds are quantiles over all rows, strings by the number that the
six bytes after their common head make, so that order is kept and every shard file has narrow ranges in all dimensions
(strings that differ later only share a cell). Rows are sorted by the curve's index and then by id, and the order is cut into runs whose row counts differ by one at most. A cell of any size is
divided, since the id is part of the sort key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh

BITS = 6
SHARDS = 24


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of rows of `cells` (n rows, d dimensions), by Skilling's transform."""
    x = cells.astype(np.uint64).T.copy()
    d = len(x)
    m = np.uint64(1) << np.uint64(bits - 1)
    q = m
    while q > 1:
        p = q - np.uint64(1)
        for i in range(d):
            up = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(up, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = np.where(up, x[i], x[i] ^ t)
        q >>= np.uint64(1)
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = m
    while q > 1:
        t = np.where((x[d - 1] & q) != 0, t ^ (q - np.uint64(1)), t)
        q >>= np.uint64(1)
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return out.astype(np.int64)


def shared_head(df: DataFrame, cols: list[str]) -> dict[str, int]:
    """For each column the number of bytes with which all its values begin: what the least and the greatest have in common."""
    if not cols:
        return {}
    raw = lambda c: F.col(c).cast("string").cast("binary")
    r = df.agg(*(f(raw(c)).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("a", F.min), ("b", F.max)))).first()
    out = {}
    for i, c in enumerate(cols):
        a, b = bytes(r[f"a{i}"] or b""), bytes(r[f"b{i}"] or b"")
        out[c] = next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return out


def is_number(df: DataFrame, col: str) -> bool:
    return df.schema[col].dataType.typeName() in ("byte", "short", "integer", "long", "float", "double")


def as_number(df: DataFrame, col: str, head: int) -> F.Column:
    """A number in the order of the column: numbers as they are, the rest by six bytes of their text after the `head` that all share; null: -1."""
    if is_number(df, col):
        return F.coalesce(F.when(~F.isnan(F.col(col).cast("double")), F.col(col).cast("double")), F.lit(-1.0))
    part = F.rpad(F.hex(F.substring(F.col(col).cast("string").cast("binary"), head + 1, 6)), 12, "0")
    return F.coalesce(F.conv(part, 16, 10).cast("double"), F.lit(-1.0))


def hilbert_ranked(df: DataFrame, dims: list[str], id_col: str = "doc_id", bits: int = BITS) -> tuple[DataFrame, int]:
    """df with hilbert_index and row_rank (gapless from 0, by index, then id, then a hash of the other columns), and the row count."""
    spark = df.sparkSession
    heads = shared_head(df, [c for c in dims if not is_number(df, c)])
    names = fresh(df, *(f"d{i}" for i in range(len(dims))))
    spot, at, part_, start = fresh(df, "spot", "at", "part", "start")
    rest = [c for c in df.columns if c != id_col]
    df = cut(df.withColumns({n: as_number(df, c, heads.get(c, 0)) for n, c in zip(names, dims)}), "hilbert")
    share = [i / (1 << bits) for i in range(1, 1 << bits)]
    cuts = df.agg(*(F.percentile_approx(n, share, 10_000) for n in names)).first()
    bounds = [np.array(cuts[i] if cuts[i] is not None else [], dtype=np.float64) for i in range(len(dims))]

    @F.pandas_udf("long")
    def index(*columns: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([np.searchsorted(b, c.to_numpy(), side="right") for b, c in zip(bounds, columns)], axis=1), bits))

    keyed = df.withColumn("hilbert_index", index(*(F.col(n) for n in names))).withColumn(spot, F.xxhash64(*rest)).drop(*names)
    key = ["hilbert_index", id_col, spot]  # of bounded size, however long the rows' texts are
    # The written order is fixed: partition number and place in it are in the written id, so a rank is a sum.
    placed = cut(keyed.repartitionByRange(*key).sortWithinPartitions(*key).drop(spot).withColumn(at, F.monotonically_increasing_id()), "hilbert")
    part = F.shiftright(at, 33)
    sizes = sorted(placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each partition
    offset, total = {}, 0
    for r in sizes:
        offset[r.p] = total
        total += r.n
    starts = spark.createDataFrame(list(offset.items()) or [(0, 0)], f"{part_} long, {start} long")
    ranked = placed.withColumn(part_, part.cast("long")).join(F.broadcast(starts), part_).withColumn("row_rank", F.col(start) + F.col(at).bitwiseAND((1 << 33) - 1))
    return ranked.drop(part_, start, at), total


def hilbert_shards(df: DataFrame, dims: list[str], shards: int = SHARDS, id_col: str = "doc_id") -> DataFrame:
    """df with hilbert_index, shard and slot: the ranked rows cut into `shards` runs, whose row counts differ by one at most.

    Nulls sort before all values, repeated rows take adjacent slots, an empty table gives no rows, and with fewer rows
    than shards some shards stay empty. Equal texts of one language, source and length share an index, so a group of
    copies fills neighbouring slots and is cut wherever a shard is full. Columns named like the added ones are replaced.
    """
    ranked, n = hilbert_ranked(df.drop("hilbert_index", "row_rank", "shard", "slot"), dims, id_col)
    n = max(n, 1)
    return (
        ranked.withColumn("shard", F.expr(f"cast(row_rank * {shards} div {n} as int)"))
        .withColumn("slot", F.expr(f"row_rank - (shard * bigint({n}) + {shards - 1}) div {shards}"))
        .drop("row_rank")
    )


def write_shards(df: DataFrame, path: str, dims: list[str], shards: int = SHARDS, id_col: str = "doc_id") -> None:
    """Write df as one folder for each shard, its files runs of slots in order, by as many tasks as the bytes need.

    Nulls, repeated rows and columns as in hilbert_shards; an empty table leaves a folder without shards.
    """
    out = hilbert_shards(df, dims, shards, id_col)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_digest(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the curve's index for every document."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    small = docs.select("doc_id", "lang", "source", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    out = hilbert_shards(small, ["lang", "source", "size"], shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert_index")


def op8(spark: SparkSession, sf: str) -> DataFrame:
    return shard_digest(spark.read.parquet(f"{sf}/documents.parquet"))
