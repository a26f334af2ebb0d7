"""Write, read, query, peek and verify Parquet files.

A column's declared encoding becomes writer options; sorting or clustering on write makes min/max pruning work. Files
are written with the version 1 writer unless a DELTA column asks for version 2, which needs a compression codec: without
one Spark's vectorised reader misreads version 2 strings.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BadArgs, Corrupt, NotFound
from ..operators import And, Op, Pred
from ..plans.spec import Col, QuerySpec, Star, compile_spec
from .ecc import protect_files
from .files import Files

CODECS = ("none", "snappy", "zstd", "lz4", "lz4_raw", "gzip")
MANIFEST = "_manifest.json"


def writer_options(df: DataFrame, codec: str) -> dict[str, str]:
    """Writer options for the columns' declared encodings."""
    if codec not in CODECS:
        raise BadArgs(f"unknown codec: {codec}")
    options = {"compression": codec}
    if codec == "zstd":
        options["parquet.compression.codec.zstd.level"] = "1"
    declared = {f.name: (f.metadata or {}).get("encoding") for f in df.schema}
    if "DELTA" in declared.values():
        if codec == "none":
            raise BadArgs("DELTA columns need a compression codec")
        options["parquet.writer.version"] = "v2"
    return options | {f"parquet.enable.dictionary#{n}": "false" for n, e in declared.items() if e in ("PLAIN", "DELTA")}


def write(df: DataFrame, path: str, codec: str = "zstd", sort_by: Sequence[str] = (), partitions: int | None = None, mode: str = "errorifexists", row_group_bytes: int | None = None, manifest: bool = False, rs: bool = False) -> None:
    """Write df, with parity bytes for repair_files() if `rs`; sort_by range-partitions and sorts it, so that filters on these columns skip files and row groups."""
    options = writer_options(df, codec) | ({"parquet.block.size": str(row_group_bytes)} if row_group_bytes else {})
    if sort_by:
        dealt = df.repartitionByRange(partitions, *sort_by) if partitions else df.repartitionByRange(*sort_by)
        df = dealt.sortWithinPartitions(*sort_by)
    elif partitions:
        df = df.repartition(partitions)
    df.write.mode(mode).options(**options).parquet(path)
    if rs:
        protect_files(df.sparkSession, path)
    if manifest:
        spark = df.sparkSession
        files = Files(spark, path)
        files.delete(MANIFEST)
        files.create(MANIFEST, json.dumps(fingerprint(spark.read.parquet(path))))


def fingerprint(df: DataFrame) -> dict[str, int]:
    """Row count and an order-free hash of all values."""
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.xxhash64(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).cast("decimal(38,0)")), F.lit(0)).alias("hash")).first()
    return {"rows": row["rows"], "hash": int(row["hash"])}


def read(spark: SparkSession, path: str, check: bool = False) -> DataFrame:
    """The files of a path; check makes the reader verify page checksums."""
    if not Files(spark, path).exists():
        raise NotFound(path)
    return spark.read.option("parquet.page.verify-checksum.enabled", str(check).lower()).parquet(path)


def read_partition(df: DataFrame, number: int) -> DataFrame:
    """The rows of one input partition."""
    return df.where(F.spark_partition_id() == number)


def read_chunk(spark: SparkSession, path: str, number: int) -> DataFrame:
    """The rows of one file of a path, in the order of file names; no other file is read."""
    files = sorted(read(spark, path).inputFiles())
    if not 0 <= number < len(files):
        raise BadArgs(f"chunk {number} of {len(files)}")
    return spark.read.parquet(files[number])


def query(spark: SparkSession, path: str, predicates: Sequence[tuple | Pred] = (), columns: Sequence[str] | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows for which all predicates (column, op, value) hold; limit None is unlimited, an offset past the end is empty."""
    preds = [p if isinstance(p, Pred) else Pred(p[0], Op(p[1]) if isinstance(p[1], str) else p[1], *p[2:]) for p in predicates]
    items = tuple(Col(c) for c in columns) if columns is not None else (Star(),)
    return compile_spec(read(spark, path), QuerySpec(items, where=And.of(*preds) if preds else None, limit=limit, offset=offset))


def peek(spark: SparkSession, path: str) -> dict:
    """Column names and types, and the row count from the files' footers."""
    df = read(spark, path)
    return {"columns": [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema], "rows": df.count()}


def verify(spark: SparkSession, path: str) -> dict[str, int]:
    """Read everything with page checksums on and compare it with the manifest, if there is one; Corrupt if it differs."""
    files = Files(spark, path)
    try:
        found = fingerprint(read(spark, path, check=True))
    except (PySparkException, Py4JJavaError) as e:
        raise Corrupt(f"{path}: {str(e).splitlines()[0]}") from e
    if files.exists(MANIFEST) and (want := json.loads(files.read(MANIFEST))) != found:
        raise Corrupt(f"{path}: manifest {want}, found {found}")
    return found
