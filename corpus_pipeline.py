"""The corpus pipeline: quality, line dedup, near-duplicates, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and reads again as the
next stage's docs. All but the last return the columns of documents and drop all others, whatever their names. Every
stage takes null ids and texts, empty and long texts, repeated rows and empty tables, as its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, linededup, nbsvm, pieces, simhash
from tessera.llm.common import cut, id_hash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Null and empty texts are judged as texts without features; repeated
    rows stay or go together; without labels every score is a half, so all stay; an empty table gives none."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(id_hash(F.col("doc_id")) % 5 != 0)
    return nbsvm.score(docs, nbsvm.train(docs, labels)).where("predicted = 1").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without surplus lines; n_chars follows the text. No row goes: null texts stay null with a null n_chars,
    a text all of whose lines stand earlier becomes empty; repeated rows keep the same lines; an empty table gives none."""
    return linededup.dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id. Rows with null ids stay; rows that repeat an id
    stay or go together; null, empty and wordless texts are copies of each other; an empty table gives none."""
    return simhash.keep_one(docs).select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts stay; rows that repeat an id stay or go together; with an
    empty benchmark all stay; an empty table gives none."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of the text, their number and whether they decode to it, for every row. Null and empty texts have no
    ids; an empty table gives no rows."""
    return pieces.encoded_digest(docs)


STAGES = [("quality", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("decontamination", benchmark), ("encoding", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
