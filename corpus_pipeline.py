"""Documents to packed training sequences: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and is written before the next one reads it; all but
the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import decontaminate, line_dedup, near_dup, packing, quality_rules
from granary.llm.common import shared_dir, table
from granary.llm.queries import tokenizer_path

#: Percent of shared five-word shingles from which two documents count as near copies here; op9's query has its own, 85.
SIMILAR = 80


def _same_columns(before: DataFrame, after: DataFrame) -> DataFrame:
    """Texts may have changed: n_chars follows them."""
    columns = [F.length("text").cast(before.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(c) for c in before.columns]
    return after.select(*columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs, quality_rules.learn(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which nothing is left go."""
    left = line_dedup.dedup(docs).where(F.col("deleted_lines").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return _same_columns(docs, left)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_first(docs, SIMILAR)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _same_columns(docs, decontaminate.clean(docs, table(spark, sf_dir, "benchmark")))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("packing", sequences),
]
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage's folder goes once the next stage is written; the last one stays, as the result is read from it."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark).rstrip('/')}/corpus-pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        folder = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            _remove(spark, before)
        before = folder
    return docs
