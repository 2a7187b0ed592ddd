"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
`documents`. Every stage works on all rows that the one before kept, and its result is written
as Parquet in the shared folder and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellreach.llm.common import fresh_path, removed
from cellreach.llm.decontaminate import drop_contaminated
from cellreach.llm.line_dedup import drop_repeated_lines
from cellreach.llm.ngram_join import keep_first_of_groups
from cellreach.llm.packing import pack_documents
from cellreach.llm.quality_rules import apply_quality_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their boilerplate lines."""
    return apply_quality_rules(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that repeat an earlier line; documents that lose every word go."""
    return drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates."""
    return keep_first_of_groups(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document, with its sequence and its place there."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("best_fit_packing", packed),
]

#: Tokenizer ids are beyond SQL; tests hold the whole run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        path = fresh_path(spark, name)
        kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
        if before:
            removed(spark, before)  # nothing reads it any more
        before = path
    out = STAGES[-1][1](spark, docs, sf_dir)  # its pieces are a table of its own by now
    removed(spark, before)
    return out
