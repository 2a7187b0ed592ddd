"""The thin opN queries over the driver's tables, and the SQL that each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellreach.llm import oracles
from cellreach.llm.alignment import align
from cellreach.llm.compact_windows import near_passages
from cellreach.llm.decontaminate import decontaminate, digest
from cellreach.llm.line_dedup import line_dedup
from cellreach.llm.ngram_join import ngram_jaccard_groups
from cellreach.llm.packing import pack_documents
from cellreach.llm.quality_rules import quality_rules
from cellreach.llm.sharding import shard_by_bytes
from cellreach.llm.suffix_dedup import remove_repeats
from cellreach.llm.url_filter import judge_urls
from cellreach.llm.warc import archive_round_trip
from cellreach.llm.whitening import whiten
from cellreach.llm.winnowing import compare_with_next


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages")).select(
        F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict", "pattern"
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(spark, _table(spark, sf_dir, "pages")).drop("url")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(_table(spark, sf_dir, "documents"), 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_groups(_table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_passages(_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(_table(spark, sf_dir, "documents"))


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_warc": op2_warc,
    "op3_sharding": op3_sharding,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_document_fingerprints": op12_document_fingerprints,
    "op13_cross_tokenizer_alignment": op13_cross_tokenizer_alignment,
}

ORACLES = {
    "op1_url_filters": oracles.OP1,
    "op2_warc": oracles.OP2,
    "op4_suffix_array_dedup": oracles.OP4,
    "op5_line_dedup": oracles.OP5,
    "op6_ngram_jaccard_join": oracles.OP6,
    "op9_quality_rules": oracles.OP9,
    "op10_benchmark_decontamination": oracles.OP10,
}
