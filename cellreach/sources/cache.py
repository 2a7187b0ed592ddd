"""Prepared edge tables beside the sources that they were made from, built again when these change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def changed_sources(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """(path) of the sources (path, size, stamp) that are new, gone, or of another size or stamp than in the manifest."""
    old = manifest.select("path", F.struct("size", "stamp").alias("was"))
    both = old.join(current.select("path", F.struct("size", "stamp").alias("now")), "path", "full")
    return both.where(~F.col("was").eqNullSafe(F.col("now"))).select("path")


def load_or_build(spark: SparkSession, folder: str, current: DataFrame, build: Callable[[], DataFrame]) -> DataFrame:
    """The table in folder if its manifest agrees with the current sources (path, size, stamp), else the one that build() gives, which is kept.

    The manifest is written last, so that a table left half written is built again.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
    exists = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)
    if not exists or changed_sources(spark.read.parquet(f"{folder}/manifest"), current).head(1):
        if exists:
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
        build().write.mode("overwrite").parquet(f"{folder}/table")
        current.select("path", "size", "stamp").write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/table")
