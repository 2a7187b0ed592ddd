"""Incremental arrival of points of interest (beyond the batch pipeline): each micro-batch renews the legs it touches.

A leg is the time to the nearest of an entity's sites, so a new site can only lessen it: the legs on disk are the state, the search starts
from the new sites alone, and both are merged by their least.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellreach.operators.graph import kbest_by_part, reverse_edges
from cellreach.plans.cuts import cut
from cellreach.sources.sinks import write_legs


def stream_pois(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def renew_legs(edges: DataFrame, sites: DataFrame, cutoff: int, parts: int = 32) -> DataFrame:
    """(anchor, entity, seconds) of every entity in sites (node, entity), all searched at once: the time from each node to its nearest site."""
    sources = sites.select("node", F.col("entity").alias("src"), F.lit(cutoff).cast("long").alias("limit"))
    times = kbest_by_part(reverse_edges(edges), sources, None, parts=parts)
    return times.select(F.col("node").alias("anchor"), F.col("src").alias("entity"), F.col("d").cast("int").alias("seconds"))


def _there(spark: SparkSession, base: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)


def on_arrival(edges: DataFrame, base: str, cutoff: int, parts: int = 32, mode: int = 0):
    """A foreachBatch function that merges the legs to a batch of new sites (node, entity) into those at base; a batch may come twice."""

    def batch(new: DataFrame, _: int) -> None:
        sites = new.select("node", "entity").where("node is not null and entity is not null").distinct()
        spark = new.sparkSession
        if not sites.head(1):
            return
        legs = renew_legs(edges, sites, cutoff, parts)
        if _there(spark, base):
            schema = "anchor long, seconds int, mode int, entity string"
            old = spark.read.schema(schema).parquet(base).where(F.col("mode") == mode)
            old = old.join(sites.select("entity").distinct(), "entity", "left_semi")
            legs = legs.unionByName(old.select("anchor", "entity", "seconds")).groupBy("anchor", "entity").agg(F.min("seconds").alias("seconds"))
        # Written elsewhere first: the partitions that are read are replaced.
        write_legs(cut(legs.withColumn("mode", F.lit(mode))), base)

    return batch
