"""Sinks: partitioned legs, per-resolution tables, GeoJSON lines, metadata, incremental writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellreach.operators.tables import conform
from cellreach.plans.catalog import geojson_lines


def write_legs(legs: DataFrame, base: str) -> None:
    """Hive layout by mode and entity; only the partitions in legs are replaced, each atomically by the commit protocol."""
    out = legs.repartition("mode", "entity").sortWithinPartitions("anchor").write.partitionBy("mode", "entity")
    out.option("compression", "zstd").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(base)


def partition_folder(spark: SparkSession, base: str, mode: int, entity: str | None) -> str:
    """The folder that Spark's own writer gives a partition, with its escaping."""
    names = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    return "/".join([base.rstrip("/"), names.getPartitionPathString("mode", str(mode)), names.getPartitionPathString("entity", entity)])


def write_shard(legs: DataFrame, base: str, mode: int, entity: str) -> None:
    """The legs of one partition in its folder; a file with the schema even if there are none."""
    own = legs.where((F.col("mode") == mode) & (F.col("entity") == entity)).drop("mode", "entity")
    folder = partition_folder(own.sparkSession, base, mode, entity)
    own.write.mode("overwrite").option("compression", "zstd").parquet(folder)
    if not own.sparkSession.read.schema(own.schema).parquet(folder).inputFiles():
        own.sparkSession.createDataFrame([], own.schema).coalesce(1).write.mode("overwrite").option("compression", "zstd").parquet(folder)


def prune(spark: SparkSession, base: str, targets: DataFrame) -> list[tuple[int, str]]:
    """Delete the (mode, entity) partitions on disk that are no targets (mode, entity); those deleted, sorted.

    Raises where a folder that should go is still there afterwards.
    """
    stale = sorted(((r["mode"], r["entity"]) for r in stale_partitions(spark, base, targets).collect()), key=str)  # one row a folder
    session = spark._jsparkSession.sessionState().newHadoopConf()
    for mode, entity in stale:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(partition_folder(spark, base, mode, entity))
        store = path.getFileSystem(session)
        if not store.delete(path, True) or store.exists(path):
            raise OSError(f"cannot delete {path}")
    return stale


CANONICAL_POI = (
    "poi_id string, name string, brand_id string, brand_name string, class string, category string, subcat string, trauma_level string,"
    " lon float, lat float, geometry binary, source string, ext_id string, h3_r9 string, provenance array<string>"
)


def write_pois(pois: DataFrame, path: str) -> None:
    """Places with exactly the columns of CANONICAL_POI; missing ones are null, others dropped."""
    from pyspark.sql import types as T

    conform(pois, T.StructType.fromDDL(CANONICAL_POI)).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_with_qa(df: DataFrame, path: str, qa_path: str, columns: list[str], rows_per_file: int = 1_000_000) -> None:
    """df as Parquet, and some of its columns as CSV with a header for people to look at."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)
    df.sparkSession.read.parquet(path).select(*columns).write.mode("overwrite").option("header", True).csv(qa_path)


def write_by_resolution(cells: DataFrame, base: str, resolutions: list[int]) -> None:
    for res in resolutions:
        cells.where(F.col("res") == res).drop("res").write.mode("overwrite").option("compression", "zstd").parquet(f"{base}/r{res}")


def write_geojson(cells: DataFrame, path: str) -> None:
    geojson_lines(cells).write.mode("overwrite").text(path)


def with_scales(df: DataFrame, scales: dict[str, float]) -> DataFrame:
    """df with the scale of quantised columns in their metadata, which Parquet keeps."""
    return df.select(*[F.col(c).alias(c, metadata={"scale": scales[c]}) if c in scales else F.col(c) for c in df.columns])


def pending(targets: DataFrame, manifest: DataFrame) -> DataFrame:
    """targets (entity, fingerprint) that the manifest of finished ones lacks."""
    return targets.join(manifest, ["entity", "fingerprint"], "left_anti")


def upsert_latest(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key of both tables."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc(), F.col("_new").desc()))
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.withColumn("_rank", rank).where("_rank = 1").drop("_rank", "_new").orderBy(key)


def stale_partitions(spark: SparkSession, base: str, targets: DataFrame) -> DataFrame:
    """(mode, entity) partitions on disk that are no targets."""
    there = spark.read.schema("mode int, entity string").parquet(base).distinct()
    return there.join(targets.select(F.col("mode").cast("int"), "entity"), ["mode", "entity"], "left_anti")
