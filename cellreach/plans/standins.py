"""Stand-ins for geodata on the star-schema tables: the same rows as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


EDGES = """
e0 AS (SELECT lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS u,
              l_partkey AS v, CAST(l_quantity AS BIGINT) + 60 AS w FROM lineitem),
edges AS (SELECT u, v, min(w) AS w FROM e0 WHERE u IS NOT NULL AND u <> v GROUP BY u, v)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    steps = table(spark, sf_dir, "lineitem").select(
        F.lag("l_partkey").over(order).alias("u"), F.col("l_partkey").alias("v"), (F.col("l_quantity").cast("long") + 60).alias("w")
    )
    return steps.where("u is not null and u <> v").groupBy("u", "v").agg(F.min("w").alias("w"))


ANCHORS = "anchors AS (SELECT p_partkey AS node FROM part WHERE p_size = 50)"


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_size = 50").select(F.col("p_partkey").alias("node"))


TIMES = "times AS (SELECT l_partkey AS cell, l_suppkey AS anchor, CAST(l_quantity AS BIGINT) * 60 AS t FROM lineitem)"


def times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("cell"), F.col("l_suppkey").alias("anchor"), (F.col("l_quantity").cast("long") * 60).alias("t")
    )


RANKED = f"""{TIMES},
least1 AS (SELECT cell, anchor, min(t) AS t FROM times GROUP BY cell, anchor),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY t, anchor) - 1 AS rank FROM least1) WHERE rank < 20)"""

LEGS = """
legs0 AS (SELECT l_suppkey AS anchor, p_brand AS entity, 60 * l_linenumber + CAST(round(l_tax * 100) AS BIGINT) * 15 AS seconds
          FROM lineitem JOIN part ON l_partkey = p_partkey),
legs AS (SELECT anchor, entity, min(seconds) AS seconds FROM legs0 GROUP BY anchor, entity)"""


def legs0(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    seconds = (60 * F.col("l_linenumber").cast("long") + F.round(F.col("l_tax") * 100).cast("long") * 15).alias("seconds")
    return table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("anchor"), F.col("p_brand").alias("entity"), seconds
    )


CELLS = """
cells AS (SELECT p_partkey AS cell, p_type AS climate_label, p_size > 40 AS near_power_corridor, p_size % 5 AS political_lean,
                 p_retailprice < 1500 AS is_core FROM part)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("cell"),
        F.col("p_type").alias("climate_label"),
        (F.col("p_size") > 40).alias("near_power_corridor"),
        (F.col("p_size") % 5).alias("political_lean"),
        (F.col("p_retailprice") < 1500).alias("is_core"),
    )


POINTS = """
points AS (SELECT c_custkey AS id, -73.5 + (c_custkey * 7919 % 3580) / 1000.0::DOUBLE AS lon,
                  41.2 + (c_custkey * 104729 % 1700) / 1000.0::DOUBLE AS lat FROM customer)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("id"), (F.lit(-73.5) + (key * 7919 % 3580) / 1000.0).alias("lon"), (F.lit(41.2) + (key * 104729 % 1700) / 1000.0).alias("lat")
    )


PLACES = """
places AS (SELECT s_suppkey AS place, -73.5 + (s_suppkey * 6271 % 3580) / 1000.0::DOUBLE AS p_lon,
                  41.2 + (s_suppkey * 3571 % 1700) / 1000.0::DOUBLE AS p_lat,
                  CASE s_nationkey % 3 WHEN 0 THEN 'ocean' WHEN 1 THEN 'lake' ELSE 'river' END AS kind FROM supplier)"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, kind = F.col("s_suppkey"), F.col("s_nationkey") % 3
    return table(spark, sf_dir, "supplier").select(
        key.alias("place"),
        (F.lit(-73.5) + (key * 6271 % 3580) / 1000.0).alias("p_lon"),
        (F.lit(41.2) + (key * 3571 % 1700) / 1000.0).alias("p_lat"),
        F.when(kind == 0, "ocean").when(kind == 1, "lake").otherwise("river").alias("kind"),
    )


DIST = """sqrt(pow((p_lon - lon) * 111000.0 * cos(radians((lat + p_lat) / 2)), 2) + pow((p_lat - lat) * 111000.0, 2))"""

#: Two feeds of the same parts, the second with other spellings and fewer brands.
POIS = """
pois AS (SELECT 'a' || p_partkey AS poi_id, p_name AS name, p_type AS category, lower(p_brand) AS brand_id, 'overture' AS source,
                CAST(p_partkey AS VARCHAR) AS ext_id, -73.5 + (p_partkey % 50) / 1000.0::DOUBLE AS lon, 41.2 + (p_partkey % 40) / 1000.0::DOUBLE AS lat FROM part
         UNION ALL
         SELECT 'b' || p_partkey, ' ' || upper(p_name), lower(p_type), CASE WHEN p_size < 25 THEN lower(p_brand) END, 'osm',
                CAST(p_partkey AS VARCHAR), -73.5 + (p_partkey % 50) / 1000.0::DOUBLE, 41.2 + (p_partkey % 40) / 1000.0::DOUBLE FROM part)"""


def pois(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    place = [(F.lit(-73.5) + (key % 50) / 1000.0).alias("lon"), (F.lit(41.2) + (key % 40) / 1000.0).alias("lat")]
    one = part.select(
        F.concat(F.lit("a"), key).alias("poi_id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"),
        F.lower("p_brand").alias("brand_id"), F.lit("overture").alias("source"), key.cast("string").alias("ext_id"), *place,
    )
    two = part.select(
        F.concat(F.lit("b"), key).alias("poi_id"), F.concat(F.lit(" "), F.upper("p_name")).alias("name"), F.lower("p_type").alias("category"),
        F.when(F.col("p_size") < 25, F.lower("p_brand")).alias("brand_id"), F.lit("osm").alias("source"), key.cast("string").alias("ext_id"), *place,
    )
    return one.unionByName(two)


#: Speed, voltage and tag texts by order key.
SPEED = """CASE o_orderkey % 7 WHEN 0 THEN '50' WHEN 1 THEN '50 km/h' WHEN 2 THEN '35 mph' WHEN 3 THEN '30;45' WHEN 4 THEN '20; 30 mph'
           WHEN 5 THEN 'signals' END"""
HIGHWAY = """CASE o_orderkey % 6 WHEN 0 THEN 'motorway_link' WHEN 1 THEN 'Primary' WHEN 2 THEN 'residential' WHEN 3 THEN 'service'
             WHEN 4 THEN 'tertiary' END"""
VOLTS = """CASE o_orderkey % 6 WHEN 0 THEN '230000' WHEN 1 THEN '345 kV' WHEN 2 THEN '115;230' WHEN 3 THEN '69'
           WHEN 4 THEN '110000,13800' END"""
