"""Travel-time tables: cell to anchor (T), anchor to entity (D), and their composition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellreach.plans.cuts import spread

#: Rows of times in a task, and the most anchors of a cell.
TASK_ROWS, K = 500_000, 20


def cell_topk(times: DataFrame, k: int = K) -> DataFrame:
    """(cell, anchor, t, rank from 0): per cell the k anchors of least time, an anchor once, ties by anchor.

    Times are dealt once, by cell, to tasks of about TASK_ROWS rows: what follows by cell has them together, however many there are.
    """
    least = spread(times.select("cell", "anchor", "t"), TASK_ROWS, "cell").groupBy("cell", "anchor").agg(F.min("t").alias("t"))
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("t", "anchor")) - 1
    return least.withColumn("rank", rank).where(F.col("rank") < k)


def widen(ranked: DataFrame, k: int = K) -> DataFrame:
    """A row per cell with a0_id, a0_s, ... from (cell, anchor, t, rank)."""
    wide = ranked.groupBy("cell").pivot("rank", list(range(k))).agg(F.first("anchor").alias("id"), F.first("t").alias("s"))
    names = {f"{i}_{x}": f"a{i}_{x}" for i in range(k) for x in ("id", "s")}
    return wide.withColumnsRenamed(names)


def compose(ranked: DataFrame, legs: DataFrame) -> DataFrame:
    """(cell, entity, total): the least t + seconds over anchors both tables have (min-plus product).

    An anchor's legs go to its cells as one row, and are taken apart where a cell's rows are together, so that the product is never shuffled.
    """
    each = F.sort_array(F.collect_list(F.struct("entity", "seconds")))
    packed = legs.groupBy("anchor").agg(each.alias("x")).select("anchor", F.col("x.entity").alias("entities"), F.col("x.seconds").alias("all_seconds"))
    met = ranked.select("cell", "anchor", "t").join(packed, "anchor").select("cell", "t", "entities", "all_seconds").repartition("cell")
    legs_of = met.select("cell", "t", F.explode(F.arrays_zip("entities", "all_seconds")).alias("x"))
    return legs_of.groupBy("cell", F.col("x.entities").alias("entity")).agg(F.min(F.col("t") + F.col("x.all_seconds")).alias("total"))


def compose_pairs(ranked: DataFrame, legs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of compose for pairs (cell, entity) alone: each is met with its cell's anchors, then with the one leg of each."""
    asked = ranked.select("cell", "anchor", "t").join(pairs.select("cell", "entity").distinct(), "cell")
    both = asked.join(legs.select("anchor", "entity", "seconds"), ["anchor", "entity"])
    return both.groupBy("cell", "entity").agg(F.min(F.col("t") + F.col("seconds")).alias("total"))


def compose_wide(wide: DataFrame, legs: DataFrame, entity: str, k: int = K) -> DataFrame:
    """(cell, total) for one entity from the wide table: its k slots are unpivoted and joined with the entity's legs."""
    slots = F.array(*[F.struct(F.col(f"a{i}_id").alias("anchor"), F.col(f"a{i}_s").alias("t")) for i in range(k)])
    long = wide.select("cell", F.explode(slots).alias("x")).where("x.anchor is not null").select("cell", "x.anchor", "x.t")
    return compose(long, legs.where(F.col("entity") == entity)).select("cell", "total")


def nearest_legs(times: DataFrame) -> DataFrame:
    """(anchor, entity, seconds): the least of several partial results."""
    return times.groupBy("anchor", "entity").agg(F.min("seconds").alias("seconds"))
