"""Contiguous shards of nearly equal bytes from global prefix sums.

Rows are ordered by id (range-partitioned; ties by text digest), each partition sums its sizes, the
partitions' totals are summed up once on the driver (two numbers a partition), and every row gets its global
byte position. A row belongs to the shard in which the middle of its bytes lies, cuts being at equal
targets, so shards are contiguous and differ from the target by less than the largest row.

Scale: one shuffle of narrow rows (id, size, checksums), never of texts; the ordered rows are kept by a
checkpoint in the shared folder, so totals and positions come from the same rows even if executors are lost.

Defined results: a null text has size 1; null ids come first; repeated rows are each placed; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellreach.llm.common import cut


def shard_by_bytes(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row; size is the text's UTF-8 bytes plus one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("k"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(text).alias("h"),
    )
    parts = narrow.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ordered = cut(
        narrow.repartitionByRange(int(parts), "k", "h").sortWithinPartitions("k", "h").withColumn(
            "seq", F.monotonically_increasing_id()
        )
    )
    # The upper bits of monotonically_increasing_id are the partition, the lower ones the row's place in it.
    keyed = ordered.select("*", F.shiftright("seq", 33).alias("p"))
    totals = keyed.groupBy("p").agg(F.sum("size").alias("bytes")).orderBy("p").collect()
    starts, run = [], 0
    for r in totals:
        starts.append((r["p"], run))
        run += r["bytes"]
    before = narrow.sparkSession.createDataFrame(starts, "p long, before long")
    inside = Window.partitionBy("p").orderBy("seq")
    placed = keyed.withColumn("upto", F.sum("size").over(inside)).join(F.broadcast(before), "p")
    middle = F.col("before") + F.col("upto") - F.expr("(size + 1) div 2")
    shard = F.least(F.floor(middle * n_shards / F.lit(max(run, 1))), F.lit(n_shards - 1)).cast("int")
    sharded = placed.select("k", "size", "crc", "p", "seq", shard.alias("shard"))
    # Slots: rows of a shard in earlier partitions, then the place within the partition.
    counts = sharded.groupBy("shard", "p").agg(F.count(F.lit(1)).alias("c"))
    earlier = counts.withColumn(
        "earlier", F.sum("c").over(Window.partitionBy("shard").orderBy("p")) - F.col("c")
    ).select(F.col("shard").alias("e_shard"), F.col("p").alias("e_p"), "earlier")
    local = Window.partitionBy("p", "shard").orderBy("seq")
    numbered = sharded.withColumn("local", F.row_number().over(local) - 1)
    return numbered.join(
        earlier, (F.col("shard") == F.col("e_shard")) & (F.col("p") == F.col("e_p"))
    ).select(
        F.col("k").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("earlier") + F.col("local")).alias("slot")
    )
