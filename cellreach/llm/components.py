"""Connected components of a link table by alternating star contractions, wholly distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellreach.llm.common import cut

MAX_ROUNDS = 60


def _to_minimum(pairs: DataFrame, keep: str) -> DataFrame:
    """pairs (u, v), grouped by u: each v that `keep` lets through is linked to the least of u and its v's."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("mu"), F.least("u", "m").alias("m")
    )
    return pairs.join(least, F.col("u") == F.col("mu")).where(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b): component is the smallest node reachable.

    Each round is two aggregations and joins over the links and one checkpoint; the number of rounds grows
    with the logarithm of the number of links. Null ends are ignored. An empty table gives an empty result.
    """
    edges = links.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).distinct()
    edges = cut(edges)
    mark = None
    for _ in range(MAX_ROUNDS):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_minimum(both, "v > u").where("u <> v").distinct()
        low = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = _to_minimum(low, "true").where("u <> v")
        tops = low.groupBy("u").agg(F.min("v").alias("v"))
        edges = cut(small.union(tops).distinct())
        found = edges.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
        ).first()
        if mark == found:
            break
        mark = found
    else:
        raise RuntimeError("components did not settle")
    up = edges.groupBy("u").agg(F.min("v").alias("component"))
    roots = edges.select(F.col("v").alias("node")).distinct().join(up, F.col("node") == F.col("u"), "left_anti")
    return up.select(F.col("u").alias("node"), "component").union(roots.select("node", F.col("node").alias("component")))
