"""Anchor sites in use: which entities they carry, the times from every anchor to the nearest of each, and labels inferred from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellreach.functions.text import pretty_label
from cellreach.operators.graph import kbest_by_part, reverse_edges
from cellreach.operators.tables import mode_label


def entity_counts(sites: DataFrame, column: str = "categories") -> DataFrame:
    """(entity, n): in how many sites a list column has each entity; blanks and nulls are left out, a site counts as often as it lists one."""
    each = sites.select(F.explode(column).alias("entity")).select(F.trim("entity").alias("entity"))
    return each.where("entity <> ''").groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


def target_entities(sites: DataFrame, registry: DataFrame, column: str = "categories", min_sites: int = 1) -> DataFrame:
    """(entity, n) of a registry's entities (entity) that are present in the sites, min_sites times or more."""
    counts = entity_counts(sites, column).where(F.col("n") >= max(1, min_sites))
    return counts.join(registry.select("entity").distinct(), "entity", "left_semi")


def with_coordinates(sites: DataFrame, nodes: DataFrame) -> DataFrame:
    """sites (node, ...) with lon and lat of their node (node, lon, lat); null where the node is not known."""
    return sites.join(nodes.select("node", "lon", "lat"), "node", "left")


def d_anchor_batch(edges: DataFrame, sites: DataFrame, targets: DataFrame, column: str = "categories", parts: int = 32) -> DataFrame:
    """(anchor, entity, seconds) of every anchor and target (entity, max_minutes) within its limit.

    sites: (anchor, node, list column). All targets are searched at once on the reversed graph, from the nodes of the sites that carry
    them; a label is (node, entity), so a node keeps the nearest site of each entity. Anchors out of reach have no row.
    """
    names = targets.select("entity", (F.col("max_minutes") * 60).cast("long").alias("limit"))
    carried = sites.select("node", F.explode(column).alias("entity")).join(names, "entity").distinct()
    sources = carried.select("node", F.col("entity").alias("src"), "limit")
    times = kbest_by_part(reverse_edges(edges), sources, None, parts=parts)
    near = times.select("node", F.col("src").alias("entity"), F.col("d").cast("int").alias("seconds"))
    return sites.select("anchor", "node").join(near, "node").select("anchor", "entity", "seconds")


def infer_labels(legs: DataFrame, sites: DataFrame, column: str = "categories") -> DataFrame:
    """(entity, label): what the anchors with a leg (anchor, entity) to it list most often, ties to the least, as a label."""
    listed = sites.select("anchor", F.explode(column).alias("label")).where("label is not null")
    best = mode_label(legs.select("anchor", "entity").join(listed, "anchor"), "entity", "label")
    return best.select("entity", pretty_label(F.col("label")).alias("label"))


def anchor_violations(sites: DataFrame) -> DataFrame:
    """(rule, key) of the sites (anchor, site_id, node, lon, lat, poi_ids, categories) that break the contract of anchor sites."""
    rules = {
        "empty poi_ids": F.coalesce(F.size("poi_ids"), F.lit(0)) < 1,
        "empty categories": F.coalesce(F.size("categories"), F.lit(0)) < 1,
        "bad coordinates": ~F.coalesce(F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90), F.lit(False)),
        "negative node": F.coalesce(F.col("node"), F.lit(-1)) < 0,
        "negative anchor": F.coalesce(F.col("anchor"), F.lit(-1)) < 0,
    }
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    rows = sites.select(F.explode(broken).alias("rule"), F.col("site_id").cast("string").alias("key"))
    for column in ("site_id", "anchor"):
        twice = sites.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        rows = rows.unionByName(twice.select(F.lit(f"repeated {column}").alias("rule"), F.col(column).cast("string").alias("key")))
    return rows
