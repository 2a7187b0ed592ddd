"""Catalogue and look-up queries that a service would answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellreach.functions import geo, h3
from cellreach.functions.text import label_of
from cellreach.functions.units import UNREACHABLE
from cellreach.operators.poi import resolve_brand_text
from cellreach.operators.graph import kbest_by_part, reverse_edges
from cellreach.operators.spatial import nearest_node


def list_categories(legs: DataFrame) -> DataFrame:
    """(entity, label) of every entity with a leg, sorted."""
    return legs.select("entity").distinct().withColumn("label", label_of(F.col("entity"))).orderBy("entity")


def catalog(pois: DataFrame) -> DataFrame:
    """(category, brands): the sorted brands of each category."""
    return pois.where("category is not null").groupBy("category").agg(F.array_sort(F.collect_set("brand_id")).alias("brands"))


#: Labels of the categories that the catalogue groups.
HOSPITAL_LABEL = "Hospital"
TRAUMA_LABELS = ["Level 1 Trauma (Adults)", "Level 1 Trauma (Pediatric)"]


def catalog_categories(legs: DataFrame, registry: DataFrame, pois: DataFrame) -> DataFrame:
    """(id, label, group, brands) of every category with a leg (registry: category_id, numeric_id, display_name; legs by category_id; pois: category, brand_id).

    A category that the registry lacks has a label made from its id. Hospitals and trauma centres have a group; brands are sorted, and empty where there are none.
    """
    there = legs.select(F.col("entity").alias("category_id")).distinct()
    label = F.coalesce("display_name", F.concat(F.lit("Category "), F.col("category_id")))
    group = F.when(label == HOSPITAL_LABEL, "hospital").when(label.isin(TRAUMA_LABELS), "hospital_trauma")
    listed = there.join(registry, "category_id", "left").select("category_id", F.coalesce(F.col("numeric_id").cast("string"), "category_id").alias("id"), label.alias("label"), group.alias("group"))
    own = pois.select(F.trim("category").alias("category_id"), F.trim("brand_id").alias("brand")).where("brand <> ''")
    brands = own.groupBy("category_id").agg(F.array_sort(F.collect_set("brand")).alias("brands"))
    empty = F.array().cast("array<string>")
    return listed.join(brands, "category_id", "left").select("id", "label", "group", F.coalesce("brands", empty).alias("brands"))


def catalog_brands(pois: DataFrame, registry: DataFrame) -> DataFrame:
    """(id, label) of every brand that a place has: its registered name (brand_id, canonical), else its id as a label."""
    there = pois.select(F.trim("brand_id").alias("id")).where("id <> ''").distinct()
    named = registry.select(F.col("brand_id").alias("id"), "canonical").dropDuplicates(["id"])
    return there.join(named, "id", "left").select("id", F.coalesce(F.nullif("canonical", F.lit("")), label_of(F.col("id"))).alias("label"))


def d_anchor(legs: DataFrame, registry: DataFrame, asked: str) -> DataFrame:
    """(anchor, seconds) of a category by slug, numeric id or label (registry: category_id, numeric_id, display_name)."""
    low = asked.strip().lower()
    rank = (
        F.when(F.col("numeric_id").cast("string") == low, 0)
        .when(F.lower("category_id") == low, 1)
        .when(F.lower("display_name") == low, 2)
    )
    one = registry.select(F.col("category_id").alias("entity"), rank.alias("rank")).where("rank is not null").orderBy("rank").limit(1)
    out = legs.join(F.broadcast(one.select("entity")), "entity", "left_semi")
    return out.select("anchor", F.coalesce("seconds", F.lit(UNREACHABLE)).alias("seconds"))


def d_anchor_brand(legs: DataFrame, registry: DataFrame, asked: str) -> DataFrame:
    """(anchor, seconds) of a brand by id, name or alias (registry: brand_id, canonical, aliases); other text is taken as an id."""
    out = legs.where(F.lower("entity") == resolve_brand_text(registry, asked).lower())
    return out.select("anchor", F.coalesce("seconds", F.lit(UNREACHABLE)).alias("seconds"))


def d_anchor_custom(edges: DataFrame, nodes: DataFrame, anchors: DataFrame, lon: float, lat: float, cutoff: int) -> DataFrame:
    """(anchor, seconds) from every anchor to the node nearest to a place; the sentinel beyond the cutoff."""
    start = nearest_node(nodes, lon, lat).select("node")
    times = kbest_by_part(reverse_edges(edges), start, 1, cutoff).select(F.col("node").alias("n"), "d")
    seconds = F.least(F.coalesce("d", F.lit(UNREACHABLE)), F.lit(UNREACHABLE)).cast("int")
    return anchors.join(times, anchors["node"] == times["n"], "left").select(F.col("node").alias("anchor"), seconds.alias("seconds"))


def poi_points(pois: DataFrame, brands: list[str] = (), category: str | None = None, box=None) -> DataFrame:
    """Points of the brands or of the category, inside the box; nothing asked for gives nothing."""
    wanted = F.lit(False)
    if brands:
        wanted = wanted | F.col("brand_id").isin(list(brands))
    if category:
        wanted = wanted | (F.col("category") == category) | (F.col("subcat") == category)
    out = pois.where(F.coalesce(wanted, F.lit(False)))
    return out if box is None else out.where(geo.in_box(F.col("lon"), F.col("lat"), box))


def geojson_lines(cells: DataFrame, id_col: str = "cell", grid: str = "square") -> DataFrame:
    """(value): a GeoJSON feature per cell, of the square grid or H3 (whose ids are printed in hex), as a line; null properties are left out."""
    boundary, text = (h3.h3_boundary, geo.h3_string) if grid == "h3" else (geo.cell_boundary, lambda c: c.cast("string"))
    names = [c for c in cells.columns if c != id_col]
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(boundary(F.col(id_col))).alias("coordinates"))
    props = F.struct(text(F.col(id_col)).alias("cell"), *[F.col(c) for c in names])
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), props.alias("properties"))
    return cells.select(F.to_json(feature).alias("value"))
