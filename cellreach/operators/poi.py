"""Points of interest: taxonomy, brands, conflation, anchor sites."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellreach.functions import geo, h3
from cellreach.functions.ids import uuid5
from cellreach.functions.text import coalesce_text
from cellreach.operators.tables import keep_first

#: Words that make a hospital of a facility, and words that do not.
HOSPITAL_WORDS = ["hospital", "medical center", "medical centre"]
NOT_HOSPITAL_WORDS = [
    "urgent care", "urgent_care", "express care", "quick care",
    "facial", "cosmetic", "plastic surgery", "dermatology", "spa", "aesthetic", "rejuvenation",
    "allergy", "asthma", "nutrition", "wellness", "office building",
    "sleep", "med docs", "concierge", "consults",
    " supply", "supplies", "equipment", " at ", "center at", "surgery at",
]
#: Place of worship by religion.
WORSHIP = {
    "christian": "church",
    "muslim": "mosque",
    "jewish": "synagogue",
    "hindu": "temple",
    "buddhist": "temple",
    "jain": "temple",
    "sikh": "temple",
}
#: Trauma levels by the words that feeds use for them.
TRAUMA_ALIASES = {
    "trauma_level_1_adult": "trauma_level_1_adult",
    "trauma_level_1_pediatric": "trauma_level_1_pediatric",
    "adult": "trauma_level_1_adult",
    "pediatric": "trauma_level_1_pediatric",
    "peds": "trauma_level_1_pediatric",
}
SOURCE_RANK = {"overture": 0, "osm": 1}
#: Snap distances in metres by mode.
SNAP_METRES = {"drive": 1609.0, "walk": 402.0}


def _lookup(value: Column, table: dict) -> Column:
    flat = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*flat), value)


def hospital_or_clinic(category: Column, name: Column) -> Column:
    """The category, or 'clinic' for a hospital whose name does not bear that out."""
    low = F.coalesce(F.lower(name), F.lit(""))
    some = lambda words: reduce(lambda a, b: a | b, [low.contains(w) for w in words])
    real = some(HOSPITAL_WORDS) & ~some(NOT_HOSPITAL_WORDS)
    return F.when((category == "hospital") & ~real, F.lit("clinic")).otherwise(category)


#: Words that make a clinic of a hospital in the tagged feed, whose names need not say hospital.
TAGGED_NOT_HOSPITAL_WORDS = [
    "urgent care", "urgent_care", "afc urgent", "express care", "quick care",
    "facial", "cosmetic", "plastic surgery", "dermatology", "spa", "aesthetic", "rejuvenation",
]
#: The tag keys that give a place its category, the first one that is mapped.
TAG_ORDER = ["amenity", "shop", "leisure", "tourism", "aeroway"]


def map_tags(pois: DataFrame, mapping: DataFrame) -> DataFrame:
    """pois (name, tags map) with class, category and subcat of the first key of TAG_ORDER whose value is mapped (key, value, class, category, subcat).

    A hospital by one of TAGGED_NOT_HOSPITAL_WORDS is a clinic; a place of worship has the kind of its religion, and nothing for a religion that
    is not mapped; airports go.
    """
    found = pois
    for k in TAG_ORDER:
        own = mapping.where(F.col("key") == k).select(F.col("value").alias(f"_{k}"), F.struct("class", "category", "subcat").alias(f"_x_{k}"))
        found = found.join(own, F.try_element_at("tags", F.lit(k)) == F.col(f"_{k}"), "left").drop(f"_{k}")
    found = found.withColumn("_x", F.coalesce(*[F.col(f"_x_{k}") for k in TAG_ORDER])).drop(*[f"_x_{k}" for k in TAG_ORDER])
    low = F.coalesce(F.lower("name"), F.lit(""))
    clinic = (F.col("_x.category") == "hospital") & reduce(lambda a, b: a | b, [low.contains(w) for w in TAGGED_NOT_HOSPITAL_WORDS])
    religion = F.try_element_at("tags", F.lit("religion"))
    worship = F.coalesce(F.col("_x.category").startswith("place_of_worship") & (religion != ""), F.lit(False))
    kind = _lookup(F.lower(religion), WORSHIP)

    def pick(field: str, of_clinic: str, of_worship: Column) -> Column:
        return F.when(clinic, F.lit(of_clinic)).when(worship, F.when(kind.isNotNull(), of_worship)).otherwise(F.col(f"_x.{field}"))

    named = found.withColumns(
        {
            "class": pick("class", "health", F.col("_x.class")),
            "category": pick("category", "clinic", F.concat(F.lit("place_of_worship_"), kind)),
            "subcat": pick("subcat", "clinic", kind),
        }
    )
    return named.drop("_x").where(F.coalesce("category", F.lit("")) != "airport")


def allowed(pois: DataFrame, categories: list[str] = (), brands: list[str] = ()) -> DataFrame:
    """pois (category, brand_id) of the categories or the brands; with neither list, those that have a category or a brand."""
    if categories or brands:
        listed = [F.coalesce(F.col(c).isin(list(some)), F.lit(False)) for c, some in (("category", categories), ("brand_id", brands))]
        return pois.where(listed[0] | listed[1])
    return pois.where("category is not null or brand_id is not null")


def resolve_brand_text(registry: DataFrame, asked: str) -> str:
    """The brand id of an id, name or alias, whatever its case; the text itself, lower-cased, if it is none."""
    low = asked.strip().lower()
    hit = alias_table(registry).where(F.col("alias") == low).select("brand_id").head(1)
    return hit[0]["brand_id"] if hit and low else low


def worship_kind(religion: Column) -> Column:
    """place_of_worship_<kind>; null for a religion that is not mapped."""
    return F.concat(F.lit("place_of_worship_"), _lookup(F.lower(religion), WORSHIP))


def map_categories(pois: DataFrame, mapping: DataFrame, key: str = "primary") -> DataFrame:
    """pois (name, religion, `key`, ...) with class, category and subcat of a mapping table (`key`, class, category, subcat).

    A hospital whose name does not bear that out is a clinic in all three. A place of worship takes the kind of its religion, if one is given (an empty
    text is none), and goes if that is not mapped; airports go.
    """
    mapped = pois.join(mapping.select(key, F.struct("class", "category", "subcat").alias("_x")), key, "left")
    worship = F.coalesce(F.lower(key).contains("place_of_worship") & (F.col("religion") != ""), F.lit(False))
    kind = _lookup(F.lower("religion"), WORSHIP)
    clinic = F.col("_x.category") != hospital_or_clinic(F.col("_x.category"), F.col("name"))

    def pick(field: str, of_clinic: str, of_worship: Column) -> Column:
        return F.when(worship, of_worship).when(clinic, F.lit(of_clinic)).otherwise(F.col(f"_x.{field}"))

    named = mapped.withColumns(
        {
            "class": pick("class", "health", F.lit("religious")),
            "category": pick("category", "clinic", worship_kind(F.col("religion"))),
            "subcat": pick("subcat", "clinic", kind),
        }
    )
    return named.where(~(worship & kind.isNull()) & (F.coalesce("category", F.lit("")) != "airport")).drop("_x")


def resolve_brand(pois: DataFrame, aliases: DataFrame, candidates: list[str]) -> DataFrame:
    """pois with brand_id: the first of the candidate columns whose lower-cased text is an alias (alias, brand_id)."""
    out = pois
    for k, column in enumerate(candidates):
        side = aliases.select(F.col("alias").alias(f"_a{k}"), F.col("brand_id").alias(f"_b{k}"))
        out = out.join(side, F.lower(F.trim(column)) == F.col(f"_a{k}"), "left")
    found = F.coalesce(*[F.col(f"_b{k}") for k in range(len(candidates))])
    return out.withColumn("brand_id", found).drop(*[f"_{x}{k}" for x in "ab" for k in range(len(candidates))])


def alias_table(brands: DataFrame) -> DataFrame:
    """(alias, brand_id) from a registry (brand_id, canonical, aliases): separators are ';', else '|', else ','."""
    sep = F.when(F.col("aliases").contains(";"), ";").when(F.col("aliases").contains("|"), "\\|").otherwise(",")
    names = F.concat(F.array("canonical", "brand_id"), F.coalesce(F.split("aliases", sep), F.array().cast("array<string>")))
    rows = brands.select("brand_id", F.explode(names).alias("alias")).select(F.lower(F.trim("alias")).alias("alias"), "brand_id")
    return keep_first(rows.where("alias <> ''"), ["alias"], [F.col("brand_id")])


#: H3 resolutions of the conflation key: of branded places and of others.
H3_FINE, H3_COARSE = 11, 10


def with_h3_r9(pois: DataFrame) -> DataFrame:
    """pois (lon, lat) with their H3 cell of resolution 9 as text, as the canonical schema has it."""
    return pois.withColumn("h3_r9", geo.h3_string(h3.h3_cell(F.col("lon"), F.col("lat"), 9)))


def conflate(pois: DataFrame, merge_sources: bool = False, fine: int = 17, coarse: int = 16, grid: str = "square") -> DataFrame:
    """One row per duplicate key, preferring branded rows and then the better source; ties by poi_id.

    The key is brand, name, category, fine cell and eight characters of ext_id for branded rows, else name,
    category, coarse cell and ext_id. With merge_sources, ext_id is left out, so that feeds are merged. grid="h3" takes the H3 cells of
    H3_FINE and H3_COARSE.
    """
    brand = coalesce_text(F.col("brand_id"))
    text = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    ext = F.lit("") if merge_sources else F.when(brand.isNotNull(), F.substring("ext_id", 1, 8)).otherwise(F.col("ext_id"))
    place = F.col("lon"), F.col("lat")
    if grid == "h3":
        cell = F.when(brand.isNotNull(), h3.h3_cell(*place, H3_FINE)).otherwise(h3.h3_cell(*place, H3_COARSE))
    else:
        cell = F.when(brand.isNotNull(), geo.cell_of(*place, fine)).otherwise(geo.cell_of(*place, coarse))
    keyed = pois.withColumns(
        {"_k1": F.coalesce(brand, F.lit("")), "_k2": text(F.col("name")), "_k3": text(F.col("category")), "_k4": cell, "_k5": F.coalesce(ext, F.lit(""))}
    )
    rank = F.coalesce(_lookup(F.col("source"), SOURCE_RANK), F.lit(2))
    keys = ["_k1", "_k2", "_k3", "_k4", "_k5"]
    return keep_first(keyed, keys, [brand.isNull(), rank, F.col("poi_id")]).drop(*keys)


def expand_categories(category: Column, subcat: Column, trauma: Column) -> Column:
    """Sorted categories of a site: its own, and for trauma centres 'hospital' and the trauma level."""
    own = F.array(coalesce_text(category))
    levels = [_lookup(F.lower(F.trim(c)), TRAUMA_ALIASES) for c in (subcat, trauma)]
    extra = [F.when(level.isNotNull(), F.array(F.lit("hospital"), level)).otherwise(F.array().cast("array<string>")) for level in levels]
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(own, *extra))))


def anchor_sites(pois: DataFrame, mode: str = "drive") -> DataFrame:
    """A site per node from snapped pois (poi_id, node, dist, brand_id, categories): lists sorted and distinct, site id by mode and node."""
    close = pois.where(F.col("dist") <= SNAP_METRES[mode])
    grouped = close.groupBy("node").agg(
        F.array_sort(F.collect_set("poi_id")).alias("poi_ids"),
        F.array_sort(F.collect_set("brand_id")).alias("brands"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("categories")))).alias("categories"),
    )
    return grouped.withColumn("site_id", uuid5(F.concat(F.lit(f"{mode}|"), F.col("node").cast("string"))))
