"""Sources: partitioned legs, registries, limits, feeds in JSON and CSV, edges, pixels."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellreach.functions.geo import wkb_point
from cellreach.operators.tables import conform

LEGS = (
    T.StructType()
    .add("anchor", T.LongType())
    .add("entity", T.StringType())
    .add("mode", T.IntegerType())
    .add("seconds", T.IntegerType())
    .add("snapshot_ts", T.DateType())
)
LEGACY = {"anchor_int_id": "anchor", "anchor_id": "anchor", "seconds_u16": "seconds", "category_id": "entity", "brand_id": "entity"}
TRAUMA_LEVELS = {"Level I Trauma Center": "adult", "Level I Pediatric Trauma Center": "pediatric"}


def read_legs(spark: SparkSession, base: str, mode: int | None = None, entity: str | None = None) -> DataFrame:
    """Legs of a Hive-partitioned folder; mode and entity prune partitions, old column names are accepted."""
    df = conform(spark.read.parquet(base), LEGS, LEGACY)
    if mode is not None:
        df = df.where(F.col("mode") == mode)
    return df if entity is None else df.where(F.col("entity") == entity)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Category registry; a numeric id given twice is an error."""
    df = spark.read.schema("category_id string, numeric_id int, display_name string").csv(path, header=True, comment="#")
    twice = df.groupBy("numeric_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"numeric_id {twice[0]['numeric_id']} is given twice")
    return df


def read_brands(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("brand_id string, canonical string, aliases string, wikidata string").csv(path, header=True, comment="#")


def limits_for(spark: SparkSession, limits: dict, kind: str, entities: DataFrame) -> DataFrame:
    """entities (entity) with max_minutes and top_k of {kind: {id: {...}}, "_defaults": {...}}."""
    given = [(k, v.get("max_minutes"), v.get("top_k")) for k, v in limits.get(kind, {}).items()]
    table = spark.createDataFrame(given, "entity string, m int, k int")
    base = limits.get("_defaults", {})
    base = base.get(kind, base)
    return entities.join(F.broadcast(table), "entity", "left").select(
        "entity",
        F.coalesce("m", F.lit(base.get("max_minutes")).cast("int")).alias("max_minutes"),
        F.coalesce("k", F.lit(base.get("top_k")).cast("int")).alias("top_k"),
    )


def read_places(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Places of nested rows (id, names.primary, categories.primary, brand.names.primary, bbox): flat; the box reaches the scan.

    The place is that of a WKB point `geometry`, if there is one, else the corner of bbox.
    """
    df = spark.read.parquet(path)
    if box:
        x1, y1, x2, y2 = box
        df = df.where(F.col("bbox.xmin").between(min(x1, x2), max(x1, x2)) & F.col("bbox.ymin").between(min(y1, y2), max(y1, y2)))
    lon, lat = wkb_point(F.col("geometry")) if "geometry" in df.columns else (F.col("bbox.xmin"), F.col("bbox.ymin"))
    return df.select(
        F.col("id").alias("ext_id"),
        F.col("names.primary").alias("name"),
        F.col("categories.primary").alias("primary"),
        F.col("brand.names.primary").alias("brand"),
        lon.cast("double").alias("lon"),
        lat.cast("double").alias("lat"),
    )


#: Subtypes of water that are read.
WATER = ["ocean", "sea", "lake", "reservoir", "pond", "lagoon", "river", "canal"]


def read_water(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Water bodies of the subtypes of WATER with a kind of ocean, lake, river or other; those whose bbox meets the box, if one is given."""
    sub = F.lower("subtype")
    kind = F.when(sub.isin("ocean", "sea"), "ocean").when(sub.isin("lake", "pond", "reservoir"), "lake").when(sub.isin("river", "canal"), "river")
    df = spark.read.parquet(path).where(sub.isin(WATER))
    if box:
        x1, y1, x2, y2 = box
        meets = [F.col("bbox.xmin") <= max(x1, x2), F.col("bbox.xmax") >= min(x1, x2), F.col("bbox.ymin") <= max(y1, y2), F.col("bbox.ymax") >= min(y1, y2)]
        for one in meets:
            df = df.where(one)
    return df.withColumn("kind", F.coalesce(kind, F.lit("other")))


def tagged_pois(features: DataFrame, wanted: dict[str, list[str]] | None = None, columns: tuple[str, ...] = ("name", "brand", "operator")) -> DataFrame:
    """Features (id, kind, tags map, lon, lat) that are nodes or ways and have a wanted tag, with a column for each tag named (null where absent).

    With nothing wanted, features with any value of the broad keys.
    """
    from cellreach.functions.text import tag_match

    own = features.where(F.col("kind").isin("node", "way"))
    if wanted:
        own = own.where(tag_match(F.col("tags"), [(k, v) for k, values in wanted.items() for v in values]))
    else:
        own = own.where(" or ".join(f"try_element_at(tags, '{k}') is not null" for k in ("amenity", "shop", "leisure", "tourism")))
    return own.withColumns({c: F.try_element_at("tags", F.lit(c)) for c in columns})


def beaches(features: DataFrame) -> DataFrame:
    """Beaches among features (id, kind, tags, lon, lat): one for each place to six decimals, a node before a way before a relation, then by id.

    With a column `rings`, shapes without a place of their own have a point inside their area; those without any area go.
    """
    from cellreach.functions.rings import representative_point
    from cellreach.operators.tables import keep_first

    if "rings" in features.columns:
        x, y = representative_point(F.col("rings"))
        features = features.withColumns({"lon": F.coalesce("lon", x), "lat": F.coalesce("lat", y)}).drop("rings")
    own = features.where((F.try_element_at("tags", F.lit("natural")) == "beach") & F.col("lon").isNotNull() & F.col("lat").isNotNull())
    rank = F.array_position(F.array(F.lit("node"), F.lit("way"), F.lit("relation")), F.col("kind"))
    keyed = own.withColumns({"_x": F.round("lon", 6), "_y": F.round("lat", 6)})
    return keep_first(keyed, ["_x", "_y"], [rank, F.col("id")]).drop("_x", "_y")


def read_election(spark: SparkSession, path: str) -> DataFrame:
    """Votes by county, party and office; columns are found by the header's names, and numbers that do not parse are null."""
    kinds = {"year": "int", "state": "string", "county_name": "string", "county_fips": "string", "office": "string", "party": "string", "candidatevotes": "int", "totalvotes": "int"}
    raw = spark.read.csv(path, header=True)
    return raw.select(*[F.col(name).try_cast(kind).alias(name) for name, kind in kinds.items()])


def with_overrides(mapping: DataFrame, overrides: dict[str, list[str]]) -> DataFrame:
    """mapping (key, value, class, category, subcat) with rows of {"key:value": [class, category, subcat]} put in place of its own.

    Entries without a colon or with fewer than three parts are left out.
    """
    rows = [(*k.split(":", 1), *map(str, v[:3])) for k, v in overrides.items() if ":" in k and isinstance(v, (list, tuple)) and len(v) >= 3]
    if not rows:
        return mapping
    new = mapping.sparkSession.createDataFrame(rows, "key string, value string, class string, category string, subcat string")
    return mapping.join(new, ["key", "value"], "left_anti").unionByName(new)


def load_checked(spark: SparkSession, paths: list[str], required: list[str], warn_only: bool = False) -> list[DataFrame]:
    """The Parquet tables at paths that have the required columns; another one is an error, or left out with a warning."""
    from pyspark.errors import AnalysisException

    out = []
    for path in paths:
        try:
            df = spark.read.parquet(path)
            lacking = sorted(set(required) - set(df.columns))
            if lacking:
                raise ValueError(f"{path} lacks {', '.join(lacking)}")
            out.append(df)
        except (AnalysisException, ValueError) as e:
            if not warn_only:
                raise
            warnings.warn(f"left out: {e}", stacklevel=2)
    return out


def read_first(spark: SparkSession, *paths: str) -> DataFrame:
    """The Parquet table at the first of the paths that exists."""
    session = spark._jsparkSession.sessionState().newHadoopConf()
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(session).exists(at):
            return spark.read.parquet(path)
    raise FileNotFoundError(", ".join(paths))


def read_airports(spark: SparkSession, path: str) -> DataFrame:
    """(iata, name, lon, lat); rows whose coordinates do not parse are left out."""
    raw = spark.read.csv(path, header=True, comment="#")
    out = raw.select(
        F.col("IATA").alias("iata"),
        F.col("AIRPORT").alias("name"),
        F.col("LONGITUDE").try_cast("double").alias("lon"),
        F.col("LATITUDE").try_cast("double").alias("lat"),
    )
    return out.na.drop(subset=["lon", "lat"])


def read_facilities(spark: SparkSession, path: str | list[str], multi_line: bool | None = True) -> DataFrame:
    """Trauma facilities of {"results": [...]} documents or JSON lines: parents and children flat, with the level of their programmes.

    A child without a place takes its parent's. Of rows of one name, level and place to five decimals the first stays: files in the order of
    their names, and in a file the order of its rows. multi_line=None tries documents and takes lines where a file is none.
    """
    if multi_line is None:
        whole = spark.read.text(path, wholetext=True).select(F.get_json_object("value", "$.results").isNotNull().alias("document"), F.input_file_name().alias("file"))
        kinds = {r["file"]: r["document"] for r in whole.collect()}  # a row a file
        some = [[f for f, document in kinds.items() if document is want] for want in (True, False)]
        tables = [read_facilities(spark, files, want) for files, want in zip(some, (True, False), strict=True) if files]
        return tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1]).distinct()
    place = "struct<latitude: double, longitude: double>"
    core = f"name: string, guid: string, country: string, locationPoint: {place}, programs: array<struct<levels: array<string>>>"
    row = f"{core}, childInstitutions: array<struct<{core}>>"
    ddl = f"results array<struct<{row}>>"
    if not multi_line:
        ddl = T.StructType.fromDDL(ddl)["results"].dataType.elementType
    read = spark.read.schema(ddl).json(path, multiLine=multi_line).select("*", F.input_file_name().alias("_file"), F.monotonically_increasing_id().alias("_line"))
    if multi_line:
        rows = read.select("_file", F.posexplode("results").alias("_at", "r"))
    else:
        rows = read.select("_file", F.col("_line").alias("_at"), F.struct(*[c for c in read.columns if c[0] != "_"]).alias("r"))
    pick = lambda x, at: F.struct(x["name"].alias("name"), x["guid"].alias("ext_id"), x["country"].alias("country"), at.alias("at"), x["programs"].alias("programs"))
    parent = F.col("r.locationPoint")
    children = F.transform(
        F.coalesce("r.childInstitutions", F.array().cast(f"array<struct<{core}>>")), lambda c: pick(c, F.coalesce(c["locationPoint"], parent))
    )
    every = rows.select("_file", "_at", F.posexplode(F.concat(F.array(pick(F.col("r"), parent)), children)).alias("_child", "x")).select("_file", "_at", "_child", "x.*")
    levels = F.array_distinct(F.flatten(F.transform(F.coalesce("programs", F.array().cast("array<struct<levels: array<string>>>")), lambda p: p["levels"])))
    known = F.create_map(*[F.lit(v) for kv in TRAUMA_LEVELS.items() for v in kv])
    named = every.withColumn("level", F.explode(levels)).withColumn("trauma_level", F.try_element_at(known, F.col("level")))
    ok = named.where("trauma_level is not null and trim(country) in ('US', 'USA', 'United States')")
    flat = ok.select("name", "ext_id", "trauma_level", F.col("at.longitude").alias("lon"), F.col("at.latitude").alias("lat"), "_file", "_at", "_child")
    from cellreach.operators.tables import keep_first

    placed = flat.withColumns({"_x": F.round("lon", 5), "_y": F.round("lat", 5)})
    first = keep_first(placed, ["name", "trauma_level", "_x", "_y"], [F.col("_file"), F.col("_at"), F.col("_child")])
    return first.select("name", "ext_id", "trauma_level", "lon", "lat")


def read_edges(spark: SparkSession, path: str, mode: str = "drive") -> DataFrame:
    """(u, v, w, oneway) of a way table (u, v, length, highway, maxspeed, oneway), or of a map extract."""
    if path.endswith(".pbf"):
        from cellreach.sources.osm import network, read_osm

        return edges_of(network(read_osm(spark, path, "way"), read_osm(spark, path, "node"), mode), mode)
    return edges_of(spark.read.parquet(path), mode)


def edges_of(raw: DataFrame, mode: str = "drive") -> DataFrame:
    """(u, v, w, oneway) of ways (u, v, length, highway, maxspeed, oneway)."""
    from cellreach.functions import text, units

    kmh = F.coalesce(text.maxspeed_kmh(F.col("maxspeed")), text.highway_kmh(F.col("highway")))
    seconds = units.walk_seconds(F.col("length")) if mode == "walk" else units.drive_seconds(F.col("length"), kmh)
    oneway = F.lit(False) if mode == "walk" else text.oneway(F.col("oneway"))
    return raw.select("u", "v", seconds.alias("w"), oneway.alias("oneway"))


#: What the name of a month's raster may be, the best first; mon, MON and Mon are the month's short name, mm its number.
RASTER_NAMES = [".*_{mon}_.*", ".*{mon}", ".*{mon}_.*", ".*{MON}.*", ".*{Mon}.*", ".*_2020{mm}_.*", ".*{mm}_.*", ".*{mm}"]


def month_rasters(files: DataFrame) -> DataFrame:
    """(var, month, path, band) from files (path, bands) named <folder of the variable>/<name>.tif.

    Each month has the file of the best of RASTER_NAMES, ties by path, and in it the month's band if it has several. A variable without a file
    for every month has twelve bands of its first file; fewer bands are an error.
    """
    from cellreach.operators.overlays import MONTHS
    from cellreach.operators.tables import keep_first

    named = files.where(F.col("path").endswith(".tif")).select(
        "path", "bands", F.element_at(F.split("path", "/"), -2).alias("var"), F.element_at(F.split("path", "/"), -1).alias("_name")
    )
    kinds = [(k, m, "^" + p.format(mon=mon, MON=mon.upper(), Mon=mon.title(), mm=f"{m:02d}") + r"\.tif$") for m, mon in enumerate(MONTHS, 1) for k, p in enumerate(RASTER_NAMES)]
    hits = F.array_compact(F.array(*[F.when(F.col("_name").rlike(p), F.struct(F.lit(m).alias("month"), F.lit(k).alias("rank"))) for k, m, p in kinds]))
    tried = named.withColumn("x", F.explode(hits)).select("var", "path", "bands", "x.*")
    best = keep_first(tried, ["var", "month"], [F.col("rank"), F.col("path")])
    whole = best.groupBy("var").agg(F.count(F.lit(1)).alias("n")).where("n = 12").select("var")
    own = best.join(whole, "var", "left_semi").select("var", "month", "path", F.when(F.col("bands") > 1, F.col("month")).alias("band"))
    stacks = keep_first(named.join(whole, "var", "left_anti"), ["var"], [F.col("path")])
    few = stacks.where("bands < 12").head(1)
    if few:
        raise ValueError(f"{few[0]['path']} has {few[0]['bands']} bands, not 12")
    every = stacks.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12)))).select("var", "month", "path", F.col("month").alias("band"))
    return own.unionByName(every)


def load_cells(spark: SparkSession, *paths: str, res: int) -> DataFrame:
    """Distinct cells of a resolution from one or more files."""
    return spark.read.option("mergeSchema", "true").parquet(*paths).where(F.col("res") == res).select(F.col("cell").cast("long").alias("cell")).distinct()


