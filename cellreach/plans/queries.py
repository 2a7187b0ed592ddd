"""The registered queries of the travel-time engine, each beside the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellreach.functions import geo, h3, ids, rings, text, units
from cellreach.operators import anchors, checks, graph, overlays, poi, polygons, spatial, tables, times
from cellreach.operators.polygons import RasterGrid
from cellreach.plans import catalog, standins as s
from cellreach.plans.cuts import spread
from cellreach.plans.livable import State, explain_cells, livable, livable_percent
from cellreach.plans.livable import livable_layers as layers
from cellreach.plans.standins import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CUTOFF, K = 1800, 5


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _ranked(spark, d):
    return times.cell_topk(s.times(spark, d))


def _legs(spark, d):
    return times.nearest_legs(s.legs0(spark, d))


STATE = State({"Brand#1": 5, "Brand#7": 6}, ("ECONOMY", "PROMO", "SMALL"), True, (1, 3))


@query(f"""
WITH {s.RANKED}, {s.LEGS}, {s.CELLS},
wanted(entity, lim) AS (VALUES ('Brand#1', 300), ('Brand#7', 360)),
c AS (SELECT cell, entity, min(t + seconds) AS total FROM ranked JOIN legs USING (anchor) GROUP BY cell, entity),
ok AS (SELECT cell FROM c JOIN wanted USING (entity) WHERE total <= lim GROUP BY cell HAVING count(*) = 2)
SELECT cell FROM cells JOIN ok USING (cell) WHERE climate_label IN ('ECONOMY', 'PROMO', 'SMALL') AND NOT near_power_corridor
AND political_lean BETWEEN 1 AND 3""")
def livable_flagship(spark, d):
    return livable(s.cells(spark, d), _ranked(spark, d), _legs(spark, d), STATE)


@query(f"WITH {s.RANKED} SELECT cell, anchor, t, rank FROM ranked")
def thex_topk(spark, d):
    return _ranked(spark, d).withColumn("rank", F.col("rank").cast("long"))


_WIDE = ", ".join(f"max(anchor) FILTER (rank = {i}) AS a{i}_id, max(t) FILTER (rank = {i}) AS a{i}_s" for i in range(20))


@query(f"WITH {s.RANKED} SELECT cell, {_WIDE} FROM ranked GROUP BY cell")
def thex_wide_pivot(spark, d):
    return times.widen(_ranked(spark, d))


@query(f"WITH {s.RANKED}, {s.LEGS} SELECT cell, entity, min(t + seconds) AS total FROM ranked JOIN legs USING (anchor) GROUP BY cell, entity")
def compose_min_plus_long(spark, d):
    return times.compose(_ranked(spark, d), _legs(spark, d))


@query(f"WITH {s.RANKED}, {s.LEGS} SELECT cell, min(t + seconds) AS total FROM ranked JOIN legs USING (anchor) WHERE entity = 'Brand#3' GROUP BY cell")
def compose_min_plus_wide(spark, d):
    return times.compose_wide(times.widen(_ranked(spark, d)), _legs(spark, d), "Brand#3")


@query(f"WITH {s.LEGS} SELECT * FROM legs")
def d_anchor_min_merge(spark, d):
    return _legs(spark, d)


_LABELS = f"""
WITH RECURSIVE {s.EDGES}, {s.ANCHORS},
lab(node, src, d) USING KEY (node, src) AS (
  SELECT node, node, CAST(0 AS BIGINT) FROM anchors
  UNION
  SELECT n.v, n.src, min(n.nd) FROM (
    SELECT edges.v AS v, lab.src AS src, lab.d + edges.w AS nd FROM lab JOIN edges ON lab.node = edges.u
  ) n LEFT JOIN recurring.lab r ON r.node = n.v AND r.src = n.src
  WHERE n.nd <= {CUTOFF} AND (r.d IS NULL OR n.nd < r.d) GROUP BY n.v, n.src)"""


@query(f"""{_LABELS}
SELECT node, src, d FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY d, src) AS rk FROM lab) WHERE rk <= {K}""")
def kbest_multisource(spark, d):
    return graph.kbest(s.edges(spark, d), s.anchors(spark, d), K, CUTOFF)


@query(ORACLES["kbest_multisource"])
def kbest_per_source(spark, d):
    return graph.kbest_by_source(s.edges(spark, d), s.anchors(spark, d), K, CUTOFF)


@query(f"{_LABELS} SELECT node, min(d) AS d FROM lab GROUP BY node")
def sssp_bounded(spark, d):
    return graph.kbest(s.edges(spark, d), s.anchors(spark, d), 1, CUTOFF).select("node", "d")


_SUPPLY = """
e AS (SELECT o_custkey AS u, l_suppkey + 1000000 AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity = 50 AND l_discount = 0.1)"""


def _sparse(spark, d):
    items = table(spark, d, "lineitem").where("l_quantity = 50 and l_discount = 0.1")
    both = items.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select(F.col("o_custkey").alias("u"), (F.col("l_suppkey") + 1000000).alias("v"))


@query(f"""
WITH RECURSIVE {_SUPPLY}, b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
lab(node, c) USING KEY (node) AS (
  SELECT u, min(u) FROM b GROUP BY u
  UNION
  SELECT b.v, min(lab.c) FROM lab JOIN b ON lab.node = b.u JOIN recurring.lab r ON r.node = b.v WHERE lab.c < r.c GROUP BY b.v)
SELECT node, c AS component FROM lab""")
def connected_components(spark, d):
    return graph.components(_sparse(spark, d))


@query(f"WITH {s.EDGES} SELECT v AS u, u AS v, w FROM edges")
def reverse_edges(spark, d):
    return graph.reverse_edges(s.edges(spark, d))


@query(f"""
WITH {s.EDGES}, o AS (SELECT u AS node, count(*) AS o FROM edges GROUP BY u), i AS (SELECT v AS node, count(*) AS i FROM edges GROUP BY v)
SELECT node, coalesce(o, 0) AS out_degree, coalesce(i, 0) AS in_degree FROM o FULL JOIN i USING (node)""")
def node_degree(spark, d):
    return graph.degrees(s.edges(spark, d))


@query(f"WITH {s.EDGES} SELECT u, v, w FROM edges UNION ALL SELECT v, u, w FROM edges WHERE w % 2 = 0")
def csr_edge_expand(spark, d):
    return graph.build_edges(s.edges(spark, d).withColumn("oneway", F.col("w") % 2 == 1))


@query(f"""
WITH {s.EDGES} SELECT u, v, w FROM edges WHERE u IN (SELECT p_partkey FROM part WHERE p_size < 40) AND v IN (SELECT p_partkey FROM part WHERE p_size < 40)""")
def known_edges(spark, d):
    nodes = table(spark, d, "part").where("p_size < 40").select(F.col("p_partkey").alias("node"))
    return graph.known_edges(s.edges(spark, d), nodes)


@query(ORACLES["connected_components"].replace("SELECT node, c AS component FROM lab", """
SELECT DISTINCT node FROM lab WHERE node >= 1000000 AND c IN (SELECT c FROM lab JOIN customer ON c_custkey = node WHERE c_mktsegment = 'BUILDING')"""))
def target_nodes(spark, d):
    comps = graph.components(_sparse(spark, d))
    anchors = comps.where("node >= 1000000").select("node")
    sources = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("node"))
    return graph.target_nodes(anchors, sources, comps)


def _supplied(spark, d):
    items = spread(table(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), graph.TASK_EDGES, "l_orderkey")
    both = items.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select(F.col("o_custkey").alias("u"), (F.col("l_suppkey") + 1000000).alias("v"))


@query()
def connected_components_all(spark, d):
    return graph.components(_supplied(spark, d))


@query()
def target_nodes_all(spark, d):
    comps = graph.components(_supplied(spark, d))
    anchors = comps.where("node >= 1000000").select("node")
    sources = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("node"))
    return graph.target_nodes(anchors, sources, comps)


_NEAR, _RES = 9000.0, 7


@query(f"""
WITH {s.POINTS}, {s.PLACES}, x AS (SELECT id, place, {s.DIST} AS dist FROM points, places),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, place) AS rank FROM x WHERE dist <= {_NEAR})
SELECT id, place, round(dist, 3) AS dist, rank FROM r WHERE rank <= 10""")
def knn_join(spark, d):
    near = spatial.knn_join(s.points(spark, d), s.places(spark, d), 10, _NEAR, _RES)
    return near.select("id", "place", F.round("dist", 3).alias("dist"), F.col("rank").cast("long").alias("rank"))


@query(f"""
WITH {s.POINTS}, {s.PLACES}, x AS (SELECT id, place, {s.DIST} AS dist, place % 4 AS score FROM points, places),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, place) AS rank FROM x WHERE dist <= {_NEAR}),
f AS (SELECT id, dist AS d1, score AS s1 FROM r WHERE rank = 1),
u AS (SELECT r.*, s1, max(r.score) OVER (PARTITION BY id) AS top FROM r JOIN f USING (id) WHERE rank <= 10 AND dist <= 2 * d1),
p AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN s1 < 2 AND top >= 2 THEN -score ELSE 0 END, dist, place) AS k FROM u)
SELECT id, place, round(dist, 3) AS dist, score FROM p WHERE k = 1""")
def connectivity_snap(spark, d):
    near = spatial.knn_join(s.points(spark, d), s.places(spark, d), 10, _NEAR, _RES).withColumn("score", F.col("place") % 4)
    return spatial.snap_connected(near).select("id", "place", F.round("dist", 3).alias("dist"), "score")


@query(f"""
WITH {s.POINTS} SELECT id AS node, round(sqrt(pow((-72.0 - lon) * 111000.0 * cos(radians((lat + 42.0) / 2)), 2) + pow((42.0 - lat) * 111000.0, 2)), 3) AS dist
FROM points ORDER BY 2, 1 LIMIT 1""")
def nearest_node(spark, d):
    found = spatial.nearest_node(s.points(spark, d).withColumnRenamed("id", "node"), -72.0, 42.0)
    return found.select("node", F.round("dist", 3).alias("dist"))


@query(f"""
WITH {s.POINTS}, {s.PLACES}, x AS (SELECT id, kind, {s.DIST} AS dist FROM points, places),
b AS (SELECT id, min(CASE WHEN kind = 'ocean' AND dist <= 5000 THEN 0 WHEN kind = 'lake' AND dist <= 3000 THEN 1 WHEN kind = 'river' AND dist <= 2000 THEN 2 END) AS k
      FROM x GROUP BY id)
SELECT id, CASE k WHEN 0 THEN 'ocean' WHEN 1 THEN 'lake' WHEN 2 THEN 'river' ELSE 'other' END AS kind FROM b""")
def nearest_within_priority(spark, d):
    limits = [("ocean", 5000.0), ("lake", 3000.0), ("river", 2000.0)]
    return spatial.nearest_by_priority(s.points(spark, d), s.places(spark, d), limits, _RES)


@query(f"""
WITH {s.POINTS}, n AS (SELECT n_nationkey AS poly, -73.40037 + (n_nationkey % 5) * 0.6::DOUBLE AS x, 41.25043 + (n_nationkey // 5) * 0.3::DOUBLE AS y FROM nation)
SELECT id, poly FROM points, n WHERE lat > y AND lat < y + 0.2 AND lon > x + (lat - y) AND lon < x + 0.5 - (lat - y)""")
def point_in_polygon(spark, d):
    x = F.lit(-73.40037) + (F.col("n_nationkey") % 5) * 0.6
    y = F.lit(41.25043) + F.floor(F.col("n_nationkey") / 5) * 0.3
    corner = lambda a, b: F.struct((x + a).alias("x"), (y + b).alias("y"))
    ring = F.array(corner(0.0, 0.0), corner(0.5, 0.0), corner(0.3, 0.2), corner(0.2, 0.2), corner(0.0, 0.0))
    polys = table(spark, d, "nation").select(F.col("n_nationkey").alias("poly"), ring.alias("ring"))
    return spatial.points_in_polygons(s.points(spark, d), polys)


_SEGMENTS = """
sg AS (SELECT p_lon AS ax, p_lat AS ay, p_lon + 0.05 AS bx, p_lat + 0.03 AS by_ FROM places),
g AS (SELECT id, 111000.0 * cos(radians(lat)) AS k, lon, lat, ax, ay, bx, by_ FROM points, sg),
h AS (SELECT id, (ax - lon) * k AS x1, (ay - lat) * 111000.0 AS y1, (bx - ax) * k AS dx, (by_ - ay) * 111000.0 AS dy FROM g),
i AS (SELECT *, least(greatest(-(x1 * dx + y1 * dy) / (dx * dx + dy * dy), 0), 1) AS t FROM h)"""


@query(f"WITH {s.POINTS}, {s.PLACES}, {_SEGMENTS} SELECT id, bool_or(sqrt(pow(x1 + t * dx, 2) + pow(y1 + t * dy, 2)) <= 1500) AS near FROM i GROUP BY id")
def corridor_flag(spark, d):
    lines = s.places(spark, d).select(
        F.col("p_lon").alias("ax"), F.col("p_lat").alias("ay"), (F.col("p_lon") + 0.05).alias("bx"), (F.col("p_lat") + 0.03).alias("by")
    )
    return spatial.near_segments(s.points(spark, d), lines, 1500.0, _RES)


@query(f"WITH {s.POINTS} SELECT id FROM points WHERE lon BETWEEN -72.5 AND -71.0 AND lat BETWEEN 41.5 AND 42.25")
def bbox_filter(spark, d):
    return s.points(spark, d).where(geo.in_box(F.col("lon"), F.col("lat"), (-71.0, 42.25, -72.5, 41.5))).select("id")


@query("SELECT p_partkey FROM part WHERE p_type IN ('PROMO', 'SMALL') OR p_brand IN (SELECT p_brand FROM part GROUP BY p_brand HAVING count(*) >= 85)")
def allowlist_semi(spark, d):
    part = table(spark, d, "part")
    brands = part.groupBy("p_brand").count().where("count >= 85").select(F.col("p_brand").alias("b"), F.lit(True).alias("ok"))
    return part.join(brands, F.col("p_brand") == F.col("b"), "left").where(F.col("p_type").isin("PROMO", "SMALL") | F.col("ok")).select("p_partkey")


@query("SELECT DISTINCT l_partkey AS cell FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_retailprice < 1500 AND p_size <= 40)")
def hex_anti_core(spark, d):
    core = s.cells(spark, d).where("is_core and not near_power_corridor").select("cell")
    return s.times(spark, d).select("cell").distinct().join(core, "cell", "left_anti")


@query("SELECT DISTINCT l_partkey AS cell FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_retailprice < 1500)")
def hex_semi_core(spark, d):
    core = s.cells(spark, d).where("is_core").select("cell")
    return s.times(spark, d).select("cell").distinct().join(core, "cell", "left_semi")


@query("""
SELECT c_custkey AS cell, n_name AS county, r_name AS state, s.n AS suppliers FROM customer
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s ON s_nationkey = c_nationkey""")
def overlay_left_chain(spark, d):
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("cell"), F.col("c_nationkey").alias("res"))
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("res"), F.col("n_name").alias("county"), F.col("n_regionkey").alias("r"))
    region = table(spark, d, "region").select(F.col("r_regionkey").alias("r"), F.col("r_name").alias("state"))
    rich = table(spark, d, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("res")).agg(F.count(F.lit(1)).alias("suppliers"))
    out = tables.overlay(base, nation.join(F.broadcast(region), "r", "left").drop("r"), rich)
    return out.select("cell", "county", "state", "suppliers")


_KEYED = f"""
WITH {s.POIS}, k AS (SELECT *, coalesce(nullif(trim(brand_id), ''), '') AS b FROM pois),
q AS (SELECT *, row_number() OVER (PARTITION BY b, lower(trim(name)), lower(trim(category)),
        floor((lon + 180) * pow(2, CASE WHEN b <> '' THEN 21 ELSE 20 END) / 360.0), floor((lat + 90) * pow(2, CASE WHEN b <> '' THEN 21 ELSE 20 END) / 360.0),
        @EXT@ ORDER BY (b = '')::INT, CASE source WHEN 'overture' THEN 0 WHEN 'osm' THEN 1 ELSE 2 END, poi_id) AS rn FROM k)
SELECT poi_id, brand_id, source FROM q WHERE rn = 1"""


@query(_KEYED.replace("@EXT@", "CASE WHEN b <> '' THEN substr(ext_id, 1, 8) ELSE ext_id END"))
def conflate_dedupe(spark, d):
    return poi.conflate(s.pois(spark, d)).select("poi_id", "brand_id", "source")


@query(_KEYED.replace("@EXT@", "1"))
def conflate_merge_sources(spark, d):
    return poi.conflate(s.pois(spark, d), merge_sources=True).select("poi_id", "brand_id", "source")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def keep_first(spark, d):
    orders = table(spark, d, "orders")
    return tables.keep_first(orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def keep_last(spark, d):
    orders = table(spark, d, "orders")
    return tables.keep_first(orders, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_custkey", "o_orderkey")


@query("""
WITH x AS (SELECT l_suppkey AS node, CAST(l_partkey AS VARCHAR) AS poi_id, p_brand, p_type FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_extendedprice <= 16090)
SELECT node, array_to_string(list_sort(list(DISTINCT poi_id)), ',') AS poi_ids, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS brands,
       array_to_string(list_sort(list(DISTINCT p_type)), ',') AS categories FROM x GROUP BY node""")
def anchor_grouping(spark, d):
    both = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    snapped = both.select(
        F.col("l_partkey").cast("string").alias("poi_id"), F.col("l_suppkey").alias("node"), (F.col("l_extendedprice") / 10).alias("dist"),
        F.col("p_brand").alias("brand_id"), F.array("p_type").alias("categories"),
    )
    joined = [F.array_join(c, ",").alias(c) for c in ("poi_ids", "brands", "categories")]
    return poi.anchor_sites(snapped).select("node", *joined)


@query("SELECT p_name, CAST(row_number() OVER (ORDER BY p_name) - 1 AS BIGINT) AS int_id FROM (SELECT DISTINCT p_name FROM part)")
def dense_ids(spark, d):
    return tables.dense_ids(table(spark, d, "part"), "p_name", "int_id")


_VOTES = """
v AS (SELECT c_nationkey AS county, CAST(count(*) FILTER (o_orderstatus = 'O') AS BIGINT) AS dem, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS rep,
             CAST(count(*) FILTER (o_orderstatus = 'P') AS BIGINT) AS other FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)"""


def _votes(spark, d):
    both = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    votes = both.groupBy(F.col("c_nationkey").alias("county"), F.col("o_orderstatus").alias("party")).agg(F.count(F.lit(1)).alias("votes"))
    return tables.share_pivot(votes, "county", {"O": "dem", "F": "rep", "P": "other"})


@query(f"WITH {_VOTES} SELECT county, dem, rep, other, dem + rep + other AS total FROM v")
def election_pivot(spark, d):
    return _votes(spark, d)


@query(f"""
WITH {_VOTES} SELECT county, round(rep / (dem + rep), 6) AS rep_share, CAST(CASE WHEN rep / (dem + rep) < 0.2 THEN 0 WHEN rep / (dem + rep) < 0.4 THEN 1
  WHEN rep / (dem + rep) < 0.6 THEN 2 WHEN rep / (dem + rep) < 0.8 THEN 3 ELSE 4 END AS BIGINT) AS political_lean FROM v WHERE dem + rep > 0""")
def election_lean(spark, d):
    out = overlays.lean(_votes(spark, d), "dem", "rep")
    return out.select("county", F.round("rep_share", 6).alias("rep_share"), F.col("political_lean").cast("long").alias("political_lean"))


@query("""
SELECT p_partkey, CAST(CASE WHEN p_size / 50 < 0.2 THEN 0 WHEN p_size / 50 < 0.4 THEN 1 WHEN p_size / 50 < 0.6 THEN 2 WHEN p_size / 50 < 0.8 THEN 3 ELSE 4 END AS BIGINT) AS lean
FROM part""")
def lean_bucket(spark, d):
    return table(spark, d, "part").select("p_partkey", units.lean_bucket(F.col("p_size") / 50).cast("long").alias("lean"))


_MONTHLY = """
m AS (SELECT l_suppkey AS cell, month(l_shipdate) AS mon, sum(CAST(l_quantity AS BIGINT)) AS q, count(*) AS n, min(l_linenumber) AS lo FROM lineitem GROUP BY 1, 2),
w AS (SELECT cell, mon, q / n * 2.0 AS t, CAST(lo AS DOUBLE) AS p FROM m),
r AS (SELECT cell, round(avg(t), 6) AS temp_ann, round(avg(t) FILTER (mon IN (6, 7, 8)), 6) AS temp_summer, round(avg(t) FILTER (mon IN (12, 1, 2)), 6) AS temp_winter,
             round(max(t), 6) AS temp_hot, round(min(t), 6) AS temp_cold, round(sum(p), 6) AS ppt_ann, max(p) FILTER (mon = 7) AS ppt_jul, max(p) FILTER (mon = 12) AS ppt_dec
      FROM w GROUP BY cell)"""


def _climate(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("cell"), F.month("l_shipdate").alias("month"), F.col("l_quantity").cast("long").alias("q"), "l_linenumber"
    )
    each = rows.groupBy("cell", "month").agg((F.sum("q") / F.count(F.lit(1)) * 2.0).alias("t"), F.min("l_linenumber").cast("double").alias("p"))
    wide = overlays.pivot_months(each, "cell", "t", "first", "t").join(overlays.pivot_months(each, "cell", "p", "first", "p"), "cell")
    rolled = overlays.climate_rollup(wide, "cell")
    return rolled.select("cell", *[F.round(c, 6).alias(c) for c in rolled.columns[1:]])


@query(f"WITH {_MONTHLY} SELECT * FROM r")
def climate_rollup(spark, d):
    return _climate(spark, d)


@query(f"WITH {_MONTHLY} SELECT cell, CAST(round(temp_ann * 10) AS BIGINT) AS t_q, CAST(round(ppt_ann * 10) AS BIGINT) AS p_q, round(round(temp_ann * 10) * 0.1, 6) AS back FROM r")
def climate_quantize(spark, d):
    q = units.quantize(F.col("temp_ann") * 10, 1.0)
    return _climate(spark, d).select(
        "cell", q.cast("long").alias("t_q"), units.quantize(F.col("ppt_ann") * 10, 1.0, signed=False).cast("long").alias("p_q"),
        F.round(units.dequantize(q), 6).alias("back"),
    )


@query(f"""
WITH {_MONTHLY} SELECT cell, CASE WHEN temp_summer < 60 AND temp_winter < 30 THEN 'Arctic Cold' WHEN temp_summer >= 65 AND temp_winter < 32 AND ppt_ann > 20 THEN 'Cold Seasonal'
 WHEN temp_summer BETWEEN 70 AND 80 AND temp_winter BETWEEN 32 AND 45 AND ppt_ann BETWEEN 25 AND 50 THEN 'Mild Continental'
 WHEN temp_summer < 70 AND temp_winter > 35 AND ppt_ann > 35 THEN 'Cool Maritime' WHEN temp_summer > 80 AND temp_winter > 45 AND ppt_ann > 40 THEN 'Warm Humid'
 WHEN ppt_ann < 10 AND temp_summer > 80 THEN 'Hot Dry (Desert)' WHEN ppt_ann >= 10 AND ppt_ann < 20 AND temp_summer BETWEEN 75 AND 85 THEN 'Warm Semi-Arid'
 WHEN ppt_ann < 30 AND ppt_dec > ppt_jul AND temp_summer > 75 THEN 'Mediterranean Mild' WHEN temp_summer BETWEEN 60 AND 75 AND temp_winter < 35 THEN 'Mountain Mixed'
 ELSE 'Unclassified' END AS climate_label FROM (SELECT cell, temp_summer + mod(cell, 40) AS temp_summer, temp_winter - mod(cell, 30) AS temp_winter,
   ppt_ann * (1 + mod(cell, 5)) AS ppt_ann, ppt_jul, ppt_dec FROM r)""")
def climate_label(spark, d):
    cell = F.col("cell")
    moved = _climate(spark, d).withColumns(
        {"temp_summer": F.col("temp_summer") + cell % 40, "temp_winter": F.col("temp_winter") - cell % 30, "ppt_ann": F.col("ppt_ann") * (1 + cell % 5)}
    )
    return overlays.with_label(moved).select("cell", "climate_label")


@query(f"""
WITH {s.POINTS} SELECT CAST({_RES} AS BIGINT) * pow(2, 56)::BIGINT + CAST(floor((lon + 180) * 2048 / 360.0) AS BIGINT) * pow(2, 28)::BIGINT + CAST(floor((lat + 90) * 2048 / 360.0) AS BIGINT) AS cell,
  count(*) AS n, round(avg(c_nationkey), 6) AS mean FROM points JOIN customer ON c_custkey = id WHERE c_nationkey <> 0 GROUP BY 1""")
def zonal_mean(spark, d):
    nation = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.nullif(F.col("c_nationkey"), F.lit(0)).alias("value"))
    out = spatial.zonal_mean(s.points(spark, d).join(nation, "id"), _RES)
    return out.select("cell", "n", F.round("mean", 6).alias("mean"))


@query("""
SELECT p_brand, p_type, n FROM (SELECT p_brand, p_type, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS k FROM part GROUP BY 1, 2) WHERE k = 1""")
def category_mode_label(spark, d):
    return tables.mode_label(table(spark, d, "part"), "p_brand", "p_type")


@query("SELECT p_type AS category, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS brands FROM part GROUP BY 1")
def catalog_brand_sets(spark, d):
    pois = table(spark, d, "part").select(F.col("p_type").alias("category"), F.col("p_brand").alias("brand_id"))
    return catalog.catalog(pois).withColumn("brands", F.array_join("brands", ","))


@query(f"WITH {s.LEGS} SELECT DISTINCT entity, entity AS label FROM legs")
def list_categories(spark, d):
    return catalog.list_categories(_legs(spark, d))


@query(f"WITH {s.LEGS} SELECT entity, round(quantile_cont(seconds, 0.5), 6) AS p50, round(quantile_cont(seconds, 0.95), 6) AS p95 FROM legs WHERE seconds < 65535 GROUP BY entity")
def percentiles_p50_p95(spark, d):
    out = checks.percentiles(_legs(spark, d), "entity", "seconds")
    return out.select("entity", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


_SENT = "CASE WHEN p_size > 49 THEN 65535 ELSE p_size * 60 END"


@query(f"SELECT count(*) AS n, count(*) FILTER ({_SENT} = 65535) AS n_sentinel, round(count(*) FILTER ({_SENT} = 65535) / count(*), 6) AS share FROM part")
def sentinel_ratio(spark, d):
    seconds = table(spark, d, "part").select(F.when(F.col("p_size") > 49, units.UNREACHABLE).otherwise(F.col("p_size") * 60).alias("seconds"))
    return checks.sentinel_share(seconds, "seconds").withColumn("share", F.round("share", 6))


@query(f"""
WITH {s.TIMES}, p AS (SELECT cell // 4 AS parent, anchor, avg(t) - 600 AS t FROM times GROUP BY 1, 2), c AS (SELECT cell // 4 AS parent, anchor, min(t) AS child_t FROM times GROUP BY 1, 2)
SELECT parent, anchor, round(t, 6) AS t, child_t FROM p JOIN c USING (parent, anchor) WHERE t < child_t""")
def cross_res_invariant(spark, d):
    fine = checks.dealt_by_parent(s.times(spark, d).select(F.floor(F.col("cell") / 4).alias("parent"), "anchor", "t"))
    coarse = fine.groupBy("parent", "anchor").agg((F.avg("t") - 600).alias("t"))
    return checks.faster_parents(coarse, fine).select("parent", "anchor", F.round("t", 6).alias("t"), "child_t")


@query("SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def orphan_refs(spark, d):
    valid = table(spark, d, "supplier").where("s_acctbal > 0")
    return checks.orphans(table(spark, d, "lineitem"), "l_suppkey", valid, "s_suppkey").select("l_orderkey", "l_linenumber", "l_suppkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return checks.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


_PARENT = "CAST({r} AS BIGINT) * pow(2, 56)::BIGINT + CAST(floor((lon + 180) * {n} / 360.0) AS BIGINT) * pow(2, 28)::BIGINT + CAST(floor((lat + 90) * {n} / 360.0) AS BIGINT)"


@query(f"WITH {s.POINTS} SELECT id, {_PARENT.format(r=9, n=8192)} AS cell, {_PARENT.format(r=7, n=2048)} AS parent FROM points")
def parent_cell(spark, d):
    cell = geo.cell_of(F.col("lon"), F.col("lat"), 9)
    return s.points(spark, d).select("id", cell.alias("cell")).withColumn("parent", geo.parent_cell(F.col("cell"), 2))


@query("""
SELECT p_partkey, (((613196570357137407 + p_partkey) & ~(15::BIGINT << 52)) | (7::BIGINT << 52)) | ((1::BIGINT << 24) - 1) AS parent, lower(hex(613196570357137407 + p_partkey)) AS h FROM part""")
def h3_parent(spark, d):
    cell = F.lit(613196570357137407) + F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", geo.h3_parent(cell, 7).alias("parent"), geo.h3_string(cell).alias("h"))


def _orders(spark, d, sql, name="x"):
    return table(spark, d, "orders").select("o_orderkey", F.expr(sql).alias(name))


@query(f"""
WITH x AS (SELECT o_orderkey, {s.SPEED} AS x FROM orders), y AS (SELECT o_orderkey, x, list_min(list_transform(regexp_extract_all(x, '(\\d+(?:\\.\\d+)?)', 1), lambda v: v::DOUBLE)) AS m FROM x)
SELECT o_orderkey, round(nullif(CASE WHEN x LIKE '%mph%' THEN m * 1.60934 ELSE m END, 0), 6) AS kmh FROM y""")
def maxspeed_parse(spark, d):
    return _orders(spark, d, s.SPEED).select("o_orderkey", F.round(text.maxspeed_kmh(F.col("x")), 6).alias("kmh"))


@query(f"""
SELECT o_orderkey, CASE {s.HIGHWAY} WHEN 'motorway_link' THEN 100.0::DOUBLE WHEN 'Primary' THEN 65.0 WHEN 'residential' THEN 25.0 WHEN 'service' THEN 15.0 WHEN 'tertiary' THEN 45.0 ELSE 40.0 END AS kmh
FROM orders""")
def highway_speed(spark, d):
    return _orders(spark, d, s.HIGHWAY).select("o_orderkey", text.highway_kmh(F.col("x")).alias("kmh"))


@query("""
SELECT o_orderkey, CAST(least(ceil(coalesce(nullif(o_totalprice, 0), 20.0) / greatest(greatest((o_orderkey % 90)::DOUBLE, 1.0) / 3.6, 0.1)), 65534) AS BIGINT) AS drive,
  CAST(least(ceil(o_totalprice / (5.0::DOUBLE / 3.6)), 65534) AS BIGINT) AS walk FROM orders""")
def edge_seconds(spark, d):
    length = F.nullif(F.col("o_totalprice"), F.lit(0.0))
    drive = units.drive_seconds(length, (F.col("o_orderkey") % 90).cast("double"))
    return table(spark, d, "orders").select("o_orderkey", drive.cast("long").alias("drive"), units.walk_seconds(length).cast("long").alias("walk"))


_ONEWAY = "CASE o_orderkey % 6 WHEN 0 THEN 'yes' WHEN 1 THEN 'True' WHEN 2 THEN '1' WHEN 3 THEN '-1' WHEN 4 THEN 'no' END"


@query(f"SELECT o_orderkey, coalesce(lower({_ONEWAY}) IN ('yes', 'true', '1'), false) AS oneway FROM orders")
def oneway_norm(spark, d):
    return _orders(spark, d, _ONEWAY).select("o_orderkey", text.oneway(F.col("x")).alias("oneway"))


@query(f"""
WITH x AS (SELECT o_orderkey, CASE {s.VOLTS} WHEN '230000' THEN '230000' WHEN '345 kV' THEN '345000' WHEN '115;230' THEN '115000,230000' WHEN '69' THEN '69000'
  WHEN '110000,13800' THEN '110000,13800' ELSE '' END AS volts FROM orders)
SELECT o_orderkey, volts, volts NOT IN ('', '69000') AS high FROM x""")
def voltage_parse(spark, d):
    shown = F.array_join(F.transform(text.voltages(F.col("x")), lambda v: v.cast("long").cast("string")), ",")
    return _orders(spark, d, s.VOLTS).select("o_orderkey", shown.alias("volts"), text.high_voltage(F.col("x")).alias("high"))


@query("""SELECT event_id, event_type AS kind, CASE WHEN event_id % 3 = 0 THEN CAST(user_id AS VARCHAR) END AS volt FROM events""")
def hstore_tag(spark, d):
    tags = F.concat(F.lit('"power"=>"'), "event_type", F.lit('"'), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(',"voltage"=>"'), "user_id", F.lit('"'))).otherwise(""))
    rows = table(spark, d, "events").select("event_id", tags.alias("tags"))
    return rows.select("event_id", text.hstore(F.col("tags"), "power").alias("kind"), text.hstore(F.col("tags"), "voltage").alias("volt"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN lower(p_brand) WHEN p_size % 3 = 1 THEN 'x' || p_type END AS brand_id FROM part""")
def brand_resolve(spark, d):
    part = table(spark, d, "part")
    brands = part.select("p_brand").distinct().select(F.lower("p_brand").alias("brand_id"), F.col("p_brand").alias("canonical"), F.lit(None).cast("string").alias("aliases"))
    kinds = part.select("p_type").distinct().select(F.concat(F.lit("x"), "p_type").alias("brand_id"), F.lit("?").alias("canonical"), F.concat("p_type", F.lit("|alt "), "p_type").alias("aliases"))
    rows = part.select(
        "p_partkey", F.when(F.col("p_size") % 3 == 0, F.upper("p_brand")).alias("brand"), F.when(F.col("p_size") % 3 == 1, F.concat(F.lit("Alt "), F.lower("p_type"))).alias("operator")
    )
    return poi.resolve_brand(rows, poi.alias_table(brands.unionByName(kinds)), ["brand", "operator"]).select("p_partkey", "brand_id")


_RAW = "CASE p_size % 5 WHEN 0 THEN 'hospital' WHEN 1 THEN 'airport' WHEN 2 THEN 'place_of_worship' WHEN 3 THEN 'park' ELSE 'other' END"
_FAITH = "CASE p_partkey % 5 WHEN 0 THEN 'Muslim' WHEN 1 THEN 'sikh' WHEN 2 THEN 'unknown' WHEN 3 THEN '' END"
_RAW_CASE = _RAW.replace("'place_of_worship'", "CASE WHEN p_partkey % 2 = 0 THEN 'Place_of_Worship' ELSE 'place_of_worship' END")


@query(f"""
WITH x AS (SELECT p_partkey, {_RAW} AS c, {_FAITH} AS f, p_partkey % 3 = 0 AS named FROM part),
y AS (SELECT p_partkey,
  CASE WHEN c = 'place_of_worship' THEN CASE f WHEN 'Muslim' THEN 'mosque' WHEN 'sikh' THEN 'temple' WHEN 'unknown' THEN '-' ELSE 'church' END
       WHEN c = 'hospital' AND named THEN 'hospital' WHEN c = 'hospital' THEN 'clinic' WHEN c = 'other' THEN NULL ELSE c END AS subcat,
  CASE c WHEN 'place_of_worship' THEN 'religious' WHEN 'hospital' THEN 'health' WHEN 'park' THEN 'recreation' END AS class, c FROM x)
SELECT p_partkey, class, CASE WHEN c = 'place_of_worship' THEN 'place_of_worship_' || subcat ELSE subcat END AS category, subcat
FROM y WHERE coalesce(subcat, '') NOT IN ('airport', '-')""")
def category_map(spark, d):
    mapping = spark.createDataFrame(
        [
            ("hospital", "health", "hospital", "hospital"),
            ("airport", "transport", "airport", "airport"),
            ("place_of_worship", "religious", "place_of_worship_church", "church"),
            ("Place_of_Worship", "religious", "place_of_worship_church", "church"),
            ("park", "recreation", "park", "park"),
        ],
        "primary string, class string, category string, subcat string",
    )
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" General Hospital"))).otherwise(F.col("p_name"))
    rows = table(spark, d, "part").select("p_partkey", name.alias("name"), F.expr(_RAW_CASE).alias("primary"), F.expr(_FAITH).alias("religion"))
    return poi.map_categories(rows, mapping).select("p_partkey", "class", "category", "subcat")


_NAME = "p_name || CASE p_partkey % 4 WHEN 0 THEN ' General Hospital' WHEN 1 THEN ' Medical Center' WHEN 2 THEN ' Hospital Urgent Care' ELSE '' END"


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 4 IN (0, 1) THEN 'hospital' ELSE 'clinic' END AS category FROM part")
def hospital_reclass(spark, d):
    return table(spark, d, "part").select("p_partkey", poi.hospital_or_clinic(F.lit("hospital"), F.expr(_NAME)).alias("category"))


@query("""
WITH h AS (SELECT p_partkey, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('drive|' || p_partkey)) AS x FROM part)
SELECT p_partkey, substr(x, 1, 8) || '-' || substr(x, 9, 4) || '-5' || substr(x, 14, 3) || '-' || substr('89ab', 1 + (strpos('0123456789abcdef', substr(x, 17, 1)) - 1) % 4, 1)
       || substr(x, 18, 3) || '-' || substr(x, 21, 12) AS site_id FROM h""")
def uuid5_ids(spark, d):
    return table(spark, d, "part").select("p_partkey", ids.uuid5(F.concat(F.lit("drive|"), F.col("p_partkey").cast("string"))).alias("site_id"))


@query("SELECT p_partkey, regexp_replace(substr(sha1(p_name || '|' || p_partkey), 1, 32), '(.{8})(.{4})(.{4})(.{4})(.{12})', '\\1-\\2-\\3-\\4-\\5') AS id FROM part")
def stable_sha1_id(spark, d):
    return table(spark, d, "part").select("p_partkey", ids.sha1_id(F.col("p_name"), F.col("p_partkey").cast("string")).alias("id"))


@query("SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN '  ' ELSE trim(c_mktsegment) END, '  '), c_name) AS label FROM customer")
def coalesce_text(spark, d):
    first = F.when(F.col("c_custkey") % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", text.coalesce_text(first, F.col("c_name")).alias("label"))


@query("SELECT c_custkey, lpad(CAST(c_custkey % 90000 AS VARCHAR), 5, '0') AS fips FROM customer")
def fips_clean(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.clean_fips((F.col("c_custkey") % 90000).cast("double").cast("string")).alias("fips"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query()
def geojson_features(spark, d):
    cells = s.points(spark, d).select(geo.cell_of(F.col("lon"), F.col("lat"), 9).alias("cell"), F.col("id"))
    return catalog.geojson_lines(cells)


@query(f"WITH {s.POIS} SELECT poi_id FROM pois WHERE (brand_id IN ('brand#1', 'brand#2') OR category = 'promo') AND lon BETWEEN -73.5 AND -73.48 AND lat BETWEEN 41.2 AND 41.22")
def poi_points_filter(spark, d):
    pois = s.pois(spark, d).withColumn("subcat", F.lit(None).cast("string"))
    return catalog.poi_points(pois, ["brand#1", "brand#2"], "promo", (-73.48, 41.22, -73.5, 41.2)).select("poi_id")


@query()
def fingerprint(spark, d):
    return tables.fingerprint(table(spark, d, "part"), ["p_partkey", "p_name", "p_brand", "p_retailprice"])


@query(f"""
WITH {s.RANKED}, {s.LEGS}, c AS (SELECT cell, entity, min(t + seconds) AS actual FROM ranked JOIN legs USING (anchor) GROUP BY 1, 2),
e AS (SELECT p_partkey AS cell, p_brand AS entity, p_size * 12 AS expected, 120 AS tolerance FROM part)
SELECT cell, entity, expected, actual, actual - expected AS delta, coalesce(abs(actual - expected) <= tolerance, false) AS ok FROM e LEFT JOIN c USING (cell, entity)""")
def golden_check(spark, d):
    expected = table(spark, d, "part").select(F.col("p_partkey").alias("cell"), F.col("p_brand").alias("entity"), (F.col("p_size") * 12).alias("expected"), F.lit(120).alias("tolerance"))
    computed = times.compose_pairs(_ranked(spark, d), _legs(spark, d), expected).withColumnRenamed("total", "actual")
    return checks.golden(expected, computed, ["cell", "entity"]).select("cell", "entity", "expected", "actual", "delta", "ok")


@query("""
WITH l AS (SELECT o_custkey AS path, sum(CAST(o_totalprice AS BIGINT)) FILTER (o_orderstatus = 'F') AS old_size, sum(CAST(o_totalprice AS BIGINT)) AS new_size,
  date_diff('day', max(o_orderdate)::DATE, DATE '2001-01-01') AS age_days FROM orders GROUP BY 1),
m AS (SELECT path, coalesce(abs(new_size - old_size) / nullif(old_size, 0) > 0.25, false) AS resized, age_days > 7 AS stale FROM l)
SELECT path, resized, stale FROM m WHERE resized OR stale""")
def ledger_size_anomaly(spark, d):
    price = F.round("o_totalprice").cast("long")
    ledger = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("path")).agg(
        F.sum(F.when(F.col("o_orderstatus") == "F", price)).alias("old_size"),
        F.sum(price).alias("new_size"),
        F.datediff(F.lit("2001-01-01").cast("date"), F.max("o_orderdate").cast("date")).alias("age_days"),
    )
    return checks.size_anomalies(ledger).select("path", "resized", "stale")


@query("SELECT n_name AS name, n_regionkey AS region, NULL::VARCHAR AS segment FROM nation UNION ALL SELECT c_name, NULL, c_mktsegment FROM customer")
def union_by_name(spark, d):
    one = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    two = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return one.unionByName(two, allowMissingColumns=True)


@query("SELECT p_partkey AS id FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def except_ids(spark, d):
    sold = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("id"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id")).subtract(sold)


@query("SELECT c_nationkey AS id FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0")
def intersect_coverage(spark, d):
    poor = table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("id"))
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("id")).intersect(poor)


@query(ORACLES["livable_flagship"].replace("SELECT cell FROM cells JOIN ok", ", vis AS (SELECT cell FROM cells JOIN ok") + """)
SELECT count(v.cell) AS visible, count(*) AS baseline, CAST(least(greatest(round(100.0 * count(v.cell) / greatest(count(*), 1)), 0), 100) AS BIGINT) AS percent
FROM cells LEFT JOIN vis v USING (cell) WHERE is_core""")
def livable_percentage(spark, d):
    out = livable_percent(s.cells(spark, d), livable_flagship(spark, d))
    return out.withColumn("percent", F.col("percent").cast("long"))


@query("SELECT l_partkey AS cell FROM lineitem UNION SELECT p_partkey FROM part WHERE p_size < 10")
def union_distinct_cells(spark, d):
    small = table(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("cell"))
    return s.times(spark, d).select("cell").union(small).distinct()


@query(f"""
WITH {s.RANKED}, {s.LEGS} SELECT cell, entity, CAST(round(min(t + seconds) / 60) AS BIGINT) AS minutes FROM ranked JOIN legs USING (anchor)
WHERE entity IN ('Brand#1', 'Brand#2') GROUP BY cell, entity""")
def explain_hex(spark, d):
    out = explain_cells(_ranked(spark, d), _legs(spark, d), ["Brand#1", "Brand#2"])
    return out.withColumn("minutes", F.col("minutes").cast("long"))


@query(f"""{_LABELS.replace(s.ANCHORS, "anchors AS (SELECT CAST(1 AS BIGINT) AS node)").replace("lab.node = edges.u", "lab.node = edges.v").replace("edges.v AS v", "edges.u AS v")}
SELECT p_partkey AS anchor, CAST(least(coalesce(d, 65535), 65535) AS BIGINT) AS seconds FROM part LEFT JOIN lab ON node = p_partkey WHERE p_size = 50""")
def d_anchor_custom(spark, d):
    places = table(spark, d, "part").select(F.col("p_partkey").alias("node"), (F.col("p_partkey") / 100.0).alias("lon"), F.lit(42.0).alias("lat"))
    out = catalog.d_anchor_custom(s.edges(spark, d), places, s.anchors(spark, d), 0.0104, 42.0, CUTOFF)
    return out.select("anchor", F.col("seconds").cast("long").alias("seconds"))


@query(f"WITH {s.LEGS} SELECT anchor, seconds FROM legs WHERE entity = 'Brand#5'")
def d_anchor_lookup(spark, d):
    registry = table(spark, d, "part").select("p_brand").distinct().select(
        F.col("p_brand").alias("category_id"), F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("int").alias("numeric_id"), F.lower("p_brand").alias("display_name")
    )
    return catalog.d_anchor(_legs(spark, d), registry, "5")


@query("""
SELECT p_partkey, array_to_string(list_sort(list_distinct(CASE WHEN p_size % 3 = 0 THEN ['hospital', p_type, 'trauma_level_1_adult'] WHEN p_size % 3 = 1 THEN ['hospital', p_type, 'trauma_level_1_pediatric'] ELSE [p_type] END)), ',') AS categories
FROM part""")
def expand_categories(spark, d):
    sub = F.when(F.col("p_size") % 3 == 0, F.lit(" Trauma_Level_1_Adult"))
    level = F.when(F.col("p_size") % 3 == 1, F.lit("peds"))
    return table(spark, d, "part").select("p_partkey", F.array_join(poi.expand_categories(F.col("p_type"), sub, level), ",").alias("categories"))


@query("""
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(user_id * 1000 AS DOUBLE) END AS rate FROM events""")
def rate_text(spark, d):
    shown = F.concat(F.format_number(F.col("user_id") * 1000, 0), F.when(F.col("event_id") % 2 == 0, F.lit(" per 100k")).otherwise(F.lit(" total")))
    return table(spark, d, "events").select("event_id", text.rate_per(shown).alias("rate"))


@query(f"WITH {_MONTHLY} SELECT 'temp_ann' AS \"column\", min(temp_ann) AS low, max(temp_ann) AS high, min(temp_ann) < -70 OR max(temp_ann) > 130 AS bad FROM r UNION ALL SELECT 'ppt_ann', min(ppt_ann), max(ppt_ann), min(ppt_ann) < 0 FROM r")
def climate_ranges(spark, d):
    return checks.climate_violations(_climate(spark, d), ["temp_ann"], ["ppt_ann"])


@query("SELECT l_suppkey AS cell, CAST(min(l_quantity) * 60 AS BIGINT) AS least, CASE WHEN min(l_quantity) * 60 <= 600 THEN 10 WHEN min(l_quantity) * 60 <= 1200 THEN 20 WHEN min(l_quantity) * 60 <= 1800 THEN 30 ELSE 60 END AS bucket FROM lineitem GROUP BY l_suppkey")
def minute_buckets(spark, d):
    least = s.times(spark, d).groupBy(F.col("anchor").alias("cell")).agg(F.min("t").alias("least"))
    return least.withColumn("bucket", units.minute_bucket(F.col("least")))


@query(ORACLES["kbest_multisource"])
def kbest_by_part(spark, d):
    return graph.kbest_by_part(s.edges(spark, d), s.anchors(spark, d), K, CUTOFF, parts=8)


_SITES = "sites AS (SELECT p_partkey AS anchor, p_type AS entity FROM part WHERE p_size >= 46)"


def _sites(spark, d):
    own = table(spark, d, "part").where("p_size >= 46")
    return own.select(F.col("p_partkey").alias("anchor"), F.col("p_partkey").alias("node"), F.array("p_type").alias("categories"))


@query(f"""
WITH RECURSIVE {s.EDGES}, {_SITES},
lab(node, entity, d) USING KEY (node, entity) AS (
  SELECT anchor, entity, CAST(0 AS BIGINT) FROM sites
  UNION
  SELECT n.u, n.entity, min(n.nd) FROM (
    SELECT edges.u AS u, lab.entity AS entity, lab.d + edges.w AS nd FROM lab JOIN edges ON lab.node = edges.v
  ) n LEFT JOIN recurring.lab r ON r.node = n.u AND r.entity = n.entity
  WHERE n.nd <= CASE WHEN n.entity = 'PROMO' THEN 120 ELSE 300 END AND (r.d IS NULL OR n.nd < r.d) GROUP BY n.u, n.entity)
SELECT DISTINCT anchor, lab.entity, d AS seconds FROM lab JOIN (SELECT DISTINCT anchor FROM sites) ON node = anchor""")
def d_anchor_batch(spark, d):
    sites = _sites(spark, d)
    minutes = F.when(F.col("entity") == "PROMO", 2).otherwise(5)
    targets = anchors.target_entities(sites, sites.select(F.explode("categories").alias("entity"))).withColumn("max_minutes", minutes)
    return anchors.d_anchor_batch(s.edges(spark, d), sites, targets, parts=8)


_LISTED = "listed AS (SELECT p_partkey AS anchor, unnest([p_type, split_part(p_name, ' ', 2), ' ', NULL]) AS entity FROM part)"


def _listed(spark, d):
    second = F.get(F.split("p_name", " "), F.lit(1))
    return table(spark, d, "part").select(F.col("p_partkey").alias("anchor"), F.array("p_type", second, F.lit(" "), F.lit(None).cast("string")).alias("categories"))


@query(f"WITH {_LISTED} SELECT entity, count(*) AS n FROM listed WHERE trim(entity) <> '' GROUP BY entity")
def entity_counts(spark, d):
    return anchors.entity_counts(_listed(spark, d))


@query(f"WITH {_LISTED} SELECT entity, count(*) AS n FROM listed WHERE entity IN ('PROMO', 'SMALL', 'widget', 'nowhere') GROUP BY entity HAVING count(*) >= 30")
def target_entities(spark, d):
    registry = spark.createDataFrame([("PROMO",), ("SMALL",), ("widget",), ("nowhere",)], "entity string")
    return anchors.target_entities(_listed(spark, d), registry, min_sites=30)


@query(f"WITH {s.POINTS} SELECT o_orderkey AS anchor, lon, lat FROM orders LEFT JOIN (SELECT * FROM points WHERE id % 3 > 0) ON id = o_custkey")
def sites_with_coordinates(spark, d):
    sites = table(spark, d, "orders").select(F.col("o_orderkey").alias("anchor"), F.col("o_custkey").alias("node"))
    return anchors.with_coordinates(sites, s.points(spark, d).where("id % 3 > 0").withColumnRenamed("id", "node")).select("anchor", "lon", "lat")


@query(f"""
WITH {s.LEGS}, x AS (SELECT anchor, entity FROM legs WHERE seconds < 90),
c AS (SELECT entity, n_name AS label, count(*) AS n FROM x JOIN supplier ON s_suppkey = anchor JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n DESC, label) AS k FROM c)
SELECT entity, 'Nation ' || substr(label, 8) AS label FROM r WHERE k = 1""")
def infer_labels(spark, d):
    sites = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return anchors.infer_labels(_legs(spark, d).where("seconds < 90"), sites.select(F.col("s_suppkey").alias("anchor"), F.array("n_name").alias("categories")))


@query("SELECT o_orderkey, o_totalprice, true AS has_more FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def page_has_more(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return tables.page(orders, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 10)


@query("""
WITH a AS (SELECT s_nationkey AS k, s_suppkey AS id FROM supplier WHERE s_acctbal > 5000), b AS (SELECT c_nationkey AS k, c_custkey AS id FROM customer)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE k NOT IN (SELECT k FROM a)""")
def preference_union(spark, d):
    first = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("id"))
    second = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("id"))
    return tables.prefer_by_key(["k"], first, second)


@query("SELECT c_custkey AS id FROM customer")
def preference_fallback(spark, d):
    none = table(spark, d, "supplier").where("s_suppkey < 0").select(F.col("s_suppkey").alias("id"))
    return tables.prefer(none, table(spark, d, "customer").select(F.col("c_custkey").alias("id")))


@query(f"WITH {s.POINTS} SELECT id FROM points WHERE pow((lon + 72.0) * cos(radians(42.0)) * 111000.0, 2) + pow((lat - 42.0) * 111000.0, 2) <= pow(20 * 1500.0 * 1.4, 2)")
def radius_prefilter(spark, d):
    return s.points(spark, d).where(geo.approx_reach(F.col("lon"), F.col("lat"), -72.0, 42.0, 20)).select("id")


@query("""
WITH b AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN lower(p_brand) ELSE p_brand END AS label FROM part)
SELECT label, row_number() OVER (ORDER BY lower(label), label) AS place FROM b""")
def brands_by_locale(spark, d):
    labels = table(spark, d, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.lower("p_brand")).otherwise(F.col("p_brand")).alias("label")).distinct()
    order = Window.orderBy(F.collate("label", "UNICODE_CI"), "label")  # a catalogue's few labels
    return labels.withColumn("place", F.row_number().over(order).cast("long"))


@query("SELECT event_type, round(avg(user_id + 0.5), 6) AS usr, round(avg(value), 6) AS idle FROM events WHERE event_id % 3 > 0 GROUP BY event_type")
def telemetry_means(spark, d):
    shown = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("[telemetry][cpu] usr="), F.col("user_id") + 0.5, F.lit("% sys=1.5% idle="), F.format_string("%.2f", "value")))
    lines = table(spark, d, "events").select("event_type", F.coalesce(shown, F.lit("starting")).alias("line")).where(F.col("line").contains("[telemetry][cpu]"))
    mean = lambda key: F.round(F.avg(text.sample_value(F.col("line"), key)), 6).alias(key)
    return lines.groupBy("event_type").agg(mean("usr"), mean("idle"))


@query("""
WITH m AS (SELECT l_suppkey AS id, CAST(avg(l_quantity) FILTER (l_linenumber = 1) AS DOUBLE) AS a, CAST(avg(l_quantity) FILTER (l_linenumber = 2) AS DOUBLE) AS b,
                  CAST(avg(l_quantity) FILTER (l_linenumber = 3) AS DOUBLE) AS c FROM lineitem GROUP BY 1),
x AS (SELECT *, least(a, b, c) AS lo, greatest(a, b, c) AS hi FROM m)
SELECT id, round((a - lo) / (hi - lo), 6) AS first, round((c - lo) / (hi - lo), 6) AS last FROM x WHERE hi > lo""")
def sparkline(spark, d):
    mean = lambda n: F.avg(F.when(F.col("l_linenumber") == n, F.col("l_quantity")))
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.array(mean(1), mean(2), mean(3)).alias("v"))
    scaled = rows.where(F.array_max("v") > F.array_min("v")).select("id", units.sparkline(F.col("v")).alias("x"))
    return scaled.select("id", F.round(F.get("x", F.lit(0)), 6).alias("first"), F.round(F.get("x", F.lit(2)), 6).alias("last"))


@query("SELECT p_partkey, round_even(CAST(p_partkey * 0.5 + 0.25 AS DOUBLE), 1) AS a, round_even(CAST(p_size + 0.5 AS DOUBLE), 0) AS b FROM part")
def half_even_rounding(spark, d):
    rows = table(spark, d, "part")
    return rows.select("p_partkey", units.half_even(F.col("p_partkey") * 0.5 + 0.25, 1).alias("a"), units.half_even(F.col("p_size") + 0.5, 0).alias("b"))


_POLYS = "n AS (SELECT n_nationkey AS poly, -73.40037 + (n_nationkey % 5) * 0.6::DOUBLE AS x, 41.25043 + (n_nationkey // 5) * 0.3::DOUBLE AS y FROM nation)"
_FILLED = f"""{_POLYS},
c AS (SELECT poly, x, y, unnest(range(floor((x + 180) * 8192 / 360)::BIGINT, floor((x + 180.5) * 8192 / 360)::BIGINT + 1)) AS i FROM n),
k AS (SELECT *, unnest(range(floor((y + 90) * 8192 / 360)::BIGINT, floor((y + 90.2) * 8192 / 360)::BIGINT + 1)) AS j FROM c),
e AS (SELECT poly, x, y, 9 * 72057594037927936 + i * 268435456 + j AS cell, (i + 0.5::DOUBLE) * 360 / 8192 - 180 AS lon, (j + 0.5::DOUBLE) * 360 / 8192 - 90 AS lat FROM k),
filled AS (SELECT poly, cell FROM e WHERE lat > y AND lat < y + 0.2 AND lon > x + (lat - y) AND lon < x + 0.5 - (lat - y))"""


def _polygons(spark, d):
    x = F.lit(-73.40037) + (F.col("n_nationkey") % 5) * 0.6
    y = F.lit(41.25043) + F.floor(F.col("n_nationkey") / 5) * 0.3
    corner = lambda a, b: F.struct((x + a).alias("x"), (y + b).alias("y"))
    ring = F.array(corner(0.0, 0.0), corner(0.5, 0.0), corner(0.3, 0.2), corner(0.2, 0.2), corner(0.0, 0.0))
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("poly"), ring.alias("ring"))


@query(f"WITH {_FILLED} SELECT poly, cell FROM filled")
def polyfill_cells(spark, d):
    return spatial.polyfill_cells(_polygons(spark, d), 9)


@query(f"WITH {_FILLED} SELECT DISTINCT cell FROM filled")
def dissolve_cells(spark, d):
    twice = spatial.polyfill_cells(_polygons(spark, d), 9)
    return spatial.dissolve(twice.unionByName(twice.withColumn("poly", F.col("poly") + 100)))


_GRID = """
points AS (SELECT 8 * 72057594037927936 + i * 268435456 + j AS id, (i + 0.5::DOUBLE) * 360 / 4096 - 180 AS lon, (j + 0.5::DOUBLE) * 360 / 4096 - 90 AS lat
           FROM range(1205, 1262) a(i), range(1490, 1520) b(j))"""
_CORRIDOR = f"{_GRID}, {s.PLACES}, {_SEGMENTS}, corridor AS (SELECT DISTINCT id AS cell FROM i WHERE sqrt(pow(x1 + t * dx, 2) + pow(y1 + t * dy, 2)) <= 5000)"


def _corridor(spark, d):
    lines = s.places(spark, d).select(
        F.col("p_lon").alias("ax"), F.col("p_lat").alias("ay"), (F.col("p_lon") + 0.05).alias("bx"), (F.col("p_lat") + 0.03).alias("by")
    )
    return spatial.corridor_cells(lines, 5000.0, 8)


@query(f"WITH {_CORRIDOR} SELECT cell FROM corridor")
def dissolve_corridors(spark, d):
    return _corridor(spark, d)


@query(f"WITH {_CORRIDOR} SELECT points.id AS cell, corridor.cell IS NOT NULL AS near_power_corridor FROM points LEFT JOIN corridor ON corridor.cell = points.id WHERE points.id % 3 = 0")
def corridor_membership(spark, d):
    cells = spark.range(1205, 1262).crossJoin(spark.range(1490, 1520).withColumnRenamed("id", "j")).select(geo.pack_cell(F.col("id"), F.col("j"), 8).alias("cell"))
    return spatial.flag_cells(cells.where("cell % 3 = 0"), _corridor(spark, d), "near_power_corridor")


@query(f"""
WITH {s.POINTS}, {s.PLACES}, x AS (SELECT id, place, {s.DIST} AS dist FROM points, places),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, place) AS rank FROM x)
SELECT id, place, round(dist, 3) AS dist, rank FROM r WHERE rank <= 3""")
def knn_any(spark, d):
    near = spatial.knn_any(s.points(spark, d), s.places(spark, d), 3, 4000.0, 9)
    return near.select("id", "place", F.round("dist", 3).alias("dist"), F.col("rank").cast("long").alias("rank"))


@query("SELECT DISTINCT l_partkey AS cell FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)")
def hex_outside_core(spark, d):
    core = table(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("cell"))
    return s.times(spark, d).select("cell").distinct().join(core, "cell", "left_anti")


@query("SELECT p_partkey AS id FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity = 7")
def except_some(spark, d):
    sold = table(spark, d, "lineitem").where("l_quantity = 7").select(F.col("l_partkey").alias("id"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id")).subtract(sold)


@query("""
WITH e AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 2020 ELSE 2024 END AS year, lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS fips,
                  CASE WHEN c_custkey % 5 = 0 THEN 'US SENATE' ELSE 'US PRESIDENT' END AS office,
                  CASE c_custkey % 4 WHEN 0 THEN 'DEMOCRAT' WHEN 1 THEN 'REPUBLICAN' WHEN 2 THEN 'DEMOCRAT' ELSE 'OTHER' END AS party FROM customer),
v AS (SELECT fips, count(*) FILTER (party = 'DEMOCRAT') * 10 AS dem_votes, count(*) FILTER (party = 'REPUBLICAN') * 10 AS rep_votes FROM e
      WHERE year = 2024 AND office = 'US PRESIDENT' AND party <> 'OTHER' GROUP BY fips)
SELECT n_name AS county, dem_votes, rep_votes, round(rep_votes / (dem_votes + rep_votes), 6) AS rep_share FROM nation JOIN v ON fips = lpad(CAST(n_nationkey AS VARCHAR), 5, '0')""")
def election_overlay(spark, d):
    key = F.col("c_custkey")
    results = table(spark, d, "customer").select(
        F.when(key % 3 == 0, 2020).otherwise(2024).alias("year"),
        F.concat(F.col("c_nationkey").cast("string"), F.lit(".0")).alias("county_fips"),
        F.when(key % 5 == 0, "US SENATE").otherwise("US PRESIDENT").alias("office"),
        F.when(key % 4 == 1, "REPUBLICAN").when(key % 4 == 3, "OTHER").otherwise("DEMOCRAT").alias("party"),
        F.lit(10).alias("candidatevotes"),
    )
    counties = table(spark, d, "nation").select(F.col("n_name").alias("county"), F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("fips"))
    return overlays.election_overlay(results, counties).select("county", "dem_votes", "rep_votes", F.round("rep_share", 6).alias("rep_share"))


@query("""
WITH x AS (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'hospital' WHEN 1 THEN 'place_of_worship' WHEN 2 THEN 'airport' WHEN 3 THEN 'park' WHEN 4 THEN 'cafe' END AS t,
                  CASE p_partkey % 3 WHEN 0 THEN 'Muslim' WHEN 1 THEN 'other' END AS r, p_partkey % 2 = 0 AS spa FROM part)
SELECT p_partkey, CASE t WHEN 'hospital' THEN CASE WHEN spa THEN 'clinic' ELSE 'hospital' END WHEN 'place_of_worship' THEN CASE r WHEN 'Muslim' THEN 'place_of_worship_mosque' WHEN 'other' THEN NULL ELSE 'place_of_worship' END
       WHEN 'park' THEN 'park' WHEN 'cafe' THEN 'bar' END AS category FROM x WHERE t IS DISTINCT FROM 'airport'""")
def tag_categories(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size") % 6
    amenity = F.when(size == 0, "hospital").when(size == 1, "place_of_worship").when(size == 4, "bar")
    tags = {"amenity": amenity, "shop": F.when(size == 4, F.lit("books")), "leisure": F.when(size == 3, F.lit("park")), "aeroway": F.when(size == 2, F.lit("aerodrome")),
            "religion": F.when(key % 3 == 0, "Muslim").when(key % 3 == 1, "other")}
    pairs = F.map_filter(F.create_map(*[x for k, v in tags.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    pois = table(spark, d, "part").select("p_partkey", F.when(key % 2 == 0, "Grand SPA Hospital").otherwise("General").alias("name"), pairs.alias("tags"))
    rows = [("amenity", "hospital", "health", "hospital", "hospital"), ("amenity", "place_of_worship", "religious", "place_of_worship", "place_of_worship"), ("amenity", "bar", "food", "bar", "bar"),
            ("shop", "books", "retail", "books", "books"), ("leisure", "park", "nature", "park", "park"), ("aeroway", "aerodrome", "transport", "airport", "airport")]
    mapping = spark.createDataFrame(rows, "key string, value string, class string, category string, subcat string")
    return poi.map_tags(pois, mapping).select("p_partkey", "category")


@query("SELECT p_partkey FROM part WHERE p_type IN ('PROMO', 'SMALL') OR p_brand = 'Brand#3'")
def allowed_pois(spark, d):
    pois = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("category"), F.when(F.col("p_size") > 0, F.col("p_brand")).alias("brand_id"))
    return poi.allowed(pois, ["PROMO", "SMALL"], ["Brand#3"]).select("p_partkey")


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 4 = 1 THEN NULL ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 0 END AS mode,
       c_custkey % 3 = 0 AS coordinates, CAST(c_custkey * 9 / 5 + 32 AS DOUBLE) AS f, round(c_custkey / 25.4, 6) AS inches FROM customer""")
def cleaned_columns(spark, d):
    key = F.col("c_custkey")
    place = F.when(key % 3 == 0, F.lit(" 42.5, -71")).when(key % 3 == 1, F.lit("42.5 Main St, 7"))
    return table(spark, d, "customer").select(
        "c_custkey",
        text.null_tokens(F.when(key % 4 == 1, F.lit(" NaN ")).otherwise(F.col("c_mktsegment"))).alias("segment"),
        units.mode_code(F.when(key % 2 == 0, "Walk").when(key % 5 == 0, "bike").otherwise("drive")).cast("int").alias("mode"),
        text.looks_like_coordinates(place).alias("coordinates"),
        units.c_to_f(key.cast("double")).alias("f"),
        F.round(units.mm_to_in(key.cast("double")), 6).alias("inches"),
    )


@query(f"WITH {s.LEGS} SELECT anchor, seconds FROM legs WHERE entity = 'Brand#7'")
def d_anchor_brand(spark, d):
    registry = spark.createDataFrame([("Brand#7", "Seven", "the seven; 7th"), ("Brand#8", "Eight", "")], "brand_id string, canonical string, aliases string")
    return catalog.d_anchor_brand(_legs(spark, d), registry, " 7TH ").select("anchor", "seconds")


@query(f"WITH {s.RANKED}, r AS (SELECT *, lag(t) OVER (PARTITION BY cell ORDER BY anchor) AS b, row_number() OVER (PARTITION BY cell ORDER BY anchor) AS n FROM ranked) SELECT cell, anchor, t FROM r WHERE t < b")
def falling_times(spark, d):
    return checks.falling_times(_ranked(spark, d).select("cell", F.col("anchor").alias("rank"), "t")).select("cell", F.col("rank").alias("anchor"), "t")


@query("""
WITH s AS (SELECT CAST(CASE WHEN p_size > 45 THEN p_partkey % 20 ELSE p_partkey + 100000 END AS VARCHAR) AS key, p_size, p_type, p_retailprice AS p FROM part)
SELECT 'repeated site_id' AS rule, key FROM s GROUP BY key HAVING count(*) > 1
UNION ALL SELECT 'negative node', key FROM s WHERE p_size = 7 UNION ALL SELECT 'empty poi_ids', key FROM s WHERE p_type = 'PROMO'
UNION ALL SELECT 'bad coordinates', key FROM s WHERE p / 6 > 180""")
def anchor_contract(spark, d):
    key = F.col("p_partkey")
    sites = table(spark, d, "part").select(
        F.when(F.col("p_size") > 45, key % 20).otherwise(key + 100000).alias("site_id"), key.alias("anchor"), F.when(F.col("p_size") == 7, -1).otherwise(1).alias("node"),
        (F.col("p_retailprice") / 6).alias("lon"), F.lit(2.0).alias("lat"), F.when(F.col("p_type") != "PROMO", F.array(F.lit("a"))).alias("poi_ids"), F.array(F.lit("b")).alias("categories"),
    )
    return anchors.anchor_violations(sites)


#: Off the thousandths that points lie on, so that no pixel is touched by a hair.
_WEST, _NORTH, _PIXEL, _COLUMNS, _ROWS = -73.5203172, 43.0101939, 0.125, 30, 20
_PIXELS = f"""px AS (SELECT p_partkey // {_COLUMNS} % {_ROWS} AS r, p_partkey % {_COLUMNS} AS c, CASE WHEN min(p_size) = 1 THEN -9999 ELSE min(p_size) END AS v FROM part GROUP BY ALL)"""


@query(f"""
WITH {s.POINTS}, {_PIXELS}, held AS (
  SELECT id, lon, lat, 0.01 + (id % 7) * 0.03::DOUBLE AS reach, {_WEST} + (c + 0.5::DOUBLE) * {_PIXEL} AS x, {_NORTH} - (r + 0.5::DOUBLE) * {_PIXEL} AS y, v FROM points, px WHERE v <> -9999),
touched AS (SELECT * FROM held WHERE greatest(abs(x - lon) - {_PIXEL / 2}, 0) + greatest(abs(y - lat) - {_PIXEL / 2}, 0) <= reach)
SELECT p.id, count(v) AS n, CAST(sum(v) AS DOUBLE) / count(v) AS mean FROM points p LEFT JOIN touched t ON t.id = p.id GROUP BY p.id""")
def zonal_mean_touched(spark, d):
    """Diamonds about points on a raster of parts: the mean of all pixels that a diamond touches, not of those alone whose centre it holds."""
    grid = RasterGrid(_WEST, _NORTH, _PIXEL, _PIXEL, _COLUMNS, _ROWS)
    key = F.col("p_partkey")
    least = table(spark, d, "part").groupBy(F.expr(f"p_partkey div {_COLUMNS} % {_ROWS}").alias("row"), (key % _COLUMNS).alias("col")).agg(F.min("p_size").alias("v"))
    pixels = least.select("row", "col", F.when(F.col("v") == 1, -9999.0).otherwise(F.col("v").cast("double")).alias("value"))
    reach = F.lit(0.01) + (F.col("id") % 7) * 0.03
    corner = lambda a, b: F.struct((F.col("lon") + reach * a).alias("x"), (F.col("lat") + reach * b).alias("y"))
    rings = F.array(F.array(corner(1, 0), corner(0, 1), corner(-1, 0), corner(0, -1)))
    return polygons.zonal_mean_touched(s.points(spark, d).select("id", rings.alias("rings")), pixels, grid, "id")


@query()
def h3_cells(spark, d):
    """H3 cells of all points at the resolutions in use, and whether the coarser ones are the finest one's parents."""
    points = s.points(spark, d)
    cells = points.select("id", *[h3.h3_cell(F.col("lon"), F.col("lat"), r).alias(f"r{r}") for r in (7, 8, 9, 11)])
    up = lambda r: geo.h3_parent(F.col("r11"), r)
    return cells.select("id", *[geo.h3_string(F.col(f"r{r}")).alias(f"r{r}") for r in (7, 8, 9, 11)], *[geo.h3_string(up(r)).alias(f"up{r}") for r in (7, 8, 9)])


@query()
def h3_boundaries(spark, d):
    """Middle and boundary of each H3 cell of resolution 8 that has a point."""
    own = s.points(spark, d).select(h3.h3_cell(F.col("lon"), F.col("lat"), 8).alias("cell")).distinct()
    lon, lat = h3.h3_centre(F.col("cell"))
    return own.select("cell", lon.alias("lon"), lat.alias("lat"), h3.h3_boundary(F.col("cell")).alias("ring"))


@query()
def h3_polygon_cells(spark, d):
    """H3 cells of resolution 7 whose middle is in a polygon."""
    return polygons.h3_polyfill(_polygons(spark, d).withColumn("rings", F.array("ring")), 7)


@query()
def county_cells(spark, d):
    """The county with most of each H3 cell, joined with its vote: polygons of nations stand in for counties, balances of their customers for votes."""
    cells = polygons.cells_by_largest_share(_polygons(spark, d).withColumn("rings", F.array("ring")), 6)
    votes = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("poly")).agg(
        F.sum(F.when(F.col("c_acctbal") < 4500, 1).otherwise(0)).alias("rep"), F.count(F.lit(1)).alias("total")
    )
    return cells.join(votes, "poly").select("cell", "poly", "share", (F.col("rep") / F.col("total")).alias("rep_share"))


_WALK = "walked AS (SELECT cell, anchor, t * 3 AS t FROM ranked)"


@query(f"""
WITH {s.RANKED}, {s.LEGS}, {s.CELLS}, {_WALK},
open AS (SELECT cell FROM cells WHERE NOT near_power_corridor),
drive AS (SELECT cell FROM (SELECT cell, entity, min(t + seconds) AS total FROM ranked JOIN legs USING (anchor) WHERE entity IN ('Brand#1', 'Brand#2') GROUP BY ALL)
  WHERE total <= CASE entity WHEN 'Brand#1' THEN 360 ELSE 1800 END GROUP BY cell HAVING count(*) = 2),
walk AS (SELECT cell FROM (SELECT cell, entity, min(t + seconds) AS total FROM walked JOIN legs USING (anchor) WHERE entity = 'Brand#7' GROUP BY ALL) WHERE total <= 720)
SELECT 'drive' AS mode, cell FROM open JOIN drive USING (cell) UNION ALL SELECT 'walk', cell FROM open JOIN walk USING (cell)""")
def livable_layers(spark, d):
    """One entity by foot and two by car (one with the default time); an overlay binds both layers, an entity without legs neither."""
    ranked, legs = _ranked(spark, d).select("cell", "anchor", "t"), _legs(spark, d).select("anchor", "entity", "seconds")
    both = lambda df, walk: df.withColumn("mode", F.lit("drive")).unionByName(walk.withColumn("mode", F.lit("walk")))
    state = State({"Brand#1": 6, "Brand#2": None, "Brand#7": 12, "nothing": 1}, avoid_power_lines=True, modes={"Brand#7": "walk", "nothing": "walk"})
    return layers(s.cells(spark, d), both(ranked, ranked.withColumn("t", F.col("t") * 3)), both(legs, legs), state)


@query(f"""
WITH {s.LEGS}, {s.POIS},
registry AS (SELECT DISTINCT p_brand AS category_id, CAST(substr(p_brand, 7) AS INTEGER) AS numeric_id,
  CASE p_brand WHEN 'Brand#1' THEN 'Hospital' WHEN 'Brand#2' THEN 'Level 1 Trauma (Adults)' ELSE 'The ' || p_brand END AS display_name FROM part WHERE p_brand <> 'Brand#9'),
own AS (SELECT upper(substr(brand_id, 1, 1)) || substr(brand_id, 2) AS category_id, list(DISTINCT category ORDER BY category) AS brands FROM pois WHERE brand_id IS NOT NULL AND brand_id <> 'brand#3' GROUP BY 1)
SELECT coalesce(CAST(numeric_id AS VARCHAR), category_id) AS id, coalesce(display_name, 'Category ' || category_id) AS label,
  CASE display_name WHEN 'Hospital' THEN 'hospital' WHEN 'Level 1 Trauma (Adults)' THEN 'hospital_trauma' END AS "group", array_to_string(coalesce(brands, []), ',') AS brands
FROM (SELECT DISTINCT entity AS category_id FROM legs) LEFT JOIN registry USING (category_id) LEFT JOIN own USING (category_id)""")
def catalog_categories(spark, d):
    """Every category with a leg: brands of parts stand in for categories, their kinds for brands."""
    brand = F.col("p_brand")
    name = F.when(brand == "Brand#1", "Hospital").when(brand == "Brand#2", "Level 1 Trauma (Adults)").otherwise(F.concat(F.lit("The "), brand))
    listed = table(spark, d, "part").where("p_brand <> 'Brand#9'").select(brand.alias("category_id"), F.substring(brand, 7, 9).cast("int").alias("numeric_id"), name.alias("display_name"))
    places = s.pois(spark, d).where("brand_id <> 'brand#3'").select(F.initcap("brand_id").alias("category_id"), F.col("category").alias("brand_id")).withColumnRenamed("category_id", "category")
    found = catalog.catalog_categories(_legs(spark, d), listed.distinct(), places)
    return found.withColumn("brands", F.array_join("brands", ","))


@query(f"""
WITH {s.POIS} SELECT DISTINCT brand_id AS id, CASE WHEN brand_id = 'brand#1' THEN 'First' ELSE upper(substr(brand_id, 1, 1)) || substr(brand_id, 2) END AS label
FROM pois WHERE brand_id IS NOT NULL""")
def catalog_brands(spark, d):
    registry = spark.createDataFrame([("brand#1", "First"), ("brand#2", ""), ("other", "Other")], "brand_id string, canonical string")
    return catalog.catalog_brands(s.pois(spark, d), registry)


@query("""
SELECT CAST(l_orderkey AS VARCHAR) AS key, CAST(l_linenumber AS DOUBLE) AS v, CAST(NULL AS VARCHAR) AS note FROM lineitem
UNION ALL SELECT o_orderstatus, CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE), o_orderpriority FROM orders""")
def union_widened(spark, d):
    """Whole numbers beside text, and int beside float, which double alone holds."""
    one = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").cast("int").alias("v"))
    two = table(spark, d, "orders").select(F.col("o_orderstatus").alias("key"), F.col("o_totalprice").cast("float").alias("v"), F.col("o_orderpriority").alias("note"))
    return tables.union_widened(one, two)


@query("""
WITH c AS (SELECT c_acctbal AS a, c_custkey AS k FROM customer)
SELECT * FROM (SELECT 'summer colder than winter' AS rule, count(*) FILTER (k % 5 > 0 AND k % 7 > 0 AND a < k) AS n FROM c
UNION ALL SELECT 'one season missing', count(*) FILTER ((k % 5 = 0) <> (k % 7 = 0)) FROM c
UNION ALL SELECT 'much rain in jan', count(*) FILTER (a > 1000) FROM c UNION ALL SELECT 'much rain in feb', count(*) FILTER (a > 1000000) FROM c) WHERE n > 0""")
def climate_warnings(spark, d):
    key, value = F.col("c_custkey"), F.col("c_acctbal")
    rows = table(spark, d, "customer").select(
        F.when(key % 5 > 0, value).alias("summer"), F.when(key % 7 > 0, key.cast("double")).alias("winter"), value.alias("jan"), (value / 1000).alias("feb")
    )
    return checks.climate_warnings(rows, "summer", "winter", ["jan", "feb"])


@query("""
WITH c AS (SELECT c_custkey AS id, c_custkey % 100 AS x, c_custkey % 90 AS y, 1.0::DOUBLE + c_custkey % 7 AS r, c_custkey % 3 = 0 AS bow FROM customer)
SELECT id, CASE WHEN bow THEN r * r / 2 ELSE r * r - r * r / 16 END AS area, CASE WHEN bow THEN 2 ELSE 2 END AS n_rings, true AS inside FROM c""")
def valid_polygons(spark, d):
    """Bow-ties, and squares with a hole that is given the wrong way round: areas after they are made valid, and a point inside of each."""
    x, y, r = (F.col("c_custkey") % 100).cast("double"), (F.col("c_custkey") % 90).cast("double"), F.lit(1.0) + F.col("c_custkey") % 7
    at = lambda a, b: F.struct((x + r * a).alias("x"), (y + r * b).alias("y"))
    bow = F.array(F.array(at(0.0, 0.0), at(1.0, 1.0), at(1.0, 0.0), at(0.0, 1.0)))
    hollow = F.array(F.array(at(0.0, 0.0), at(0.0, 1.0), at(1.0, 1.0), at(1.0, 0.0)), F.array(at(0.5, 0.5), at(0.75, 0.5), at(0.75, 0.75), at(0.5, 0.75)))
    own = spread(table(spark, d, "customer").select("c_custkey"), 20_000)  # small keys of much work
    shapes = own.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, bow).otherwise(hollow).alias("rings"))
    # Dealt again, as calls on calls in one stage would make the rings twice.
    valid = shapes.withColumn("rings", rings.make_valid(F.col("rings"))).repartition(own.rdd.getNumPartitions(), "id")
    px, py = rings.representative_point(F.col("rings"))
    held = valid.withColumns({"px": px, "py": py})
    odd = F.aggregate(F.transform("rings", lambda ring: geo.in_ring(F.col("px"), F.col("py"), ring).cast("int")), F.lit(0), lambda a, b: a + b)
    return held.select("id", F.round(rings.rings_area(F.col("rings")), 9).alias("area"), F.size("rings").alias("n_rings"), (odd % 2 == 1).alias("inside"))


@query()
def conflate_h3(spark, d):
    """Conflation with the key's spatial part on H3: resolution 11 of branded places, 10 of others."""
    return poi.with_h3_r9(poi.conflate(s.pois(spark, d), merge_sources=True, grid="h3")).select("poi_id", "source", "h3_r9")


@query()
def h3_features(spark, d):
    """GeoJSON features of the H3 cells of points, with the number of points in each."""
    own = s.points(spark, d).groupBy(h3.h3_cell(F.col("lon"), F.col("lat"), 8).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    return catalog.geojson_lines(own, grid="h3")
