"""What larger tables showed: whole jobs, and operators whose work follows their result."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from cellreach.functions import rings
from cellreach.operators import checks, graph, spatial, times
from cellreach.plans.queries import QUERIES
from tests.test_operators import brute_kbest


def test_except_ids_takes_every_returned_line(spark, tmp_path):
    spark.createDataFrame([(1,), (2,), (3,)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(1, "R", 1), (2, "R", 2), (3, "N", 1)]
    spark.createDataFrame(lines, "l_partkey long, l_returnflag string, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [r["id"] for r in QUERIES["except_ids"](spark, str(tmp_path)).collect()] == [3]


def _metres(a, b):
    k = 111000.0 * math.cos(math.radians((a[1] + b[1]) / 2))
    return math.hypot((b[0] - a[0]) * k, (b[1] - a[1]) * 111000.0)


def test_nearest_places_of_crowds(spark, monkeypatch):
    """Crowds of places are searched nearby, lone points far off, and many points at a spot once."""
    r = random.Random(5)
    places = [(k, -72 + r.random() * 0.1, 42 + r.random() * 0.1) for k in range(1500)] + [(5000 + k, -72.05, 42.05) for k in range(300)] + [(9000, -70.0, 42.0)]
    points = [(k, -72 + k % 20 * 0.005, 42 + k % 15 * 0.006) for k in range(600)] + [(700, -72.05, 42.05), (701, -70.01, 42.0), (702, -60.0, 10.0)]
    pairs, own = [], spatial.within

    def counted(*args):
        found = own(*args)
        pairs.append(found.count())
        return found

    monkeypatch.setattr(spatial, "within", counted)
    near, to = spark.createDataFrame(points, "id long, lon double, lat double"), spark.createDataFrame(places, "place long, p_lon double, p_lat double")
    want = {i: sorted((_metres((x, y), (px, py)), p) for p, px, py in places) for i, x, y in points}
    got = {}
    for row in spatial.knn_join(near, to, 3, 9000.0, 7).collect():
        got[row["id"], row["rank"]] = row["place"]
    assert got == {(i, n + 1): p for i, rows in want.items() for n, (d, p) in enumerate(rows[:3]) if d <= 9000}
    assert sum(pairs) < len(points) * len(places) / 10  # all of them within the last distance: over 700,000
    any_ = {(row["id"], row["rank"]): row["place"] for row in spatial.knn_any(near, to, 3, 4000.0, 9).collect()}
    assert any_ == {(i, n + 1): p for i, rows in want.items() for n, (_, p) in enumerate(rows[:3])}


def test_corridors_of_crowds(spark):
    r = random.Random(6)
    lines = [(x := -72 + r.random() * 0.2, y := 42 + r.random() * 0.2, x + 0.05, y + 0.03) for _ in range(25)] + [(-71.0, 41.0, -69.0, 43.0), (-68.0, 44.0, -68.0, 44.0)]
    points = [(k, -72.1 + r.random() * 0.4, 41.9 + r.random() * 0.4) for k in range(500)] + [(600 + k, -71 + k * 0.02, 41 + k * 0.02 + r.random() * 0.04) for k in range(100)]
    points += [(701, -68.0, 44.01), (702, -68.0, 44.02), (703, None, 44.0)]

    def off(x, y, ax, ay, bx, by):
        k = 111000.0 * math.cos(math.radians(y))
        x1, y1, dx, dy = (ax - x) * k, (ay - y) * 111000.0, (bx - ax) * k, (by - ay) * 111000.0
        n = dx * dx + dy * dy
        t = min(max(-(x1 * dx + y1 * dy) / n, 0), 1) if n else 0
        return math.hypot(x1 + t * dx, y1 + t * dy)

    near, segments = spark.createDataFrame(points, "id long, lon double, lat double"), spark.createDataFrame(lines, "ax double, ay double, bx double, by double")
    for metres in (300.0, 1500.0):
        got = {row["id"]: row["near"] for row in spatial.near_segments(near, segments, metres, 7).collect()}
        assert got == {i: x is not None and any(off(x, y, *s) <= metres for s in lines) for i, x, y in points}
        assert 100 < sum(got.values()) < len(points) or metres < 1000


def test_product_of_times_is_not_shuffled(spark):
    """40 cells of 20 anchors with 30 legs each: the exchanges carry anchors' rows, not their legs one by one."""
    ranked = spark.createDataFrame([(c, a, (c * 7 + a * 3) % 50, a) for c in range(40) for a in range(20)], "cell long, anchor long, t long, rank int")
    legs = spark.createDataFrame([(a, f"e{e}" if e else None, (a * 5 + e * 11) % 60) for a in range(25) for e in range(30)], "anchor long, entity string, seconds long")
    want = {}
    for c, a, t in ((r["cell"], r["anchor"], r["t"]) for r in ranked.collect()):
        for e in range(30):
            key = c, f"e{e}" if e else None
            want[key] = min(want.get(key, 999), t + (a * 5 + e * 11) % 60)
    out = times.compose(ranked, legs)
    assert {(r["cell"], r["entity"]): r["total"] for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.index("HashAggregate(keys=[cell") < plan.index("Generate explode") < plan.index("Exchange hashpartitioning(cell")
    pairs = spark.createDataFrame([(c, f"e{e}") for c in (3, 39, 77) for e in (1, 29, 88)], "cell long, entity string")
    got = {(r["cell"], r["entity"]): r["total"] for r in times.compose_pairs(ranked, legs, pairs).collect()}
    assert got == {k: want[k] for k in ((c, f"e{e}") for c in (3, 39) for e in (1, 29))}


def test_few_sides_as_many(spark, monkeypatch):
    """Plain numbers and arrays give the same rings, and the query makes them once."""
    r = random.Random(8)
    shapes = [[[(float(r.randrange(5)), float(r.randrange(5))) for _ in range(r.randrange(3, 6))] for _ in range(r.randrange(1, 4))] for _ in range(150)]
    shown = [[[{"x": x, "y": y} for x, y in ring] for ring in s] for s in shapes]
    made = lambda: [[ring.tolist() for ring in rings.valid(rings.corners_of(s))] for s in shown]
    few = made()
    monkeypatch.setattr(rings, "FEW", 0)
    assert made() == few and sum(map(len, few)) > 150
    plan = QUERIES["valid_polygons"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    calls = [line.count("of(") for line in plan.splitlines() if "ArrowEvalPython [" in line]
    assert calls == [1, 1]


def test_a_part_is_searched_in_small_steps(monkeypatch):
    """However large a part and its frontier, few edges are followed at once, with the rows of the whole; of what leaves, a node gets its k least."""
    r = random.Random(9)
    rows = [(r.randrange(300), r.randrange(300), r.randrange(1, 9)) for _ in range(6000)]
    u, v, w = np.array(rows).T
    starts = np.array([(s, s, 0) for s in range(0, 200, 7)])
    none, limits, seen, own = np.empty((0, 3), np.int64), np.full(len(starts), 12), [], graph._Part.leave

    def counted(part, node):
        found = own(part, node)
        seen.append(len(found[0]))
        return found

    monkeypatch.setattr(graph._Part, "leave", counted)
    monkeypatch.setattr(graph, "STEP_EDGES", 100)
    inside = lambda node: node < 200
    home = u < 200
    part = graph._Part(u[home], v[home], w[home], none, starts, inside)
    near = [x for x in rows if x[0] < 200 and x[1] < 200]
    all_ = {tuple(x) for x in graph._search_all(part, none, starts, limits).tolist()}
    assert all_ == brute_kbest(near, starts[:, 0].tolist(), 999, 12)
    best = graph._search_k(part, none, starts, limits, 3)
    assert {tuple(x) for x in best.tolist()} == brute_kbest(near, starts[:, 0].tolist(), 3, 12)
    out = {}
    for a, b, c in rows:
        for n, s, d in best.tolist():
            if a == n and b >= 200 and d + c <= 12:
                out[b, s] = min(out.get((b, s), 99), d + c)
    want = {(b, s, d) for (b, s), d in out.items() if sum((e, t) < (d, s) for (n, t), e in out.items() if n == b) < 3}
    assert {tuple(x) for x in np.stack(graph._leaving(part, best, starts, limits, 3)[:3], 1).tolist()} == want
    assert max(seen) <= 100 + 60


def test_times_are_dealt_by_their_number(spark, monkeypatch):
    """More rows make more tasks, not larger ones, whatever the session's number of shuffle partitions."""
    monkeypatch.setattr(times, "TASK_ROWS", 100, raising=False)
    rows = spark.range(4000).selectExpr("id % 90 as cell", "id % 70 as anchor", "id * 31 % 500 as t")
    out = times.widen(times.cell_topk(rows))
    assert out.count() == 90 and out.rdd.getNumPartitions() == 40


def test_parents_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(checks, "TASK_ROWS", 100, raising=False)
    d = "/root/testdata/sf0.001"
    tasks = -(-spark.read.parquet(f"{d}/lineitem.parquet").count() // 100)
    assert QUERIES["cross_res_invariant"](spark, d).rdd.getNumPartitions() == tasks > 4


def test_edges_of_components_are_dealt_by_their_number(spark, monkeypatch):
    """More edges make more tasks, not larger ones; rows repeated or null, and the query's own edges, are as before."""
    dealt, own = [], graph.spread if hasattr(graph, "spread") else None

    def counted(df, *args, **more):
        out = own(df, *args, **more)
        dealt.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(graph, "TASK_EDGES", 50, raising=False)
    monkeypatch.setattr(graph, "spread", counted, raising=False)
    edges = spark.createDataFrame([(k, 1000 + k % 3) for k in range(300)] * 2, "u long, v long")
    got = {r["node"]: r["component"] for r in graph.components(edges).collect()}
    assert got == {**{k: k % 3 for k in range(300)}, 1000: 0, 1001: 1, 1002: 2}
    assert dealt[0] == 24 and set(dealt[1:]) == {12}


def test_kbest_rounds_are_crossings_of_parts(spark):
    """Labels are shuffled where a path leaves a part, not once a hop: 40 hops settle in twelve rounds."""
    path = spark.createDataFrame([(k, k + 1, 2) for k in range(40)], "u long, v long, w long")
    got = {tuple(r) for r in graph.kbest(path, spark.createDataFrame([(0,)], "node long"), 1, 70, max_rounds=12).select("node", "src", "d").collect()}
    assert got == {(k, 0, 2 * k) for k in range(36)}


def test_knn_any_takes_every_point(spark):
    d = "/root/testdata/sf0.001"
    want = {(r["c_custkey"], k) for r in spark.read.parquet(f"{d}/customer.parquet").collect() for k in (1, 2, 3)}
    got = [(r["id"], r["rank"]) for r in QUERIES["knn_any"](spark, d).collect()]
    assert len(got) == len(want) and set(got) == want


def test_parts_travel_in_small_rows_a_part_a_task(spark, monkeypatch):
    """However many edges and labels a part has, a row carries few of them, and no task holds two parts."""
    kept, own = [], graph.cut

    def watched(df):
        kept.append(own(df))
        return kept[-1]

    monkeypatch.setattr(graph, "cut", watched)
    edges = spark.range(300_000).selectExpr("id % 30000 as u", "(id * 7 + id div 30000) % 30000 as v", "1 + id % 9 as w")
    starts = list(range(0, 30000, 1000))
    got = graph.kbest_by_part(edges, spark.createDataFrame([(k,) for k in starts], "node long"), 5, 8, parts=4)
    assert {tuple(r) for r in got.select("node", "src", "d").collect()} == brute_kbest([tuple(r) for r in edges.collect()], starts, 5, 8)
    packed = [df for df in kept if "part" in df.columns]
    for df in packed:
        lists = [f.name for f in df.schema if f.dataType.typeName() == "array"]
        assert (df.select(F.max(F.greatest(*[F.size(c) for c in lists]))).first()[0] or 0) <= 1 << 16
    tasks = packed[0].groupBy(F.spark_partition_id()).agg(F.count_distinct("part").alias("n")).collect()
    assert len(tasks) == 4 and {t["n"] for t in tasks} == {1}
