"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from cellreach.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(columns).collect())))
    found = duck.execute(ORACLES[name])
    order = [d[0] for d in found.description]
    assert sorted(order) == columns
    want = sorted(repr(tuple(r[order.index(c)] for c in columns)) for r in found.fetchall())
    assert got == want


def supplied(d):
    """Component of every node of all customer-supplier edges, and the suppliers in components of BUILDING customers."""
    con = duckdb.connect()
    edges = con.execute(f"SELECT o_custkey, l_suppkey + 1000000 FROM '{d}/lineitem.parquet/*.parquet' JOIN '{d}/orders.parquet/*.parquet' ON l_orderkey = o_orderkey").fetchall()
    up = {n: n for e in edges for n in e}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        up[hi] = lo
    wanted = {find(c) for (c,) in con.execute(f"SELECT c_custkey FROM '{d}/customer.parquet/*.parquet' WHERE c_mktsegment = 'BUILDING'").fetchall() if c in up}
    return {n: find(n) for n in up}, {n for n in up if n >= 1000000 and find(n) in wanted}


@pytest.mark.parametrize("kept", ["true", "l_suppkey % 3 <> 0 and o_custkey % 7 = l_suppkey % 7"])
def test_whole_supply_graph(spark, tmp_path, kept):
    """On all edges (hub suppliers), and on a graph of several large components."""
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    read("orders").write.parquet(f"{tmp_path}/orders.parquet")
    read("customer").write.parquet(f"{tmp_path}/customer.parquet")
    items = read("lineitem").join(read("orders").selectExpr("o_orderkey as l_orderkey", "o_custkey"), "l_orderkey").where(kept)
    items.select("l_orderkey", "l_suppkey", "l_quantity", "l_discount").write.parquet(f"{tmp_path}/lineitem.parquet")
    comps, targets = supplied(tmp_path)
    got = [tuple(r) for r in QUERIES["connected_components_all"](spark, str(tmp_path)).select("node", "component").collect()]
    assert len(got) == len(comps) and dict(got) == comps
    found = [r["node"] for r in QUERIES["target_nodes_all"](spark, str(tmp_path)).collect()]
    assert len(found) == len(targets) and set(found) == targets


def test_entry(spark):
    assert entry.entry(spark).columns == ["cell"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
