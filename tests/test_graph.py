"""Graph queries against plain searches."""

import random

import duckdb
from pyspark.sql import functions as F

from assetlens import registry
from assetlens.operators import graph

PART = 1_000_000_000_000


def union_find(nodes, links):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_connected_is_union_find(spark):
    r = random.Random(5)
    chain = list(range(1000, 1060))
    r.shuffle(chain)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(90)] + list(zip(chain, chain[1:], strict=False)) + [(300, x) for x in range(301, 340)] + [(7, 7)]
    nodes = [*range(200), *chain, *range(300, 345)]
    got = graph.connected(spark.createDataFrame([(x,) for x in nodes], "id bigint"), spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert len(got) == len(nodes) and {x.id: x.cluster for x in got} == union_find(nodes, links)


def test_components_take_all_links_and_nodes(spark, tmp_path):
    """Links of any quantity count, and suppliers and parts that have none are components of their own."""
    rows = [(1, 10, 1.0), (1, 11, 50.0), (2, 11, 3.0), (3, 12, 49.0), (3, 12, 2.0), (4, 13, 7.0)]
    spark.createDataFrame(rows, "l_suppkey bigint, l_partkey bigint, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(x,) for x in range(1, 7)], "s_suppkey bigint").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(x,) for x in range(10, 16)], "p_partkey bigint").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.id: r.cluster for r in registry.queries()["e3_all_components"](spark, str(tmp_path)).collect()}
    assert got == union_find([*range(1, 7), *(PART + x for x in range(10, 16))], [(a, PART + b) for a, b, _ in rows])


def test_components_of_the_tables(spark, sf):
    links = [(r.l_suppkey, PART + r.l_partkey) for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_partkey").distinct().collect()]
    nodes = {x for link in links for x in link} | {r[0] for r in spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey").collect()}
    nodes |= {r[0] for r in spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey") + PART).collect()}
    got = registry.queries()["e3_all_components"](spark, sf).collect()
    assert len(got) == len(nodes) and {r.id: r.cluster for r in got} == union_find(nodes, links)


def test_connected_components_take_both_tables(spark, tmp_path):
    """A chain of suppliers over parts of any quantity, several sections of a person, null keys, and nodes of each kind without links;
    SQL and query give what union-find gives."""
    items = [(1, 10, 1.0), (2, 10, 50.0), (2, 11, 3.0), (3, 11, 49.0), (3, 12, 2.0), (4, 12, 7.0), (5, 13, 8.0), (8, 15, 50.0), (6, None, 1.0), (None, 14, 50.0), (None, None, 1.0)]
    sections = [(1, 10), (1, 11), (2, 12), (None, 13)]
    tables = {
        "lineitem": (items, "l_suppkey bigint, l_partkey bigint, l_quantity double"), "orders": (sections, "o_custkey bigint, o_orderkey bigint"), "customer": ([(x,) for x in range(1, 4)], "c_custkey bigint"),
        "supplier": ([(x,) for x in range(1, 8)], "s_suppkey bigint"), "part": ([(x,) for x in range(10, 17)], "p_partkey bigint"),
    }
    db = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{t}.parquet")
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    links = [(a, PART + b) for a, b in sections if a] + [(2 * PART + a, 3 * PART + b) for a, b, _ in items if a and b]
    nodes = [*range(1, 4), *(PART + x for x in range(10, 14)), *(2 * PART + x for x in range(1, 9)), *(3 * PART + x for x in range(10, 17))]
    want = sorted(union_find(nodes, links).items())
    assert sorted(map(tuple, registry.queries()["e3_connected_components"](spark, str(tmp_path)).collect())) == want
    assert sorted(db.execute(registry.oracle_sql()["e3_connected_components"]).fetchall()) == want


def test_connected_components_of_the_tables(spark, sf):
    def pairs(t, a, b):
        return [tuple(x) for x in spark.read.parquet(f"{sf}/{t}.parquet").select(a, b).distinct().collect()]

    links = [(a, PART + b) for a, b in pairs("orders", "o_custkey", "o_orderkey")] + [(2 * PART + a, 3 * PART + b) for a, b in pairs("lineitem", "l_suppkey", "l_partkey")]
    nodes = {x for link in links for x in link} | {k * PART + x for t, key, k in (("customer", "c_custkey", 0), ("supplier", "s_suppkey", 2), ("part", "p_partkey", 3)) for x, _ in pairs(t, key, key)}
    got = registry.queries()["e3_connected_components"](spark, sf).collect()
    assert len(got) == len(nodes) and {r.id: r.cluster for r in got} == union_find(nodes, links)
