import random

import pytest
from pyspark.sql import functions as F

from placeloom.operators import graph, nearpaths, spatial


def network(spark, seed, levels=1):
    """Sessions on a grid, so that many paths are equally long, with points on top of each other left out."""
    rnd = random.Random(seed)
    spots = rnd.sample([(x / 2, y / 2, z) for x in range(18) for y in range(8) for z in range(levels)], 100)
    rows = [(f"{k // 20}_{k % 20}", k // 20, k % 20, k, float(x), float(y), float(z)) for k, (x, y, z) in enumerate(spots)]
    nodes = spark.createDataFrame(rows, "id string, session int, seq long, ord long, x double, y double, z double")
    edges = spark.createDataFrame([(a[0], b[0]) for a, b in zip(rows, rows[1:]) if a[1] == b[1] and a[2] % 7] + [("0_0", "nowhere"), ("0_3", "0_3")], "source_id string, target_id string")
    near = spatial.proximity_pairs(nodes, edges, 1.2, 4).select(F.col("a").alias("source_id"), F.col("b").alias("target_id"))
    return nodes, edges, graph.weighted(edges.unionByName(near), nodes)


@pytest.mark.parametrize(("seed", "levels"), [(1, 1), (2, 1), (3, 2)])
def test_paths_over_unlisted_links(spark, seed, levels):
    nodes, edges, links = network(spark, seed, levels)
    starts = spark.createDataFrame([("0_0",), ("2_7",), ("4_19",), (None,)], "src string")
    want = {tuple(r) for r in graph.shortest(links, starts).collect()}
    got = {tuple(r) for r in nearpaths.shortest(nodes, edges, starts, 1.2, 4, chunk=1).collect()}
    assert got == want and len(got) > 100
    assert {tuple(r) for r in nearpaths.shortest(nodes, edges, starts, 1.2, 4, at_once=10).collect()} == want


def test_set_distances_over_unlisted_links(spark, monkeypatch):
    nodes, edges, links = network(spark, 4)
    anchors = nodes.where("seq % 6 = 0").select(F.col("session").alias("key"), F.col("id").alias("node"), (0.25 * (F.col("seq") % 4)).alias("offset"))
    anchors = anchors.unionByName(spark.createDataFrame([(9, "nowhere", 0.0), (0, "0_1", float("inf"))], "key int, node string, offset double"))
    paths = graph.shortest(links, anchors.select(F.col("node").alias("src")))
    want = sorted((r.i, r.j, round(r.dist, 9)) for r in graph.set_distances(anchors, paths).collect() if r.i != r.j)
    got = sorted((r.i, r.j, round(r.dist, 9)) for r in nearpaths.set_distances(nodes, edges, anchors, 1.2, 4, chunk=1).collect())
    assert got == want and len(got) == 10


def test_links_are_not_listed(spark, monkeypatch):
    """Nothing may write one row a link: the listing join and the sharing out of edges are not used."""
    nodes, edges, _ = network(spark, 5)
    for owner, name in ((spatial, "proximity_pairs"), (graph, "shortest")):
        monkeypatch.setattr(owner, name, lambda *a, **k: pytest.fail("links are listed"))
    assert nearpaths.shortest(nodes, edges, spark.createDataFrame([("1_1",)], "src string"), 1.2, 4).count() > 50


def test_queries_list_no_links(spark, sf_dir, monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(spatial, "proximity_pairs", lambda *a, **k: pytest.fail("links are listed"))
    for name in ("g3_shortest_paths", "g4_path_nodes", "g6_set_distances", "v4_geodesic_heat"):
        assert entry.queries()[name](spark, sf_dir).count() > 0
