import random

import pytest

from placeloom.operators import clusters, graph, network, spatial

XYZ = "xyz"


def crosses(s, g, margin=0.3):
    """Plain reading of the gate test: the middle plane across the thinnest axis, widened by the margin."""
    p0, p1, centre, half = s[1:4], s[4:7], g[1:4], g[4:7]
    thin = half.index(min(half))
    slope = p1[thin] - p0[thin]
    if abs(slope) < 1e-9:
        return False
    t = (centre[thin] - p0[thin]) / slope
    return 0 <= t <= 1 and all(abs(p0[k] + t * (p1[k] - p0[k]) - centre[k]) <= half[k] + margin for k in range(3) if k != thin)


def tables(spark, segments, gates):
    s = spark.createDataFrame(segments, "key string, " + ", ".join(f"p{k}{c} double" for k in (0, 1) for c in XYZ))
    return s, spark.createDataFrame(gates, "uid long, " + ", ".join(f"{c} double" for c in XYZ) + ", " + ", ".join(f"h{c} double" for c in XYZ))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_crossings_equal_all_pairs(spark, seed):
    """Short, long, flat and huge segments; halves and margins on cell borders; a gate far off widens the box of all."""
    rnd = random.Random(seed)
    spot = lambda r: [rnd.randrange(-r * 10, r * 10) / 10 for _ in XYZ]
    gates = [(k, *spot(6), *[rnd.choice([0.1, 0.2, 0.7, 1.5]) for _ in XYZ]) for k in range(60)] + [(60, 90.0, 80.0, 0.0, 0.2, 3.0, 3.0)]
    segments = [(f"s{k}", *(p := spot(12)), *[c + d for c, d in zip(p, spot(2))]) for k in range(300)]
    segments += [(f"l{k}", *spot(40), *spot(40)) for k in range(60)] + [("huge", -1e9, 0.5, 0.5, 1e9, 0.5, 0.5)]
    segments += [(f"f{k}", *spot(8)[:2], 0.0, *spot(8)[:2], 0.0) for k in range(100)] + [("point", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)]
    s, g = tables(spark, segments + [("none", None, 0.0, 0.0, 1.0, 0.0, 0.0)], gates + [(99, None, 0.0, 0.0, 1.0, 1.0, 1.0)])
    want = {a[0] for a in segments if any(crosses(a, b) for b in gates)}
    assert {r.key for r in spatial.crossing(s, g).collect()} == want and len(want) > 30
    assert {r.key for r in spatial.crossing(s, g, kept=True).collect()} == {a[0] for a in segments} - want | {"none"}
    assert {r.uid for r in spatial.crossed(g, s, "uid").collect()} == {b[0] for b in gates if any(crosses(a, b) for a in segments)}


def test_no_gates_and_no_segments(spark):
    s, g = tables(spark, [("a", 0.0, 0.0, 0.0, 1.0, 0.0, 0.0)], [(1, 0.5, 0.0, 0.0, 0.1, 1.0, 1.0)])
    assert spatial.crossing(s, g.limit(0), kept=True).count() == 1 and spatial.crossing(s.limit(0), g).count() == 0


def test_areas_search_only_from_nodes_that_are_reached(spark, monkeypatch):
    """A door stands between object 3 and its node, so nothing is searched from there; objects alone in their shard need no matrix."""
    seen, shortest = [], graph.shortest
    monkeypatch.setattr(graph, "shortest", lambda e, s, t=None: (seen.extend(r.src for r in s.distinct().collect()), shortest(e, s, t))[1])
    box = (0.2, 0.2, 0.2)
    rows = [(1, "L0", 0.0, 1.0, 0.0, *box), (2, "L0", 2.0, 1.0, 0.0, *box), (3, "L0", 40.0, 4.0, 0.0, *box), (4, "glassdoor", 40.0, 2.0, 0.0, 2.0, 0.1, 2.0)]
    o = spark.createDataFrame(rows, "uid long, label string, x double, y double, z double, hx double, hy double, hz double")
    nodes = spark.createDataFrame([(f"n{k}", k, 2.0 * k, 0.0, 0.0) for k in range(25)], "id string, ord long, x double, y double, z double")
    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(24)], "source_id string, target_id string")
    none = spark.createDataFrame([], "uid long, node string")
    drop = ("door", "entrance", "mirror", "glassdoor")
    got = {(r.cluster, r.n, r.diameter) for r in network.areas(o, none, nodes, edges, drop).collect()}
    assert got == {(1, 2, 4.0), (3, 1, 0.0)} and sorted(seen) == ["n0", "n1"]
    d = spark.createDataFrame([(1, 1, 0.0), (2, 3, 1.0)], "i long, j long, dist double")
    assert {tuple(r) for r in clusters.linkage_clusters(spark.createDataFrame([(k,) for k in range(1, 5)], "id long"), d, 2.0).collect()} == {(1, 1), (2, 2), (3, 2), (4, 4)}
