"""Hand-checkable cases and invariants of the scene operators."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from placeloom.functions import geo
from placeloom.functions import tags as T
from placeloom.operators import align, clouds, clusters, graph, hierarchy, resolve, spatial, tracks
from placeloom.plans import planner


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_nested_box(spark):
    z = [F.lit(0.0)] * 3
    small, large = [F.lit(1.0)] * 3, [F.lit(2.0)] * 3
    shared = geo.overlap(z, small, z, large)
    r = one(spark, ios=geo.over_smaller(shared, geo.volume(small), geo.volume(large)), iou=geo.over_union(shared, geo.volume(small), geo.volume(large)))
    assert (r.ios, r.iou) == (1.0, 8 / 64)


def test_touching_boxes_share_nothing(spark):
    h = [F.lit(1.0)] * 3
    assert one(spark, v=geo.overlap([F.lit(0.0)] * 3, h, [F.lit(0.0), F.lit(0.0), F.lit(2.0)], h)).v == 0


def test_square_turned_by_45_degrees():
    a, b = hierarchy.box_corners(0, 0, 0.5, 0.5, 0), hierarchy.box_corners(0, 0, 0.5, 0.5, math.pi / 4)
    assert hierarchy.clip_area(a, b) == pytest.approx(2 * math.sqrt(2) - 2)


def test_gate(spark):
    gate = ([F.lit(0.0)] * 3, None, [F.lit(0.1), F.lit(1.0), F.lit(1.0)], 0.3)
    seg = lambda y: ([F.lit(-1.0), F.lit(y), F.lit(0.0)], [F.lit(1.0), F.lit(y), F.lit(0.0)])
    r = one(spark, a=geo.crosses_gate(*seg(0.0), *gate), b=geo.crosses_gate(*seg(1.4), *gate), c=geo.crosses_gate([F.lit(0.0), F.lit(-5.0), F.lit(0.0)], [F.lit(0.0), F.lit(5.0), F.lit(0.0)], *gate))
    assert (r.a, r.b, r.c) == (True, False, False)


def test_sim3_composes():
    a = geo.Sim3(2.0, (0, -1, 0, 1, 0, 0, 0, 0, 1), (1, 2, 3))
    b = geo.Sim3(0.5, (1, 0, 0, 0, 0, -1, 0, 1, 0), (4, 5, 6))
    p = [0.3, -0.7, 1.1]
    assert (a @ b).of(p) == pytest.approx(a.of(b.of(p)))
    assert a.inverse().of(a.of(p)) == pytest.approx(p)


def test_tags(spark):
    tags = lambda **k: F.create_map(*[F.lit(x) for kv in k.items() for x in kv])
    r = one(
        spark,
        road=T.disposition(tags(highway="primary", area="yes"), F.lit(100.0), 30, 1000),
        power=T.disposition(tags(power="x"), F.lit(100.0), 30, 1000),
        both=T.disposition(tags(power="x", building="yes"), F.lit(100.0), 30, 1000),
        hall=T.classify(F.create_map(F.lit("building"), F.lit("dormitory"), F.lit("building:levels"), F.lit("3"))),
    )
    assert (r.road, r.power, r.both) == ("pathway", "infrastructure", "hierarchy")
    assert (r.hall.role, r.hall.category, r.hall.function, r.hall.desc) == ("structure", "building", "residential", "dormitory building, 3 levels")


def test_voxels(spark):
    rows = [(0.01, 0.0, 0.0), (0.09, 0.0, 0.0), (-0.01, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "x double, y double, z double").withColumns({c: F.lit(5) for c in "rgb"})
    found = {r.ix: (r.n, r.x) for r in clouds.voxel_mean(df, 0.1).collect()}
    assert found[0] == (2, pytest.approx(0.05)) and found[-1][0] == 1


def obj(uid, x, conf=0.5, label="a", h=0.5, session="A"):
    return (uid, session, uid, float(x), 0.0, 0.0, h, h, h, label, conf, 1)


SCHEMA = "uid long, session string, ord long, x double, y double, z double, hx double, hy double, hz double, label string, conf double, support long"
VOTES = "uid long, label string, n long, pos int"


def test_reconcile_chain_and_fresh_uids(spark):
    a = spark.createDataFrame([obj(3, 0.0, 0.4), obj(7, 0.6, 0.9)], SCHEMA)
    b = spark.createDataFrame([obj(0, 0.3, 0.5, session="B"), obj(1, 50.0, 0.5, session="B")], SCHEMA)
    m = resolve.reconcile(a, b, spark.createDataFrame([], VOTES), trust=0.3)
    found = {r.uid: r for r in m.collect()}
    assert set(found) == {7, 8} and found[7].kind == "fused" and found[7].support == 3 and found[8].kind == "only_b"


@pytest.mark.parametrize("side", ["a", "b"])
def test_reconcile_with_an_empty_side(spark, side):
    full, none = spark.createDataFrame([obj(2, 0.0), obj(5, 9.0)], SCHEMA), spark.createDataFrame([], SCHEMA)
    a, b = (none, full) if side == "a" else (full, none)
    m = resolve.reconcile(a, b, spark.createDataFrame([], VOTES))
    assert sorted(r.uid for r in m.collect()) == ([0, 1] if side == "a" else [2, 5])


def brute_suppress(rows, share):
    vol = lambda r: 8 * r[6] * r[7] * r[8]
    def inter(p, q):
        v = 1.0
        for k in range(3):
            v *= max(0, min(p[3 + k] + p[6 + k], q[3 + k] + q[6 + k]) - max(p[3 + k] - p[6 + k], q[3 + k] - q[6 + k]))
        return v
    keep = [True] * len(rows)
    for i, p in enumerate(rows):
        keep[i] = not any(keep[j] and j != i and vol(q) > vol(p) and inter(p, q) >= share * vol(p) for j, q in enumerate(rows))
    return {r[0] for r, k in zip(rows, keep) if k}


def test_suppress_contained_follows_input_order(spark):
    rng = np.random.default_rng(4)
    rows = [obj(k, rng.uniform(0, 3), h=float(rng.uniform(0.2, 1.5))) for k in range(40)]
    got = {r.uid for r in resolve.suppress_contained(spark.createDataFrame(rows, SCHEMA), 0.7).collect()}
    assert got == brute_suppress(rows, 0.7)


def test_motion(spark):
    rows = [("p", k, float(x), 0.0, 0.0) for k, x in enumerate([0, 0.1, 0.2, 5.2, 5.3])] + [("q", 0, 0.0, 0.0, 0.0), ("q", 1, 9.0, 0.0, 0.0)]
    m = {r.track: r.motion for r in tracks.motion(spark.createDataFrame(rows, "track string, seq int, x double, y double, z double"), ["track"]).collect()}
    assert m["p"] == pytest.approx(0.1) and m["q"] == 0


def test_densify_and_resample(spark):
    line = spark.createDataFrame([("a", 0, 0.0, 0.0, 0.0), ("a", 1, 25.0, 0.0, 0.0), ("b", 0, 0.0, 0.0, 0.0), ("b", 1, 4.0, 0.0, 0.0)], "line string, seq int, x double, y double, z double")
    d = sorted(r.x for r in tracks.densify(line, ["line"], 10.0).where("line = 'a'").collect())
    assert d == pytest.approx([0, 25 / 3, 50 / 3, 25])
    r = tracks.resample(line, ["line"], 10.0)
    assert sorted(x.x for x in r.where("line = 'a'").collect()) == [0, 10, 20]
    assert sorted(x.x for x in r.where("line = 'b'").collect()) == [0, 4]


def test_paths(spark):
    nodes = spark.createDataFrame([("a", 0.0, 0.0, 0.0), ("b", 3.0, 0.0, 0.0), ("c", 3.0, 4.0, 0.0), ("z", 9.0, 9.0, 9.0)], "id string, x double, y double, z double")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "a")], "source_id string, target_id string")
    tree = graph.shortest(graph.weighted(edges, nodes), spark.createDataFrame([("a",)], "src string"))
    assert {r.node: r.dist for r in tree.collect()} == {"a": 0, "b": 3, "c": 7}
    path = graph.path_nodes(tree, spark.createDataFrame([("a", "c"), ("a", "z")], "src string, target string"))
    assert [r.node for r in path.orderBy("step").collect()] == ["c", "b", "a"]


@settings(max_examples=30, deadline=None)
@given(st.integers(2, 12), st.integers(0, 10_000), st.sampled_from(["complete", "average", "single"]))
def test_linkage_stops_at_the_threshold(n, seed, linkage):
    p = np.random.default_rng(seed).uniform(0, 10, (n, 2))
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    label = clusters.agglomerate(d, 4.0, linkage)
    if linkage == "complete":
        assert all(d[i, j] < 4 for i in range(n) for j in range(n) if label[i] == label[j])
    if linkage == "single":
        assert all(label[i] == label[j] for i in range(n) for j in range(n) if d[i, j] < 4)


def test_alignment_recovers_a_shift(spark):
    rng = np.random.default_rng(1)
    p = rng.uniform(-6, 6, (400, 3)) * [1, 0.6, 0.2]
    q = p + [1.3, -0.9, 0]
    df = lambda a: spark.createDataFrame([tuple(map(float, r)) for r in a], "x double, y double, z double")
    r = align.align(df(p), df(q), span=2.4).first()
    assert (r.tx, r.ty) == (pytest.approx(1.3, abs=0.15), pytest.approx(-0.9, abs=0.15)) and abs(math.remainder(r.yaw, 2 * math.pi)) < 0.1


def test_order_is_cut_at_stop():
    assert planner.settle([5, 7, "STOP", 9], {5, 7, 9}) == [5, 7]
    assert planner.order_route([{"uid": 4, "score": 1.0}], lambda c: 1 / 0) == [4]


def test_nearest_of_no_targets_is_empty(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "uid long, x double, y double, z double")
    t = spark.createDataFrame([], "id string, ord long, x double, y double, z double")
    assert spatial.nearest(p, t, "uid", "id", "ord").count() == 0


def test_outlines(spark):
    from placeloom.operators import outlines

    block = [(x + 0.5, y + 0.5, 0.0) for x in range(10) for y in range(6)] + [(x + 0.5, 40.5, 0.0) for x in range(3)]
    df = spark.createDataFrame(block, "x double, y double, z double")
    r = outlines.outlines(df, cell=1.0, close=1.0, tolerance=0.3).orderBy("rank").collect()
    assert (r[0].n_vertices, r[0].area_m2, len(r)) == (4, 45.0, 2)
    ring = outlines.trace({(0, 0), (1, 0), (2, 0), (0, 1), (2, 1), (0, 2), (1, 2), (2, 2)})
    assert sorted(ring) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1), (2, 2)]


def test_ranks_cover_ranges(spark):
    from placeloom.operators import ranking

    df = spark.createDataFrame([((k * 37) % 101,) for k in range(101)], "v int")
    assert all(r.rank == r.v + 1 for r in ranking.numbered(df, "v").collect())


def brute_distances(links):
    """All shortest distances of a small graph, by repeated relaxation."""
    nodes = sorted({u for u, _, _ in links})
    d = {(s, n): 0.0 if s == n else float("inf") for s in nodes for n in nodes}
    for _ in nodes:
        for u, v, w in links:
            for s in nodes:
                d[s, v] = min(d[s, v], d[s, u] + w)
    return {k: v for k, v in d.items() if v < float("inf")}


def test_both_ways_of_finding_paths_equal_brute_force(spark):
    import random

    from placeloom.operators import graph

    rng = random.Random(4)
    one = [(f"n{rng.randint(0, 30):02d}", f"n{rng.randint(0, 30):02d}", float(rng.choice([0, 1, 2, 5]))) for _ in range(45)]
    links = [x for u, v, w in one for x in ((u, v, w), (v, u, w))]
    low = {}
    for u, v, w in links:
        low[u, v] = min(low.get((u, v), w), w)
    links = [(u, v, w) for (u, v), w in low.items() if u != v]
    want = {k: v for k, v in brute_distances(links).items() if k[0] in ("n01", "n07", "n20")}
    edges = spark.createDataFrame(links, "u string, v string, w double")
    sources = spark.createDataFrame([("n01",), ("n07",), ("n20",), (None,)], "src string")
    for sizes in ({"component_nodes": 1000, "chunk": 2}, {"component_nodes": 0}):
        tree = graph.shortest(edges, sources, **sizes).collect()
        assert {(r.src, r.node): r.dist for r in tree} == want
        rows = spark.createDataFrame([tuple(r) for r in tree], "src string, node string, dist double, pred string")
        ends = rows.select("src", F.col("node").alias("target"))
        steps = {}
        for r in graph.path_nodes(rows, ends).collect():
            steps.setdefault((r.src, r.target), []).append((r.step, r.node))
        for (s, t), path in steps.items():
            names = [n for _, n in sorted(path)][::-1]
            assert names[0] == s and names[-1] == t and [k for k, _ in sorted(path)] == list(range(len(path)))
            assert sum(low[a, b] for a, b in zip(names, names[1:])) == want[s, t]
        assert set(steps) == set(want)
    few = graph.shortest(edges, sources, spark.createDataFrame([("n07",), ("zz",)], "node string"))
    assert {(r.src, r.node): r.dist for r in few.collect()} == {k: v for k, v in want.items() if k[1] == "n07"}
    assert graph.shortest(edges.limit(0), sources).count() == 3  # every source reaches itself


def test_components_at_once_and_by_rounds(spark):
    import random

    from placeloom.operators import graph

    rng = random.Random(2)
    links = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)]
    nodes, edges = spark.range(85), spark.createDataFrame(links, "u long, v long")
    found = [sorted((r.id, r.component) for r in graph.components(nodes, edges, at_once=n).collect()) for n in (1000, 0)]
    assert found[0] == found[1] and len(found[0]) == 85


def test_hash_embeddings_are_the_agreed_ones():
    import hashlib

    import numpy as np

    from placeloom.plans import planner

    v = planner.HashEncoder().encode(["L1", ""])
    want = np.random.default_rng(int.from_bytes(hashlib.sha256(b"L1").digest()[:8], "big")).standard_normal(512).astype(np.float32)
    assert v.shape == (2, 512) and np.allclose(v[0], want / np.linalg.norm(want)) and abs(np.linalg.norm(v[1]) - 1) < 1e-6


def test_turned_boxes_equal_clipping(spark, sf_dir):
    """Turned overlap against polygon clipping, pair by pair; candidates and overlaps against all pairs of a map."""
    import random

    from placeloom.plans import registry, scene

    rng = random.Random(1)
    names = [f"{s}{c}" for s in "lr" for c in ("x", "y", "z", "hx", "hy", "hz", "yaw")]
    box = lambda: [*[rng.uniform(-2, 2) for _ in range(3)], *[rng.uniform(0.2, 2) for _ in range(3)], rng.choice([0.0, math.pi / 2, math.pi / 4, rng.uniform(-7, 7)])]
    rows = [(*box(), *box()) for _ in range(500)] + [(0.0, 0.0, 0.0, 0.5, 0.5, 0.5, t, 0.0, 0.0, 0.0, 0.5, 0.5, 0.5, u) for t, u in ((0.0, math.pi / 4), (0.3, 0.3), (0.0, 0.0))]
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], ", ".join(f"{n} double" for n in names))
    side = lambda s: ([F.col(s + c) for c in "xyz"], [F.col(f"{s}h{c}") for c in "xyz"], F.col(s + "yaw"))
    got = hierarchy.turned_overlap(df.withColumn("own", geo.turned_overlap(*side("l"), *side("r")))).collect()
    assert max(abs(r.own - r.shared) for r in got) < 1e-9 and abs(got[-3].own - (2 * math.sqrt(2) - 2)) < 1e-9

    o = [r.asDict() for r in scene.objects(spark, sf_dir).collect()]
    for r in o:
        r["yaw"] = 2 * math.pi * abs(float(r["embedding"][7]))

    def share(a, b):
        dz = min(a["z"] + a["hz"], b["z"] + b["hz"]) - max(a["z"] - a["hz"], b["z"] - b["hz"])
        if dz <= 0:
            return 0.0
        flat = hierarchy.clip_area(*[hierarchy.box_corners(r["x"], r["y"], r["hx"], r["hy"], r["yaw"]) for r in (a, b)])
        return dz * flat / (8 * min(r["hx"] * r["hy"] * r["hz"] for r in (a, b)))

    reach = lambda r: math.sqrt(r["hx"] ** 2 + r["hy"] ** 2 + r["hz"] ** 2)
    near = [(a, b) for a in o for b in o if a["uid"] < b["uid"] and math.dist([a[c] for c in "xyz"], [b[c] for c in "xyz"]) <= reach(a) + reach(b)]
    want = {(a["uid"], b["uid"]): s for a, b in near if (s := share(a, b)) >= 0.5}
    pairs = {(r.u, r.v): r.ios for r in registry.queries()["j3_turned_overlap_pairs"](spark, sf_dir).collect()}
    assert pairs.keys() == want.keys() and all(abs(pairs[k] - want[k]) < 1e-3 for k in want) and want
    joined = {(r.a_uid, r.b_uid) for r in registry.queries()["j2_turned_candidates"](spark, sf_dir).collect()}
    across = {tuple(sorted(k, key=lambda u: u % 2)) for k in want if (k[0] - k[1]) % 2}  # even ids are session S0
    assert across <= joined
    merged = registry.queries()["e1_turned_reconcile"](spark, sf_dir).collect()
    assert sum(r.n_members for r in merged) == len(o) and all(r["yaw"] is not None and r["size"] == 64 for r in merged)


def test_rounded_sums_make_no_further_part(spark):
    """Steps of 14 take 7 parts of 2, wherever the sum stands; longer ones take 8, tiny ones 1."""
    starts = [115 + 0.037 * k for k in range(300)]
    assert any(x + 14.0 - x > 14 for x in starts) and any(x + 14.0 - x < 14 for x in starts)
    rows = [(3 + k, seq, x + 14.0 * seq, 0.0, 0.0) for k, x in enumerate(starts) for seq in (0, 1)]
    rows += [(2, 0, 1000.0, 0.0, 0.0), (2, 1, 1014.000000001, 0.0, 0.0), (2, 2, 1014.0000000010001, 0.0, 0.0)]
    points = spark.createDataFrame(rows, "session int, seq int, x double, y double, z double")
    n = {(r.session, r.seq): r["count"] for r in tracks.densify(points, ["session"], 2.0).groupBy("session", "seq").count().collect()}
    assert {n[3 + k, 1] for k in range(300)} == {7} and n[2, 1] == 8 and n[2, 2] == 1
