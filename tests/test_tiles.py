import math
import random

import pytest

from placeloom.operators import spatial


def brute(probes, targets):
    """key -> (target, distance), the smallest ord of equals."""
    out = {}
    for k, *p in probes:
        d, _, t = min((math.sqrt((p[0] - q[0]) * (p[0] - q[0]) + (p[1] - q[1]) * (p[1] - q[1]) + (p[2] - q[2]) * (p[2] - q[2])), o, t) for t, o, *q in targets)
        out[k] = (t, d)
    return out


@pytest.mark.parametrize(("seed", "flat"), [(1, True), (2, False)])
def test_nearest_equals_all_pairs(spark, seed, flat):
    """Many places on a coarse grid, so that distances tie and targets stand on each other; one probe is farther off than doubling radii reach."""
    rnd = random.Random(seed)
    spot = lambda step: (rnd.randrange(40) / step, rnd.randrange(40) / step, 0.0 if flat else rnd.randrange(20) / step)
    dense = [(f"t{rnd.random()}", 5000 - k, *spot(4)) for k in range(1500)]
    targets = dense + [(f"far{k}", k, 500.0 + k, -300.0, 0.0) for k in range(20)]
    probes = [(k, *spot(8)) for k in range(700)] + [(700, 1e15, 3.0, 0.0), (701, 200.0, 200.0, 0.0)]
    p = spark.createDataFrame(probes + [(900, None, 0.0, 0.0), (901, float("nan"), 0.0, 0.0)], "uid long, x double, y double, z double")
    t = spark.createDataFrame(targets + [("none", -1, None, 0.0, 0.0)], "id string, ord long, x double, y double, z double")
    want = brute(probes, targets)
    got = {r.uid: (r.id, r.distance) for r in spatial.nearest(p, t, "uid", "id", "ord").collect()}
    assert got == want
    rows = spatial.nearest(p, t, "uid", "id", "ord", size=60, chunk=50).collect()
    assert {r.uid: (r.id, r.distance) for r in rows} == want and len(rows) == len(want)
