import math
import random

import pytest
from pyspark.sql import functions as F

from placeloom.operators import resolve, spatial
from placeloom.operators import turned as turned_boxes


def boxes(spark, n, seed, session):
    rnd = random.Random(seed)
    rows = [(k, session, k, *[rnd.uniform(0, 3) for _ in range(3)], *[rnd.uniform(0.05, 0.5) for _ in range(3)], rnd.uniform(0, 6.3), f"L{k % 4}", [f"L{k % 4}"]) for k in range(n)]
    return spark.createDataFrame(rows, "uid long, session string, ord long, x double, y double, z double, hx double, hy double, hz double, yaw double, label string, voted array<string>")


def test_cells_follow_the_boxes(spark):
    """Cells of 4 around boxes of 0.1 to 1 compare nearly all pairs; they are made finer, but not where boxes are large."""
    b = boxes(spark, 50, 1, "a")
    half = [F.col(f"h{c}") for c in "xyz"]
    assert spatial.finest(b, half, 4.0) < 1
    assert spatial.finest(b.withColumns({f"h{c}": F.lit(9.0) for c in "xyz"}), half, 4.0) == 4.0
    assert spatial.finest(b.limit(0), half, 4.0) <= 4.0


@pytest.mark.parametrize("turned", [False, True])
@pytest.mark.parametrize(("trust", "gate"), [(0.5, 0.5), (0.1, 0.0), (0.9, 1.5), (0.0, 0.3)])
def test_candidates_are_those_of_all_pairs(spark, turned, trust, gate):
    a, b = boxes(spark, 60, 2, "a"), boxes(spark, 60, 3, "b")
    if not turned:
        a, b = a.drop("yaw"), b.drop("yaw")
    pairs = a.select(F.struct(*a.columns).alias("l")).crossJoin(b.select(F.struct(*b.columns).alias("r")))
    pairs = pairs.withColumn("shared", spatial.shared_volume("l", "r", turned)).withColumn("ios", spatial.ios())
    both = resolve.half_diagonal("l") + resolve.half_diagonal("r")
    d = F.sqrt(sum((F.col(f"l.{c}") - F.col(f"r.{c}")) ** 2 for c in "xyz"))
    want = pairs.where((d <= both) & ((F.col("ios") >= trust) | ((d / (both + 1e-9) < gate) & resolve.labels_agree())))
    want = {tuple(r) for r in want.select("l.uid", "r.uid").collect()}
    assert {tuple(r)[:2] for r in resolve.candidates(a, b, trust, gate).collect()} == want and want


@pytest.mark.parametrize("turned", [False, True])
def test_overlap_pairs_are_those_of_all_pairs(spark, turned):
    a = boxes(spark, 80, 4, "a") if turned else boxes(spark, 80, 4, "a").drop("yaw")
    pairs = a.select(F.struct(*a.columns).alias("l")).crossJoin(a.select(F.struct(*a.columns).alias("r"))).where("l.uid < r.uid")
    pairs = pairs.withColumn("shared", spatial.shared_volume("l", "r", turned)).withColumn("ios", spatial.ios()).where("ios >= 0.2")
    assert {tuple(r) for r in resolve.overlap_pairs(a, 0.2).select("u", "v").collect()} == {tuple(r) for r in pairs.select("l.uid", "r.uid").collect()}


@pytest.mark.parametrize("rows", [60, 100_000])
@pytest.mark.parametrize("share", [0.5, 0.8])
def test_turned_pairs_by_arrays_are_those_of_all_pairs(spark, monkeypatch, share, rows):
    a = boxes(spark, 250, 6, "a").withColumn("uid", F.col("uid").cast("string"))
    more = a.where("ord % 5 = 0")
    # copies, the same place turned by a right angle, a little shift, boxes in boxes, one flat, one without a yaw, one far off
    a = a.unionByName(more.withColumn("uid", F.concat(F.lit("0"), "uid"))).unionByName(more.withColumns({"uid": F.concat("uid", F.lit("t")), "yaw": F.col("yaw") + math.pi / 2}))
    a = a.unionByName(more.withColumns({"uid": F.concat("uid", F.lit("s")), "x": F.col("x") + 0.1, "hx": F.col("hx") / 3, "yaw": -F.col("yaw")}))
    a = a.unionByName(more.limit(1).withColumns({"uid": F.lit("flat"), "hz": F.lit(0.0)})).unionByName(more.limit(1).withColumns({"uid": F.lit("none"), "yaw": F.lit(None).cast("double")}))
    a = a.unionByName(more.limit(1).withColumns({"uid": F.lit("far"), "x": F.lit(1e7)})).cache()
    pairs = a.select(F.struct(*a.columns).alias("l")).crossJoin(a.select(F.struct(*a.columns).alias("r"))).where("l.uid < r.uid")
    pairs = pairs.withColumn("shared", spatial.shared_volume("l", "r", True)).where("shared > 0").withColumn("ios", spatial.ios()).where(F.col("ios") >= share)
    want = {(x.u, x.v): x.ios for x in pairs.select(F.col("l.uid").alias("u"), F.col("r.uid").alias("v"), "ios").collect()}
    monkeypatch.setattr(spatial, "boxes_overlapping", lambda *a, **k: pytest.fail("every pair of touching boxes is joined"))
    monkeypatch.setattr(turned_boxes, "BLOCK", 1000)
    found = resolve.overlap_pairs(a, share) if rows > 60 else turned_boxes.overlap_pairs(a, share, rows=rows)
    got = {(x.u, x.v): x.ios for x in found.collect()}
    assert len(got) == found.count() and got == pytest.approx(want, abs=1e-9) and len(got) > 50
