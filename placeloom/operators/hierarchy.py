"""Containment trees: parents of polygons, heights, and beam search down a tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placeloom.functions import vector
from placeloom.operators.store import materialize


def clip_area(subject: np.ndarray, clip: np.ndarray) -> float:
    """Area that a polygon shares with a convex one, by cutting it along the clip's edges in turn."""

    def area(p: np.ndarray) -> float:
        x, y = p[:, 0], p[:, 1]
        return float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2

    if len(subject) < 3 or len(clip) < 3:
        return 0.0
    if area(clip) < 0:
        clip = clip[::-1]
    out = subject
    for a, b in zip(clip, np.roll(clip, -1, axis=0)):
        side = (b[0] - a[0]) * (out[:, 1] - a[1]) - (b[1] - a[1]) * (out[:, 0] - a[0])
        points = []
        for k in range(len(out)):
            p, q, s, t = out[k], out[(k + 1) % len(out)], side[k], side[(k + 1) % len(out)]
            if s >= 0:
                points.append(p)
            if (s >= 0) != (t >= 0):
                points.append(p + (q - p) * (s / (s - t)))
        if len(points) < 3:
            return 0.0
        out = np.array(points)
    return abs(area(out))


def box_corners(cx: float, cy: float, hx: float, hy: float, angle: float) -> np.ndarray:
    """Corners of a rectangle turned by ``angle``, counter-clockwise."""
    c, s = np.cos(angle), np.sin(angle)
    local = np.array([[-hx, -hy], [hx, -hy], [hx, hy], [-hx, hy]])
    return local @ np.array([[c, s], [-s, c]]) + [cx, cy]


def turned_overlap(pairs: DataFrame) -> DataFrame:
    """Adds ``shared``: the volume two boxes turned about the vertical share.

    ``pairs``: lx, ly, lz, lhx, lhy, lhz, lyaw and the same with r.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            dz = np.minimum(p.lz + p.lhz, p.rz + p.rhz) - np.maximum(p.lz - p.lhz, p.rz - p.rhz)
            flat = [
                clip_area(box_corners(a.lx, a.ly, a.lhx, a.lhy, a.lyaw), box_corners(a.rx, a.ry, a.rhx, a.rhy, a.ryaw)) if d > 0 else 0.0
                for a, d in zip(p.itertuples(), dz)
            ]
            yield p.assign(shared=np.maximum(dz, 0) * flat)

    return pairs.mapInPandas(run, f"{pairs._jdf.schema().toDDL()}, shared double")


def box_parents(boxes: DataFrame, ratio: float = 0.9, size: float = 64.0) -> DataFrame:
    """(uid, parent) for rectangles: the smallest strictly larger one that covers ``ratio`` of it.

    ``boxes``: uid, x0, y0, x1, y1.  Of equal areas the smaller uid; without a parent null.  Boxes
    are met in grid cells, and a pair counts in the cell of its common lower corner only.
    """

    def placed(side: str) -> DataFrame:
        spans = [F.sequence(F.floor(F.col(f"{c}0") / size).cast("long"), F.floor(F.col(f"{c}1") / size).cast("long")) for c in "xy"]
        cells = F.flatten(F.transform(spans[0], lambda i: F.transform(spans[1], lambda j: F.struct(i.alias("cx"), j.alias("cy")))))
        area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
        return boxes.select(F.struct("uid", "x0", "y0", "x1", "y1", area.alias("area")).alias(side), F.inline(cells))

    pairs = placed("l").join(placed("r"), ["cx", "cy"]).where("r.area > l.area")
    low = {c: F.greatest(f"l.{c}0", f"r.{c}0") for c in "xy"}
    width = {c: F.least(f"l.{c}1", f"r.{c}1") - low[c] for c in "xy"}
    pairs = pairs.where((F.floor(low["x"] / size).cast("long") == F.col("cx")) & (F.floor(low["y"] / size).cast("long") == F.col("cy")))
    pairs = pairs.where((width["x"] > 0) & (width["y"] > 0) & (width["x"] * width["y"] >= ratio * F.col("l.area")))
    best = pairs.groupBy(F.col("l.uid").alias("uid")).agg(F.min_by("r.uid", F.struct("r.area", "r.uid")).alias("parent"))
    return boxes.select("uid").join(best, "uid", "left")


def polygon_parents(polygons: DataFrame, ratio: float = 0.9, size: float = 64.0) -> DataFrame:
    """As ``box_parents`` for convex parents of any shape: bounding boxes propose, exact clipping decides.

    ``polygons``: uid, ring (array of structs x, y, closed), area.
    """
    bound = polygons.select("uid", "ring", "area", *[F.expr(f"array_min(transform(ring, p -> p.{c}))").alias(f"{c}0") for c in "xy"], *[F.expr(f"array_max(transform(ring, p -> p.{c}))").alias(f"{c}1") for c in "xy"])
    spans = [F.sequence(F.floor(F.col(f"{c}0") / size).cast("long"), F.floor(F.col(f"{c}1") / size).cast("long")) for c in "xy"]
    cells = F.flatten(F.transform(spans[0], lambda i: F.transform(spans[1], lambda j: F.struct(i.alias("cx"), j.alias("cy")))))
    side = lambda s: bound.select(F.struct("uid", "ring", "area", "x0", "y0", "x1", "y1").alias(s), F.inline(cells))
    pairs = side("l").join(side("r"), ["cx", "cy"]).where("r.area > l.area")
    low = {c: F.greatest(f"l.{c}0", f"r.{c}0") for c in "xy"}
    pairs = pairs.where((F.floor(low["x"] / size).cast("long") == F.col("cx")) & (F.floor(low["y"] / size).cast("long") == F.col("cy")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        points = lambda ring: np.array([(p["x"], p["y"]) for p in ring])[:-1]
        for f in frames:
            shared = [clip_area(points(a), points(b)) for a, b in zip(f.child_ring, f.parent_ring)]
            yield f.assign(shared=shared)[["child", "parent", "child_area", "parent_area", "shared"]].astype({"shared": "float64"})

    flat = pairs.select(
        F.col("l.uid").alias("child"), F.col("r.uid").alias("parent"), F.col("l.area").alias("child_area"), F.col("r.area").alias("parent_area"), F.col("l.ring").alias("child_ring"), F.col("r.ring").alias("parent_ring")
    )
    kind = dict(polygons.dtypes)["uid"]
    tested = flat.mapInPandas(run, f"child {kind}, parent {kind}, child_area double, parent_area double, shared double")
    best = tested.where(F.col("shared") >= ratio * F.col("child_area")).groupBy(F.col("child").alias("uid")).agg(F.min_by("parent", F.struct("parent_area", "parent")).alias("parent"))
    return polygons.select("uid").join(best, "uid", "left")


def heights(nodes: DataFrame) -> DataFrame:
    """(uid, height): 0 for a leaf, else one more than the highest child.  ``nodes``: uid, parent (null for roots).

    One round for each level from the leaves up.
    """
    found = materialize(nodes.select("uid", F.lit(0).alias("height")), "heights")
    front = found
    while True:
        up = front.join(nodes, "uid").where("parent IS NOT NULL").groupBy(F.col("parent").alias("uid")).agg((F.max("height") + 1).alias("height"))
        up = materialize(up, "heights")
        if up.limit(1).count() == 0:
            return found
        found = materialize(found.unionByName(up).groupBy("uid").agg(F.max("height").alias("height")), "heights")
        front = up.join(nodes.select("uid"), "uid", "left_semi")


def score(query: list[float], robot: tuple[float, float, float], beta: float, sigma: float) -> Column:
    """beta * similarity + (1 - beta) * nearness of a node with embedding and x, y, z (no position: nearness 0)."""
    q = F.array(*[F.lit(float(v)) for v in query])
    d = vector.distance(*[(F.col(c), F.lit(float(v))) for c, v in zip("xyz", robot)])
    return beta * vector.dot("embedding", q) + (1 - beta) * F.coalesce(vector.proximity(d, sigma), F.lit(0.0))


def descend(nodes: DataFrame, query: list[float], robot: tuple[float, float, float], beta: float = 0.9, sigma: float = 10.0, k: int = 5, strict_children: bool = False) -> DataFrame:
    """The best ``k`` areas found by beam search from the roots: uid, score, rank.

    ``nodes``: uid, level, parent, ord, x, y, z, embedding.  The search starts at the children of
    site nodes, or at all nodes without a parent if there is no site (with ``strict_children`` a
    site without children gives nothing).  At each level the children of all kept nodes compete
    together; nodes without an embedding are passed over; equal scores go by ord.
    """
    site = nodes.where("level = 'site'").select(F.col("uid").alias("parent"))
    has_site = site.limit(1).count() > 0
    level = nodes.join(site, "parent", "left_semi") if has_site else nodes.where("parent IS NULL")
    if has_site and not strict_children and level.limit(1).count() == 0:
        level = nodes.where("parent IS NULL AND level <> 'site'")
    for _ in range(64):
        ranked = level.where("embedding IS NOT NULL").withColumn("score", score(query, robot, beta, sigma)).orderBy(F.desc("score"), "ord").limit(k)
        ranked = materialize(ranked.select("uid", "level", "score", "ord"), "descend")
        rest = ranked.where("level <> 'area'").limit(1).count()
        if rest == 0:
            return ranked.select("uid", "score", F.row_number().over(W.orderBy(F.desc("score"), "ord")).alias("rank"))
        level = nodes.join(ranked.select(F.col("uid").alias("parent")), "parent", "left_semi")
    raise RuntimeError("the tree is deeper than 64 levels")
