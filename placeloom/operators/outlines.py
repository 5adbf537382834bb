"""Outlines of occupied ground: threshold, closing, 8-connected regions, traced and simplified borders."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placeloom.operators import clouds, graph

#: The eight neighbours, clockwise from the west.
AROUND = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))
SHIFT = 1 << 30


def regions(cells: DataFrame) -> DataFrame:
    """(ix, iy, component): 8-connected components of cells."""
    key = lambda x, y: (F.col(x) + SHIFT) * (2 * SHIFT) + F.col(y) + SHIFT
    own = cells.select("ix", "iy").distinct()
    ahead = F.array(*[F.struct((F.col("ix") + i).alias("nx"), (F.col("iy") + j).alias("ny")) for i, j in ((1, 0), (0, 1), (1, 1), (1, -1))])
    moved = own.select(key("ix", "iy").alias("u"), F.inline(ahead)).select("u", key("nx", "ny").alias("v"))
    known = own.select(key("ix", "iy").alias("v"))
    parts = graph.components(own.select(key("ix", "iy").alias("id")), moved.join(known, "v", "left_semi"))
    return own.withColumn("id", key("ix", "iy")).join(parts, "id").select("ix", "iy", "component")


def trace(cells: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """The outer border of a connected set of cells, by Moore's walk from its lowest cell."""
    start = min(cells, key=lambda c: (c[1], c[0]))
    path, at, back = [start], start, 0  # the cell west of the start is free
    first = None
    while True:
        for k in range(1, 9):
            d = (back + k) % 8
            nxt = (at[0] + AROUND[d][0], at[1] + AROUND[d][1])
            if nxt in cells:
                if first is None:
                    first = (at, d)
                elif (at, d) == first:
                    return path[:-1]
                # come from the last free neighbour before it
                free = AROUND[(d - 1) % 8]
                rel = (at[0] + free[0] - nxt[0], at[1] + free[1] - nxt[1])
                back, at = AROUND.index(rel), nxt
                path.append(at)
                break
        else:
            return path


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker on a closed ring, split at its two farthest vertices; without recursion."""
    n = len(points)
    if n < 4:
        return points
    far = int(np.argmax(((points - points[0]) ** 2).sum(axis=1)))
    keep = np.zeros(n, bool)
    keep[[0, far]] = True
    ring = np.vstack([points, points[:1]])
    todo = [(0, far), (far, n)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        p, q = ring[a], ring[b]
        d = q - p
        rel = ring[a + 1 : b] - p
        length = float(np.hypot(*d))
        off = np.abs(d[0] * rel[:, 1] - d[1] * rel[:, 0]) / length if length else np.hypot(rel[:, 0], rel[:, 1])
        k = int(np.argmax(off))
        if off[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[keep]


def outlines(points: DataFrame, cell: float = 0.25, threshold: float = 0.1, close: float = 0.5, tolerance: float = 0.3, most: int = 5, percentile: float | None = None) -> DataFrame:
    """rank, area_m2, n_vertices, vertices (array of [x, y]) of the largest outlines of a cloud.

    Cells whose likelihood exceeds ``threshold`` are closed by a square and split into regions; the
    ``most`` regions with most cells are traced, each in one task (a region's border is a walk).
    """
    dense = clouds.likelihood(clouds.histogram(points, cell), percentile).where(F.col("p") > threshold)
    size = max(round(close / cell), 1)
    closed = clouds.close_gaps(dense, size // 2) if size >= 2 else dense.select("ix", "iy")
    parts = regions(closed)
    top = clouds.largest_regions(parts, most)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        border = trace(set(zip(group.ix.tolist(), group.iy.tolist())))
        ring = simplify((np.array(border, dtype=float) + 0.5) * cell, tolerance)
        x, y = ring[:, 0], ring[:, 1]
        area = abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2
        return pd.DataFrame({"component": [int(group.component.iloc[0])], "area_m2": [area], "n_vertices": [len(ring)], "vertices": [ring.tolist()]})

    kept = parts.join(top.select("component"), "component", "left_semi")
    found = kept.groupBy("component").applyInPandas(run, "component long, area_m2 double, n_vertices int, vertices array<array<double>>")
    order = W.orderBy(F.desc("area_m2"), "component")  # at most ``most`` rows
    return found.withColumn("rank", F.row_number().over(order)).select("rank", "area_m2", "n_vertices", "vertices")
