"""Point clouds and grids: voxel aggregation, histograms, blur, outlines' cells, ground planes."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placeloom.functions import geo
from placeloom.operators.store import materialize

XYZ = ("x", "y", "z")


def voxel_cells(size: float) -> list[Column]:
    return [geo.voxel(F.col(c), size).alias(f"i{c}") for c in XYZ]


def voxel_mean(points: DataFrame, size: float) -> DataFrame:
    """Mean position and truncated mean colour by voxel, with the number of points."""
    return points.groupBy(*voxel_cells(size)).agg(
        *[F.avg(c).alias(c) for c in XYZ], *[F.floor(F.avg(c)).cast("int").alias(c) for c in "rgb"], F.count("*").alias("n")
    )


def voxel_first(points: DataFrame, size: float) -> DataFrame:
    """The first point of each voxel by ``seq``."""
    return points.groupBy(*voxel_cells(size)).agg(*[F.min_by(c, "seq").alias(c) for c in (*XYZ, *"rgb")])


def accumulate(old: DataFrame, new: DataFrame, size: float) -> DataFrame:
    """Old voxel centres re-enter as points of weight one beside the new points."""
    columns = [*XYZ, *"rgb"]
    return voxel_mean(old.select(*columns).unionByName(new.select(*columns)), size)


def histogram(points: DataFrame, size: float, low: float | None = None, high: float | None = None) -> DataFrame:
    """Counts by ground cell (ix, iy); ``low`` and ``high`` keep an inclusive band of z."""
    band = points if low is None else points.where(F.col("z").between(low, high))
    return band.groupBy(*voxel_cells(size)[:2]).agg(F.count("*").alias("n"))


def kernel(sigma: float, truncate: float = 4.0) -> list[tuple[int, float]]:
    """Offsets and weights of a sampled Gaussian, summing to one."""
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [(k - r, x / sum(w)) for k, x in enumerate(w)]


def blur(cells: DataFrame, sigma: float, value: str = "n") -> DataFrame:
    """Separable Gaussian blur of sparse cells (ix, iy, value), zero outside; cells that get nothing have no row."""
    taps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in kernel(sigma)])
    out = cells.select("ix", "iy", F.col(value).cast("double").alias("v"))
    for axis in ("ix", "iy"):
        other = "iy" if axis == "ix" else "ix"
        out = out.select(axis, other, "v", F.inline(taps)).groupBy((F.col(axis) + F.col("k")).alias(axis), other).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return out.select("ix", "iy", F.col("v").alias(value))


def likelihood(cells: DataFrame, percentile: float | None = None, value: str = "n") -> DataFrame:
    """Values over the largest, or over a percentile of the positive ones, clipped to [0, 1]."""
    top = cells.agg((F.max(value) if percentile is None else F.percentile(F.when(F.col(value) > 0, F.col(value)), percentile / 100)).alias("t")).first()[0]
    return cells.withColumn("p", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(value) / F.lit(float(top or 1.0)))))


def dense_points(points: DataFrame, size: float, percentile: float) -> DataFrame:
    """Points whose cell count reaches the percentile of the points' own cell counts."""
    counted = points.withColumns({"ix": geo.voxel(F.col("x"), size), "iy": geo.voxel(F.col("y"), size)})
    cells = counted.groupBy("ix", "iy").agg(F.count("*").alias("density"))
    joined = materialize(counted.join(cells, ["ix", "iy"]), "dense")
    cut = joined.agg(F.percentile("density", percentile / 100)).first()[0]
    return joined.where(F.col("density") >= cut).drop("ix", "iy")


def dilate(cells: DataFrame, radius: int) -> DataFrame:
    """Cells within a square of ``radius`` around any cell."""
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    around = F.flatten(F.transform(steps, lambda i: F.transform(steps, lambda j: F.struct((F.col("ix") + i).alias("ix"), (F.col("iy") + j).alias("iy")))))
    return cells.select(F.inline(around)).distinct()


def erode(cells: DataFrame, radius: int) -> DataFrame:
    """Cells whose whole square of ``radius`` is set."""
    full = (2 * radius + 1) ** 2
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    around = F.flatten(F.transform(steps, lambda i: F.transform(steps, lambda j: F.struct((F.col("ix") + i).alias("ix"), (F.col("iy") + j).alias("iy")))))
    return cells.select("ix", "iy").distinct().select(F.inline(around)).groupBy("ix", "iy").agg(F.count("*").alias("c")).where(F.col("c") == full).select("ix", "iy")


def close_gaps(cells: DataFrame, radius: int) -> DataFrame:
    """Morphological closing by a square."""
    return erode(dilate(cells.select("ix", "iy"), radius), radius)


def plane_candidates(points: DataFrame, tries: int, seed: int) -> list[tuple[float, float, float, float]]:
    """Unit normals and offsets of planes through ``tries`` triples of a hash-picked sample of points."""
    picked = points.orderBy(F.xxhash64(F.lit(seed), *XYZ)).limit(3 * tries).select(*XYZ).collect()  # bounded by tries
    out = []
    for k in range(0, len(picked) - 2, 3):
        a, b, c = (np.array([p.x, p.y, p.z]) for p in picked[k : k + 3])
        n = np.cross(b - a, c - a)
        if (length := float(np.linalg.norm(n))) > 1e-9:
            n = n / length
            n = n if n[2] >= 0 else -n
            out.append((float(n[0]), float(n[1]), float(n[2]), float(-n @ a)))
    return out


def ground_plane(points: DataFrame, tolerance: float = 0.1, tries: int = 300, seed: int = 0) -> DataFrame:
    """nx, ny, nz, d, inliers of the candidate plane with most points within ``tolerance``, the first of equals."""
    planes = plane_candidates(points, tries, seed)
    counts = [F.count_if(F.abs(a * F.col("x") + b * F.col("y") + c * F.col("z") + d) <= tolerance).alias(f"c{k}") for k, (a, b, c, d) in enumerate(planes)]
    spark = points.sparkSession
    if not counts:
        return spark.createDataFrame([], "nx double, ny double, nz double, d double, inliers long")
    found = points.agg(*counts).first()
    best = max(range(len(planes)), key=lambda k: (found[k], -k))
    return spark.createDataFrame([(*planes[best], int(found[best]))], "nx double, ny double, nz double, d double, inliers long")


def largest_regions(parts: DataFrame, most: int) -> DataFrame:
    """The ``most`` components with most cells: component, cells, rank."""
    sized = parts.groupBy("component").agg(F.count("*").alias("cells"))
    return sized.withColumn("rank", F.row_number().over(W.orderBy(F.desc("cells"), "component"))).where(F.col("rank") <= most)
