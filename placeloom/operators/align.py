"""Session alignment: a potential field over the target cloud, a coarse search over poses, and refinement."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.operators.clouds import kernel


class Field:
    """Negative blurred occupancy of a point set on a grid, sampled trilinearly; outside it is 0.

    The grid's size follows the extent of the mapped place, not the number of points.
    """

    def __init__(self, points: np.ndarray, cell: float, sigma: float):
        self.cell = cell
        pad = int(np.ceil(3 * sigma / cell)) + 1
        self.origin = np.floor(points.min(axis=0) / cell).astype(int) - pad
        shape = np.floor(points.max(axis=0) / cell).astype(int) - self.origin + pad + 1
        grid = np.zeros(shape)
        index = np.floor(points / cell).astype(int) - self.origin
        grid[tuple(index.T)] = 1.0
        taps = kernel(sigma / cell, 3.0)
        for axis in range(3):
            out = np.zeros_like(grid)
            for k, w in taps:
                moved = np.roll(grid, k, axis=axis)
                edge = [slice(None)] * 3
                edge[axis] = slice(0, k) if k > 0 else slice(grid.shape[axis] + k, None)
                if k:
                    moved[tuple(edge)] = 0
                out += w * moved
            grid = out
        self.grid = -grid / max(grid.max(), 1e-12)

    def sample(self, points: np.ndarray) -> np.ndarray:
        at = points / self.cell - self.origin - 0.5
        low = np.floor(at).astype(int)
        share = at - low
        total = np.zeros(len(points))
        limit = np.array(self.grid.shape) - 1
        for corner in np.ndindex(2, 2, 2):
            where = low + corner
            inside = ((where >= 0) & (where <= limit)).all(axis=1)
            weight = np.prod(np.where(corner, share, 1 - share), axis=1)
            safe = np.clip(where, 0, limit)
            total += np.where(inside, weight * self.grid[tuple(safe.T)], 0.0)
        return total


def turn(yaw: float) -> np.ndarray:
    c, s = np.cos(yaw), np.sin(yaw)
    return np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]])


def sample_points(points: DataFrame, most: int, seed: int = 0) -> np.ndarray:
    """At most ``most`` points, picked by a seeded hash."""
    rows = points.orderBy(F.xxhash64(F.lit(seed), "x", "y", "z")).limit(most).select("x", "y", "z").toPandas()
    return rows.to_numpy(dtype=np.float64)


def coarse_poses(span: float, step: float, yaws: int = 24) -> pd.DataFrame:
    """All candidate (yaw, tx, ty) within ``span`` of no shift."""
    axis = np.arange(-span, span + step / 2, step)
    y, tx, ty = np.meshgrid(np.arange(yaws) * 2 * np.pi / yaws, axis, axis, indexing="ij")
    return pd.DataFrame({"yaw": y.ravel(), "tx": tx.ravel(), "ty": ty.ravel()})


def energies(poses: DataFrame, source: np.ndarray, field: Field) -> DataFrame:
    """Adds ``energy``: the mean field under the moved source points; candidates are spread over the tasks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(energy=[float(field.sample(source @ turn(p.yaw).T + [p.tx, p.ty, 0.0]).mean()) for p in f.itertuples()])

    return poses.mapInPandas(run, "yaw double, tx double, ty double, energy double")


def refine(start: np.ndarray, source: np.ndarray, field: Field, rounds: int = 60, step: float = 0.2) -> tuple[np.ndarray, float]:
    """Coordinate descent with shrinking steps on (yaw, tx, ty); never worse than the start."""
    value = lambda p: float(field.sample(source @ turn(p[0]).T + [p[1], p[2], 0.0]).mean())
    best, energy = np.array(start, dtype=float), value(start)
    size = np.array([step / 4, step, step])
    for _ in range(rounds):
        moved = False
        for k in range(3):
            for sign in (1, -1):
                trial = best.copy()
                trial[k] += sign * size[k]
                if (e := value(trial)) < energy - 1e-12:
                    best, energy, moved = trial, e, True
        if not moved:
            size /= 2
            if size.max() < 1e-4:
                break
    return best, energy


def align(source: DataFrame, target: DataFrame, cell: float = 0.5, sigma: float = 0.8, span: float = 4.0, step: float = 0.8, top: int = 3, most: int = 4000, seed: int = 0) -> DataFrame:
    """yaw, tx, ty, energy, inliers of the rigid motion that brings ``source`` onto ``target``.

    Both clouds are sampled to at most ``most`` points (a sampling parameter of the method).  All
    coarse candidates are scored in parallel; the best ``top`` are refined, each in its own task.
    """
    spark = source.sparkSession
    a, b = sample_points(source, most, seed), sample_points(target, most, seed + 1)
    schema = "yaw double, tx double, ty double, energy double, inliers double"
    if not len(a) or not len(b):
        return spark.createDataFrame([], schema)
    field = Field(b, cell, sigma)
    scored = energies(spark.createDataFrame(coarse_poses(span, step)).repartition(spark.sparkContext.defaultParallelism), a, field)
    starts = scored.orderBy("energy", "yaw", "tx", "ty").limit(top)

    def polish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for p in f.itertuples():
                best, energy = refine(np.array([p.yaw, p.tx, p.ty]), a, field)
                under = field.sample(a @ turn(best[0]).T + [best[1], best[2], 0.0])
                out.append((*best, energy, float((under < 0.1 * field.grid.min()).mean())))
            yield pd.DataFrame(out, columns=["yaw", "tx", "ty", "energy", "inliers"])

    return starts.repartition(top, "energy").mapInPandas(polish, schema).orderBy("energy").limit(1)


def median_scale(a: DataFrame, b: DataFrame, key: str = "id") -> float:
    """Scale between two sets of matched positions: the median ratio of their consecutive distances; 1 without any."""
    from placeloom.functions import vector

    both = a.select(key, *[F.col(c).alias(f"a{c}") for c in "xyz"]).join(b.select(key, *[F.col(c).alias(f"b{c}") for c in "xyz"]), key)
    p, q = both.alias("p"), both.alias("q")
    pairs = p.join(q, F.col(f"p.{key}") < F.col(f"q.{key}"))
    local = vector.distance(*[(f"p.a{c}", f"q.a{c}") for c in "xyz"])
    far = vector.distance(*[(f"p.b{c}", f"q.b{c}") for c in "xyz"])
    found = pairs.select(local.alias("d"), far.alias("e")).where("d > 1e-9").agg(F.median(F.col("e") / F.col("d"))).first()[0]
    return float(found) if found is not None else 1.0


def from_poses(a: DataFrame, b: DataFrame, key: str = "id"):
    """The similarity transform that takes positions ``a`` to ``b``: sums in Spark, a 3x3 decomposition on the driver."""
    from placeloom.functions.geo import Sim3

    both = a.select(key, *[F.col(c).alias(f"a{c}") for c in "xyz"]).join(b.select(key, *[F.col(c).alias(f"b{c}") for c in "xyz"]), key)
    names = [f"{s}{c}" for s in "ab" for c in "xyz"]
    sums = both.agg(F.count("*").alias("n"), *[F.sum(n).alias(n) for n in names], *[F.sum(F.col(f"b{i}") * F.col(f"a{j}")).alias(f"{i}{j}") for i in "xyz" for j in "xyz"]).first()
    if not sums["n"]:
        return Sim3()
    ma, mb = (np.array([sums[f"{s}{c}"] for c in "xyz"]) / sums["n"] for s in "ab")
    h = np.array([[sums[f"{i}{j}"] for j in "xyz"] for i in "xyz"]) / sums["n"] - np.outer(mb, ma)
    u, _, vt = np.linalg.svd(h)
    d = np.diag([1, 1, np.sign(np.linalg.det(u @ vt))])
    r = u @ d @ vt
    s = median_scale(a, b, key)
    return Sim3(s, r.ravel(), mb - s * r @ ma)
