"""Ordered operators: trajectories, arc length, resampling, smoothing, motion tests, session routes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placeloom.functions import vector

XYZ = ("x", "y", "z")


def along(keys: Sequence[str], seq: str = "seq") -> W:
    return W.partitionBy(*keys).orderBy(seq)


def steps(poses: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """Adds ``step``: the distance from the previous pose, null for the first."""
    w = along(keys, seq)
    return poses.withColumn("step", vector.distance(*[(F.col(c), F.lag(c).over(w)) for c in XYZ]))


def motion(poses: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """keys, n and motion: the median step of each track; 0 under three points."""
    moved = steps(poses, keys, seq).groupBy(*keys).agg(F.count("*").alias("n"), F.median("step").alias("m"))
    return moved.select(*keys, "n", F.when(F.col("n") < 3, 0.0).otherwise(F.col("m")).alias("motion"))


def classify_static(tracks: DataFrame, max_step: float, min_support: int) -> DataFrame:
    """Adds ``dynamic``: moves by more than ``max_step`` and has support enough to say so."""
    return tracks.withColumn("dynamic", (F.col("motion") > max_step) & (F.col("n") >= min_support))


def sticky_dynamic(poses: DataFrame, keys: Sequence[str], max_step: float, seq: str = "seq") -> DataFrame:
    """Adds ``dynamic``: whether the median step up to some pose so far exceeded ``max_step``; once true, always true."""
    w = along(keys, seq)
    seen = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    out = steps(poses, keys, seq).withColumn("n", F.row_number().over(w)).withColumn("m", F.percentile("step", F.lit(0.5)).over(seen))
    over = F.when((F.col("n") >= 3) & (F.col("m") > max_step), 1).otherwise(0)
    return out.withColumn("dynamic", F.max(over).over(seen) == 1).drop("step", "n", "m")


def arc_length(poses: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """Adds ``s``: the path length up to each pose."""
    w = along(keys, seq).rowsBetween(W.unboundedPreceding, W.currentRow)
    return steps(poses, keys, seq).withColumn("s", F.coalesce(F.sum("step").over(w), F.lit(0.0))).drop("step")


def resample(poses: DataFrame, keys: Sequence[str], spacing: float, seq: str = "seq") -> DataFrame:
    """keys, k, x, y, z: points at 0, spacing, 2 spacing, ... under the path's length, interpolated.

    A path shorter than ``spacing`` gives its two ends.  Each segment makes its own points, so a
    long path is not gathered.
    """
    w = along(keys, seq)
    lined = arc_length(poses, keys, seq)
    total = W.partitionBy(*keys)
    seg = lined.withColumns({**{f"n{c}": F.lead(c).over(w) for c in XYZ}, "s1": F.lead("s").over(w), "total": F.max("s").over(total)})
    first, last = F.ceil(F.col("s") / spacing), F.ceil(F.col("s1") / spacing) - 1
    grid = seg.where((F.col("s1") > F.col("s")) & (last >= first) & (F.col("total") >= spacing)).withColumn("k", F.explode(F.sequence(first, last)))
    share = (F.col("k") * spacing - F.col("s")) / (F.col("s1") - F.col("s"))
    inner = grid.select(*keys, F.col("k").cast("long").alias("k"), *[(F.col(c) + share * (F.col(f"n{c}") - F.col(c))).alias(c) for c in XYZ])
    ends = lined.withColumn("total", F.max("s").over(total)).where(F.col("total") < spacing)
    a = ends.groupBy(*keys).agg(F.min_by(F.struct(*XYZ), seq).alias("a"), F.max_by(F.struct(*XYZ), seq).alias("b"))
    short = a.select(*keys, F.posexplode(F.array("a", "b")).alias("k", "p")).select(*keys, F.col("k").cast("long").alias("k"), "p.*")
    return inner.unionByName(short)


def densify(points: DataFrame, keys: Sequence[str], longest: float, seq: str = "seq") -> DataFrame:
    """keys, seq, part, x, y, z: the vertices, and between them as many equal parts as keep segments within ``longest``.

    Segments without length are skipped.  What a segment is longer by the rounding of its ends makes no further part, so
    positions that are running sums are cut alike in whatever order they were added up.
    """
    w = along(keys, seq)
    seg = points.withColumns({f"p{c}": F.lag(c).over(w) for c in XYZ}).withColumn("d", vector.distance(*[(c, f"p{c}") for c in XYZ]))
    first = seg.where("px IS NULL").select(*keys, seq, F.lit(0).alias("part"), *XYZ)
    rounding = F.greatest(*[F.abs(f"{p}{c}") for c in XYZ for p in ("", "p")]) * 1e-15
    parts = F.greatest(F.lit(1), F.ceil((F.col("d") - rounding) / longest).cast("int"))
    more = seg.where("d > 0").withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(1), F.col("parts"))))
    share = F.col("part") / F.col("parts")
    return first.unionByName(more.select(*keys, seq, "part", *[(F.col(f"p{c}") + share * (F.col(c) - F.col(f"p{c}"))).alias(c) for c in XYZ]))


def sequential_edges(nodes: DataFrame, keys: Sequence[str], seq: str = "seq", id_col: str = "id") -> DataFrame:
    """(source_id, target_id) between neighbours."""
    return nodes.select(F.col(id_col).alias("source_id"), F.lead(id_col).over(along(keys, seq)).alias("target_id")).where("target_id IS NOT NULL")


def smooth(path: np.ndarray, rounds: int = 10, shrink: float = 0.5, grow: float = -0.53) -> np.ndarray:
    """Taubin smoothing with fixed ends: alternating steps towards and away from the neighbours' mean."""
    p = path.astype(np.float64).copy()
    for _ in range(rounds if len(p) > 2 else 0):
        for factor in (shrink, grow):
            p[1:-1] += factor * ((p[:-2] + p[2:]) / 2 - p[1:-1])
    return p


def smoothed(poses: DataFrame, key: str, seq: str = "seq", rounds: int = 10) -> DataFrame:
    """The poses of each ``key`` with smoothed positions; a path is one group by nature."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(seq, ignore_index=True)
        group[list(XYZ)] = smooth(group[list(XYZ)].to_numpy(), rounds)
        return group

    return poses.groupBy(key).applyInPandas(run, poses.schema)


def session_route(poses: DataFrame, key: str, spacing: float, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of each session's smoothed and resampled path; node ids are ``{session}_{k}``."""
    nodes = resample(smoothed(poses.select(key, seq, *XYZ), key, seq), [key], spacing, seq)
    nodes = nodes.withColumn("id", F.concat_ws("_", F.col(key).cast("string"), F.col("k").cast("string")))
    return nodes, sequential_edges(nodes, [key], "k")


def path_length(points: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    return steps(points, keys, seq).groupBy(*keys).agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"))


def running_best(rows: DataFrame, keys: Sequence[str], value: str, seq: str = "seq") -> DataFrame:
    """Adds ``best`` and ``best_seq``: the smallest value so far and where it first came."""
    w = along(keys, seq).rowsBetween(W.unboundedPreceding, W.currentRow)
    least = F.min(F.struct(value, seq)).over(w)
    return rows.withColumn("__b", least).withColumns({"best": F.col(f"__b.{value}"), "best_seq": F.col(f"__b.{seq}")}).drop("__b")


def chunks(frames: DataFrame, size: int, overlap: int = 0, seq: str = "seq") -> DataFrame:
    """Adds ``chunk`` by position: the first holds ``size`` frames, each later one brings ``size - overlap`` new ones."""
    fresh = size - overlap
    return frames.withColumn("chunk", F.when(F.col(seq) < size, 0).otherwise(F.floor((F.col(seq) - size) / fresh) + 1).cast("long"))


def sample_per_key(rows: DataFrame, keys: Sequence[str], most: int, by: Sequence[str], seed: int = 0) -> DataFrame:
    """At most ``most`` rows of each key, picked by a seeded hash of ``by``: a repeatable reservoir."""
    order = W.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), *by), *by)
    return rows.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= most).drop("__k")


def stride(frames: DataFrame, every: int, most: int | None = None, seq: str = "seq") -> DataFrame:
    """Every n-th frame, then the first ``most`` of them."""
    kept = frames.where(F.col(seq) % every == 0)
    return kept if most is None else kept.where(F.col(seq) < every * most)

