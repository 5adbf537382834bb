"""Nearest targets by tiles: space is cut where the targets are, and a task searches one tile's tree."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.operators.store import materialize

XYZ = ("x", "y", "z")
LEAF = 32


def _gaps(p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Distances from points to boxes, never more than to any point in the box, as rounding keeps order."""
    d = np.maximum(np.maximum(low - p, p - high), 0.0)
    d *= d
    return np.sqrt(d[..., 0] + d[..., 1] + d[..., 2])


def _spans(p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Distances from points to the far corners of boxes."""
    d = np.maximum(np.abs(p - low), np.abs(p - high))
    d *= d
    return np.sqrt(d[..., 0] + d[..., 1] + d[..., 2])


class Tree:
    """Points in a balanced k-d tree; of equally near ones that with the smallest ``rank`` is found."""

    def __init__(self, xyz: np.ndarray, rank: np.ndarray):
        order = np.arange(len(xyz))
        self.parts: list[tuple[int, int, np.ndarray, np.ndarray, int, int]] = []  # from, to, box, two parts or -1

        def cut(a: int, b: int) -> int:
            own = order[a:b]
            at = xyz[own]
            low, high = at.min(0), at.max(0)
            number = len(self.parts)
            self.parts.append((a, b, low, high, -1, -1))
            if b - a > LEAF:
                half = (b - a) // 2
                order[a:b] = own[np.argpartition(at[:, (high - low).argmax()], half)]
                self.parts[number] = (a, b, low, high, cut(a, a + half), cut(a + half, b))
            else:
                order[a:b] = own[np.argsort(rank[own])]
            return number

        cut(0, len(xyz))
        self.order, self.rank = order, rank[order]
        self.x, self.y, self.z = (np.ascontiguousarray(xyz[order, k]) for k in range(3))

    def nearest(self, p: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the nearest point, distance) for each row of ``p``; -1 where none is within ``most``."""
        best, place, rank = most.copy(), np.full(len(p), -1), np.full(len(p), np.iinfo(np.int64).max)

        def test(a: int, b: int, idx: np.ndarray) -> None:
            d = p[idx, 0, None] - self.x[a:b]
            d *= d
            for k, c in ((1, self.y), (2, self.z)):
                e = p[idx, k, None] - c[a:b]
                e *= e
                d += e
            np.sqrt(d, out=d)
            j = d.argmin(1)
            d, r = d[np.arange(len(idx)), j], self.rank[a + j]
            better = (d < best[idx]) | ((d == best[idx]) & (r < rank[idx]))
            idx = idx[better]
            best[idx], rank[idx], place[idx] = d[better], r[better], self.order[a + j[better]]

        # first every probe goes down to one leaf, for a bound; then all parts within its bound are gone through
        todo = [(0, np.arange(len(p)))]
        while todo:
            number, idx = todo.pop()
            a, b, _, _, left, right = self.parts[number]
            if left < 0:
                test(a, b, idx)
                continue
            to_left = _gaps(p[idx], *self.parts[left][2:4]) <= _gaps(p[idx], *self.parts[right][2:4])
            todo += [(n, i) for n, i in ((left, idx[to_left]), (right, idx[~to_left])) if len(i)]
        todo = [(0, np.arange(len(p)))]
        while todo:
            number, idx = todo.pop()
            a, b, low, high, left, right = self.parts[number]
            idx = idx[_gaps(p[idx], low, high) <= best[idx]]
            if not len(idx):
                continue
            if left < 0:
                test(a, b, idx)
            else:
                todo += [(left, idx), (right, idx)]
        return place, best


def _finite(df: DataFrame) -> DataFrame:
    for c in XYZ:
        df = df.where(F.abs(c) < float("inf"))  # also neither null nor NaN
    return df


def _cut(targets: DataFrame, size: int) -> Column:
    """The tile of a place: each axis in turn is cut at quantiles of all targets of each part."""
    whole = targets.agg(F.count("*").alias("n"), *[(F.min(c) < F.max(c)).alias(c) for c in XYZ]).first()
    axes = [c for c in XYZ if whole[c]]
    k = int(np.ceil((whole.n / size) ** (1 / max(1, len(axes)))))
    tile, parts = F.lit(0), 1
    if k > 1:
        for c in axes:
            cuts = targets.groupBy(tile.alias("tile")).agg(F.percentile_approx(c, [q / k for q in range(1, k)], 1000).alias("cuts"))
            known = {r.tile: [float(v) for v in r.cuts] for r in cuts.collect()}
            every = F.array(*[F.array(*[F.lit(v) for v in known.get(t, [float("inf")] * (k - 1))]) for t in range(parts)])
            at = F.col(c)
            tile = (tile * k + F.size(F.filter(F.get(every, tile), lambda v: v <= at))).cast("int")  # noqa: B023
            parts *= k
    return tile


def nearest(probes: DataFrame, targets: DataFrame, key: str, target: str, ord_: str, size: int = 50_000, chunk: int = 10_000) -> DataFrame:
    """(key, target id, distance) of the nearest target of each probe; the smallest ``ord_`` of equals.

    Both have x, y, z; rows without finite ones match nothing.  Tiles hold about ``size`` different places of targets.  A
    probe searches its own tile, then every other tile within the distance found there.  A task has one tile and about
    ``chunk`` probes however dense the targets are.  The tiles' boxes, a row a tile, come to the driver.
    """
    kinds = dict(probes.dtypes) | {"__id": dict(targets.dtypes)[target], "__ord": dict(targets.dtypes)[ord_]}
    places = _finite(targets.select(F.col(target).alias("__id"), F.col(ord_).alias("__ord"), *[F.col(c).cast("double").alias(c) for c in XYZ]))
    places = places.groupBy(*XYZ).agg(F.min(F.struct("__ord", "__id")).alias("m")).select(*XYZ, "m.*")
    places = materialize(places, "nearest")
    tile = _cut(places, size)
    answer = lambda df: df.groupBy(key).agg(F.min(F.struct("distance", "__ord", "__id")).alias("m")).select(key, F.col("m.__id").alias(target), F.col("m.distance").alias("distance"))
    places = places.withColumn("tile", tile)
    boxes = sorted(places.groupBy("tile").agg(*[F.min(c).alias(f"l{c}") for c in XYZ], *[F.max(c).alias(f"h{c}") for c in XYZ]).collect())
    number = np.array([r.tile for r in boxes], np.int32)
    low, high = (np.array([[r[f"{s}{c}"] for c in XYZ] for r in boxes], np.float64).reshape(-1, 3) for s in "lh")
    own = _finite(probes.select(key, *[F.col(c).cast("double").alias(c) for c in XYZ]))
    own = materialize(own, "nearest").withColumn("tile", tile).withColumn("most", F.lit(float("inf")))

    def searched(asked: DataFrame, onward: bool) -> DataFrame:
        """``asked``: key, x, y, z, tile, most; with ``onward`` come the coordinates and the other tiles to look at."""
        chunks = asked.groupBy("tile").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
        dealt = places.join(chunks, "tile").select("tile", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("part"), "__id", "__ord", *XYZ)
        mine = asked.join(chunks, "tile").withColumn("part", F.pmod(F.xxhash64(key, *XYZ), F.col("chunks")).cast("int")).drop("chunks")

        def run(table: pa.Table, given: pa.Table) -> pa.Table:
            p, xyz = (np.column_stack([t.column(c).to_numpy() for c in XYZ]).reshape(-1, 3) for t in (given, table))
            place, best = np.full(len(p), -1), given.column("most").to_numpy().astype(np.float64)
            if len(xyz) and len(p):
                rank = np.empty(len(xyz), np.int64)
                rank[pc.sort_indices(table.column("__ord"), null_placement="at_start").to_numpy()] = np.arange(len(xyz))
                place, best = Tree(xyz, rank).nearest(p, best)
            at = pa.array(place, mask=place < 0)
            out = {key: given.column(key), "__id": table.column("__id").take(at), "__ord": table.column("__ord").take(at), "distance": pa.array(best, mask=place < 0)}
            if onward:
                more, here = [], given.column("tile").to_numpy()
                for a in range(0, len(p), 1000):
                    q = p[a : a + 1000, None, :]
                    bound = np.minimum(best[a : a + 1000], _spans(q, low, high).min(1))
                    met = (_gaps(q, low, high) <= bound[:, None]) & (number != here[a : a + 1000, None])
                    more += [number[m] for m in met]
                out |= {c: given.column(c) for c in XYZ} | {"more": pa.array(more, pa.list_(pa.int32()))}
            return pa.table(out)

        schema = f"{key} {kinds[key]}, __id {kinds['__id']}, __ord {kinds['__ord']}, distance double" + (", x double, y double, z double, more array<int>" if onward else "")
        return mine.groupBy("tile", "part").cogroup(dealt.groupBy("tile", "part")).applyInArrow(lambda g, t: run(t, g), schema)

    if len(boxes) < 2:
        return answer(searched(own, False).where("distance IS NOT NULL"))
    first = materialize(searched(own, True), "nearest")
    most = F.coalesce("distance", F.lit(float("inf"))).alias("most")
    second = searched(first.select(key, *XYZ, F.explode("more").alias("tile"), most), False)
    columns = [key, "__id", "__ord", "distance"]
    return answer(materialize(first.select(columns).unionByName(second.select(columns)).where("distance IS NOT NULL"), "nearest"))
