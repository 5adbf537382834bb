"""Overlapping pairs of boxes turned about the vertical, worked out by arrays within grid cells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.operators import spatial
from placeloom.operators.store import materialize

XYZ = spatial.XYZ
SHAPE = (*XYZ, "hx", "hy", "hz", "yaw")
#: Pairs tested at a time.
BLOCK = 500_000


def _inside(p: list, d: list, half: list) -> np.ndarray:
    low, high = np.zeros(len(p[0])), np.ones(len(p[0]))
    for x, step, h in zip(p, d, half):
        flat = np.abs(step) < 1e-12
        step = np.where(flat, 1.0, step)
        a, b = (-h - x) / step, (h - x) / step
        low = np.maximum(low, np.where(flat, np.where(np.abs(x) <= h, 0.0, 2.0), np.minimum(a, b)))
        high = np.minimum(high, np.where(flat, 1.0, np.maximum(a, b)))
    return np.maximum(high - low, 0.0)


def shared_area(a: dict, b: dict) -> np.ndarray:
    """``geo.turned_area`` of rows of columns x, y, hx, hy, yaw."""
    turn = a["yaw"] - b["yaw"]
    cb, sb = np.cos(b["yaw"]), np.sin(b["yaw"])
    dx, dy = a["x"] - b["x"], a["y"] - b["y"]
    c, s, x, y = np.cos(turn), np.sin(turn), cb * dx + sb * dy, cb * dy - sb * dx
    ax, ay, bx, by = a["hx"], a["hy"], b["hx"], b["hy"]
    back = lambda w: [c * w[0] + s * w[1], c * w[1] - s * w[0]]
    corners = ((-1, -1), (1, -1), (1, 1), (-1, 1))
    total = np.zeros(len(x))
    for (i, j), (ni, nj) in zip(corners, corners[1:] + corners[:1]):
        u, v = float(ni - i), float(nj - j)
        p = [x + i * ax * c - j * ay * s, y + i * ax * s + j * ay * c]
        d = [u * ax * c - v * ay * s, u * ax * s + v * ay * c]
        q, f = [i * bx - x, j * by - y], [u * bx, v * by]
        total = total + (_inside(p, d, [bx, by]) * (p[0] * d[1] - p[1] * d[0]) + _inside(back(q), back(f), [ax, ay]) * 2.0 * bx * by)
    square = np.abs(s) < 1e-9
    sides = [np.maximum(np.minimum(m + w, h) - np.maximum(m - w, -h), 0.0) for m, w, h in ((x, np.where(square, ax, ay), bx), (y, np.where(square, ay, ax), by))]
    return np.where(square | (np.abs(c) < 1e-9), sides[0] * sides[1], np.maximum(total / 2, 0.0))


def _runs(cells: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of ``cells`` by cell, and for each row of ``of`` where the rows of its cell begin and end in it)."""
    both = np.concatenate([cells, of])
    by = np.lexsort(both.T)
    new = np.append(True, (both[by[1:]] != both[by[:-1]]).any(1))
    number = np.empty(len(both), np.int64)
    number[by] = np.cumsum(new)
    order = np.argsort(number[: len(cells)], kind="stable")
    return order, *(np.searchsorted(number[: len(cells)][order], number[len(cells) :], side) for side in ("left", "right"))


def overlap_pairs(objects: DataFrame, share: float, size: float = 4.0, rows: int = 100_000) -> DataFrame:
    """(u, v, ios), u < v, of turned boxes that share at least ``share``, 0.5 or more, of the smaller one.

    ``objects``: uid, x, y, z, hx, hy, hz, yaw.  A box of which half is in another has its centre there too, so larger boxes
    fill grid cells and meet the centres in them, each once.  A task has the cells of about ``rows`` boxes and centres.
    """
    if share < 0.5:
        raise ValueError("a smaller share can be had without the centre")
    kind = dict(objects.dtypes)["uid"]
    boxes = objects.where("uid IS NOT NULL").select("uid", *[F.col(c).cast("double").alias(c) for c in SHAPE])
    for c in SHAPE:
        boxes = boxes.where(F.abs(c) < float("inf"))
    boxes = materialize(boxes, "turned")
    turn = [(F.abs(F.cos("yaw")), F.abs(F.sin("yaw"))), (F.abs(F.sin("yaw")), F.abs(F.cos("yaw")))]
    half = [F.col("hx") * a + F.col("hy") * b for a, b in turn] + [F.col("hz")]
    size = spatial.finest(boxes, half, size)
    slack = F.greatest(*[F.abs(c) for c in XYZ], *half) * 1e-9 + 1e-9
    spans = [F.sequence(F.floor((F.col(c) - h - slack) / size).cast("long"), F.floor((F.col(c) + h + slack) / size).cast("long")) for c, h in zip(XYZ, half)]
    cells = F.flatten(F.transform(spans[0], lambda i: F.flatten(F.transform(spans[1], lambda j: F.transform(spans[2], lambda k: F.struct(i.alias("__cx"), j.alias("__cy"), k.alias("__cz")))))))
    keys = ["__cx", "__cy", "__cz"]
    filled = materialize(boxes.where("hx > 0 AND hy > 0 AND hz > 0").select("uid", *SHAPE, F.inline(cells)), "turned")
    tasks = 1 + (filled.count() + boxes.count()) // rows
    dealt = lambda df: df.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(tasks)).cast("int")).groupBy("part")

    def run(large: pa.Table, small: pa.Table) -> pa.Table:
        u, v, ios = [], [], []
        if len(large) and len(small):
            names = pa.chunked_array([*large.column("uid").chunks, *small.column("uid").chunks]).combine_chunks()
            rank = pc.rank(names, tiebreaker="min").to_numpy()
            ranks = rank[: len(large)], rank[len(large) :]
            big, little = ({c: t.column(c).to_numpy() for c in SHAPE} for t in (large, small))
            volume = [8 * t["hx"] * t["hy"] * t["hz"] for t in (big, little)]
            order, begin, end = _runs(*(np.column_stack([t.column(c).to_numpy() for c in keys]) for t in (small, large)))
            n = end - begin
            upto, at = np.cumsum(n), 0
            while at < len(n):
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK, "right")))
                for first in range(0, int(n[at:to].max()), BLOCK):  # one box alone can meet more centres than a block holds
                    m = np.clip(n[at:to] - first, 0, BLOCK)
                    a = np.repeat(np.arange(at, to), m)
                    b = order[np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(begin[at:to] + first, m)]
                    found = _shares(big, little, volume, ranks, a, b, share)
                    for own, x in zip((u, v, ios), found):
                        own.append(x)
                at = to
        u, v, ios = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (u, v, ios))
        if not len(u):
            return pa.table({"u": large.column("uid").slice(0, 0), "v": large.column("uid").slice(0, 0), "ios": pa.array([], pa.float64())})
        return pa.table({"u": names.take(pa.array(u)), "v": names.take(pa.array(v)), "ios": pa.array(ios, pa.float64())})

    centres = boxes.select("*", *spatial.cell(size))
    return dealt(filled).cogroup(dealt(centres)).applyInArrow(run, f"u {kind}, v {kind}, ios double")


def _shares(big: dict, little: dict, volume: list, ranks: tuple, a: np.ndarray, b: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of u and v among both tables' rows, ios) of the pairs of rows ``a`` of ``big`` and ``b`` of ``little`` that share enough."""
    va, vb, ra, rb = volume[0][a], volume[1][b], ranks[0][a], ranks[1][b]
    fits = (vb < va) | ((vb == va) & (rb > ra))  # one of the two is the smaller
    fits &= vb > 1e-12
    a, b = a[fits], b[fits]
    gap = np.abs(big["z"][a] - little["z"][b])
    high = np.minimum(big["z"][a] + big["hz"][a], little["z"][b] + little["hz"][b]) - np.maximum(big["z"][a] - big["hz"][a], little["z"][b] - little["hz"][b])
    fits = high >= share * (1 - 1e-9) * 2 * little["hz"][b] - 1e-9 * (1 + gap)
    a, b = a[fits], b[fits]
    dx, dy, c, s = little["x"][b] - big["x"][a], little["y"][b] - big["y"][a], np.cos(big["yaw"][a]), np.sin(big["yaw"][a])
    slack = 1e-9 * (np.abs(little["x"][b]) + np.abs(little["y"][b]) + big["hx"][a] + big["hy"][a]) + 1e-9
    fits = (np.abs(c * dx + s * dy) <= big["hx"][a] + slack) & (np.abs(c * dy - s * dx) <= big["hy"][a] + slack)
    a, b = a[fits], b[fits]
    first = (ranks[0][a] < ranks[1][b])[:, None]
    rows = [np.column_stack([t[k][i] for k in SHAPE]) for t, i in ((big, a), (little, b))]
    p, q = ({k: x[:, n] for n, k in enumerate(SHAPE)} for x in (np.where(first, rows[0], rows[1]), np.where(first, rows[1], rows[0])))
    high = np.minimum(p["z"] + p["hz"], q["z"] + q["hz"]) - np.maximum(p["z"] - p["hz"], q["z"] - q["hz"])
    shared = np.where(high > 0, high * shared_area(p, q), 0.0)
    ios = shared / volume[1][b]
    far, reach = (p["x"] - q["x"]) ** 2 + (p["y"] - q["y"]) ** 2 + (p["z"] - q["z"]) ** 2, [np.sqrt(t["hx"] ** 2 + t["hy"] ** 2 + t["hz"] ** 2) for t in (p, q)]
    fits = (ios >= share) & (shared > 0) & (np.sqrt(far) <= reach[0] + reach[1])
    a, b, first, ios = a[fits], b[fits] + len(big["x"]), first[fits, 0], ios[fits]
    return np.where(first, a, b), np.where(first, b, a), ios
