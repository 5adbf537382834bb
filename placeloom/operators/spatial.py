"""Spatial joins: radius, nearest, box overlap and gate crossing, as equi-joins on grid cells.

A theta join on distance would compare all pairs.  Here the left side is put into one cell and
the right side into the 27 cells around its own (or the other way round, whichever the caller
finds smaller), so Spark joins on the cell and the exact test is a residual filter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.functions import geo, vector
from placeloom.operators.tiles import nearest  # noqa: F401

XYZ = ("x", "y", "z")


def cell(size: float | Column, prefix: str = "") -> list[Column]:
    return [F.floor(F.col(prefix + c) / size).cast("long").alias(f"__c{c}") for c in XYZ]


def neighbours(size: float | Column, axes: Sequence[str] = XYZ) -> Column:
    """The 27 cells at and around a point, as an array to explode."""
    steps = F.sequence(F.lit(-1), F.lit(1))
    base = [F.floor(F.col(c) / size).cast("long") for c in axes]
    return F.flatten(
        F.transform(steps, lambda i: F.flatten(F.transform(steps, lambda j: F.transform(steps, lambda k: F.struct((base[0] + i).alias("__cx"), (base[1] + j).alias("__cy"), (base[2] + k).alias("__cz"))))))
    )


def radius_join(left: DataFrame, right: DataFrame, radius: float, how: str = "inner") -> DataFrame:
    """Pairs (l struct, r struct, distance) of rows with x, y, z at most ``radius`` apart.

    ``how`` may be inner or left_semi (then rows of ``left`` come back).  Rows without
    coordinates match nothing.
    """
    l = left.select(F.struct(*left.columns).alias("l"), *XYZ).select("l", *[F.col(c).alias(f"l{c}") for c in XYZ], *cell(radius))
    r = right.select(F.struct(*right.columns).alias("r"), *XYZ, F.inline(neighbours(radius)))
    r = r.select("r", *[F.col(c).alias(f"r{c}") for c in XYZ], "__cx", "__cy", "__cz")
    d = vector.distance(*[(f"l{c}", f"r{c}") for c in XYZ])
    keys = ["__cx", "__cy", "__cz"]
    if how == "left_semi":
        same = [l[k] == r[k] for k in keys]
        return l.join(r, [*same, d <= radius], "left_semi").select("l.*")
    return l.join(r, keys).withColumn("distance", d).where(F.col("distance") <= radius).select("l", "r", "distance")


def proximity_pairs(nodes: DataFrame, edges: DataFrame, radius: float, min_gap: int = 3) -> DataFrame:
    """New undirected edges (a, b), a before b in ``ord``, of nodes within ``radius``.

    Nodes: id, session, seq, ord, x, y, z.  Left out: pairs that have an edge (source_id,
    target_id) in either direction, and pairs of one session whose seq differ by less than
    ``min_gap`` (only where both have session and seq).
    """
    pairs = radius_join(nodes, nodes, radius).where("l.ord < r.ord")
    near = (F.col("l.session") == F.col("r.session")) & (F.abs(F.col("l.seq") - F.col("r.seq")) < min_gap)
    pairs = pairs.where(~F.coalesce(near, F.lit(False)))
    pairs = pairs.select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), "distance", F.least("l.id", "r.id").alias("__u"), F.greatest("l.id", "r.id").alias("__v"))
    known = edges.select(F.least("source_id", "target_id").alias("__u"), F.greatest("source_id", "target_id").alias("__v"))
    return pairs.join(known, ["__u", "__v"], "left_anti").select("a", "b", "distance")


def finest(boxes: DataFrame, halves: list[Column], size: float, cells: float = 10.0) -> float:
    """The smallest of ``size``, its half, its quarter... at which a box touches at most ``cells`` grid cells on average."""
    tried = [size / 2**k for k in range(8)]
    touched = [F.coalesce(F.avg((2 * halves[0] / s + 1) * (2 * halves[1] / s + 1) * (2 * halves[2] / s + 1)), F.lit(0.0)) for s in tried]
    found = boxes.agg(*[t.alias(f"n{k}") for k, t in enumerate(touched)]).first()
    return min([s for s, n in zip(tried, found) if n <= cells], default=size)


def boxes_overlapping(left: DataFrame, right: DataFrame, size: float, only: Column | None = None, share: float = 0.0) -> DataFrame:
    """Pairs (l, r, shared) of boxes that share volume, among those for which ``only`` (of l and r) holds.

    Grid cells are ``size`` wide, or finer if the boxes are much smaller than that.  ``share``: pairs whose bounding
    boxes share less of the smaller volume may be left out, before the exact overlap is worked out.

    Boxes have x, y, z, hx, hy, hz, and yaw if they are turned about the vertical (both sides
    have it or it is not used).  Each box is put into every grid cell its bounding box touches; a
    pair is tested only in the cell that holds the lower corner of the common part of the two
    bounding boxes, so no pair comes twice and no global largest box widens the search.
    """
    turned = "yaw" in left.columns and "yaw" in right.columns

    def half(c: str, side: str = "") -> Column:
        h = lambda k: F.col(f"{side}h{k}")
        if not turned or c == "z":
            return h(c)
        yaw = F.col(f"{side}yaw")
        first, second = (F.cos(yaw), F.sin(yaw)) if c == "x" else (F.sin(yaw), F.cos(yaw))
        return F.abs(h("x") * first) + F.abs(h("y") * second)

    size = finest(left.select(*[half(c).alias(c) for c in XYZ]).unionByName(right.select(*[half(c).alias(c) for c in XYZ])), [F.col(c) for c in XYZ], size)

    def placed(df: DataFrame, side: str) -> DataFrame:
        spans = [F.sequence(F.floor((F.col(c) - half(c)) / size).cast("long"), F.floor((F.col(c) + half(c)) / size).cast("long")) for c in XYZ]
        cells = F.flatten(F.transform(spans[0], lambda i: F.flatten(F.transform(spans[1], lambda j: F.transform(spans[2], lambda k: F.struct(i.alias("__cx"), j.alias("__cy"), k.alias("__cz")))))))
        return df.select(F.struct(*df.columns).alias(side), F.inline(cells))

    pairs = placed(left, "l").join(placed(right, "r"), ["__cx", "__cy", "__cz"])
    for c in XYZ:
        low = F.greatest(F.col(f"l.{c}") - half(c, "l."), F.col(f"r.{c}") - half(c, "r."))
        pairs = pairs.where(F.floor(low / size).cast("long") == F.col(f"__c{c}"))
    if only is not None:
        pairs = pairs.where(only)
    if share > 0:
        common = geo.overlap(*[x for s in ("l", "r") for x in ([F.col(f"{s}.{c}") for c in XYZ], [half(c, f"{s}.") for c in XYZ])])
        least = F.least(*[geo.volume([F.col(f"{s}.h{c}") for c in XYZ]) for s in ("l", "r")])
        pairs = pairs.where(common >= (share * (1 - 1e-9)) * least)
    return pairs.select("l", "r", shared_volume("l", "r", turned).alias("shared")).where("shared > 0")


def centres_within(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """Pairs (l, r) of which one's centre lies in the box around the other's centre; x, y, z and the half sizes wx, wy, wz.

    The boxes fill grid cells, a centre is in one, so no pair meets twice; pairs found from the left are left out from the right.
    """
    wide = [F.col(f"w{c}") for c in XYZ]
    size = finest(left.select(*[f"w{c}" for c in XYZ]).unionByName(right.select(*[f"w{c}" for c in XYZ])), wide, size, 16.0)
    spans = [F.sequence(F.floor((F.col(c) - F.col(f"w{c}")) / size).cast("long"), F.floor((F.col(c) + F.col(f"w{c}")) / size).cast("long")) for c in XYZ]
    cells = F.flatten(F.transform(spans[0], lambda i: F.flatten(F.transform(spans[1], lambda j: F.transform(spans[2], lambda k: F.struct(i.alias("x"), j.alias("y"), k.alias("z")))))))

    def named(df: DataFrame, side: str, *places: Column) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{side}_{c}") for c in df.columns], *places)

    def inside(side: str) -> Column:
        x, y, z = (F.abs(F.col(f"l_{c}") - F.col(f"r_{c}")) <= F.col(f"{side}_w{c}") for c in XYZ)
        return x & y & z

    def met(boxes: DataFrame, points: DataFrame, of: Column) -> DataFrame:
        same = [F.col(f"__b{c}") == F.col(f"__c{c}") for c in XYZ]
        return boxes.join(points, same[0] & same[1] & same[2] & of).drop(*[f"__{k}{c}" for k in "bc" for c in XYZ])

    filled = F.inline(cells).alias("__bx", "__by", "__bz")
    first = met(named(left, "l", filled), named(right, "r", *cell(size)), inside("l"))
    second = met(named(right, "r", filled), named(left, "l", *cell(size)), inside("r") & ~inside("l"))
    both = first.unionByName(second)
    return both.select(*[F.struct(*[F.col(f"{s}_{c}").alias(c) for c in df.columns]).alias(s) for s, df in (("l", left), ("r", right))])


def shared_volume(a: str, b: str, turned: bool) -> Column:
    """Volume that the boxes of two struct columns share."""
    own = [([F.col(f"{s}.{c}") for c in XYZ], [F.col(f"{s}.h{c}") for c in XYZ]) for s in (a, b)]
    return geo.turned_overlap(*own[0], F.col(f"{a}.yaw"), *own[1], F.col(f"{b}.yaw")) if turned else geo.overlap(*own[0], *own[1])


def ios(side_l: str = "l", side_r: str = "r") -> Column:
    """Intersection over the smaller volume of a pair from ``boxes_overlapping``."""
    v = [geo.volume([F.col(f"{s}.h{c}") for c in XYZ]) for s in (side_l, side_r)]
    return geo.over_smaller(F.col("shared"), *v)


def gate_test(margin: float = 0.3) -> Column:
    """Whether segment (p0x.., p1x..) crosses gate (gx.., gh..), axis-aligned."""
    col = lambda p: [F.col(p + c) for c in XYZ]
    return geo.crosses_gate(col("p0"), col("p1"), col("g"), None, col("gh"), margin)


def crossing(segments: DataFrame, gates: DataFrame, margin: float = 0.3, kept: bool = False, size: float = 4.0) -> DataFrame:
    """Segments that cross a gate, or with ``kept`` those that cross none.

    Segments: key and p0x..p1z; gates: x, y, z, hx, hy, hz.
    """
    s, g = _gate_cells(segments, gates, margin, size, ["key"])
    hits = s.join(g, _meet(margin), "left_semi").select("key").distinct()
    return segments.join(hits, "key", "left_anti" if kept else "left_semi")


def crossed(gates: DataFrame, segments: DataFrame, key: str, margin: float = 0.3, size: float = 4.0) -> DataFrame:
    """(key) of the gates that a segment crosses; tables as for ``crossing``, gates with a ``key``."""
    s, g = _gate_cells(segments, gates, margin, size, [], [key])
    return g.join(s, _meet(margin), "left_semi").select(key).distinct()


def _meet(margin: float) -> Column:
    return (F.col("__sx") == F.col("__gx")) & (F.col("__sy") == F.col("__gy")) & (F.col("__sz") == F.col("__gz")) & gate_test(margin)


def _gate_cells(segments: DataFrame, gates: DataFrame, margin: float, size: float, of_segment: list[str], of_gate: list[str] = []) -> tuple[DataFrame, DataFrame]:  # noqa: B006
    """Segments and gates (gx.., ghx..), with the columns asked for, in the grid cells that they pass or fill.

    Cells are ``size`` wide or finer, so that few gates share one; joined as a semi join, a row stops at its first hit.
    A segment is cut into pieces as long as a cell, of which those in the bounding box of all gates are placed, so it is
    in about as many cells as it passes.  Rows without coordinates are in none.
    """
    wide = margin + 1e-6  # a crossing on the very face of a gate counts whatever way it was rounded
    g = gates.select(*of_gate, *[F.col(c).alias(f"g{c}") for c in XYZ], *[F.col(f"h{c}").alias(f"gh{c}") for c in XYZ])
    for c in XYZ:
        g = g.where(F.abs(f"g{c}") + F.abs(f"gh{c}") < float("inf"))
    half = [F.col(f"gh{c}") + wide for c in XYZ]
    size = finest(g, half, size, 24.0)
    box = g.agg(*[F.min(F.col(f"g{c}") - h).alias(f"l{c}") for c, h in zip(XYZ, half)], *[F.max(F.col(f"g{c}") + h).alias(f"h{c}") for c, h in zip(XYZ, half)]).first()
    s = segments.select(*of_segment, *[f"{p}{c}" for p in ("p0", "p1") for c in XYZ])
    for c in XYZ:
        s = s.where(F.abs(f"p0{c}") + F.abs(f"p1{c}") < float("inf"))
    if box.lx is None:
        s = s.where("false")
    low, high = ([F.lit(box[f"{k}{c}"]).cast("double") for c in XYZ] for k in "lh")
    step = [F.col(f"p1{c}") - F.col(f"p0{c}") for c in XYZ]
    pieces = F.greatest(F.lit(1.0), F.ceil(F.greatest(*[F.abs(d) for d in step]) / size).cast("double"))
    s = s.withColumn("__n", pieces)
    # the part of the segment in the bounding box of all gates, in pieces
    slope = [F.when(F.abs(d) >= 1e-9, d) for d in step]
    ends = [tuple((e - F.col(f"p0{c}")) / d for e in edges) for c, d, *edges in zip(XYZ, slope, low, high)]
    enter = F.greatest(F.lit(0.0), *[F.least(a, b) for a, b in ends])
    leave = F.least(F.lit(1.0), *[F.greatest(a, b) for a, b in ends])
    s = s.withColumn("__a", F.greatest(F.lit(0.0), F.floor(enter * F.col("__n")) - 1).cast("long")).withColumn("__b", F.least(F.col("__n") - 1, F.floor(leave * F.col("__n")) + 1).cast("long"))
    s = s.where("__a <= __b").withColumn("__k", F.explode(F.sequence("__a", "__b")))
    for c, d, lo, hi in zip(XYZ, step, low, high):
        first, last = (F.col(f"p0{c}") + d * ((F.col("__k") + k) / F.col("__n")) for k in (0, 1))
        slack = 1e-6 + (F.abs(f"p0{c}") + F.abs(f"p1{c}")) * 1e-12
        s = s.withColumn(f"__l{c}", F.least(first, last) - slack).withColumn(f"__h{c}", F.greatest(first, last) + slack)
        s = s.where((F.col(f"__h{c}") >= lo) & (F.col(f"__l{c}") <= hi))
    g = g.withColumns({f"__l{c}": F.col(f"g{c}") - h for c, h in zip(XYZ, half)} | {f"__h{c}": F.col(f"g{c}") + h for c, h in zip(XYZ, half)})

    def filled(df: DataFrame, side: str, own: list[str]) -> DataFrame:
        spans = [F.sequence(F.floor(F.col(f"__l{c}") / size).cast("long"), F.floor(F.col(f"__h{c}") / size).cast("long")) for c in XYZ]
        cells = F.flatten(F.transform(spans[0], lambda i: F.flatten(F.transform(spans[1], lambda j: F.transform(spans[2], lambda k: F.struct(i.alias("x"), j.alias("y"), k.alias("z")))))))
        return df.select(*own, F.inline(cells).alias(f"__{side}x", f"__{side}y", f"__{side}z"))

    return filled(s, "s", [*of_segment, *[f"{p}{c}" for p in ("p0", "p1") for c in XYZ]]), filled(g, "g", [*of_gate, *[f"{p}{c}" for p in ("g", "gh") for c in XYZ]])


def near_any(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Rows of ``left`` with a row of ``right`` within ``radius``."""
    return radius_join(left, right, radius, "left_semi")
