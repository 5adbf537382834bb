"""Walk networks: snapping, merging of route graphs, points of interest, portals and areas."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placeloom.functions import tags as T
from placeloom.functions import vector
from placeloom.operators import clusters, graph, spatial, tracks
from placeloom.operators.store import materialize

XYZ = ("x", "y", "z")


def snap_in_order(points: DataFrame, radius: float, key: str = "region") -> DataFrame:
    """(key, ord, rep): each point's representative under first-come snapping, in ``ord`` within each ``key``.

    A point joins the first representative within ``radius`` found in the nine ground cells around
    it (cells by dx, then dy; within a cell the oldest first), else becomes one.  The outcome
    depends on order by definition, so a region is one group; regions run in parallel.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ord", ignore_index=True)
        cells: dict[tuple[int, int], list[tuple[float, float, int]]] = {}
        reps = []
        for x, y, o in zip(group.x, group.y, group.ord):
            cx, cy = int(np.floor(x / radius)), int(np.floor(y / radius))
            near = (r for dx in (-1, 0, 1) for dy in (-1, 0, 1) for r in cells.get((cx + dx, cy + dy), ()))
            rep = next((r[2] for r in near if (r[0] - x) ** 2 + (r[1] - y) ** 2 <= radius * radius), None)
            if rep is None:
                cells.setdefault((cx, cy), []).append((x, y, o))
                rep = o
            reps.append(rep)
        return pd.DataFrame({key: group[key], "ord": group.ord, "rep": reps})

    kinds = dict(points.dtypes)
    return points.select(key, "ord", "x", "y").groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, ord {kinds['ord']}, rep {kinds['ord']}")


def snap_to_cells(points: DataFrame, size: float) -> DataFrame:
    """Distributed snapping: points of a voxel become its mean; order plays no part."""
    cells = [F.floor(F.col(c) / size).alias(f"i{c}") for c in XYZ]
    return points.groupBy(*cells).agg(*[F.avg(c).alias(c) for c in XYZ], F.min("ord").alias("ord"), F.count("*").alias("n"))


def walk_network(ways: DataFrame, longest: float = 10.0, radius: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of walkable lines: densified, snapped, edges once.

    ``ways``: region, way, kind, tags, ring of structs (x, y).  Node ids are ``nav_`` and the
    representative's number; edges carry the sorted distinct ways they come from.
    """
    lines = ways.where(T.walkable(F.col("kind"), F.col("tags"))).select("region", "way", F.posexplode("ring").alias("seq", "p"))
    lines = lines.select("region", "way", "seq", F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.lit(0.0).alias("z"))
    dense = tracks.densify(lines, ["region", "way"], longest)
    placed = materialize(dense.withColumn("ord", F.row_number().over(W.partitionBy("region").orderBy("way", "seq", "part")).cast("long")), "network")
    rep = snap_in_order(placed, radius)
    node = lambda c: F.concat(F.lit("nav_"), F.col("region").cast("string"), F.lit("_"), F.format_string("%04d", c))
    both = placed.join(rep, ["region", "ord"])
    nodes = both.where("rep = ord").select(node(F.col("ord")).alias("id"), "region", "ord", *XYZ)
    order = W.partitionBy("region", "way").orderBy("seq", "part")
    steps = both.select("region", "way", node(F.col("rep")).alias("a"), node(F.lead("rep").over(order)).alias("b")).where("b IS NOT NULL AND a <> b")
    edges = steps.groupBy(F.least("a", "b").alias("source_id"), F.greatest("a", "b").alias("target_id")).agg(F.array_sort(F.collect_set("way")).alias("ways"))
    return nodes, edges


def absorb(base: DataFrame, other: DataFrame, key: str = "id") -> DataFrame:
    """Append-only union: rows of ``other`` whose key is known already are left out, so absorbing twice changes nothing."""
    return base.unionByName(other.join(base.select(key), key, "left_anti"))


def add_places(nodes: DataFrame, edges: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with a node ``poi_<uid>`` for each place and an edge to its nearest walkable node."""
    near = spatial.nearest(places, nodes.where("type = 'nav'"), "uid", "id", "ord")
    poi = places.select(F.concat(F.lit("poi_"), F.col("uid").cast("string")).alias("id"), *XYZ, F.lit("poi").alias("type"))
    link = near.select(F.concat(F.lit("poi_"), F.col("uid").cast("string")).alias("source_id"), F.col("id").alias("target_id"))
    return absorb(nodes.select("id", *XYZ, "type"), poi), edges.select("source_id", "target_id").unionByName(link)


def anchors(objects: DataFrame, attached: DataFrame, nodes: DataFrame, gates: DataFrame, margin: float = 0.3) -> DataFrame:
    """(key, node, offset): the nodes an object is reached from and how far it is from each.

    Objects without an attachment get the nearest node of any type.  An offset whose line passes a
    gate is infinite.
    """
    known = attached.join(nodes.select(F.col("id").alias("node")), "node", "left_semi")
    lone = objects.join(known.select("uid"), "uid", "left_anti")
    near = spatial.nearest(lone, nodes, "uid", "id", "ord").select("uid", F.col("id").alias("node"))
    both = known.select("uid", "node").unionByName(near).distinct()
    o = objects.select("uid", *[F.col(c).alias(f"p0{c}") for c in XYZ])
    n = nodes.select(F.col("id").alias("node"), *[F.col(c).alias(f"p1{c}") for c in XYZ])
    line = materialize(both.join(o, "uid").join(n, "node").withColumn("key", F.concat_ws("|", F.col("uid").cast("string"), "node")), "anchors")
    cut = spatial.crossing(line.select("key", *[f"{p}{c}" for p in ("p0", "p1") for c in XYZ]), gates, margin).select("key", F.lit(True).alias("cut"))
    d = vector.distance(*[(f"p0{c}", f"p1{c}") for c in XYZ])
    return line.join(cut, "key", "left").select(F.col("uid").alias("key"), "node", F.when(F.coalesce("cut", F.lit(False)), float("inf")).otherwise(d).alias("offset"))


def portals(objects: DataFrame, segments: DataFrame, adjacency: float = 2.0, margin: float = 0.3) -> DataFrame:
    """Objects that act as gates: labels with door or entrance in them, and mirrors that are walked through or near such.

    ``why`` is labelled, through or near; through comes before near.
    """
    label = F.lower("label")
    doors = objects.where(label.contains("door") | label.contains("entrance"))
    mirrors = objects.where("label = 'mirror'")
    m = mirrors.select("uid", *XYZ, "hx", "hy", "hz")
    through = spatial.crossed(m, segments, "uid", margin)
    near = spatial.near_any(m.select("uid", *XYZ), doors.select("uid", *XYZ), adjacency).select("uid")
    why = through.select("uid", F.lit("through").alias("why")).unionByName(near.join(through, "uid", "left_anti").select("uid", F.lit("near").alias("why")))
    return objects.join(doors.select("uid", F.lit("labelled").alias("why")).unionByName(why), "uid")


def areas(objects: DataFrame, attached: DataFrame, nodes: DataFrame, edges: DataFrame, drop: tuple[str, ...] = ("door", "entrance", "mirror"), d_max: float = 8.0, linkage: str = "average", margin: float = 0.3) -> DataFrame:
    """(cluster, n, diameter, box) of objects that are near each other on foot without passing a gate.

    ``objects``: uid, label, x..hz; ``attached``: uid, node; ``nodes``: id, ord, x, y, z; ``edges``:
    source_id, target_id.  Without objects there are no areas.
    """
    nodes = materialize(nodes, "areas")
    p, q = (nodes.select(F.col("id").alias(f"{n}_id"), *[F.col(c).alias(f"{s}{c}") for c in XYZ]) for n, s in (("source", "p0"), ("target", "p1")))
    seg = materialize(edges.join(p, "source_id").join(q, "target_id").withColumn("key", F.concat_ws("|", "source_id", "target_id")), "areas")
    lines = seg.select("key", *[f"{s}{c}" for s in ("p0", "p1") for c in XYZ])
    gates = materialize(portals(objects, lines, margin=margin).select(*XYZ, "hx", "hy", "hz"), "areas")
    kept = seg.join(spatial.crossing(lines, gates, margin, kept=True).select("key"), "key", "left_semi").select("source_id", "target_id")
    inner = objects.where(~F.col("label").isin(*drop)).select("uid", *XYZ)
    at = materialize(anchors(inner, attached, nodes, gates, margin), "areas")
    walked = at.where(F.col("offset") < graph.INFINITY)  # the others are on no way
    paths = materialize(graph.shortest(graph.weighted(kept, nodes), walked.select(F.col("node").alias("src")), walked.select("node")), "areas")
    dist = materialize(graph.set_distances(at, paths), "areas")
    label = clusters.linkage_clusters(inner.select(F.col("uid").alias("id")), dist, d_max, linkage)
    members = label.join(inner.withColumnRenamed("uid", "id"), "id")
    return clusters.summary(members, dist)


def merge_routes(base: DataFrame, other: DataFrame, radius: float) -> DataFrame:
    """(id, target): where each node of ``other`` goes: the nearest base node within ``radius``, else itself."""
    near = spatial.radius_join(other, base, radius).groupBy(F.col("l.id").alias("id")).agg(F.min_by("r.id", F.struct("distance", "r.ord")).alias("target"))
    return other.select("id").join(near, "id", "left").select("id", F.coalesce("target", "id").alias("target"))

