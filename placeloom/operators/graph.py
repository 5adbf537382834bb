"""Graphs as tables: connected components, shortest paths, node-set distances."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.functions import vector
from placeloom.operators.store import materialize

INFINITY = float("inf")


def undirected(edges: DataFrame, a: str = "source_id", b: str = "target_id") -> DataFrame:
    """Each pair once as (u, v), u < v; self-loops are dropped."""
    return edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct()


def weighted(edges: DataFrame, nodes: DataFrame, a: str = "source_id", b: str = "target_id") -> DataFrame:
    """(u, v, w) in both directions, w the straight distance; edges that name no node are dropped.

    Repeated edges count once (adding their weights up would lengthen a road for being listed twice).
    """
    p = nodes.select(F.col("id").alias("u"), *[F.col(c).alias(f"u{c}") for c in "xyz"])
    q = nodes.select(F.col("id").alias("v"), *[F.col(c).alias(f"v{c}") for c in "xyz"])
    one = undirected(edges, a, b).join(p, "u").join(q, "v").select("u", "v", vector.distance(*[(f"u{c}", f"v{c}") for c in "xyz"]).alias("w"))
    return one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))


def joined(links: pd.DataFrame) -> dict:
    """node -> smallest node it is connected with, of the links a, b."""
    up: dict = {}

    def root(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    for a, b in zip(links.a, links.b):
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(up)}


def components(nodes: DataFrame, edges: DataFrame, limit: int = 60, at_once: int = 300_000) -> DataFrame:
    """(id, component) for every node: the smallest id it is connected with.

    ``nodes``: id; ``edges``: u, v.  At most ``at_once`` links (counted first) are joined in one
    task.  More go through alternating large-star and small-star steps, two aggregations a round; a
    written table cuts the lineage, and a run that doesn't settle is an error.  The result is the
    same.
    """
    links = materialize(edges.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).where("a < b").distinct(), "components")
    if links.count() <= at_once:
        kind = dict(links.dtypes)["a"]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = list(frames)
            if known:
                low = joined(pd.concat(known))
                yield pd.DataFrame({"id": list(low), "component": list(low.values())})

        found = materialize(links.coalesce(1).mapInPandas(run, f"id {kind}, component {kind}"), "components")
        return nodes.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    mark = None
    for _ in range(limit):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        lowest = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(lowest, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).where("x < y")
        links = materialize(small.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "components")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            found = links.select(F.col("b").alias("id"), F.col("a").alias("component"))
            return nodes.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
        mark = now
    raise RuntimeError(f"components did not settle in {limit} rounds")


PATHS = "src {0}, node {0}, dist double, pred {0}"


def from_source(links: dict, source) -> dict:
    """node -> (distance, predecessor) over ``links`` (node -> [(neighbour, weight)]); the smallest predecessor of equal paths."""
    best, done, heap = {source: (0.0, None)}, set(), [(0.0, source)]
    while heap:
        d, u = heapq.heappop(heap)
        if u in done:
            continue
        done.add(u)
        for v, w in links.get(u, ()):
            if v not in done:
                old = best.get(v)
                if old is None or d + w < old[0]:
                    best[v] = (d + w, u)
                    heapq.heappush(heap, (d + w, v))
                elif d + w == old[0] and old[1] is not None and u < old[1]:
                    best[v] = (old[0], u)
    return best


def shortest(edges: DataFrame, sources: DataFrame, targets: DataFrame | None = None, component_nodes: int = 200_000, chunk: int = 64) -> DataFrame:
    """(src, node, dist, pred) from every source to every node it reaches, or to those in ``targets`` (node) only.

    ``edges``: u, v, w (both directions); ``sources``: src.  Of equal paths the smallest
    predecessor is kept.  A component of at most ``component_nodes`` nodes is one search per
    source within a task, ``chunk`` sources a task; larger ones are relaxed by rounds of joins,
    with the same result.
    """
    edges = materialize(edges.groupBy("u", "v").agg(F.min("w").alias("w")), "paths-edges")
    kind = dict(edges.dtypes)["v"]
    sources = sources.select(F.col("src").cast(kind)).where("src IS NOT NULL").distinct()
    nodes = edges.select(F.col("u").alias("id")).unionByName(sources.select(F.col("src").alias("id"))).distinct()
    parts = materialize(components(nodes, edges.select("u", "v")), "paths-parts")
    sizes = parts.groupBy("component").agg(F.count("*").alias("size"))
    own = sources.join(parts, sources["src"] == parts["id"]).select("src", "component")
    asked = materialize(own.join(sizes, "component"), "paths-sources")
    # only components with a source take part
    counts = asked.groupBy("component", "size").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    dealt = edges.join(parts, edges["u"] == parts["id"]).join(counts.where(F.col("size") <= component_nodes), "component")
    dealt = dealt.select("component", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("part"), "u", "v", "w")
    small = asked.where(F.col("size") <= component_nodes).join(counts, ["component", "size"]).select("component", F.pmod(F.xxhash64("src"), F.col("chunks")).cast("int").alias("part"), "src")
    goal = None if targets is None else targets.select(F.col("node").cast(kind).alias("node")).distinct()

    def search(links: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        out = {}
        for u, v, w in zip(links.u, links.v, links.w):
            out.setdefault(u, []).append((v, w))
        rows = [(s, n, d, p) for s in starts.src for n, (d, p) in from_source(out, s).items()]
        return pd.DataFrame(rows, columns=["src", "node", "dist", "pred"])

    found = dealt.groupBy("component", "part").cogroup(small.groupBy("component", "part")).applyInPandas(search, PATHS.format(kind))
    large = asked.where(F.col("size") > component_nodes).select("src")
    if large.isEmpty():
        return found if goal is None else found.join(goal, "node", "left_semi")
    both = found.unionByName(relaxed(edges, large))
    return both if goal is None else both.join(goal, "node", "left_semi")


def relaxed(edges: DataFrame, sources: DataFrame, limit: int = 10_000) -> DataFrame:
    """As ``shortest``, for components of any size: only nodes whose distance fell in the last round offer new ones.

    A round is a join and an aggregation over (src, node).
    """
    kind = dict(edges.dtypes)["v"]
    best = materialize(sources.select("src", F.col("src").alias("node"), F.lit(0.0).alias("dist"), F.lit(None).cast(kind).alias("pred")).distinct(), "paths")
    front, parts = best, [best]

    def known() -> DataFrame:
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return every.groupBy("src", "node").agg(F.min(F.struct("dist", "pred")).alias("o")).select("src", "node", "o.dist", "o.pred")

    for _ in range(limit):
        offers = front.join(edges, front["node"] == edges["u"]).select("src", F.col("v").alias("node"), (F.col("dist") + F.col("w")).alias("dist"), F.col("u").alias("pred"))
        offers = offers.groupBy("src", "node").agg(F.min(F.struct("dist", "pred")).alias("o"))
        old = known().select("src", "node", F.col("dist").alias("d0"))
        better = offers.join(old, ["src", "node"], "left").where("d0 IS NULL OR o.dist < d0")
        front = materialize(better.select("src", "node", F.col("o.dist").alias("dist"), F.col("o.pred").alias("pred")), "paths")
        if front.isEmpty():
            return known()
        parts.append(front)
        if len(parts) > 6:  # what was found so far is put together now and then only
            parts[:] = [materialize(known(), "paths")]
    raise RuntimeError("paths did not settle")


def path_nodes(tree: DataFrame, ends: DataFrame, limit: int = 40) -> DataFrame:
    """(src, target, step, node): the nodes of each path from src to target, step 0 at the target.

    ``ends``: src, target.  Unreachable targets have no rows.  Jumps of 1, 2, 4... predecessors
    are built from each other, so a path of n nodes takes twice log2 n joins.
    """
    at = ends.select("src", "target").distinct().join(tree.select("src", F.col("node").alias("target")), ["src", "target"])
    own = tree.select("src", "node", "pred").where("pred IS NOT NULL").join(ends.select("src").distinct(), "src", "left_semi")
    jumps = [materialize(own.select("src", "node", F.col("pred").alias("to")), "path-jumps")]
    while not jumps[-1].isEmpty():
        if len(jumps) > limit:
            raise RuntimeError("path too long")
        last = jumps[-1]
        onward = last.select("src", F.col("node").alias("to"), F.col("to").alias("beyond"))
        jumps.append(materialize(last.join(onward, ["src", "to"]).select("src", "node", F.col("beyond").alias("to")), "path-jumps"))
    out = materialize(at.select("src", "target", F.col("target").alias("node"), F.lit(0).alias("step")), "path")
    for k in range(len(jumps) - 2, -1, -1):
        up = out.join(jumps[k], ["src", "node"]).select("src", "target", F.col("to").alias("node"), (F.col("step") + (1 << k)).alias("step"))
        out = materialize(out.unionByName(up), "path")
    return out.select("src", "target", "step", "node")


def set_distances(anchors: DataFrame, paths: DataFrame) -> DataFrame:
    """(i, j, dist), i < j: least offset + path + offset over the anchors of two objects.

    ``anchors``: key, node, offset; ``paths``: src, node, dist from every anchor node.  Pairs
    without a path have no row.  Both directions are taken and the smaller kept.
    """
    a = anchors.where(F.col("offset") < INFINITY)
    reach = a.join(paths, a["node"] == paths["src"]).groupBy("key", paths["node"].alias("at")).agg(F.min(F.col("offset") + F.col("dist")).alias("r"))
    far = a.select(F.col("key").alias("j"), F.col("node").alias("at"), F.col("offset").alias("o"))
    pair = reach.join(far, "at").where("key <> j")
    return pair.groupBy(F.least("key", "j").alias("i"), F.greatest("key", "j").alias("j")).agg(F.min(F.col("r") + F.col("o")).alias("dist"))
