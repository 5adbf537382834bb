"""Queries over the place tree: text of areas, embeddings, retrieval, ordering, and a walkable route."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placeloom.functions import vector
from placeloom.operators import graph, hierarchy, spatial
from placeloom.operators.store import materialize


class Encoder(Protocol):
    """Turns texts into unit vectors."""

    model_id: str

    def encode(self, texts: Sequence[str]) -> np.ndarray: ...


class HashEncoder:
    """Deterministic stand-in: a text's hash seeds a normal vector, scaled to unit length."""

    def __init__(self, size: int = 512):
        self.model_id, self.size = f"hash-{size}", size

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        out = np.empty((len(texts), self.size), np.float32)
        for row, t in zip(out, texts):
            seed = int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big")
            v = np.random.default_rng(seed).standard_normal(self.size).astype(np.float32)
            row[:] = v / np.linalg.norm(v)
        return out


#: Encoders by name.
ENCODERS: dict[str, Callable[[], Encoder]] = {"hash": HashEncoder}


def encode_distinct(rows: DataFrame, text: str, encoder: Encoder) -> DataFrame:
    """``rows`` with ``embedding``; each distinct text is encoded once and joined back."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(embedding=list(encoder.encode(f[text].tolist())))

    known = rows.select(text).where(F.col(text).isNotNull()).distinct().mapInPandas(run, f"`{text}` string, embedding array<float>")
    return rows.join(known, text, "left")


def vote_summary(votes: DataFrame, key: str, most: int = 12) -> DataFrame:
    """(key, contains): up to ``most`` labels by votes, as "label (n)", or bare for a single vote."""
    w = W.partitionBy(key).orderBy(F.desc("n"), "pos")
    top = votes.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    text = F.when(F.col("n") > 1, F.concat("label", F.lit(" ("), F.col("n").cast("string"), F.lit(")"))).otherwise(F.col("label"))
    listed = top.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("k", text.alias("t")))).alias("x"))
    return listed.select(key, F.array_join(F.transform("x", lambda t: t["t"]), ", ").alias("contains"))


def area_text(name: Column, desc: Column, uid: Column, contains: Column) -> Column:
    """What an area is searched by: its name and description (or its number), then what it holds."""
    title = F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("area "), uid.cast("string")))
    return F.concat_ws(". ", title, F.nullif(desc, F.lit("")), F.concat(F.lit("contains "), F.nullif(contains, F.lit(""))))


def vote_embeddings(votes: DataFrame, labels: DataFrame) -> DataFrame:
    """(uid, embedding): vote-weighted mean of label embeddings at unit length; without votes no row."""
    parts = votes.join(labels, "label").select("uid", "n", F.posexplode("embedding").alias("k", "e"))
    sums = parts.groupBy("uid", "k").agg(F.sum(F.col("n") * F.col("e").cast("double")).alias("s"))
    whole = sums.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("k", "s"))).alias("x"))
    return whole.select("uid", vector.unit(F.transform("x", lambda t: t["s"])).alias("embedding"))


Orderer = Callable[[list[dict]], list]
STOP, REQUESTER = "STOP", "REQUESTER"


def by_score(candidates: list[dict]) -> list:
    """The default orderer: descending score."""
    return [c["uid"] for c in sorted(candidates, key=lambda c: -c["score"])]


def settle(sequence: list, known: set, most: int = 12) -> list:
    """An orderer's answer made safe: cut at the first STOP, unknown ids left out, at most ``most`` entries."""
    cut = sequence[: sequence.index(STOP)] if STOP in sequence else sequence
    return [s for s in cut if s in known or s == REQUESTER][:most]


def order_route(candidates: list[dict], orderer: Orderer = by_score, tries: int = 3) -> list:
    """The visiting order; an orderer that fails or answers nothing is asked again, then the first candidate is taken."""
    known = {c["uid"] for c in candidates}
    for _ in range(tries):
        try:
            found = settle(orderer(candidates), known)
        except Exception:  # noqa: BLE001  orderers are plugged in and may fail in any way
            continue
        if found:
            return found
    return [candidates[0]["uid"]] if candidates else []


def attach(places: DataFrame, nodes: DataFrame) -> DataFrame:
    """(uid, node): the nearest walkable node of each place."""
    nav = nodes.where("type = 'nav'")
    return spatial.nearest(places, nav, "uid", "id", "ord").select("uid", F.col("id").alias("node"))


def route_lengths(stops: DataFrame, anchors: DataFrame, edges: DataFrame, source: str = "src") -> DataFrame:
    """(uid, dist) walked from the node ``source`` to each place; unreachable places have no row."""
    tree = graph.shortest(edges, stops.select(F.col(source).alias("src")), anchors.select("node"))
    return anchors.join(tree, anchors["node"] == tree["node"]).select("uid", "src", "dist")


def plan_route(areas: DataFrame, query: list[float], robot: tuple[float, float, float], nodes: DataFrame, edges: DataFrame, k: int = 5, orderer: Orderer = by_score) -> DataFrame:
    """leg, uid, from_node, to_node, length, path_nodes, total: the shortlist in visiting order and the walk between its stops.

    path_nodes runs from from_node to to_node; total is the length walked up to the leg's end.  A
    leg without a path is left out and the next one starts where the last reached stop was.
    """
    spark = areas.sparkSession
    found = hierarchy.descend(areas, query, robot, k=k).collect()  # at most k rows
    order = [u for u in order_route([r.asDict() for r in found], orderer) if u != REQUESTER]
    schema = "leg int, uid long, from_node string, to_node string, length double, path_nodes array<string>, total double"
    if not order:
        return spark.createDataFrame([], schema)
    places = areas.where(F.col("uid").isin(order)).select("uid", "x", "y", "z").unionByName(spark.createDataFrame([(-1, *map(float, robot))], "uid long, x double, y double, z double"))
    node_of = {r.uid: r.node for r in attach(places, nodes).collect()}  # the stops
    sources = spark.createDataFrame([(n,) for n in sorted(set(node_of.values()))], "src string")
    tree = materialize(graph.shortest(edges, sources), "plan")
    dist = {(r.src, r.node): r.dist for r in tree.join(sources.withColumnRenamed("src", "node"), "node", "left_semi").collect()}  # stops by stops
    legs, at, total = [], node_of[-1], 0.0
    for u in order:
        to = node_of.get(u)
        if (length := dist.get((at, to))) is not None:
            total += length
            legs.append((len(legs), u, at, to, float(length), total))
            at = to
    walked = spark.createDataFrame(legs, "leg int, uid long, from_node string, to_node string, length double, total double")
    steps = graph.path_nodes(tree, walked.select(F.col("from_node").alias("src"), F.col("to_node").alias("target")))
    paths = steps.groupBy("src", "target").agg(F.reverse(F.array_sort(F.collect_list(F.struct("step", "node")))).alias("p"))
    paths = paths.select(F.col("src").alias("from_node"), F.col("target").alias("to_node"), F.transform("p", lambda x: x["node"]).alias("path_nodes"))
    return walked.join(paths, ["from_node", "to_node"]).select("leg", "uid", "from_node", "to_node", "length", "path_nodes", "total")


def plan_iteratively(areas: DataFrame, query: list[float], robot: tuple[float, float, float], choose: Callable[[list[dict], int], object] | None = None, k: int = 5, most: int = 8) -> list:
    """Stops chosen one at a time, each search from the last stop; DONE is not taken as a first answer."""
    stops: list = []
    at = robot
    for step in range(most):
        rest = areas.where(~F.col("uid").isin(stops)) if stops else areas
        found = [r.asDict() for r in hierarchy.descend(rest, query, at, k=k).collect()]
        if not found:
            break
        answer = choose(found, step) if choose else found[0]["uid"]
        if answer == "DONE":
            if step:
                break
            answer = found[0]["uid"]
        stops.append(answer)
        p = areas.where(F.col("uid") == answer).select("x", "y", "z").first()
        at = (p.x, p.y, p.z)
    return stops
