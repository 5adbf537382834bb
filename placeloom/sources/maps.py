"""Readers and writers of map artefacts: graph documents, GeoJSON, element dumps, tables, clouds."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placeloom.functions import tags as T

POINT = "array<struct<lat:double,lon:double>>"
SCENE = (
    "nodes array<struct<uid:long,level:string,parent:long,children:array<long>,name:string,desc:string,label:string,supp:long,conf:double,"
    "geom:struct<type:string,frame:string,coords:array<array<double>>,offset:array<double>,half_size:array<double>,quat_xyzw:array<double>>,"
    "votes:map<string,long>,attrs:map<string,string>>>, edges array<struct<source:long,target:long,edge_type:string>>, emb_model_id string"
)
ROUTE = "nodes array<struct<id:string,pos:array<double>,type:string,seq:long,session:string,poi_uid:long>>, edges array<struct<source_id:string,target_id:string,source:string>>"
ELEMENTS = f"elements array<struct<type:string,id:long,tags:map<string,string>,geometry:{POINT}>>"
FEATURES = "features array<struct<id:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def read_scene(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of scene documents; a node's absent children, name or level get empty values."""
    doc = spark.read.schema(SCENE).json(path, multiLine=True)
    nodes = doc.select(F.inline("nodes"))
    nodes = nodes.withColumns({"children": F.coalesce("children", F.array().cast("array<long>")), "name": F.coalesce("name", F.lit("")), "desc": F.coalesce("desc", F.lit("")), "level": F.coalesce("level", F.lit("object"))})
    return nodes, doc.select(F.inline("edges"))


def read_route(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of route documents; the default type is nav, the default source osm."""
    doc = spark.read.schema(ROUTE).json(path, multiLine=True)
    nodes = doc.select(F.inline("nodes")).select("id", *[F.col("pos")[k].alias(c) for k, c in enumerate("xyz")], F.coalesce("type", F.lit("nav")).alias("type"), "seq", "session", "poi_uid")
    return nodes, doc.select(F.inline("edges")).withColumn("source", F.coalesce("source", F.lit("osm")))


def duplicate_uids(nodes: DataFrame) -> DataFrame:
    """uids that occur more than once: must be empty before a graph is used."""
    return nodes.groupBy("uid").agg(F.count("*").alias("n")).where("n > 1")


def parse_elements(elements: DataFrame, deduplicate: bool = True) -> DataFrame:
    """Typed features of element rows (pos, type, id, tags, geometry): kind, category, primary_tag.

    Unknown types and elements without geometry are dropped; of equal (type, id) the first parsed
    one by ``pos`` stays.
    """
    ok = elements.where(F.col("type").isin("node", "way", "relation") & (F.size(F.coalesce("geometry", F.array().cast(POINT))) > 0))
    tag = F.coalesce("tags", F.create_map().cast("map<string,string>"))
    out = ok.withColumn("tags", tag)
    out = out.withColumns({"kind": T.geometry_kind(F.col("type"), F.col("tags"), F.col("geometry")), "category": T.category(F.col("tags")), "primary_tag": T.primary_key(F.col("tags"))})
    if deduplicate:
        out = out.withColumn("__k", F.row_number().over(W.partitionBy("type", "id").orderBy("pos"))).where("__k = 1").drop("__k")
    return out


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """Elements of captured answers of a map server, with their place in the file."""
    return spark.read.schema(ELEMENTS).json(path, multiLine=True).select(F.posexplode("elements").alias("pos", "e")).select("pos", "e.*")


def read_geojson_polygons(spark: SparkSession, path: str) -> DataFrame:
    """pos, type, id, tags, geometry (outer ring, lat/lon) of polygon features; ids read ``type/number``, other types count as way."""
    feats = spark.read.schema(FEATURES).json(path, multiLine=True).select(F.posexplode("features").alias("pos", "f"))
    poly = feats.where("f.geometry.type = 'Polygon'").withColumn("rings", F.from_json("f.geometry.coordinates", "array<array<array<double>>>"))
    part = F.split("f.id", "/")
    return poly.select(
        "pos",
        F.when(part[0].isin("node", "way", "relation"), part[0]).otherwise("way").alias("type"),
        F.expr("try_cast(element_at(split(f.id, '/'), -1) as bigint)").alias("id"),
        F.col("f.properties").alias("tags"),
        F.transform(F.col("rings")[0], lambda p: F.struct(p[1].alias("lat"), p[0].alias("lon"))).alias("geometry"),
    )


def tag_table(features: DataFrame, prefix: list[str], tags: str = "tags") -> DataFrame:
    """One column per key: ``prefix`` first, then the keys in order; absent values are empty."""
    keys = [r.k for r in features.select(F.explode(F.map_keys(tags)).alias("k")).distinct().orderBy("k").collect()]  # the schema
    rest = [k for k in keys if k not in prefix]
    return features.select(*prefix, *[F.coalesce(F.col(tags)[k], F.lit("")).alias(k) for k in rest])


def to_document(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row ``document`` with nodes (by uid) and edges as JSON; meant for graphs that one file can hold."""
    n = nodes.agg(F.array_sort(F.collect_list(F.struct(*nodes.columns))).alias("nodes"))
    e = edges.agg(F.array_sort(F.collect_list(F.struct(*edges.columns))).alias("edges"))
    return n.withColumn("__k", F.lit(1)).join(e.withColumn("__k", F.lit(1)), "__k").select(F.to_json(F.struct("nodes", "edges")).alias("document"))


def to_geojson(features: DataFrame) -> DataFrame:
    """``feature`` (JSON) of rows with type, id, kind, tags and geometry."""
    lonlat = F.transform("geometry", lambda p: F.array(p["lon"], p["lat"]))
    shape = (
        F.when(F.col("kind") == "polygon", F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(lonlat).alias("coordinates"))))
        .when(F.col("kind") == "point", F.to_json(F.struct(F.lit("Point").alias("type"), lonlat[0].alias("coordinates"))))
        .otherwise(F.to_json(F.struct(F.lit("LineString").alias("type"), lonlat.alias("coordinates"))))
    )
    head = F.concat(F.lit('{"type":"Feature","id":"'), F.col("type"), F.lit("/"), F.col("id").cast("string"), F.lit('","properties":'), F.to_json("tags"), F.lit(',"geometry":'), shape, F.lit("}"))
    return features.select("type", "id", head.alias("feature"))


def annotations(nodes: DataFrame) -> DataFrame:
    """uid, role, category, function, name, description of nodes that have a role, by uid."""
    return nodes.where("role <> ''").select("uid", "role", "category", "function", "name", "description").orderBy("uid")


def read_poses(spark: SparkSession, path: str) -> DataFrame:
    """session (file name), seq, x, y, z, qx, qy, qz, qw of pose files: seven numbers a line, in line order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, data in zip(f.path, f.content):
                rows = np.loadtxt(io.BytesIO(data), ndmin=2)
                yield pd.DataFrame(rows, columns=["x", "y", "z", "qx", "qy", "qz", "qw"]).assign(session=p.rsplit("/", 1)[-1].rsplit(".", 1)[0], seq=np.arange(len(rows)))[["session", "seq", "x", "y", "z", "qx", "qy", "qz", "qw"]]

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "session string, seq long, x double, y double, z double, qx double, qy double, qz double, qw double")


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """uid, session, x, y, z, label, conf, support of session archives (arrays per attribute, never pickled ones).

    A missing uid falls back on track_id, then on the place in the file.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, data in zip(f.path, f.content):
                with np.load(io.BytesIO(data), allow_pickle=False) as z:
                    c = z["centers"]
                    n = len(c)
                    get = lambda k, d, z=z, n=n: z[k] if k in z.files else d(n)
                    uid = z["uid"] if "uid" in z.files else get("track_id", np.arange)
                    yield pd.DataFrame(
                        {
                            "uid": uid.astype("int64"), "session": p.rsplit("/", 1)[-1].rsplit(".", 1)[0], "x": c[:, 0], "y": c[:, 1], "z": c[:, 2],
                            "label": get("labels", lambda n: np.full(n, "")).astype(str), "conf": get("conf", np.zeros).astype(float), "support": get("support", np.zeros).astype("int64"),
                        }
                    )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "uid long, session string, x double, y double, z double, label string, conf double, support long")


def write_session(objects: DataFrame, path: str) -> None:
    """The native form: Parquet by session; a session that is written again replaces its own part only."""
    spark = objects.sparkSession
    old = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        objects.write.mode("overwrite").partitionBy("session").parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", old)


def ply_vertices(points: DataFrame) -> DataFrame:
    """``vertex`` (binary, little-endian floats and colour bytes) of each point, for a cloud file's body."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kind = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("r", "u1"), ("g", "u1"), ("b", "u1")])
        for f in frames:
            rows = np.empty(len(f), kind)
            for c in kind.names:
                rows[c] = f[c].to_numpy()
            yield pd.DataFrame({"vertex": [r.tobytes() for r in rows]})

    return points.select("x", "y", "z", "r", "g", "b").mapInPandas(run, "vertex binary")


def tiles_for(spark: SparkSession, low: tuple[int, int], high: tuple[int, int]) -> DataFrame:
    """All map tiles (x, y) of a rectangle, row by row, with their place ``k``."""
    w, h = high[0] - low[0] + 1, high[1] - low[1] + 1
    return spark.range(w * h).select((F.col("id") % w + low[0]).alias("x"), (F.floor(F.col("id") / w) + low[1]).alias("y"), F.col("id").alias("k"))
