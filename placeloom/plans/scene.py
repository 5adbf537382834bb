"""Scene tables derived from the driver's tables, the same in Spark and in SQL (FIXTURES.md, part C)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Tags of a part as text that both engines read; null means that the tag is absent.
TAGS = {
    "building": "CASE WHEN p_partkey % 7 = 0 THEN CASE p_partkey % 4 WHEN 0 THEN 'university' WHEN 1 THEN 'dormitory' WHEN 2 THEN 'garage' ELSE 'yes' END END",
    "building:levels": "CASE WHEN p_partkey % 14 = 0 THEN CAST(p_size AS VARCHAR(10)) END",
    "highway": "CASE WHEN p_partkey % 5 = 1 THEN CASE p_partkey % 3 WHEN 0 THEN 'footway' WHEN 1 THEN 'primary' ELSE 'path' END END",
    "power": "CASE WHEN p_partkey % 11 = 0 THEN 'line' END",
    "boundary": "CASE WHEN p_partkey % 17 = 0 THEN 'administrative' END",
    "amenity": "CASE WHEN p_partkey % 6 = 2 THEN CASE p_partkey % 4 WHEN 0 THEN 'parking' WHEN 2 THEN 'school' ELSE 'charging_station' END END",
    "leisure": "CASE WHEN p_partkey % 9 = 4 THEN CASE p_partkey % 2 WHEN 0 THEN 'pitch' ELSE 'garden' END END",
    "landuse": "CASE WHEN p_partkey % 10 = 3 THEN CASE p_partkey % 3 WHEN 0 THEN 'retail' WHEN 1 THEN 'basin' ELSE 'grass' END END",
    "natural": "CASE WHEN p_partkey % 12 = 5 THEN CASE p_partkey % 2 WHEN 1 THEN 'water' ELSE 'wood' END END",
    "name": "CASE WHEN p_partkey % 3 = 0 THEN p_name END",
    "ref": "CASE WHEN p_partkey % 8 = 1 THEN p_brand END",
    "source": "CASE WHEN p_partkey % 2 = 0 THEN 'survey' END",
    "addr:street": "CASE WHEN p_partkey % 4 = 1 THEN p_type END",
}
TAG_SQL = "tagged AS (SELECT p_partkey AS uid, p_retailprice AS area, " + ", ".join(f'{v} AS "{k}"' for k, v in TAGS.items()) + " FROM part)"

OBJECTS_SQL = """objects AS (
  SELECT vec_id AS uid, 'S' || (vec_id % 2) AS session, vec_id AS ord, 20.0 * CAST(embedding[1] AS DOUBLE) AS x, 20.0 * CAST(embedding[2] AS DOUBLE) AS y, 20.0 * CAST(embedding[3] AS DOUBLE) AS z,
         0.2 + 2.0 * abs(CAST(embedding[4] AS DOUBLE)) AS hx, 0.2 + 2.0 * abs(CAST(embedding[5] AS DOUBLE)) AS hy, 0.2 + 2.0 * abs(CAST(embedding[6] AS DOUBLE)) AS hz,
         'L' || label AS label, 0.5 + abs(CAST(embedding[7] AS DOUBLE)) / 2 AS conf, 1 + vec_id % 7 AS support, embedding FROM embeddings)"""
VOTES_SQL = """votes AS (
  SELECT vec_id AS uid, 'L' || label AS label, CAST(3 AS BIGINT) AS n, 0 AS pos FROM embeddings
  UNION ALL SELECT vec_id, 'L' || ((label + 1) % 10), 1 + vec_id % 2, 1 FROM embeddings)"""
POSES_SQL = """poses AS (
  SELECT user_id AS session, row_number() OVER o - 1 AS seq, sum(value / 10) OVER o AS x, CAST(sum(event_id % 7 - 3) OVER o AS DOUBLE) AS y, CAST(0 AS DOUBLE) AS z
  FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))"""
ROUTE_SQL = POSES_SQL + """, route_nodes AS (
  SELECT session || '_' || seq AS id, session, seq, session * 1000000 + seq AS ord, x, y, z FROM poses WHERE seq % 5 = 0
), route_edges AS (
  SELECT * FROM (SELECT id AS source_id, lead(id) OVER (PARTITION BY session ORDER BY seq) AS target_id FROM route_nodes) WHERE target_id IS NOT NULL
)"""
AREAS_SQL = OBJECTS_SQL + """, areas AS (
  SELECT label, avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS n, min(x) AS x0, max(x) AS x1 FROM objects GROUP BY label)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda k: F.col("embedding")[k].cast("double")
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("uid"), F.concat(F.lit("S"), F.col("vec_id") % 2).alias("session"), F.col("vec_id").alias("ord"),
        *[(20.0 * e(k)).alias(c) for k, c in enumerate("xyz")], *[(0.2 + 2.0 * F.abs(e(3 + k))).alias(f"h{c}") for k, c in enumerate("xyz")],
        F.concat(F.lit("L"), "label").alias("label"), (0.5 + F.abs(e(6)) / 2).alias("conf"), (1 + F.col("vec_id") % 7).alias("support"), "embedding",
    )


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "embeddings")
    own = v.select(F.col("vec_id").alias("uid"), F.concat(F.lit("L"), "label").alias("label"), F.lit(3).cast("long").alias("n"), F.lit(0).alias("pos"))
    return own.unionByName(v.select(F.col("vec_id").alias("uid"), F.concat(F.lit("L"), (F.col("label") + 1) % 10).alias("label"), (1 + F.col("vec_id") % 2).alias("n"), F.lit(1).alias("pos")))


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    run = w.rowsBetween(W.unboundedPreceding, 0)
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("session"), (F.row_number().over(w) - 1).cast("long").alias("seq"), F.sum(F.col("value") / 10).over(run).alias("x"),
        F.sum(F.col("event_id") % 7 - 3).over(run).cast("double").alias("y"), F.lit(0.0).alias("z"),
    )


def route(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): every fifth pose, and the edges between neighbours."""
    nodes = poses(spark, sf_dir).where("seq % 5 = 0")
    nodes = nodes.select(F.concat_ws("_", F.col("session").cast("string"), F.col("seq").cast("string")).alias("id"), "session", "seq", (F.col("session") * 1000000 + F.col("seq")).alias("ord"), *"xyz", F.lit("nav").alias("type"))
    edges = nodes.select(F.col("id").alias("source_id"), F.lead("id").over(W.partitionBy("session").orderBy("seq")).alias("target_id")).where("target_id IS NOT NULL")
    return nodes, edges


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, area and tags of every part."""
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.expr(v).alias("v")) for k, v in TAGS.items()])
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("uid"), F.col("p_retailprice").alias("area"), F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull())).alias("tags"))


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One area for each label: uid, its members' mean position and mean unit embedding."""
    from placeloom.functions import vector

    o = objects(spark, sf_dir)
    e = o.select("label", F.posexplode("embedding").alias("k", "v")).groupBy("label", "k").agg(F.avg(F.col("v").cast("double")).alias("m"))
    e = e.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("k", "m"))).alias("s")).select("label", vector.unit(F.transform("s", lambda t: t["m"])).alias("embedding"))
    a = o.groupBy("label").agg(*[F.avg(c).alias(c) for c in "xyz"], F.count("*").alias("n"))
    return a.join(e, "label").select(F.expr("cast(substring(label, 2) as long)").alias("uid"), F.lit("area").alias("level"), F.lit(None).cast("long").alias("parent"), F.expr("cast(substring(label, 2) as long)").alias("ord"), *"xyz", "n", "embedding", "label")
