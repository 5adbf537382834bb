"""Readers, writers and streaming twins against their batch operators."""

import json

import numpy as np
from pyspark.sql import functions as F

from placeloom.operators import clouds, tracks
from placeloom.sources import maps
from placeloom.streaming import incremental


def test_elements_and_geojson(spark, tmp_path):
    ring = [{"lat": 0, "lon": 0}, {"lat": 0, "lon": 1}, {"lat": 1, "lon": 1}, {"lat": 0, "lon": 0}]
    els = [{"type": "way", "id": 1, "tags": {"building": "yes"}, "geometry": ring}, {"type": "way", "id": 1, "tags": {"highway": "path"}, "geometry": ring}, {"type": "area", "id": 2, "geometry": ring}, {"type": "node", "id": 3, "geometry": []}]
    p = tmp_path / "e.json"
    p.write_text(json.dumps({"elements": els}))
    f = maps.parse_elements(maps.read_elements(spark, f"file://{p}")).collect()
    assert [(r.id, r.kind, r.category, r.primary_tag) for r in f] == [(1, "polygon", "building", "building")]
    g = maps.to_geojson(maps.parse_elements(maps.read_elements(spark, f"file://{p}"))).first().feature
    doc = json.loads(g)
    assert doc["geometry"]["type"] == "Polygon" and doc["geometry"]["coordinates"][0][1] == [1.0, 0.0]
    q = tmp_path / "g.json"
    q.write_text(json.dumps({"type": "FeatureCollection", "features": [doc]}))
    back = maps.read_geojson_polygons(spark, f"file://{q}").first()
    assert (back.type, back.id, back.geometry[1].lon) == ("way", 1, 1.0)


def test_route_and_scene_documents(spark, tmp_path):
    p = tmp_path / "r.json"
    p.write_text(json.dumps({"nodes": [{"id": "a", "pos": [1, 2, 3]}], "edges": [{"source_id": "a", "target_id": "a"}]}))
    nodes, edges = maps.read_route(spark, f"file://{p}")
    assert nodes.first().type == "nav" and edges.first().source == "osm"
    q = tmp_path / "s.json"
    q.write_text(json.dumps({"nodes": [{"uid": 4, "level": "area", "votes": {"chair": 2}}, {"uid": 4}], "edges": []}))
    nodes, _ = maps.read_scene(spark, f"file://{q}")
    assert nodes.where("level = 'area'").first().votes == {"chair": 2} and maps.duplicate_uids(nodes).first().n == 2


def test_arrays_poses_and_native_sessions(spark, tmp_path):
    np.savez(tmp_path / "s1.npz", centers=np.eye(3), track_id=np.array([5, 6, 7]), conf=np.ones(3))
    a = maps.read_arrays(spark, f"file://{tmp_path}/s1.npz")
    assert sorted(r.uid for r in a.collect()) == [5, 6, 7] and a.first().session == "s1"
    (tmp_path / "p.txt").write_text("0 0 0 0 0 0 1\n1 0 0 0 0 0 1\n")
    assert [r.x for r in maps.read_poses(spark, f"file://{tmp_path}/p.txt").orderBy("seq").collect()] == [0, 1]
    out = f"file://{tmp_path}/native"
    maps.write_session(a, out)
    maps.write_session(a.withColumn("session", F.lit("s2")), out)
    maps.write_session(a.limit(1), out)
    assert {r.session: r["count"] for r in spark.read.parquet(out).groupBy("session").count().collect()} == {"s1": 1, "s2": 3}


def stream(spark, df, path, parts=3):
    df.repartition(parts).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def finish(spark, df, name, mode="update"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_streamed_voxels_equal_batch(spark, tmp_path):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([tuple(map(float, r)) for r in rng.uniform(-2, 2, (60, 3))], "x double, y double, z double")
    found = finish(spark, incremental.voxel_sums(stream(spark, df, f"file://{tmp_path}/v"), 1.0), "voxels")
    last = found.groupBy("ix", "iy", "iz").agg(F.max_by(F.struct("n", "sx"), "n").alias("m")).select("ix", "iy", "iz", "m.n", F.round(F.col("m.sx") / F.col("m.n"), 6).alias("x"))
    batch = clouds.voxel_mean(df.withColumns({c: F.lit(0) for c in "rgb"}), 1.0).select("ix", "iy", "iz", "n", F.round("x", 6).alias("x"))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, batch.collect()))


def test_streamed_flags_equal_batch(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [("s", t, k, float(k * (3 if t == 1 else 0.01)), float(rng.normal()) * 0.001, 0.0) for t in range(2) for k in range(12)]
    df = spark.createDataFrame(rows, "session string, track_id long, seq long, x double, y double, z double")
    src = df.orderBy("seq").coalesce(1)
    src.write.parquet(f"file://{tmp_path}/d")
    s = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/d")
    got = {r.track_id: r.dynamic for r in finish(spark, incremental.sticky_tracks(s, 1.0), "flags").collect()}
    want = {r.track_id: r.dynamic for r in tracks.sticky_dynamic(df, ["session", "track_id"], 1.0).where("seq = 11").collect()}
    assert got == want == {0: False, 1: True}
