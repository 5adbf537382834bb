"""Registered queries of the scene operators, each with the SQL that defines it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.functions import geo, vector
from placeloom.functions import tags as T
from placeloom.operators import clouds, clusters, graph, hierarchy, nearpaths, ranking, resolve, spatial, tracks
from placeloom.operators.store import materialize
from placeloom.plans import planner, scene
from placeloom.sources import maps

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def r4(c: str | Column, name: str | None = None) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 4).alias(name or c)


O, V, P, R, A, G = (f"WITH {x}" for x in (scene.OBJECTS_SQL, scene.VOTES_SQL, scene.POSES_SQL, scene.ROUTE_SQL, scene.AREAS_SQL, scene.TAG_SQL))
OV = f"WITH {scene.OBJECTS_SQL}, {scene.VOTES_SQL}"
DIST = "sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))"
SHARED = " * ".join(f"greatest(0, least(a.{c}+a.h{c}, b.{c}+b.h{c}) - greatest(a.{c}-a.h{c}, b.{c}-b.h{c}))" for c in "xyz")
VOL = lambda s: f"(8*{s}.hx*{s}.hy*{s}.hz)"
DIAG = lambda s: f"sqrt({s}.hx*{s}.hx+{s}.hy*{s}.hy+{s}.hz*{s}.hz)"


# ---- tags, kinds, classification

@query(G + """ SELECT uid, CASE WHEN area < 905 OR area > 1900 THEN 'excluded' WHEN boundary <> '' THEN 'boundary' WHEN highway <> '' THEN 'pathway'
 WHEN power <> '' AND building IS NULL AND amenity IS NULL AND leisure IS NULL AND landuse IS NULL AND "natural" IS NULL THEN 'infrastructure' ELSE 'hierarchy' END AS disposition FROM tagged""")
def f1_polygon_disposition(spark, d):
    return scene.tagged(spark, d).select("uid", T.disposition(F.col("tags"), F.col("area"), 905, 1900).alias("disposition"))


@query(G + """, ok AS (SELECT *, CASE WHEN area < 905 OR area > 1900 THEN 'excluded' WHEN boundary <> '' THEN 'boundary' WHEN highway <> '' THEN 'pathway'
 WHEN power <> '' AND building IS NULL AND amenity IS NULL AND leisure IS NULL AND landuse IS NULL AND "natural" IS NULL THEN 'infrastructure' ELSE 'hierarchy' END AS disp FROM tagged)
 SELECT uid AS source_id, row_number() OVER (ORDER BY uid) AS uid FROM ok WHERE disp = 'hierarchy'""")
def f2_seed_graph(spark, d):
    ok = scene.tagged(spark, d).where(T.disposition(F.col("tags"), F.col("area"), 905, 1900) == "hierarchy")
    return ranking.numbered(ok.select(F.col("uid").alias("source_id")), "source_id", name="uid")


@query(G + " SELECT uid, coalesce(uid % 2 = 0 AND highway IN ('footway','path','pedestrian','steps','cycleway','living_street'), false) AS walkable FROM tagged")
def f3_walkable(spark, d):
    kind = F.when(F.col("uid") % 2 == 0, "linestring").otherwise("polygon")
    return scene.tagged(spark, d).select("uid", T.walkable(kind, F.col("tags")).alias("walkable"))


@query(G + """ SELECT uid, CASE WHEN uid % 6 = 1 THEN 'point' WHEN uid % 6 >= 4 THEN 'polygon' ELSE 'linestring' END AS kind FROM tagged""")
def f4_geometry_kind(spark, d):
    ring = F.transform(F.sequence(F.lit(1), F.greatest(F.col("uid") % 6, F.lit(1))), lambda i: F.struct((i % (F.greatest(F.col("uid") % 6, F.lit(2)) - 1)).cast("double").alias("lat"), F.lit(1.0).alias("lon")))
    ring = F.when(F.col("uid") % 6 == 0, F.array(F.struct(F.lit(0.0).alias("lat"), F.lit(1.0).alias("lon")), F.struct(F.lit(2.0).alias("lat"), F.lit(1.0).alias("lon")))).otherwise(ring)
    return scene.tagged(spark, d).select("uid", T.geometry_kind(F.lit("way"), F.map_filter("tags", lambda k, v: k == "name"), ring).alias("kind"))


@query(G + " SELECT uid, CASE WHEN building IS NOT NULL THEN 'building' WHEN highway IS NOT NULL THEN 'highway' END AS category FROM tagged")
def f5_category(spark, d):
    return scene.tagged(spark, d).select("uid", T.category(F.col("tags")).alias("category"))


PRIMARY = "CASE " + " ".join(f"WHEN \"{k}\" IS NOT NULL THEN '{k}'" for k in sorted(scene.TAGS)) + " ELSE 'untagged' END"


@query(G + f" SELECT uid, {PRIMARY} AS primary_tag FROM tagged")
def f6_primary_tag(spark, d):
    return scene.tagged(spark, d).select("uid", T.primary_key(F.col("tags")).alias("primary_tag"))


CONTEXT = [k for k in sorted(scene.TAGS) if k not in ("ref", "source") and not k.startswith("addr:")]


@query(G + " SELECT uid, concat_ws(',', " + ", ".join(f"CASE WHEN \"{k}\" IS NOT NULL THEN '{k}' END" for k in CONTEXT) + ") AS keys FROM tagged")
def f7_context_tags(spark, d):
    return scene.tagged(spark, d).select("uid", F.array_join(F.array_sort(F.map_keys(T.context(F.col("tags")))), ",").alias("keys"))


PLAIN = [k for k in sorted(scene.TAGS) if k != "source" and not k.startswith("addr:")]
HINT = "array_to_string(list_slice(list_filter([" + ", ".join(f"CASE WHEN \"{k}\" IS NOT NULL THEN '{k}=' || \"{k}\" END" for k in PLAIN) + "], lambda x: x IS NOT NULL), 1, 4), ', ')"
CLASSIFY = f"""c AS (SELECT *, coalesce(nullif(name, ''), nullif(ref, '')) AS called,
 CASE WHEN building <> '' THEN 'structure' WHEN amenity = 'parking' THEN 'parking' WHEN leisure = 'pitch' THEN 'pitch' WHEN leisure = 'garden' THEN 'park' WHEN landuse <> '' THEN 'landuse' WHEN "natural" <> '' THEN 'natural' WHEN amenity <> '' THEN 'amenity' ELSE 'none' END AS rule FROM tagged)"""


@query(G + f""", {CLASSIFY} SELECT uid,
 CASE rule WHEN 'structure' THEN 'structure' WHEN 'parking' THEN 'facility' WHEN 'pitch' THEN 'facility' WHEN 'amenity' THEN 'facility' WHEN 'none' THEN 'unclassified' ELSE 'region_use' END AS role,
 CASE rule WHEN 'structure' THEN 'building' WHEN 'parking' THEN 'parking' WHEN 'pitch' THEN 'recreation' WHEN 'park' THEN 'vegetation' WHEN 'landuse' THEN CASE WHEN landuse = 'basin' THEN 'water' ELSE 'vegetation' END
  WHEN 'natural' THEN CASE WHEN "natural" = 'water' THEN 'water' ELSE 'vegetation' END WHEN 'amenity' THEN 'service_point' ELSE 'unknown' END AS category,
 CASE rule WHEN 'structure' THEN CASE building WHEN 'university' THEN 'academic' WHEN 'dormitory' THEN 'residential' WHEN 'garage' THEN 'utility' ELSE 'unknown' END WHEN 'parking' THEN 'transport' WHEN 'pitch' THEN 'sports'
  WHEN 'landuse' THEN CASE WHEN landuse = 'retail' THEN 'retail' ELSE 'none' END WHEN 'park' THEN 'none' WHEN 'natural' THEN 'none' WHEN 'amenity' THEN CASE amenity WHEN 'school' THEN 'academic' WHEN 'charging_station' THEN 'transport' ELSE 'unknown' END ELSE 'unknown' END AS function,
 coalesce(called, '') AS name,
 left(CASE rule WHEN 'structure' THEN coalesce(called, building || ' building') || coalesce(', ' || "building:levels" || ' levels', '') WHEN 'parking' THEN coalesce(called, 'vehicle parking area') WHEN 'pitch' THEN coalesce(called, 'pitch area (pitch)')
  WHEN 'park' THEN coalesce(called, leisure || ' area') WHEN 'landuse' THEN coalesce(called, landuse || ' land') WHEN 'natural' THEN coalesce(called, "natural" || ' area') WHEN 'amenity' THEN coalesce(called, amenity || ' facility')
  ELSE CASE WHEN {HINT} <> '' THEN 'unclassified area (' || {HINT} || ')' ELSE 'unclassified area' END END, 240) AS "desc" FROM c""")
def f8_classify(spark, d):
    return scene.tagged(spark, d).select("uid", T.classify(F.col("tags")).alias("c")).select("uid", "c.*")


@query(G + " SELECT uid, coalesce(nullif(name, ''), nullif(ref, ''), '') AS name FROM tagged")
def f9_name(spark, d):
    return scene.tagged(spark, d).select("uid", T.name(F.col("tags")).alias("name"))


@query(G + f""", {CLASSIFY} SELECT CASE WHEN rule = 'structure' THEN 'structure' ELSE 'region' END AS level, count(*) AS n FROM c GROUP BY 1""")
def f10_feature_levels(spark, d):
    t = scene.tagged(spark, d).select(F.when(T.classify(F.col("tags"))["role"] == "structure", "structure").otherwise("region").alias("level"))
    return t.groupBy("level").agg(F.count("*").alias("n"))


@query(O + " SELECT uid, round((conf + support / 7.0) / 2, 4) AS score FROM objects WHERE conf >= 0.55")
def f11_score_gate(spark, d):
    return scene.objects(spark, d).where("conf >= 0.55").select("uid", r4((F.col("conf") + F.col("support") / 7.0) / 2, "score"))


@query(O + """, p AS (SELECT uid, x, y, z, sqrt(x*x+y*y+z*z) AS dist, 320 * x / z + 320 AS u, 320 * y / z + 240 AS v FROM objects WHERE z > 0)
 SELECT uid, round(u, 4) AS u, round(v, 4) AS v FROM p WHERE dist <= 8 AND u >= 0 AND u < 640 AND v >= 0 AND v < 480""")
def f12_quality_gate(spark, d):
    u, v = geo.project([F.col(c) for c in "xyz"], 320.0, 320.0, 320.0, 240.0)
    o = scene.objects(spark, d).withColumns({"u": u, "v": v, "dist": F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)})
    return o.where("z > 0 AND dist <= 8 AND u >= 0 AND u < 640 AND v >= 0 AND v < 480").select("uid", r4("u"), r4("v"))


@query(O + """, c AS (SELECT uid, x + i * hx AS x, y + j * hy AS y, z + k * hz AS z FROM objects, (VALUES (-1), (1)) a(i), (VALUES (-1), (1)) b(j), (VALUES (-1), (1)) c(k)),
 b AS (SELECT uid, min(z) AS zmin, min(320*x/z+320) AS u0, max(320*x/z+320) AS u1, min(320*y/z+240) AS v0, max(320*y/z+240) AS v1 FROM c GROUP BY uid)
 SELECT uid, CASE WHEN zmin <= 0.001 THEN 0.0 ELSE round(greatest(0, least(u1, 640) - greatest(u0, 0)) * greatest(0, least(v1, 480) - greatest(v0, 0)) / ((u1 - u0) * (v1 - v0)), 4) END AS visible FROM b""")
def f13_visible_fraction(spark, d):
    sign = F.array(F.lit(-1), F.lit(1))
    o = scene.objects(spark, d).select("uid", *"xyz", "hx", "hy", "hz", F.explode(sign).alias("i")).select("*", F.explode(sign).alias("j")).select("*", F.explode(sign).alias("k"))
    c = o.select("uid", (F.col("x") + F.col("i") * F.col("hx")).alias("x"), (F.col("y") + F.col("j") * F.col("hy")).alias("y"), (F.col("z") + F.col("k") * F.col("hz")).alias("z"))
    c = c.withColumns({"u": F.try_divide(320 * F.col("x"), F.col("z")) + 320, "v": F.try_divide(320 * F.col("y"), F.col("z")) + 240})
    b = c.groupBy("uid").agg(F.min("z").alias("zmin"), F.min("u").alias("u0"), F.max("u").alias("u1"), F.min("v").alias("v0"), F.max("v").alias("v1"))
    side = lambda a, n: F.greatest(F.lit(0.0), F.least(F.col(f"{a}1"), F.lit(n)) - F.greatest(F.col(f"{a}0"), F.lit(0.0)))
    share = side("u", 640.0) * side("v", 480.0) / ((F.col("u1") - F.col("u0")) * (F.col("v1") - F.col("v0")))
    return b.select("uid", F.when(F.col("zmin") <= 1e-3, 0.0).otherwise(F.round(share, 4)).alias("visible"))


@query(O + " SELECT uid FROM objects WHERE label NOT IN ('L1', 'L2', 'L3') AND support >= 3")
def f15_f16_drop_labels_min_support(spark, d):
    return scene.objects(spark, d).where(~F.col("label").isin("L1", "L2", "L3") & (F.col("support") >= 3)).select("uid")


@query(O + ", near AS (SELECT * FROM objects WHERE x*x+y*y <= 4) SELECT count(*) AS n FROM (SELECT uid FROM near WHERE (SELECT count(*) FROM near) >= 20 UNION ALL SELECT uid FROM objects WHERE (SELECT count(*) FROM near) < 20)")
def f17_local_contour(spark, d):
    o = scene.objects(spark, d).withColumn("near", F.col("x") ** 2 + F.col("y") ** 2 <= 4)
    counts = o.agg(F.count_if("near").alias("k"), F.count("*").alias("all"))
    return counts.select(F.when(F.col("k") >= 20, F.col("k")).otherwise(F.col("all")).alias("n"))


@query(P + " SELECT session, seq FROM poses WHERE seq % 4 = 0 AND seq < 40")
def f18_stride(spark, d):
    return tracks.stride(scene.poses(spark, d), 4, 10).select("session", "seq")


# ---- joins

@query(R + """, pairs AS (SELECT a.id AS a, b.id AS b FROM route_nodes a JOIN route_nodes b ON a.ord < b.ord AND sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) <= 2.0003
  AND NOT (a.session = b.session AND abs(a.seq - b.seq) < 15))
 SELECT a, b FROM pairs WHERE NOT EXISTS (SELECT 1 FROM route_edges e WHERE (e.source_id = a AND e.target_id = b) OR (e.source_id = b AND e.target_id = a))""")
def j1_proximity_edges(spark, d):
    nodes, edges = scene.route(spark, d)
    return spatial.proximity_pairs(nodes, edges, 2.0003, 15).select("a", "b")


CAND = f"""pairs AS (SELECT a.uid AS a_uid, b.uid AS b_uid, {DIST} AS d, {DIAG('a')} + {DIAG('b')} AS r, {SHARED} / least({VOL('a')}, {VOL('b')}) AS ios,
  EXISTS (SELECT 1 FROM votes v WHERE v.uid = b.uid AND v.label = a.label) OR EXISTS (SELECT 1 FROM votes v WHERE v.uid = a.uid AND v.label = b.label) AS agree
  FROM objects a, objects b WHERE a.session = 'S0' AND b.session = 'S1'),
 cand AS (SELECT *, d / (r + 1e-9) AS cdiag FROM pairs WHERE d <= r AND (ios >= 0.5 OR (d / (r + 1e-9) < 0.5 AND agree)))"""


@query(OV + f", {CAND} SELECT a_uid, b_uid, round(ios, 4) AS ios, round(cdiag, 4) AS cdiag FROM cand")
def j2_reconcile_candidates(spark, d):
    o = resolve.label_sets(scene.objects(spark, d), scene.votes(spark, d))
    return resolve.candidates(o.where("session = 'S0'"), o.where("session = 'S1'")).select("a_uid", "b_uid", r4("ios"), r4("cdiag"))


OVERLAP = f"""links AS (SELECT a.uid AS u, b.uid AS v, {SHARED} / least({VOL('a')}, {VOL('b')}) AS ios FROM objects a JOIN objects b ON a.uid < b.uid AND {DIST} <= {DIAG('a')} + {DIAG('b')}
  WHERE {SHARED} / least({VOL('a')}, {VOL('b')}) >= 0.5)"""


@query(O + f", {OVERLAP} SELECT u, v, round(ios, 4) AS ios FROM links")
def j3_overlap_pairs(spark, d):
    return resolve.overlap_pairs(scene.objects(spark, d), 0.5).select("u", "v", r4("ios"))


def _turned(spark, d):
    """The objects with boxes turned about the vertical."""
    return scene.objects(spark, d).withColumn("yaw", 2 * 3.141592653589793 * F.abs(F.col("embedding")[7].cast("double")))


@query()
def j2_turned_candidates(spark, d):
    o = resolve.label_sets(_turned(spark, d), scene.votes(spark, d))
    return resolve.candidates(o.where("session = 'S0'"), o.where("session = 'S1'")).select("a_uid", "b_uid", r4("ios"), r4("cdiag"))


@query()
def j3_turned_overlap_pairs(spark, d):
    return resolve.overlap_pairs(_turned(spark, d), 0.5).select("u", "v", r4("ios"))


@query()
def e1_turned_reconcile(spark, d):
    o = _turned(spark, d)
    m = resolve.reconcile(o.where("session = 'S0'"), o.where("session = 'S1'"), scene.votes(spark, d))
    return m.select("uid", "kind", r4("x"), r4("yaw"), "label", r4("conf"), "support", "n_members", F.size("embedding").alias("size"), r4("ios"))


@query(OV + " SELECT DISTINCT o.uid FROM objects o JOIN votes v ON v.label = o.label AND v.uid = o.uid - 1")
def j4_labels_agree(spark, d):
    o, v = scene.objects(spark, d), scene.votes(spark, d)
    return o.join(v.select((F.col("uid") + 1).alias("uid"), "label"), ["uid", "label"], "left_semi").select("uid")


@query()
def j5_suppress_contained(spark, d):
    return resolve.suppress_contained(scene.objects(spark, d), 0.7).select("uid")


RECT = "boxes AS (SELECT uid, 10*x-10*hx AS x0, 10*y-10*hy AS y0, 10*x+10*hx AS x1, 10*y+10*hy AS y1 FROM objects)"


@query(O + f""", {RECT}, b AS (SELECT *, (x1-x0)*(y1-y0) AS area FROM boxes), m AS (SELECT c.uid, p.uid AS parent, row_number() OVER (PARTITION BY c.uid ORDER BY p.area, p.uid) AS k FROM b c JOIN b p ON p.area > c.area
  AND greatest(0, least(c.x1,p.x1)-greatest(c.x0,p.x0)) * greatest(0, least(c.y1,p.y1)-greatest(c.y0,p.y0)) >= 0.9 * c.area)
 SELECT b.uid, m.parent FROM b LEFT JOIN m ON m.uid = b.uid AND m.k = 1""")
def j6_containment_parent(spark, d):
    o = scene.objects(spark, d)
    b = o.select("uid", *[(10 * F.col(c) - 10 * F.col(f"h{c}")).alias(f"{c}0") for c in "xy"], *[(10 * F.col(c) + 10 * F.col(f"h{c}")).alias(f"{c}1") for c in "xy"])
    return hierarchy.box_parents(b)


@query(R + f""", o AS (SELECT vec_id AS uid, 20.0 * CAST(embedding[1] AS DOUBLE) AS x, 20.0 * CAST(embedding[2] AS DOUBLE) AS y, 20.0 * CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
 m AS (SELECT a.uid, b.id AS node, {DIST} AS d, row_number() OVER (PARTITION BY a.uid ORDER BY {DIST}, b.ord) AS k FROM o a, route_nodes b)
 SELECT uid, node, round(d, 4) AS distance FROM m WHERE k = 1""")
def j7_nearest_node(spark, d):
    nodes, _ = scene.route(spark, d)
    return spatial.nearest(scene.objects(spark, d), nodes, "uid", "id", "ord").select("uid", F.col("id").alias("node"), r4("distance"))


@query(R + ", obs AS (SELECT user_id AS uid, event_id % 5 AS frame, user_id AS session FROM events) SELECT obs.uid, n.id AS node FROM obs JOIN route_nodes n ON n.session = obs.session AND n.seq = obs.frame * 5 GROUP BY 1, 2")
def j8_attach_frames(spark, d):
    nodes, _ = scene.route(spark, d)
    obs = scene.read(spark, d, "events").select(F.col("user_id").alias("session"), (F.col("event_id") % 5 * 5).alias("seq"))
    return obs.distinct().join(nodes, ["session", "seq"]).select(F.col("session").alias("uid"), F.col("id").alias("node")).distinct()


@query(O + f" SELECT DISTINCT a.uid FROM objects a JOIN objects b ON b.label IN ('L1', 'L2') AND {DIST} <= 2 WHERE a.label = 'L3'")
def j11_mirror_near_door(spark, d):
    o = scene.objects(spark, d)
    return spatial.near_any(o.where("label = 'L3'").select("uid", *"xyz"), o.where("label IN ('L1', 'L2')").select("uid", *"xyz"), 2.0).select("uid")


SEGMENTS = "segs AS (SELECT a.id AS key, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM route_edges e JOIN route_nodes a ON a.id = e.source_id JOIN route_nodes b ON b.id = e.target_id)"
GATES = "gates AS (SELECT 20.0 * CAST(embedding[1] AS DOUBLE) AS x, 20.0 * CAST(embedding[2] AS DOUBLE) AS y, 0.1 AS hx, 0.2 + 2.0 * abs(CAST(embedding[5] AS DOUBLE)) AS hy FROM embeddings WHERE label = 1)"
CROSS = "abs(x1-x0) >= 1e-9 AND (g.x-x0)/(x1-x0) BETWEEN 0 AND 1 AND abs(y0 + (g.x-x0)/(x1-x0)*(y1-y0) - g.y) <= g.hy + 0.3"


def _gates(spark, d):
    o = scene.objects(spark, d).where("label = 'L1'")
    return o.select(*"xy", F.lit(0.0).alias("z"), F.lit(0.1).alias("hx"), "hy", F.lit(2.0).alias("hz"))


def _segments(spark, d):
    nodes, edges = scene.route(spark, d)
    p, q = (nodes.select(F.col("id").alias(f"{n}_id"), *[F.col(c).alias(f"{s}{c}") for c in "xyz"]) for n, s in (("source", "p0"), ("target", "p1")))
    return edges.join(p, "source_id").join(q, "target_id").select(F.col("source_id").alias("key"), *[f"{s}{c}" for s in ("p0", "p1") for c in "xyz"])


@query(R + f", {SEGMENTS}, {GATES} SELECT key FROM segs WHERE EXISTS (SELECT 1 FROM gates g WHERE {CROSS})")
def j12_edges_cut_by_gates(spark, d):
    return spatial.crossing(_segments(spark, d), _gates(spark, d)).select("key")


@query(R + f", {SEGMENTS}, {GATES} SELECT key FROM segs WHERE NOT EXISTS (SELECT 1 FROM gates g WHERE {CROSS})")
def j12_v2_edges_kept(spark, d):
    return spatial.crossing(_segments(spark, d), _gates(spark, d), kept=True).select("key")


@query(O + f""", m AS (SELECT a.uid, b.uid AS track, {SHARED} / ({VOL('a')} + {VOL('b')} - {SHARED}) AS iou FROM objects a, objects b WHERE a.session = 'S1' AND b.session = 'S0' AND {SHARED} > 0),
 k AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY iou DESC, track) AS k FROM m) SELECT uid, track, round(iou, 4) AS iou FROM k WHERE k = 1 AND iou >= 0.1""")
def j14_track_association(spark, d):
    o = scene.objects(spark, d)
    pairs = spatial.boxes_overlapping(o.where("session = 'S1'"), o.where("session = 'S0'"), 4.0)
    v = [geo.volume([F.col(f"{s}.h{c}") for c in "xyz"]) for s in "lr"]
    pairs = pairs.withColumn("iou", geo.over_union(F.col("shared"), *v))
    best = pairs.groupBy(F.col("l.uid").alias("uid")).agg(F.max_by(F.struct(F.col("r.uid").alias("track"), "iou"), F.struct("iou", -F.col("r.uid"))).alias("m"))
    return best.select("uid", "m.track", "m.iou").where("iou >= 0.1").select("uid", "track", r4("iou"))


# ---- aggregations

@query(O + " SELECT CAST(floor(x / 0.5) AS BIGINT) AS ix, CAST(floor(y / 0.5) AS BIGINT) AS iy, CAST(floor(z / 0.5) AS BIGINT) AS iz, round(avg(x), 4) AS x, round(avg(y), 4) AS y, round(avg(z), 4) AS z, CAST(floor(avg(uid % 256)) AS INTEGER) AS r, count(*) AS n FROM objects GROUP BY 1, 2, 3")
def a1_voxel_mean(spark, d):
    o = scene.objects(spark, d).select(*"xyz", *[(F.col("uid") % 256).alias(c) for c in "rgb"])
    return clouds.voxel_mean(o, 0.5).select("ix", "iy", "iz", r4("x"), r4("y"), r4("z"), "r", "n")


@query(O + " SELECT uid, ((CAST(floor(x / 0.5) AS BIGINT) + 1048576) << 42) | ((CAST(floor(y / 0.5) AS BIGINT) + 1048576) << 21) | (CAST(floor(z / 0.5) AS BIGINT) + 1048576) AS key FROM objects")
def a2_voxel_key(spark, d):
    return scene.objects(spark, d).select("uid", geo.voxel_key(*[geo.voxel(F.col(c), 0.5) for c in "xyz"]).alias("key"))


@query(O + """, old AS (SELECT avg(x) AS x, avg(y) AS y, avg(z) AS z FROM objects WHERE session = 'S0' GROUP BY floor(x), floor(y), floor(z)), al AS (SELECT x, y, z FROM old UNION ALL SELECT x, y, z FROM objects WHERE session = 'S1')
 SELECT CAST(floor(x) AS BIGINT) AS ix, CAST(floor(y) AS BIGINT) AS iy, CAST(floor(z) AS BIGINT) AS iz, round(avg(x), 4) AS x, count(*) AS n FROM al GROUP BY 1, 2, 3""")
def a3_accumulate_cloud(spark, d):
    o = scene.objects(spark, d).select("session", *"xyz", *[(F.col("uid") % 256).alias(c) for c in "rgb"])
    old = clouds.voxel_mean(o.where("session = 'S0'"), 1.0)
    return clouds.accumulate(old, o.where("session = 'S1'"), 1.0).select("ix", "iy", "iz", r4("x"), "n")


@query(O + " SELECT CAST(floor(x) AS BIGINT) AS ix, CAST(floor(y) AS BIGINT) AS iy, CAST(floor(z) AS BIGINT) AS iz, round(arg_min(x, uid), 4) AS x FROM objects GROUP BY 1, 2, 3")
def a4_voxel_first(spark, d):
    o = scene.objects(spark, d).select(F.col("uid").alias("seq"), *"xyz", *[(F.col("uid") % 256).alias(c) for c in "rgb"])
    return clouds.voxel_first(o, 1.0).select("ix", "iy", "iz", r4("x"))


@query(O + """, m AS (SELECT *, arg_max(uid, (conf, -ord)) OVER (PARTITION BY label) AS lead FROM objects)
 SELECT label AS component, round(sum(greatest(conf, 0.001) * x) / sum(greatest(conf, 0.001)), 4) AS x, max(lead) AS uid, round(max(conf), 4) AS conf, CAST(sum(support) AS BIGINT) AS support, count(*) AS n_members FROM m GROUP BY label""")
def a5_fuse(spark, d):
    members = scene.objects(spark, d).withColumn("component", F.col("label"))
    return resolve.fuse(members).select("component", r4("x"), "uid", r4("conf"), "support", "n_members")


@query(OV + """, s AS (SELECT o.session AS component, v.label, sum(v.n) AS n, min((o.ord, v.pos)) AS pos FROM objects o JOIN votes v USING (uid) GROUP BY 1, 2),
 k AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY n DESC, pos) AS k FROM s) SELECT component, label FROM k WHERE k = 1""")
def a6_vote_winner(spark, d):
    members = scene.objects(spark, d).select(F.col("session").alias("component"), "uid", "ord")
    return resolve.winning_label(resolve.merge_votes(members, scene.votes(spark, d)))


@query(O + " SELECT label AS component, session, CAST(sum(support) AS BIGINT) AS support, round(max(conf), 4) AS conf, arg_min(uid, ord) AS track FROM objects GROUP BY 1, 2")
def a7_provenance(spark, d):
    members = scene.objects(spark, d).withColumn("component", F.col("label"))
    return resolve.merge_provenance(members).select("component", "session", "support", r4("conf"), "track")


@query(OV + """, s AS (SELECT o.session AS area, v.label, sum(v.n) AS n, min((o.ord, v.pos)) AS pos FROM objects o JOIN votes v USING (uid) GROUP BY 1, 2),
 k AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY n DESC, pos) AS k FROM s) SELECT area, string_agg(label || CASE WHEN n > 1 THEN ' (' || CAST(n AS BIGINT) || ')' ELSE '' END, ', ' ORDER BY k) AS contains FROM k WHERE k <= 5 GROUP BY area""")
def a8_area_contains(spark, d):
    members = scene.objects(spark, d).select(F.col("session").alias("component"), "uid", "ord")
    merged = resolve.merge_votes(members, scene.votes(spark, d)).withColumnRenamed("component", "area")
    return planner.vote_summary(merged, "area", 5)


LABEL_E = """le AS (SELECT 'L' || label AS label, k, avg(CAST(embedding[k] AS DOUBLE)) AS e FROM embeddings, range(1, 65) r(k) GROUP BY 1, 2)"""


@query(OV + f""", {LABEL_E}, s AS (SELECT v.uid, le.k, sum(v.n * le.e) AS s FROM votes v JOIN le USING (label) GROUP BY 1, 2), n AS (SELECT uid, sqrt(sum(s * s)) AS norm FROM s GROUP BY uid)
 SELECT s.uid, round(s.s / n.norm, 4) AS e0 FROM s JOIN n USING (uid) WHERE k = 1""")
def a10_vote_embeddings(spark, d):
    e = scene.objects(spark, d).select("label", F.posexplode("embedding").alias("k", "v")).groupBy("label", "k").agg(F.avg(F.col("v").cast("double")).alias("m"))
    labels = e.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("k", "m"))).alias("s")).select("label", F.transform("s", lambda t: t["m"]).alias("embedding"))
    return planner.vote_embeddings(scene.votes(spark, d), labels).select("uid", r4(F.col("embedding")[0], "e0"))


@query(" SELECT user_id AS track, count(*) AS support, arg_max(event_type, (n, event_type)) AS top FROM (SELECT user_id, event_type, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events) GROUP BY user_id")
def a11_track_statistics(spark, d):
    c = scene.read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return c.groupBy(F.col("user_id").alias("track")).agg(F.sum("n").alias("support"), F.max_by("event_type", F.struct("n", "event_type")).alias("top"))


@query()
def a13_reservoir(spark, d):
    return tracks.sample_per_key(scene.poses(spark, d), ["session"], 3, ["session", "seq"]).select("session", "seq")


STEPS = "steps AS (SELECT *, sqrt(power(x - lag(x) OVER o, 2) + power(y - lag(y) OVER o, 2)) AS step FROM poses WINDOW o AS (PARTITION BY session ORDER BY seq))"


@query(P + f", {STEPS} SELECT session, count(*) AS n, round(CASE WHEN count(*) < 3 THEN 0.0 ELSE median(step) END, 4) AS motion FROM steps GROUP BY session")
def a14_motion(spark, d):
    return tracks.motion(scene.poses(spark, d), ["session"]).select("session", "n", r4("motion"))


@query(P + f", {STEPS}, m AS (SELECT session, count(*) AS n, median(step) AS motion FROM steps GROUP BY session) SELECT session, motion > 4.1 AND n >= 60 AS dynamic FROM m")
def a15_classify_static(spark, d):
    return tracks.classify_static(tracks.motion(scene.poses(spark, d), ["session"]), 4.1, 60).select("session", "dynamic")


@query(O + " SELECT CAST(floor(x) AS BIGINT) AS ix, CAST(floor(y) AS BIGINT) AS iy, count(*) AS n FROM objects WHERE z BETWEEN -2 AND 2 GROUP BY 1, 2")
def a16_bev_histogram(spark, d):
    return clouds.histogram(scene.objects(spark, d), 1.0, -2, 2)


@query(O + ", c AS (SELECT *, count(*) OVER (PARTITION BY floor(x), floor(y)) AS density FROM objects) SELECT uid FROM c WHERE density >= (SELECT quantile_cont(density, 0.8) FROM c)")
def a17_dense_points(spark, d):
    return clouds.dense_points(scene.objects(spark, d).select("uid", *"xyz"), 1.0, 80).select("uid")


@query()
def a18_ground_plane(spark, d):
    return clouds.ground_plane(scene.objects(spark, d), 0.5, 50)


@query(O + " SELECT label, round(avg(CASE WHEN z < -0.1 THEN 1.0 ELSE 0.0 END), 4) AS inliers FROM objects GROUP BY label")
def a19_inlier_fraction(spark, d):
    return scene.objects(spark, d).groupBy("label").agg(r4(F.avg((F.col("z") < -0.1).cast("double")), "inliers"))


@query(O + " SELECT label, count(*) AS n, round((min(x)+max(x))/2, 4) AS x, round((max(x)-min(x))/2 + 0.001, 4) AS hx, round(median(conf), 4) AS med, round(quantile_cont(conf, 0.9), 4) AS p90 FROM objects GROUP BY label")
def a20_a23_cluster_report(spark, d):
    return scene.objects(spark, d).groupBy("label").agg(
        F.count("*").alias("n"), r4((F.min("x") + F.max("x")) / 2, "x"), r4((F.max("x") - F.min("x")) / 2 + 1e-3, "hx"), r4(F.median("conf"), "med"), r4(F.percentile("conf", 0.9), "p90")
    )


@query()
def a21_coherence(spark, d):
    members = scene.objects(spark, d).select(F.col("uid").alias("id"), F.col("label").alias("cluster"), *"xyz", "embedding")
    return clusters.coherence(members, 40.0, 0.9).select("cluster", "n", r4("incoherence"), "accepted")


@query(O + ", m AS (SELECT a.uid AS i, b.uid AS j, " + DIST + " AS d FROM objects a JOIN objects b ON a.uid < b.uid WHERE a.uid < 60 AND b.uid < 60) SELECT round(median(2.0 * d / d), 4) AS scale FROM m WHERE d > 1e-9")
def a24_sim3_scale(spark, d):
    from placeloom.operators import align

    a = scene.objects(spark, d).select(F.col("uid").alias("id"), *"xyz")
    s = align.median_scale(a, a.select("id", *[(2.0 * F.col(c)).alias(c) for c in "xyz"]))
    return spark.range(1).select(r4(F.lit(s), "scale"))


@query(V + " SELECT DISTINCT label FROM votes")
def a27_vocabulary(spark, d):
    return scene.votes(spark, d).select("label").distinct()


# ---- ordered operators

@query(P + f", {STEPS} SELECT session, seq, round(step, 4) AS step FROM steps")
def w1_displacement(spark, d):
    return tracks.steps(scene.poses(spark, d), ["session"]).select("session", "seq", r4("step"))


@query(P + f""", {STEPS}, m AS (SELECT session, seq, median(step) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING) AS m FROM steps)
 SELECT session, seq, bool_or(seq >= 2 AND m > 4.1) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING) AS dynamic FROM m""")
def w2_sticky_dynamic(spark, d):
    return tracks.sticky_dynamic(scene.poses(spark, d), ["session"], 4.1).select("session", "seq", "dynamic")


@query(P + f""", {STEPS}, s AS (SELECT *, coalesce(sum(step) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING), 0) AS s FROM steps), g AS (SELECT *, lead(s) OVER o AS s1, lead(x) OVER o AS nx, lead(y) OVER o AS ny FROM s WINDOW o AS (PARTITION BY session ORDER BY seq)),
 k AS (SELECT session, k, x + (k*10.0-s)/(s1-s)*(nx-x) AS x FROM g, range(0, 200) r(k) WHERE s1 > s AND k*10.0 >= s AND k*10.0 < s1) SELECT session, k, round(x, 3) AS x FROM k""")
def w3_resample(spark, d):
    return tracks.resample(scene.poses(spark, d), ["session"], 10.0).select("session", "k", F.round("x", 3).alias("x"))


@query()
def w4_smooth(spark, d):
    return tracks.smoothed(scene.poses(spark, d), "session").select("session", "seq", r4("x"), r4("y"))


@query(R + " SELECT source_id, target_id FROM route_edges")
def w5_sequential_edges(spark, d):
    nodes, _ = scene.route(spark, d)
    return tracks.sequential_edges(nodes, ["session"])


@query(P + f""", {STEPS}, g AS (SELECT *, lag(x) OVER (PARTITION BY session ORDER BY seq) AS px, CAST(ceil(step / 2.0) AS INTEGER) AS parts FROM steps)
 SELECT session, seq, 0 AS part, round(x, 9) AS x FROM g WHERE px IS NULL UNION ALL SELECT session, seq, CAST(p AS INTEGER), round(px + CAST(p AS DOUBLE) / parts * (x - px), 9) FROM g, range(1, 100) r(p) WHERE step > 0 AND p <= parts""")
def w6_densify(spark, d):
    return tracks.densify(scene.poses(spark, d), ["session"], 2.0).select("session", "seq", "part", F.round("x", 9).alias("x"))


@query(P + f""", {STEPS}, s AS (SELECT session, seq, step, min((step, seq)) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING) AS b FROM steps WHERE step IS NOT NULL) SELECT session, seq, round(b[1], 4) AS best, b[2] AS best_seq FROM s""")
def w9_running_best(spark, d):
    s = tracks.steps(scene.poses(spark, d), ["session"]).where("step IS NOT NULL")
    return tracks.running_best(s, ["session"], "step").select("session", "seq", r4("best"), "best_seq")


@query(P + f", {STEPS} SELECT session, round(coalesce(sum(step), 0), 4) AS length FROM steps GROUP BY session")
def w10_path_length(spark, d):
    return tracks.path_length(scene.poses(spark, d), ["session"]).select("session", r4("length"))


@query(P + " SELECT session, count(*) - count(DISTINCT (floor(x + 0.0003), floor(y))) AS closures FROM poses GROUP BY session")
def w11_loop_closures(spark, d):
    return scene.poses(spark, d).groupBy("session").agg((F.count("*") - F.count_distinct(F.floor(F.col("x") + 0.0003), F.floor("y"))).alias("closures"))


# ---- scalar functions

@query(O + " SELECT uid, round(0.9 * (0.8*x - 0.6*y) + 1, 4) AS x, round(0.9 * (0.6*x + 0.8*y) + 2, 4) AS y, round(0.9 * z + 3, 4) AS z FROM objects")
def x2_sim3_apply(spark, d):
    p = geo.Sim3(0.9, (0.8, -0.6, 0, 0.6, 0.8, 0, 0, 0, 1), (1, 2, 3)).apply([F.col(c) for c in "xyz"])
    return scene.objects(spark, d).select("uid", *[r4(v, c) for v, c in zip(p, "xyz")])


@query(O + " SELECT uid, round(cos(hx), 4) AS r00, round(-sin(hx), 4) AS r01, round(sin(hx / 2), 4) AS qz, round(cos(hx / 2), 4) AS qw FROM objects")
def x1_quaternions(spark, d):
    q = [F.lit(0.0), F.lit(0.0), F.sin(F.col("hx") / 2), F.cos(F.col("hx") / 2)]
    m = geo.quaternion_matrix(q)
    back = geo.matrix_quaternion(m)
    return scene.objects(spark, d).select("uid", r4(m[0], "r00"), r4(m[1], "r01"), r4(back[2], "qz"), r4(back[3], "qw"))


@query(O + f" SELECT a.uid, round({SHARED} / least({VOL('a')}, {VOL('b')}), 4) AS ios, round({SHARED} / ({VOL('a')} + {VOL('b')} - {SHARED}), 4) AS iou FROM objects a JOIN objects b ON b.uid = a.uid + 1")
def x5_box_overlap(spark, d):
    o = scene.objects(spark, d)
    b = o.select((F.col("uid") - 1).alias("uid"), *[F.col(c).alias(f"b{c}") for c in ("x", "y", "z", "hx", "hy", "hz")])
    j = o.join(b, "uid")
    shared = geo.overlap(*[[F.col(f"{p}{h}{c}") for c in "xyz"] for p in ("", "b") for h in ("", "h")])
    v1, v2 = geo.volume([F.col(f"h{c}") for c in "xyz"]), geo.volume([F.col(f"bh{c}") for c in "xyz"])
    return j.select("uid", r4(geo.over_smaller(shared, v1, v2), "ios"), r4(geo.over_union(shared, v1, v2), "iou"))


@query()
def x5_turned_overlap(spark, d):
    o = scene.objects(spark, d)
    cols = ("x", "y", "z", "hx", "hy", "hz")
    side = lambda df, s: df.select(F.col("uid").alias(f"{s}uid"), *[F.col(c).alias(f"{s}{c}") for c in cols], (2 * 3.141592653589793 * F.abs(F.col("embedding")[7].cast("double"))).alias(f"{s}yaw"))
    pairs = side(o, "l").join(side(o.withColumn("uid", F.col("uid") - 1), "r"), F.col("luid") == F.col("ruid"))
    return hierarchy.turned_overlap(pairs.drop("ruid")).select(F.col("luid").alias("uid"), r4("shared"))


@query(O + " SELECT uid, round((x*10 + 180) / 360 * 262144, 3) AS tx, round((1 - ln(tan(radians(y*3)) + 1 / cos(radians(y*3))) / pi()) / 2 * 262144, 3) AS ty FROM objects")
def x10_mercator_tiles(spark, d):
    t = geo.tile(F.col("y") * 3, F.col("x") * 10, 18)
    return scene.objects(spark, d).select("uid", F.round(t[0], 3).alias("tx"), F.round(t[1], 3).alias("ty"))


@query(O + " SELECT uid, CAST(floor((x*10 + 180) / 6) AS INTEGER) + 1 AS zone FROM objects")
def x9_utm_zone(spark, d):
    return scene.objects(spark, d).select("uid", geo.utm_zone(F.col("x") * 10).alias("zone"))


@query(O + f", {RECT} SELECT uid, round((x1-x0)*(y1-y0), 3) AS area, round((x0+x1)/2, 3) AS cx FROM boxes")
def x12_polygon_area(spark, d):
    o = scene.objects(spark, d)
    p = lambda i, j: F.struct((10 * F.col("x") + i * 10 * F.col("hx")).alias("x"), (10 * F.col("y") + j * 10 * F.col("hy")).alias("y"))
    ring = o.select("uid", F.array(p(-1, -1), p(1, -1), p(1, 1), p(-1, 1), p(-1, -1)).alias("ring"))
    return ring.select("uid", F.round(geo.signed_area(F.col("ring")), 3).alias("area"), F.round(geo.centroid(F.col("ring"))[0], 3).alias("cx"))


@query(O + " SELECT uid, round(exp(-power(sqrt(x*x+y*y+z*z) / 10, 2)), 4) AS rho FROM objects")
def x13_proximity(spark, d):
    zero = F.lit(0.0)
    return scene.objects(spark, d).select("uid", r4(vector.proximity(vector.distance(("x", zero), ("y", zero), ("z", zero)), 10.0), "rho"))


@query("SELECT a.vec_id AS uid, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def x14_cosine(spark, d):
    e = scene.read(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select(F.col("vec_id").alias("uid"), r4(vector.cosine("embedding", "other"), "cosine"))


@query(O + " SELECT uid, round(CASE WHEN uid % 3 = 0 THEN abs(x) ELSE greatest(y, abs(x)) END, 4) AS d, round(CASE WHEN abs(x) > 1e-6 THEN y / abs(x) ELSE 1 END, 3) AS ratio FROM objects")
def x15_x27_geodesic_floor(spark, d):
    g, e = F.when(F.col("uid") % 3 == 0, float("inf")).otherwise(F.col("y")), F.abs("x")
    return scene.objects(spark, d).select("uid", r4(vector.floored(g, e), "d"), F.round(vector.separability(F.col("y"), e), 3).alias("ratio"))


@query()
def x22_stub_embedding(spark, d):
    labels = scene.votes(spark, d).select("label").distinct()
    return planner.encode_distinct(labels, "label", planner.HashEncoder()).select("label", F.size("embedding").alias("size"), r4(F.col("embedding")[0].cast("double"), "e0"))


# ---- top-k, sets

Q = "(SELECT embedding FROM embeddings WHERE vec_id = 7)"


def _query_vector(spark, d) -> list[float]:
    return [float(x) for x in scene.read(spark, d, "embeddings").where("vec_id = 7").first().embedding]


@query(A + f""", le AS (SELECT 'L' || label AS label, k, avg(CAST(embedding[k] AS DOUBLE)) AS e FROM embeddings, range(1, 65) r(k) GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(e * e)) AS norm FROM le GROUP BY 1),
 sim AS (SELECT le.label, sum(le.e / n.norm * CAST({Q}[le.k] AS DOUBLE)) AS sim FROM le JOIN n USING (label) GROUP BY 1),
 s AS (SELECT CAST(substring(label, 2) AS BIGINT) AS uid, 0.9 * sim + 0.1 * exp(-power(sqrt(x*x+y*y+z*z) / 10, 2)) AS score FROM areas JOIN sim USING (label))
 SELECT uid, round(score, 4) AS score, CAST(row_number() OVER (ORDER BY score DESC, uid) AS INTEGER) AS rank FROM s ORDER BY score DESC, uid LIMIT 5""")
def t1_descend(spark, d):
    return hierarchy.descend(scene.areas(spark, d), _query_vector(spark, d), (0.0, 0.0, 0.0)).select("uid", r4("score"), "rank")


@query(A + ", k AS (SELECT label, n, row_number() OVER (ORDER BY n DESC, label) AS k FROM areas) SELECT label, n FROM k WHERE k <= 3")
def t5_largest_areas(spark, d):
    return scene.areas(spark, d).orderBy(F.desc("n"), "label").limit(3).select("label", "n")


@query(R + " SELECT DISTINCT least(source_id, target_id) AS u, greatest(source_id, target_id) AS v FROM route_edges WHERE source_id <> target_id")
def u6_undirected_edges(spark, d):
    _, edges = scene.route(spark, d)
    return graph.undirected(edges)


@query("SELECT label FROM (SELECT DISTINCT 'L' || label AS label FROM embeddings EXCEPT SELECT 'L1' UNION SELECT 'reserved')")
def u4_s13_vocabulary(spark, d):
    own = scene.objects(spark, d).select("label").distinct()
    return own.where("label <> 'L1'").union(spark.sql("SELECT 'reserved'")).distinct()


# ---- graphs and clusters

@query(O + f""", {OVERLAP.replace('links AS', 'e0 AS')}, e AS (SELECT u, v FROM e0 UNION ALL SELECT v, u FROM e0),
 reach AS (SELECT DISTINCT id, low FROM (WITH RECURSIVE r(id, low) AS (SELECT uid, uid FROM objects UNION SELECT e.v, r.low FROM r JOIN e ON e.u = r.id WHERE r.low < e.v) SELECT * FROM r))
 SELECT id, min(low) AS component FROM reach GROUP BY id""")
def g1_components(spark, d):
    o = scene.objects(spark, d)
    return graph.components(o.select(F.col("uid").alias("id")), resolve.overlap_pairs(o, 0.5).select("u", "v"))


@query(R + """, w AS (SELECT e.source_id AS u, e.target_id AS v, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS w FROM route_edges e JOIN route_nodes a ON a.id = e.source_id JOIN route_nodes b ON b.id = e.target_id)
 SELECT u, v, round(w, 4) AS w FROM w UNION ALL SELECT v, u, round(w, 4) FROM w""")
def g2_weighted_edges(spark, d):
    nodes, edges = scene.route(spark, d)
    return graph.weighted(edges, nodes).select("u", "v", r4("w"))


#: The routes of all sessions, joined where they come near each other, and the distances from the first node.
NETWORK = """, near AS (SELECT a.id AS u, b.id AS v FROM route_nodes a JOIN route_nodes b ON a.ord < b.ord AND sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) <= 2.0003 AND NOT (a.session = b.session AND abs(a.seq - b.seq) < 15)),
 one AS (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM (SELECT u, v FROM near UNION ALL SELECT source_id, target_id FROM route_edges)),
 net AS MATERIALIZED (SELECT o.u, o.v, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS w FROM one o JOIN route_nodes a ON a.id = o.u JOIN route_nodes b ON b.id = o.v),
 ways AS MATERIALIZED (SELECT u, v, w FROM net UNION ALL SELECT v, u, w FROM net)"""
REACH = """, far(node, dist) USING KEY (node) AS (SELECT id, CAST(0 AS DOUBLE) FROM route_nodes WHERE ord = (SELECT min(ord) FROM route_nodes)
 UNION SELECT e.v, min(f.dist + e.w) FROM far f JOIN ways e ON e.u = f.node LEFT JOIN recurring.far k ON k.node = e.v GROUP BY e.v HAVING min(f.dist + e.w) < coalesce(min(k.dist), 1e300))"""
RR = R.replace("WITH ", "WITH RECURSIVE ", 1)


def _paths(spark, d):
    """Paths from the first node over all sessions' routes and the links where they come near each other."""
    nodes, edges = scene.route(spark, d)
    nodes = materialize(nodes, "network")
    first = nodes.agg(F.min_by("id", "ord").alias("src"))
    return nearpaths.shortest(nodes, edges, first, 2.0003, 15)


@query(RR + NETWORK + REACH + " SELECT node, round(dist, 4) AS dist FROM far")
def g3_shortest_paths(spark, d):
    return _paths(spark, d).select("node", r4("dist"))


@query(RR + NETWORK + REACH + """, pred AS (SELECT e.v AS node, arg_min(e.u, (f.dist + e.w, e.u)) AS pred FROM ways e JOIN far f ON f.node = e.u GROUP BY e.v),
 path(node, step) AS (SELECT arg_max(node, (dist, node)), 0 FROM far UNION ALL SELECT p.pred, path.step + 1 FROM path JOIN pred p ON p.node = path.node WHERE path.node <> (SELECT min_by(id, ord) FROM route_nodes)) SELECT node, step FROM path""")
def g4_path_nodes(spark, d):
    tree = materialize(_paths(spark, d), "tree")
    end = tree.groupBy("src").agg(F.max_by("node", F.struct("dist", "node")).alias("target"))
    return graph.path_nodes(tree, end).select("node", "step")


@query(O + f""", near AS (SELECT a.uid AS u, b.uid AS v FROM objects a JOIN objects b ON a.uid <> b.uid AND {DIST} < 1),
 reach AS (SELECT DISTINCT id, low FROM (WITH RECURSIVE r(id, low) AS (SELECT uid, uid FROM objects UNION SELECT e.v, r.low FROM r JOIN near e ON e.u = r.id WHERE r.low < e.v) SELECT * FROM r))
 SELECT id, min(low) AS component FROM reach GROUP BY id""")
def c1_single_linkage(spark, d):
    o = scene.objects(spark, d).select("uid", *"xyz")
    dist = spatial.radius_join(o, o, 1.0).where("l.uid < r.uid").select(F.col("l.uid").alias("i"), F.col("r.uid").alias("j"), F.col("distance").alias("dist"))
    return clusters.single_linkage(o.select(F.col("uid").alias("id")), dist, 1.0)


@query()
def c1_average_linkage(spark, d):
    return clusters.place_clusters(scene.objects(spark, d).select(F.col("uid").alias("id"), *"xyz"), 2.0, 1.5, "average")


@query()
def c1_complete_linkage(spark, d):
    return clusters.place_clusters(scene.objects(spark, d).select(F.col("uid").alias("id"), *"xyz"), 2.0, 1.5, "complete")


@query(O + f""", near AS (SELECT a.uid AS i, b.uid AS j, {DIST} AS d FROM objects a, objects b WHERE {DIST} <= 1), core AS (SELECT i FROM near GROUP BY i HAVING count(*) >= 4),
 e AS (SELECT i, j FROM near WHERE i IN (SELECT i FROM core) AND j IN (SELECT i FROM core)),
 reach AS (SELECT DISTINCT id, low FROM (WITH RECURSIVE r(id, low) AS (SELECT i, i FROM core UNION SELECT e.j, r.low FROM r JOIN e ON e.i = r.id WHERE r.low < e.j) SELECT * FROM r)),
 parts AS (SELECT id, min(low) AS cluster FROM reach GROUP BY id), border AS (SELECT n.i AS id, arg_min(p.cluster, (n.d, n.j)) AS cluster FROM near n JOIN parts p ON p.id = n.j WHERE n.i NOT IN (SELECT i FROM core) GROUP BY n.i)
 SELECT o.uid AS id, coalesce(p.cluster, b.cluster) AS cluster FROM objects o LEFT JOIN parts p ON p.id = o.uid LEFT JOIN border b ON b.id = o.uid""")
def c4_dbscan(spark, d):
    return clusters.dbscan(scene.objects(spark, d).select(F.col("uid").alias("id"), *"xyz"), 1.0, 4)


@query("""WITH RECURSIVE t AS (SELECT c_custkey + 1000 AS uid, c_nationkey + 100 AS parent FROM customer UNION ALL SELECT n_nationkey + 100, n_regionkey + 1 FROM nation UNION ALL SELECT r_regionkey + 1, CAST(NULL AS INTEGER) FROM region),
 h(uid, height) AS (SELECT uid, 0 FROM t UNION SELECT t.parent, h.height + 1 FROM h JOIN t ON t.uid = h.uid WHERE t.parent IS NOT NULL) SELECT CAST(uid AS BIGINT) AS uid, max(height) AS height FROM h GROUP BY uid""")
def h1_heights(spark, d):
    n = lambda t, a, b: scene.read(spark, d, t).select(F.expr(a).cast("long").alias("uid"), F.expr(b).cast("long").alias("parent"))
    tree = n("customer", "c_custkey + 1000", "c_nationkey + 100").unionByName(n("nation", "n_nationkey + 100", "n_regionkey + 1")).unionByName(n("region", "r_regionkey + 1", "null"))
    return hierarchy.heights(tree)


@query()
def r1_blur(spark, d):
    return clouds.blur(clouds.histogram(scene.objects(spark, d), 1.0), 1.0).select("ix", "iy", r4("n"))


@query(O + """, c AS (SELECT DISTINCT CAST(floor(x) AS BIGINT) AS ix, CAST(floor(y) AS BIGINT) AS iy FROM objects), s AS (SELECT k FROM (VALUES (-1), (0), (1)) v(k)),
 dil AS (SELECT DISTINCT ix + a.k AS ix, iy + b.k AS iy FROM c, s a, s b) SELECT ix, iy FROM (SELECT ix + a.k AS ix, iy + b.k AS iy FROM dil, s a, s b) GROUP BY ix, iy HAVING count(*) = 9""")
def r2_close_gaps(spark, d):
    return clouds.close_gaps(clouds.histogram(scene.objects(spark, d), 1.0), 1)


# ---- composites

@query()
def e1_reconcile(spark, d):
    o = scene.objects(spark, d)
    m = resolve.reconcile(o.where("session = 'S0'"), o.where("session = 'S1'"), scene.votes(spark, d))
    return m.select("uid", "kind", r4("x"), r4("y"), r4("z"), "label", r4("conf"), "support", "n_members", r4("ios"))


@query()
def e3_overlap_merge(spark, d):
    return resolve.overlap_merge(scene.objects(spark, d), 0.5).select("uid", r4("x"), "label", r4("conf"), "support", "n_members")


@query()
def e8_plan_route(spark, d):
    nodes, edges = scene.route(spark, d)
    plan = planner.plan_route(scene.areas(spark, d), _query_vector(spark, d), (0.0, 0.0, 0.0), nodes, graph.weighted(edges, nodes))
    return plan.select("leg", "uid", "from_node", "to_node", r4("length"), "path_nodes", r4("total"))


# ---- streams' batch twins, sinks

@query(P + " SELECT session, CAST(seq // 8 AS BIGINT) AS chunk, count(*) AS n FROM poses GROUP BY 1, 2")
def z5_chunks(spark, d):
    return tracks.chunks(scene.poses(spark, d), 8).groupBy("session", "chunk").agg(F.count("*").alias("n"))


@query(P + " SELECT session, CASE WHEN seq < 8 THEN 0 ELSE CAST((seq - 8) // 4 + 1 AS BIGINT) END AS chunk, count(*) AS n FROM poses GROUP BY 1, 2")
def z6_overlapping_chunks(spark, d):
    return tracks.chunks(scene.poses(spark, d), 8, 4).groupBy("session", "chunk").agg(F.count("*").alias("n"))


@query(G + f" SELECT {PRIMARY} AS tag, count(*) AS n FROM tagged GROUP BY 1")
def k5_counts_by_tag(spark, d):
    return scene.tagged(spark, d).groupBy(T.primary_key(F.col("tags")).alias("tag")).agg(F.count("*").alias("n"))


@query(G + " SELECT uid, " + ", ".join(f"coalesce(\"{k}\", '') AS \"{k}\"" for k in scene.TAGS) + " FROM tagged")
def k3_tag_table(spark, d):
    return maps.tag_table(scene.tagged(spark, d).select("uid", "tags"), ["uid"])
