"""Further registered queries: networks, composites, streams' twins, sinks, views."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placeloom.functions import geo, vector
from placeloom.functions import tags as T
from placeloom.operators import align, clouds, clusters, graph, nearpaths, network, ranking, resolve, spatial, tracks
from placeloom.operators.store import materialize
from placeloom.plans import planner, scene
from placeloom.plans.catalog import CLASSIFY, DIST, G, NETWORK, O, OV, P, R, REACH, RR, STEPS, A, _paths, query, r4
from placeloom.sources import maps

# ---- joins

@query(R + f""", o AS (SELECT vec_id AS uid, 20.0 * CAST(embedding[1] AS DOUBLE) AS x, 20.0 * CAST(embedding[2] AS DOUBLE) AS y, 20.0 * CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
 att AS (SELECT DISTINCT o.uid, n.id AS node FROM o JOIN route_nodes n ON n.session = o.uid AND n.seq < 15),
 lone AS (SELECT a.uid, b.id AS node, row_number() OVER (PARTITION BY a.uid ORDER BY {DIST}, b.ord) AS k FROM o a, route_nodes b WHERE a.uid NOT IN (SELECT uid FROM att))
 SELECT uid, node FROM att UNION ALL SELECT uid, node FROM lone WHERE k = 1""")
def j9_attachment_fallback(spark, d):
    nodes, _ = scene.route(spark, d)
    o = scene.objects(spark, d).select("uid", *"xyz")
    att = nodes.where("seq < 15").select(F.col("session").alias("uid"), F.col("id").alias("node"))
    none = o.select(*"xyz", *[F.lit(0.0).alias(f"h{c}") for c in "xyz"]).limit(0)
    return network.anchors(o, att.join(o.select("uid"), "uid", "left_semi"), nodes, none).select(F.col("key").alias("uid"), "node")


@query(A + f""", p AS (SELECT session, seq, x, y, z FROM ({scene.POSES_SQL[len('poses AS ('):-1]})),
 m AS (SELECT a.session, a.seq, b.label, row_number() OVER (PARTITION BY a.session, a.seq ORDER BY {DIST}, b.label) AS k FROM p a, areas b) SELECT session, seq, label FROM m WHERE k = 1""")
def j10_nearest_area(spark, d):
    p = scene.poses(spark, d).withColumn("pose", F.struct("session", "seq"))
    return spatial.nearest(p, scene.areas(spark, d), "pose", "label", "label").select("pose.session", "pose.seq", "label")


@query(R + """, far AS (SELECT * FROM route_nodes WHERE session % 2 = 1), base AS (SELECT * FROM route_nodes WHERE session % 2 = 0),
 m AS (SELECT a.id, b.id AS target, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)), b.ord) AS k FROM far a JOIN base b ON sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) <= 2.0003)
 SELECT far.id, coalesce(m.target, far.id) AS target FROM far LEFT JOIN m ON m.id = far.id AND m.k = 1""")
def j15_route_merge(spark, d):
    nodes, _ = scene.route(spark, d)
    return network.merge_routes(nodes.where("session % 2 = 0"), nodes.where("session % 2 = 1"), 2.0003)


@query(R + " SELECT e.source_id, e.target_id, round(a.x, 4) AS x0, round(b.x, 4) AS x1 FROM route_edges e JOIN route_nodes a ON a.id = e.source_id JOIN route_nodes b ON b.id = e.target_id")
def j16_edge_endpoints(spark, d):
    nodes, edges = scene.route(spark, d)
    p = nodes.select(F.col("id").alias("source_id"), F.col("x").alias("x0"))
    q = nodes.select(F.col("id").alias("target_id"), F.col("x").alias("x1"))
    return edges.join(p, "source_id").join(q, "target_id").select("source_id", "target_id", r4("x0"), r4("x1"))


@query("SELECT r_regionkey AS region, n_nationkey AS nation, count(c_custkey) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def j17_children(spark, d):
    t = lambda n: scene.read(spark, d, n)
    j = t("region").join(t("nation"), F.col("n_regionkey") == F.col("r_regionkey")).join(t("customer"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy(F.col("r_regionkey").alias("region"), F.col("n_nationkey").alias("nation")).agg(F.count("c_custkey").alias("n"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type IN (SELECT min(event_type) FROM events)) WHERE k <= 3")
def j18_crops_per_track(spark, d):
    e = scene.read(spark, d, "events")
    first = e.agg(F.min("event_type").alias("event_type"))
    own = e.join(first, "event_type", "left_semi")
    return own.withColumn("k", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))).where("k <= 3").select("user_id", "event_id")


@query(O + f" SELECT a.uid AS i, b.uid AS j, round({DIST}, 4) AS dist FROM objects a JOIN objects b ON a.label = b.label AND a.uid < b.uid")
def j20_pair_distances(spark, d):
    """The distance matrix of each label's objects."""
    o = scene.objects(spark, d).select("uid", "label", *"xyz")
    a, b = o.alias("a"), o.alias("b")
    return a.join(b, (F.col("a.label") == F.col("b.label")) & (F.col("a.uid") < F.col("b.uid"))).select(F.col("a.uid").alias("i"), F.col("b.uid").alias("j"), r4(vector.distance(*[(f"a.{c}", f"b.{c}") for c in "xyz"]), "dist"))


# ---- aggregations

@query(OV + """, s AS (SELECT o.session AS area, v.label, sum(v.n) AS n, min((o.ord, v.pos)) AS pos FROM objects o JOIN votes v USING (uid) GROUP BY 1, 2)
 SELECT area, string_agg(label || ' x' || CAST(n AS BIGINT), ', ' ORDER BY n DESC, pos) AS summary FROM s GROUP BY area""")
def a9_caption_summary(spark, d):
    members = scene.objects(spark, d).select(F.col("session").alias("component"), "uid", "ord")
    m = resolve.merge_votes(members, scene.votes(spark, d))
    x = m.groupBy(F.col("component").alias("area")).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "pos", F.concat("label", F.lit(" x"), F.col("n").cast("string")).alias("t")))).alias("x"))
    return x.select("area", F.array_join(F.transform("x", lambda t: t["t"]), ", ").alias("summary"))


@query("SELECT user_id % 10 AS track, count(*) AS support, count(DISTINCT event_type) AS labels, array_to_string(list_sort(list(DISTINCT event_id % 7)), ',') AS frames FROM events GROUP BY 1")
def a12_track_union(spark, d):
    e = scene.read(spark, d, "events")
    return e.groupBy((F.col("user_id") % 10).alias("track")).agg(F.count("*").alias("support"), F.count_distinct("event_type").alias("labels"), F.array_join(F.array_sort(F.collect_set(F.col("event_id") % 7)), ",").alias("frames"))


@query(O + ", s AS (SELECT label, count(*) AS n FROM objects GROUP BY label) SELECT uid FROM objects WHERE label IN (SELECT label FROM s WHERE n >= (SELECT avg(n) FROM s))")
def a22_cluster_size_gate(spark, d):
    o = scene.objects(spark, d).select("uid", F.col("label").alias("cluster"))
    least = o.groupBy("cluster").count().agg(F.avg("count")).first()[0]
    return clusters.min_size(o, least).select("uid")


@query(O + ", m AS (SELECT *, arg_max(uid, (support, -ord)) OVER (PARTITION BY label) AS lead FROM objects) SELECT label AS component, round(sum(support * x) / sum(support), 4) AS x, max(lead) AS uid FROM m GROUP BY label")
def a26_fuse_by_support(spark, d):
    return resolve.fuse(scene.objects(spark, d).withColumn("component", F.col("label")), "support").select("component", r4("x"), "uid")


@query(O + " SELECT label, round(avg(x), 4) AS mx, round(min(x), 4) AS x0, round(max(x), 4) AS x1 FROM objects GROUP BY label")
def a28_roi_box(spark, d):
    return scene.objects(spark, d).groupBy("label").agg(r4(F.avg("x"), "mx"), r4(F.min("x"), "x0"), r4(F.max("x"), "x1"))


# ---- ordered

@query(O + ", top AS (SELECT max(uid) AS m FROM objects WHERE session = 'S0') SELECT uid AS old, m + row_number() OVER (ORDER BY ord) AS uid FROM objects, top WHERE session = 'S1'")
def w8_fresh_uids(spark, d):
    o = scene.objects(spark, d)
    top = o.where("session = 'S0'").agg(F.max("uid")).first()[0]
    b = ranking.numbered(o.where("session = 'S1'").select(F.col("uid").alias("old"), "ord"), "ord")
    return b.select("old", (F.col("rank") + top).alias("uid"))


@query(O + """, b AS (SELECT uid, 4 * hx + 4 * hy AS len, x - hx AS x0, x + hx AS x1 FROM objects) SELECT uid, greatest(CAST(floor(len / 0.5) AS INTEGER), 1) AS n FROM b""")
def w7_contour_points(spark, d):
    return scene.objects(spark, d).select("uid", F.greatest(F.floor((4 * F.col("hx") + 4 * F.col("hy")) / 0.5).cast("int"), F.lit(1)).alias("n"))


# ---- scalars

@query("SELECT 1 AS id, CAST(2.0 AS DOUBLE) AS scale, CAST(0.6 AS DOUBLE) AS r10, CAST(1.0 AS DOUBLE) AS t0")
def x3_sim3_from_poses(spark, d):
    a = scene.objects(spark, d).select(F.col("uid").alias("id"), *"xyz")
    moved = geo.Sim3(2.0, (0.8, -0.6, 0, 0.6, 0.8, 0, 0, 0, 1), (1, 2, 3)).apply([F.col(c) for c in "xyz"])
    s = align.from_poses(a, a.select("id", *[v.alias(c) for v, c in zip(moved, "xyz")]))
    return spark.range(1).select(F.lit(1).alias("id"), r4(F.lit(float(s.scale)), "scale"), r4(F.lit(float(s.rotation[3])), "r10"), r4(F.lit(float(s.shift[0])), "t0"))


@query(O + " SELECT uid, round(0.5 * (0.8*x - 0.6*y) + 1, 4) AS x, round(0.5 * hx, 4) AS hx, round(sin((hx + 2 * atan(1.0/3)) / 2), 4) AS qz FROM objects")
def x4_transform_object(spark, d):
    s = geo.Sim3(0.5, (0.8, -0.6, 0, 0.6, 0.8, 0, 0, 0, 1), (1, 0, 0))
    own = geo.quaternion_matrix([F.lit(0.0), F.lit(0.0), F.sin(F.col("hx") / 2), F.cos(F.col("hx") / 2)])
    q = geo.matrix_quaternion(geo.product(s.matrix(), own))
    return scene.objects(spark, d).select("uid", r4(s.apply([F.col(c) for c in "xyz"])[0], "x"), r4(s.scale * F.col("hx"), "hx"), r4(q[2], "qz"))


@query(O + " SELECT uid, round((uid % 640 - 320) * hx / 300, 4) AS x, round((uid % 480 - 240) * hx / 300, 4) AS y, round(hx, 4) AS z FROM objects")
def x7_unproject(spark, d):
    u, v = F.col("uid") % 640, F.col("uid") % 480
    p = geo.unproject(u, v, F.col("hx"), F.lit(300.0), F.lit(300.0), F.lit(320.0), F.lit(240.0))
    return scene.objects(spark, d).select("uid", *[r4(c, n) for c, n in zip(p, "xyz")])


@query(O + " SELECT uid, round(0.8*(x-1) + 0.6*(y-2), 4) AS x, round(-0.6*(x-1) + 0.8*(y-2), 4) AS y, round(z-3, 4) AS z FROM objects")
def x8_world_to_camera(spark, d):
    p = geo.to_camera([F.col(c) for c in "xyz"], [F.lit(v) for v in (0.8, -0.6, 0.0, 0.6, 0.8, 0.0, 0.0, 0.0, 1.0)], [F.lit(v) for v in (1.0, 2.0, 3.0)])
    return scene.objects(spark, d).select("uid", *[r4(c, n) for c, n in zip(p, "xyz")])


@query(A + " SELECT label, 'area ' || CAST(substring(label, 2) AS BIGINT) || '. contains ' || label || ' (' || n || ')' AS text FROM areas")
def x16_area_text(spark, d):
    a = scene.areas(spark, d)
    return a.select("label", planner.area_text(F.lit(""), F.lit(None).cast("string"), F.col("uid"), F.concat("label", F.lit(" ("), F.col("n").cast("string"), F.lit(")"))).alias("text"))


@query(O + " SELECT uid, 'nav_' || lpad(CAST(uid AS VARCHAR), 4, '0') AS id FROM objects")
def x17_node_ids(spark, d):
    return scene.objects(spark, d).select("uid", F.concat(F.lit("nav_"), F.lpad(F.col("uid").cast("string"), 4, "0")).alias("id"))


@query("SELECT item_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html FROM benchmark")
def x19_html_escape(spark, d):
    e = F.col("text")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        e = F.replace(e, F.lit(a), F.lit(b))
    return scene.read(spark, d, "benchmark").select("item_id", e.alias("html"))


@query(O + " SELECT uid, round(uid * CAST(0.61803398875 AS DOUBLE) - floor(uid * CAST(0.61803398875 AS DOUBLE)), 6) AS hue FROM objects")
def x20_hue(spark, d):
    h = F.col("uid") * 0.61803398875
    return scene.objects(spark, d).select("uid", F.round(h - F.floor(h), 6).alias("hue"))


@query(O + f" SELECT a.uid, round(0.6 * {DIST} / 4 + 0.4 * (1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 4) AS d FROM objects a JOIN objects b ON b.uid = a.uid + 1")
def x26_spatio_semantic(spark, d):
    o = scene.objects(spark, d).select("uid", *"xyz", "embedding")
    b = o.select((F.col("uid") - 1).alias("uid"), *[F.col(c).alias(f"b{c}") for c in "xyz"], F.col("embedding").alias("other"))
    far = vector.distance(*[(c, f"b{c}") for c in "xyz"])
    return o.join(b, "uid").select("uid", r4(vector.spatio_semantic(far, vector.cosine("embedding", "other"), 0.6, 4.0), "d"))


# ---- top-k and sets

@query("SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS k FROM events GROUP BY 1, 2) WHERE k <= 2")
def t4_most_common(spark, d):
    c = scene.read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return c.withColumn("k", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("n"), "event_type"))).where("k <= 2").select("user_id", "event_type")


@query(O + ", s AS (SELECT label AS component, count(*) AS cells FROM objects GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY cells DESC, component) AS k FROM s) SELECT component, cells, CAST(k AS INTEGER) AS rank FROM k WHERE k <= 3")
def t6_largest_components(spark, d):
    return clouds.largest_regions(scene.objects(spark, d).withColumn("component", F.col("label")), 3)


@query()
def t10_subsample(spark, d):
    o = scene.objects(spark, d)
    return o.orderBy(F.xxhash64(F.lit(1), "uid")).limit(100).select("uid")


@query(R + " SELECT id FROM route_nodes")
def u1_absorb(spark, d):
    nodes, _ = scene.route(spark, d)
    half = nodes.where("seq % 10 = 0")
    return network.absorb(half, nodes).select("id")


@query("SELECT user_id AS session, min(event_id) AS pos FROM events GROUP BY 1")
def u2_session_roster(spark, d):
    return scene.read(spark, d, "events").groupBy(F.col("user_id").alias("session")).agg(F.min("event_id").alias("pos"))


@query(O + " SELECT count(*) AS n, count(DISTINCT uid) AS uids FROM objects")
def u3_reconcile_partitions(spark, d):
    """Every object of either session is in one component of the merged map."""
    o = scene.objects(spark, d)
    m = resolve.reconcile(o.where("session = 'S0'"), o.where("session = 'S1'"), scene.votes(spark, d))
    return m.agg(F.sum("n_members").cast("long").alias("n"), (F.count_distinct("uid") + F.sum("n_members") - F.count("*")).cast("long").alias("uids"))


# ---- graphs

@query(RR + NETWORK + """, a AS (SELECT session AS key, id, 0.1 * (seq % 4) AS o FROM route_nodes WHERE seq % 40 = 0),
 far(src, node, dist) USING KEY (src, node) AS (SELECT id, id, CAST(0 AS DOUBLE) FROM a
  UNION SELECT f.src, e.v, min(f.dist + e.w) FROM far f JOIN ways e ON e.u = f.node LEFT JOIN recurring.far k ON k.src = f.src AND k.node = e.v GROUP BY f.src, e.v HAVING min(f.dist + e.w) < coalesce(min(k.dist), 1e300))
 SELECT p.key AS i, q.key AS j, round(min(p.o + f.dist + q.o), 4) AS dist FROM far f JOIN a p ON p.id = f.src JOIN a q ON q.id = f.node WHERE p.key < q.key GROUP BY 1, 2""")
def g6_set_distances(spark, d):
    """Every session has anchors at each eighth node of its route; distances between the sessions' anchors over the whole network."""
    nodes, edges = scene.route(spark, d)
    nodes = materialize(nodes, "network")
    anchors = nodes.where("seq % 40 = 0").select(F.col("session").alias("key"), F.col("id").alias("node"), (0.1 * (F.col("seq") % 4)).alias("offset"))
    return nearpaths.set_distances(nodes, edges, anchors, 2.0003, 15).select("i", "j", r4("dist"))


@query(R + ", c AS (SELECT count(DISTINCT session) AS n FROM route_nodes) SELECT n FROM c")
def g8_component_count(spark, d):
    nodes, edges = scene.route(spark, d)
    parts = graph.components(nodes, edges.select(F.col("source_id").alias("u"), F.col("target_id").alias("v")))
    return parts.agg(F.count_distinct("component").alias("n"))


@query(R + f""", o AS (SELECT vec_id AS uid, 20.0 * CAST(embedding[1] AS DOUBLE) AS x, 20.0 * CAST(embedding[2] AS DOUBLE) AS y, 20.0 * CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
 m AS (SELECT a.uid, b.id AS node, row_number() OVER (PARTITION BY a.uid ORDER BY {DIST}, b.ord) AS k FROM o a, route_nodes b) SELECT 'poi_' || uid AS source_id, node AS target_id FROM m WHERE k = 1""")
def g9_add_places(spark, d):
    nodes, edges = scene.route(spark, d)
    _, out = network.add_places(nodes, edges, scene.objects(spark, d).select("uid", *"xyz"))
    return out.where("source_id LIKE 'poi_%'")


@query()
def g10_walk_network(spark, d):
    poses = scene.poses(spark, d)
    ring = poses.where("seq % 5 = 0").groupBy("session").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("ring"))
    ways = ring.select((F.col("session") % 4).alias("region"), F.col("session").alias("way"), F.lit("linestring").alias("kind"), F.create_map(F.lit("highway"), F.lit("path")).alias("tags"), F.transform("ring", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring"))
    nodes, edges = network.walk_network(ways)
    return nodes.select(F.lit("node").alias("kind"), "id").unionByName(edges.select(F.lit("edge").alias("kind"), F.concat_ws("-", "source_id", "target_id").alias("id")))


@query()
def g11_snap_in_order(spark, d):
    o = scene.objects(spark, d).select(F.col("label").alias("region"), "ord", *"xyz")
    return network.snap_in_order(o, 2.0)


@query(R + " SELECT CAST(floor((x + 0.0003) / 2) AS BIGINT) AS ix, CAST(floor(y / 2) AS BIGINT) AS iy, round(avg(x + 0.0003), 7) AS x, count(*) AS n FROM route_nodes GROUP BY 1, 2")
def g12_voxel_snap(spark, d):
    nodes, _ = scene.route(spark, d)
    return network.snap_to_cells(nodes.withColumn("x", F.col("x") + 0.0003), 2.0).select("ix", "iy", F.round("x", 7).alias("x"), "n")


@query()
def g13_session_route(spark, d):
    nodes, edges = tracks.session_route(scene.poses(spark, d), "session", 10.0)
    return nodes.select("id", r4("x"), r4("y"))


@query()
def r5_align(spark, d):
    o = scene.objects(spark, d).select(*"xyz")
    moved = o.select((F.col("x") + 0.9).alias("x"), (F.col("y") - 0.5).alias("y"), "z")
    return align.align(o, moved, span=1.6, most=600).select(*[F.round(c, 2).alias(c) for c in ("yaw", "tx", "ty")])


# ---- composites

@query()
def e4_integrate_session(spark, d):
    """A session joins the map: transformed, reconciled, overlaps merged."""
    o = scene.objects(spark, d)
    s = geo.Sim3(1.0, (1, 0, 0, 0, 1, 0, 0, 0, 1), (0.1, 0, 0))
    moved = o.where("session = 'S1'").withColumns(dict(zip("xyz", s.apply([F.col(c) for c in "xyz"]))))
    m = materialize(resolve.reconcile(o.where("session = 'S0'"), moved, scene.votes(spark, d), trust=0.9), "integrate")
    return resolve.overlap_merge(m.withColumn("ord", F.col("uid")), 0.5).select("uid", r4("x"), "label", "support")


@query()
def e6_areas(spark, d):
    nodes, edges = scene.route(spark, d)
    own = nodes.withColumns({c: F.col(c) / 4 - 10 for c in "xy"})
    o = scene.objects(spark, d)
    o = o.withColumn("label", F.when(F.col("label") == "L1", "glassdoor").when(F.col("label") == "L2", "mirror").otherwise(F.col("label")))
    att = o.select("uid").limit(0).withColumn("node", F.lit(""))
    return network.areas(o, att, own, edges, d_max=8.0).select("cluster", "n", "diameter", r4("x"))


@query(G + f""", {CLASSIFY} SELECT count(*) FILTER (rule = 'structure') AS structures, count(*) FILTER (rule <> 'structure') AS regions, count(*) AS features FROM c""")
def k6_phase_counts(spark, d):
    role = T.classify(F.col("tags"))["role"]
    return scene.tagged(spark, d).agg(F.count_if(role == "structure").alias("structures"), F.count_if(role != "structure").alias("regions"), F.count("*").alias("features"))


@query(G + f""", {CLASSIFY} SELECT uid, rule = 'none' AS open FROM c""")
def k4_annotations(spark, d):
    t = scene.tagged(spark, d).select("uid", T.classify(F.col("tags")).alias("c"))
    t = t.select("uid", "c.role", "c.category", "c.function", "c.name", F.col("c.desc").alias("description"))
    return maps.annotations(t).select("uid", (F.col("role") == "unclassified").alias("open"))


@query("SELECT c_custkey AS id, CAST(json_object('type', 'node', 'key', c_custkey, 'name', c_name) AS VARCHAR) AS doc FROM customer")
def k1_json_documents(spark, d):
    c = scene.read(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.to_json(F.struct(F.lit("node").alias("type"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))).alias("doc"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def s7_json_fields(spark, d):
    return scene.read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT x + 3 AS x, y + 5 AS y, y * 4 + x AS k FROM range(0, 4) a(x), range(0, 3) b(y)")
def s15_tile_list(spark, d):
    return maps.tiles_for(spark, (3, 5), (6, 7))


# ---- streams' twins and views

@query(O + " SELECT CAST(floor(x) AS BIGINT) AS ix, CAST(floor(y) AS BIGINT) AS iy, CAST(floor(z) AS BIGINT) AS iz, count(*) AS n, round(sum(x), 4) AS sx FROM objects GROUP BY 1, 2, 3")
def z3_voxel_sums(spark, d):
    from placeloom.streaming import incremental

    return incremental.voxel_sums(scene.objects(spark, d), 1.0).select("ix", "iy", "iz", "n", r4("sx"))


@query("SELECT user_id AS session, event_type AS label, count(*) AS n FROM events GROUP BY 1, 2")
def z4_label_counts(spark, d):
    from placeloom.streaming import incremental

    e = scene.read(spark, d, "events").select(F.col("user_id").alias("session"), F.lit(0).alias("track_id"), F.col("event_type").alias("label"), F.col("event_id").alias("seq"))
    return incremental.label_counts(e).select("session", "label", "n")


@query("SELECT time_bucket(INTERVAL '5 minutes', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def z8_event_windows(spark, d):
    e = scene.read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "5 minutes"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(P + f", {STEPS} SELECT session, count(*) AS n, round(sum(step), 4) AS length, round(max(x) - min(x), 4) AS width FROM steps GROUP BY session")
def v5_trajectory_summary(spark, d):
    s = tracks.steps(scene.poses(spark, d), ["session"])
    return s.groupBy("session").agg(F.count("*").alias("n"), r4(F.sum("step"), "length"), r4(F.max("x") - F.min("x"), "width"))


@query(O + " SELECT greatest(500.0, max(greatest(abs(x), abs(y)))) AS extent FROM objects")
def v3_display_extent(spark, d):
    return scene.objects(spark, d).agg(F.greatest(F.lit(500.0), F.max(F.greatest(F.abs("x"), F.abs("y")))).alias("extent"))


@query(RR + NETWORK + REACH + " SELECT node, round(dist / max(dist) OVER (), 4) AS heat FROM far")
def v4_geodesic_heat(spark, d):
    tree = materialize(_paths(spark, d), "heat")
    return tree.crossJoin(tree.agg(F.max("dist").alias("top"))).select("node", r4(F.col("dist") / F.col("top"), "heat"))


@query()
def r2_outlines(spark, d):
    from placeloom.operators import outlines

    return outlines.outlines(scene.objects(spark, d), cell=1.0, close=2.0, most=3).select("rank", r4("area_m2"), "n_vertices")


@query(O + """, c AS (SELECT DISTINCT CAST(floor(x) AS BIGINT) AS ix, CAST(floor(y) AS BIGINT) AS iy FROM objects), e AS (SELECT a.ix, a.iy, b.ix AS jx, b.iy AS jy FROM c a JOIN c b ON abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1),
 reach AS (SELECT DISTINCT ix, iy, low FROM (WITH RECURSIVE r(ix, iy, low) AS (SELECT ix, iy, (ix, iy) FROM c UNION SELECT e.jx, e.jy, r.low FROM r JOIN e ON e.ix = r.ix AND e.iy = r.iy WHERE r.low < (e.jx, e.jy)) SELECT * FROM r)),
 m AS (SELECT ix, iy, min(low) AS low FROM reach GROUP BY 1, 2) SELECT low[1] AS lx, low[2] AS ly, count(*) AS cells FROM m GROUP BY 1, 2""")
def r2_regions(spark, d):
    from placeloom.operators import outlines

    parts = outlines.regions(clouds.histogram(scene.objects(spark, d), 1.0))
    low = parts.groupBy("component").agg(F.min(F.struct("ix", "iy")).alias("low"), F.count("*").alias("cells"))
    return low.select(F.col("low.ix").alias("lx"), F.col("low.iy").alias("ly"), "cells")


@query(O + f" SELECT uid, label, CASE WHEN label IN ('L1', 'L2') THEN 'portal' WHEN support >= 3 THEN 'area' ELSE 'free' END AS layer FROM objects")
def v1_view_layers(spark, d):
    layer = F.when(F.col("label").isin("L1", "L2"), "portal").when(F.col("support") >= 3, "area").otherwise("free")
    return scene.objects(spark, d).select("uid", "label", layer.alias("layer"))


@query(G + """ SELECT uid, '{"type":"node","id":' || uid || ',"tags":' || CASE WHEN name IS NULL THEN '{}' ELSE '{"name":"' || name || '"}' END || '}' AS payload FROM tagged""")
def k9_overlay_payload(spark, d):
    t = scene.tagged(spark, d)
    return t.select("uid", F.to_json(F.struct(F.lit("node").alias("type"), F.col("uid").alias("id"), F.map_filter("tags", lambda k, v: k == "name").alias("tags"))).alias("payload"))


@query(O + f""", e AS (SELECT a.uid AS i, b.uid AS j FROM objects a, objects b WHERE a.uid <> b.uid AND {DIST} < 2 AND greatest({DIST}, 1.5) / {DIST} < 1.8),
 reach AS (SELECT DISTINCT id, low FROM (WITH RECURSIVE r(id, low) AS (SELECT uid, uid FROM objects UNION SELECT e.j, r.low FROM r JOIN e ON e.i = r.id WHERE r.low < e.j) SELECT * FROM r))
 SELECT id, min(low) AS component FROM reach GROUP BY id""")
def g8_ratio_components(spark, d):
    """Objects linked when near and when the way round is not much longer than the straight line."""
    o = scene.objects(spark, d).select("uid", *"xyz")
    pairs = spatial.radius_join(o, o, 2.0).where("l.uid <> r.uid AND distance < 2")
    ratio = vector.separability(F.greatest("distance", F.lit(1.5)), F.col("distance"))
    links = pairs.where(ratio < 1.8).select(F.col("l.uid").alias("u"), F.col("r.uid").alias("v"))
    return graph.components(o.select(F.col("uid").alias("id")), links)


@query()
def e9_plan_iteratively(spark, d):
    query_vector = [float(x) for x in scene.read(spark, d, "embeddings").where("vec_id = 7").first().embedding]
    stops = planner.plan_iteratively(scene.areas(spark, d), query_vector, (0.0, 0.0, 0.0), k=2, most=3)
    return spark.createDataFrame([(k, int(u)) for k, u in enumerate(stops)], "step int, uid long")


@query("SELECT c_custkey AS uid, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE n_nationkey END AS parent FROM customer JOIN nation ON n_nationkey = c_nationkey")
def t2_parents(spark, d):
    c, n = scene.read(spark, d, "customer"), scene.read(spark, d, "nation")
    j = c.join(n, F.col("n_nationkey") == F.col("c_nationkey"))
    return j.select(F.col("c_custkey").alias("uid"), F.when(F.col("c_custkey") % 3 != 0, F.col("n_nationkey")).alias("parent"))


@query("SELECT count(*) AS bad FROM part WHERE p_retailprice < 0 OR p_size < 1")
def f19_validation(spark, d):
    return scene.read(spark, d, "part").agg(F.count_if((F.col("p_retailprice") < 0) | (F.col("p_size") < 1)).alias("bad"))
