"""Entity resolution of objects across sessions: candidate joins, components, fusion with votes and provenance.

Objects: uid, session, ord, x, y, z, hx, hy, hz, label, conf, support.  Votes: uid, label, n, pos.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placeloom.functions import geo, vector
from placeloom.operators import graph, ranking, spatial, turned
from placeloom.operators.store import materialize

XYZ = spatial.XYZ
HALF = ("hx", "hy", "hz")


def half_diagonal(side: str) -> Column:
    return F.sqrt(sum(F.col(f"{side}.{h}") * F.col(f"{side}.{h}") for h in HALF))


def label_sets(objects: DataFrame, votes: DataFrame) -> DataFrame:
    """``objects`` with ``voted``, the array of labels that have votes."""
    named = votes.groupBy("uid").agg(F.array_sort(F.collect_set("label")).alias("voted"))
    return objects.join(named, "uid", "left").withColumn("voted", F.coalesce("voted", F.array().cast("array<string>")))


def labels_agree() -> Column:
    """One side's label is among the other's votes."""
    return F.array_contains(F.col("r.voted"), F.col("l.label")) | F.array_contains(F.col("l.voted"), F.col("r.label"))


def candidates(a: DataFrame, b: DataFrame, trust: float = 0.5, gate: float = 0.5, size: float = 4.0) -> DataFrame:
    """(a_uid, b_uid, ios, cdiag) of pairs that may be one object.

    A pair must be closer than its half diagonals together; then it needs either an overlap of
    ``trust`` of the smaller box, or a centre distance under ``gate`` of the half diagonals and
    labels that agree.  Boxes with a yaw on both sides are turned.  Either way the boxes themselves overlap or the cubes around
    ``gate`` of the half diagonals do: the box join takes the larger of the two on each axis, so it neither misses
    a pair nor compares all that merely reach each other.
    """

    part = min(gate, 1.0) if trust > 0 else 1.0  # without a needed overlap all that reach each other count
    turned = "yaw" in a.columns and "yaw" in b.columns
    shape = (*HALF, "yaw") if turned else HALF

    def cubes(df: DataFrame) -> DataFrame:
        reach = part * F.sqrt(sum(F.col(h) * F.col(h) for h in HALF))
        wide = F.sqrt(F.col("hx") * F.col("hx") + F.col("hy") * F.col("hy"))  # of a box turned anyhow
        box = {h: wide if turned and h != "hz" else F.col(h) for h in HALF}
        own = F.struct("uid", "label", "voted", *shape).alias("own")
        return df.select(*XYZ, own, *[(F.greatest(reach, box[h]) * (1 + 1e-9) + 1e-9).alias(h) for h in HALF])

    def reached(df: DataFrame) -> DataFrame:
        radius = F.sqrt(sum(F.col(h) * F.col(h) for h in HALF))
        wide = F.sqrt(F.col("hx") * F.col("hx") + F.col("hy") * F.col("hy"))
        box = {h: wide if turned and h != "hz" else F.col(h) for h in HALF}
        around = [(F.greatest(2 * part * radius, box[f"h{c}"]) * (1 + 1e-9) + 1e-9).alias(f"w{c}") for c in XYZ]
        return df.select(*XYZ, "uid", "label", "voted", *shape, *around)

    if trust >= 0.5:  # half of the smaller box in the larger one: so is its centre; and the larger half diagonal is at least half of both
        pairs = spatial.centres_within(reached(a), reached(b), size)
    else:
        pairs = spatial.boxes_overlapping(cubes(a), cubes(b), size)
        flat = lambda s: F.struct(*[F.col(f"{s}.{c}").alias(c) for c in XYZ], F.col(f"{s}.own.uid").alias("uid"), F.col(f"{s}.own.label").alias("label"), F.col(f"{s}.own.voted").alias("voted"), *[F.col(f"{s}.own.{h}").alias(h) for h in shape]).alias(s)
        pairs = pairs.select(flat("l"), flat("r"))
    shared = spatial.shared_volume("l", "r", turned)
    far = vector.distance(*[(F.col(f"l.{c}"), F.col(f"r.{c}")) for c in XYZ])
    both = half_diagonal("l") + half_diagonal("r")
    pairs = pairs.where(far <= both).withColumns({"shared": shared, "distance": far}).withColumn("ios", spatial.ios())
    pairs = pairs.withColumn("cdiag", F.col("distance") / (both + 1e-9))
    pairs = pairs.where((F.col("ios") >= trust) | ((F.col("cdiag") < gate) & labels_agree()))
    return pairs.select(F.col("l.uid").alias("a_uid"), F.col("r.uid").alias("b_uid"), "ios", "cdiag")


def kept_of_lead(objects: DataFrame) -> list[str]:
    """The columns, beside the box, that a fused object takes from its lead."""
    return [c for c in ("yaw", "qx", "qy", "qz", "qw", "embedding") if c in objects.columns]


def fuse(members: DataFrame, lead: str = "conf") -> DataFrame:
    """One row for each component: centre weighted by confidence (at least 0.001), the lead's box and label, sums.

    ``members``: component, ord and the object columns.  The lead has the largest ``lead`` value,
    the first of equals by ord.  The lead's yaw, quaternion (qx to qw) and embedding stay too, where there are any.
    """
    w = F.greatest(F.col(lead).cast("double"), F.lit(1e-3))
    first = F.struct(F.col(lead), -F.col("ord"))
    mean = [(F.sum(w * F.col(c)) / F.sum(w)).alias(c) for c in XYZ]
    keep = [F.max_by(c, first).alias(c) for c in ("uid", "label", *HALF, *kept_of_lead(members))]
    return members.groupBy("component").agg(*mean, *keep, F.max("conf").alias("conf"), F.sum("support").alias("support"), F.count("*").alias("n_members"))


def merge_votes(members: DataFrame, votes: DataFrame) -> DataFrame:
    """(component, label, n, pos): votes summed by component; pos is the first place they came from."""
    order = members.select("component", "uid", "ord").join(votes, "uid")
    return order.groupBy("component", "label").agg(F.sum("n").alias("n"), F.min(F.struct("ord", "pos")).alias("pos"))


def winning_label(merged: DataFrame) -> DataFrame:
    """(component, label): the most votes, the first inserted of equals."""
    first = W.partitionBy("component").orderBy(F.desc("n"), "pos")
    return merged.withColumn("k", F.row_number().over(first)).where("k = 1").select("component", "label")


def merge_provenance(members: DataFrame) -> DataFrame:
    """(component, session, support, conf, track): per session the sums, the best confidence, and the first track."""
    return members.groupBy("component", "session").agg(F.sum("support").alias("support"), F.max("conf").alias("conf"), F.min_by("uid", "ord").alias("track"))


def reconcile(a: DataFrame, b: DataFrame, votes: DataFrame, trust: float = 0.5, gate: float = 0.5) -> DataFrame:
    """The merged map: fused, only-A and only-B objects, with ``kind`` and uid.

    A's uids stay (a fused object takes its most confident A member's); objects only in B get new
    ones above A's largest, in B's order.  ``ios`` is the best overlap of a fused component.
    Either side may be empty.
    """
    left, right = (label_sets(s, votes) for s in (a, b))
    pairs = materialize(candidates(left, right, trust, gate), "reconcile")
    tag = lambda c, side: F.concat(F.lit(side), F.lpad(F.col(c).cast("string"), 20, "0"))
    nodes = left.select(tag("uid", "a").alias("id")).unionByName(right.select(tag("uid", "b").alias("id")))
    parts = graph.components(nodes, pairs.select(tag("a_uid", "a").alias("u"), tag("b_uid", "b").alias("v")))
    whole = left.withColumn("side", F.lit("a")).unionByName(right.withColumn("side", F.lit("b")))
    whole = whole.withColumn("id", F.concat("side", F.lpad(F.col("uid").cast("string"), 20, "0"))).join(parts, "id")
    # A comes before B among equals
    whole = whole.withColumn("ord", F.col("ord") + F.when(F.col("side") == "b", F.lit(1 << 40)).otherwise(0))
    whole = materialize(whole, "reconcile-members")
    kinds = whole.groupBy("component").agg(
        F.max(F.when(F.col("side") == "a", 1).otherwise(0)).alias("has_a"),
        F.max(F.when(F.col("side") == "b", 1).otherwise(0)).alias("has_b"),
        F.max_by(F.when(F.col("side") == "a", F.col("uid")), F.when(F.col("side") == "a", F.struct("conf", -F.col("ord")))).alias("a_uid"),
        F.min("ord").alias("first"),
    )
    kinds = kinds.withColumn("kind", F.when(F.col("has_a") + F.col("has_b") == 2, "fused").when(F.col("has_a") == 1, "only_a").otherwise("only_b"))
    top = a.agg(F.coalesce(F.max("uid"), F.lit(-1))).first()[0]
    fresh = ranking.numbered(kinds.where("kind = 'only_b'").select("component", "first"), "first").select("component", (F.col("rank") + top).alias("new_uid"))
    best = pairs.join(parts.withColumnRenamed("id", "node"), tag("a_uid", "a") == F.col("node")).groupBy("component").agg(F.max("ios").alias("ios"))
    fused = fuse(whole).drop("uid", "label")
    labelled = votes.select("uid", "label", "n", "pos")
    label = winning_label(merge_votes(whole.select("component", "uid", "ord"), labelled))
    lead = whole.groupBy("component").agg(F.max_by("label", F.struct("conf", -F.col("ord"))).alias("lead_label"))
    out = fused.join(kinds.select("component", "kind", "a_uid"), "component").join(fresh, "component", "left").join(label, "component", "left").join(lead, "component").join(best, "component", "left")
    return out.select(F.coalesce("a_uid", "new_uid").cast("long").alias("uid"), "kind", *XYZ, *HALF, *kept_of_lead(whole), F.coalesce("label", "lead_label").alias("label"), "conf", "support", "n_members", F.coalesce("ios", F.lit(0.0)).alias("ios"))


def overlap_pairs(objects: DataFrame, share: float, size: float = 4.0) -> DataFrame:
    """(u, v, ios) of objects whose centres are within half their diagonals together and whose boxes overlap by ``share``."""
    d = vector.distance(*[(F.col(f"l.{c}"), F.col(f"r.{c}")) for c in XYZ])
    near = (F.col("l.uid") < F.col("r.uid")) & (d <= half_diagonal("l") + half_diagonal("r"))
    boxes = objects.select("uid", *XYZ, *HALF, *[c for c in ("yaw",) if c in objects.columns])
    if "yaw" in boxes.columns and share >= 0.5:
        return turned.overlap_pairs(boxes, share, size)
    pairs = spatial.boxes_overlapping(boxes, boxes, size, near, share).withColumn("ios", spatial.ios())
    return pairs.where(F.col("ios") >= share).select(F.col("l.uid").alias("u"), F.col("r.uid").alias("v"), "ios")


def overlap_merge(objects: DataFrame, share: float) -> DataFrame:
    """Objects of one map that overlap are fused; the smallest uid stays.  ``share`` of 0 or less changes nothing."""
    if share <= 0:
        links = objects.select(F.col("uid").alias("u"), F.col("uid").alias("v")).limit(0)
    else:
        links = overlap_pairs(objects, share).select("u", "v")
    parts = graph.components(objects.select(F.col("uid").alias("id")), links)
    members = objects.join(parts, objects["uid"] == parts["id"])
    return fuse(members).withColumn("uid", F.col("component")).drop("component")


def suppress_contained(objects: DataFrame, share: float = 0.7, size: float = 4.0) -> DataFrame:
    """Objects that no strictly larger kept object contains by ``share``; in input order, as earlier decisions bind later ones.

    An object is settled as soon as all containers that come earlier are: rounds settle whole
    generations at a time, so a chain of k nested boxes takes k rounds.
    """
    vol = lambda s: geo.volume([F.col(f"{s}.{h}") for h in HALF])
    boxes = objects.select("uid", "ord", *XYZ, *HALF, *[c for c in ("yaw",) if c in objects.columns])
    pairs = spatial.boxes_overlapping(boxes, boxes, size, (F.col("l.uid") != F.col("r.uid")) & (vol("r") > vol("l")), share)
    pairs = pairs.where(F.col("shared") >= share * vol("l"))
    inside = materialize(pairs.select(F.col("l.uid").alias("i"), F.col("l.ord").alias("io"), F.col("r.uid").alias("j"), F.col("r.ord").alias("jo")), "suppress")
    # a container that comes later is always still kept when i is visited
    dropped = materialize(inside.where("jo > io").select("i").distinct(), "suppress")
    open_ = materialize(inside.where("jo < io").join(dropped, "i", "left_anti"), "suppress")
    while open_.limit(1).count():
        waiting = open_.select(F.col("i").alias("j")).distinct()
        settled = open_.join(waiting, "j", "left_anti")  # containers that are decided
        alive = settled.join(dropped.select(F.col("i").alias("j")), "j", "left_anti")
        gone = materialize(alive.select("i").distinct(), "suppress")
        spent = settled.select("i", "j").distinct()
        dropped = materialize(dropped.unionByName(gone), "suppress")
        open_ = materialize(open_.join(spent, ["i", "j"], "left_anti").join(gone, "i", "left_anti"), "suppress")
    return objects.join(dropped.withColumnRenamed("i", "uid"), "uid", "left_anti")
