"""Rules over map-feature tags (map<string,string>): admission, kinds, names, classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tag vocabularies that results depend on.
METADATA_KEYS = (
    "check_date", "created_by", "description", "end_date", "fixme", "layer", "length", "local_ref", "note", "opening_date", "ref", "ref:FR:cadastre",
    "ref:INSEE", "ref:NUM_ILOT", "ref:UAI", "source", "start_date", "survey:date", "todo",
)
PLAIN_METADATA_KEYS = ("check_date", "created_by", "description", "fixme", "note", "source", "todo")
METADATA_PREFIXES = ("addr:", "contact:", "ref:", "source:")
STRONG_KEYS = ("amenity", "building", "building:part", "healthcare", "historic", "landuse", "leisure", "natural", "office", "shop", "sport", "tourism", "water")
WALKABLE = ("cycleway", "footway", "living_street", "path", "pedestrian", "steps")


def present(tags: Column, key: str) -> Column:
    """The tag's value, null if absent or empty."""
    return F.nullif(tags[key], F.lit(""))


def has(tags: Column, key: str) -> Column:
    return present(tags, key).isNotNull()


def disposition(tags: Column, area: Column, low: float, high: float) -> Column:
    """What a polygon is for: excluded (by area), boundary, pathway, infrastructure or hierarchy."""
    strong = F.exists(F.map_keys(tags), lambda k: k.isin(*STRONG_KEYS))
    return (
        F.when((area < low) | (area > high), "excluded")
        .when(has(tags, "boundary"), "boundary")
        .when(has(tags, "highway"), "pathway")
        .when((has(tags, "power") | has(tags, "railway")) & ~strong, "infrastructure")
        .otherwise("hierarchy")
    )


def walkable(kind: Column, tags: Column) -> Column:
    return F.coalesce((kind == "linestring") & tags["highway"].isin(*WALKABLE), F.lit(False))


def geometry_kind(type_: Column, tags: Column, vertices: Column, tolerance: float = 1e-9) -> Column:
    """polygon, point or linestring of an element with (lat, lon) vertices."""
    a, b = F.element_at(vertices, 1), F.element_at(vertices, -1)
    ring = (F.size(vertices) >= 4) & (F.abs(a["lat"] - b["lat"]) < tolerance) & (F.abs(a["lon"] - b["lon"]) < tolerance)
    shaped = F.coalesce((tags["area"] == "yes") | has(tags, "area:highway"), has(tags, "area:highway"), F.lit(False))
    return F.when(shaped | ((type_ == "way") & ring), "polygon").when(F.size(vertices) == 1, "point").otherwise("linestring")


def category(tags: Column) -> Column:
    """building before highway, by the key's presence; null for anything else."""
    return F.when(F.map_contains_key(tags, "building"), "building").when(F.map_contains_key(tags, "highway"), "highway")


def primary_key(tags: Column) -> Column:
    """The smallest key that doesn't start with an underscore."""
    return F.coalesce(F.array_min(F.filter(F.map_keys(tags), lambda k: ~k.startswith("_"))), F.lit("untagged"))


def metadata(key: Column, keys: tuple[str, ...] = METADATA_KEYS) -> Column:
    test = key.isin(*keys)
    for p in METADATA_PREFIXES:
        test = test | key.startswith(p)
    return test


def context(tags: Column, keys: tuple[str, ...] = METADATA_KEYS) -> Column:
    """Tags that are not metadata."""
    return F.map_filter(tags, lambda k, v: ~metadata(k, keys))


def name(tags: Column) -> Column:
    return F.coalesce(*[present(tags, k) for k in ("name", "alt_name", "short_name", "ref")], F.lit(""))


def classify(tags: Column) -> Column:
    """struct(role, category, function, name, desc) by the first rule that applies."""
    title = name(tags)
    called = F.nullif(title, F.lit(""))

    def row(role: str, cat: str | Column, fn: str | Column, desc: Column, cut: bool = False) -> Column:
        lit = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.struct(lit(role).alias("role"), lit(cat).alias("category"), lit(fn).alias("function"), title.alias("name"), (F.left(desc, F.lit(240)) if cut else desc).alias("desc"))

    said = lambda c, tail: F.coalesce(called, F.concat(c, F.lit(tail)))
    b = F.coalesce(tags["building"], F.lit("yes"))
    use = F.when(b.isin("university", "college", "school"), "academic").when(b.isin("dormitory", "residential"), "residential").when(b.isin("garage", "service", "roof"), "utility").otherwise("unknown")
    levels = F.coalesce(F.concat(F.lit(", "), present(tags, "building:levels"), F.lit(" levels")), F.lit(""))
    leisure, landuse, natural, amenity = (tags[k] for k in ("leisure", "landuse", "natural", "amenity"))
    pitch = F.concat(leisure, F.lit(" area ("), F.coalesce(tags["sport"], leisure), F.lit(")"))
    ctx = context(tags, PLAIN_METADATA_KEYS)
    pairs = F.transform(F.slice(F.array_sort(F.map_keys(ctx)), 1, 4), lambda k: F.concat(k, F.lit("="), ctx[k]))
    hint = F.when(F.size(pairs) > 0, F.concat(F.lit("unclassified area ("), F.array_join(pairs, ", "), F.lit(")"))).otherwise("unclassified area")
    return (
        F.when(has(tags, "building") | has(tags, "building:part"), row("structure", "building", use, F.concat(said(b, " building"), levels), True))
        .when(amenity.isin("parking", "parking_space"), row("facility", "parking", "transport", F.coalesce(called, F.lit("vehicle parking area"))))
        .when(leisure.isin("pitch", "sports_centre", "fitness_station", "swimming_pool"), row("facility", "recreation", "sports", F.coalesce(called, pitch), True))
        .when(leisure.isin("park", "garden", "playground"), row("region_use", F.when(leisure == "garden", "vegetation").otherwise("recreation"), "none", said(leisure, " area")))
        .when(has(tags, "landuse"), row("region_use", F.when(landuse.isin("reservoir", "basin", "pond"), "water").otherwise("vegetation"), F.when(landuse.isin("commercial", "retail"), "retail").otherwise("none"), said(landuse, " land")))
        .when(has(tags, "natural"), row("region_use", F.when(natural == "water", "water").otherwise("vegetation"), "none", said(natural, " area")))
        .when(has(tags, "amenity"), row("facility", "service_point", F.when(amenity.isin("university", "school"), "academic").when(amenity.isin("charging_station", "shelter"), "transport").otherwise("unknown"), said(amenity, " facility")))
        .otherwise(row("unclassified", "unknown", "unknown", hint, True))
    )
