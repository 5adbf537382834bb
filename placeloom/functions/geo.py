"""Geometry as column arithmetic: rotations, similarity transforms, boxes, gates, cameras, map tiles, rings."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = Sequence[Column]


def quaternion_matrix(q: Vec) -> list[Column]:
    """Row-major rotation matrix of (x, y, z, w), which is not normalised first."""
    x, y, z, w = q
    return [
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
    ]


def matrix_quaternion(r: Vec) -> list[Column]:
    """(x, y, z, w) of a row-major rotation: by the trace if it is positive, else by the largest diagonal entry."""
    trace = r[0] + r[4] + r[8]

    def by(s: Column, x: Column, y: Column, z: Column, w: Column) -> Column:
        return F.struct((x / s).alias("x"), (y / s).alias("y"), (z / s).alias("z"), (w / s).alias("w"))

    safe = lambda v: 2 * F.sqrt(F.greatest(v, F.lit(1e-300)))
    st, sx, sy, sz = safe(trace + 1), safe(1 + r[0] - r[4] - r[8]), safe(1 + r[4] - r[0] - r[8]), safe(1 + r[8] - r[0] - r[4])
    q = (
        F.when(trace > 0, by(st, r[7] - r[5], r[2] - r[6], r[3] - r[1], st * st / 4))
        .when((r[0] > r[4]) & (r[0] > r[8]), by(sx, sx * sx / 4, r[1] + r[3], r[2] + r[6], r[7] - r[5]))
        .when(r[4] > r[8], by(sy, r[1] + r[3], sy * sy / 4, r[5] + r[7], r[2] - r[6]))
        .otherwise(by(sz, r[2] + r[6], r[5] + r[7], sz * sz / 4, r[3] - r[1]))
    )
    return [q[k] for k in "xyzw"]


def rotate(r: Sequence, p: Vec) -> list[Column]:
    return [r[3 * k] * p[0] + r[3 * k + 1] * p[1] + r[3 * k + 2] * p[2] for k in range(3)]


def product(a: Sequence, b: Sequence) -> list:
    """Row-major product of two 3x3 matrices."""
    return [sum(a[3 * i + k] * b[3 * k + j] for k in range(3)) for i in range(3) for j in range(3)]


class Sim3:
    """Similarity transform x -> scale * R x + t, small enough to be literals in a plan."""

    def __init__(self, scale: float = 1.0, rotation: Sequence[float] = (1, 0, 0, 0, 1, 0, 0, 0, 1), shift: Sequence[float] = (0, 0, 0)):
        self.scale, self.rotation, self.shift = float(scale), [float(x) for x in rotation], [float(x) for x in shift]

    def apply(self, p: Vec) -> list[Column]:
        return [self.scale * x + t for x, t in zip(rotate(self.rotation, p), self.shift)]

    def of(self, p: Sequence[float]) -> list[float]:
        return [self.scale * x + t for x, t in zip(rotate(self.rotation, p), self.shift)]

    def __matmul__(self, other: Sim3) -> Sim3:
        """(a @ b)(x) = a(b(x))."""
        return Sim3(self.scale * other.scale, product(self.rotation, other.rotation), self.of(other.shift))

    def inverse(self) -> Sim3:
        back = [self.rotation[3 * j + i] for i in range(3) for j in range(3)]
        return Sim3(1 / self.scale, back, [-x / self.scale for x in rotate(back, self.shift)])

    def matrix(self) -> list[Column]:
        return [F.lit(x) for x in self.rotation]


def yaw(r: Vec) -> Column:
    return F.atan2(r[3], r[0])


def volume(h: Vec) -> Column:
    """Of a box with half sizes ``h``."""
    return 8 * h[0] * h[1] * h[2]


def overlap(c1: Vec, h1: Vec, c2: Vec, h2: Vec) -> Column:
    """Volume that two axis-aligned boxes share; 0 if they only touch."""
    sides = [F.greatest(F.lit(0.0), F.least(c1[k] + h1[k], c2[k] + h2[k]) - F.greatest(c1[k] - h1[k], c2[k] - h2[k])) for k in range(3)]
    return sides[0] * sides[1] * sides[2]


def over_union(shared: Column, v1: Column, v2: Column) -> Column:
    total = v1 + v2 - shared
    return F.when(total > 1e-12, shared / total).otherwise(0.0)


def _inside(p: Vec, d: Vec, half: Vec) -> Column:
    """The share of the segment p, p + d that lies in the rectangle of half sizes ``half`` around the origin."""
    low, high = F.lit(0.0), F.lit(1.0)
    for x, step, h in zip(p, d, half):
        flat = F.abs(step) < 1e-12
        a, b = (-h - x) / F.when(~flat, step), (h - x) / F.when(~flat, step)
        low = F.greatest(low, F.when(flat, F.when(F.abs(x) <= h, 0.0).otherwise(2.0)).otherwise(F.least(a, b)))
        high = F.least(high, F.when(flat, 1.0).otherwise(F.greatest(a, b)))
    return F.greatest(high - low, F.lit(0.0))


def turned_area(c1: Vec, h1: Vec, yaw1: Column, c2: Vec, h2: Vec, yaw2: Column) -> Column:
    """Area that two turned rectangles share: the line integral along each one's edges within the other.

    Where the sides are parallel, edges may coincide; the overlap is then that of two intervals each way.
    """
    turn = yaw1 - yaw2
    cb, sb = F.cos(yaw2), F.sin(yaw2)
    dx, dy = c1[0] - c2[0], c1[1] - c2[1]
    # the first's centre as the second sees it, named once: spelt out, the expression is too large to compile
    named = {"c": F.cos(turn), "s": F.sin(turn), "x": cb * dx + sb * dy, "y": cb * dy - sb * dx, "ax": h1[0], "ay": h1[1], "bx": h2[0], "by": h2[1]}
    corners = ((-1, -1), (1, -1), (1, 1), (-1, 1))
    sides = F.array(*[F.struct(F.lit(float(i)).alias("i"), F.lit(float(j)).alias("j"), F.lit(float(ni - i)).alias("u"), F.lit(float(nj - j)).alias("v")) for (i, j), (ni, nj) in zip(corners, corners[1:] + corners[:1])])

    def edges(v: Column, e: Column) -> Column:
        c, s, i, j = v["c"], v["s"], e["i"], e["j"]
        p = [v["x"] + i * v["ax"] * c - j * v["ay"] * s, v["y"] + i * v["ax"] * s + j * v["ay"] * c]
        d = [e["u"] * v["ax"] * c - e["v"] * v["ay"] * s, e["u"] * v["ax"] * s + e["v"] * v["ay"] * c]
        q, f = [i * v["bx"] - v["x"], j * v["by"] - v["y"]], [e["u"] * v["bx"], e["v"] * v["by"]]
        back = lambda w: [c * w[0] + s * w[1], c * w[1] - s * w[0]]
        return _inside(p, d, [v["bx"], v["by"]]) * (p[0] * d[1] - p[1] * d[0]) + _inside(back(q), back(f), [v["ax"], v["ay"]]) * 2.0 * v["bx"] * v["by"]

    def area(v: Column) -> Column:
        square = F.abs(v["s"]) < 1e-9
        own = [F.when(square, v["ax"]).otherwise(v["ay"]), F.when(square, v["ay"]).otherwise(v["ax"])]
        both = [F.greatest(F.least(a + x, y) - F.greatest(a - x, -y), F.lit(0.0)) for a, x, y in zip((v["x"], v["y"]), own, (v["bx"], v["by"]))]
        total = F.aggregate(sides, F.lit(0.0), lambda acc, e: acc + edges(v, e))
        return F.when(square | (F.abs(v["c"]) < 1e-9), both[0] * both[1]).otherwise(F.greatest(total / 2, F.lit(0.0)))

    return F.transform(F.array(F.struct(*[x.alias(n) for n, x in named.items()])), area)[0]


def turned_overlap(c1: Vec, h1: Vec, yaw1: Column, c2: Vec, h2: Vec, yaw2: Column) -> Column:
    """Volume that two boxes turned about the vertical share."""
    high = F.least(c1[2] + h1[2], c2[2] + h2[2]) - F.greatest(c1[2] - h1[2], c2[2] - h2[2])
    return F.when(high > 0, high * turned_area(c1, h1, yaw1, c2, h2, yaw2)).otherwise(0.0)


def over_smaller(shared: Column, v1: Column, v2: Column) -> Column:
    """Share of the smaller box; 0 if that has no volume."""
    low = F.least(v1, v2)
    return F.when(low > 1e-12, shared / low).otherwise(0.0)


def crosses_gate(p0: Vec, p1: Vec, center: Vec, rotation: Vec | None, half: Vec, margin: Column | float = 0.3) -> Column:
    """Whether the segment passes the gate: a box's middle plane across its thinnest axis, widened by ``margin``."""
    r = rotation or [F.lit(float(k % 4 == 0)) for k in range(9)]
    axis = [[r[k], r[3 + k], r[6 + k]] for k in range(3)]
    along = lambda a, v: a[0] * v[0] + a[1] * v[1] + a[2] * v[2]
    d = [b - a for a, b in zip(p0, p1)]
    tests = []
    for thin in range(3):
        slope = along(axis[thin], d)
        t = along(axis[thin], [c - p for c, p in zip(center, p0)]) / F.when(F.abs(slope) < 1e-9, F.lit(None)).otherwise(slope)
        at = [p + t * x - c for p, x, c in zip(p0, d, center)]
        inside = F.lit(True)
        for k in range(3):
            if k != thin:
                inside = inside & (F.abs(along(axis[k], at)) <= half[k] + margin)
        tests.append(F.coalesce((t >= 0) & (t <= 1) & inside, F.lit(False)))
    first = (half[0] <= half[1]) & (half[0] <= half[2])
    return F.when(first, tests[0]).when(half[1] <= half[2], tests[1]).otherwise(tests[2])


def unproject(u: Column, v: Column, depth: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> list[Column]:
    """Camera coordinates of a pixel with depth."""
    return [(u - cx) * depth / fx, (v - cy) * depth / fy, depth]


def project(p: Vec, fx: Column | float, fy: Column | float, cx: Column | float, cy: Column | float) -> list[Column]:
    """Pixel coordinates of a point in camera coordinates, null behind the camera."""
    z = F.when(p[2] > 0, p[2])
    return [fx * p[0] / z + cx, fy * p[1] / z + cy]


def to_camera(p: Vec, rotation: Vec, origin: Vec) -> list[Column]:
    """World coordinates seen from a camera-to-world pose: R^T (p - t)."""
    d = [a - b for a, b in zip(p, origin)]
    return [rotation[k] * d[0] + rotation[3 + k] * d[1] + rotation[6 + k] * d[2] for k in range(3)]


def tile(lat: Column, lon: Column, zoom: int) -> list[Column]:
    """Fractional Web-Mercator tile coordinates."""
    n, r = float(2**zoom), F.radians(lat)
    return [(lon + 180.0) / 360.0 * n, (1.0 - F.log(F.tan(r) + 1.0 / F.cos(r)) / math.pi) / 2.0 * n]


def tile_corner(x: Column, y: Column, zoom: int) -> list[Column]:
    """Latitude and longitude of a fractional tile."""
    n = float(2**zoom)
    return [F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / n)))), x / n * 360.0 - 180.0]


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180.0) / 6.0) + 1).cast("int")


def utm(lat: Column, lon: Column, zone: Column) -> list[Column]:
    """Easting and northing on WGS84 by Krüger's series of third order in n."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    a = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    k = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - k * F.atanh(k * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, c in enumerate(alpha, 1):
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return [500000.0 + 0.9996 * a * east, F.when(lat < 0, 10000000.0).otherwise(0.0) + 0.9996 * a * north]


def local_plane(lat: Column, lon: Column, lat0: float, lon0: float) -> list[Column]:
    """East and north in metres of a point near an origin: azimuthal equidistant on the osculating sphere at the origin."""
    f = 1 / 298.257223563
    e2, s0 = f * (2 - f), math.sin(math.radians(lat0))
    w = 1 - e2 * s0 * s0
    meridian, normal = 6378137.0 * (1 - e2) / w**1.5, 6378137.0 / math.sqrt(w)
    return [F.radians(lon - lon0) * normal * F.cos(F.radians((lat + lat0) / 2)), F.radians(lat - lat0) * meridian]


def closed(ring: Column) -> Column:
    """The ring with its first vertex repeated at the end, if it isn't; empty under three vertices."""
    shut = F.when(F.element_at(ring, 1) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))
    return F.when(F.size(ring) >= 3, shut).otherwise(F.slice(ring, 1, 0))


def _cross_sum(ring: Column, term) -> Column:
    steps = F.transform(F.sequence(F.lit(0), F.size(ring) - 2), lambda i: term(ring[i], ring[i + 1]))
    return F.when(F.size(ring) >= 3, F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)


def signed_area(ring: Column) -> Column:
    """Shoelace area of a closed ring of structs (x, y), counter-clockwise positive."""
    return _cross_sum(ring, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]) / 2


def centroid(ring: Column) -> list[Column]:
    """Of the polygon, not of its vertices."""
    area = signed_area(ring)
    area = F.when(area != 0, area)
    weigh = lambda k: _cross_sum(ring, lambda a, b: (a[k] + b[k]) * (a["x"] * b["y"] - b["x"] * a["y"]))
    return [weigh("x") / (6 * area), weigh("y") / (6 * area)]


def voxel(x: Column, size: float) -> Column:
    return F.floor(x / size)


def voxel_key(ix: Column, iy: Column, iz: Column) -> Column:
    """Three cell numbers packed into one long, 21 bits each."""
    move = lambda c: c.cast("long") + (1 << 20)
    return F.shiftleft(move(ix), 42).bitwiseOR(F.shiftleft(move(iy), 21)).bitwiseOR(move(iz))
