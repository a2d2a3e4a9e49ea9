"""Geographic column functions; angles in degrees, lengths in metres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radii of the two distance models, kept apart by use.
FLAT_RADIUS, HAVERSINE_RADIUS = 6_371_000.0, 6_371_008.8
METRES_PER_DEGREE = 111_195.0


def flat_distance(lon1, lat1, lon2, lat2) -> Column:
    """Equirectangular distance at the mean latitude, the short way round."""
    apart = F.abs(lon2 - lon1) % 360
    x = F.radians(F.least(apart, 360 - apart)) * F.cos(F.radians((lat1 + lat2) / 2))
    y = F.radians(lat2 - lat1)
    return FLAT_RADIUS * F.sqrt(x * x + y * y)


def planar(a: Column, b: Column) -> Column:
    """Distance of two points (structs ``x, y``) in a plane."""
    return F.hypot(b["x"] - a["x"], b["y"] - a["y"])


def segments(points: Column) -> Column:
    """Neighbours of a line as structs ``a, b``; none for fewer than two points."""
    n = F.greatest(F.size(points) - 1, F.lit(0))
    return F.zip_with(F.slice(points, F.lit(1), n), F.slice(points, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def haversine(lon1, lat1, lon2, lat2) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2)
    b = F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * HAVERSINE_RADIUS * F.asin(F.sqrt(F.least(a + b, F.lit(1.0))))


def tile(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Web-mercator tile numbers, held within the map."""
    n = float(1 << zoom)
    s = F.sin(F.radians(lat))
    y = (1 - F.log((1 + s) / (1 - s)) / (2 * 3.141592653589793)) / 2 * n
    hold = lambda c: F.least(F.greatest(F.floor(c), F.lit(0)), F.lit(int(n) - 1)).cast("long")
    return hold((lon + 180) / 360 * n), hold(y)


def z_order(x: Column, y: Column, bits: int = 16) -> Column:
    """Interleaved bits of two whole numbers, x in the even places."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(x, b).bitwiseAND(1).cast("long"), 2 * b))
        out = out.bitwiseOR(F.shiftleft(F.shiftright(y, b).bitwiseAND(1).cast("long"), 2 * b + 1))
    return out


def hilbert_tile(x: Column, y: Column, zoom: int) -> Column:
    """Number of a tile along the Hilbert curves of all zooms up to its own."""
    state = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(((1 << 2 * zoom) - 1) // 3).cast("long").alias("d"))

    def step(s: Column, half: Column) -> Column:
        right, upper = (s["x"].bitwiseAND(half) > 0).cast("long"), (s["y"].bitwiseAND(half) > 0).cast("long")
        d = s["d"] + half * half * (3 * right).bitwiseXOR(upper)
        flip = (upper == 0) & (right == 1)
        # Turn the quarter so that the curve inside it starts and ends where it must.
        px, py = F.when(flip, half - 1 - s["x"]).otherwise(s["x"]), F.when(flip, half - 1 - s["y"]).otherwise(s["y"])
        return F.struct(
            F.when(upper == 0, py).otherwise(px).alias("x"), F.when(upper == 0, px).otherwise(py).alias("y"), d.alias("d")
        )

    halves = F.array(*(F.lit(1 << k).cast("long") for k in range(zoom - 1, -1, -1))) if zoom else F.array().cast("array<bigint>")
    return F.aggregate(halves, state, step, lambda s: s["d"])


def on_segment(px, py, ax, ay, bx, by) -> tuple[Column, Column]:
    """Planar distance of a point to a segment, and the share of the segment at its foot."""
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.least(F.greatest(((px - ax) * dx + (py - ay) * dy) / size, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return F.sqrt(ex * ex + ey * ey), t


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies in a ring (array of structs ``x, y``, closed or not) or on its border."""
    n = F.size(ring)
    edges = F.transform(ring, lambda a, i: F.struct(a.alias("a"), F.get(ring, F.pmod(i + 1, n)).alias("b")))

    def border(e: Column) -> Column:
        a, b = e["a"], e["b"]
        cross = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
        return (cross == 0) & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])

    hits = F.size(F.filter(edges, crosses))
    return F.exists(edges, border) | (hits % 2 == 1)


def ring_measures(ring: Column) -> Column:
    """Struct ``area, x, y`` of a ring (array of structs ``x, y``): signed area and centre of mass.

    Without area, the centre is the first corner.
    """
    n = F.size(ring)
    pairs = F.transform(ring, lambda a, i: F.struct(a.alias("a"), F.get(ring, F.pmod(i + 1, n)).alias("b")))
    zero = F.lit(0.0)

    def step(s: Column, e: Column) -> Column:
        a, b = e["a"], e["b"]
        cross = a["x"] * b["y"] - b["x"] * a["y"]
        return F.struct(
            (s["area"] + cross / 2).alias("area"), (s["x"] + (a["x"] + b["x"]) * cross).alias("x"), (s["y"] + (a["y"] + b["y"]) * cross).alias("y")
        )

    def centre(s: Column) -> Column:
        six = F.nullif(6 * s["area"], zero)
        first = F.get(ring, F.lit(0))
        return F.struct(s["area"].alias("area"), F.coalesce(s["x"] / six, first["x"]).alias("x"), F.coalesce(s["y"] / six, first["y"]).alias("y"))

    return F.aggregate(pairs, F.struct(zero.alias("area"), zero.alias("x"), zero.alias("y")), step, centre)


def enters_box(line: Column, west: float, south: float, east: float, north: float) -> Column:
    """Whether any segment of a line (array of structs ``x, y``) touches a box.

    It does if their boxes overlap and the box's corners are not all on one side of it.
    """

    def touches(s: Column) -> Column:
        a, b = s["a"], s["b"]
        overlap = (F.greatest(a["x"], b["x"]) >= west) & (F.least(a["x"], b["x"]) <= east) & (F.greatest(a["y"], b["y"]) >= south) & (F.least(a["y"], b["y"]) <= north)
        side = lambda x, y: F.signum((b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"]))
        sides = [side(x, y) for x in (west, east) for y in (south, north)]
        return overlap & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)

    return F.exists(segments(line), touches)
