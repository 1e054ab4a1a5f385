"""Geometry as Catalyst expressions over arrays of (x, y) structs: lines, rings, boxes, axes, and the map projection."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x: double, y: double>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def distance(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def let(value: Column, of) -> Column:
    """of(value) with the value worked out once: inside higher-order functions an expression is evaluated wherever it stands."""
    return F.element_at(F.transform(F.array(value), of), 1)


def segments(line: Column) -> Column:
    """The pairs of neighbouring points."""
    n = F.size(line)
    return F.arrays_zip(F.slice(line, F.lit(1), F.greatest(n - 1, F.lit(0))).alias("a"), F.slice(line, F.lit(2), F.greatest(n - 1, F.lit(0))).alias("b"))


def _total(array: Column, of) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + of(x))


def length(line: Column) -> Column:
    return _total(segments(line), lambda s: distance(s["a"], s["b"]))


def signed_area(ring: Column) -> Column:
    """Of a closed ring, positive where it turns left."""
    return _total(segments(ring), lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]) / 2


def centroid(ring: Column) -> Column:
    cross = lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]
    six = signed_area(ring) * 6
    return point(_total(segments(ring), lambda s: (s["a"]["x"] + s["b"]["x"]) * cross(s)) / six, _total(segments(ring), lambda s: (s["a"]["y"] + s["b"]["y"]) * cross(s)) / six)


def box(line: Column) -> Column:
    xs, ys = F.transform(line, lambda p: p["x"]), F.transform(line, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A closed ring, counter-clockwise."""
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))


def start(line: Column) -> Column:
    return F.element_at(line, 1)


def end(line: Column) -> Column:
    return F.element_at(line, -1)


def interpolate(line: Column, at: Column) -> Column:
    """The point at a length along the line, held to its ends."""
    none = F.lit(None).cast(POINT)
    first = F.struct(F.lit(0.0).alias("s"), none.alias("p"))

    def step(state: Column, g: Column) -> Column:
        d = distance(g["a"], g["b"])
        f = F.when(d > 0, (at - state["s"]) / d).otherwise(0.0)
        here = point(g["a"]["x"] + f * (g["b"]["x"] - g["a"]["x"]), g["a"]["y"] + f * (g["b"]["y"] - g["a"]["y"]))
        return F.struct((state["s"] + d).alias("s"), F.when(state["p"].isNotNull(), state["p"]).when((at >= state["s"]) & (at <= state["s"] + d), here).otherwise(none).alias("p"))

    inside = F.aggregate(segments(line), first, step, lambda s: s["p"])
    return F.when(at <= 0, start(line)).otherwise(F.coalesce(inside, end(line)))


def project(line: Column, p: Column) -> Column:
    """(s, t) of the nearest place on the line: length along it, and distance from it, positive to the left; the first of equals."""
    return _projected(segments(line), p)


def _projected(pieces: Column, p: Column) -> Column:
    zero = F.struct(F.lit(0.0).alias("at"), F.lit(None).cast("double").alias("d"), F.lit(0.0).alias("s"), F.lit(0.0).alias("t"))

    def step(state: Column, g: Column) -> Column:
        named = lambda **of: F.struct(*[c.alias(n) for n, c in of.items()])
        vectors = named(dx=g["b"]["x"] - g["a"]["x"], dy=g["b"]["y"] - g["a"]["y"], px=p["x"] - g["a"]["x"], py=p["y"] - g["a"]["y"])

        def share(v: Column) -> Column:
            along = lambda square: F.when(square > 0, F.least(F.greatest((v["px"] * v["dx"] + v["py"] * v["dy"]) / square, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
            return let(v["dx"] * v["dx"] + v["dy"] * v["dy"], lambda q: named(v=v, f=along(q), size=F.sqrt(q)))

        def apart(w: Column) -> Column:
            v, f = w["v"], w["f"]
            side = F.when(v["dx"] * v["py"] - v["dy"] * v["px"] >= 0, 1.0).otherwise(-1.0)
            return named(d=F.hypot(v["px"] - f * v["dx"], v["py"] - f * v["dy"]), f=f, size=w["size"], side=side)

        def after(n: Column) -> Column:
            at = state["at"] + n["size"]
            here = named(at=at, d=n["d"], s=state["at"] + n["f"] * n["size"], t=n["side"] * n["d"])
            return F.when(state["d"].isNull() | (n["d"] < state["d"]), here).otherwise(named(at=at, d=state["d"], s=state["s"], t=state["t"]))

        return let(let(let(vectors, share), apart), after)

    return F.aggregate(pieces, zero, step, lambda s: F.struct(s["s"].alias("s"), s["t"].alias("t")))


def extent(axis: Column, shape: Column) -> Column:
    """Range of a shape's vertices on an axis: s0, s1 along it, t0, t1 across."""

    def ranges(st: Column) -> Column:
        s, t = F.transform(st, lambda q: q["s"]), F.transform(st, lambda q: q["t"])
        return F.struct(F.array_min(s).alias("s0"), F.array_max(s).alias("s1"), F.array_min(t).alias("t0"), F.array_max(t).alias("t1"))

    return let(let(segments(axis), lambda pieces: F.transform(shape, lambda p: _projected(pieces, p))), ranges)


def distance_to(line: Column, p: Column) -> Column:
    return F.abs(project(line, p)["t"])


def contains(ring: Column, p: Column) -> Column:
    """Whether a closed ring holds a point: an odd number of edges cross the ray to the right of it."""
    crossings = F.filter(segments(ring), lambda s: ((s["a"]["y"] > p["y"]) != (s["b"]["y"] > p["y"])) & (p["x"] < (s["b"]["x"] - s["a"]["x"]) * (p["y"] - s["a"]["y"]) / (s["b"]["y"] - s["a"]["y"]) + s["a"]["x"]))
    return F.size(crossings) % 2 == 1


def clip(ring: Column, nx: Column, ny: Column, c: Column) -> Column:
    """The part of a closed convex or simple ring where nx * x + ny * y <= c, closed again."""
    side = lambda p: nx * p["x"] + ny * p["y"] - c

    def of(s: Column) -> Column:
        u, v = side(s["a"]), side(s["b"])
        f = u / (u - v)
        cut = point(s["a"]["x"] + f * (s["b"]["x"] - s["a"]["x"]), s["a"]["y"] + f * (s["b"]["y"] - s["a"]["y"]))
        keep = F.when(u <= 0, F.array(s["a"])).otherwise(F.array().cast(f"array<{POINT}>"))
        return F.concat(keep, F.when(((u < 0) & (v > 0)) | ((u > 0) & (v < 0)), F.array(cut)).otherwise(F.array().cast(f"array<{POINT}>")))

    left = F.flatten(F.transform(segments(ring), of))
    return F.when(F.size(left) > 0, F.concat(left, F.slice(left, 1, 1))).otherwise(left)


def shifted(line: Column, by: Column) -> Column:
    """Each segment of two points moved to its left."""
    a, b = start(line), end(line)
    d = distance(a, b)
    dx, dy = -(b["y"] - a["y"]) / d * by, (b["x"] - a["x"]) / d * by
    return F.transform(line, lambda p: point(p["x"] + dx, p["y"] + dy))


def strip_size(area: Column, perimeter: Column) -> Column:
    """(width, length) of the rectangle that has this area and perimeter."""
    half = perimeter / 2
    width = (half - F.sqrt(F.greatest(half * half - 4 * area, F.lit(0.0)))) / 2
    return F.struct(width.alias("width"), (half - width).alias("length"))


def bearing(a: Column, b: Column) -> Column:
    """Degrees clockwise from north, 0 to 360."""
    return F.pmod(F.degrees(F.atan2(b["x"] - a["x"], b["y"] - a["y"])), F.lit(360.0))


def turn(a: Column, b: Column) -> Column:
    """The signed difference of two bearings, -180 to 180."""
    return F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0


def haversine(lon0: Column, lat0: Column, lon1: Column, lat1: Column, radius: float = 6_371_008.8) -> Column:
    a = F.pow(F.sin(F.radians(lat1 - lat0) / 2), 2) + F.cos(F.radians(lat0)) * F.cos(F.radians(lat1)) * F.pow(F.sin(F.radians(lon1 - lon0) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(a))


def wkt(line: Column, kind: str = "LINESTRING") -> Column:
    text = F.array_join(F.transform(line, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", ")
    return F.concat(F.lit(f"{kind} (" + ("(" if kind == "POLYGON" else "")), text, F.lit("))" if kind == "POLYGON" else ")"))


def from_wkt(text: Column) -> Column:
    """The points of a LINESTRING or of a POLYGON's outer ring."""
    first = F.regexp_extract(text, r"\(\(?([^()]*)\)", 1)
    return F.transform(F.split(first, ","), lambda p: point(F.element_at(F.split(F.trim(p), r"\s+"), 1).cast("double"), F.element_at(F.split(F.trim(p), r"\s+"), 2).cast("double")))


def geojson(line: Column, kind: str = "LineString") -> Column:
    return F.to_json(F.struct(F.lit(kind).alias("type"), F.transform(line, lambda p: F.array(p["x"], p["y"])).alias("coordinates")))


def from_geojson(text: Column) -> Column:
    read = F.from_json(text, "struct<type: string, coordinates: array<array<double>>>")
    return F.transform(read["coordinates"], lambda c: point(c[0], c[1]))


# WGS 84, and the third-order series of the transverse Mercator projection (fixed values: semi-major axis, flattening, scale, false easting).
_A, _F, _K0, _E0 = 6_378_137.0, 1 / 298.257223563, 0.9996, 500_000.0


def utm(lon: Column, lat: Column, zone: int) -> Column:
    """Metres of a place in a northern UTM zone, by the Krueger series to the third order in n (millimetres inside a zone)."""
    n = _F / (2 - _F)
    scale = _K0 * _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    sin = F.sin(F.radians(lat))
    atanh = lambda x: F.log((1 + x) / (1 - x)) / 2
    t = F.sinh(atanh(sin) - e * atanh(e * sin))
    dl = F.radians(lon - (6 * zone - 183))
    xi, eta = F.atan2(t, F.cos(dl)), atanh(F.sin(dl) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(alpha, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return point(_E0 + scale * x, scale * y)


def lon_lat(p: Column, zone: int) -> Column:
    """The inverse of utm: x is the longitude, y the latitude."""
    n = _F / (2 - _F)
    scale = _K0 * _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi, eta = p["y"] / scale, (p["x"] - _E0) / scale
    x, y = xi, eta
    for j, b in enumerate(beta, 1):
        x = x - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        y = y - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    lat = chi
    for j, d in enumerate(delta, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return point((6 * zone - 183) + F.degrees(F.atan2(F.sinh(y), F.cos(x))), F.degrees(lat))
