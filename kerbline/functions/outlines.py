"""More of lines and outlines as expressions: parallels, extensions, touching, rectangularity, arrows; and two codecs in Arrow batches."""

from __future__ import annotations

import math
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.functions import shapes as g

LINE = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))


def closed(line: Column) -> Column:
    """A ring of a line's points: the first again at the end, where it is not there already."""
    return F.when(g.start(line) == g.end(line), line).otherwise(F.concat(line, F.slice(line, 1, 1)))


def unit(a: Column, b: Column) -> Column:
    """The direction from a to b, of length one; zero where they are one point."""
    of = lambda d: g.point(F.when(d > 0, (b["x"] - a["x"]) / d).otherwise(0.0), F.when(d > 0, (b["y"] - a["y"]) / d).otherwise(0.0))
    return g.let(g.distance(a, b), of)


def bisector(before: Column, at: Column, after: Column) -> Column:
    """The normal of the cut between two pieces that meet at a point: the middle of the directions in and out."""
    i, o = unit(before, at), unit(at, after)
    return unit(g.point(F.lit(0.0), F.lit(0.0)), g.point(i["x"] + o["x"], i["y"] + o["y"]))


def parallel(line: Column, by: Column) -> Column:
    """A line of any number of points moved to its left, corners mitred; where the line turns back on itself, the point moves with
    the piece before it."""
    last = F.size(line) - 1

    def corners(units: Column) -> Column:
        return F.transform(line, lambda p, i: F.struct(p.alias("p"), F.get(units, F.greatest(i - 1, F.lit(0))).alias("u"), F.get(units, F.least(i, last - 1)).alias("v")))

    def moved(c: Column) -> Column:
        p, u, v = c["p"], c["u"], c["v"]
        dot = u["x"] * v["x"] + u["y"] * v["y"]
        back = dot < -0.999
        k = F.when(back, by).otherwise(by / (1 + F.when(back, 0.0).otherwise(dot)))
        nx, ny = F.when(back, -u["y"]).otherwise(-u["y"] - v["y"]), F.when(back, u["x"]).otherwise(u["x"] + v["x"])
        return g.point(p["x"] + k * nx, p["y"] + k * ny)

    units = F.transform(g.segments(line), lambda s: unit(s["a"], s["b"]))
    return F.when(last > 0, F.transform(g.let(units, corners), moved)).otherwise(line)


def extended(line: Column, by: Column) -> Column:
    """A line and a point beyond its end, straight on."""
    a, b = F.element_at(line, -2), g.end(line)
    u = unit(a, b)
    return F.concat(line, F.array(g.point(b["x"] + u["x"] * by, b["y"] + u["y"] * by)))


def touch_length(a: Column, b: Column, tolerance: float) -> Column:
    """How much of outline a runs along outline b, no further off than the tolerance."""

    def along(s: Column, t: Column) -> Column:
        u, size = unit(s["a"], s["b"]), g.distance(s["a"], s["b"])
        on = lambda p: (p["x"] - s["a"]["x"]) * u["x"] + (p["y"] - s["a"]["y"]) * u["y"]
        off = lambda p: F.abs((p["y"] - s["a"]["y"]) * u["x"] - (p["x"] - s["a"]["x"]) * u["y"])
        low, high = F.least(on(t["a"]), on(t["b"])), F.greatest(on(t["a"]), on(t["b"]))
        shared = F.greatest(F.least(high, size) - F.greatest(low, F.lit(0.0)), F.lit(0.0))
        return F.when((off(t["a"]) <= tolerance) & (off(t["b"]) <= tolerance), shared).otherwise(0.0)

    def with_all(s: Column) -> Column:
        return F.aggregate(g.segments(b), F.lit(0.0), lambda n, t: n + along(s, t))

    return F.aggregate(g.segments(a), F.lit(0.0), lambda n, s: n + with_all(s))


def crosses_box(way: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether a line of two points runs through the inside of a box."""
    a, b = g.start(way), g.end(way)

    def within(c: str, low: Column, high: Column) -> tuple[Column, Column]:
        """The shares of the way at which it enters and leaves the range of one axis."""
        d = b[c] - a[c]
        u, v = (low - a[c]) / d, (high - a[c]) / d
        still = (a[c] > low) & (a[c] < high)
        return F.when(d != 0, F.least(u, v)).when(still, 0.0).otherwise(1.0), F.when(d != 0, F.greatest(u, v)).when(still, 1.0).otherwise(0.0)

    (xi, xo), (yi, yo) = within("x", x0, x1), within("y", y0, y1)
    return F.greatest(xi, yi, F.lit(0.0)) < F.least(xo, yo, F.lit(1.0))


def rectangularity(ring: Column) -> Column:
    """Area as a share of the smallest rectangle around the ring that stands on one of its sides."""

    spread = lambda values: g.let(values, lambda v: F.array_max(v) - F.array_min(v))

    def size(points: Column, u: Column) -> Column:
        along, across = F.transform(points, lambda p: p["x"] * u["x"] + p["y"] * u["y"]), F.transform(points, lambda p: p["y"] * u["x"] - p["x"] * u["y"])
        return spread(along) * spread(across)

    def around(points: Column, s: Column) -> Column:
        return F.when(g.distance(s["a"], s["b"]) > 0, g.let(unit(s["a"], s["b"]), lambda u: size(points, u)))

    def share(points: Column) -> Column:
        least = F.array_min(F.transform(g.segments(points), lambda s: around(points, s)))
        return g.let(least, lambda n: F.when(n > 0, F.abs(g.signed_area(points)) / n))

    return g.let(ring, share)


# Fixed values of the painted arrow, in metres: the fork as a share of the shaft, a branch's reach ahead and aside, a head's length and half width.
_FORK, _AHEAD, _ASIDE, _HEAD, _WIDE = 0.45, 0.7, 1.0, 0.8, 0.4


def _glyph(size: float, ways: tuple[str, ...]) -> list[list[complex]]:
    """The arrow as drawn on paper: its tip at the origin, ahead along the real axis, left along the imaginary one."""
    tail, fork, tip = complex(-size), complex(-size * (1 - _FORK)), 0j
    stem = {"straight": [tail, tip], "left": [fork, fork + complex(_AHEAD, _ASIDE)], "right": [fork, fork + complex(_AHEAD, -_ASIDE)]}
    drawn = [stem[w] for w in stem if w in ways]
    heads = []
    for begin, end in drawn:
        turn = (end - begin) / abs(end - begin)
        heads.append([end + turn * p for p in (complex(-_HEAD, _WIDE), 0j, complex(-_HEAD, -_WIDE))])
    return ([] if "straight" in ways else [[tail, fork]]) + drawn + heads


def arrow(tip: Column, u: Column, size: float, ways: tuple[str, ...] = ("straight",)) -> Column:
    """A painted lane arrow as an array of lines: shaft and branches, then a head at each of their ends; u is its direction. The
    drawing is the same for all rows, and is turned and moved to each place."""
    drawing = F.array(*[F.array(*[g.point(F.lit(p.real), F.lit(p.imag)) for p in line]) for line in _glyph(size, ways)])
    placed = lambda p: g.point(tip["x"] + u["x"] * p["x"] - u["y"] * p["y"], tip["y"] + u["y"] * p["x"] + u["x"] * p["y"])
    return F.transform(drawing, lambda line: F.transform(line, placed))


def tried_wkt(text: Column) -> Column:
    """Points of a well-known text; null where it holds anything but pairs of numbers in brackets."""
    first = F.regexp_extract(text, r"^[A-Z ]+\(\(?([^()]*)\)?\)$", 1)
    number = lambda p, k: F.get(F.split(F.trim(p), r"\s+"), F.lit(k)).try_cast("double")
    points = F.transform(F.split(first, ","), lambda p: g.point(number(p, 0), number(p, 1)))
    return F.when(~F.exists(points, lambda p: p["x"].isNull() | p["y"].isNull()), points)


@F.pandas_udf(T.BinaryType())
def wkb(lines: pd.Series) -> pd.Series:
    """Lines as little-endian well-known binary."""

    def one(line) -> bytes | None:
        if line is None:
            return None
        flat = [c for p in line for c in (p["x"], p["y"])]
        return struct.pack(f"<BII{len(flat)}d", 1, 2, len(line), *flat)

    return lines.map(one)


@F.pandas_udf(LINE)
def from_wkb(texts: pd.Series) -> pd.Series:
    """The points of binary lines, of either byte order; null for any other kind."""

    def one(data):
        if data is None or len(data) < 9:
            return None
        order = "<" if data[0] == 1 else ">"
        kind, n = struct.unpack_from(order + "II", data, 1)
        if kind != 2 or len(data) != 9 + 16 * n:
            return None
        flat = struct.unpack_from(f"{order}{2 * n}d", data, 9)
        return [{"x": x, "y": y} for x, y in zip(flat[::2], flat[1::2], strict=True)]

    return texts.map(one)


def simplified(line: Column, tolerance: float) -> Column:
    """A line without the points that lie within the tolerance of what is left (farthest point first); a ring keeps four points, and
    one that would keep fewer stays as it is."""

    def keep(pts: list, ring: bool) -> list:
        used, open_ = {0, len(pts) - 1}, [(0, len(pts) - 1)]
        while open_:
            i, j = open_.pop()
            (ax, ay), (bx, by) = pts[i], pts[j]
            dx, dy = bx - ax, by - ay
            size, far, at = dx * dx + dy * dy, tolerance, None
            for k in range(i + 1, j):
                px, py = pts[k][0] - ax, pts[k][1] - ay
                f = min(1.0, max(0.0, (px * dx + py * dy) / size)) if size else 0.0
                d = math.hypot(px - f * dx, py - f * dy)
                if d > far:
                    far, at = d, k
            if at is not None:
                used.add(at)
                open_ += [(i, at), (at, j)]
        return [pts[k] for k in sorted(used)] if not ring or len(used) >= 4 else pts

    @F.pandas_udf(LINE)
    def of(lines: pd.Series) -> pd.Series:
        def one(line):
            if line is None or len(line) < 3:
                return line
            pts = [(p["x"], p["y"]) for p in line]
            return [{"x": x, "y": y} for x, y in keep(pts, pts[0] == pts[-1])]

        return lines.map(one)

    return of(line)
