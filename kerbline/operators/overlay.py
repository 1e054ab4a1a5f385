"""Union, precedence and borders of boxes with any coordinates, exactly: rows grow with the boxes, not with the ground they cover.

Boxes are cut at tiles that are divided further only where more than a few different pieces meet. In a tile equal pieces are one,
and whatever comes after a piece that fills the tile is hidden and goes no further, so a tile that is divided passes on the edges
that cross it and one filling piece at most. In the tiles that remain, the pieces' own coordinates are the lines of a small grid,
each cell of which goes to the first piece that covers it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.operators.store import cut

#: Parts of a divided tile's side, and pieces that may meet in a tile that isn't divided.
SPLIT = 8
MOST_PIECES = 16
#: Divisions at which tiles are as narrow as coordinates can tell apart; no tile is divided further.
DEEPEST = 16
#: Tiles whose figures are broadcast.
MOST_BROADCAST = 100_000
_TILE = ["g", "ix", "iy"]
_BOX = ["x0", "y0", "x1", "y1"]


def _divided(pieces: DataFrame, low: tuple[float, float], width: float, parts: int | None = None) -> DataFrame:
    """The pieces of tiles of this width, cut at the tiles they divide into: parts (SPLIT) on each side."""
    parts = parts or SPLIT
    part = width / parts
    for c, at in (("x", low[0]), ("y", low[1])):
        own = F.col(f"i{c}") * parts
        # One more on either side than the quotients say, as those are rounded; what has no width goes.
        first = F.greatest(own, F.floor((F.col(f"{c}0") - at) / part) - 1)
        last = F.least(own + (parts - 1), F.floor((F.col(f"{c}1") - at) / part) + 1)
        pieces = pieces.withColumn(f"i{c}", F.explode(F.sequence(first, last)))
        begin, end = at + F.col(f"i{c}") * part, at + (F.col(f"i{c}") + 1) * part
        pieces = pieces.withColumns({f"{c}0": F.greatest(f"{c}0", begin), f"{c}1": F.least(f"{c}1", end)}).filter(f"{c}1 > {c}0")
    return pieces


def _cells(tiles: DataFrame) -> DataFrame:
    """g, o, x0, y0, x1, y1: the cells of each tile's own grid with the first piece that covers them."""
    lines = lambda *names: F.array_sort(F.array_distinct(F.flatten(F.array(*[F.transform("pieces", lambda p: p[n]) for n in names]))))  # noqa: B023, E731
    t = tiles.select("g", "pieces", lines("x0", "x1").alias("xs"), lines("y0", "y1").alias("ys"))
    spans = lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.struct(F.element_at(c, i).alias("a"), F.element_at(c, i + 1).alias("b")))
    columns = t.select("g", "ys", F.explode(spans("xs")).alias("x"), "pieces")
    columns = columns.select("g", "ys", "x", F.expr("filter(pieces, p -> p.x0 <= x.a AND p.x1 >= x.b)").alias("pieces"))
    cells = columns.select("g", "x", "pieces", F.explode(spans("ys")).alias("y"))
    first = F.expr("array_min(transform(filter(pieces, p -> p.y0 <= y.a AND p.y1 >= y.b), p -> p.o))")
    return cells.select("g", first.alias("o"), *[F.col(c).alias(n) for n, c in zip(_BOX, ("x.a", "y.a", "x.b", "y.b"), strict=True)]).filter("o IS NOT NULL")


def owned(boxes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, id, x0, y0, x1, y1: pieces that don't overlap and together cover what the boxes (by, rank, id, x0, y0, x1, y1) of a group
    cover, each with its owner: the box of least rank, then least id. Boxes without area own nothing."""
    group = F.struct(*by) if by else F.lit(0)
    order = F.struct("rank", "id")
    pieces = boxes.select(group.alias("g"), order.alias("o"), *[F.col(c).cast("double").alias(c) for c in _BOX]).filter("x1 > x0 AND y1 > y0")
    low_x, low_y, high_x, high_y = pieces.agg(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).first()
    if low_x is None:
        return boxes.select(*by, "id", *[F.col(c).cast("double").alias(c) for c in _BOX]).limit(0)
    low, width = (low_x, low_y), 2.0 ** math.ceil(math.log2(max(high_x - low_x, high_y - low_y)))
    pieces = pieces.withColumns({"ix": F.lit(0).cast("long"), "iy": F.lit(0).cast("long")})
    done = []
    for depth in range(DEEPEST + 1):
        begins = {c: at + F.col(f"i{c}") * width for c, at in (("x", low[0]), ("y", low[1]))}
        fills = reduce(Column.__and__, [(F.col(f"{c}0") <= begins[c]) & (F.col(f"{c}1") >= at + (F.col(f"i{c}") + 1) * width) for c, at in (("x", low[0]), ("y", low[1]))])
        pieces = cut(pieces.groupBy(*_TILE, *_BOX).agg(F.min("o").alias("o")).withColumn("fills", fills))
        tiles = cut(pieces.groupBy(*_TILE).agg(F.count("*").alias("n"), F.min(F.when(F.col("fills"), F.col("o"))).alias("top")))
        known = F.broadcast(tiles) if tiles.count() <= MOST_BROADCAST else tiles
        seen = pieces.join(known, _TILE).filter(F.col("top").isNull() | (F.col("o") <= F.col("top")))
        enough = F.col("n") <= MOST_PIECES if depth < DEEPEST else F.lit(True)
        # A tile's pieces are few here, or as few as coordinates allow.
        done.append(seen.filter(enough).groupBy(*_TILE).agg(F.collect_list(F.struct("o", *_BOX)).alias("pieces")).select("g", "pieces"))
        if depth == DEEPEST or tiles.filter(F.col("n") > MOST_PIECES).isEmpty():
            break
        pieces = _divided(seen.filter(~enough).select(*_TILE, "o", *_BOX), low, width)
        width /= SPLIT
    made = _cells(reduce(DataFrame.unionAll, done))
    return made.select(*[F.col(f"g.{c}").alias(c) for c in by], F.col("o.id").alias("id"), *_BOX)


def area() -> Column:
    return F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))


def _filled(low: tuple[float, float], width: float) -> Column:
    """Bits of the parts of its tile that a piece fills: the part at (i, j) has bit j * SPLIT + i. SPLIT is 8 at most."""
    part = width / SPLIT
    begins = lambda c, at, i: at + (F.col(f"i{c}") * SPLIT + i) * part
    fills = lambda c, at, i: (F.col(f"{c}0") <= begins(c, at, i)) & (F.col(f"{c}1") >= begins(c, at, i + 1))
    of = lambda bits: reduce(Column.bitwiseOR, bits)
    row = of([F.when(fills("x", low[0], i), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(SPLIT)])
    return of([F.when(fills("y", low[1], j), F.shiftleft(row, SPLIT * j)).otherwise(F.lit(0).cast("long")) for j in range(SPLIT)])


def union_area(boxes: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, area: what the boxes of a group cover together.

    Tiles are divided as in `owned`, but as no owner is asked for, a part that one piece fills is done: what fills it is told from the
    tile's pieces before they are cut, and none is passed on to it. So what is passed on are pieces of parts that none fills, and the
    more boxes lie over one another, the fewer these are. The first tiles are about as wide as the boxes."""
    group = F.struct(*by) if by else F.lit(0)
    real = boxes.select(group.alias("g"), *[F.col(c).cast("double").alias(c) for c in _BOX]).filter("x1 > x0 AND y1 > y0")
    # Of boxes that share a corner and a side, the longest.
    real = cut(real.groupBy("g", "x0", "y0", "y1").agg(F.max("x1").alias("x1")).select("g", *_BOX))
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    low_x, low_y, high_x, high_y, n, sides, ground = real.agg(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1"), F.count("*"), F.sum(w + h), F.sum(w * h)).first()
    if low_x is None:
        return boxes.select(*by, F.lit(0.0).alias("area")).limit(0)
    low, whole = (low_x, low_y), 2.0 ** math.ceil(math.log2(max(high_x - low_x, high_y - low_y)))
    # Halved while boxes are cut in two at most on average, and tiles would hold many.
    width, least = whole, whole / SPLIT**DEEPEST
    while width > least and ground / (width / 2) ** 2 + sides / (width / 2) <= n and (whole / width) ** 2 * MOST_PIECES < n:
        width /= 2
    pieces = _divided(real.withColumns({"ix": F.lit(0).cast("long"), "iy": F.lit(0).cast("long")}), low, whole, int(whole / width))
    done, areas = [], []
    while True:
        # No piece is shuffled for these figures: they are added up before.
        tiles = cut(pieces.withColumn("filled", _filled(low, width)).groupBy(*_TILE).agg(F.count("*").alias("n"), F.bit_or("filled").alias("filled")))
        known = F.broadcast(tiles) if tiles.count() <= MOST_BROADCAST else tiles
        seen = pieces.join(known, _TILE)
        enough = F.col("n") <= MOST_PIECES if width > least else F.lit(True)
        done.append(seen.filter(enough).groupBy(*_TILE).agg(F.collect_list(F.struct(F.lit(0).alias("o"), *_BOX)).alias("pieces")).select("g", "pieces"))
        more = tiles.filter(F.col("n") > MOST_PIECES)
        if width <= least or more.isEmpty():
            break
        areas.append(more.select("g", (F.bit_count("filled") * (width / SPLIT) ** 2).alias("area")).filter("area > 0"))
        parts = _divided(seen.filter(~enough).select(*_TILE, *_BOX, "filled"), low, width)
        place = (F.col("iy") % SPLIT * SPLIT + F.col("ix") % SPLIT).cast("int")
        open_ = F.call_function("shiftright", "filled", place).bitwiseAND(F.lit(1)) == 0
        pieces = cut(parts.filter(open_).select(*_TILE, *_BOX).distinct())
        width /= SPLIT
    areas.append(_cells(reduce(DataFrame.unionAll, done)).select("g", ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area")))
    return reduce(DataFrame.unionAll, areas).groupBy("g").agg(F.sum("area").alias("area")).select(*[F.col(f"g.{c}").alias(c) for c in by], "area")


def claimed(boxes: DataFrame) -> DataFrame:
    """id, area: what each claim keeps; claims that keep nothing have 0."""
    kept = owned(boxes).groupBy("id").agg(area().alias("area"))
    return boxes.select("id").join(kept, "id", "left").select("id", F.coalesce("area", F.lit(0.0)).alias("area"))


def neighbours(pieces: DataFrame, cell: float) -> DataFrame:
    """one, two, edge: length of the border between two owners of pieces (id, x0, y0, x1, y1) that don't overlap. A border lies where
    one piece ends and another begins on the same line; lines are looked at in stretches of the cell's length."""

    def borders(c: str, d: str) -> DataFrame:
        """Borders at lines of coordinate c, running along d."""

        def ends(at: str, name: str) -> DataFrame:
            stretch = F.explode(F.sequence(F.floor(F.col(f"{d}0") / cell), F.floor(F.col(f"{d}1") / cell))).alias("stretch")
            return pieces.select(F.col(at).alias("line"), F.col(f"{d}0").alias(f"{name}0"), F.col(f"{d}1").alias(f"{name}1"), F.col("id").alias(name), stretch)

        both = ends(f"{c}1", "a").join(ends(f"{c}0", "b"), ["line", "stretch"]).filter("a <> b")
        low, high = F.greatest("a0", "b0"), F.least("a1", "b1")
        # Each meeting once: in the stretch where it begins.
        return both.filter((high > low) & (F.col("stretch") == F.floor(low / cell))).select("a", "b", (high - low).alias("d"))

    both = borders("x", "y").unionAll(borders("y", "x"))
    return both.groupBy(F.least("a", "b").alias("one"), F.greatest("a", "b").alias("two")).agg(F.sum("d").alias("edge"))


def slivers_joined(pieces: DataFrame, least: float, cell: float) -> DataFrame:
    """id, into: owners of less than some area and the neighbour with the longest border (ties: least id) that takes them."""
    small = pieces.groupBy("id").agg(area().alias("area")).filter(F.col("area") < least).select("id")
    n = neighbours(pieces, cell)
    both = n.unionAll(n.select(F.col("two").alias("one"), F.col("one").alias("two"), "edge")).join(small, F.col("one") == F.col("id"))
    # Borders are sums in no fixed order.
    return both.groupBy("id").agg(F.max_by("two", F.struct(F.round("edge", 6), -F.col("two"))).alias("into"))
