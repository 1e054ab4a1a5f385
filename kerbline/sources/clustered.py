"""Tables of points that lie on disk in the order of a Hilbert curve, so that a box reads few files and few of their row groups.

The extent is divided into 2^BITS x 2^BITS cells, numbered along the curve. Rows are written in that order, in a folder for each tile (a
run of cells). A box becomes ranges of numbers: whole tiles are left out by their folder, row groups by the least and most number in them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 16
CELL, TILE = "hilbert", "tile"


def along(x: int, y: int, bits: int) -> int:
    """The number of a cell along the curve through 2^bits x 2^bits cells."""
    d = 0
    for k in range(bits - 1, -1, -1):
        right, up = x >> k & 1, y >> k & 1
        d = d * 4 + (3 * right ^ up)
        if not up:
            if right:
                x, y = ~x, ~y
            x, y = y, x
    return d


def along_column(x: Column, y: Column, bits: int = BITS) -> Column:
    """`along` of columns of whole numbers."""

    def step(at: Column, k: Column) -> Column:
        right, up = F.getbit(at["x"], k).cast("long"), F.getbit(at["y"], k).cast("long")
        turned = (up == 0) & (right == 1)
        flip = lambda c: F.when(turned, F.bitwise_not(at[c])).otherwise(at[c])
        swap = lambda one, other: F.when(up == 0, flip(other)).otherwise(flip(one))
        return F.struct(swap("x", "y").alias("x"), swap("y", "x").alias("y"), (at["d"] * 4 + (3 * right).bitwiseXOR(up)).alias("d"))

    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))
    number = F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step)["d"]
    return F.when(x.isNotNull() & y.isNotNull(), number)


@dataclass(frozen=True)
class Grid:
    """The extent of a table and its 4^tile_level tiles. Points outside belong to the nearest cell at the border, so any extent gives right
    results; one that fits the data reads least."""

    x0: float
    y0: float
    x1: float
    y1: float
    tile_level: int = 3

    def __post_init__(self):
        if not (self.x0 < self.x1 and self.y0 < self.y1 and 0 <= self.tile_level <= BITS):
            raise ValueError("a grid needs an extent and a tile level from 0 to BITS")

    def cell(self, x: float, y: float) -> tuple[int, int]:
        most = float(2**BITS - 1)
        at = lambda v, low, high: int(max(min((v - low) / (high - low) * 2**BITS, most), 0.0))
        return at(x, self.x0, self.x1), at(y, self.y0, self.y1)

    def number(self, x: Column, y: Column) -> Column:
        """The number of the cell of a point, null where a coordinate is."""
        most = F.lit(float(2**BITS - 1))
        # least and greatest would leave a null out.
        at = lambda v, low, high: F.when(v.isNotNull(), F.floor(F.greatest(F.least((v - low) / (high - low) * 2**BITS, most), F.lit(0.0))))
        return along_column(at(x, self.x0, self.x1), at(y, self.y0, self.y1))

    def ranges(self, box: tuple[float, float, float, float], most: int = 32) -> list[tuple[int, int]]:
        """At most `most` (4 or more) ranges of numbers, both ends included, in order, that hold all cells of a box (x0, y0, x1, y1).
        Squares that the box cuts are divided until more would be too many; what they then hold too much is left to the scan."""
        (cx0, cy0), (cx1, cy1) = self.cell(*box[:2]), self.cell(*box[2:])
        whole, border, level = [], [(0, 0)], BITS
        while border:
            parts = [(2 * x + i, 2 * y + j) for x, y in border for i in (0, 1) for j in (0, 1)] if level < BITS else border
            side = 2**level
            cut = []
            inside = []
            for x, y in parts:
                if x * side <= cx1 and (x + 1) * side > cx0 and y * side <= cy1 and (y + 1) * side > cy0:
                    held = x * side >= cx0 and (x + 1) * side - 1 <= cx1 and y * side >= cy0 and (y + 1) * side - 1 <= cy1
                    (inside if held or level == 0 else cut).append((x, y))
            found = self._joined(whole + [self._range(x, y, level) for x, y in inside + cut])
            if level < BITS and len(found) > most:
                whole += [self._range(x, y, level + 1) for x, y in border]
                break
            whole += [self._range(x, y, level) for x, y in inside]
            border, level = cut, level - 1
        return self._joined(whole)

    @staticmethod
    def _range(x: int, y: int, level: int) -> tuple[int, int]:
        first = along(x, y, BITS - level) << 2 * level
        return first, first + (1 << 2 * level) - 1

    @staticmethod
    def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for low, high in sorted(ranges):
            if out and low <= out[-1][1] + 1:
                out[-1] = out[-1][0], max(high, out[-1][1])
            else:
                out.append((low, high))
        return out


def write(df: DataFrame, grid: Grid, path: str, most_rows: int = 0) -> None:
    """A table with x and y, clustered; at most `most_rows` in a file if given. Its columns must not be called CELL or TILE. Rows of one cell
    are dealt to tasks by their other columns, so a crowded place is no single task; rows without a place lie in a folder of their own."""
    if {CELL, TILE} & {c.lower() for c in df.columns}:
        raise ValueError(f"the columns {CELL} and {TILE} are made here")
    placed = df.withColumn(CELL, grid.number(F.col("x"), F.col("y"))).withColumn(TILE, F.shiftright(CELL, 2 * (BITS - grid.tile_level)))
    hashed = [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]  # maps have no hash
    dealt = placed.repartitionByRange(CELL, F.xxhash64(*hashed)).sortWithinPartitions(TILE, CELL)
    dealt.write.option("maxRecordsPerFile", most_rows).partitionBy(TILE).parquet(path)


def in_box(df: DataFrame, grid: Grid, box: tuple[float, float, float, float], most: int = 32) -> DataFrame:
    """Rows of a clustered table, read with `spark.read.parquet`, whose x and y lie in a box (x0, y0, x1, y1), borders included. The tiles
    reach the scan as partition filters, the ranges as pushed filters on row groups. A box that is turned around holds no row."""
    x0, y0, x1, y1 = box
    exact = F.col("x").between(x0, x1) & F.col("y").between(y0, y1)
    if not (x0 <= x1 and y0 <= y1):
        return df.filter(F.lit(False)).drop(CELL, TILE)
    found = grid.ranges(box, most)
    shift = 2 * (BITS - grid.tile_level)
    tiles, cells = F.lit(False), F.lit(False)
    for low, high in found:
        tiles = tiles | F.col(TILE).between(low >> shift, high >> shift)
        cells = cells | F.col(CELL).between(low, high)
    return df.filter(tiles).filter(cells).filter(exact).drop(CELL, TILE)
