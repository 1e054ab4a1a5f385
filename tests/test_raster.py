"""Runs of cells against sets of cells."""

import random

import pytest

from kerbline.operators import raster


def cells(df):
    rows = df.collect()
    out = [(r["i"], j) for r in rows for j in range(r["j0"], r["j1"] + 1)]
    assert len(out) == len(set(out)), "runs of a column don't overlap"
    return set(out)


def of_boxes(boxes, size):
    n = 400
    inside = lambda i, j: any(x0 <= (i + 0.5) * size < x1 and y0 <= (j + 0.5) * size < y1 for x0, y0, x1, y1 in boxes)
    return {(i, j) for i in range(-20, n // 8) for j in range(-20, n // 8) if inside(i, j)}


def disc(r):
    m = int(r)
    return [(a, b) for a in range(-m, m + 1) for b in range(-m, m + 1) if a * a + b * b <= r * r]


def shrunk(ground, r):
    return {(i, j) for i, j in ground if all((i + a, j + b) in ground for a, b in disc(r))}


def grown(ground, r):
    return {(i + a, j + b) for i, j in ground for a, b in disc(r)}


@pytest.fixture(scope="module")
def ground(spark):
    r = random.Random(4)
    boxes = [(x, y, x + r.uniform(0.1, 9), y + r.uniform(0.1, 7)) for x, y in ((r.uniform(-8, 30), r.uniform(-8, 30)) for _ in range(45))]
    boxes += [(0.0, 0.0, 12.0, 12.0), (5.0, 5.0, 5.0, 9.0), (3.0, 4.0, 1.0, 9.0)]
    df = spark.createDataFrame([*boxes, (None, 0.0, 1.0, 1.0)], "x0 double, y0 double, x1 double, y1 double")
    return raster.runs(df, 1.0).persist(), of_boxes(boxes, 1.0)


@pytest.mark.parametrize("r", [1.0, 2.5, 3.0])
def test_wider_and_narrower(ground, r):
    runs, want = ground
    assert cells(runs) == want
    assert cells(raster.dilated(runs, r)) == grown(want, r)
    assert cells(raster.eroded(runs, r)) == shrunk(want, r)
    assert cells(raster.opened(runs, r)) == grown(shrunk(want, r), r)


def test_parts_and_their_outlines(spark, ground):
    runs, all_ = ground
    houses = [(10.0, -3.0, 14.0, 30.0), (20.0, 2.0, 23.0, 9.0), (-4.0, 20.0, 30.0, 22.0)]
    built = raster.runs(spark.createDataFrame(houses, "x0 double, y0 double, x1 double, y1 double"), 1.0)
    taken = of_boxes(houses, 1.0)
    left = all_ - taken
    free = raster.subtracted(runs, built)
    assert cells(free) == left
    found = {r["part"]: r for r in raster.outlines(raster.parts(free), built).collect()}
    todo, want = set(left), []
    while todo:
        part, open_ = set(), [min(todo)]
        while open_:
            c = open_.pop()
            if c in todo:
                todo.remove(c)
                part.add(c)
                open_ += [(c[0] + a, c[1] + b) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))]
        sides = [(i + a, j + b) for i, j in part for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1)) if (i + a, j + b) not in part]
        want.append((len(part), len(sides), sum(c in taken for c in sides)))
    assert len(want) > 3
    assert sorted((r["cells"], r["outline"], r["along"]) for r in found.values()) == sorted(want)


def test_plazas(spark):
    kind = "x0 double, y0 double, x1 double, y1 double"
    # An open square with a lane that leaves it, between two houses; and an equal square in a park.
    ground = spark.createDataFrame([(0.0, 0.0, 12.0, 12.0), (12.0, 5.0, 30.0, 7.0), (100.0, 0.0, 112.0, 12.0)], kind)
    houses = spark.createDataFrame([(-5.0, -1.0, 0.0, 13.0), (0.0, 12.0, 12.0, 20.0)], kind)
    got = raster.plazas(raster.runs(ground, 1.0), raster.runs(houses, 1.0), 3.0, 100, 0.2).collect()
    square = {(i, j) for i in range(12) for j in range(12)}
    want = grown(shrunk(square | {(i, j) for i in range(12, 30) for j in (5, 6)}, 3.0), 3.0)
    assert [r["cells"] for r in got] == [len(want)] and not any(i > 12 for i, _ in want)
    sides = [(i + a, j + b) for i, j in want for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1)) if (i + a, j + b) not in want]
    along = sum((-5 <= i < 0 and -1 <= j < 13) or (0 <= i < 12 and 12 <= j < 20) for i, j in sides)
    assert (got[0]["outline"], got[0]["along"]) == (len(sides), along) and along / len(sides) >= 0.2


def test_no_ground(spark):
    none = raster.runs(spark.createDataFrame([], "x0 double, y0 double, x1 double, y1 double"), 1.0)
    assert raster.opened(none, 2.0).count() == 0 and raster.plazas(none, none, 2.0, 1, 0.0).count() == 0
