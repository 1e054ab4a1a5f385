"""Pieces of overlapping boxes against a grid of all their coordinates."""

import random
from itertools import pairwise

import pytest

from kerbline.operators import overlay

KIND = "g string, rank int, id long, x0 double, y0 double, x1 double, y1 double"


def brute(boxes):
    """Owner by cell of the grid of all coordinates: (x0, y0, x1, y1) to id."""
    xs, ys = sorted({v for b in boxes for v in (b[3], b[5])}), sorted({v for b in boxes for v in (b[4], b[6])})
    out = {}
    for x0, x1 in pairwise(xs):
        for y0, y1 in pairwise(ys):
            over = [(b[1], b[2]) for b in boxes if b[3] <= x0 and b[5] >= x1 and b[4] <= y0 and b[6] >= y1]
            if over:
                out[x0, y0, x1, y1] = min(over)[1]
    return out


def areas(cells):
    out = {}
    for (x0, y0, x1, y1), k in cells.items():
        out[k] = out.get(k, 0) + (x1 - x0) * (y1 - y0)
    return out


def borders(cells):
    out = {}
    items = list(cells.items())
    for (a0, b0, a1, b1), k in items:
        for (c0, d0, c1, d1), m in items:
            if k != m:
                edge = (min(b1, d1) - max(b0, d0)) if a1 == c0 else (min(a1, c1) - max(a0, c0)) if b1 == d0 else 0
                if edge > 0:
                    out[min(k, m), max(k, m)] = out.get((min(k, m), max(k, m)), 0) + edge
    return out


@pytest.fixture(params=[(2, 2)])
def bounds(request, monkeypatch):
    monkeypatch.setattr(overlay, "SPLIT", request.param[0])
    monkeypatch.setattr(overlay, "MOST_PIECES", request.param[1])


def test_random_boxes(spark, bounds):
    r = random.Random(1)
    boxes = []
    for k in range(30):
        x, y = r.uniform(-5, 5), r.choice([0.1, 1 / 3, 2.5, r.uniform(-5, 5)])
        boxes.append(("a", r.randint(0, 3), k, x, y, x + r.choice([1e-9, 0.7, 6.0]), y + r.choice([0.2, 4.0])))
    df = spark.createDataFrame(boxes, KIND)
    cells = brute(boxes)
    want = areas(cells)
    assert {x["id"]: x["area"] for x in overlay.claimed(df).collect()} == {b[2]: pytest.approx(want.get(b[2], 0.0)) for b in boxes}
    got = {(x["one"], x["two"]): x["edge"] for x in overlay.neighbours(overlay.owned(df), 1.5).collect()}
    assert got == {k: pytest.approx(v) for k, v in borders(cells).items()}
    assert overlay.union_area(df, ["g"]).first()["area"] == pytest.approx(sum(want.values()))


def test_groups_stay_apart(spark, bounds):
    boxes = [(g, 0, k, k * 0.5, 0.0, k * 0.5 + 1, 1.0) for k in range(40) for g in (["a", "b"] if k < 20 else ["b"])] + [(None, 0, 1, 0.0, 0.0, 2.0, 3.0)]
    got = {r["g"]: r["area"] for r in overlay.union_area(spark.createDataFrame(boxes, KIND), ["g"]).collect()}
    assert got == {"a": pytest.approx(10.5), "b": pytest.approx(20.5), None: 6.0}


def test_copies_and_one_corner(spark):
    """A thousand copies, and a thousand boxes that share a corner, each within the next."""
    boxes = [("a", 0, k, 7.0, 7.0, 8.0, 8.0) for k in range(1000)] + [("a", 0, 5000 + k, 0.0, 0.0, 1 + k / 1000, 1 + k / 1000) for k in range(1000)]
    got = {r["id"]: r["area"] for r in overlay.claimed(spark.createDataFrame(boxes, KIND)).collect()}
    assert got[0] == 1.0 and all(got[k] == 0 for k in range(1, 1000)) and got[5000] == 1.0
    assert sum(got.values()) == pytest.approx(1 + 1.999**2)


def test_no_ground(spark):
    boxes = [("a", 0, 1, 1.0, 1.0, 1.0, 5.0), ("a", 0, 2, None, 0.0, 1.0, 1.0), ("a", 0, 3, 2.0, 2.0, 1.0, 1.0)]
    df = spark.createDataFrame(boxes, KIND)
    assert {r["id"]: r["area"] for r in overlay.claimed(df).collect()} == {1: 0.0, 2: 0.0, 3: 0.0}
    assert overlay.union_area(df, ["g"]).count() == 0 and overlay.owned(df.limit(0), ["g"]).count() == 0


def test_slivers(spark):
    boxes = [("a", 0, 1, 0.0, 0.0, 10.0, 10.0), ("a", 1, 2, 9.5, 0.0, 10.2, 10.0), ("a", 2, 3, 10.0, 0.0, 14.0, 9.0), ("a", 3, 4, 20.0, 0.0, 20.1, 1.0)]
    got = overlay.slivers_joined(overlay.owned(spark.createDataFrame(boxes, KIND)), 3.0, 2.0).collect()
    assert [(r["id"], r["into"]) for r in got] == [(2, 1)]  # 10 along box 1, 9 along box 3; box 4 has no neighbour


def test_hidden_parts_are_not_passed_on(spark, monkeypatch):
    """Thousands of boxes over one another: rows written stay near the boxes, whatever they are cut into."""
    r = random.Random(2)
    boxes = [(g, 0, k, x, y, x + r.uniform(1, 2), y + r.uniform(1, 2)) for k in range(4000) for g, x, y in [(r.choice("ab"), r.uniform(0, 10), r.uniform(0, 10))]]
    rows, kept = [], overlay.cut

    def counted(df):
        out = kept(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(overlay, "cut", counted)
    got = {x["g"]: x["area"] for x in overlay.union_area(spark.createDataFrame(boxes, KIND), ["g"]).collect()}
    for g in "ab":
        own, want = [b for b in boxes if b[0] == g], 0.0
        for y0, y1 in pairwise(sorted({v for b in own for v in (b[4], b[6])})):
            end = float("-inf")
            for x0, x1 in sorted((b[3], b[5]) for b in own if b[4] <= y0 and b[6] >= y1):
                want += max(0.0, x1 - max(x0, end)) * (y1 - y0)
                end = max(end, x1)
        assert got[g] == pytest.approx(want)
    assert sum(rows) < 4 * len(boxes), rows
