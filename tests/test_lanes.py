"""Lane links against plain walks, and orders of lanes against all alignments."""

import random
from itertools import combinations

from kerbline.operators import lanes


def cheapest(incoming, outgoing, miss):
    """All alignments of two sorted lists (t in millimetres, lane), by number of pairs: the best by cost, lanes alone, pairs."""
    found = []
    for n in range(min(len(incoming), len(outgoing)) + 1):
        for some in combinations(incoming, n):
            for others in combinations(outgoing, n):
                cost = sum(abs(a[0] - b[0]) for a, b in zip(some, others, strict=True)) + miss * (len(incoming) + len(outgoing) - 2 * n)
                found.append((cost, -n, [(a[1], b[1]) for a, b in zip(some, others, strict=True)]))
    return min(found)


def test_orders_against_all_alignments(spark):
    """Small whole offsets make many ties; some nodes have lanes on one side only, or lanes without a place."""
    r = random.Random(4)
    made = {side: [(node, 10 * k + (side == "out"), float(r.randint(0, 6)) if r.random() < 0.95 else None) for node in range(60) for k in range(r.randint(0, 5))] for side in ("in", "out")}
    made["in"] += [(None, 1, 1.0)]
    df = {side: spark.createDataFrame(rows, "node long, lane long, t double").repartition(5) for side, rows in made.items()}
    got = {}
    for x in lanes.order_links(df["in"], df["out"], "node", 1.0).collect():
        got.setdefault(x["node"], []).append((x["from_lane"], x["to_lane"]))
    for node in range(60):
        i, o = (sorted((round(t * 1000), lane) for n, lane, t in made[side] if n == node and t is not None) for side in ("in", "out"))
        links, place = got.pop(node, []), {lane: k for k, (_, lane) in enumerate(i + o)}
        assert links == cheapest(i, o, 1000)[2]
        assert all((place[a] < place[c]) == (place[b] < place[d]) for (a, b), (c, d) in combinations(links, 2))
    assert not got


def test_no_lanes(spark):
    none = spark.createDataFrame([], "node long, lane long, t double")
    assert lanes.order_links(none, none, "node", 1.0).count() == 0


def test_joints(spark):
    """Touch just enough and too short, other numbers and directions, null directions, a gap in the subsections, lanes against the axis."""
    rows = [(1, "s", 1, "forward", 1, 0.0, 3.0), (2, "s", 2, "forward", 1, 2.5, 5.5), (3, "s", 2, "forward", 2, 0.0, 3.0), (4, "s", 3, "forward", 1, 5.1, 8.0),
            (5, "s", 1, "backward", 1, -3.0, 0.0), (6, "s", 2, "backward", 1, -3.0, 0.0), (7, "s", 1, None, None, 9.0, 10.0), (8, "s", 2, None, None, 9.0, 10.0),
            (9, "t", 1, "forward", 1, 0.0, 3.0), (10, "t", 3, "forward", 1, 0.0, 3.0), (11, None, 1, "forward", 1, 0.0, 3.0), (12, None, 2, "forward", 1, 0.0, 3.0)]
    parts = spark.createDataFrame(rows, "part long, section string, k int, direction string, lane int, t0 double, t1 double")
    links = lanes.joint_links(parts)
    assert {(x["lane"], x["next"]) for x in links.collect()} == {(1, 2), (6, 5), (7, 8)}
    both = {x["lane"]: (x["before"], x["after"]) for x in lanes.neighbours(links.unionAll(links)).collect()}
    assert both == {1: ([], [2]), 2: ([1], []), 5: ([6], []), 6: ([], [5]), 7: ([], [8]), 8: ([7], [])}


def test_arms(spark):
    """Into and out of a junction at both ends of a section; another road, another junction and a short touch make no link."""
    ends = spark.createDataFrame([(1, "j", "a", "forward", 1), (2, "j", "a", "backward", 1), (3, "j", None, "forward", 0), (4, "j", "a", None, 0)], "part long, junction string, road string, direction string, end int")
    inner = spark.createDataFrame([(11, "j", "a"), (12, "j", "b"), (13, "j", None), (14, "k", "a")], "part long, junction string, road string")
    touching = spark.createDataFrame([(1, 11, 3.0), (1, 12, 3.0), (1, 14, 3.0), (2, 11, 0.5), (3, 13, 1.0), (4, 11, 0.49), (4, 13, 2.0)], "a long, b long, length double")
    assert {(x["lane"], x["next"]) for x in lanes.arm_links(ends, inner, touching).collect()} == {(1, 11), (11, 2), (13, 3)}


def test_turns_against_all_pairs(spark):
    r = random.Random(7)
    places = [(k % 40, r.uniform(0, 60), r.uniform(0, 60)) for k in range(200)]
    turns = [(k, *[r.uniform(-5, 65) for _ in range(4)]) for k in range(150)] + [(900, 1.0, 1.0, None, 2.0), (901, 1.0, 1.0, 1.0, 1.0)]
    got = lanes.turn_links(spark.createDataFrame(turns, "turn long, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(places, "lane long, x double, y double"), 3.0)
    want = set()
    for _, x0, y0, x1, y1 in turns:
        if x1 is not None:
            near = [min((((x - px) ** 2 + (y - py) ** 2) ** 0.5, lane) for lane, px, py in places) for x, y in ((x0, y0), (x1, y1))]
            if all(d <= 3 for d, _ in near) and near[0][1] != near[1][1]:
                want.add((near[0][1], near[1][1]))
    assert len(want) > 40
    assert {(x["lane"], x["next"]) for x in got.collect()} == want
