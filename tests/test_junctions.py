"""Junction groups on drawn fixtures and against plain loops."""

import math
import random

from kerbline.operators import graph, junctions


def frame(spark, rows, kind):
    return spark.createDataFrame(rows, kind)


def groups(spark, of):
    return frame(spark, list(of.items()), "node long, junction long")


EDGES = "edge long, source long, target long"


def test_contraction_keeps_its_edges(spark):
    r = random.Random(1)
    of = {n: r.randint(1, 4) for n in range(30)}
    rows = [(k, r.randint(0, 39), r.randint(0, 39)) for k in range(300)]
    got = {x["edge"]: (x["a"], x["b"], x["link"]) for x in junctions.contracted(frame(spark, rows, EDGES), groups(spark, of)).collect()}
    name = lambda n: of.get(n, -n - 1)
    least = {}
    for k, s, t in rows:
        least.setdefault(frozenset((name(s), name(t))), k)
    for k, s, t in rows:
        a, b = sorted((name(s), name(t)))
        assert got[k] == ((None, None, None) if a == b else (a, b, least[frozenset((a, b))]))


def test_rings(spark):
    rows = [(1, 1, 2), (2, 2, 3), (3, 3, 1), (4, 5, 6), (5, 6, 7), (6, 7, 5), (7, 7, 8), (8, 10, 11), (9, 20, 21), (10, 21, 20)]
    got = {x["edge"]: x["ring"] for x in junctions.rings(frame(spark, rows, EDGES)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 20, 10: 20}


def roundabout(spark):
    """A ring of four nodes, an entry with a splitter island near it, and a junction 60 m off that one group took in."""
    xy = {1: (10, 0), 2: (0, 10), 3: (-10, 0), 4: (0, -10), 5: (16, 2), 6: (70, 0), 7: (72, 4), 8: (70, 30), 9: (40, 0), 10: (0, 55), 11: (90, 0)}
    rows = [(1, 1, 2), (2, 2, 3), (3, 3, 4), (4, 4, 1), (5, 1, 5), (6, 5, 9), (7, 9, 6), (8, 6, 7), (9, 7, 8), (10, 6, 8), (11, 6, 11), (12, 2, 10)]
    of = {n: 100 for n in (1, 2, 3, 4, 5, 6, 7, 9, 10)} | {8: 200}
    return frame(spark, [(n, float(x), float(y)) for n, (x, y) in xy.items()], "node long, x double, y double"), frame(spark, rows, EDGES), groups(spark, of)


def test_groups_are_cut_back_to_their_ring(spark):
    nodes, edges, of = roundabout(spark)
    ring = frame(spark, [(k,) for k in (1, 2, 3, 4)], "edge long")
    got = {x["node"]: x["junction"] for x in junctions.split_around_rings(of, nodes, edges, ring, 15.0).collect()}
    # 5 lies 6 m from the ring and stays; 6, 7 and 9 hang together, 6 with three edges: one junction; 10 is a mere end and stays.
    assert got == {1: 100, 2: 100, 3: 100, 4: 100, 5: 100, 6: -7, 7: -7, 9: -7, 10: 100, 8: 200}
    none = frame(spark, [], "edge long")
    assert {x["junction"] for x in junctions.split_around_rings(of, nodes, edges, none, 15.0).collect()} == {100, 200}


def test_crossings_of_divided_roads(spark):
    r = random.Random(2)
    of = {n: n + 100 for n in range(60)}
    rows = [(k, r.randrange(60), r.randrange(60), r.choice([5.0, 12.0, 25.0])) for k in range(50)]
    travel = [(r.randrange(60), r.randrange(70), r.choice([0.0, 90.0, 180.0, 270.0, 36.8, 36.9, r.uniform(-400, 400)])) for _ in range(90)]
    # A hub: very many headings at both ends of one link, the closest to opposite just inside the bound.
    rows.append((500, 1, 2, 3.0))
    travel += [(1, 1000 + k, 10.0 + k % 7 / 10) for k in range(400)] + [(2, 3000 + k, 153.6 + k % 5 / 100) for k in range(400)]
    never = {103, 104}
    got = junctions.divided_crossings(groups(spark, of), frame(spark, rows, f"{EDGES}, length double"), frame(spark, travel, "node long, edge long, heading double"), 20.0, frame(spark, [(k,) for k in never], "junction long"))
    parent = {j: j for j in of.values()}

    def root(j):
        while parent[j] != j:
            j = parent[j]
        return j

    for k, s, t, length in rows:
        a, b = of[s], of[t]
        if a == b or length >= 20 or {a, b} & never:
            continue
        ra, rb = ([h for n, e, h in travel if n == end and e != k] for end in (s, t))
        if any(math.cos(math.radians(x - y)) < -0.8 for x in ra for y in rb):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    assert {x["node"]: x["junction"] for x in got.collect()} == {n: root(j) for n, j in of.items()}


def dual_carriageway(spark):
    """Two halves between two crossings; a side street joins the upper half only, at node 3."""
    xy = {1: (0, 10), 2: (0, 0), 3: (50, 10), 4: (49, 0), 5: (100, 10), 6: (100, 0), 7: (50, 60), 8: (0, 50), 9: (0, -50), 10: (100, 50), 11: (100, -50)}
    rows = [(1, 1, 3, 70), (2, 3, 5, 71), (3, 2, 4, 80), (4, 4, 6, 80), (5, 3, 7, 90), (6, 1, 2, 91), (7, 5, 6, 92), (8, 1, 8, 91), (9, 2, 9, 91), (10, 5, 10, 92), (11, 6, 11, 92)]
    nodes = frame(spark, [(n, float(x), float(y)) for n, (x, y) in xy.items()], "node long, x double, y double")
    return nodes, frame(spark, rows, f"{EDGES}, way long"), frame(spark, [(1, 3), (2, 4)], "one long, two long")


def test_two_halves_are_one_section(spark):
    nodes, edges, pairs = dual_carriageway(spark)
    forced = {(x["node"], x["other"]): x["forced"] for x in junctions.forced_junctions(pairs, edges, nodes, 40.0).collect()}
    assert forced == {(1, 2): False, (2, 1): False, (3, 4): True, (5, 6): False, (6, 5): False}
    assert junctions.forced_junctions(pairs, edges, nodes, 5.0).count() == 0
    # Crossings on both halves are one group each, and so is the side street's with the node that it forced.
    of = {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5}
    plain = frame(spark, [(n,) for n in (7, 8, 9, 10, 11)], "node long")
    chains = graph.streets(edges.select("edge", "source", "target").selectExpr("*", "1 AS one"), ["one"], plain)
    got = {x["edge"]: x["section"] for x in junctions.same_ends(chains, edges, groups(spark, of), pairs).collect()}
    assert got[1] == got[3] == 1 and got[2] == got[4] == 2 and got[5] == 5 and got[6] == 6
    # Without the forced node the lower half is one chain from end to end, which has other ends than each part of the upper one.
    joined = frame(spark, [(n,) for n in (4, 7, 8, 9, 10, 11)], "node long")
    chains = graph.streets(edges.select("edge", "source", "target").selectExpr("*", "1 AS one"), ["one"], joined)
    got = {x["edge"]: x["section"] for x in junctions.same_ends(chains, edges, groups(spark, of), pairs).collect()}
    assert got[3] == got[4] == 3 and got[1] == 1 and got[2] == 2


def test_ways_that_reach_the_node_force_nothing(spark):
    nodes, edges, pairs = dual_carriageway(spark)
    joined = edges.unionByName(frame(spark, [(12, 3, 4, 80)], f"{EDGES}, way long"))
    got = {(x["node"], x["other"]) for x in junctions.forced_junctions(pairs, joined, nodes, 40.0).collect()}
    assert (3, 4) not in got and (4, 3) in got
