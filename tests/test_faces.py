"""Faces against a plain walk, and parts that lie in each other."""

import math
import random

import pytest

from kerbline.operators import faces
from kerbline.operators.pointers import followed


def network(spark, nodes, edges):
    n = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in nodes.items()], "node long, x double, y double")
    e = spark.createDataFrame([(k, a, b, k % 3) for k, (a, b) in enumerate(edges)], "edge long, source long, target long, street long")
    return faces.rings(faces.half_edges(e, n, "street"))


def walked(nodes, edges):
    """The rings as sets of (from, to), by turning right from the way back at each node."""
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set()).add(a)
    turn = {a: sorted(bs, key=lambda b: math.atan2(nodes[b][1] - nodes[a][1], nodes[b][0] - nodes[a][0])) for a, bs in out.items()}
    left, rings = {(a, b) for a in out for b in out[a]}, []
    while left:
        first = now = min(left)
        ring = []
        while now in left:
            left.remove(now)
            ring.append(now)
            a, b = now
            now = (b, turn[b][turn[b].index(a) - 1])
        assert now == first
        rings.append(ring)
    return rings


def area(nodes, ring):
    return sum(nodes[a][0] * nodes[b][1] - nodes[b][0] * nodes[a][1] for a, b in ring) / 2


def inside(nodes, ring, p):
    odd = False
    for a, b in ring:
        (ax, ay), (bx, by) = nodes[a], nodes[b]
        if (ay > p[1]) != (by > p[1]) and p[0] > ax + (bx - ax) / (by - ay) * (p[1] - ay):
            odd = not odd
    return odd


def brute(nodes, edges):
    """area, sides and holes of every face: an outline lies in the smallest face that holds its leftmost node and isn't of its part."""
    rings = walked(nodes, edges)
    inner = [r for r in rings if area(nodes, r) > 0]
    part = {n: n for n in nodes}

    def root(n):
        while part[n] != n:
            n = part[n]
        return n

    for a, b in edges:
        part[root(a)] = root(b)
    found = [[area(nodes, r), len(r), 0] for r in inner]
    for r in rings:
        if area(nodes, r) <= 0:
            p = min(nodes[a] for a, _ in r)
            holds = [k for k, f in enumerate(inner) if root(f[0][0]) != root(r[0][0]) and inside(nodes, f, (p[0] - 1e-7, p[1] + 1e-9))]
            if holds:
                k = min(holds, key=lambda k: area(nodes, inner[k]))
                found[k][0] += area(nodes, r)
                found[k][1] += len(r)
                found[k][2] += 1
    return sorted(map(tuple, found))


def square(x, y, size, first):
    nodes = {first: (x, y), first + 1: (x + size, y), first + 2: (x + size, y + size), first + 3: (x, y + size)}
    return nodes, [(first, first + 1), (first + 1, first + 2), (first + 2, first + 3), (first + 3, first)]


def made(spark, nodes, edges, cell):
    got = faces.faces(network(spark, nodes, edges), cell).collect()
    return sorted((r["area"], r["sides"], r["holes"]) for r in got)


@pytest.mark.parametrize("seed,keep", [(1, 0.85), (2, 0.45)])
def test_lattices_against_a_walk(spark, seed, keep):
    r, w = random.Random(seed), 14
    nodes = {i * w + j: (i * 10 + r.randint(0, 2), j * 10 + r.randint(0, 2)) for i in range(w) for j in range(w)}
    edges = [(k, k + s) for k in nodes for s, ok in ((1, k % w < w - 1), (w, k + w in nodes)) if ok and r.random() < keep]
    assert made(spark, nodes, edges, 7.0) == brute(nodes, edges)
    rings = faces.outlines(network(spark, nodes, edges)).collect()
    assert sorted((x["sides"], x["area"]) for x in rings) == sorted((len(x), area(nodes, x)) for x in walked(nodes, edges))


def test_parts_within_parts(spark):
    """Squares in squares, one beside another within the same face, a lone edge, and a hub of very many spokes."""
    nodes, edges = {}, []
    for x, y, size, first in ((0, 0, 100, 0), (10, 10, 60, 10), (20, 20, 20, 20), (50, 22, 10, 30), (200, 0, 10, 40), (74, 30, 6, 50), (84, 30, 6, 60)):
        n, e = square(x, y, size, first)
        nodes |= n
        edges += e
    nodes |= {70: (45, 60), 71: (47, 61), 80: (300, 300)}
    edges += [(70, 71)]
    for k in range(40):
        nodes[100 + k] = (300 + 50 * math.cos(k / 40 * 2 * math.pi), 300 + 50 * math.sin(k / 40 * 2 * math.pi))
        edges.append((80, 100 + k))
    edges += [(100 + k, 100 + (k + 1) % 40) for k in range(39)]
    for cell in (3.0, 1000.0):
        got, want = made(spark, nodes, edges, cell), brute(nodes, edges)
        assert [g[1:] for g in got] == [x[1:] for x in want]
        assert [g[0] for g in got] == pytest.approx([x[0] for x in want])


def test_edges_that_bound_nothing(spark):
    nodes = {1: (0, 0), 2: (4, 0), 3: (4, 4), 4: (0, 0)}
    edges = [(1, 2), (2, 3), (3, 1), (1, 4), (2, 2), (1, 99)]
    assert made(spark, nodes, edges, 2.0) == [(8.0, 3, 0)]
    assert made(spark, nodes, [(1, 2)], 2.0) == []
    assert made(spark, nodes, [(1, 99)], 2.0) == []


def test_sides_go_around_the_first_edge(spark):
    """A side that runs over the ring's least half-edge is one side; a ring of one street has one."""
    nodes, edges = square(0, 0, 10, 0)
    nodes |= {8: (5, 0)}
    streets = [7, 7, 8, 7, 7]
    path = [(8, 1), (1, 2), (2, 3), (3, 0), (0, 8)]
    n = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in nodes.items()], "node long, x double, y double")
    for of, want in ((streets, [(7, 4, 30.0), (8, 1, 10.0)]), ([7] * 5, [(7, 5, 40.0)]), ([None] * 5, [(None, 5, 40.0)])):
        e = spark.createDataFrame([(k, a, b, s) for k, ((a, b), s) in enumerate(zip(path, of, strict=True))], "edge long, source long, target long, street long")
        got = faces.sides(faces.rings(faces.half_edges(e, n, "street")), "street").collect()
        assert sorted(((r["street"], r["edges"], r["length"]) for r in got), key=str) == want


def test_pointers(spark):
    r = random.Random(3)
    ids = r.sample(range(1000), 400)
    step, at = {}, 0
    kinds = []
    while at < len(ids):
        n = min(r.choice([1, 2, 3, 40, 64, 97]), len(ids) - at)
        own, at = ids[at : at + n], at + n
        ring = r.random() < 0.5
        kinds.append((own, ring))
        step |= {a: b for a, b in zip(own, [*own[1:], own[0] if ring else None], strict=True)}
    df = spark.createDataFrame(list(step.items()), "id long, next long")
    got = {x["id"]: x for x in followed(df).collect()}
    for own, ring in kinds:
        for k, a in enumerate(own):
            assert got[a]["ring"] == ring
            if ring:
                assert got[a]["least"] == min(own)
            else:
                assert (got[a]["last"], got[a]["steps"], got[a]["least"]) == (own[-1], len(own) - 1 - k, min(own[k:]))
