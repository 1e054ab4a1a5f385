"""Nested numbers against a walk."""

import random
from collections import Counter

from kerbline.operators import pointers, series, store, trees


def walk(rows):
    """low and high of every node by a walk down from the roots."""
    ids = {i for i, _ in rows}
    below = {}
    for i, p in rows:
        below.setdefault(p if p in ids else None, []).append(i)
    out, n = {}, 0
    open_ = [(i, False) for i in sorted(below.get(None, []), reverse=True)]
    while open_:
        i, done = open_.pop()
        n += 1
        if done:
            out[i] = (out[i], n)
        else:
            out[i] = n
            open_ += [(i, True), *((c, False) for c in sorted(below.get(i, []), reverse=True))]
    return out


def test_forest_against_a_walk(spark):
    r = random.Random(1)
    rows = [(f"n{k}", None if k < 5 or r.random() < 0.05 else f"n{r.randrange(k)}" if r.random() < 0.5 else "n3") for k in range(1, 200)]
    rows += [("deep0", "n5"), *((f"deep{k}", f"deep{k - 1}") for k in range(1, 90)), ("lost", "nowhere")]
    # Two nodes that are each other's parent, and one below them.
    round_ = [("x", "y"), ("y", "x"), ("z", "x")]
    kinds = {i: "ab"[len(i) % 2] for i, _ in rows + round_}
    df = spark.createDataFrame([(i, p, kinds[i]) for i, p in rows + round_], "id string, parent string, sort string").repartition(5)
    placed = trees.nested(df).persist()
    got = {x["id"]: (x["low"], x["high"]) for x in placed.collect()}
    want = walk(rows)
    assert got == want
    lows = {i: low for i, (low, _) in want.items()}
    low, high = want["n3"]
    assert {x["id"] for x in trees.below(placed, low, high).collect()} == {i for i, v in lows.items() if low < v < high}
    parent = dict(rows)
    up, at = [], "deep89"
    while (at := parent.get(at)) in want:
        up.append(at)
    assert [x["id"] for x in trees.above(placed, lows["deep89"]).collect()] == up[::-1]
    counts = {(x["id"], x["kind"]): x["n"] for x in trees.counted_below(placed.join(df.select("id", "sort"), "id"), "sort").collect()}
    expected = Counter((i, kinds[j]) for i, (a, b) in want.items() for j, v in lows.items() if a < v < b)
    assert counts == dict(expected)


def test_no_tree(spark):
    none = spark.createDataFrame([], "id long, parent long")
    assert trees.nested(none).count() == 0
    one = spark.createDataFrame([(4, 4)], "id long, parent long")
    assert trees.nested(one).count() == 0


def test_rounds_grow_with_depth_and_not_with_nodes(spark, monkeypatch):
    cuts = []
    for module in (trees, series, pointers):
        monkeypatch.setattr(module, "cut", lambda df: cuts.append(1) or store.cut(df))
    rows = [(k, None if k == 0 else (k - 1) // 40) for k in range(3000)]
    got = {x["id"]: (x["low"], x["high"]) for x in trees.nested(spark.createDataFrame(rows, "id long, parent long")).collect()}
    assert got == walk(rows)
    # A way around all of them is 6,000 places long, 13 rounds.
    assert len(cuts) <= 10


def test_loops_of_joins_keep_plans_small(spark):
    now = spark.range(20).selectExpr("id", "(id + 1) % 20 AS next")
    for _ in range(12):
        now = store.cut(now.join(now.selectExpr("id AS next", "next AS then"), "next").selectExpr("id", "then AS next"))
    assert now.count() == 20
    # The guess of the size that joins and broadcasts go by.
    size = now._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert size < 1e9


def test_pointers_into_rings_and_lists(spark):
    r = random.Random(4)
    next_ = {k: (k + 1 if k < 40 else 0) for k in range(41)} | {k: k + 1 for k in range(100, 190)} | {190: None, 300: 300, 400: 999, 201: 202, 202: 203, 203: 7, 204: 150}
    rows = list(next_.items())
    r.shuffle(rows)
    got = {x["id"]: x for x in pointers.followed(spark.createDataFrame(rows, "id long, next long")).collect()}
    assert sorted(got) == sorted(next_)
    for k in next_:
        way, at = [k], next_[k]
        while at is not None and at not in way:
            way.append(at)
            at = next_.get(at)
        assert got[k]["ring"] == (at is not None), k
        assert got[k]["least"] == min(way), k
        if at is None:
            assert (got[k]["last"], got[k]["steps"]) == (way[-1], len(way) - 1)
