"""Section cuts against one walk per section."""

import random

from kerbline.operators import cuts
from kerbline.operators.pointers import reached


def walk(length, at, least, priority):
    """at: s to kinds. The kept cuts with their kinds."""
    kept = []
    for s in sorted(at):
        if s >= least and s + least <= length and (not kept or kept[-1][0] + least <= s):
            kept.append((s, min(at[s], key=priority.index)))
    return kept


def upper(values):
    return sorted(values)[len(values) // 2]


def test_ranges_against_a_walk(spark):
    """One section holds most positions; some lie at one place, at the least distance, or outside; one section has none."""
    r, priority = random.Random(1), ["b", "a", "c"]
    lengths = {1: 400.0, 2: 50.0, 3: 7.0, 4: 20.0}
    rows = [(1, float(r.randint(0, 800)) / 2, r.choice("abc")) for _ in range(500)] + [(2, s, k) for s, k in [(10.0, "c"), (10.0, "a"), (15.0, "b"), (45.0, "a"), (45.5, "a"), (-3.0, "b"), (99.0, "c")]] + [(3, 3.5, "a"), (9, 5.0, "a"), (2, None, "a")]
    sections = spark.createDataFrame(list(lengths.items()), "section long, length double")
    kept = cuts.kept_cuts(sections, spark.createDataFrame(rows, "section long, s double, kind string").repartition(7), 5.0, priority)
    found = cuts.ranges(sections, kept)
    samples = [(1 + k % 4, (k * 37 % 800) / 2, None if k % 3 == 0 else k * 13 % 101) for k in range(400)] + [(2, s, 5) for s in (10.0, 15.0, 0.0, 50.0)]
    made = cuts.described(found, spark.createDataFrame(samples, "section long, s double, v long"), ["v"]).collect()
    got = {(x["section"], x["k"]): (x["s0"], x["s1"], x["starts_at"], x["v"]) for x in made}
    want = {}
    for key, length in lengths.items():
        at = {}
        for section, s, kind in rows:
            if section == key and s is not None:
                at.setdefault(s, set()).add(kind)
        own = [(0.0, "section end"), *walk(length, at, 5.0, priority)]
        for k, ((s0, kind), s1) in enumerate(zip(own, [*[s for s, _ in own[1:]], length], strict=True), 1):
            # Samples beyond a section's length lie in its last range here.
            inside = [v for section, s, v in samples if section == key and s0 <= s and (s <= s1 or s1 == length)]
            values = [v for v in inside if v is not None]
            want[key, k] = (s0, s1, kind, upper(values) if inside and len(values) * 2 >= len(inside) else None)
    assert got == want


def test_changes(spark):
    rows = [("x", 1.0, "a"), ("x", 2.0, "a"), ("x", 3.0, "b"), ("y", 0.0, "a"), ("y", 1.0, "b"), ("y", 1.0, "c"), (None, 5.0, "a"), (None, 6.0, "b")]
    from pyspark.sql import functions as F

    got = cuts.changes(spark.createDataFrame(rows, "section string, s double, v string"), F.col("v") != F.col("before_v"), "k").collect()
    assert sorted(((r["section"], r["s"]) for r in got), key=str) == [("x", 3.0), ("y", 1.0), ("y", 1.0), (None, 6.0)]


def test_changes_of_several_kinds_in_one_order(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = [("a", 1.0, "p", 1.0), ("a", 2.0, "q", 9.0), ("a", 3.0, "q", 1.0), ("a", 4.0, None, 1.0), ("b", 0.0, "p", 5.0), ("b", 1.0, "p", None), ("b", 2.0, "r", 5.0)]
    calls, kept = [], cuts.series.numbered
    monkeypatch.setattr(cuts.series, "numbered", lambda *a: calls.append(a) or kept(*a))
    by = {"type": F.col("v") != F.col("before_v"), "value": F.abs(F.col("w") - F.col("before_w")) > 2}
    got = cuts.all_changes(spark.createDataFrame(rows, "section string, s double, v string, w double"), by).collect()
    assert sorted(map(tuple, got)) == [("a", 2.0, "type"), ("a", 2.0, "value"), ("a", 3.0, "value"), ("b", 2.0, "type")]
    assert len(calls) == 1


def test_no_sections(spark):
    sections = spark.createDataFrame([], "section long, length double")
    none = spark.createDataFrame([], "section long, s double, kind string")
    assert cuts.ranges(sections, cuts.kept_cuts(sections, none, 1.0, ["a"])).count() == 0


def test_reached(spark):
    step = {k: k + 1 for k in range(50)} | {100: 101, 101: 102, 102: 100, 200: None}
    df = spark.createDataFrame(list(step.items()), "id long, next long")
    heads = spark.createDataFrame([(37,), (101,), (200,), (37,)], "id long")
    assert {r["id"] for r in reached(df, heads).collect()} == {*range(37, 51), 100, 101, 102, 200}
