"""Rows that share a place: joins by place pair them as one, whatever their number, and tell each pair once."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.functions import outlines
from kerbline.functions import shapes as g
from kerbline.operators import graph, matching, nodes, spatial, streets, temporal


def test_rows_of_one_box_are_packed(spark):
    rows = spark.range(5000).select("id", *[F.lit(v).cast("double").alias(c) for c, v in (("x0", 1), ("y0", 1), ("x1", 2), ("y1", 3))])
    lists = spatial.packed(rows, ["x0", "y0", "x1", "y1"], "a").select(F.size("_a").alias("n")).collect()
    assert sum(r["n"] for r in lists) == 5000
    assert 4 <= len(lists) <= 6 and max(r["n"] for r in lists) < 2 * spatial.PACKED


def test_every_pair_of_one_box_is_told_once(spark):
    rows = spark.range(1500).select("id", *[F.lit(v).cast("double").alias(c) for c, v in (("x0", 1), ("y0", 1), ("x1", 40), ("y1", 3))])
    pairs = spatial.box_join(rows, rows, 4.0)
    got = pairs.agg(F.count("*"), F.count_distinct("a.id", "b.id")).first()
    assert tuple(got) == (1500 * 1500, 1500 * 1500)


def test_pairs_of_long_lists_are_made_a_few_at_once(spark):
    # One row without a value is listed like all others.
    rows = spark.range(1800).select(F.when(F.col("id") > 0, F.col("id")).alias("id"), F.lit(2.0).alias("at"))
    a, b = spatial.packed(rows, ["at"], "a"), spatial.packed(rows.filter("id < 1500"), ["at"], "b")
    assert a.schema["_a"].dataType.elementType == rows.schema["id"].dataType
    lists = spatial.shortened(a.join(b, F.col("a.at") == F.col("b.at")).select("_a", "_b"))
    n = F.size("_a") * F.size("_b")
    assert lists.agg(F.sum(n)).first()[0] == 1800 * 1499 and lists.agg(F.max(n)).first()[0] <= spatial.AT_ONCE
    i = rows.select(F.col("id").alias("i"), F.lit(1.0).alias("low"), F.lit(3.0).alias("high")).filter("i < 1500")
    got = temporal.range_join(rows, i, "at", "low", "high", 1.0).agg(F.count("*"), F.count_distinct("id", "i"), F.sum(F.col("id").isNull().cast("int"))).first()
    assert tuple(got) == (1800 * 1499, 1799 * 1499, 1499)


def test_pairs_within_a_distance_by_a_condition_on_places(spark):
    rows = spark.createDataFrame([(k, k % 2, float(k % 3), 0.0) for k in range(60)] + [(99, 0, None, 0.0)], "id long, side int, x double, y double")
    apart = spatial.distance_join(rows, rows, 1.0, (), ("side",), F.col("a.side") != F.col("b.side"))
    want = sorted((a, b, abs(a % 3 - b % 3)) for a in range(60) for b in range(60) if a % 2 != b % 2 and abs(a % 3 - b % 3) <= 1)
    assert sorted((r["a"]["id"], r["b"]["id"], r["d"]) for r in apart.collect()) == want


def boxes(spark, n, sides=7):
    return spark.range(n).selectExpr("id", f"CAST(id * 37 % {sides} * 5 AS DOUBLE) AS x0", "CAST(id % 3 * 9 AS DOUBLE) AS y0").withColumns({"x1": F.col("x0") + 3 + F.col("id") % 4, "y1": F.col("y0") + 4})


def test_colours_of_boxes_are_those_of_their_links(spark):
    some = boxes(spark, 60)
    links = spatial.box_join(some, some, 8.0).filter("a.id < b.id").select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    want = {tuple(r) for r in nodes.colours(some.select("id"), links).collect()}
    assert {tuple(r) for r in nodes.box_colours(some, 8.0).collect()} == want
    # As many rounds as equal boxes would not end.
    equal = spark.range(3000).selectExpr("id", "0D AS x0", "0D AS y0", "1D AS x1", "1D AS y1")
    assert sorted(r["colour"] for r in nodes.box_colours(equal, 8.0).collect()) == list(range(3000))


def test_largest_overlap_of_equal_boxes(spark):
    rows = [tuple(r) for r in boxes(spark, 80).collect()]

    def best(a):
        shared = [((min(a[3], b[3]) - max(a[1], b[1])) * (min(a[4], b[4]) - max(a[2], b[2])), -b[0]) for b in rows if b[0] != a[0] and a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]]
        return -max(shared)[1] if shared else None

    got = {r["id"]: r["other"] for r in spatial.largest_overlap(boxes(spark, 80), 8.0).collect()}
    assert got == {a[0]: best(a) for a in rows if best(a) is not None}


def test_continuations_with_many_ends_of_one_heading(spark):
    ends = [(k % 2, k // 2 % 40, float(k * 45 % 360)) for k in range(120)]

    def best(node, a):
        turns = [(abs((h - g + 180) % 360 - 180), -b) for n, e, h in ends if (n, e) == (node, a) for m, b, g in ends if m == node and b != a]
        return -max(turns)[1] if max(turns)[0] >= 135 else None

    choice = {(n, e): best(n, e) for n, e, _ in ends}
    want = {(n, a, b) for (n, a), b in choice.items() if b is not None and a < b and choice[n, b] == a}
    got = graph.continuations(spark.createDataFrame(ends, "node long, edge long, heading double"))
    assert {tuple(r) for r in got.collect()} == want and want


def test_many_points_of_one_place_are_one_cluster_at_once(spark):
    points = spark.range(2000).selectExpr("id", "CAST(id % 2 * 100 AS DOUBLE) AS x", "0D AS y")
    got = nodes.junction_clusters(points, 15.0, 30.0).groupBy("cluster").count().collect()
    assert {tuple(r) for r in got} == {(0, 1000), (1, 1000)}


def test_means_best_names_and_split_of_copies(spark):
    a = spark.createDataFrame([(k, k % 2, 0.0, 0.0) for k in range(4)], "id long, name int, x double, y double")
    b = spark.createDataFrame([(k, 1, float(k % 2), 0.0, float(k)) for k in range(10, 16)], "id long, name int, x double, y double, z double")
    z = {r["id"]: r["z"] for r in nodes.weighted(a, b, 2.0, 1 / (1 + F.col("d")), "z").collect()}
    assert z == {k: (36 + 39 / 2) / (3 + 3 / 2) for k in range(4)}
    m = {r["id"]: (r["match_id"], r["same"], r["d"]) for r in matching.name_then_distance(a, b, 2.0, 2.0).collect()}
    assert m == {0: (10, False, 0.0), 1: (10, True, 0.0), 2: (10, False, 0.0), 3: (10, True, 0.0)}


def test_expressions_on_outlines_stay_small(spark):
    # What stands in a higher-order function is evaluated wherever it stands; each is named once more as the column.
    plan = lambda c: spark.range(1).select(g.rectangle(*[F.col("id") + k for k in range(4)]).alias("r")).select(c)._jdf.queryExecution().analyzed().toString()
    assert plan(outlines.parallel(F.col("r"), F.lit(1.0))).lower().count("hypot(") <= 2
    assert plan(g.extent(F.col("r"), F.col("r"))).lower().count("hypot(") <= 2
    assert plan(outlines.rectangularity(F.col("r"))).lower().count("hypot(") <= 4


def test_range_join_of_equal_values_and_hulls_of_many_groups(spark):
    p = spark.range(400).selectExpr("id AS p", "CAST(id % 4 AS DOUBLE) AS at")
    i = spark.range(300).selectExpr("id AS i", "CAST(id % 3 AS DOUBLE) AS low", "CAST(id % 3 + 2 AS DOUBLE) AS high")
    got = temporal.range_join(p, i, "at", "low", "high", 1.5)
    assert got.columns == ["p", "at", "i", "low", "high"]
    assert got.agg(F.count("*"), F.count_distinct("p", "i")).first() == (60000, 60000)
    pts = spark.range(9000).select((F.col("id") % 3000).alias("k"), g.point(F.floor(F.col("id") / 3000), F.col("id") % 2).alias("p"))
    hull = streets.hulls(pts, "k").collect()
    assert len(hull) == 3000 and {tuple((q["x"], q["y"] - r["k"] % 2) for q in r["hull"]) for r in hull} == {((0.0, 0.0), (2.0, 0.0), (0.0, 0.0))}
