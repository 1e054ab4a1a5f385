import math
import random
import statistics
import zipfile

import pytest
from pyspark.sql import functions as F

from kerbline.functions import outlines, profiles, shapes, tags
from kerbline.operators import conformance, constraints, facets, filters, fusion, graph, matching, nodes, overlay, series, spatial, temporal
from kerbline.sources import readers


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT 1;",
        "with a as (select 1) select * from a",
        "SELECT 'drop table x; copy'",
        "SELECT load, b FROM t WHERE b = 'x;y' AND b = \"x;y\"",
        "SELECT upper(b), count(*), max(load) OVER (PARTITION BY b) FROM T WHERE load IN (SELECT load FROM t) GROUP BY b, load",
        "SELECT b, x FROM t LATERAL VIEW explode(array(1, 2)) AS x",
        "SELECT * FROM (VALUES (1), (2)) AS v(k) JOIN t ON k = load",
        "WITH a AS (SELECT 1 AS k), b AS (SELECT k + 1 AS k FROM a) SELECT * FROM a JOIN b USING (k) ORDER BY 1 LIMIT 3 OFFSET 1",
        "SELECT (WITH a AS (SELECT 1 AS k) SELECT max(k) FROM a) FROM t WHERE EXISTS (SELECT 1 FROM t AS u WHERE u.b = t.b)",
        "SELECT b, sum(k) FILTER (WHERE k > 0) OVER (PARTITION BY b) FROM t",
        "SELECT DISTINCT b FROM t UNION ALL SELECT b FROM t EXCEPT SELECT b FROM t INTERSECT SELECT b FROM t",
        "SELECT b, count(*) FROM t GROUP BY CUBE (b) HAVING count(*) > 1",
        "SELECT x FROM t LATERAL VIEW explode(sequence(1, 5, 2)) AS x",
        "SELECT * FROM t PIVOT (sum(k) FOR b IN ('x', 'y'))",
        "SELECT sum(k) OVER w FROM t WINDOW w AS (ORDER BY b)",
        "SELECT * FROM t, LATERAL (SELECT t.b AS c)",
    ],
)
def test_guard_accepts(spark, sql):
    assert filters.check_sql(spark, sql, ["t"])


@pytest.mark.parametrize(
    "sql",
    [
        "DROP TABLE x",
        "SELECT 1; SELECT 2",
        "ATTACH 'x'",
        "SELECT * FROM read_csv('x')",
        "COPY t TO 'x'",
        "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a",
        "INSERT INTO t SELECT 1",
        "SELECT * FROM parquet.`/root/testdata/sf0.001/part.parquet`",
        "SELECT * FROM other",
        "SELECT (SELECT max(k) FROM other) FROM t",
        "WITH a AS (SELECT * FROM other) SELECT * FROM a",
        "SELECT * FROM t WHERE EXISTS (SELECT 1 FROM other)",
        "SELECT reflect('java.lang.System', 'getenv')",
        "SELECT java_method('java.lang.System', 'getenv') FROM t",
        "SELECT max(try_reflect('java.lang.System', 'getenv')) FROM t",
        "SELECT TRANSFORM(b) USING 'cat' FROM t",
        "SET x = 1",
        "SELECT * FROM range(3)",
        "EXECUTE IMMEDIATE 'DROP VIEW t'",
        "EXECUTE IMMEDIATE 'SELECT 1'",
        "SELECT * FROM IDENTIFIER('parquet.`/root/testdata/sf0.001/part.parquet`')",
        "SELECT IDENTIFIER('reflect')('java.lang.System', 'getenv') FROM t",
        "SELECT * FROM other JOIN (WITH other AS (SELECT 1 AS z) SELECT * FROM other) ON true",
        "WITH a AS (SELECT * FROM b), b AS (SELECT 1) SELECT * FROM a",
        "SELECT (WITH x AS (SELECT 1) SELECT max(k) FROM other) FROM t",
        "SELECT explode(sequence(1, 1000000000))",
        "SELECT explode(sequence(1, k)) FROM t",
        "SELECT length(repeat('x', 1000000000))",
        "SELECT /*+ BROADCAST(t) */ * FROM t",
        "VALUES (1); DROP VIEW t",
        "DESCRIBE t",
        "SHOW TABLES",
        "BEGIN SELECT 1; END",
    ],
)
def test_guard_rejects(spark, sql):
    with pytest.raises(ValueError):
        filters.check_sql(spark, sql, ["t"])


def test_sql_over_given_tables_only(spark):
    """Queries of all kinds are bound to the given frames; a name that leads elsewhere is refused after it is resolved, too."""
    t = spark.createDataFrame([("x", 1), ("y", 2)], "b string, k int")
    for sql in ("WITH a AS (SELECT k FROM t) SELECT x.k FROM a AS x JOIN a AS y USING (k)", "SELECT (SELECT max(k) FROM t) AS k FROM t", "SELECT k FROM t AS u JOIN t AS v USING (k)", "SELECT k FROM VALUES (1), (2) AS v(k)"):
        assert filters.run_sql(spark, sql, {"t": t}).count() == 2
    spark.range(5).createOrReplaceTempView("secret")
    check = filters.check_sql
    try:
        filters.check_sql = lambda spark, sql, tables: sql
        for sql in ("SELECT * FROM secret", "SELECT (SELECT max(id) FROM secret) FROM t", "SELECT * FROM IDENTIFIER('secret')"):
            with pytest.raises(ValueError):
                filters.run_sql(spark, sql, {"t": t})
    finally:
        filters.check_sql = check
        spark.catalog.dropTempView("secret")


def test_sql_leaves_the_callers_views(spark):
    spark.range(3).createOrReplaceTempView("t")
    got = filters.run_sql(spark, "SELECT load FROM t", {"t": spark.createDataFrame([(7,)], "load int")})
    assert [r["load"] for r in got.collect()] == [7]
    assert spark.table("t").count() == 3
    spark.catalog.dropTempView("t")


def test_unknown_filters_are_rejected(spark):
    df = spark.range(3)
    with pytest.raises(ValueError):
        filters.predicate(df, "nothing", "=", 1)
    with pytest.raises(ValueError):
        filters.predicate(df, "id", "~", 1)


def test_building_spans(spark):
    cases = [(3, None, None, None, False, (0, 2)), (None, None, None, 10.0, False, (0, 2)), (None, None, None, None, False, (0, 0)), (2, 1, None, None, False, (-1, 1)), (None, None, None, None, True, (-1, -1)), (None, 2, None, None, True, (-2, -1))]
    for levels, under, lowest, height, deep, want in cases:
        lit = lambda v, t: F.lit(v).cast(t)
        got = one(spark, tags.building_span(lit(levels, "long"), lit(under, "long"), lit(lowest, "long"), lit(height, "double"), F.lit(deep)))
        assert tuple(got) == want


def test_minus_sign_levels(spark):
    assert one(spark, tags.first_integer(F.lit("−3"))) == -3
    lengths = [one(spark, tags.metres(F.lit(x))) for x in ("10 ft", "66", "20.5 (m)", "12.5 m", "none")]
    assert lengths == [pytest.approx(3.048), pytest.approx(20.1168), 20.5, pytest.approx(3.81), None]
    assert one(spark, tags.road_level(F.lit("1.5"), F.lit(None).cast("string"), F.lit(None).cast("string"))) == 2


def test_heights(spark):
    knots = [(0.0, 0.0), (400.0, 16.0)]
    assert one(spark, profiles.height(knots, F.lit(200.0))) == pytest.approx(8.0)
    assert [one(spark, profiles.ramp(300.0, 16.0, F.lit(s))) for s in (0.0, 150.0, 300.0)] == [16.0, 8.0, 0.0]


def test_utm_round_trip(spark):
    p = shapes.lon_lat(shapes.utm(F.lit(18.06), F.lit(59.33), 34), 34)
    got = one(spark, p)
    assert got["x"] == pytest.approx(18.06, abs=1e-8) and got["y"] == pytest.approx(59.33, abs=1e-8)


def test_strip_size(spark):
    got = one(spark, shapes.strip_size(F.lit(100.0), F.lit(85.0)))
    assert got["width"] == pytest.approx(2.5) and got["length"] == pytest.approx(40.0)


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, k) for k in range(101, 160)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and all(got[k] == 100 for k in range(100, 160))


def test_components_of_nothing(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_numbering_follows_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = series.numbered(df, ["k"], "n").orderBy("k").collect()
    assert [r["n"] for r in got] == list(range(1, 1001))


def test_asof_takes_the_last_not_later(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 9, 3)], "k string, at int, id int")
    right = spark.createDataFrame([("a", 2, 10), ("a", 5, 11), ("a", 7, 12)], "k string, at int, v int")
    got = {r["id"]: r["last"] for r in temporal.asof(left, right, "k", "at", {"v": "last"}).collect()}
    assert got == {1: 11, 2: None, 3: None}


def test_nearest_grows_its_radius(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, 1000.0, 0.0)], "id long, x double, y double")
    b = spark.createDataFrame([(7, 3.0, 4.0), (8, -3.0, 4.0)], "id long, x double, y double")
    got = {r["id"]: (r["near_id"], r["d"]) for r in spatial.nearest(a, b, 1.0).collect()}
    assert got[1] == (7, 5.0) and got[2][0] == 7
    empty = b.filter("id < 0")
    assert {r["near_id"] for r in spatial.nearest(a, empty, 1.0).collect()} == {None}


@pytest.mark.parametrize("cell", [0.5, 7.0, 1e4])
def test_nearest_against_all_pairs(spark, cell):
    r = random.Random(8)
    place = lambda: (r.choice([r.uniform(-900, 900), r.gauss(300, 1)]), r.choice([r.uniform(-40, 40), 5.0]))
    a = [(k, *place()) for k in range(150)] + [(500, None, 1.0), (501, 2.0, None)]
    b = [(k, *place()) for k in range(90)] + [(k + 1000, 300.0, 5.0) for k in range(3)] + [(99, None, None)]
    kind = "id long, x double, y double"
    got = {x["id"]: (x["near_id"], x["d"]) for x in spatial.nearest(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), cell).collect()}
    assert got[500] == got[501] == (None, None)
    for i, x, y in a[:150]:
        d, near = min((((x - u) ** 2 + (y - v) ** 2) ** 0.5, k) for k, u, v in b if u is not None)
        assert got[i] == (near, pytest.approx(d))


def test_split_by_nearest(spark):
    """Cells on the line between two sites go to the least id; a box beyond all sites, and one without area."""
    sites = spark.createDataFrame([(2, 0.0, 0.0), (1, 4.0, 0.0), (3, 0.0, 50.0)], "id long, x double, y double")
    boxes = spark.createDataFrame([(10, 0.0, 0.0, 4.0, 2.0), (11, 1.5, 0.0, 2.5, 1.0), (12, -900.0, 0.0, -899.0, 1.0), (13, 1.0, 1.0, 1.0, 9.0)], "id long, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r["box"], r["site"], r["cells"]) for r in spatial.split_by_nearest(boxes, sites, 1.0, 2.0).collect())
    assert got == [(10, 1, 4), (10, 2, 4), (11, 2, 1), (12, 2, 1)]


def test_claims_add_up(spark):
    boxes = spark.createDataFrame([(1, 1, 0, 0, 4, 4), (2, 0, 2, 2, 6, 6), (3, 2, 2, 2, 4, 4)], "id long, rank int, x0 int, y0 int, x1 int, y1 int")
    got = {r["id"]: r["area"] for r in overlay.claimed(boxes).collect()}
    assert got == {1: 12, 2: 16, 3: 0}


def test_registry_keeps_ids(spark):
    none = spark.createDataFrame([], "kind string, key string, uid string, first_seen string, last_seen string")
    things = spark.createDataFrame([("part", "a"), ("part", "b")], "kind string, key string")
    first = matching.register(none, things, F.lit("1"))
    second = {r["key"]: r for r in matching.register(first, things.filter("key = 'a'"), F.lit("2")).collect()}
    uids = {r["key"]: r["uid"] for r in first.collect()}
    assert {k: r["uid"] for k, r in second.items()} == uids
    assert second["a"]["last_seen"] == "2" and second["b"]["last_seen"] == "1" and second["a"]["first_seen"] == "1"


def test_fusion_keeps_one_record_of_a_source(spark):
    rows = [(1, "pole", 0, 5.0, 0.0, 0.0), (2, "pole", 1, 5.0, 3.0, 0.0), (3, "pole", 1, 4.0, 4.0, 0.0), (4, "sign", 0, 1.0, 0.0, 0.0), (5, "pole", 0, 1.0, 500.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, class string, source_rank int, seen double, x double, y double")
    got = {r["id"]: r["thing"] for r in fusion.fuse(df, 10.0).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_fusion_against_the_plain_order(spark):
    """Records taken one by one in their order; many lie close together, so things compete for records."""
    r = random.Random(1)
    rows = [(k, r.choice(["pole", "sign"]), r.randint(0, 3), float(r.randint(0, 5)), r.uniform(0, 60), r.uniform(0, 60)) for k in range(200)]
    want, things = {}, []
    for i, kind, rank, _, x, y in sorted(rows, key=lambda q: (q[2], -q[3], q[0])):
        near = [(((t[2] - x) ** 2 + (t[3] - y) ** 2) ** 0.5, t[0], t) for t in things if t[1] == kind and rank not in t[4]]
        near = [n for n in near if n[0] <= 10.0]
        if near:
            best = min(near, key=lambda n: n[:2])[2]
            best[4].add(rank)
            want[i] = best[0]
        else:
            things.append((i, kind, x, y, {rank}))
            want[i] = i
    df = spark.createDataFrame(rows, "id long, class string, source_rank int, seen double, x double, y double")
    assert {q["id"]: q["thing"] for q in fusion.fuse(df, 10.0).collect()} == want


def test_fusion_takes_few_rounds_for_many_records_of_a_place(spark, monkeypatch):
    """Places in a row, each in reach of the next, with unlike numbers of records that all want the same things."""
    r = random.Random(3)
    rows = [(k, "pole", r.randint(0, 2), float(r.randint(0, 9)), 8.0 * min(r.randint(0, 3), r.randint(0, 3)), 0.0) for k in range(160)]
    rows += [(200, None, 0, 1.0, 0.0, 0.0), (201, "pole", 1, 1.0, None, 0.0)]
    want, things = {200: 200, 201: 201}, []
    for i, _, rank, _, x, _ in sorted(rows[:160], key=lambda q: (q[2], -q[3], q[0])):
        near = [(abs(t[1] - x), t[0], t) for t in things if rank not in t[2] and abs(t[1] - x) <= 10.0]
        if near:
            best = min(near, key=lambda n: n[:2])[2]
            best[2].add(rank)
            want[i] = best[0]
        else:
            things.append((i, x, {rank}))
            want[i] = i
    tables, kept = [], fusion.cut

    def counted(df):
        tables.append(df.columns)
        assert len(tables) <= 60, "rounds grow with the records of a place"
        return kept(df)

    monkeypatch.setattr(fusion, "cut", counted)
    df = spark.createDataFrame(rows, "id long, class string, source_rank int, seen double, x double, y double")
    assert {q["id"]: q["thing"] for q in fusion.fuse(df, 10.0).collect()} == want


def test_change_points_against_a_plain_walk(spark):
    r = random.Random(2)
    rows = [(k, t, r.choice([None, float(r.randint(0, 9))])) for k in ("a", "b", None) for t in range(80)]
    want = set()
    for key in ("a", "b", None):
        values, level = [v for k, _, v in rows if k == key], None
        for i in range(80):
            ahead = sorted(v for v in values[i : i + 3] if v is not None)
            if not ahead:
                continue
            now = statistics.median(ahead)
            if level is None:
                level = now
            elif abs(now - level) > 3:
                want.add((key, i, now))
                level = now
    got = series.change_points(spark.createDataFrame(rows, "k string, t int, v double").repartition(5), "k", ["t"], "v", 3.0, 3)
    assert {tuple(q) for q in got.collect()} == want


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace as N

    from kerbline.operators import store

    session = N(conf=N(get=lambda *_: None), sparkContext=N(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(ValueError):
        store.shared_dir(session)


def test_suite_statuses(spark):
    df = spark.createDataFrame([(1, 5), (2, -1)], "id long, v int")
    out = constraints.suite([constraints.Check("A", "a", constraints.where(df, "id", F.col("v") < 0)), constraints.Check("B", "b", constraints.where(df, "id", F.col("v") > 9)), constraints.Check("C", "c", constraints.where(df, "id", F.col("v") > 0), hard=False)])
    assert {r["id"]: (r["status"], r["n"]) for r in out.collect()} == {"A": ("FAIL", 1), "B": ("PASS", 0), "C": ("INFO", 1)}
    assert constraints.failed(out)


def test_upper_median(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,)], "v int")
    assert df.agg(facets.upper_median("v").alias("m")).first()["m"] == 3


def test_colours_differ_between_neighbours(spark):
    links = [(a, b) for a in range(40) for b in range(a + 1, 40) if (a * b) % 7 == 1] + [(3, 3), (5, 6), (6, 5)]
    got = {r["id"]: r["colour"] for r in nodes.colours(spark.range(40), spark.createDataFrame(links, "a long, b long")).collect()}
    assert set(got) == set(range(40))
    for a, b in links:
        assert a == b or got[a] != got[b]
    for k, c in got.items():
        beside = {got[b] for a, b in links if a == k and b != k} | {got[a] for a, b in links if b == k and a != k}
        assert set(range(c)) <= beside  # the least that is free


def test_lines_of_odd_kinds(spark):
    rows = [(1, [(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)]), (2, [(0.0, 0.0), (0.0, 0.0)]), (3, [(5.0, 5.0)]), (4, []), (5, None)]
    d = spark.createDataFrame(rows, "id int, line array<struct<x: double, y: double>>")
    made = d.select("id", "line", outlines.from_wkb(outlines.wkb(F.col("line"))).alias("w"), outlines.simplified(F.col("line"), 0.1).alias("s"), outlines.parallel(F.col("line"), F.lit(1.0)).alias("p"))
    got = {r["id"]: r for r in made.collect()}
    for k in range(1, 6):
        assert got[k]["w"] == got[k]["line"]
    assert [tuple(p) for p in got[1]["p"]] == [(0.0, 1.0), (1.0, 1.0), (0.0, -1.0)]
    assert len(got[1]["s"]) == 3 and got[3]["p"] == got[3]["line"]
    texts = spark.createDataFrame([("LINESTRING (1 2, 3 4)", 2), ("LINESTRING (1 2, x 4)", None), ("LINESTRING (1)", None), ("", None), (None, None)], "t string, n int")
    for r in texts.select("n", outlines.tried_wkt(F.col("t")).alias("p")).collect():
        assert (r["p"] is None) == (r["n"] is None)


def test_way_through_a_box(spark):
    rows = [((0.0, 0.0), (4.0, 4.0), True), ((0.0, 0.0), (1.0, 1.0), False), ((2.0, -1.0), (2.0, 9.0), True), ((1.0, -1.0), (1.0, 9.0), False), ((0.0, 3.0), (0.5, 9.0), False), ((2.0, 2.0), (2.0, 2.0), True)]
    d = spark.createDataFrame([([a, b], w) for a, b, w in rows], "way array<struct<x: double, y: double>>, want boolean")
    for r in d.select("want", outlines.crosses_box(F.col("way"), *map(F.lit, (1.0, 1.0, 3.0, 3.0))).alias("got")).collect():
        assert r["got"] == r["want"]


MODEL = {
    "sections": ("id int, road string, street string, intersections int", [(1, "r", "s", 2)], [(2, None, "s", 2), (3, "r", "s", 3)]),
    "intersections": ("id int, arms int, streets int, area double", [(1, 3, 2, 100.0)], [(2, 2, 1, 5.0)]),
    "junctions": ("id int, intersection int", [(1, 1)], [(9, 99), (10, None)]),
    "subsections": ("id int", [(1,)], [(9,)]),
    "spaces": ("id int, subsection int, junction int, block int, pieces int, valid boolean, area double", [(1, 1, None, 1, 1, True, 50.0), (2, None, 1, 1, 1, True, 60.0)], [(3, None, None, 9, 2, False, 50.0), (3, None, None, 1, 1, True, None)]),
    "blocks": ("id int", [(1,)], []),
    "parts": ("id int, space int, kind string, area double, source string", [(1, 1, "lane", 50.5, None), (2, 2, "parking", 59.0, "tag")], [(3, 3, "cycle", 10.0, None)]),
    "approaches": ("id int, arms int", [(1, 4), (2, 4), (3, 3)], [(4, 4)]),
    "lanes": ("id int, approach int, section int, width double, offset double, arrow string, told_width double", [(1, 1, 1, 3.0, 0.2, "straight", 3.0), (2, 3, 1, 3.0, None, "left", None)], [(3, 4, 2, 2.5, -0.6, None, 3.0), (4, 4, 2, None, -0.7, "left", 3.0)]),
    "moves": ("lane int, way string", [(1, "straight"), (2, "left")], [(4, "left")]),
    "grounds": ("id int, kind string", [(1, "plaza")], [(2, "lava"), (3, None)]),
    "joints": ("id int, before double, after double", [(1, 3.0, 3.05), (2, None, 1.0)], [(3, 3.0, 3.2)]),
    "level_joins": ("id int, below double, above double", [(1, 3.0, 3.4)], [(2, 3.0, 3.6)]),
    "clearances": ("id int, wanted double, got double", [(1, 4.5, 4.5)], [(2, 4.5, 4.4)]),
}


def test_street_model_rules(spark):
    good = {n: spark.createDataFrame(rows, schema) for n, (schema, rows, _) in MODEL.items()}
    results = constraints.suite(conformance.rules(good)).collect()
    assert len(results) == 24 and {r["status"] for r in results} == {"PASS"}
    bad = {n: spark.createDataFrame(rows + more, schema) for n, (schema, rows, more) in MODEL.items()}
    got = {r["id"]: r["examples"] for r in constraints.suite(conformance.rules(bad)).collect()}
    want = {"P3": "3", "P4": "3", "P7": "3", "S1": "2", "S2": "3", "I1": "2", "I2": "2", "I3": "2", "J1": "10,9", "U3": "10,9", "U7": "9", "U8": "3", "U11": "3", "U12": "4", "U13": "3", "A1": "2", "A2": "3", "R1": "3", "R3": "3", "B7": "3", "B8": "3", "G1": "2,3", "W3": "2", "BR15": "2"}
    assert got == want
    assert conformance.rules({}) == []


def test_chains_of_lines_rings_and_crossings(spark):
    r = random.Random(4)
    runs = [[0, 1, 2, 3, 4], [0, 10, 11], [0, 20], [30, 31, 32, 33, 30], [40, 41, 40], [50, 51], [60, 60]]
    pairs = [p for run in runs for p in zip(run[:-1], run[1:], strict=True)]
    names = r.sample(range(100), len(pairs))
    edges = [(n, *(p if r.random() < 0.5 else p[::-1])) for n, p in zip(names, pairs, strict=True)]
    by, got = {n: (a, b) for n, a, b in edges}, {}
    for x in graph.chains(spark.createDataFrame(edges, "edge long, source long, target long")).collect():
        got.setdefault(x["chain"], {})[x["k"]] = (x["edge"], x["forward"])
    at = 0
    for run in runs:
        own = names[at : at + len(run) - 1]
        at += len(own)
        line = got.pop(min(own))
        assert sorted(line) == list(range(len(own))) and {e for e, _ in line.values()} == set(own)
        ways = [by[e] if f else by[e][::-1] for e, f in (line[k] for k in sorted(line))]
        assert all(a[1] == b[0] for a, b in zip(ways[:-1], ways[1:], strict=True))
        if run[0] == run[-1]:
            assert line[0][0] == min(own) and ways[-1][1] == ways[0][0]
        else:
            assert line[0][0] == min(own[0], own[-1]) and {ways[0][0], ways[-1][1]} == {run[0], run[-1]}
    assert not got


def test_csv_in_archives(spark, tmp_path):
    for k in range(2):
        with zipfile.ZipFile(tmp_path / f"{k}.zip", "w") as z:
            z.writestr("stops.txt", "﻿stop_id,name\n" + f'{k}a,"x, y"\n{k}b,\n')
            z.writestr("other.txt", "a\n1\n")
    got = readers.archived_csv(spark, str(tmp_path), "stops.txt", ["stop_id", "name", "zone"]).collect()
    assert sorted(map(tuple, got), key=str) == [("0a", "x, y", None), ("0b", None, None), ("1a", "x, y", None), ("1b", None, None)]


def test_junction_clusters_as_one_merge_at_a_time(spark):
    r = random.Random(8)
    at = {k: (float(r.randint(0, 90)), float(r.randint(0, 50))) for k in range(60)}
    apart = {(p, q): math.dist(at[p], at[q]) for p in at for q in at}
    far = lambda p, q: apart[p, q]
    own = {k: {k} for k in at}
    while True:
        fit = [(min((far(p, q), min(p, q), max(p, q)) for p in own[a] for q in own[b]), a, b) for a in own for b in own if a < b and max(far(p, q) for p in own[a] for q in own[b]) <= 30]
        fit = [f for f in fit if f[0][0] <= 15]
        if not fit:
            break
        _, a, b = min(fit)
        own[a] |= own.pop(b)
    rows = spark.createDataFrame([(k, *p) for k, p in at.items()], "id long, x double, y double")
    got = {x["id"]: x["cluster"] for x in nodes.junction_clusters(rows, 15.0, 30.0).collect()}
    assert got == {k: min(c) for c in own.values() for k in c}
    assert nodes.junction_clusters(rows.limit(0), 15.0, 30.0).count() == 0


def test_heads_of_an_arrow(spark):
    u = shapes.point(F.lit(0.0), F.lit(1.0))
    a = one(spark, outlines.arrow(shapes.point(F.lit(5.0), F.lit(7.0)), u, 2.0, ("left", "right")))
    lines = [[(p["x"], p["y"]) for p in line] for line in a]
    assert len(lines) == 5 and lines[0][0] == (5.0, 5.0)
    for branch, head, side in ((lines[1], lines[3], -1.0), (lines[2], lines[4], 1.0)):
        tip = branch[1]
        assert tip == pytest.approx((5.0 + side, 6.6)) and head[1] == pytest.approx(tip)
        back = ((head[0][0] + head[2][0]) / 2, (head[0][1] + head[2][1]) / 2)  # on the branch, a head's length before its end
        assert math.dist(back, tip) == pytest.approx(0.8) and math.dist(head[0], head[2]) == pytest.approx(0.8)
        assert (tip[0] - back[0]) * (tip[1] - branch[0][1]) == pytest.approx((tip[1] - back[1]) * (tip[0] - branch[0][0]))
