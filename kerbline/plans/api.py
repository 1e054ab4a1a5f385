"""The query API (API): tree, focus, features, search, schema, levels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.operators import browse, filters, spatial, trees
from kerbline.plans.joins import PART_POINT, SUPPLIER_POINT, columns, points
from kerbline.plans.registry import query, table


def layers(spark, sf):
    return {"part": (table(spark, sf, "part"), "p_partkey", ["p_name", "p_brand", "p_type"]), "customer": (table(spark, sf, "customer"), "c_custkey", ["c_name", "c_mktsegment"])}


@query("api02_children", "SELECT n_nationkey AS id, n_name AS label, CAST(count(s_suppkey) AS BIGINT) AS n_children FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey = 2 GROUP BY 1, 2")
def children(spark, sf):
    n, s = table(spark, sf, "nation"), table(spark, sf, "supplier")
    return browse.children(n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label"), F.col("n_regionkey").alias("parent")), s.select(F.col("s_nationkey").alias("parent")), 2)


NODES = """t AS MATERIALIZED (SELECT 'r' || r_regionkey AS id, NULL AS parent, 'region' AS kind, ['r' || r_regionkey] AS path FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'nation', ['r' || n_regionkey, 'n' || n_nationkey] FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'customer', ['r' || n_regionkey, 'n' || n_nationkey, 'c' || c_custkey] FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'supplier', ['r' || n_regionkey, 'n' || n_nationkey, 's' || s_suppkey] FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'order', ['r' || n_regionkey, 'n' || n_nationkey, 'c' || c_custkey, 'o' || o_orderkey]
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def nodes(spark, sf):
    """id, parent, kind of regions, nations, customers, suppliers and orders."""
    i = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    ranks = [("region", "r", "r_regionkey", None, None), ("nation", "n", "n_nationkey", "r", "n_regionkey"), ("customer", "c", "c_custkey", "n", "c_nationkey"), ("supplier", "s", "s_suppkey", "n", "s_nationkey"), ("orders", "o", "o_orderkey", "c", "o_custkey")]
    parts = [table(spark, sf, t).select(i(p, k).alias("id"), (i(up, of) if up else F.lit(None).cast("string")).alias("parent"), F.lit(t.removesuffix("s")).alias("kind")) for t, p, k, up, of in ranks]
    return reduce(DataFrame.unionByName, parts)


@query("grf17_nested", f"WITH {NODES}, o AS (SELECT id, path, row_number() OVER (ORDER BY path) AS k, len(path) AS depth FROM t), n AS (SELECT unnest(path) AS id, count(*) AS n FROM t GROUP BY 1) SELECT id, CAST(2 * k - depth AS BIGINT) AS low, CAST(2 * k - depth + 2 * n - 1 AS BIGINT) AS high FROM o JOIN n USING (id)")
def nested_numbers(spark, sf):
    return trees.nested(nodes(spark, sf))


@query("api02_below", f"WITH {NODES} SELECT u.id, kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT kind, unnest(path[:-2]) AS id FROM t) u GROUP BY 1, 2")
def counted_below(spark, sf):
    n = nodes(spark, sf)
    return trees.counted_below(trees.nested(n).join(n.select("id", "kind"), "id"), "kind")


@query("api03_focus", f"WITH p AS (SELECT p_partkey AS id, {PART_POINT} FROM part), s AS (SELECT s_suppkey AS sid, {SUPPLIER_POINT} FROM supplier WHERE s_suppkey IN (3, 17)) SELECT DISTINCT p.id FROM p JOIN s ON (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y) <= 2500")
def focus(spark, sf):
    chosen = table(spark, sf, "supplier").filter(F.col("s_suppkey").isin(3, 17)).selectExpr("s_suppkey AS id", *columns(SUPPLIER_POINT))
    return spatial.distance_join(points(spark, sf, "part", "p_partkey", PART_POINT), chosen, 50.0).select("a.id").distinct()


@query("api05_features", f"WITH p AS (SELECT p_partkey AS id, p_brand AS class, {PART_POINT} FROM part WHERE p_size = 10), c AS (SELECT count(*) AS total FROM p) SELECT id, '{{\"type\":\"Point\",\"coordinates\":[' || x || ',' || y || ']}}' AS geometry, CAST(total AS BIGINT) AS total FROM p, c ORDER BY id LIMIT 20")
def features(spark, sf):
    p = table(spark, sf, "part").filter("p_size = 10").selectExpr("p_partkey AS id", "p_brand AS class", *columns(PART_POINT))
    return browse.features(p, 20).select("id", "geometry", "total")


@query("api06_query_box", f"WITH p AS (SELECT p_partkey AS id, p_size, {PART_POINT} FROM part) SELECT id FROM p WHERE p_size >= 20 AND x BETWEEN 100 AND 400 AND y BETWEEN 200 AND 700")
def query_box(spark, sf):
    p = table(spark, sf, "part").selectExpr("p_partkey AS id", "p_size", *columns(PART_POINT))
    return filters.where(p, [("p_size", ">=", 20)], (100, 200, 400, 700)).select("id")


@query("api07_search", "WITH h AS (SELECT 'part' AS layer, CAST(p_partkey AS VARCHAR) AS id FROM part WHERE concat_ws(' ', p_partkey, p_name, p_brand, p_type) ILIKE '%77%' UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR) FROM customer WHERE concat_ws(' ', c_custkey, c_name, c_mktsegment) ILIKE '%77%') SELECT layer, id FROM h QUALIFY row_number() OVER (PARTITION BY layer ORDER BY id) <= 50")
def search(spark, sf):
    return browse.search(layers(spark, sf), "77", 50)


@query("api09_schema", "SELECT * FROM (VALUES ('nation', 'n_nationkey', 'int', 25), ('nation', 'n_name', 'string', 25), ('nation', 'n_regionkey', 'int', 25), ('region', 'r_regionkey', 'int', 5), ('region', 'r_name', 'string', 5)) t(relation, field, type, n)")
def schema(spark, sf):
    return browse.schema({t: table(spark, sf, t) for t in ("nation", "region")})


@query("api10_open_checks", "SELECT id, n, array_to_string((list_sort(items))[1:3], ',') AS items FROM (SELECT 'c' || (p_size % 4) AS id, CAST(count(*) AS BIGINT) AS n, list(p_partkey) AS items FROM part WHERE p_size > 45 GROUP BY 1)")
def open_checks(spark, sf):
    g = table(spark, sf, "part").filter("p_size > 45").groupBy(F.concat(F.lit("c"), (F.col("p_size") % 4).cast("string")).alias("id"))
    return g.agg(F.count("*").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_list("p_partkey")), 1, 3), ",").alias("items"))


@query("api11_levels", "SELECT DISTINCT unnest(range(least(p_size % 4 - 2, p_size % 3), greatest(p_size % 4 - 2, p_size % 3) + 1)) AS level FROM part")
def levels(spark, sf):
    a, b = F.col("p_size") % 4 - 2, F.col("p_size") % 3
    return browse.levels(table(spark, sf, "part").select(F.least(a, b).cast("long").alias("low"), F.greatest(a, b).cast("long").alias("high")))
