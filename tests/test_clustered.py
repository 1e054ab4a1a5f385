"""Clustered tables: the curve against its definition, boxes against plain comparisons, what the scan leaves out."""

import random

import pytest
from pyspark.sql import functions as F

from kerbline.operators.store import shared_dir
from kerbline.sources import clustered
from kerbline.sources.clustered import Grid


def test_the_curve_visits_neighbours(spark):
    at = {clustered.along(x, y, 4): (x, y) for x in range(16) for y in range(16)}
    assert sorted(at) == list(range(256))
    assert all(abs(at[d][0] - at[d + 1][0]) + abs(at[d][1] - at[d + 1][1]) == 1 for d in range(255))
    r = random.Random(1)
    cells = [(r.randrange(2**16), r.randrange(2**16)) for _ in range(300)] + [(0, 0), (2**16 - 1, 2**16 - 1), (None, 1)]
    got = spark.createDataFrame(cells, "x long, y long").withColumn("d", clustered.along_column(F.col("x"), F.col("y"))).collect()
    assert all(x["d"] == (None if x["x"] is None else clustered.along(x["x"], x["y"], 16)) for x in got)


@pytest.mark.parametrize("most", [4, 9, 32, 500])
def test_ranges_hold_the_box(most):
    grid, r = Grid(0.0, 0.0, 100.0, 100.0), random.Random(most)
    for _ in range(40):
        x0, y0 = r.uniform(-10, 110), r.uniform(-10, 110)
        box = (x0, y0, x0 + r.choice([0, 0.01, 1, 60]), y0 + r.choice([0, 0.01, 1, 60]))
        found = grid.ranges(box, most)
        assert 1 <= len(found) <= most
        assert all(a[1] + 1 < b[0] for a, b in zip(found[:-1], found[1:], strict=True))
        for _ in range(50):
            d = clustered.along(*grid.cell(r.uniform(box[0], box[2]), r.uniform(box[1], box[3])), clustered.BITS)
            assert any(low <= d <= high for low, high in found)


def scanned(df):
    """Files read by a scan, and its plan."""
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    while plan.children().size():
        plan = plan.children().head()
    return plan.metrics().apply("numFiles").value(), df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_boxes_read_few_files(spark):
    """A third of the rows at one place, rows outside the extent and on its border, without a place, and repeated."""
    r = random.Random(3)
    rows = [(k, r.uniform(0, 100), r.uniform(0, 100)) for k in range(3000)] + [(k, 20.0, 20.0) for k in range(3000, 4600)]
    rows += [(5000, -50.0, 20.0), (5001, 500.0, 500.0), (5002, 100.0, 100.0), (5003, 0.0, 0.0), (5004, None, 1.0), (5005, 1.0, None), (5006, float("nan"), 5.0), (5007, 30.0, 30.0), (5007, 30.0, 30.0), (5008, float("inf"), 50.0)]
    df, grid = spark.createDataFrame(rows, "id long, x double, y double"), Grid(0.0, 0.0, 100.0, 100.0)
    path = f"{shared_dir(spark)}/clustered-test"
    clustered.write(df.repartition(6), grid, path, most_rows=200)
    table = spark.read.parquet(path)
    assert table.count() == len(rows)
    everything = scanned(table)[0]
    for box in [(40.0, 40.0, 52.0, 47.0), (20.0, 20.0, 20.0, 20.0), (-100.0, 0.0, -1.0, 100.0), (99.0, 99.0, 1000.0, 1000.0), (0.0, 0.0, 100.0, 100.0), (-1e9, -1e9, 1e9, 1e9), (5.0, 5.0, 4.0, 9.0), (29.5, 29.5, 30.0, 30.0)]:
        got = clustered.in_box(table, grid, box)
        want = sorted(k for k, x, y in rows if x is not None and y is not None and box[0] <= x <= box[2] and box[1] <= y <= box[3])
        assert got.columns == ["id", "x", "y"]
        assert sorted(x["id"] for x in got.collect()) == want
    files, plan = scanned(clustered.in_box(table, grid, (40.0, 40.0, 52.0, 47.0)))
    assert files * 5 < everything
    low, high = grid.ranges((40.0, 40.0, 52.0, 47.0))[0]
    assert "PartitionFilters: [" in plan and f"GreaterThanOrEqual(hilbert,{low})" in plan and f"LessThanOrEqual(hilbert,{high})" in plan


def test_names_and_empty_tables(spark):
    grid = Grid(0.0, 0.0, 1.0, 1.0)
    none = spark.createDataFrame([], "x double, y double, Tile long")
    with pytest.raises(ValueError, match="made here"):
        clustered.write(none, grid, f"{shared_dir(spark)}/clustered-names")
    path = f"{shared_dir(spark)}/clustered-none"
    clustered.write(spark.createDataFrame([(None, 1.0)], "x double, y double"), grid, path)
    assert clustered.in_box(spark.read.parquet(path), grid, (0.0, 0.0, 1.0, 1.0)).count() == 0
    with pytest.raises(ValueError, match="extent"):
        Grid(1.0, 0.0, 1.0, 1.0)
