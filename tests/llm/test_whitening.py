"""Merged factors against one decomposition of all vectors, in whole numbers and by eigenvalues."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.llm import whitening
from kerbline.llm.queries import QUERIES

COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def brute(rows, most=4):
    """vec_id, component: n, deviation, whitened up to its sign, explained."""
    whole = []
    for key, v in rows:
        if v is not None and all(c is not None and math.isfinite(c) for c in v):
            whole.append((key, [math.floor(256 * float(c)) for c in v]))
    d = max((len(x) for _, x in whole), default=0)
    whole = [(key, (*x, *[0] * (d - len(x)))) for key, x in whole]
    fit = sorted({x for _, x in whole})
    if not fit or not d:
        return []
    n, sums = len(fit), [sum(x[k] for x in fit) for k in range(d)]
    centred = np.array([[n * x[k] - sums[k] for k in range(d)] for x in fit], float) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    out = []
    for key, x in whole:
        own = [n * a - s for a, s in zip(x, sums, strict=True)]
        for k in range(min(most, d)):
            if e[k] > 1e-12 * e[0] > 0:
                out.append((key, k + 1, n, sum(a * a for a in own), abs(float(np.array(own, float) / n @ v[:, k]) / math.sqrt(e[k])), e[k] / e.sum()))
    return sorted(out, key=repr)


def check(df, rows):
    assert df.columns == COLUMNS
    got = df.collect()
    want = brute(rows)
    assert len(got) == len(want)
    key = lambda r: (r[0] is not None, r[0], r[1], r[3], round(r[4], 6))
    mine = sorted(((r["vec_id"], r["component"], r["n"], r["deviation"], abs(r["whitened"]), r["explained"]) for r in got), key=key)
    for g, w in zip(mine, sorted(want, key=key), strict=True):
        assert g[:4] == w[:4]
        assert g[4] == pytest.approx(w[4], abs=1e-8, rel=1e-8)
        assert g[5] == pytest.approx(w[5], rel=1e-9)
    assert len({r["identity_error"] for r in got}) <= 1 and all(r["identity_error"] < 1e-9 for r in got)


def test_every_vector(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    check(QUERIES["op13_whitening"](spark, sf_dir), [(r["vec_id"], r["embedding"]) for r in table.collect()])


def test_many_small_factors(spark, monkeypatch):
    """Blocks of three vectors, factors merged two at a time, over more tasks than a factor has dimensions."""
    monkeypatch.setattr(whitening, "BLOCK", 3)
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    r = random.Random(5)
    rows = [(k, [r.gauss(0, 2) * (j + 1) + r.choice([0, 5]) for j in range(6)]) for k in range(200)]
    rows += [(300 + k, rows[0][1]) for k in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(13)
    check(whitening.report(df), [(x["vec_id"], x["embedding"]) for x in df.collect()])


def test_merging_loses_nothing():
    r = np.random.default_rng(6)
    x = r.integers(-300, 300, (500, 12))
    x[:, 7] = 3 * x[:, 2]  # one dimension less than it seems
    now = whitening.factor(x[:1])
    at = 1
    while at < len(x):
        step = int(r.integers(1, 60))
        now = whitening.merged(now, whitening.factor(x[at : at + step]))
        at += step
    centred = x - x.mean(0)
    assert now.n == 500 and (now.sums == x.sum(0)).all()
    assert np.allclose(now.rows.T @ now.rows, centred.T @ centred, rtol=1e-10, atol=1e-6)


def test_all_dimensions(spark):
    r = random.Random(7)
    rows = [(k, [r.gauss(0, 1) for _ in range(9)]) for k in range(120)]
    usable = whitening.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    model = whitening.fit(usable.select("x").distinct())
    made = np.array([x["whitened"] for x in whitening.whitened(usable, model).collect()])
    assert made.shape == (120, 9)
    assert np.allclose(np.cov(made.T, bias=True), np.eye(9), atol=1e-10)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.25, 1.0]), (1, [0.5, -0.25, 1.0]), (2, None), (3, [1.0, None, 2.0]), (4, [nan, 0.0, 0.0]), (5, [inf, 0.0, 0.0]), (6, [1.0]), (None, [-0.0, 3.5, 2.0]), (7, []), (8, [9.0, 0.001, -4.0])]
    df = spark.createDataFrame([(*x, 1, "y") for x in rows], "vec_id long, embedding array<float>, n int, x string")
    check(whitening.report(df), [(x["vec_id"], x["embedding"]) for x in df.collect()])
    assert whitening.report(df.limit(0)).count() == 0
    assert whitening.report(df.filter("vec_id = 1")).count() == 0  # one distinct vector varies in nothing
    assert whitening.report(df.filter("vec_id = 2 OR vec_id = 7")).count() == 0


def test_deviations_beyond_a_long(spark):
    df = spark.createDataFrame([(1, [3.0e9, 1.0]), (2, [-3.0e9, 2.0]), (3, [0.0, 4.0])], "vec_id long, embedding array<double>")
    got = {(r["vec_id"], r["component"]): r["deviation"] for r in whitening.report(df).collect()}
    x = {1: (3 * 256 * 10**9, 256), 2: (-3 * 256 * 10**9, 512), 3: (0, 1024)}
    sums = [sum(v[k] for v in x.values()) for k in (0, 1)]
    exact = {k: sum((3 * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for k, v in x.items()}
    assert {k: got[k, 1] for k in x} == {k: v if v < 2**63 else None for k, v in exact.items()}
