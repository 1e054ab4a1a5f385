"""Whitening of embeddings by merged singular value decompositions.

A vector's entries are scaled by SCALE and floored, so all sums are whole numbers. The model is fitted to the distinct vectors. Every
task decomposes its centred vectors block by block and keeps a factor: their number, their sums, and all singular values times their
right vectors, as many rows as there are dimensions. Two factors are merged by decomposing one factor's rows over the other's, with
one more row for the distance of the means, sqrt(n1 n2 / (n1 + n2)) (mean1 - mean2): the scatter of both together is kept whole, in
all dimensions, as nothing is cut off. Factors meet FAN_IN at a time, so a task holds that many; only the last comes to the driver,
and its size is the square of the dimensions, whatever the number of rows.

Components without variance (a singular value within rounding of none) have no whitened value and are left out. Vectors shorter than
the longest count as zero beyond their end. A deviation that no long can hold is null.

Defined cases: rows whose vector is null, or has an entry that is null, infinite or not a number, are dropped; repeated
rows are fitted once and given out each; an empty table, or one where all vectors are equal, gives an empty result; only vec_id and
embedding are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.llm import common

SCALE = 256
#: Vectors that are decomposed at once, and factors that are merged in one task.
BLOCK = 4096
FAN_IN = 16
#: Components of the report.
COMPONENTS = 4
FACTOR = "part long, n long, sums array<long>, rows array<double>"


class Factor(NamedTuple):
    """n vectors with these sums, whose centred scatter is rows.T @ rows."""

    n: int
    sums: np.ndarray
    rows: np.ndarray


class Model(NamedTuple):
    """The fitted whole: eigenvalues of the covariance by falling size, and unit eigenvectors as rows."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray


def whole_numbers(vector: Column) -> Column:
    """Entries times SCALE, floored, as long; null where the vector or one of its entries is null or not finite."""
    numbers = vector.cast("array<double>")
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(~F.exists(numbers, odd), F.transform(numbers, lambda c: F.floor(c * SCALE).cast("long")))


def usable(vectors: DataFrame, carried: tuple[str, ...] = ("vec_id",), vector: str = "embedding") -> DataFrame:
    """The carried columns and x, of the rows whose vector is whole."""
    return vectors.select(*carried, whole_numbers(F.col(vector)).alias("x")).filter("x IS NOT NULL")


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of a list column; shorter ones are zero beyond their end."""
    ends = column.offsets.to_numpy()
    flat, sizes = column.values.to_numpy()[ends[0] : ends[-1]], np.diff(ends)
    if (sizes == d).all():
        return flat.reshape(-1, d)
    out = np.zeros((len(sizes), d), np.int64)
    out[np.arange(d) < sizes[:, None]] = flat
    return out


def factor(x: np.ndarray) -> Factor:
    """Of whole numbers, a vector a row."""
    sums = x.sum(0)
    _, s, v = np.linalg.svd(x - sums / len(x), full_matrices=False)
    return Factor(len(x), sums, s[:, None] * v)


def merged(a: Factor, b: Factor) -> Factor:
    """Of the vectors of both."""
    apart = np.sqrt(a.n * b.n / (a.n + b.n)) * (a.sums / a.n - b.sums / b.n)
    _, s, v = np.linalg.svd(np.vstack([a.rows, b.rows, apart]), full_matrices=False)
    return Factor(a.n + b.n, a.sums + b.sums, s[:, None] * v)


def _told(part: int, f: Factor) -> tuple[int, int, np.ndarray, np.ndarray]:
    return part, f.n, f.sums, f.rows.ravel()


def fit(distinct: DataFrame) -> Model | None:
    """The model of distinct vectors x; None where there are none."""
    d = distinct.agg(F.max(F.size("x"))).first()[0]
    if not d:
        return None

    def by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            x = _matrix(batch.column(0), d)
            for at in range(0, len(x), BLOCK):
                block = factor(x[at : at + BLOCK])
                now = block if now is None else merged(now, block)
        if now is not None:
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())]
            row = _told(TaskContext.get().partitionId(), now)
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, kinds, strict=True)], names=["part", "n", "sums", "rows"])

    def together(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        now = None
        for r in rows.sort_values("part").itertuples():
            one = Factor(int(r.n), np.asarray(r.sums, np.int64), np.asarray(r.rows, float).reshape(-1, d))
            now = one if now is None else merged(now, one)
        return pd.DataFrame([_told(int(group[0]), now)], columns=["part", "n", "sums", "rows"])

    factors = common.stored(distinct.select("x").mapInArrow(by_task, FACTOR))
    while (left := factors.count()) > 1:
        # Parts are numbered anew, so that they fall in groups of FAN_IN: one small row a factor, none of its numbers.
        parts = sorted(r["part"] for r in factors.select("part").collect())
        group = factors.sparkSession.createDataFrame([(p, k // FAN_IN) for k, p in enumerate(parts)], "part long, into long")
        dealt = factors.join(F.broadcast(group), "part").repartition(max(1, -(-left // FAN_IN)), "into")
        factors = common.stored(dealt.select("into", "part", "n", "sums", "rows").groupBy("into").applyInPandas(together, FACTOR))
    last = factors.first()
    n, rows = last["n"], np.array(last["rows"]).reshape(-1, d)
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    return Model(n, np.array(last["sums"], np.int64), s * s / n, v)


def _components(model: Model | None, most: int | None) -> np.ndarray:
    """Numbers from 0 of the components with variance."""
    if model is None or not model.values.size:
        return np.zeros(0, int)
    least = (np.finfo(float).eps * max(model.n, len(model.sums))) ** 2 * model.values[0]
    return np.flatnonzero(model.values > least)[:most]


def _projected(x: np.ndarray, model: Model, own: np.ndarray) -> np.ndarray:
    return (x - model.sums / model.n) @ (model.vectors[own] / np.sqrt(model.values[own])[:, None]).T


def _deviations(x: np.ndarray, model: Model) -> list[int | None]:
    """Sums over dimensions of (n x - S)^2, exact."""
    n, s = model.n, model.sums
    largest = max(int(np.abs(x).max(initial=0)), 1), max(int(np.abs(s).max(initial=0)), 1)
    if max(largest) * largest[0] * x.shape[1] >= 1 << 62:
        x, s = x.astype(object), s.astype(object)
    squares, with_s, total = (x * x).sum(1).tolist(), (x @ s).tolist(), sum(int(k) ** 2 for k in s)
    exact = [n * n * q - 2 * n * r + total for q, r in zip(squares, with_s, strict=True)]
    return [k if k < 1 << 63 else None for k in exact]


def identity_error(distinct: DataFrame, model: Model | None, most: int | None = None) -> float | None:
    """The largest entry, in amount, of the covariance of the whitened distinct vectors less the identity: summed over tasks, one
    row for each two components and task."""
    own = _components(model, most)
    if not len(own):
        return None
    d, i, j = len(model.sums), *np.triu_indices(len(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, plain = np.zeros((len(own), len(own))), np.zeros(len(own))
        for batch in batches:
            w = _projected(_matrix(batch.column(0), d), model, own)
            total += w.T @ w
            plain += w.sum(0)
        columns = [pa.array(np.r_[np.arange(len(i)), -1 - np.arange(len(own))]), pa.array(np.r_[total[i, j], plain])]
        yield pa.RecordBatch.from_arrays(columns, names=["at", "v"])

    rows = distinct.select("x").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    sums = {r["at"]: r["v"] / model.n for r in rows}
    mean = np.array([sums[-1 - k] for k in range(len(own))])
    cov = np.array([sums[k] for k in range(len(i))]) - mean[i] * mean[j]
    return float(np.abs(cov - (i == j)).max())


def whitened(rows: DataFrame, model: Model | None, most: int | None = None) -> DataFrame:
    """The rows of usable() with deviation and whitened, an array over the components (all with variance, or the first `most`)."""
    kept = [c for c in rows.columns if c != "x"]
    kinds = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept), "deviation long, whitened array<double>"])
    own = _components(model, most)
    if not len(own):
        return rows.sparkSession.createDataFrame([], kinds)
    d = len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(len(kept)), d)
            w = _projected(x, model, own)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(own)), pa.array(w.ravel()))
            columns = [*batch.columns[: len(kept)], pa.array(_deviations(x, model), pa.int64()), flat]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "deviation", "whitened"])

    return rows.select(*kept, "x").mapInArrow(run, kinds)


def report(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per vector and component."""
    rows = usable(vectors.select(vectors["vec_id"].cast("long"), "embedding"))
    distinct = common.stored(rows.select("x").distinct())
    model = fit(distinct)
    error = identity_error(distinct, model, most)
    made = whitened(rows, model, most).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    share = [0.0] if error is None else (model.values / model.values.sum())[:most].tolist()
    return made.select(
        "vec_id",
        (F.col("k") + 1).cast("int").alias("component"),
        F.lit(0 if model is None else model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(F.array(*map(F.lit, share)), F.col("k")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
