"""Vertical alignments, one profile a row: heights that keep bounds and grades, their fewest grade points, the curves that round these.

A profile is one axis between two ends, a few hundred stations at most; profiles are solved side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KNOT = "struct<s: double, z: double>"
#: Longest vertical curve in metres, and its share of the shorter grade beside it.
CURVE = 80.0
CURVE_SHARE = 0.9
#: Weight of the wish to stay low, which decides where nothing else does.
LOW = 1e-6


def gathered(samples: DataFrame, by: str) -> DataFrame:
    """by, samples: the samples (by, s, z) of each profile in order, those of one place as their mean; without a place or height: left out."""
    at = samples.filter("s IS NOT NULL AND z IS NOT NULL").groupBy(by, "s").agg(F.avg("z").alias("z"))
    return at.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("s", "z"))).cast(f"array<{KNOT}>").alias("samples"))


def fewest_knots(samples: Column, tolerance: float) -> Column:
    """The fewest of a profile's samples, the first and the last among them, whose straight grades keep all samples within the tolerance.
    Of ties: from the end on, the earliest sample that a grade can come from. For each sample, those before it are walked backward with
    the range of slopes that the samples between allow, so the whole is least, not only what halving at the worst sample finds."""

    def reach(best: Column, i: Column) -> Column:
        here = samples[i]

        def back(at: Column, k: Column) -> Column:
            there = samples[k]
            ds, dz = here["s"] - there["s"], here["z"] - there["z"]
            fits = (dz / ds >= at["low"]) & (dz / ds <= at["high"]) & (best[k]["n"] + 1 <= at["n"])
            return F.struct(
                F.greatest(at["low"], (dz - tolerance) / ds).alias("low"),
                F.least(at["high"], (dz + tolerance) / ds).alias("high"),
                F.when(fits, best[k]["n"] + 1).otherwise(at["n"]).alias("n"),
                F.when(fits, k).otherwise(at["from"]).alias("from"),
            )

        start = F.struct(F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"), (i + 1).alias("n"), F.lit(-1).alias("from"))
        found = F.aggregate(F.sequence(i - 1, F.lit(0), F.lit(-1)), start, back)
        return F.concat(best, F.array(F.struct(found["n"].alias("n"), found["from"].alias("from"))))

    last = F.size(samples) - 1
    table = F.aggregate(F.sequence(F.lit(1), last), F.array(F.struct(F.lit(0).alias("n"), F.lit(-1).alias("from"))), reach)

    def trace(best: Column) -> Column:
        start = F.struct(last.alias("at"), F.slice(samples, -1, 1).alias("knots"))
        step = lambda a, _: F.struct(best[a["at"]]["from"].alias("at"), F.concat(F.array(samples[best[a["at"]]["from"]]), a["knots"]).alias("knots"))
        return F.aggregate(F.sequence(F.lit(1), best[last]["n"]), start, step)["knots"]

    # The table is bound once: a list of one, turned.
    return F.when(last < 1, samples).otherwise(F.transform(F.array(table), trace)[0])


def curves(knots: Column) -> Column:
    """The length of the vertical curve at each knot: none at the ends."""
    length = lambda i: F.least(F.lit(CURVE), CURVE_SHARE * F.least(knots[i]["s"] - knots[i - 1]["s"], knots[i + 1]["s"] - knots[i]["s"]))
    return F.transform(knots, lambda _, i: F.when((i > 0) & (i < F.size(knots) - 1), length(i)).otherwise(0.0))


def height(knots: Column, lengths: Column, s: Column) -> Column:
    """The height at s: straight grades between the knots, each inner knot rounded by a parabola of its length; level beyond the ends.
    Curves that keep to CURVE_SHARE never meet, so only the knots at either end of the grade at s can round it."""
    last = F.size(knots) - 1
    j = F.greatest(F.least(F.size(F.filter(knots, lambda k: k["s"] < s)), last), F.lit(1))
    slope = lambda i: (knots[i]["z"] - knots[i - 1]["z"]) / (knots[i]["s"] - knots[i - 1]["s"])
    inside = F.greatest(knots[0]["s"], F.least(s, knots[last]["s"]))
    z = knots[j]["z"] - slope(j) * (knots[j]["s"] - inside)
    for i in (j - 1, j):
        # The parabola leaves the straight line by the change of grade, growing with the square of the way into the curve.
        into = lengths[i] / 2 - F.abs(s - knots[i]["s"])
        rounds = (i > 0) & (i < last) & (lengths[i] > 0) & (into > 0)
        z = F.when(rounds, z + (slope(i + 1) - slope(i)) * into * into / (2 * lengths[i])).otherwise(z)
    return F.when(last < 1, knots[0]["z"]).otherwise(z)


def fitted(profiles: DataFrame, tolerance: float) -> DataFrame:
    """Profiles (..., samples) with knots, curves, and rms and worst: how far the curved heights are from the samples."""
    out = profiles.withColumn("knots", fewest_knots(F.col("samples"), tolerance)).withColumn("curves", curves(F.col("knots")))
    off = F.transform("samples", lambda p: F.abs(height(F.col("knots"), F.col("curves"), p["s"]) - p["z"]))
    squares = F.aggregate("_off", F.lit(0.0), lambda a, e: a + e * e)
    return out.withColumn("_off", off).withColumns({"rms": F.sqrt(squares / F.size("_off")), "worst": F.array_max("_off")}).drop("_off")


def _least(h: np.ndarray, f: np.ndarray, a: np.ndarray, low: np.ndarray, high: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The z with the least z'hz / 2 - f'z of those with low <= az <= high, from one of these on. The bounds that hold at z are kept while
    z moves to what is least with them; a bound in the way is added, then the one that pulls most is let go, until none pulls."""
    rows, ends, fixed = np.vstack([a, -a]), np.concatenate([low, -high]), low == high
    n, open_ = len(h), ~np.concatenate([fixed, fixed])
    held = np.flatnonzero(fixed).tolist()
    for k in range(20 * len(rows)):
        w = rows[held]
        system = np.block([[h, -w.T], [w, np.zeros((len(held), len(held)))]])
        found = np.linalg.solve(system, np.concatenate([f - h @ z, np.zeros(len(held))]))
        p, push = found[:n], found[n:]
        rate = rows @ p
        ahead = open_ & (rate < -1e-12)
        ahead[held] = False
        room = np.full(len(rows), np.inf)
        room[ahead] = np.maximum((ends[ahead] - rows[ahead] @ z) / rate[ahead], 0.0)
        step = int(room.argmin())
        if room[step] < 1:
            z = z + room[step] * p
            held.append(step)
            continue
        z = z + p
        pulls = [i for i, r in enumerate(held) if open_[r] and push[i] < -1e-10 * (1 + np.abs(push).max())]
        if not pulls:
            return z
        # After many steps by the first in order, so that no set of bounds comes again for ever.
        held.pop(min(pulls, key=(lambda i: push[i]) if k < 10 * len(rows) else (lambda i: held[i])))
    return z


def _steepest(z: np.ndarray, climb: np.ndarray, up: bool) -> np.ndarray:
    """The least heights at or above z (or the greatest at or below) that change by no more than `climb` from station to station."""
    out, pick, sign = z.copy(), (max if up else min), (-1 if up else 1)
    for i in range(1, len(z)):
        out[i] = pick(out[i], out[i - 1] + sign * climb[i - 1])
    for i in range(len(z) - 2, -1, -1):
        out[i] = pick(out[i], out[i + 1] + sign * climb[i])
    return out


def _solved(s: np.ndarray, wish: np.ndarray, low: np.ndarray, high: np.ndarray, grade: float, weight: float) -> np.ndarray | None:
    climb = grade * np.diff(s)
    floor, roof = _steepest(low, climb, True), _steepest(high, climb, False)
    if (floor > roof).any():
        return None
    n, known = len(s), ~np.isnan(wish)
    d = np.diff(s)
    bend = np.zeros((max(n - 2, 0), n))
    for i in range(n - 2):
        bend[i, i : i + 3] = 1 / d[i], -1 / d[i] - 1 / d[i + 1], 1 / d[i + 1]
    h = 2 * (bend.T @ bend + np.diag(weight * known + LOW))
    f = 2 * weight * np.where(known, wish, 0.0)
    step = np.diff(np.eye(n), axis=0)
    inside = lambda z: _steepest(np.clip(z, floor, roof), climb, True)  # noqa: E731  heights within the bounds stay within them
    z = _least(h, f, np.vstack([np.eye(n), step]), np.concatenate([low, -climb]), np.concatenate([high, climb]), inside(np.linalg.solve(h, f)))
    return np.clip(inside(z), low, high)  # what rounding left outside goes back in


def smoothed(stations: DataFrame, by: str, grade: float, weight: float) -> DataFrame:
    """by, s, z: the smoothest heights of each profile. stations: (by, s, wish, low, high), one row a place; of several at one place the
    narrowest bounds and the mean wish. Hard: low <= z <= high (null: none) and no grade beyond `grade`. Soft: least together are the
    squared changes of grade, `weight` times the squared distances from the wishes (null: none), and the heights themselves, by little.
    Where no heights keep the bounds, z is null."""
    at = stations.filter("s IS NOT NULL").groupBy(by, "s").agg(F.avg("wish").alias("wish"), F.max("low").alias("low"), F.min("high").alias("high"))
    # Far beyond any height, in place of none.
    far = F.struct("s", F.coalesce("wish", F.lit(float("nan"))).alias("wish"), F.coalesce("low", F.lit(-1e6)).alias("low"), F.coalesce("high", F.lit(1e6)).alias("high"))
    rows = at.groupBy(by).agg(F.array_sort(F.collect_list(far)).alias("_p"))
    lists = rows.select(by, *[F.col("_p")[c].cast("array<double>").alias(c) for c in ("s", "wish", "low", "high")])

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [_solved(*[np.array(v, dtype=float) for v in row], grade, weight) for row in zip(frame["s"], frame["wish"], frame["low"], frame["high"], strict=True)]
            yield pd.DataFrame({by: frame[by], "s": frame["s"], "z": found})

    kind = stations.schema[by].dataType.simpleString()
    made = lists.mapInPandas(solve, f"`{by}` {kind}, s array<double>, z array<double>")
    return made.select(by, F.posexplode("s").alias("_k", "s"), F.col("z").alias("_z")).select(by, "s", F.col("_z")[F.col("_k")].alias("z"))
