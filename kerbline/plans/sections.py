"""Section cuts (STP06) along the users' time: a user is a section, hours since the year began are the axis, and what happens there
changes by type of event, by steps of the value, and at fixed marks."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.operators import cuts
from kerbline.plans.registry import query, table

LEAST = 12.0
STEP = 60.0
HOURS = "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9"
SAMPLES = f"""sample AS MATERIALIZED (SELECT user_id AS section, {HOURS} AS s, event_type AS kind, value, event_id FROM events),
  section AS MATERIALIZED (SELECT section, max(s) AS length FROM sample GROUP BY 1)"""
CUTS = f"""{SAMPLES}, n AS (SELECT *, lag(kind) OVER w AS k0, lag(value) OVER w AS v0 FROM sample WINDOW w AS (PARTITION BY section ORDER BY s, kind, value, event_id)),
  raw AS (SELECT section, s, 'type' AS kind, 2 AS rank FROM n WHERE kind <> k0 UNION ALL SELECT section, s, 'value', 1 FROM n WHERE abs(value - v0) > {STEP}
    UNION ALL SELECT section, CAST(unnest(range(100, CAST(floor(length) AS BIGINT) + 1, 100)) AS DOUBLE), 'mark', 3 FROM section),
  valid AS MATERIALIZED (SELECT section, s, arg_min(kind, rank) AS kind FROM raw JOIN section USING (section) WHERE s >= {LEAST} AND s + {LEAST} <= length GROUP BY 1, 2),
  kept(section, s) AS (SELECT section, min(s) FROM valid GROUP BY 1 UNION ALL
    SELECT k.section, min(v.s) FROM kept k JOIN valid v ON v.section = k.section AND v.s >= k.s + {LEAST} GROUP BY 1),
  begin_ AS (SELECT section, s, kind FROM kept JOIN valid USING (section, s) UNION ALL SELECT section, 0, 'section end' FROM section),
  range_ AS MATERIALIZED (SELECT section, row_number() OVER w AS k, s AS s0, coalesce(lead(s) OVER w, length) AS s1, kind AS starts_at
    FROM begin_ JOIN section USING (section) WINDOW w AS (PARTITION BY section ORDER BY s))"""


def samples(spark, sf):
    hours = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / F.lit(3.6e9)
    return table(spark, sf, "events").select(F.col("user_id").alias("section"), hours.alias("s"), F.col("event_type").alias("kind"), "value", "event_id")


def found(spark, sf):
    e = samples(spark, sf)
    sections = e.groupBy("section").agg(F.max("s").alias("length"))
    marks = F.explode(F.sequence(F.lit(1), F.floor(F.col("length") / 100))).alias("m")
    marked = sections.filter("length >= 100").select("section", marks).select("section", (F.col("m") * 100.0).alias("s"), F.lit("mark").alias("kind"))
    changed = cuts.all_changes(e, {"type": F.col("kind") != F.col("before_kind"), "value": F.abs(F.col("value") - F.col("before_value")) > STEP})
    kept = cuts.kept_cuts(sections, cuts.united(changed, marked), LEAST, ["value", "type", "mark"])
    return cuts.ranges(sections, kept)


@query("stp06_ranges", f"WITH RECURSIVE {CUTS} SELECT section, k, round(s0, 6) AS s0, round(s1, 6) AS s1, starts_at FROM range_")
def section_ranges(spark, sf):
    return found(spark, sf).select("section", "k", F.round("s0", 6).alias("s0"), F.round("s1", 6).alias("s1"), "starts_at")


@query("stp06_described", f"""WITH RECURSIVE {CUTS}, held AS (SELECT *, CASE WHEN event_id % 3 > 0 THEN value END AS v FROM sample),
  list_ AS (SELECT r.section, k, count(*) AS n, list_sort(list(v) FILTER (v IS NOT NULL)) AS vs FROM range_ r JOIN held h ON h.section = r.section AND s BETWEEN s0 AND s1 GROUP BY 1, 2)
  SELECT section, k, CASE WHEN len(vs) * 2 >= n THEN vs[len(vs) // 2 + 1] END AS v FROM range_ LEFT JOIN list_ USING (section, k)""")
def described_ranges(spark, sf):
    held = samples(spark, sf).withColumn("v", F.when(F.col("event_id") % 3 > 0, F.col("value")))
    return cuts.described(found(spark, sf), held, ["v"]).select("section", "k", "v")
