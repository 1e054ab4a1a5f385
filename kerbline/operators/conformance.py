"""Conformance rules of a street model, as checks over its tables. A rule is made where the tables that it needs are given.

sections (id, road, street, intersections) | intersections (id, arms, streets, area) | junctions (id, intersection) |
subsections (id) | spaces (id, subsection, junction, block, pieces, valid, area) | blocks (id) |
parts (id, space, kind, area, source) | approaches (id, arms) | lanes (id, approach, section, width, offset, arrow, told_width) |
moves (lane, way) | grounds (id, kind) | joints (id, before, after) | level_joins (id, below, above) | clearances (id, wanted, got)

A null key is a broken reference; a null measure breaks no rule, for lack of a value to judge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.operators.constraints import Check, missing, repeated, where

#: Fixed values of the rules, in metres and square metres.
ARMS, STREETS, LEAST_AREA, MOST_AREA, SPAN = 3, 2, 30.0, 10_000.0, 2
SHARE, SLACK, OFF_LINE, LANE, STEP, LEVEL_STEP = 0.03, 1.5, 0.5, 2.75, 0.1, 0.5
GROUNDS = ("building", "carriageway", "sidewalk", "parking", "cycle", "green", "water", "rail", "plaza", "lot", "other")
SOURCED = ("parking", "cycle")


def adds_up(wholes: DataFrame, parts: DataFrame, key: str, share: float = SHARE, slack: float = SLACK) -> DataFrame:
    """Wholes (id, area) whose parts (key, area) miss their area by more than a share of it and a slack; one without parts by all."""
    total = parts.groupBy(F.col(key).alias("_k")).agg(F.sum("area").alias("_t"))
    off = F.abs(F.coalesce("_t", F.lit(0.0)) - F.col("area"))
    return where(wholes.join(total, F.col("id") == F.col("_k"), "left"), "id", off > F.greatest(share * F.col("area"), F.lit(slack)))


def without(df: DataFrame, users: DataFrame, key: str) -> DataFrame:
    """Rows (id) that no row of another table names by its key."""
    return missing(df, "id", "id", users.filter(F.col(key).isNotNull()), key)


def approaches_without(approaches: DataFrame, lanes: DataFrame, moves: DataFrame, way: str, arms: int) -> DataFrame:
    """Approaches of nodes with so many arms or more that have lanes, none of which goes that way."""
    going = lanes.join(moves.filter(F.col("way") == way), lanes["id"] == moves["lane"], "left_semi").select("approach")
    own = approaches.filter(F.col("arms") >= arms).join(lanes.select(F.col("approach").alias("_l")), F.col("id") == F.col("_l"), "left_semi")
    return without(own, going, "approach")


def off_line(lanes: DataFrame, most: float = OFF_LINE) -> DataFrame:
    """Sections whose lanes lie off their line by more than `most`, by the median of offsets."""
    return where(lanes.groupBy("section").agg(F.median("offset").alias("m")), "section", F.abs("m") > most)


def rules(t: dict[str, DataFrame]) -> list[Check]:
    out = []

    def add(id_: str, text: str, needs: tuple[str, ...], violations, hard: bool = True) -> None:
        if all(n in t for n in needs):
            out.append(Check(id_, text, violations(*[t[n] for n in needs]), hard))

    col = F.col
    add("P3", "spaces are valid and have an area", ("spaces",), lambda s: where(s, "id", ~col("valid") | (col("area") < 1)))
    add("P4", "spaces are of one piece", ("spaces",), lambda s: where(s, "id", col("pieces") != 1))
    add("P7", "ids of spaces are unique", ("spaces",), lambda s: repeated(s, "id"))
    add("S1", "sections have a road and a street", ("sections",), lambda s: where(s, "id", col("road").isNull() | col("street").isNull()))
    add("S2", "sections touch two intersections at most", ("sections",), lambda s: where(s, "id", col("intersections") > SPAN))
    add("I1", "intersections have three arms or more", ("intersections",), lambda i: where(i, "id", col("arms") < ARMS))
    add("I2", "intersections have two streets or more", ("intersections",), lambda i: where(i, "id", col("streets") < STREETS), False)
    add("I3", "intersections are of a usual size", ("intersections",), lambda i: where(i, "id", (col("area") < LEAST_AREA) | (col("area") > MOST_AREA)))
    add("J1", "junctions lie in an intersection", ("junctions", "intersections"), lambda j, i: missing(j, "id", "intersection", i, "id"))
    add("U3", "junctions have a space", ("junctions", "spaces"), lambda j, s: without(j, s, "junction"))
    add("U7", "subsections have a space", ("subsections", "spaces"), lambda u, s: without(u, s, "subsection"))
    add("U8", "parts add up to their space", ("spaces", "parts"), lambda s, p: adds_up(s, p, "space"))
    add("U11", "lanes have a move", ("lanes", "moves"), lambda l, m: without(l, m, "lane"), False)
    add("U12", "approaches of four arms go straight on", ("approaches", "lanes", "moves"), lambda a, l, m: approaches_without(a, l, m, "straight", 4), False)
    add("U13", "lanes have an arrow", ("lanes",), lambda l: where(l, "id", col("arrow").isNull()), False)
    add("A1", "lanes are centred on their line", ("lanes",), off_line)
    add("A2", "parking and cycle parts have a source", ("parts",), lambda p: where(p, "id", col("kind").isin(*SOURCED) & col("source").isNull()))
    add("R1", "surfaces meet without a step", ("joints",), lambda j: where(j, "id", F.abs(col("before") - col("after")) > STEP))
    add("R3", "lanes are wide enough", ("lanes",), lambda l: where(l, "id", col("width") < LANE), False)
    add("B7", "spaces lie in a block", ("spaces", "blocks"), lambda s, b: missing(s, "id", "block", b, "id"))
    add("B8", "lanes are as wide as told", ("lanes",), lambda l: where(l, "id", col("width") < col("told_width")), False)
    add("G1", "grounds are of a known kind", ("grounds",), lambda g: where(g, "id", col("kind").isNull() | ~col("kind").isin(*GROUNDS)), False)
    add("W3", "levels join without a step", ("level_joins",), lambda j: where(j, "id", F.abs(col("above") - col("below")) > LEVEL_STEP))
    add("BR15", "clearances are met", ("clearances",), lambda c: where(c, "id", col("got") < col("wanted")), False)
    return out
