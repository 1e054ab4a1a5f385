"""Faces of a plane network of straight edges, their sides by street, and the blocks among them.

Every edge is run along both ways; the face of such a half-edge lies to its left. Half-edges are sorted by angle around the node
they leave, over the whole table at once, so a node with very many edges is no single task. The one that follows a half-edge is the
next clockwise from its way back. Faces are the rings of these pointers.

A ring that turns left bounds a face; any other is the outline of a connected part of the network, seen from outside, and lies in
some face of another part or in none. That face is found by looking to the left from the outline's leftmost node, through cells of
a grid: each round looks twice as far as the one before, and only the outlines that have met nothing look on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.operators import series
from kerbline.operators.pointers import followed
from kerbline.operators.store import cut


def half_edges(edges: DataFrame, nodes: DataFrame, *keep: str) -> DataFrame:
    """h, edge, node, ax, ay, bx, by: edges (edge, source, target) of nodes (node, x, y), both ways: h is twice the edge, or one more
    for its way back. Edges between places that are one, and those with an end that is no node, are left out."""
    a = nodes.select(F.col("node").alias("source"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = nodes.select(F.col("node").alias("target"), F.col("x").alias("bx"), F.col("y").alias("by"))
    e = edges.select("edge", "source", "target", *keep).join(a, "source").join(b, "target").filter("ax <> bx OR ay <> by")

    def way(back: int, node: str, *place: str) -> Column:
        ends = [F.col(c).alias(n) for c, n in zip(place, ("ax", "ay", "bx", "by"), strict=True)]
        return F.struct((F.col("edge") * 2 + back).alias("h"), F.col(node).alias("node"), *ends)

    return e.select("edge", *keep, F.inline(F.array(way(0, "source", "ax", "ay", "bx", "by"), way(1, "target", "bx", "by", "ax", "ay"))))


def following(halves: DataFrame) -> DataFrame:
    """id, next: for each half-edge the one after it around the face to its left."""
    angle = F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax"))
    sorted_ = cut(series.numbered(halves.select("h", "node", angle.alias("angle")), ["node", "angle", "h"], "place"))
    around = sorted_.groupBy("node").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    before = F.when(F.col("place") == F.col("first"), F.col("last")).otherwise(F.col("place") - 1)
    own = sorted_.join(around, "node").select(F.col("h").bitwiseXOR(1).alias("id"), before.alias("place"))
    return own.join(sorted_.select("place", F.col("h").alias("next")), "place").select("id", "next")


def rings(halves: DataFrame) -> DataFrame:
    """The half-edges with ring, the least half-edge of theirs, and next."""
    pointers = cut(following(halves))
    found = followed(pointers).select(F.col("id").alias("h"), F.col("least").alias("ring"))
    return cut(halves.join(found, "h").join(pointers.withColumnRenamed("id", "h"), "h"))


def outlines(ringed: DataFrame) -> DataFrame:
    """ring, sides, area, perimeter, inner: area is positive, and inner true, where a ring bounds a face; sides counts half-edges, so
    an edge with one face on both sides counts twice."""
    area = F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")) / 2
    g = ringed.groupBy("ring").agg(
        F.count("*").alias("sides"), area.alias("area"), F.sum(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))).alias("perimeter")
    )
    return g.withColumn("inner", F.col("area") > 0)


def around_outlines(ringed: DataFrame, cell: float) -> DataFrame:
    """ring, around: for each ring that bounds no face the ring of the face it lies in; null where it lies in none."""
    shape = cut(outlines(ringed).select("ring", "inner"))
    halves = ringed.join(shape, "ring")
    # Of several leftmost nodes the lowest; just above it nothing of its own part lies to the left.
    point = F.min(F.struct("ax", "ay")).alias("p")
    looking = halves.filter("NOT inner").groupBy("ring").agg(point).select("ring", F.col("p.ax").alias("px"), F.col("p.ay").alias("py"))
    looking = cut(looking.withColumns({"cx": F.floor(F.col("px") / cell), "cy": F.floor(F.col("py") / cell)}))
    # Half-edges that run down have to their left what lies to the right of them.
    down = halves.filter("ay > by").select(F.col("ring").alias("around"), "ax", "ay", "bx", "by")
    over = lambda low, high: F.sequence(F.floor(low / cell), F.floor(high / cell))
    down = down.withColumn("cx", F.explode(over(F.least("ax", "bx"), F.greatest("ax", "bx")))).withColumn("cy", F.explode(over(F.col("by"), F.col("ay"))))
    down = cut(down)
    least = down.agg(F.min("cx")).first()[0]
    found, reach = [], 0
    while least is not None and not looking.isEmpty():
        # Columns of cells [from, from + width) to the left; the first round looks at the node's own.
        begin, width = (0, 1) if reach == 0 else (reach, reach)
        reach = begin + width
        some = looking.withColumn("cx", F.explode(F.sequence(F.greatest(F.col("cx") - (reach - 1), F.lit(least)), F.col("cx") - begin)))
        some = some.filter(F.col("cx") >= least) if begin == 0 else some
        slope = (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))
        at = F.col("ax") + slope * (F.col("py") - F.col("ay"))
        hits = some.join(down, ["cx", "cy"]).filter((F.col("by") <= F.col("py")) & (F.col("ay") > F.col("py"))).withColumn("at", at)
        # Where edges meet the line at one place, the one that leans furthest to the right above it stands before the others.
        best = hits.filter(F.col("at") < F.col("px")).groupBy("ring").agg(F.max_by("around", F.struct("at", slope)).alias("around"), F.max("at").alias("at"))
        # A hit counts once every column between is seen: an edge that lies further left than these columns may still be nearer in none.
        seen = cut(looking.join(best, "ring", "left"))
        sure = F.col("around").isNotNull() & (F.col("at") >= (F.col("cx") - (reach - 1)) * cell)
        found.append(seen.filter(sure).select("ring", "around"))
        looking = cut(seen.filter(~sure).filter(F.col("cx") - reach >= least).select("ring", "px", "py", "cx", "cy"))
    none = shape.filter("NOT inner").select("ring", F.lit(None).cast("long").alias("around"))
    if not found:
        return none
    hit = found[0]
    for more in found[1:]:
        hit = hit.unionAll(more)
    # The ring beside an outline may be an outline itself, in turn: pointers lead on until a ring that bounds a face.
    ways = shape.join(hit, "ring", "left").select(F.col("ring").alias("id"), F.when(~F.col("inner"), F.col("around")).alias("next"))
    last = followed(ways).select(F.col("id").alias("ring"), F.col("last").alias("around"))
    bounding = shape.filter("inner").select(F.col("ring").alias("around"), F.lit(True).alias("bounds"))
    out = shape.filter("NOT inner").select("ring").join(last, "ring").join(bounding, "around", "left")
    return out.select("ring", F.when(F.col("bounds"), F.col("around")).alias("around"))


def faces(ringed: DataFrame, cell: float) -> DataFrame:
    """face, sides, area, perimeter, holes: every face that has an end, without the outlines that lie in it; their sides count as
    its own."""
    shape = cut(outlines(ringed))
    inside = around_outlines(ringed, cell).filter("around IS NOT NULL").join(shape, "ring")
    taken = inside.groupBy(F.col("around").alias("face")).agg(
        F.sum("area").alias("less"), F.sum("perimeter").alias("more"), F.sum("sides").alias("more_sides"), F.count("*").alias("holes")
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    own = shape.filter("inner").withColumnRenamed("ring", "face").join(taken, "face", "left")
    return own.select(
        "face",
        (F.col("sides") + zero("more_sides")).alias("sides"),
        (F.col("area") + zero("less")).alias("area"),
        (F.col("perimeter") + zero("more")).alias("perimeter"),
        zero("holes").alias("holes"),
    )


def sides(ringed: DataFrame, street: str) -> DataFrame:
    """face, side, street, edges, length: stretches of one street along the outline of a face; a side is called by its last
    half-edge, and by the least one where one street runs all around. Outlines of parts within a face aren't listed."""
    inner = outlines(ringed).filter("inner").select("ring")
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    own = cut(ringed.join(inner, "ring", "left_semi").select("h", "ring", "next", F.col(street).alias("street"), length.alias("length")))
    ahead = own.select(F.col("h").alias("next"), F.col("street").alias("then"))
    same = own.join(ahead, "next").select(F.col("h").alias("id"), F.when(F.col("street").eqNullSafe(F.col("then")), F.col("next")).alias("next"))
    named = followed(same).select(F.col("id").alias("h"), F.when(F.col("ring"), F.col("least")).otherwise(F.col("last")).alias("side"))
    by = own.join(named, "h").groupBy(F.col("ring").alias("face"), "side")
    return by.agg(F.first("street").alias("street"), F.count("*").alias("edges"), F.sum("length").alias("length"))


def blocks(found: DataFrame, least_area: float, least_width: float) -> DataFrame:
    """Faces (face, area, perimeter) as blocks: those of some area whose mean width, as that of a strip, is enough."""
    width = 2 * F.col("area") / F.col("perimeter")
    return found.withColumn("width", width).filter((F.col("area") >= least_area) & (width >= least_width))
