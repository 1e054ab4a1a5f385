"""Trees as nested numbers: everything below a node lies between two numbers of it, everything above it around them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.operators import series
from kerbline.operators.store import cut


def _below(inner: DataFrame) -> DataFrame:
    """id, below, lost of nodes that have children (id, up, n): how many nodes lie below each, where n is the number of its children and
    up its parent, or null. Lost are those below themselves, and what hangs from them."""
    now, before = cut(inner.select("id", "up", F.col("n").alias("below"))), -1
    open_ = now.filter("up IS NOT NULL").count()
    # Nodes without an end above them are left when a round ends none: of the others, some would be as deep as it looks.
    while open_ and open_ != before:
        more = now.filter("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(F.sum("below").alias("more"))
        ahead = now.select(F.col("id").alias("up"), F.col("up").alias("then"))
        both = now.join(ahead, "up", "left").join(more, "id", "left")
        now = cut(both.select("id", F.col("then").alias("up"), (F.col("below") + F.coalesce("more", F.lit(0))).alias("below")))
        before, open_ = open_, now.filter("up IS NOT NULL").count()
    return now.select("id", "below", F.col("up").isNotNull().alias("lost"))


def _from_roots(steps: DataFrame) -> DataFrame:
    """id, low: the sum of the steps (id, up, low) of a node and of all above it."""
    now = cut(steps.select("id", "up", "low"))
    while not now.filter("up IS NOT NULL").isEmpty():
        ahead = now.select(F.col("id").alias("up"), F.col("up").alias("then"), F.col("low").alias("more"))
        now = cut(now.join(ahead, "up", "left").select("id", F.col("then").alias("up"), (F.col("low") + F.coalesce("more", F.lit(0))).alias("low")))
    return now.select("id", "low")


def nested(nodes: DataFrame) -> DataFrame:
    """id, low, high of a forest (id, parent), 1 and up: a node's numbers lie around those of all nodes below it; siblings and roots
    follow in the order of their ids. A parent that is no node counts as none. Nodes that are below themselves have no place and are
    left out, and so is what hangs from them.

    A node's numbers follow from how many nodes lie below it, and from the numbers that the siblings before it take, summed along the
    way up. Both are found by doubling how far up is looked, among nodes that have children only: rounds grow with the logarithm of
    the depth, and a node with very many children is no single task."""
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n"))
    inner = cut(nodes.select("id", "parent").join(children, "id"))
    there = inner.select(F.col("id").alias("parent"), F.lit(True).alias("there"))
    sizes = _below(inner.join(there, "parent", "left").select("id", F.when(F.col("there"), F.col("parent")).alias("up"), "n"))
    above = sizes.select(F.col("id").alias("parent"), "lost")
    own = nodes.select("id", "parent").join(above, "parent", "left").filter("lost IS NULL OR NOT lost")
    own = own.select("id", F.when(F.col("lost").isNotNull(), F.col("parent")).alias("parent"))
    own = own.join(sizes.select("id", "below"), "id", "left").withColumn("size", F.coalesce("below", F.lit(0)) + 1)
    placed = cut(series.summed(own, ["parent", "id"], "size", "before"))
    first = placed.filter("parent IS NOT NULL").groupBy("parent").agg(F.min("before").alias("first"))
    step = 1 + 2 * (F.col("before") - F.coalesce("first", F.lit(0)))
    steps = placed.filter("below IS NOT NULL").join(first, "parent", "left").select("id", F.col("parent").alias("up"), step.alias("low"))
    begins = _from_roots(steps).withColumnRenamed("id", "parent").join(first, "parent")
    low = F.coalesce(F.col("low") - 2 * F.col("first"), F.lit(0)) + 1 + 2 * F.col("before")
    both = placed.join(begins, "parent", "left").select("id", low.alias("low"), "size")
    return both.select("id", "low", (F.col("low") + 2 * F.col("size") - 1).alias("high"))


def below(placed: DataFrame, low: int, high: int) -> DataFrame:
    """What lies below the node with these numbers; over a table sorted by low, the scan reads little else."""
    return placed.filter((F.col("low") > low) & (F.col("low") < high))


def above(placed: DataFrame, low: int) -> DataFrame:
    """What the node with this number lies in, from the root on."""
    return placed.filter((F.col("low") < low) & (F.col("high") > low)).orderBy("low")


def counted_below(placed: DataFrame, kind: str) -> DataFrame:
    """id, kind, n: how many nodes of each kind lie below every node (id, low, high and a column of kinds) that has any. For each kind,
    the nodes below are those numbered up to `high`, less those up to `low`; both are places in one order, so that no pair of a
    node and one below it is ever made. Nodes with nothing between their numbers ask for nothing."""
    rows = cut(placed.select("id", "low", "high", F.col(kind).alias("kind")))
    kinds = rows.select("kind").distinct()
    at = rows.select("kind", F.col("low").alias("s"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("probe"))
    # A few kinds, each asked for at both ends of every node.
    holds = rows.filter("high > low + 1")
    ask = holds.select("low", F.explode(F.array("low", "high")).alias("s")).join(F.broadcast(kinds))
    ask = ask.select("kind", "s", F.lit(1).alias("side"), F.col("low").alias("probe"))
    # A node itself, which stands at its low number, counts at both ends.
    both = at.unionAll(ask).withColumn("one", 1 - F.col("side"))
    up_to = series.summed(both, ["kind", "s", "side"], "one", "n").filter("side = 1")
    n = up_to.groupBy("kind", F.col("probe").alias("low")).agg((F.max("n") - F.min("n")).alias("n")).filter("n > 0")
    return n.join(holds.select("low", "id"), "low").select("id", "kind", "n")
