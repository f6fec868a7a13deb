"""Connected components of a graph of links, by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, written


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` for every end of ``links`` (columns ``a``, ``b``, any
    orderable type): the component is its smallest node.

    Every round each node merges into the smallest of its neighbours, if that
    is smaller, and the links are carried over to what their ends merged into;
    links that lie within one node, and repeated ones, go.  A component's
    smallest node never merges into another, so it is what remains.  The links
    shrink from round to round, and the rounds grow with the logarithm of the
    longest chain.  Links and merges are written after every round, and those of
    the round before deleted; the result is a written table.  Minima are
    taken before the shuffle, so a node with very many links costs no task more
    than its share.  No links give no rows.
    """
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    left = written(links.where("a <> b").select(low, high).distinct())
    found = None
    while found is None or left.limit(1).count():
        ends = left.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("other")))
        into = ends.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("into"))
        # a node follows what it merged into one step further, which shortens chains
        further = into.select(F.col("node").alias("into"), F.col("into").alias("next"))
        into = written(into.join(further, "into").select("node", F.col("next").alias("into")))
        at_a, at_b = (into.select(F.col("node").alias(c), F.col("into").alias(f"to_{c}")) for c in "ab")
        moved = left.join(at_a, "a").join(at_b, "b").where("to_a <> to_b")
        before, left = left, written(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
        discard(before)
        if found is None:
            found = written(into.select("node", F.col("into").alias("component")))
        else:
            step = into.select(F.col("node").alias("component"), "into")
            old, found = found, written(found.join(step, "component", "left").select("node", F.coalesce("into", "component").alias("component")))
            discard(old)
        discard(into)
    discard(left)
    return found
