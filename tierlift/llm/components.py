"""Connected components of a link table, without holding a node's links in one task.

Alternating star operations: every node's links are moved to the smallest node it knows, over
its larger neighbours and then over its smaller ones, until nothing changes. The smallest
neighbour is an aggregate that combines before the shuffle; it is stored and joined back, so
Spark can split the join where one node holds a large share of the links. Every round's
links are stored in the shared folder, and nothing comes to the driver but a count and a
checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierlift.llm.common import drop_stored, stored


def _star(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links of ``(node, other)`` moved to ``(other, smallest neighbour of node)``."""
    least = stored(links.groupBy("node").agg(F.min("other").alias("least")))
    return links.join(least, "node"), least


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
                 .first())


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for each node that has a link; the component is its smallest node.

    ``links`` has two bigint columns ``a`` and ``b``, in any order; repeated links, links of a
    node with itself and links with null are allowed and change nothing. No links give an
    empty table.
    """
    now = stored(links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    while state[0]:
        both = now.select(F.col("a").alias("node"), F.col("b").alias("other")).union(
            now.select(F.col("b").alias("node"), F.col("a").alias("other")))
        moved, least1 = _star(both)
        large = stored(moved.where("other > node").select(
            F.col("other").alias("a"), F.least("least", "node").alias("b")).distinct())
        moved, least2 = _star(large.select(F.col("a").alias("node"), F.col("b").alias("other")))
        small = moved.where("other <> least").select(
            F.col("other").alias("a"), F.col("least").alias("b")).union(
            least2.select(F.col("node").alias("a"), F.col("least").alias("b"))).distinct()
        then = stored(small)
        before, state = state, _state(then)
        drop_stored(now, least1, large, least2)
        now = then
        if state == before:
            break
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component")))
