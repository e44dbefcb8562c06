"""Connected components of an edge table, by alternating large-star and
small-star steps (Kiveris et al., *Connected Components in MapReduce and
Beyond*, 2014).  Every step is one aggregate and one join on a node id, in which
the nodes with most edges are broadcast, so no node's neighbours are ever
gathered in one place; per round the driver learns whether all are stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexil.llm._join import lookup
from vexil.llm._store import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return lookup(both.where("v > u"), least, ["u"], "n").where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # edges are (a < b): b's smaller neighbours meet at the smallest of them
    least = edges.groupBy("b").agg(F.min("a").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = lookup(edges, least, ["b"], "n").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """No node has two smaller neighbours, and none has both a smaller and a larger one."""
    ends = edges.select(F.col("a").alias("u")).distinct().unionByName(edges.select(F.col("b").alias("u")))
    return ends.groupBy("u").count().where("count > 1").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node reachable.

    Self loops, nulls and repeated edges are ignored; an empty table gives an empty table.
    """
    now = materialize(
        edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct()
    )
    while not _are_stars(now):
        now = materialize(_small_star(_large_star(now)))
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )


def union_find_forest(a, b):
    """Edges (two int64 arrays of positions) reduced to a spanning forest of them: a mask."""
    import numpy as np

    parent: dict[int, int] = {}
    keep = np.zeros(len(a), bool)

    def top(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        p, q = top(x), top(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            keep[i] = True
    return keep
