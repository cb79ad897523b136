"""Connected components of a graph given as links, by contraction.

In every round each node points to the neighbour (or itself) that comes first in a random
order, and the links between what is pointed to make the next, smaller graph. Half of the
linked nodes, or more, are expected to go in a round, whatever the shape of the graph. Every
step is a grouped minimum and joins; no neighbourhood is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendlens.llm.scratch import written


def _ranked(node: str | Column) -> Column:
    return F.struct(F.xxhash64(node).alias("rank"), F.col(node).alias("node"))


def _different(links: DataFrame) -> DataFrame:
    return links.filter(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every linked node: two have the same root if links connect them."""
    links = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    links = written(_different(links), "links", few=True)
    roots = None
    while roots is None or not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(_ranked("b")).alias("first"))
        first = first.select(
            F.col("a").alias("node"), F.least("first", _ranked("a"))["node"].alias("root")
        )
        first = written(first, "first", few=True)
        if roots is None:
            roots = first
        else:
            later = first.select(F.col("node").alias("root"), F.col("root").alias("later"))
            roots = roots.join(later, "root", "left")
            roots = roots.select("node", F.coalesce("later", "root").alias("root"))
        of_a = first.withColumnsRenamed({"node": "a", "root": "root_a"})
        of_b = first.withColumnsRenamed({"node": "b", "root": "root_b"})
        moved = links.join(of_a, "a").join(of_b, "b")
        moved = moved.select(
            F.greatest("root_a", "root_b").alias("a"), F.least("root_a", "root_b").alias("b")
        )
        links = written(_different(moved), "links", few=True)
    return written(roots, "roots", few=True)
