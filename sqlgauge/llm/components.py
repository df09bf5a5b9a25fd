"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlgauge.llm import work


def _lower(pairs: DataFrame) -> DataFrame:
    """Each node with the smallest node it meets in ``pairs`` (u, v), itself included."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    """Ties the larger neighbours of each node to the smallest node around it."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    return both.join(_lower(both), "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Ties each node and its smaller neighbours to the smallest of them. Links come as a > b."""
    down = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return tied.union(least.select("u", "m"))


def _state(links: DataFrame) -> tuple:
    total = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    return tuple(links.agg(F.count("*"), total).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of the links (a, b); root is the smallest node that can be reached.

    Alternates large and small stars until the links no longer change, about log n rounds. Every round is a written
    table of distinct links, never more than there were at first. The join of a node's links with its smallest neighbour
    is one that Spark splits where a node has very many of them. Links that are null or from a node to itself are left out.
    """
    links = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = work.written(links, "links")
    state = _state(links)
    while state[0]:
        links = work.written(_small_star(_large_star(links).distinct()).distinct(), "links")
        before, state = state, _state(links)
        if state == before:
            break
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(links.select("b", "b").distinct())
