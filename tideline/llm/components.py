"""Connected components of an edge table by alternating star contractions.

Each round links every node's larger neighbours to its smallest one, then every node's smaller neighbours to the
smallest of them, until nothing changes; then each edge leads from a node to the smallest of its component. Rounds are
joins and aggregates with map-side sums; nothing is collected but two numbers a round. Each round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import durable, look_up


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _both(edges)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return look_up(both.where("b > a"), least, "a", "b").select(F.col("m").alias("a"), "b").where("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    more = look_up(down, least, "u", "v").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b")
    return least.select(F.col("m").alias("a"), F.col("u").alias("b")).unionByName(more).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), a <> b; the root is the component's smallest node."""
    edges = durable(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    mark = None
    while True:
        edges = durable(_small_star(durable(_large_star(edges))))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
