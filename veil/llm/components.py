"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.llm.common import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Every node points its larger neighbours at the least node it knows."""
    both = links.union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every node points its smaller neighbours, and itself, at the least of them. Links run from larger to smaller."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component) for every node that `links` (a, b) mention; component: the least `least` of its members.

    `nodes` has a `least` value for each node (an id that names it). Ends when a round changes no link: then every
    node points at the least node of its component. A hot node is no hot group: least neighbours are aggregated on the
    map side, and joins with them are split or broadcast by Spark.
    """
    stars = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    seen = None
    while True:
        state = stars.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if not state["n"] or state == seen:
            break
        seen = state
        stars = stored(_small_star(_large_star(stars)), "stars")
    members = stars.union(stars.select("b", "b")).distinct().toDF("node", "root")
    named = members.join(nodes.select("node", "least"), "node")
    names = named.groupBy("root").agg(F.min("least").alias("component"))
    return named.join(names, "root").select("node", "component")
