"""Bipartite graphs of sources and what they hold (programs, themes, geographies)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callboard.operators.baseline import ratio
from callboard.operators.graph import connected_components, numbered

LEAST_SOURCES, LEAST_RIGHT = 3, 5


def edges(links: DataFrame) -> DataFrame:
    """(src, dst, weight): weight is the number of distinct programs behind the pair."""
    return links.groupBy("src", "dst").agg(F.count_distinct("program_id").alias("weight"))


def node_metrics(edge: DataFrame, sources: DataFrame) -> DataFrame:
    """Degree, strength and degree centrality of every node; sources without edges stay.

    Centrality divides by the other side's size, and is null when that side is empty.
    """
    left = edge.groupBy("src").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))
    left = sources.select("src").join(left, "src", "left").select(F.lit("source").alias("side"), F.col("src").cast("string").alias("node"), F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("strength", F.lit(0)).alias("strength"))
    right = edge.groupBy("dst").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength")).select(F.lit("target").alias("side"), F.col("dst").cast("string").alias("node"), "degree", "strength")
    nodes = left.unionByName(right)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sizes = nodes.groupBy("side").agg(F.count(F.lit(1)).alias("n")).withColumn("others", F.sum("n").over(whole) - F.col("n"))
    return nodes.join(F.broadcast(sizes.select("side", "others")), "side").select("side", "node", "degree", "strength", ratio(F.col("degree"), F.col("others")).alias("centrality"))


def density(edge: DataFrame, sources: DataFrame) -> DataFrame:
    """Edges, nodes of each side, density, and the small-graph warning, in one row."""
    got = edge.agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("dst").alias("targets")).crossJoin(sources.agg(F.count_distinct("src").alias("sources")))  # one row each
    small = (F.col("sources") < LEAST_SOURCES) | (F.col("targets") < LEAST_RIGHT)
    return got.select("edges", "sources", "targets", ratio(F.col("edges"), F.col("sources") * F.col("targets")).alias("density"), small.alias("small_graph"))


def components(edge: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, component, number): nodes are ``s:`` and ``t:`` names; a component is its smallest
    node, and numbers follow that order.  Sources without edges are components of their own."""
    named = edge.select(F.concat(F.lit("s:"), F.col("src").cast("string")).alias("src"), F.concat(F.lit("t:"), F.col("dst").cast("string")).alias("dst"))
    alone = sources.select(F.concat(F.lit("s:"), F.col("src").cast("string")).alias("src")).join(named.select("src").distinct(), "src", "left_anti")
    got = connected_components(named).unionByName(alone.select(F.col("src").alias("node"), F.col("src").alias("component")))
    return got.join(numbered(got.select("component").distinct(), "component"), "component").select("node", "component", "number")


def summaries(links: DataFrame, key: str) -> DataFrame:
    """(key, nodes, edges, density, components, small_graph) of the graph of every key (a snapshot or a
    week), all graphs at once.  links: key, src, dst; repeated links count once."""
    edge = links.select(key, "src", "dst").distinct()
    sizes = edge.groupBy(key).agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"))
    name = lambda side, c: F.concat_ws("\x1f", F.lit(side), F.col(key).cast("string"), F.col(c).cast("string"))
    heads = connected_components(edge.select(name("s", "src").alias("src"), name("t", "dst").alias("dst"))).select("component").distinct()
    counts = heads.groupBy(F.split_part("component", F.lit("\x1f"), F.lit(2)).alias("__key")).agg(F.count(F.lit(1)).alias("components"))
    got = sizes.join(counts, F.col(key).cast("string") == F.col("__key"))
    small = (F.col("sources") < LEAST_SOURCES) | (F.col("targets") < LEAST_RIGHT)
    return got.select(key, (F.col("sources") + F.col("targets")).alias("nodes"), "edges", ratio(F.col("edges"), F.col("sources") * F.col("targets")).alias("density"), "components", small.alias("small_graph"))
