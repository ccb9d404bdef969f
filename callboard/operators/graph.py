"""Connected components over an edge list of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, column: str, number: str = "number") -> DataFrame:
    """The rows with their place, from 1, in the order of a column of distinct values.

    Rows are range-partitioned and counted within their partition; only the partitions' counts, one
    row each, are added up in one place.
    """
    order = Window.partitionBy("__part").orderBy(column)
    ranged = rows.repartitionByRange(column).withColumn("__part", F.spark_partition_id()).withColumn("__place", F.row_number().over(order)).checkpoint()
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return ranged.join(F.broadcast(before), "__part").select(*(f"`{c}`" for c in rows.columns), (F.col("__place") + F.col("__before")).alias(number))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable from every node of an edge.

    Each round takes the least label among a node's neighbours, then follows that label's own
    label, so paths shorten geometrically.  Lineage is cut by ``checkpoint`` once a round, and
    the loop ends when no label moves.  Both directions of an edge are kept; a hub is reduced
    by map-side ``min`` and its side of the join can be split by the skew-join rule.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null").checkpoint()
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct().checkpoint()
    loops = pairs.where("a = b").select(F.col("a").alias("node")).distinct()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")).checkpoint()
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        stepped = labels.join(near, F.col("node") == F.col("a"), "left").select("node", "component", F.least("component", F.coalesce("near", "component")).alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("further"))
        new = (
            stepped.join(jump, "low", "left")
            .select("node", F.least("low", F.coalesce("further", "low")).alias("component"), (F.coalesce("further", "low") < F.col("component")).alias("moved"))
            .checkpoint()
        )
        labels = new.select("node", "component")
        if new.where("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"labels still move after {rounds} rounds")
    return labels.unionByName(loops.join(labels, "node", "left_anti").select("node", F.col("node").alias("component")))
