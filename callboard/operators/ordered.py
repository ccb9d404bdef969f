"""Places and predecessors within a key, for keys that may hold a large part of all rows.

A window by key sorts each key in one task.  Here rows are parted in ranges of (key, order), so a large key spans many
partitions; a window inside each partition numbers its rows, and what came before is carried over from one row for a
key and partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def placed(df: DataFrame, keys: list[str], order: list[str], before: tuple[str, ...] = ()) -> DataFrame:
    """The rows with ``nth`` (from 1) and ``total`` of their key by ``order``, ascending, and ``previous``: a struct of the columns
    ``before`` of the row just before, null for the first.

    Null keys are one key, and nulls come first.  Rows of equal order are told apart by their place in the input, so
    their numbers are distinct but depend on it.  Columns of the input named like a result give way.
    """
    results = ("nth", "total", "previous")
    df = df.drop(*(c for c in results if c not in (*keys, *order, *before)))
    tie = F.monotonically_increasing_id().alias("__tie")
    named = df.select("*", F.struct(*keys).alias("__key"), F.struct(*order).alias("__order"), tie)
    # Ranges are chosen by samples, so rows are written with the number of their partition before they are counted.
    rows = named.repartitionByRange("__key", "__order", "__tie").withColumn("__part", F.spark_partition_id()).checkpoint()
    carried = F.struct(*before) if before else F.lit(None).cast("string")
    within = Window.partitionBy("__part", "__key").orderBy("__order", "__tie")
    local = rows.withColumn("__nth", F.row_number().over(within)).withColumn("__before", F.lag(carried).over(within))
    ends = rows.groupBy("__part", "__key").agg(F.count(F.lit(1)).alias("__n"), F.max_by(carried, F.struct("__order", "__tie")).alias("__last"))
    # One row for a key and each partition that it spans.
    parts = Window.partitionBy("__key").orderBy("__part")
    earlier = F.coalesce(F.sum("__n").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("__n").over(parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    carry = ends.select("__part", "__key", earlier.alias("__earlier"), whole.alias("total"), F.lag("__last").over(parts).alias("__carried"))
    got = local.join(carry, ["__part", "__key"])
    previous = F.when(F.col("__nth") > 1, F.col("__before")).otherwise(F.col("__carried"))
    return got.select(*df.columns, (F.col("__earlier") + F.col("__nth")).alias("nth"), "total", previous.alias("previous"))
