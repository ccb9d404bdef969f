"""Incidence of multi-label categories (themes, geographies) over a roster of programs.

Labels overlap, so shares of categories can add up to more than one.  Each share names its
denominator: all programs, labelled programs, or either without one source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callboard.operators.baseline import ratio

SMALL_SAMPLE = 5


def coverage(programs: DataFrame, links: DataFrame) -> DataFrame:
    """Labelled and unlabelled programs, assignments and categories, in one row."""
    inside = links.join(programs.select("program_id"), "program_id", "left_semi")
    got = inside.agg(F.count_distinct("program_id").alias("labelled"), F.count(F.lit(1)).alias("assignments"), F.count_distinct("slug").alias("categories"))
    total = programs.agg(F.count(F.lit(1)).alias("total"))
    return got.crossJoin(total).select(  # one row each
        "total", "labelled", (F.col("total") - F.col("labelled")).alias("unlabelled"), "assignments", "categories", F.bround(ratio(F.col("labelled"), F.col("total")), 12).alias("labelled_share")
    )


def incidence(programs: DataFrame, links: DataFrame) -> DataFrame:
    """Programs of every category, its shares of all and of labelled ones, and the small-sample
    flag that suppresses rankings."""
    totals = coverage(programs, links).select("total", "labelled")
    counts = links.join(programs.select("program_id"), "program_id", "left_semi").groupBy("slug").agg(F.count_distinct("program_id").alias("n"))
    return counts.crossJoin(totals).select(  # totals is one row
        "slug", "n", F.bround(ratio(F.col("n"), F.col("total")), 12).alias("share_of_all"), F.bround(ratio(F.col("n"), F.col("labelled")), 12).alias("share_of_labelled"),
        F.when(F.col("n") < SMALL_SAMPLE, "small_sample").otherwise("ok").alias("sample"),
    )


def by_source(programs: DataFrame, links: DataFrame) -> DataFrame:
    """(slug, source_key, n): distinct programs of each category in each source that has any."""
    return links.join(programs.select("program_id", "source_key"), "program_id").groupBy("slug", "source_key").agg(F.count_distinct("program_id").alias("n"))


def leave_one_out(programs: DataFrame, links: DataFrame) -> DataFrame:
    """Each category's share without each source, both in the count and in the denominator.

    One row per category and source; programs belong to one source, so counts subtract.
    """
    pair = F.struct("source_key", "n")
    categories = by_source(programs, links).groupBy("slug").agg(F.sum("n").alias("n_all"), F.map_from_entries(F.collect_list(pair)).alias("by_source"))
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sizes = programs.groupBy("source_key").agg(F.count_distinct("program_id").alias("size")).withColumn("total", F.sum("size").over(whole))
    # Categories and sources are dictionaries, and the result itself has a row for each pair.
    rows = categories.join(sizes)
    left, rest = F.col("n_all") - F.coalesce(F.col("by_source")[F.col("source_key")], F.lit(0)), F.col("total") - F.col("size")
    return rows.select("slug", "source_key", left.alias("n_without"), rest.alias("total_without"), F.bround(ratio(left, rest), 12).alias("share_without"))
