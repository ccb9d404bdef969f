"""Lists that span pages: the order of their pages, loops and pages that no list reaches.

A page names its next page.  Steps are doubled: who is 2^k steps on is known from who is 2^(k-1) steps on, so a
list of n pages takes log n joins, whatever its loops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def walked(pages: DataFrame, starts: DataFrame, page: str = "url", following: str = "next_url", rounds: int = 40) -> DataFrame:
    """(start, page, place): the pages of each list from its start, place 0, each at its first place.

    pages: page, following (null at the end); of several next pages the least counts.  starts: start.  A next
    page that is not among the pages ends the list.
    """
    step = pages.where(F.col(following).isNotNull()).groupBy(F.col(page).alias("at")).agg(F.min(following).alias("to"))
    step = step.join(pages.select(F.col(page).alias("to")).distinct(), "to", "left_semi")
    known = pages.select(F.col(page).alias("at")).distinct()
    reached = starts.select("start", F.col("start").alias("at"), F.lit(0).alias("place")).distinct().join(known, "at", "left_semi").checkpoint()
    size, jump = reached.count(), step
    for k in range(rounds):
        further = reached.join(jump, "at").select("start", F.col("to").alias("at"), (F.col("place") + (1 << k)).alias("place"))
        grown = reached.unionByName(further).groupBy("start", "at").agg(F.min("place").alias("place")).checkpoint()
        now = grown.count()
        if now == size:
            return grown.select("start", F.col("at").alias("page"), "place")
        reached, size = grown, now
        jump = jump.join(jump.select(F.col("at").alias("to"), F.col("to").alias("then")), "to").select("at", F.col("then").alias("to")).checkpoint()
    raise RuntimeError(f"a list has more than 2^{rounds} pages")


def lists(pages: DataFrame, reached: DataFrame, page: str = "url", following: str = "next_url") -> DataFrame:
    """(start, pages, last, loop, problem) of each walked list: how many pages, the last of them, how many of them a loop
    holds (0 without one), and ``loop``, ``next_page_missing`` or null."""
    last = reached.groupBy("start").agg(F.count(F.lit(1)).alias("pages"), F.max_by("page", "place").alias("last"))
    step = pages.where(F.col(following).isNotNull()).groupBy(F.col(page).alias("last")).agg(F.min(following).alias("next"))
    back = reached.select("start", F.col("page").alias("next"), F.col("place").alias("back"))
    got = last.join(step, "last", "left").join(back, ["start", "next"], "left")
    problem = F.when(F.col("back").isNotNull(), "loop").when(F.col("next").isNotNull(), "next_page_missing")
    return got.select("start", "pages", "last", F.coalesce(F.col("pages") - F.col("back"), F.lit(0)).alias("loop"), problem.alias("problem"))


def unreached(pages: DataFrame, reached: DataFrame, page: str = "url") -> DataFrame:
    """Pages that no list comes to."""
    return pages.join(reached.select(F.col("page").alias(page)).distinct(), page, "left_anti")
