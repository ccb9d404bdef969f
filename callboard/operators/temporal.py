"""Weekly change indicators over snapshots of a roster.

A series has at most one snapshot a week: the latest of its cohort.  Every requested week has a
row; a week without a snapshot says so instead of giving zeros.  Change is measured against the
latest earlier snapshot of the cohort, found by a window over the selected weeks, and memberships
are compared by one full outer join on (week, entity), all weeks at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callboard.operators.baseline import ratio

MAX_WEEKS = 520


def week_start(ts: Column) -> Column:
    """The Monday of the week, as a date."""
    return F.date_trunc("week", ts).cast("date")


def weekly_latest(snapshots: DataFrame, cohort: list[str]) -> DataFrame:
    """The latest snapshot of every cohort and week (ties by id), and how many it stands for."""
    weekly = snapshots.withColumn("week_start", week_start(F.col("as_of")))
    latest = F.max_by(F.struct(*weekly.columns), F.struct("as_of", "snapshot_id")).alias("__latest")
    return weekly.groupBy(*cohort, "week_start").agg(latest, (F.count(F.lit(1)) - 1).alias("omitted")).select("__latest.*", "omitted")


def calendar(edges: DataFrame) -> DataFrame:
    """(week_start) for every week from ``first`` to ``last`` of a one-row frame; over
    ``MAX_WEEKS`` weeks are an error."""
    weeks = F.sequence(week_start(F.col("first")), week_start(F.col("last")), F.expr("interval 7 days"))
    checked = F.when(F.size(weeks) > MAX_WEEKS, F.raise_error(F.lit(f"time-series range cannot exceed {MAX_WEEKS} weeks")).cast("array<date>")).otherwise(weeks)
    return edges.select(F.explode(checked).alias("week_start"))


def series(weeks: DataFrame, latest: DataFrame, cohort: list[str]) -> DataFrame:
    """Calendar weeks with their snapshot, the one before it, and the weeks between them."""
    order = Window.partitionBy(*cohort).orderBy("week_start") if cohort else Window.orderBy("week_start")
    linked = latest.withColumn("previous_week", F.lag("week_start").over(order))
    rows = weeks.join(linked, "week_start", "left")
    gap = F.greatest(F.lit(0), (F.date_diff("week_start", "previous_week") / 7).cast("long") - 1)
    return rows.withColumn("status", F.when(F.col("snapshot_id").isNull(), "no_snapshot").when(F.col("previous_week").isNull(), "no_prior_snapshot").otherwise("computed")).withColumn("gap_weeks", F.when(F.col("previous_week").isNotNull(), gap))


def intervals(rows: DataFrame, requested: DataFrame) -> DataFrame:
    """``series`` rows (one cohort) with what a point says of its interval: ``partial`` where the week
    runs out of the requested days, ``interval_seconds`` since the snapshot before, and a warning
    where weeks between them have none.  requested: one row (first, last)."""
    edges = requested.select(F.col("first").cast("date").alias("__from"), F.col("last").cast("date").alias("__to"))
    before = F.lag("as_of").over(Window.orderBy("week_start"))  # one row per snapshot of the series, 520 weeks at most
    taken = rows.where("snapshot_id is not null").select("week_start", before.alias("__before"))
    seconds = F.round((F.unix_micros(F.col("as_of").cast("timestamp")) - F.unix_micros(F.col("__before").cast("timestamp"))) / 1e6, 3)
    partial = (F.col("week_start") < F.col("__from")) | (F.date_add("week_start", 6) > F.col("__to"))
    got = rows.join(taken, "week_start", "left").crossJoin(F.broadcast(edges))  # one row
    return got.withColumns({"partial": partial, "interval_seconds": seconds, "warning": F.when(F.col("gap_weeks") > 0, "snapshot_gap_no_interpolation")}).drop("__before", "__from", "__to")


def paired(members: DataFrame, links: DataFrame, attributes: list[str]) -> DataFrame:
    """Members of each week next to those of the week before it: (week_start, entity, in_now,
    in_before, and each attribute as name, name_before).

    links: (week_start, previous_week).  A full outer join, so that one side may lack the entity.
    """
    now = members.select("week_start", "entity", F.lit(True).alias("in_now"), *attributes)
    shifted = members.withColumnRenamed("week_start", "previous_week").join(F.broadcast(links.select("week_start", "previous_week")), "previous_week")
    before = shifted.select("week_start", "entity", F.lit(True).alias("in_before"), *(F.col(a).alias(f"{a}_before") for a in attributes))
    rows = now.join(before, ["week_start", "entity"], "full_outer")
    return rows.withColumn("in_now", F.coalesce("in_now", F.lit(False))).withColumn("in_before", F.coalesce("in_before", F.lit(False)))


def changes(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Stock, newly observed, removed, and the union that they are measured over, per week; null
    against no week before, never zero."""
    first = F.col("previous_week").isNull()
    got = pairs.groupBy("week_start").agg(
        F.count_if("in_now").alias("stock"), F.count_if(F.col("in_now") & ~F.col("in_before")).alias("newly"), F.count_if(~F.col("in_now") & F.col("in_before")).alias("removed"), F.count(F.lit(1)).alias("sample_size")
    )
    return links.select("week_start", "previous_week").join(got, "week_start", "left").select(
        "week_start", "previous_week", "stock", F.when(~first, F.col("newly")).alias("newly_observed"), F.when(~first, F.col("removed")).alias("removed"), F.when(~first, F.col("sample_size")).alias("sample_size")
    )


def attribute_changes(pairs: DataFrame, attributes: list[str]) -> DataFrame:
    """Per week, the entities of both snapshots whose attribute differs (nulls are values), for
    every attribute and for any of them."""
    both = pairs.where("in_now and in_before")
    differs = {a: ~F.col(a).eqNullSafe(F.col(f"{a}_before")) for a in attributes}
    any_ = F.lit(False)
    for d in differs.values():
        any_ = any_ | d
    return both.groupBy("week_start").agg(F.count(F.lit(1)).alias("compared"), *(F.count_if(d).alias(f"{a}_changes") for a, d in differs.items()), F.count_if(any_).alias("any_change"))


def deadline_state(deadline: Column, on: Column) -> Column:
    return F.when(deadline.isNull(), "missing").when(deadline < on, "overdue").otherwise("upcoming_or_today")


def deadline_states(members: DataFrame) -> DataFrame:
    """(week_start, state, n) of the members' deadlines, each state a row in every week that has members.

    members: week_start, entity, deadline_state."""
    states = F.explode(F.array(*map(F.lit, ("missing", "overdue", "upcoming_or_today"))))
    counts = members.groupBy("week_start", F.col("deadline_state").alias("state")).agg(F.count(F.lit(1)).alias("n"))
    return members.select("week_start").distinct().select("week_start", states.alias("state")).join(counts, ["week_start", "state"], "left").select("week_start", "state", F.coalesce("n", F.lit(0)).alias("n"))


def state_transitions(pairs: DataFrame, state: str) -> DataFrame:
    """(week_start, before, now, n) of entities of both snapshots whose state moved."""
    moved = pairs.where("in_now and in_before").where(~F.col(state).eqNullSafe(F.col(f"{state}_before")))
    return moved.groupBy("week_start", F.col(f"{state}_before").alias("before"), F.col(state).alias("now")).agg(F.count(F.lit(1)).alias("n"))


def category_points(members: DataFrame, links: DataFrame) -> DataFrame:
    """Count and share of every category in every week over the cohort-wide roster, so a category
    has a row of 0 before it first appears.  members: (week_start, entity, category)."""
    roster = members.select("category").distinct()
    stock = members.groupBy("week_start").agg(F.count_distinct("entity").alias("stock"))
    counts = members.groupBy("week_start", "category").agg(F.count_distinct("entity").alias("n"))
    grid = links.select("week_start").join(roster)  # the result has a row for each pair
    rows = grid.join(counts, ["week_start", "category"], "left").join(stock, "week_start", "left")
    n = F.coalesce("n", F.lit(0))
    return rows.select("week_start", "category", n.alias("n"), F.bround(ratio(n, F.col("stock")), 12).alias("share"))
