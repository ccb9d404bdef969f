"""Tidy metrics: one row per documented metric, ready to be joined to its definition and exported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callboard.operators import baseline
from callboard.schemas import MISSING, NUMERIC_KINDS

COLUMNS = ("metric_key", "value_num", "numerator", "denominator", "sample_size", "status")
QUARTILE_NAMES = (("q25", "Q25"), ("median", "median"), ("q75", "Q75"))


def _row(key: Column | str, value: Column, numerator: Column | None = None, denominator: Column | None = None, sample: Column | None = None) -> Column:
    none = F.lit(None).cast("long")
    key = F.lit(key) if isinstance(key, str) else key
    status = F.when(value.isNull(), "not_computed").otherwise("computed")
    return F.struct(
        key.alias("metric_key"), value.cast("double").alias("value_num"), (none if numerator is None else numerator.cast("long")).alias("numerator"),
        (none if denominator is None else denominator.cast("long")).alias("denominator"), (none if sample is None else sample.cast("long")).alias("sample_size"), status.alias("status"),
    )


def _tidy(df: DataFrame, *rows: Column) -> DataFrame:
    return df.select(F.explode(F.array(*rows)).alias("m")).select("m.*")


def baseline_metrics(programs: DataFrame, sources: DataFrame, executions: DataFrame, as_of: Column) -> DataFrame:
    """All baseline metrics but the intervals: counts and shares of sources, funding shares and
    quartiles, deadline shares and quartiles, and execution coverage."""
    c = F.col
    shares = baseline.source_shares(sources, programs)
    out = _tidy(shares, _row(F.concat(F.lit("opportunities.source."), "source_key", F.lit(".count")), c("n"), sample=c("total")), _row(F.concat(F.lit("opportunities.source."), "source_key", F.lit(".share")), c("share"), c("n"), c("total"), c("total")))
    state = F.coalesce("value_kind", F.lit(MISSING))
    funding = programs.agg(F.count(F.lit(1)).alias("n"), F.count_if(state != MISSING).alias("records"), F.count_if(state.isin(*NUMERIC_KINDS)).alias("numeric"))
    out = out.unionByName(
        _tidy(
            funding, _row("opportunities.count", c("n"), sample=c("n")), _row("funding.record_share", baseline.ratio(c("records"), c("n")), c("records"), c("n"), c("n")),
            _row("funding.numeric_share", baseline.ratio(c("numeric"), c("n")), c("numeric"), c("n"), c("n")),
        )
    )
    money = baseline.quartiles(baseline.funding_measures(programs), ["currency_code", "value_kind", "measure"], "amount")
    prefix = F.concat_ws(".", F.lit("funding.quantile"), "currency_code", "value_kind", "measure")
    out = out.unionByName(_tidy(money, *(_row(F.concat(prefix, F.lit(f".{name}")), c(q), sample=c("n")) for q, name in QUARTILE_NAMES)))
    d = baseline.deadline_metrics(programs, as_of)
    out = out.unionByName(
        _tidy(
            d, _row("deadlines.presence_share", c("presence_share"), c("present"), c("total"), c("total")), _row("deadlines.upcoming_share", c("upcoming_share"), c("upcoming"), c("total"), c("total")),
            _row("deadlines.overdue_count", c("overdue"), sample=c("total")), *(_row(f"deadlines.days.{name}", c(f"days_{q}"), sample=c("upcoming")) for q, name in QUARTILE_NAMES),
        )
    )
    covered = baseline.execution_coverage(sources, executions)
    return out.unionByName(_tidy(covered, _row(F.concat(F.lit("source.execution_coverage."), "source_key"), c("covered"), sample=c("executions"))))


def chart_series(metrics: DataFrame, prefix: str, suffix: str) -> DataFrame:
    """(label, value) of metrics whose keys have the prefix and suffix; the label is what is between."""
    key = F.col("metric_key")
    rows = metrics.where(key.startswith(prefix) & key.endswith(suffix))
    return rows.select(F.substring(key, F.lit(len(prefix) + 1), F.char_length(key) - len(prefix) - len(suffix)).alias("label"), F.col("value_num").alias("value"))


def compatibility(snapshots: DataFrame, reference: dict[str, str]) -> DataFrame:
    """Snapshots with ``reasons`` why they cannot be compared with the reference, and what metrics
    their version allows.  reference: column -> required value."""
    reasons = F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.lit(v)), F.lit(f"{c}_differs")) for c, v in reference.items())))
    taxonomy = F.coalesce(F.col("calculation_version") >= "v3", F.lit(False))
    return snapshots.withColumn("reasons", reasons).withColumn("is_compatible", F.size("reasons") == 0).withColumn("has_regional", taxonomy).withColumn("has_network", taxonomy)


def inconsistent(stored: DataFrame, recomputed: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Metrics that recomputation does not give again: missing on a side, or a different value."""
    both = stored.select("metric_key", F.col("value_num").alias("stored")).join(recomputed.select("metric_key", F.col("value_num").alias("recomputed")), "metric_key", "full_outer")
    return both.where(F.coalesce(F.abs(F.col("stored") - F.col("recomputed")) > tolerance, ~F.col("stored").eqNullSafe(F.col("recomputed"))))


def insights(regions: DataFrame, topics: DataFrame, sources: DataFrame) -> DataFrame:
    """Sentences from the first row of three rankings (name, value)."""
    rows = None
    for text, df in (("%s leads the regions with %d programs.", regions), ("%s is the widest topic with %d programs.", topics), ("%s publishes most: %d programs.", sources)):
        one = df.orderBy(F.desc("value"), "name").limit(1).select(F.format_string(text, "name", "value").alias("sentence"))
        rows = one if rows is None else rows.unionByName(one)
    return rows
