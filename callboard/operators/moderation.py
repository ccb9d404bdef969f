"""Journals of ingestion: where an issue comes from, what a run did, what waits for a person."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callboard.operators.baseline import ratio


def provenance(issues: DataFrame, records: DataFrame, captures: DataFrame, runs: DataFrame, sources: DataFrame) -> DataFrame:
    """(issue_id, record_id, capture_id, run_id, source_id) along the chain of keys; an issue whose chain
    breaks drops out.  Each table holds its own id and the next one's."""
    chain = issues.select("issue_id", "record_id")
    for table, key, further in ((records, "record_id", "capture_id"), (captures, "capture_id", "run_id"), (runs, "run_id", "source_id")):
        chain = chain.join(table.select(key, further), key)
    return chain.join(sources.select("source_id"), "source_id").select("issue_id", "record_id", "capture_id", "run_id", "source_id")


def with_counts(parents: DataFrame, key: str, **children: DataFrame) -> DataFrame:
    """Parents with the number of rows of each child table, 0 without any; each child is counted
    before it meets the parents."""
    out = parents
    for name, child in children.items():
        out = out.join(child.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def journal(rows: DataFrame, at: str, key: str, limit: int, source: str | None = None) -> DataFrame:
    """The latest rows of a log, of one source or of all."""
    kept = rows if source is None else rows.where(F.col("source_id") == source)
    return kept.orderBy(F.desc(at), key).limit(limit)


def subjects(cases: DataFrame, **kinds: DataFrame) -> DataFrame:
    """Cases (subject_type, subject_id) with ``reference``, from the table (id, reference) of their
    type; null where the type or the id is unknown."""
    out, found = cases, []
    for kind, table in kinds.items():
        t = table.select(F.col("id").alias(f"__{kind}"), F.col("reference").alias(f"__{kind}_reference"))
        out = out.join(t, (F.col("subject_type") == kind) & (F.col("subject_id") == F.col(f"__{kind}")), "left")
        found.append(f"__{kind}_reference")
    return out.withColumn("reference", F.coalesce(*found)).select(*cases.columns, "reference")


def match_targets(matches: DataFrame, staged: DataFrame, programs: DataFrame) -> DataFrame:
    """Matches (target_kind, target_id) with the target's title and state, from staged records or
    programs (id, title, state)."""
    found = {k: t.select("id", F.struct("title", "state").alias("reference")) for k, t in (("staged", staged), ("program", programs))}
    got = subjects(matches.withColumnsRenamed({"target_kind": "subject_type", "target_id": "subject_id"}), **found)
    back = got.withColumnsRenamed({"subject_type": "target_kind", "subject_id": "target_id"})
    return back.select(*matches.columns, F.col("reference.title").alias("title"), F.col("reference.state").alias("state"))


def run_quality(resources: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Per run: discovered, extracted, valid and repeated rows, and their ratios; a ratio without a
    denominator is null.

    resources: key, last_modified_at (of the discovered pages).  rows: key, is_valid, is_duplicate.
    Completeness compares valid rows with what was discovered, or with themselves where a page gave
    several; freshness is the share of pages that say when they changed.
    """
    seen = resources.groupBy(key).agg(F.count(F.lit(1)).alias("discovered"), F.count("last_modified_at").alias("dated"), F.max("last_modified_at").alias("newest_at"))
    read = rows.groupBy(key).agg(F.count(F.lit(1)).alias("extracted"), F.count_if("is_valid").alias("valid"), F.count_if("is_duplicate").alias("repeated"))
    got = seen.join(read, key, "full_outer").fillna(0, ["discovered", "dated", "extracted", "valid", "repeated"])
    c = F.col
    return got.select(
        key, "discovered", "extracted", "valid", "repeated", ratio(c("valid"), F.greatest("discovered", "valid")).alias("completeness"), ratio(c("valid"), c("extracted")).alias("validity"),
        ratio(c("repeated"), c("extracted")).alias("duplicate_rate"), ratio(c("dated"), c("discovered")).alias("freshness"), "newest_at",
    )


def field_errors(issues: DataFrame, key: str) -> DataFrame:
    """(key, field, errors): errors by the field that they name; warnings and others do not count."""
    return issues.where("severity = 'error' and field is not null").groupBy(key, "field").agg(F.count(F.lit(1)).alias("errors"))


def waiting() -> Column:
    return F.col("status").isin("open", "needs_clarification")


def queue_sizes(canonical: DataFrame, discovery: DataFrame) -> DataFrame:
    """One row: cases that wait for a person, of each queue and in all."""
    both = canonical.select("status", F.lit("canonical").alias("queue")).unionByName(discovery.select("status", F.lit("discovery").alias("queue"))).where(waiting())
    return both.agg(F.count_if(F.col("queue") == "canonical").alias("canonical"), F.count_if(F.col("queue") == "discovery").alias("discovery"), F.count(F.lit(1)).alias("total"))
