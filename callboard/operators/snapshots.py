"""Freezing a roster: eligibility with reasons, fingerprints, and writing each snapshot once."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callboard.operators.baseline import exclusion_reason


def eligibility(programs: DataFrame, as_of: Column) -> DataFrame:
    """Programs with ``exclusion_reason``, the first rule they fail, or null.

    programs: publication_status, published_at, updated_at, source_bucket, observed_at.
    """
    rules = [
        ("not_published", ~F.coalesce(F.col("publication_status") == "published", F.lit(False))),
        ("published_after_as_of", F.coalesce(F.col("published_at") > as_of, F.lit(False))),
        ("updated_after_as_of", F.coalesce(F.col("updated_at") > as_of, F.lit(False))),
        ("source_not_active", ~F.coalesce(F.col("source_bucket") == "active", F.lit(False))),
        ("observed_after_as_of", F.coalesce(F.col("observed_at") > as_of, F.lit(False))),
    ]
    return programs.withColumn("exclusion_reason", exclusion_reason(rules))


def exclusions(marked: DataFrame) -> DataFrame:
    """(reason, n) of excluded rows."""
    return marked.where("exclusion_reason is not null").groupBy(F.col("exclusion_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def source_scope(sources: DataFrame, registry: DataFrame) -> DataFrame:
    """(canonical_url, bucket, reason) of every source: its registry row's, or excluded as
    ``unregistered`` without one."""
    known = source_bucket(registry).select("canonical_url", "bucket", "reason")
    got = sources.select("canonical_url").distinct().join(known, "canonical_url", "left")
    return got.select("canonical_url", F.coalesce("bucket", F.lit("excluded")).alias("bucket"), F.when(F.col("bucket").isNull(), "unregistered").otherwise(F.col("reason")).alias("reason"))


def class_counts(snapshots: DataFrame, known: tuple[str, ...], column: str = "data_class") -> DataFrame:
    """(data_class, snapshots): counts of the known classes, all others as ``unknown``."""
    return snapshots.groupBy(F.when(F.col(column).isin(*known), F.col(column)).otherwise("unknown").alias("data_class")).agg(F.count(F.lit(1)).alias("snapshots"))


def source_bucket(registry: DataFrame) -> DataFrame:
    """Registry rows with ``bucket`` (active, program, excluded) and the reason of exclusion."""
    reason = F.when(F.col("access_method") == "fixture", "fixture").when(F.col("status") != "active", "inactive").when(F.col("protocol_excluded"), "protocol_excluded")
    return registry.withColumn("reason", reason).withColumn("bucket", F.when(reason.isNotNull(), "excluded").when(F.col("holds_programs"), "program").otherwise("active"))


def roster_fingerprint(programs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(snapshot_id, programs, fingerprint): one hash per snapshot, independent of row order.

    Rows are hashed alone; the hashes, as numbers, are summed modulo 2**61 - 1 in three lanes, which
    partial aggregation handles without gathering the roster.
    """
    body = F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(columns)))), 256)
    lanes = [F.sum(F.conv(F.substring(body, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")) % F.lit(2305843009213693951).cast("decimal(38,0)") for k in range(3)]
    got = programs.groupBy(key).agg(F.count(F.lit(1)).alias("programs"), *(lane.alias(f"lane{k}") for k, lane in enumerate(lanes)))
    return got.select(key, "programs", F.sha2(F.concat_ws("|", F.col("programs"), "lane0", "lane1", "lane2"), 256).alias("fingerprint"))


def snapshot_uuid(fingerprint: str, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> str:
    return str(uuid.uuid5(namespace, fingerprint))


def append_once(new: DataFrame, path: str, key: str = "fingerprint", folders: tuple[str, ...] = ()) -> DataFrame:
    """Appends rows whose fingerprint the table at ``path`` lacks, each fingerprint once; returns what
    was new.  One writer at a time: two that run together may both append a fingerprint."""
    spark = new.sparkSession
    try:
        known = spark.read.schema(new.schema).parquet(path).select(key)
        known.limit(1).count()
    except Exception as e:  # the table may not exist yet; anything else is an error
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = new.select(key).limit(0)
    fresh = new.dropDuplicates([key]).join(known, key, "left_anti").select(new.columns).checkpoint()
    fresh.write.mode("append").partitionBy(*folders).parquet(path)
    return fresh
