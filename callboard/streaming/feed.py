"""Message feeds with Structured Streaming: cursors, de-duplication, url state, expiry, weeks.

Each function works on a streaming frame and, where it says so, on a batch one alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from callboard.operators import ordered


def messages(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    """Messages from a folder that grows."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def after_cursor(feed: DataFrame, cursors: DataFrame) -> DataFrame:
    """Messages beyond their source's high-water mark; a source without one starts at the top.
    Works on batches and, with a static cursor table, on streams."""
    got = feed.join(cursors.select("source_id", "high_water"), "source_id", "left")
    return got.where(F.col("message_id") > F.coalesce("high_water", F.lit(-1))).drop("high_water")


def new_cursors(feed: DataFrame, cursors: DataFrame) -> DataFrame:
    """High-water marks after a batch; they never go back."""
    seen = feed.groupBy("source_id").agg(F.max("message_id").alias("seen"))
    return cursors.join(seen, "source_id", "full_outer").select("source_id", F.greatest("high_water", "seen").alias("high_water"))


def once(feed: DataFrame, delay: str = "7 days") -> DataFrame:
    """The first message of each (source, id); state older than the delay is dropped."""
    return feed.withWatermark("published_at", delay).dropDuplicatesWithinWatermark(["source_id", "message_id"])


def observations(feed: DataFrame, key: tuple[str, ...] = ("source_id", "message_id"), at: str = "observed_at") -> DataFrame:
    """Every sight of every message with ``sight`` from 1, and whether it is the first, whose provenance
    is kept; later ones are only noted.  A batch; ties go by the smallest row."""
    rest = [c for c in feed.columns if c not in (*key, at)]
    got = ordered.placed(feed, list(key), [at, *rest])
    return got.select(*feed.columns, F.col("nth").alias("sight"), (F.col("nth") == 1).alias("is_first"))


def delivered(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Deliveries with ``outcome``: run, skipped where their source had the fingerprint before (in
    ``known`` or earlier in the batch), or empty for a poll without messages, which is never a repeat.

    batch: source_id, fingerprint, messages, at (distinct within a source and fingerprint); known: source_id,
    fingerprint.
    """
    first = batch.where("messages > 0").groupBy("source_id", "fingerprint").agg(F.min("at").alias("__first"))
    seen = known.select("source_id", "fingerprint", F.lit(True).alias("__known")).distinct()
    got = batch.join(first, ["source_id", "fingerprint"], "left").join(seen, ["source_id", "fingerprint"], "left")
    outcome = F.when(F.col("messages") == 0, "empty").when(F.col("__known") | (F.col("at") > F.col("__first")), "skipped").otherwise("run")
    return got.withColumn("outcome", outcome).select(*batch.columns, "outcome")


def weekly(feed: DataFrame, delay: str = "7 days") -> DataFrame:
    """Messages, and the last of them, in weeks that begin on Monday; batch or stream."""
    frame = F.window("published_at", "7 days", startTime="4 days")
    source = feed.withWatermark("published_at", delay) if feed.isStreaming else feed
    return source.groupBy(frame.alias("w"), "source_id").agg(F.count(F.lit(1)).alias("messages"), F.max("published_at").alias("last_at")).select(F.col("w.start").cast("date").alias("week_start"), "source_id", "messages", "last_at")


def seen_state(feed: DataFrame, key: str, at: str, keep_days: int = 30) -> DataFrame:
    """First and last sight, number of sights and expiry per key, from a batch."""
    got = feed.groupBy(key).agg(F.min(at).alias("first_seen_at"), F.max(at).alias("last_seen_at"), F.count(F.lit(1)).alias("seen_count"))
    return got.withColumn("expires_at", F.col("last_seen_at") + F.make_dt_interval(F.lit(keep_days)))


SEEN = "key string, first_seen_at timestamp, last_seen_at timestamp, seen_count long, expires_at timestamp"


def seen_stream(feed: DataFrame, key: str, at: str, keep_days: int = 30) -> DataFrame:
    """``seen_state`` over a stream, kept as state per key and dropped when it expires."""

    def fold(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first, last, n = state.get if state.exists else (None, None, 0)
        for pdf in parts:
            low, high = pdf[at].min(), pdf[at].max()
            first = low if first is None or low < first else first
            last = high if last is None or high > last else last
            n += len(pdf)
        state.update((first, last, n))
        expires = last + pd.Timedelta(days=keep_days)
        state.setTimeoutTimestamp(max(int(expires.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [str(keys[0])], "first_seen_at": [first], "last_seen_at": [last], "seen_count": [n], "expires_at": [expires]})

    rows = feed.withWatermark(at, f"{keep_days} days").groupBy(key)
    return rows.applyInPandasWithState(fold, SEEN, "first timestamp, last timestamp, n long", "update", GroupStateTimeout.EventTimeTimeout)


def merge_into(path: str, key: str, checkpoint: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that appends rows with new keys only, so a batch that is delivered
    again adds nothing; every batch is kept in a folder of its number."""

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates([key])
        try:
            known = spark.read.option("basePath", path).parquet(path).where(F.col("batch") != number).select(key)
            rows = rows.join(known, key, "left_anti")
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
        checkpoint(rows).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sink


def unexpired(rows: DataFrame, at: str, now, keep_days: int) -> DataFrame:
    """Rows within the retention window; rows dated later than ``now`` stay out too."""
    return rows.where((F.col(at) >= now - F.make_dt_interval(F.lit(keep_days))) & (F.col(at) <= now))
