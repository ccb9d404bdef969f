"""The state of every url of a feed: first and last sight, number of sights, current route, and expiry.

Each key has one value of state and one event-time timer.  A sight moves the timer on; when the watermark passes it, the url
expires: its last row says so and its state is dropped.  Needs the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Times are microseconds: whether workers see a zone does not matter.
STATE = "first long, last long, seen long, route string, routed long"
OUT = "url string, first long, last long, seen long, route string, expires long, is_expired boolean"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class UrlState(StatefulProcessor):
    """Rows of (url, at, route, microseconds of at); a null route leaves the one before."""

    def __init__(self, keep_days: int):
        self.keep = keep_days * 86_400_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("sights", STATE)

    def _row(self, url: str, state: tuple, expired: bool) -> Row:
        first, last, n, route, _ = state
        return Row(url=url, first=first, last=last, seen=n, route=route, expires=last + self.keep, is_expired=expired)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first, last, n, route, routed = self.state.get() if self.state.exists() else (None, None, 0, None, None)
        for _, _, route_now, at in rows:
            first = at if first is None else min(first, at)
            last = at if last is None else max(last, at)
            n += 1
            if route_now is not None and (routed is None or (at, route_now) >= (routed, route)):
                route, routed = route_now, at
        state = (first, last, n, route, routed)
        self.state.update(state)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        # The watermark is past this time only when no later sight can come in time.
        self.handle.registerTimer((last + self.keep) // 1000)
        yield self._row(key[0], state, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.state.exists():
            yield self._row(key[0], self.state.get(), True)
            self.state.clear()


def url_states(feed: DataFrame, keep_days: int = 30, delay: str = "1 day") -> DataFrame:
    """A streaming frame of the states that each batch changes.  feed: url, at, route.

    A sight later than ``delay`` after the watermark is dropped; null urls and times are no sights.  A url that is seen
    again after it expired begins anew.
    """
    provider = feed.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass")
    if provider != PROVIDER:
        raise ValueError(f"spark.sql.streaming.stateStore.providerClass must be {PROVIDER}")
    rows = feed.where("url is not null and at is not null").select("url", "at", "route", F.unix_micros("at").alias("us")).withWatermark("at", delay)
    out = rows.groupBy("url").transformWithState(UrlState(keep_days), OUT, "Update", "EventTime")
    at = [F.timestamp_micros(a).alias(b) for a, b in (("first", "first_seen_at"), ("last", "last_seen_at"), ("expires", "expires_at"))]
    return out.select("url", *at[:2], F.col("seen").alias("seen_count"), "route", at[2], "is_expired")


def batch_states(sights: DataFrame, keep_days: int = 30) -> DataFrame:
    """The same states from a batch: a url's sights part where one comes after the last one's expiry; the
    last part is the url's state."""
    order = Window.partitionBy("url").orderBy("at")
    rows = sights.where("url is not null and at is not null")
    gap = F.col("at") > F.max("at").over(order.rowsBetween(Window.unboundedPreceding, -1)) + F.make_dt_interval(F.lit(keep_days))
    lives = rows.withColumn("life", F.sum(F.coalesce(gap, F.lit(False)).cast("int")).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    each = lives.groupBy("url", "life").agg(
        F.min("at").alias("first_seen_at"), F.max("at").alias("last_seen_at"), F.count(F.lit(1)).alias("seen_count"), F.max(F.when(F.col("route").isNotNull(), F.struct("at", "route")))["route"].alias("route")
    )
    last = each.groupBy("url").agg(F.max_by(F.struct("first_seen_at", "last_seen_at", "seen_count", "route"), "life").alias("s")).select("url", "s.*")
    return last.withColumn("expires_at", F.col("last_seen_at") + F.make_dt_interval(F.lit(keep_days)))
