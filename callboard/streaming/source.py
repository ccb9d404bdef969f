"""A stream of messages whose offsets are each source's high-water mark.

Captured messages lie as JSON lines in ``<path>/<source>/<first id>-<last id>.jsonl``, in a folder that executors can open.
An offset is the last message id of every source; a batch is one partition a source, from its mark on, and only
reads the files that hold such ids.  Spark keeps offsets in the query's checkpoint and asks for the same range again
after a failure.  Finished batches are also noted in ``<path>/_cursors.json``, so that a new query goes on from there;
marks never go back.  Spark says that a batch is finished when it begins the next one, so what the last batch of an
ended query has read is noted by ``finished``.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "source_id string, message_id long, published_at timestamp, text string"
CURSORS = "_cursors.json"
FILE = re.compile(r"(\d+)-(\d+)\.jsonl")


@dataclass
class Span(InputPartition):
    """Messages of a source beyond ``low``, up to ``high``."""

    source: str
    low: int
    high: int


class Messages(DataSource):
    """``spark.readStream.format("captured_messages").option("path", ...).load()``; ``per_batch`` bounds the ids that one
    batch goes on by in each source."""

    @classmethod
    def name(cls) -> str:
        return "captured_messages"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> MessageReader:
        return MessageReader(self.options["path"], int(self.options.get("per_batch", 0)))


class MessageReader(DataSourceStreamReader):
    def __init__(self, path: str, per_batch: int):
        self.path, self.per_batch = path, per_batch
        self.at: dict[str, int] = {}

    def _cursors(self) -> dict[str, int]:
        try:
            with open(os.path.join(self.path, CURSORS)) as f:
                return json.load(f)
        except FileNotFoundError:
            return {}

    def _files(self, source: str) -> list[tuple[int, int, str]]:
        folder = os.path.join(self.path, source)
        return sorted((int(m[1]), int(m[2]), os.path.join(folder, name)) for name in os.listdir(folder) if (m := FILE.fullmatch(name)))

    def initialOffset(self) -> dict:
        return self._cursors()

    def latestOffset(self) -> dict:
        """Each source's last id, or as far as one batch may go; never before an offset that was given."""
        begin = self.at or self._cursors()
        out = dict(begin)
        for source in sorted(os.listdir(self.path)):
            if os.path.isdir(os.path.join(self.path, source)):
                low = begin.get(source, -1)
                ends = [last for _, last, _ in self._files(source) if last > low]
                if ends:
                    # Whole files: ids have gaps, files have messages.
                    out[source] = max([e for e in ends if not self.per_batch or e <= low + self.per_batch] or [min(ends)])
        self.at = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Span]:
        # After a restart Spark names the offset to go on from.
        self.at = {s: max(n, self.at.get(s, -1)) for s, n in end.items()}
        return [Span(source, start.get(source, -1), high) for source, high in sorted(end.items()) if high > start.get(source, -1)]

    def read(self, partition: Span) -> Iterator[tuple]:
        for first, last, file in self._files(partition.source):
            if last > partition.low and first <= partition.high:
                with open(file) as lines:
                    for line in lines:
                        m = json.loads(line)
                        if partition.low < m["message_id"] <= partition.high:
                            at = m.get("published_at")
                            yield partition.source, m["message_id"], datetime.fromisoformat(at) if at else None, m.get("text")

    def commit(self, end: dict) -> None:
        note(self.path, end)


def note(path: str, marks: dict[str, int]) -> None:
    """Moves the folder's cursors on."""
    try:
        with open(os.path.join(path, CURSORS)) as f:
            known = json.load(f)
    except FileNotFoundError:
        known = {}
    with open(os.path.join(path, f"{CURSORS}.new"), "w") as f:
        json.dump({s: max(marks.get(s, -1), known.get(s, -1)) for s in sorted({*known, *marks})}, f)
    os.replace(os.path.join(path, f"{CURSORS}.new"), os.path.join(path, CURSORS))


def finished(query: StreamingQuery, path: str) -> None:
    """Notes what a query that ended without an error has read."""
    if query.isActive or query.exception() is not None:
        raise ValueError("the query has not ended well")
    for progress in query.recentProgress:
        for at in json.loads(progress.json)["sources"]:
            if at["endOffset"]:
                note(path, at["endOffset"])
