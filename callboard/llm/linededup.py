"""Dropping lines that many documents hold, by keep bitmaps.

Every long line becomes a row of its hash, its document and its places there; rows are sorted by
(hash, document from the largest, text) in ranges of all three, so a line that a third of all
documents hold spans as many partitions as it needs.  A partition streams its rows: the first
document of a hash keeps its lines, the others lose theirs once the hash is found to be frequent.
Only a partition's first and last hash may go on in another one; those rows stay open, and two sums a
partition settle them.  What comes back is a compressed bitmap of the lines to keep for each document
that loses some; texts move once, to meet their bitmaps.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callboard.llm.arrays import LEAD, LOWER, WORD, owners, pieces, raw, spans

#: A line counts from so many code points on, and goes when so many documents hold it.
LEAST_CHARS = 40
DOCUMENTS = 5
LINE = np.ones(256, bool)
LINE[0x0A] = False
ROW = "h1 long, h2 long, doc_id {id}, same long, n_lines int, lines binary"
#: What a streamed row says: its lines go, its hash is open, or it sums up an open hash.
GOES, OPEN, SUM = 0, 1, 2


def keys(data: np.ndarray, offsets: np.ndarray, least: int = LEAST_CHARS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, line number, hash, second hash) of every line whose key has ``least`` code points; the key is
    the line without blanks at its ends, A-Z in lower case.  128 bits of hash stand for the key."""
    low = LOWER[data]
    starts, ends, _ = spans(data, offsets, WORD)
    l_starts, l_ends, l_firsts = spans(data, offsets, LINE)
    first, last = np.searchsorted(starts, l_starts), np.searchsorted(starts, l_ends)
    worded = np.flatnonzero(last > first)
    a, b = starts[first[worded]], ends[last[worded] - 1]
    leads = np.concatenate([[0], np.cumsum(LEAD[data])])
    long = leads[b] - leads[a] >= least
    a, b, line = a[long], b[long], worded[long]
    doc = owners(l_firsts)[line]
    breaks = np.concatenate([[0], np.cumsum(data == 0x0A)])
    view = memoryview(np.ascontiguousarray(low))
    hashed = np.frombuffer(b"".join(xxhash.xxh3_128_digest(view[i:j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)), "<i8").reshape(-1, 2)
    return doc, breaks[l_starts[line]] - breaks[offsets[doc]], hashed[:, 0], hashed[:, 1]


def _long_lines(docs: DataFrame, least: int) -> DataFrame:
    """A row for each document and long line of it, with all places of that line."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            data, offsets = raw(part.column(1))
            doc, line, h1, h2 = keys(data, offsets, least)
            order = np.lexsort((line, h2, h1, doc))
            doc, line, h1, h2 = doc[order], line[order], h1[order], h2[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            at = np.flatnonzero(new)
            edges = np.append(at, len(doc)).astype(np.int32) * 4
            places = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(line.astype("<u4").tobytes())])
            breaks = np.concatenate([[0], np.cumsum(data == 0x0A)])
            n_lines = (breaks[offsets[1:]] - breaks[offsets[:-1]] + 1).astype(np.int32)
            rows = pa.array(doc[at])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1[at]), pa.array(h2[at]), part.column(0).take(rows), part.column(2).take(rows), pa.array(n_lines[doc[at]]), places], ["h1", "h2", "doc_id", "same", "n_lines", "lines"]
            )

    return docs.mapInArrow(of, ROW.format(id=dict(docs.dtypes)["doc_id"]))


def _differs(column: pa.Array) -> np.ndarray:
    """Whether a value differs from the one before it; nulls always do."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.fill_null(pc.not_equal(column[1:], column[:-1]), True).to_numpy(zero_copy_only=False).astype(bool)


class Stream:
    """Walks one partition's sorted rows; a row a hash and document, documents from the largest."""

    def __init__(self, documents: int):
        self.documents = documents
        self.before = None  # the row before the next batch
        self.first = None  # the partition's first hash
        self.group = None  # the hash that the rows before belong to
        self.count, self.top, self.on_top = 0, None, True
        self.held: list[pa.RecordBatch] = []  # rows of that hash that may have to go

    def out(self, rows: pa.RecordBatch, kind: int) -> pa.RecordBatch:
        n = rows.num_rows
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(n, kind, np.int32)), pa.array(np.zeros(n, np.int64))], [*rows.schema.names, "kind", "n"])

    def closed(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """The last hash's rows that are still held, and the sum of it."""
        for rows in self.held:
            yield self.out(rows, OPEN)
        self.held = []
        yield from self.summed(schema)

    def summed(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        none = [None]
        values = [[self.group[0]], [self.group[1]], [self.top], none, none, none]
        columns = [pa.array(v, f.type) for v, f in zip(values, schema, strict=True)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([SUM], pa.int32()), pa.array([self.count], pa.int64())], [*schema.names, "kind", "n"])

    def batch(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        # Repeated rows of one id say the same once.
        joined = pa.Table.from_batches([*([self.before] if self.before is not None else []), rows])
        id_differs = _differs(joined.column("doc_id"))
        h1, h2, same = (joined.column(c).to_numpy() for c in ("h1", "h2", "same"))
        hash_differs = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        told = id_differs | hash_differs | (same[1:] != same[:-1])
        if self.before is None:
            id_differs, hash_differs, told = (np.concatenate([[True], x]) for x in (id_differs, hash_differs, told))
        self.before = rows.slice(rows.num_rows - 1)
        kept = np.flatnonzero(told)
        rows = rows.take(pa.array(kept))
        new, moved = hash_differs[kept], (hash_differs | id_differs)[kept]
        cuts = np.unique(np.concatenate([[0], np.flatnonzero(new), [len(kept)]])) if len(kept) else np.zeros(0, np.int64)
        if not len(kept):
            return
        h1, h2 = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        cuts = [*np.union1d([0], np.flatnonzero(new)).tolist(), len(kept)]

        def segment(k: int) -> Iterator[pa.RecordBatch]:
            a, b = cuts[k], cuts[k + 1]
            return self.grown(rows.slice(a, b - a), moved[a:b], bool(new[a]), (int(h1[a]), int(h2[a])))

        at, last = 0, len(cuts) - 2
        if not new[0] or self.first is None:
            yield from segment(0)
            at = 1
        if at > last:
            return
        if self.group is not None:
            yield from self.ended(rows.schema)
        if at < last:  # hashes that begin and end in this batch, all at once
            yield self.out(rows.slice(cuts[at], cuts[last] - cuts[at]).take(pa.array(self.going(rows.column(2), moved, np.array(cuts[at : last + 1])))), GOES)
        yield from segment(last)

    def going(self, ids: pa.Array, moved: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Places, from the first cut on, of rows whose lines go, among hashes from cut to cut."""
        at, sizes = cuts[:-1] - cuts[0], np.diff(cuts)
        nth = np.cumsum(moved[cuts[0] : cuts[-1]])
        documents = np.append(nth[at[1:]] - 1, nth[-1]) - nth[at] + 1
        nameless = pc.is_null(ids).to_numpy(zero_copy_only=False)[cuts[:-1]]
        return np.flatnonzero(np.repeat((documents >= self.documents) & ~nameless, sizes) & (nth != np.repeat(nth[at], sizes)))

    def ended(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """The hash so far is over: rows held for it stay; the partition's first hash is summed up."""
        self.held = []
        if self.group == self.first:
            yield from self.summed(schema)
        self.group = None

    def grown(self, rows: pa.RecordBatch, moved: np.ndarray, begins: bool, group: tuple[int, int]) -> Iterator[pa.RecordBatch]:
        """More rows of one hash that may go on."""
        if begins:
            self.group, self.count, self.top, self.on_top = group, 0, rows.column(2)[0].as_py(), True
            self.first = self.first or group
        self.count += int(moved.sum())
        steps = np.cumsum(moved) - (1 if begins else 0)
        top = (steps == 0) & self.on_top
        self.on_top = bool(top[-1])
        others = rows.take(pa.array(np.flatnonzero(~top))) if self.top is not None else rows.slice(0, 0)
        if self.group == self.first:
            # Its largest document may be in an earlier partition, so all its rows are open.
            yield self.out(rows, OPEN)
        elif self.count >= self.documents:
            for held in [*self.held, others]:
                yield self.out(held, GOES)
            self.held = []
        elif others.num_rows:
            self.held.append(others)


def _streamed(lines: DataFrame, documents: int) -> DataFrame:
    """Rows of lines that go, rows that are open, and sums of open hashes."""
    order = ("h1", "h2", F.col("doc_id").desc_nulls_last(), "same")
    ranged = lines.repartitionByRange(*order[:3]).sortWithinPartitions(*order)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, schema = Stream(documents), None
        for batch in batches:
            if batch.num_rows:
                schema = batch.schema
                yield from stream.batch(batch)
        if schema is not None:
            yield from stream.closed(schema)

    return ranged.mapInArrow(of, ROW.format(id=dict(lines.dtypes)["doc_id"]) + ", kind int, n long")


def bitmaps(docs: DataFrame, least: int = LEAST_CHARS, documents: int = DOCUMENTS, text: str = "text") -> DataFrame:
    """(doc_id, same, n_lines, n_dropped, keep): a row for each document that loses a line; ``same`` is
    the hash of its text, ``keep`` the compressed bits of its lines, 1 for those that stay.

    A line goes when its key has ``least`` code points and ``documents`` documents hold it, unless its
    document has the largest id of them.  Rows of one id are one document, and all of them keep the
    line if it is the largest; rows without an id are documents of their own, smaller than any id, and
    keep a line that nobody with an id holds.  Null and empty texts have one empty line, which is too
    short to go, as is any line of blanks.  Repeated rows have one bitmap.  An empty table gives no rows.
    Lines of any length count whole.
    """
    rows = docs.select("doc_id", F.col(f"`{text}`").alias("text"), F.xxhash64(f"`{text}`").alias("same"))
    # Written once: the ranges are drawn from it, and then it is sorted.
    found = _streamed(_long_lines(rows, least).checkpoint(), documents).checkpoint()
    # Two rows a partition at most, so the sums are small whatever the documents hold.
    sums = found.where(F.col("kind") == SUM).groupBy("h1", "h2").agg(F.sum("n").alias("total"), F.max("doc_id").alias("top"))
    opened = found.where(F.col("kind") == OPEN).join(F.broadcast(sums), ["h1", "h2"])
    settled = opened.where((F.col("total") >= documents) & F.col("top").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("top")))
    gone = found.where(F.col("kind") == GOES).select("doc_id", "same", "n_lines", "lines").unionByName(settled.select("doc_id", "same", "n_lines", "lines"))
    each = gone.groupBy("doc_id", "same").agg(F.first("n_lines").alias("n_lines"), F.collect_set("lines").alias("lines"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, dropped = [], []
            for n, lines in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                bits = np.ones(n, bool)
                bits[np.frombuffer(b"".join(lines), "<u4")] = False
                keep.append(zlib.compress(np.packbits(bits).tobytes()))
                dropped.append(n - int(bits.sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(dropped, pa.int64()), pa.array(keep, pa.binary())], ["doc_id", "same", "n_lines", "n_dropped", "keep"])

    return each.mapInArrow(packed, f"doc_id {dict(docs.dtypes)['doc_id']}, same long, n_lines int, n_dropped long, keep binary")


def kept_bits(keep: bytes, n_lines: int) -> np.ndarray:
    """Whether each line stays."""
    return np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n_lines).astype(bool)


def _with_bitmaps(docs: DataFrame, found: DataFrame, text: str) -> DataFrame:
    bits = found.select(F.col("doc_id").alias("__id"), F.col("same").alias("__same"), F.col("keep").alias("__keep"))
    return docs.join(bits, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(f"`{text}`") == F.col("__same")), "left").drop("__id", "__same")


def _left(text: bytes, keep: bytes | None) -> tuple[int, int, bytes]:
    """(lines, dropped lines, what is left) of one text."""
    n = text.count(b"\n") + 1
    if keep is None:
        return n, 0, text
    bits = kept_bits(keep, n)
    return n, n - int(bits.sum()), b"\n".join(line for line, stays in zip(text.split(b"\n"), bits, strict=True) if stays)


def deduplicated(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents, all columns as they are, but without the lines that ``bitmaps`` drops; a null text
    stays null."""
    met = _with_bitmaps(docs, bitmaps(docs, text=text, **options), text)

    @F.pandas_udf("string")
    def cut(texts, keeps):
        return texts.combine(keeps, lambda t, k: t if k is None else _left(t.encode(), k)[2].decode())

    return met.withColumn(text, F.when(F.col("__keep").isNull(), F.col(f"`{text}`")).otherwise(cut(F.col(f"`{text}`"), F.col("__keep")))).drop("__keep")


def digest(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every row of ``docs``."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            data, offsets = raw(part.column(1))
            body = data.tobytes()
            out = [_left(body[a:b], keep) for a, b, keep in zip(offsets[:-1].tolist(), offsets[1:].tolist(), part.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": part.column(0), "n_lines": pa.array([x[0] for x in out], pa.int64()), "n_dropped": pa.array([x[1] for x in out], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x[2]).hexdigest() for x in out], pa.string())}
            )

    met = _with_bitmaps(docs.select("doc_id", F.col(f"`{text}`").alias("text")), found, "text")
    return met.select("doc_id", "text", "__keep").mapInArrow(of, f"doc_id {dict(docs.dtypes)['doc_id']}, n_lines long, n_dropped long, kept_sha256 string")
