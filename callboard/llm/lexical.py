"""Ranked lexical search: the best documents for each item, by intervals of documents.

A task cuts its rows into blocks of bounded text and sorts a block by document id.  Each asked term has
a posting list of (document, impact) with a sparse table over it, which answers the largest impact
in any range of the list, and where it is.  An item's search begins with the whole block as one interval,
bounded by the sum of its terms' largest impacts.  The intervals with the highest bounds are split at
the document of the largest impact, which is scored, and both sides get bounds of their own from the tables;
what cannot beat the item's tenth best is never opened.  The best of all blocks stand against each
other at the end.  Texts never move: a first pass counts documents and terms, a second one searches.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.pandas.types import to_arrow_type

from callboard.llm.arrays import LOWER, hashes, owners, pieces, raw, spans

TOP = 10
#: Text of one block, and of the items of one pass; and how many intervals are split at a time.
BLOCK_BYTES = 16 << 20
ITEM_BYTES = 8 << 20
WAVE = 32
#: Bytes of terms: digits, letters and all beyond ASCII.
TERM = np.zeros(256, bool)
TERM[0x30:0x3A] = TERM[0x41:0x5B] = TERM[0x61:0x7B] = TERM[0x80:] = True


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each term, index of each text's first term); 64 bits stand for a term."""
    data, offsets = raw(column)
    data = LOWER[data]
    starts, ends, firsts = spans(data, offsets, TERM)
    return hashes(data, starts, ends), firsts


class Items:
    """Some items' terms, and what all documents say of them."""

    def __init__(self, texts: pa.Array):
        words, firsts = terms(texts)
        self.vocabulary, which = np.unique(words, return_inverse=True)
        self.terms, self.times = [], []
        for a, b in zip(firsts[:-1], firsts[1:], strict=True):
            term, times = np.unique(which[a:b], return_counts=True)
            self.terms.append(term)
            self.times.append(times)
        self.documents = self.length = 0
        self.weights = np.zeros(len(self.vocabulary), np.int64)

    def weigh(self, documents: int, length: int, holding: dict[int, int]) -> None:
        self.documents, self.length = documents, length
        self.weights = np.array([math.floor(1000 * math.log((2.0 * documents + 2) / (2.0 * holding.get(t, 0) + 1))) for t in range(len(self.vocabulary))], np.int64)

    def found(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, terms) of the words that items ask for."""
        near = np.minimum(np.searchsorted(self.vocabulary, words), max(len(self.vocabulary) - 1, 0))
        at = np.flatnonzero(self.vocabulary[near] == words) if len(self.vocabulary) else np.zeros(0, np.int64)
        return at, near[at]

    def lengths(self, n: np.ndarray) -> np.ndarray:
        """The m of documents with so many terms."""
        if not len(n) or 75 * int(n.max()) * self.documents < 1 << 63:
            return 25 + 75 * n * self.documents // max(self.length, 1)
        return np.array([25 + 75 * int(x) * self.documents // self.length for x in n], np.int64)


class Postings:
    """A block's posting lists of (document, impact), and sparse tables of their largest impacts."""

    def __init__(self, items: Items, doc: np.ndarray, term: np.ndarray, n: np.ndarray):
        self.size = len(n)
        of = self.size + 1
        self.keys, times = np.unique(term.astype(np.int64) * of + doc, return_counts=True)
        self.doc = self.keys % of
        impact = (1_000_000_000 * times) // (1000 * times + 8 * items.lengths(n)[self.doc])
        self.impact = impact
        count = len(self.keys)
        self.edges = np.searchsorted(self.keys, np.arange(len(items.weights) + 1) * of)
        # Impact above, place from the end below: the largest number is the first of the largest impacts.
        level = (impact << 32) | (count - 1 - np.arange(count))
        self.last = count - 1
        tables, width = [level], 1
        longest = int(np.diff(self.edges).max(initial=0))
        while 2 * width <= longest:
            level = np.append(np.maximum(level[:-width], level[width:]), np.zeros(width, np.int64))
            tables.append(level)
            width *= 2
        self.table = np.concatenate(tables) if count else np.zeros(1, np.int64)
        self.step = max(count, 1)

    def largest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The table's answer for places a to b of a list; 0 for no place."""
        level = np.frexp((b - a).astype(np.float64))[1].astype(np.int64) - 1
        some = level >= 0
        level = np.where(some, level, 0)
        at = level * self.step
        return np.where(some, np.maximum(self.table[at + np.where(some, a, 0)], self.table[at + np.where(some, b - (1 << level), 0)]), 0)

    def search(self, asked: np.ndarray, weights: np.ndarray, ids: list[tuple], best: list[tuple[int, tuple]], top: int) -> None:
        """Adds the block's documents, named by ``ids`` in their order, to the sorted pairs (-score, id)
        of the best so far."""
        held = (self.edges[asked + 1] > self.edges[asked]) & (weights > 0)
        asked, weights = asked[held], weights[held]
        if not len(asked):
            return
        base = asked * (self.size + 1)

        def opened(low, high, a, b):
            """Intervals with their bounds and the documents to split them at."""
            most = self.largest(a, b)
            part = (most >> 32) * weights
            bound = part.sum(1)
            lead = np.take_along_axis(most, part.argmax(1)[:, None], 1)[:, 0]
            at = self.doc[np.clip(self.last - (lead & 0xFFFFFFFF), 0, self.last)]
            some = np.flatnonzero(bound > 0)
            return tuple(x[some] for x in (bound, low, high, at, a, b))

        def alive(rows):
            """Those that can still hold a better document; of equal scores, one with a lesser id."""
            if len(best) < top:
                return rows
            least, late = -best[-1][0], bisect.bisect_left(ids, best[-1][1])
            keep = np.flatnonzero((rows[0] > least) | ((rows[0] == least) & (rows[1] < late)))
            return rows if len(keep) == len(rows[0]) else tuple(x[keep] for x in rows)

        rows = opened(np.zeros(1, np.int64), np.full(1, self.size), self.edges[asked][None, :], self.edges[asked + 1][None, :])
        rows = alive(rows)
        while len(rows[0]):
            if len(rows[0]) > WAVE:
                order = np.argpartition(-rows[0], WAVE)
                now, later = tuple(x[order[:WAVE]] for x in rows), tuple(x[order[WAVE:]] for x in rows)
            else:
                now, later = rows, None
            _, low, high, at, a, b = now
            cut = np.searchsorted(self.keys, base[None, :] + at[:, None])
            there = (cut < b) & (self.keys[np.minimum(cut, self.last)] == base[None, :] + at[:, None])
            score = (np.where(there, self.impact[np.minimum(cut, self.last)], 0) * weights).sum(1)
            for s, d in zip(score.tolist(), at.tolist(), strict=True):
                if len(best) < top or (-s, ids[d]) < best[-1]:
                    bisect.insort(best, (-s, ids[d]))
                    del best[top:]
            split = opened(np.concatenate([low, at + 1]), np.concatenate([at, high]), np.concatenate([a, cut + there]), np.concatenate([cut, b]))
            rows = alive(split if later is None else tuple(np.concatenate(x) for x in zip(split, later, strict=True)))


def _counted(docs: DataFrame, shared) -> DataFrame:
    """(term, n): documents that hold each term; -1 for documents with any term, -2 for all terms."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        holding, documents, length = np.zeros(len(items.vocabulary), np.int64), 0, 0
        for part in pieces(batches):
            words, firsts = terms(part.column(0))
            at, term = items.found(words)
            pair = np.unique(owners(firsts)[at].astype(np.int64) * max(len(holding), 1) + term)
            holding += np.bincount(pair % max(len(holding), 1), minlength=len(holding))[: len(holding)]
            documents, length = documents + int((np.diff(firsts) > 0).sum()), length + len(words)
        some = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([some, [-1, -2]])), pa.array(np.concatenate([holding[some], [documents, length]]))], ["term", "n"])

    return docs.select("text").mapInArrow(of, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _searched(docs: DataFrame, shared, top: int, block_bytes: int) -> DataFrame:
    """(item, doc_id, score): each task's best documents of every item."""
    kind = dict(docs.dtypes)["doc_id"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        best: list[list[tuple[int, tuple]]] = [[] for _ in items.terms]
        ids, doc, term, n, size = [], [], [], [], 0

        def block() -> None:
            if not ids:
                return
            column = pa.chunked_array(ids).combine_chunks()
            order = pc.sort_indices(column, null_placement="at_end").to_numpy()
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            postings = Postings(items, place[np.concatenate(doc)], np.concatenate(term), np.concatenate(n)[order])
            named = [(x is None, x) for x in column.take(pa.array(order)).to_pylist()]
            for found, asked, times in zip(best, items.terms, items.times, strict=True):
                postings.search(asked, items.weights[asked] * times, named, found, top)

        for part in pieces(batches):
            words, firsts = terms(part.column(1))
            at, which = items.found(words)
            ids.append(part.column(0))
            doc.append(owners(firsts)[at] + sum(map(len, n)))
            term.append(which)
            n.append(np.diff(firsts))
            size += int(raw(part.column(1))[1][-1])
            if size >= block_bytes:
                block()
                ids, doc, term, n, size = [], [], [], [], 0
        block()
        flat = [(k, i, -s) for k, found in enumerate(best) for s, (_, i) in found]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], ids_type), pa.array([x[2] for x in flat], pa.int64())], ["item", "doc_id", "score"])

    ids_type = to_arrow_type(docs.schema["doc_id"].dataType)
    return docs.select("doc_id", "text").mapInArrow(of, f"item int, doc_id {kind}, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, text: str = "text", block_bytes: int = BLOCK_BYTES, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of every row of ``items`` with a score above 0,
    or all if fewer, equal scores by ascending doc_id, null last.

    Terms are maximal runs of digits, letters and signs beyond ASCII, A-Z in lower case, of whole
    texts; a null text has none.  A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), its impact
    10^9 tf div (1000 tf + 8 m) with m = 25 + 75 n N div L.  Every row is a document, so repeated rows
    and ids have ranks of their own; rows of ``items`` with one id are items of their own, and items that
    nothing matches have no row.  An empty table on either side gives no rows.  Other columns are ignored.

    Items are asked in passes of ``item_bytes`` of text: a pass broadcasts its terms (16 bytes and less for
    each byte of text) and its result is written before the next one begins.
    """
    rows = docs.select("doc_id", F.col(f"`{text}`").alias("text"))
    asked = items.select("item_id", "text")
    total = asked.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64).alias("n")).first()["n"] or 0
    passes = max(1, -(-total // item_bytes))
    context, out = docs.sparkSession.sparkContext, None
    for k in range(passes):
        block = (asked if passes == 1 else asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)).toArrow()
        known = Items(block.column("text").combine_chunks())
        counting = context.broadcast(known)
        counted = {r["term"]: r["n"] for r in _counted(rows, counting).collect()}
        known.weigh(counted.get(-1, 0), counted.get(-2, 0), counted)
        shared = context.broadcast(known)
        names = docs.sparkSession.createDataFrame(block.select(["item_id"]).append_column("item", pa.array(np.arange(block.num_rows), pa.int32())))
        best = _ranked(_searched(rows, shared, top, block_bytes), top).join(names.withColumnRenamed("item", "__item"), F.col("item") == F.col("__item"))
        best = best.select("item_id", "rank", "doc_id", "score")
        if passes > 1:
            best = best.checkpoint()
            counting.unpersist()
            shared.unpersist()
        out = best if out is None else out.unionByName(best)
    return out


def _ranked(found: DataFrame, top: int) -> DataFrame:
    """The best of all tasks' best: first of groups of tasks, then of these."""
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    grouped = found.withColumn("group", F.pmod(F.spark_partition_id(), F.lit(64)))
    near = grouped.withColumn("rank", F.row_number().over(W.Window.partitionBy("item", "group").orderBy(*order))).where(F.col("rank") <= top)
    return near.withColumn("rank", F.row_number().over(W.Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
