"""Benchmark decontamination with suffix arrays over the training text.

Words of the benchmark get ranks; the training text is turned into ranks, with 0 for any word
that no benchmark item has.  Each shard of the training text sorts the suffixes that could hold a
match (runs of ranked words no shorter than the shortest window) into a suffix array to the depth
of one window.  Every distinct benchmark suffix is binary-searched in every shard's array, which
gives all its verbatim places; neighbouring places are then chained into longest matches.

The benchmark is collected in blocks of bounded bytes and broadcast as ranks and window starts,
about five times its words; the windows themselves are only laid out for a slice of the search.  A
larger benchmark takes more passes over the rows, each adding its hits, so no pass holds more than
a block.  The text is never shuffled.
"""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callboard.llm.arrays import ALNUM, LOWER, chained, hashes, owners, pieces, raw, spans

WINDOW = 13
#: A document with hits is contaminated when this many times its hit words reach its words.
FRACTION = 20
#: Text bytes of the benchmark that one pass holds.
BLOCK_BYTES = 32 << 20
#: Suffixes of one shard's array, and windows laid out at once to be searched in it.
SHARD = 1 << 16
SLICE = 1 << 16


class Tests:
    """One block of benchmark items: vocabulary, distinct windows and the items of each.

    ids: an Arrow column; texts: an Arrow string column without nulls.
    """

    def __init__(self, ids, texts, window: int):
        data, offsets = raw(texts)
        data = LOWER[data]
        starts, ends, firsts = spans(data, offsets, ALNUM)
        words = hashes(data, starts, ends)
        self.vocabulary = np.unique(words)
        self.window = window
        self.ranks = (np.searchsorted(self.vocabulary, words) + 1).astype(np.uint32)
        self.names = ids
        counts = np.diff(firsts)
        each = np.where(counts > 0, np.maximum(counts - window + 1, 1), 0)
        item = np.repeat(np.arange(len(counts)), each)
        start = firsts[item] + np.arange(len(item)) - np.repeat(np.cumsum(each) - each, each)
        size = np.minimum(window, firsts[item + 1] - start)
        # Equal windows are one: by the hash of their words, and their size.
        name = np.zeros(len(item), np.uint64)
        for n in np.unique(size).tolist():
            name[size == n] = chained(words, n)[start[size == n]] + np.uint64(n)
        _, one, which = np.unique(name, return_index=True, return_inverse=True)
        order = np.lexsort((self.ranks[start[one]],))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        which = place[which]
        self.starts, self.sizes = start[one][order], size[one][order].astype(np.int32)
        self.least = int(self.sizes.min()) if len(one) else 0
        pairs = np.unique((which.astype(np.uint64) << np.uint64(32)) | item.astype(np.uint64))
        self.item = (pairs & np.uint64(0xFFFFFFFF)).astype(np.int32)
        self.item_edges = np.searchsorted(pairs >> np.uint64(32), np.arange(len(one) + 1, dtype=np.uint64))
        follows = np.flatnonzero((item[1:] == item[:-1]) & (size[1:] == window)) if len(item) else np.zeros(0, np.int64)
        self.links = np.unique((which[follows].astype(np.uint64) << np.uint64(32)) | which[follows + 1].astype(np.uint64))

    def rows(self, which: np.ndarray, fill: int) -> np.ndarray:
        """The keys of some windows, with ``fill`` after a short one's words."""
        at = self.starts[which][:, None] + np.arange(self.window)
        inside = np.arange(self.window)[None, :] < self.sizes[which][:, None]
        return as_keys(np.where(inside, self.ranks[np.minimum(at, len(self.ranks) - 1)], np.uint32(fill)).astype(">u4"))

    def linked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether window b comes right after window a in some item."""
        pair = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        near = np.minimum(np.searchsorted(self.links, pair), max(len(self.links) - 1, 0))
        return self.links[near] == pair if len(self.links) else np.zeros(len(pair), bool)


def as_keys(rows: np.ndarray) -> np.ndarray:
    """Rows of big-endian ranks as byte strings, whose order is the rows' order."""
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1] * 4}").ravel() if rows.size else np.zeros(0, f"S{max(rows.shape[1], 1) * 4}")


def matches(ranks: np.ndarray, stops: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
    """(word position, window's index) of every place where a distinct window occurs in the shard.

    ranks: the shard's words; stops: the end of each word's text, as a word position.
    """
    n = len(ranks)
    none = np.zeros(0, np.int64)
    if not n or not len(tests.starts):
        return none, none
    ends = np.where(ranks == 0, np.arange(n), n)
    reach = np.minimum(np.minimum.accumulate(ends[::-1])[::-1], stops)
    held = np.flatnonzero(reach - np.arange(n) >= tests.least)
    padded = np.concatenate([ranks, np.zeros(tests.window, ranks.dtype)])
    head = tests.ranks[tests.starts]
    found_at, found = [none], [none]
    for low in range(0, len(held), SHARD):
        part = held[low : low + SHARD]
        rows = padded[part[:, None] + np.arange(tests.window)]
        rows[np.arange(tests.window)[None, :] >= (reach[part] - part)[:, None]] = 0
        keys = as_keys(rows.astype(">u4"))
        order = np.argsort(keys, kind="stable")
        array = keys[order]
        # A window whose first word begins no suffix of the shard need not be laid out.
        begins = np.zeros(len(tests.vocabulary) + 1, bool)
        begins[ranks[part]] = True
        asked = np.flatnonzero(begins[head])
        for k in range(0, len(asked), SLICE):
            which = asked[k : k + SLICE]
            a, b = np.searchsorted(array, tests.rows(which, 0), "left"), np.searchsorted(array, tests.rows(which, 0xFFFFFFFF), "right")
            each = np.maximum(b - a, 0)
            slot = np.repeat(a - np.cumsum(each) + each, each) + np.arange(int(each.sum()))
            found_at.append(part[order[slot]])
            found.append(np.repeat(which, each))
    return np.concatenate(found_at), np.concatenate(found)


def _longest(doc: np.ndarray, at: np.ndarray, tests: Tests, which: np.ndarray) -> np.ndarray:
    """The words of the match that each place is part of: windows at neighbouring places that follow
    one another in the benchmark are one match."""
    order = np.lexsort((which, at))
    full = order[tests.sizes[which[order]] == tests.window]
    words = tests.sizes[which].astype(np.int64)
    if len(full):  # one full window at most begins at a place
        a, w, d = at[full], which[full], doc[full]
        new = np.ones(len(full), bool)
        new[1:] = (a[1:] != a[:-1] + 1) | (d[1:] != d[:-1]) | ~tests.linked(w[:-1], w[1:])
        run = np.cumsum(new) - 1
        words[full] = (np.bincount(run) - 1 + tests.window)[run]
    return words


HITS = "n_words long, hits array<struct<start:int,end:int>>, items array<string>, longest_match int"


def _pass(df: DataFrame, tests: Tests, text: str) -> DataFrame:
    """Adds to each row's hits (spans of word positions), items and longest match."""
    shared = df.sparkSession.sparkContext.broadcast(tests)
    names = [c for c in df.columns]
    state = ("n_words", "hits", "items", "longest_match")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = shared.value
        for part in pieces(batches, text):
            column = {c: part.column(k) for k, c in enumerate(part.schema.names)}
            data, offsets = raw(column[text])
            data = LOWER[data]
            starts, ends, firsts = spans(data, offsets, ALNUM)
            words = hashes(data, starts, ends)
            near = np.minimum(np.searchsorted(tests.vocabulary, words), max(len(tests.vocabulary) - 1, 0))
            ranks = np.where(tests.vocabulary[near] == words, near + 1, 0).astype(np.uint32) if len(tests.vocabulary) else np.zeros(len(words), np.uint32)
            doc = owners(firsts)
            at, which = matches(ranks, firsts[1:][doc], tests)
            hits, items, longest = column["hits"].to_pylist(), column["items"].to_pylist(), column["longest_match"].to_pylist()
            if len(at):
                owner, size = doc[at], _longest(doc[at], at, tests, which)
                order = np.argsort(owner, kind="stable")
                cuts = np.flatnonzero(np.diff(owner[order])) + 1
                for rows in np.split(order, cuts):
                    k = int(owner[rows[0]])
                    begin = at[rows] - firsts[k]
                    got = np.unique(np.stack([begin, begin + tests.sizes[which[rows]]], 1), axis=0)
                    hits[k] = _merged([*((h["start"], h["end"]) for h in hits[k]), *map(tuple, got.tolist())])
                    mine = np.unique(which[rows])
                    of = np.unique(np.concatenate([tests.item[a:b] for a, b in zip(tests.item_edges[mine], tests.item_edges[mine + 1], strict=True)]))
                    items[k] = sorted({*items[k], *(i for i in tests.names.take(pa.array(of)).to_pylist() if i is not None)})
                    longest[k] = max(longest[k], int(size[rows].max()))
            new = {"n_words": pa.array(np.diff(firsts)), "hits": pa.array(hits, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), "items": pa.array(items, pa.list_(pa.string())), "longest_match": pa.array(longest, pa.int32())}
            yield pa.RecordBatch.from_arrays([new.get(c, column[c]) for c in part.schema.names], part.schema.names)

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes if n not in state) + ", " + HITS
    return df.select(*(f"`{c}`" for c in names if c not in state), *state).mapInArrow(of, schema)


def _merged(found: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"start": a, "end": b} for a, b in out]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, fraction: int = FRACTION, block_bytes: int = BLOCK_BYTES, carry: tuple[str, ...] | None = None, text: str = "text") -> DataFrame:
    """The carried columns (all by default) and ``n_words``, ``hits`` (merged spans of word
    positions inside occurring windows), ``items`` (sorted ids of items with occurring windows),
    ``longest_match`` (words of the longest row of windows that follow one another in the benchmark)
    and ``contaminated``.

    Null texts have no words.  Items without words have no window; items of one id count once,
    and a null item id is left out of ``items``.  Each row is judged by its own text, so repeated
    rows agree; a long text is judged whole; an empty table gives no rows, an empty benchmark no
    hits.  Columns of these names in ``docs`` give way.
    """
    names = ("n_words", "hits", "items", "longest_match", "contaminated")
    kept = [c for c in (carry or docs.columns) if c not in names]
    tests = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = tests.agg(F.sum(F.octet_length("text") + 64).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // block_bytes))
    df = docs.select(*(f"`{c}`" for c in dict.fromkeys([*kept, text])))
    df = df.select("*", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<start:int,end:int>>").alias("hits"), F.array().cast("array<string>").alias("items"), F.lit(0).alias("longest_match"))
    for k in range(blocks):
        block = (tests if blocks == 1 else tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)).toArrow()
        df = _pass(df, Tests(block.column(0).combine_chunks(), block.column(1), window), text)
        if blocks > 1:  # written, so that one pass's tables are held at a time
            df = df.checkpoint()
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, h: s + h["end"] - h["start"])
    return df.select(*(f"`{c}`" for c in kept), "n_words", "hits", "items", "longest_match", n_hit.alias("n_hit"), ((n_hit > 0) & (fraction * n_hit >= F.col("n_words"))).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns, whatever their names."""
    bare = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    found = contamination(bare, benchmark, text=f"c{docs.columns.index(text)}", **options)
    return found.where("not contaminated").select(*bare.columns).toDF(*docs.columns)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``contamination``."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated", "longest_match"
    )
