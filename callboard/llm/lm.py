"""Language-model scores from an n-gram trie in Elias-Fano levels.

The trie has three orders: words, pairs and triples.  It is built and asked in shards, in one
exchange.  A block of documents sends each shard its distinct n-grams with their training counts;
a shard adds up the counts of all blocks, writes each level to a file in the shared folder, maps
it, and answers every block in the order of its keys.

A level holds contexts, pointers from each context to its successors, and the successors, as
monotone Elias-Fano sequences: a successor is stored relative to its context's rank and searched
between that context's two pointers only.  One byte a successor holds its quantised probability
of occurring with its context, in units of one occurrence in training: exact up to ``EXACT``, in
steps of ``STEP`` of log10 beyond.  The first order keeps exact counts, as running sums.

Smoothing is the hierarchical Dirichlet form: P(w|v) = (c(v,w) + K * P(w)) / (c(v) + K), then
P(w|u,v) = (c(u,v,w) + K * P(w|v)) / (c(u,v) + K), with P(w) the add-one unigram of the base.  The
count of a context is the count of the n-gram before, so a context's successors need not lie in
one shard: each is dealt by its hash to one of ``fan`` nodes of its context, and the number of nodes
grows with the corpus, which spreads "of the" and its like.  Scores do not depend on it.

Words and n-grams are hashed.  A triple or pair that training lacks is taken for another of its
context with a chance of T / 2**SUCCESSOR_BITS for T successors in its node (27 bits for a corpus
of a gigabyte, 30 from 32 GB on): 2e-8 for a pair of the usual three, 0.4 % in a context with half
a million successors.  Then it gets that one's count, mostly one.
"""

from __future__ import annotations

import mmap
import os
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from callboard.llm import blocks as B
from callboard.llm.arrays import LOWER, WORD, hashes, mixed, spans
from callboard.llm.eliasfano import EliasFano

ORDERS = 3
#: Occurrences that the lower order's estimate counts for, by order (chosen on held-out text).
WEIGHTS = (0.0, 200.0, 20.0)
TOKEN_BITS = 63
BLOCK_BYTES = 8 << 20
#: Text bytes whose n-grams one shard holds, and shards for each node of a context.
SHARD_BYTES = 10 << 20
SHARDS_A_NODE = 128
#: A byte's values: 0 is none, then counts up to EXACT, then steps of STEP in log10.
EXACT = 64
STEP = 0.06
VALUES = np.concatenate([np.arange(EXACT + 1.0), EXACT * 10 ** (STEP * np.arange(1, 256 - EXACT))])
END, START = np.uint64(0x1234567890ABCDEF), np.uint64(0x0FEDCBA987654321)
_TURN, _WORD, _EARLIER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x5851F42D4C957F2D), np.uint64(0xD6E8FEB86659FD93)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words and its end, and each text's first (one more than texts)."""
    data = LOWER[data]
    starts, ends, firsts = spans(data, offsets, WORD)
    begins = firsts + np.arange(len(offsets))
    out = np.full(int(begins[-1]), END)
    word = np.ones(len(out), bool)
    word[begins[1:] - 1] = False
    out[word] = hashes(data, starts, ends)
    return out, begins


def shifted(values: np.ndarray, begins: np.ndarray, first) -> np.ndarray:
    """The value before each one of its text; ``first`` before a text's first."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[begins[:-1]] = first
    return out


@dataclass(frozen=True)
class Keys:
    """How n-grams become keys: a node of the context above, the successor's hash below."""

    bits: int
    fan: int

    @property
    def low_bits(self) -> np.uint64:
        return np.uint64(self.bits // 2 - 1)

    @classmethod
    def of(cls, size: int, shards: int) -> Keys:
        return cls(min(62, max(56, size.bit_length() + 26)), max(1, shards // SHARDS_A_NODE))

    def __call__(self, token: np.ndarray, begins: np.ndarray) -> list[np.ndarray]:
        """Keys of the n-gram that ends at each token, by order."""
        out = [token >> np.uint64(64 - TOKEN_BITS)]
        successor = mixed(token ^ _WORD)
        turn = (successor >> np.uint64(32)) % np.uint64(self.fan)
        low = successor & np.uint64((1 << int(self.low_bits)) - 1)
        one = shifted(token, begins, START)
        two = shifted(one, begins, START)
        for context in (one, mixed(one ^ mixed(two + _EARLIER))):
            node = mixed(context + turn * _TURN) >> (np.uint64(64 - self.bits) + self.low_bits)
            out.append((node << self.low_bits) | low)
        return out

    def width(self, order: int) -> int:
        return self.bits if order else TOKEN_BITS


def counted(keys: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys (63 bits at most) and how often each occurs in training."""
    both = np.sort((keys << np.uint64(1)) | learn.astype(np.uint64))
    if not len(both):
        return both, np.zeros(0, np.int64)
    heads = np.flatnonzero(np.concatenate([[True], (both[1:] >> np.uint64(1)) != (both[:-1] >> np.uint64(1))]))
    return both[heads] >> np.uint64(1), np.add.reduceat((both & np.uint64(1)).astype(np.int64), heads)


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, each key's place among them, and the order that sorts the keys."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], place, order


def quantised(counts: np.ndarray) -> np.ndarray:
    """The byte of each count."""
    steps = np.rint(np.log10(np.maximum(counts, 1) / EXACT) / STEP)
    return np.where(counts <= EXACT, counts, np.clip(EXACT + steps, EXACT, 255)).astype(np.uint8)


class Unigrams:
    """A shard of the first level: words, and running sums of their counts."""

    def __init__(self, words: EliasFano, sums: EliasFano):
        self.words, self.sums = words, sums

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray) -> bytes:
        sums = np.concatenate([[0], np.cumsum(counts)]).astype(np.uint64)
        return EliasFano.build(keys, 1 << TOKEN_BITS).to_bytes() + EliasFano.build(sums, int(sums[-1]) + 1).to_bytes()

    @classmethod
    def mapped(cls, buffer) -> Unigrams:
        words, at = EliasFano.from_buffer(buffer)
        return cls(words, EliasFano.from_buffer(buffer, at)[0])

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The counts of sorted distinct words; 0 where unknown."""
        at = self.words.find(keys)
        known = np.flatnonzero(at >= 0)
        out = np.zeros(len(keys), np.int64)
        out[known] = (self.sums.get(at[known] + 1) - self.sums.get(at[known])).astype(np.int64)
        return out


class Successors:
    """A shard of a further level: contexts, pointers, successors, and a byte for each."""

    def __init__(self, low_bits: np.uint64, contexts: EliasFano, pointers: EliasFano, successors: EliasFano, codes: np.ndarray):
        self.low_bits, self.contexts, self.pointers, self.successors, self.codes = low_bits, contexts, pointers, successors, codes

    @staticmethod
    def _nodes(keys: np.ndarray, low_bits: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """The distinct nodes of sorted keys, and where each one's keys begin (and the last end)."""
        node = keys >> low_bits
        heads = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return node[heads], np.append(heads, len(keys))

    def _relative(self, rank: np.ndarray, keys: np.ndarray) -> np.ndarray:
        return (rank.astype(np.uint64) << self.low_bits) | (keys & np.uint64((1 << int(self.low_bits)) - 1))

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray, shape: Keys) -> bytes:
        node, edges = cls._nodes(keys, shape.low_bits)
        rank = np.repeat(np.arange(len(node)), np.diff(edges))
        value = cls(shape.low_bits, None, None, None, None)._relative(rank, keys)
        low = int(shape.low_bits)
        levels = EliasFano.build(node, 1 << (shape.bits - low)), EliasFano.build(edges.astype(np.uint64), len(keys) + 1), EliasFano.build(value, max(len(node), 1) << low)
        return b"".join(x.to_bytes() for x in levels) + quantised(counts).tobytes()

    @classmethod
    def mapped(cls, buffer, shape: Keys) -> Successors:
        at, levels = 0, []
        for _ in range(3):
            level, at = EliasFano.from_buffer(buffer, at)
            levels.append(level)
        return cls(shape.low_bits, *levels, np.frombuffer(buffer, np.uint8, levels[2].n, at))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The bytes of sorted distinct n-grams; 0 where unknown."""
        node, edges = self._nodes(keys, self.low_bits)
        rank = self.contexts.find(node)
        held = np.flatnonzero(rank >= 0)
        each = np.diff(edges)[held]
        begin, end = (np.repeat(self.pointers.get(rank[held] + k).astype(np.int64), each) for k in (0, 1))
        asked = np.flatnonzero(np.repeat(rank >= 0, np.diff(edges)))
        at = self.successors.find(self._relative(np.repeat(rank[held], each), keys[asked]), begin, end)
        out = np.zeros(len(keys), np.uint8)
        out[asked[at >= 0]] = self.codes[at[at >= 0]]
        return out


def on_file(folder: str | None, level: bytes):
    """The level as a memory map of a file in the shared folder; the file goes when it is unmapped.

    Without a folder that can be mapped (an object store), the level stays as it is.
    """
    if folder is None:
        return level
    path = os.path.join(folder, f"level-{uuid.uuid4().hex}")
    if not os.path.isdir(folder):  # an executor that cannot see it
        return level
    try:
        with open(path, "xb") as f:
            f.write(level)
        with open(path, "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    finally:
        if os.path.exists(path):
            os.unlink(path)


def shared_folder(docs: DataFrame) -> str | None:
    """The session's shared folder, if it is one that files can be mapped from."""
    path = docs.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not path:
        return None
    at = docs.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(docs.sparkSession._jsparkSession.sessionState().newHadoopConf())
    # A path without a scheme is one of the cluster's own file system.
    return at.toUri().getPath() if system.getUri().getScheme() == "file" else None


def answered(bodies: list[bytes], shape: Keys, folder: str | None) -> list[bytes]:
    """One shard: what blocks sent (``Keys`` by order, with counts), merged into its levels, which
    answer each block.  The first section of an answer has the shard's words and distinct words."""
    answers: list[list[bytes]] = [[] for _ in bodies]
    totals = b""
    for order in range(ORDERS):
        sent = []
        for body in bodies:
            keys, extra = B.unpack(B.section(body, order, ORDERS))
            sent.append((keys, B.from_mostly_ones(extra, len(keys))))
        edges = np.cumsum([0, *(len(k) for k, _ in sent)])
        distinct, place, _ = ranked(np.concatenate([k for k, _ in sent]))
        counts = np.bincount(place, np.concatenate([c for _, c in sent]), len(distinct)).astype(np.int64)
        del sent
        known = counts > 0
        if order == 0:
            totals = int(counts.sum()).to_bytes(8, "little") + int(known.sum()).to_bytes(8, "little")
            found = Unigrams.mapped(on_file(folder, Unigrams.build(distinct[known], counts[known])))(distinct)
        else:
            found = Successors.mapped(on_file(folder, Successors.build(distinct[known], counts[known], shape)), shape)(distinct)
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            mine = found[place[a:b]]
            answers[k].append(len(mine).to_bytes(4, "little") + B.mostly_ones(mine))
    return [B.sections([totals, *a]) for a in answers]


def scored(docs: DataFrame, held_out: Column, carry: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The carried columns, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` and ``score`` of every text; the model learns from rows that are not held out.

    A null text is empty and so has its end as the only token; an empty table gives no rows.
    Without a training row every token is unknown and the score is that of the base.  Repeated rows
    count as often as they occur, and rows with equal texts get equal scores.  A long text is one
    row of one block.  Columns of ``docs`` with the names of results, or ``block``, give way.
    """
    results = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    carry = tuple(c for c in carry if c not in (*results, "block"))
    n, size = B.count(docs, text, BLOCK_BYTES)
    shards = max(8, -(-size // SHARD_BYTES))
    shape, folder = Keys.of(size, shards), shared_folder(docs)
    own = [c for c in dict.fromkeys([*carry, text, "doc_id"]) if c in docs.columns]
    keyed = B.dealt(docs.select(*(f"`{c}`" for c in own), held_out.alias("held_out")), n, text)

    def read(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """All tokens of the block, and each text's first."""
        parts = [tokens(d, o) for d, o in B.texts(table, text)]
        token = np.concatenate([np.zeros(0, np.uint64), *(t for t, _ in parts)])
        sizes = np.concatenate([np.zeros(0, np.int64), *(np.diff(b) for _, b in parts)])
        return token, np.concatenate([[0], np.cumsum(sizes)])

    def send(table: pa.Table) -> pa.Table:
        token, begins = read(table)
        learn = np.repeat(~table.column("held_out").to_numpy().astype(bool), np.diff(begins))
        bodies: list[list[bytes]] = [[] for _ in range(shards)]
        for order, keys in enumerate(shape(token, begins)):
            keys, counts = counted(keys, learn)
            edges = B.bucket_edges(keys, shards, shape.width(order))
            for k in range(shards):
                a, b = edges[k], edges[k + 1]
                bodies[k].append(B.pack(keys[a:b], B.mostly_ones(counts[a:b])))
        return B.rows(table.column("block")[0].as_py(), [(k, B.sections(b)) for k, b in enumerate(bodies)])

    def merge(table: pa.Table) -> pa.Table:
        bodies = answered([x.as_py() for x in table.column("body")], shape, folder)
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "body": pa.array(bodies, pa.binary())})

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        token, begins = read(left)
        answers = B.answers(right)
        totals = [B.section(x, 0, ORDERS + 1) for x in answers]  # of every shard, as each answers each block
        total, kinds = (sum(int.from_bytes(x[a : a + 8], "little") for x in totals) for a in (0, 8))
        out = {}
        for order, keys in enumerate(shape(token, begins)):
            _, place, _ = ranked(keys)
            parts = [B.section(x, order + 1, ORDERS + 1) for x in answers]
            found = np.concatenate([B.from_mostly_ones(p[4:], int.from_bytes(p[:4], "little")) for p in parts])[place].astype(np.int64)
            if order == 0:
                probability = (found + 1) / (total + kinds + 1)
                out["n_known"], out["base_score"] = found > 0, np.log10(probability)
                starts = found[begins[1:] - 1][:1]  # as often as an end
                context = shifted(found.astype(np.float64), begins, starts)
            else:
                found = np.minimum(VALUES[found], context)
                probability = (found + WEIGHTS[order] * probability) / (context + WEIGHTS[order])
                context = shifted(found, begins, starts)
        out["score"] = np.log10(probability)
        columns = {c: left.column(c) for c in (*carry, "held_out")} | {"n_tokens": pa.array(np.diff(begins)), "train_tokens": pa.array(np.full(left.num_rows, total))}
        for name, values in out.items():
            columns[name] = pa.array(np.add.reduceat(values.astype(np.float64 if "score" in name else np.int64), begins[:-1]))
        return pa.table(columns).select([*carry, *results])

    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in carry), "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"])
    told = keyed.groupBy("block").applyInArrow(send, B.SENT).groupBy("bucket").applyInArrow(merge, B.SENT)
    return keyed.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(score, schema)
