"""Removal of bytes inside long strings that occur more than once in the corpus.

The construction is a difference-cover one, block by block and bucket by bucket.

A difference cover modulo PERIOD is a set of residues such that any two residues meet in it after
one common shift.  If two suffixes agree on LENGTH bytes, some shift under PERIOD leads both to
sampled places (a twelfth of the text), which then agree on DEPTH = LENGTH - PERIOD + 1 bytes.

1. All sampled places are ranked first, to two depths: by their DEPTH bytes, and by TIE = LENGTH +
   PERIOD - 1 bytes or what is left of their text.  A sampled place whose short rank is its own
   alone cannot follow a long tie.  One whose long rank is shared resolves the ties of the PERIOD
   suffixes from it on: each of them agrees on LENGTH bytes with the same suffix of its twin.
2. A suffix that follows a shared short rank and is not resolved so is open.  Short ranks with an
   open suffix within reach anywhere are told to all blocks that hold them.
3. Only suffixes within reach of such a rank are dealt to suffix buckets.  One bucket at a time is
   sorted, alone, which settles who agrees on all LENGTH bytes.

Copies of whole texts are resolved by ranks; what is sorted are suffixes at the ends of shared
passages, so a bucket's memory is bounded by its share of those.

Ranks and suffix keys are fingerprints of the bytes, since only equality matters here, not the
order of unequal suffixes.  A short rank (48 bits) with a false twin costs candidates, nothing
more.  A long rank has 40 more bits, a suffix key 64, so a suffix without a twin is taken for a
repeat with a chance of (distinct suffixes dealt) / 2**64, or (places of equal short rank) / 2**40.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from callboard.llm import blocks as B
from callboard.llm.arrays import Rolling, mixed

LENGTH = 200
PERIOD = 133
#: Residues modulo 133 whose differences are all residues.
COVER = (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)
DEPTH = LENGTH - PERIOD + 1
TIE = LENGTH + PERIOD - 1
RANK_BITS = 48
TIE_BITS = 40
KEY_BITS = 64
#: Text bytes whose ranks one bucket holds.
BUCKET_BYTES = 24 << 20


def covered(n: int, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in a span."""
    return np.cumsum(np.bincount(begins, minlength=n + 1) - np.bincount(ends, minlength=n + 1))[:n] > 0


class Piece:
    """Some texts of a block: their bytes, and their sampled places with both ranks."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.rolling = Rolling(data)
        sizes = np.diff(offsets)
        periods = -(-sizes // PERIOD)
        text = np.repeat(np.arange(len(sizes)), periods)
        turn = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods)
        at = ((offsets[text] + PERIOD * turn)[:, None] + np.array(COVER)).ravel()
        text = np.repeat(text, len(COVER))
        left = offsets[text + 1] - at
        keep = left >= DEPTH
        self.at, self.first, left = at[keep], offsets[text[keep]], left[keep]
        self.short = self.rolling(self.at, self.at + DEPTH) >> np.uint64(64 - RANK_BITS)
        self.run = np.where(left >= LENGTH, np.minimum(left, TIE), 0)  # 0: no suffix of LENGTH bytes begins here
        tie = mixed(self.rolling(self.at, self.at + self.run) + self.run.astype(np.uint64)) >> np.uint64(64 - TIE_BITS)
        self.tie = np.where(self.run > 0, np.maximum(tie, np.uint64(1)), np.uint64(0))
        whole = sizes >= LENGTH
        self.suffix = covered(len(data), offsets[:-1][whole], offsets[1:][whole] - LENGTH + 1)

    def reach(self, samples: np.ndarray) -> np.ndarray:
        """Suffixes of LENGTH bytes that come to one of the sampled places within PERIOD."""
        at, first = self.at[samples], self.first[samples]
        return covered(len(self.data), np.maximum(at - PERIOD + 1, first), at + 1) & self.suffix

    def settle(self, shared: np.ndarray, tied: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that long ranks resolve, and which sampled places have an open one in reach."""
        tied = tied & (self.run > 0)
        resolved = covered(len(self.data), self.at[tied], self.at[tied] + self.run[tied] - LENGTH + 1)
        open_ = np.concatenate([[0], np.cumsum(self.reach(shared) & ~resolved)])
        return resolved, shared & (open_[self.at + 1] > open_[np.maximum(self.at - PERIOD + 1, self.first)])

    def keys(self, starts: np.ndarray) -> np.ndarray:
        return self.rolling(starts, starts + LENGTH)


def paired(short: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts by both, and where its distinct pairs begin."""
    order = np.argsort(short)
    s = short[order]
    same = s[1:] == s[:-1]
    close = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]])) if len(s) else np.zeros(0, np.int64)
    order[close] = order[close][np.lexsort((tie[order[close]], s[close]))]
    t = tie[order]
    new = np.ones(len(s), bool)
    new[1:] = ~same | (t[1:] != t[:-1])
    return order, new


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, each key's place among them, and how often each occurs."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], place, np.diff(np.append(np.flatnonzero(new), len(keys)))


def _bits(values: np.ndarray) -> bytes:
    return np.packbits(values).tobytes()


def _unbits(body: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(body, np.uint8), count=n).astype(bool)


def _sent(block: int, keys: np.ndarray, extra, buckets: int, bits: int) -> pa.Table:
    """One row for each bucket that the sorted keys reach; extra(a, b) are the bytes of a range."""
    edges = B.bucket_edges(keys, buckets, bits)
    return B.rows(block, [(k, B.pack(keys[a:b], extra(a, b))) for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if b > a])


def _told(table: pa.Table, sizes: list[int], flags: list[np.ndarray]) -> pa.Table:
    """The buckets' answers: one bit a key from each array of flags over what all blocks sent."""
    edges = np.cumsum([0, *sizes]).tolist()
    bodies = [B.sections([n.to_bytes(4, "little"), *(_bits(f[a:b]) for f in flags)]) for n, a, b in zip(sizes, edges[:-1], edges[1:], strict=True)]
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "body": pa.array(bodies, pa.binary())})


def _flags(table: pa.Table, stage: int, of: int) -> list[np.ndarray]:
    """A block's answers of one stage in the order of its sorted keys."""
    mine = table.filter(pa.array(table.column("stage").to_numpy() == stage)) if table.num_rows else table
    out: list[list[np.ndarray]] = [[np.zeros(0, bool)] for _ in range(of)]
    for body in B.answers(mine):
        n = int.from_bytes(B.section(body, 0, of + 1), "little")
        for k in range(of):
            out[k].append(_unbits(B.section(body, k + 1, of + 1), n))
    return [np.concatenate(x) for x in out]


def merge_ranks(table: pa.Table) -> pa.Table:
    """One bucket of ranks: whether each short rank is shared, and each long one."""
    parts = [B.unpack(x.as_py()) for x in table.column("body")]
    sizes = [len(k) for k, _ in parts]
    planes = TIE_BITS // 8
    short = np.concatenate([k for k, _ in parts])
    tie = np.zeros((len(short), 8), np.uint8)
    at = 0
    for (k, extra), n in zip(parts, sizes, strict=True):
        tie[at : at + n, :planes] = np.frombuffer(extra, np.uint8, planes * n).reshape(planes, n).T
        at += n
    twice = np.concatenate([_unbits(extra[planes * n :], n) for (_, extra), n in zip(parts, sizes, strict=True)])
    order, new = paired(short, tie.view("<u8").ravel())
    repeated, first = twice[order], np.ones(len(short), bool)
    first[1:] = short[order][1:] != short[order][:-1]
    shared, tied = np.empty(len(short), bool), np.empty(len(short), bool)
    for out, heads in ((tied, np.flatnonzero(new)), (shared, np.flatnonzero(first))):
        sizes_ = np.diff(np.append(heads, len(short)))
        out[order] = np.repeat((sizes_ > 1) | np.logical_or.reduceat(repeated, heads), sizes_)
    return _told(table, sizes, [shared, tied])


def merge_flags(table: pa.Table, shared: bool) -> pa.Table:
    """One bucket of keys with a flag: whether any block set the flag, or, if asked, has the key too."""
    parts = [B.unpack(x.as_py()) for x in table.column("body")]
    sizes = [len(k) for k, _ in parts]
    _, place, times = distinct(np.concatenate([k for k, _ in parts]))
    flag = np.bincount(place, np.concatenate([_unbits(extra, n) for (_, extra), n in zip(parts, sizes, strict=True)]), len(times)) > 0
    return _told(table, sizes, [(flag | (times > 1) if shared else flag)[place]])


def repeats(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), text: str = "text", kept_text: bool = False) -> DataFrame:
    """The carried columns, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and, on demand,
    ``kept``: the remaining bytes.

    A null text is empty.  A text under LENGTH bytes has no window and stays whole.  Repeated rows,
    of one id or of none, are documents of their own, so a text of LENGTH bytes and more that occurs
    twice goes in both.  There are no ties to break; an empty table gives no rows.  A long text is
    one row of one block.  Columns of ``docs`` with the names of results, or ``block``, give way.
    """
    carry = tuple(c for c in carry if c not in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "block"))
    n, size = B.count(docs, text)
    buckets = max(8, -(-size // BUCKET_BYTES))
    own = [c for c in dict.fromkeys([*carry, text, "doc_id"]) if c in docs.columns]
    keyed = B.dealt(docs.select(*(f"`{c}`" for c in own)), n, text)

    def read(table: pa.Table) -> list[Piece]:
        return [Piece(d, o) for d, o in B.texts(table, text)]

    def split(values: np.ndarray, parts: list[Piece]) -> list[np.ndarray]:
        return np.split(values, np.cumsum([len(p.at) for p in parts])[:-1])

    def joined(arrays: list[np.ndarray], kind=np.uint64) -> np.ndarray:
        return np.concatenate([np.zeros(0, kind), *arrays])

    def rank(table: pa.Table) -> pa.Table:
        parts = read(table)
        short, tie = joined([p.short for p in parts]), joined([p.tie for p in parts])
        order, new = paired(short, tie)
        heads = np.flatnonzero(new)
        twice = np.diff(np.append(heads, len(order))) > 1
        planes = tie[order[heads]].astype("<u8").view(np.uint8).reshape(-1, 8)[:, : TIE_BITS // 8].T
        return _sent(table.column("block")[0].as_py(), short[order[heads]], lambda a, b: planes[:, a:b].tobytes() + _bits(twice[a:b]), buckets, RANK_BITS)

    def settled(parts: list[Piece], told: pa.Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per piece: shared short ranks, resolved suffixes, and places with an open suffix."""
        order, new = paired(joined([p.short for p in parts]), joined([p.tie for p in parts]))
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        shared, tied = (split(f[place], parts) for f in _flags(told, 1, 2))
        return [(s, *p.settle(s, t)) for p, s, t in zip(parts, shared, tied, strict=True)]

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = read(left)
        found = settled(parts, right)
        keys, place, times = distinct(joined([p.short[s] for p, (s, *_) in zip(parts, found, strict=True)]))
        flag = np.bincount(place, joined([o[s] for s, _, o in found], bool), len(times)) > 0
        return _sent(left.column("block")[0].as_py(), keys, lambda a, b: _bits(flag[a:b]), buckets, RANK_BITS)

    def dealt(parts: list[Piece], told: pa.Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per piece: resolved suffixes, the starts of those that buckets sort, and their keys."""
        found = settled(parts, told)
        place = distinct(joined([p.short[s] for p, (s, *_) in zip(parts, found, strict=True)]))[1]
        open_ = np.split(_flags(told, 2, 1)[0][place], np.cumsum([int(s.sum()) for s, *_ in found])[:-1])
        out = []
        for p, (s, resolved, _), o in zip(parts, found, open_, strict=True):
            starts = np.flatnonzero(p.reach(np.flatnonzero(s)[o]))
            out.append((resolved, starts, p.keys(starts)))
        return out

    def deal(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, _, times = distinct(joined([k for *_, k in dealt(read(left), right)]))
        return _sent(left.column("block")[0].as_py(), keys, lambda a, b: _bits(times[a:b] > 1), buckets, KEY_BITS)

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = read(left)
        found = dealt(parts, right)
        place = distinct(joined([k for *_, k in found]))[1]
        twins = np.split(_flags(right, 3, 1)[0][place], np.cumsum([len(k) for *_, k in found])[:-1])
        n_bytes, n_removed, n_spans, digest, rest = [], [], [], [], []
        for p, (resolved, starts, _), hot in zip(parts, found, twins, strict=True):
            d, o = p.data, p.offsets
            resolved[starts[hot]] = True
            begins = np.flatnonzero(resolved)
            gone = covered(len(d), begins, begins + LENGTH)
            begin = gone.copy()
            begin[1:] &= ~gone[:-1]
            inner = o[:-1][o[:-1] < len(d)]
            begin[inner] = gone[inner]
            begins, cover = np.concatenate([[0], np.cumsum(begin)]), np.concatenate([[0], np.cumsum(gone)])
            n_bytes.append(np.diff(o))
            n_removed.append(cover[o[1:]] - cover[o[:-1]])
            n_spans.append(begins[o[1:]] - begins[o[:-1]])
            for a, b, k in zip(o[:-1].tolist(), o[1:].tolist(), n_removed[-1].tolist(), strict=True):
                left_over = d[a:b].tobytes() if not k else b"" if k == b - a else d[a:b][~gone[a:b]].tobytes()
                digest.append(hashlib.sha256(left_over).hexdigest())
                if kept_text:
                    rest.append(left_over)
        longs = {c: pa.array(joined(x, np.int64), pa.int64()) for c, x in (("n_bytes", n_bytes), ("n_removed", n_removed), ("n_spans", n_spans))}
        out = {c: left.column(c) for c in carry} | longs | {"kept_sha256": pa.array(digest, pa.string())}
        return pa.table(out | ({"kept": pa.array(rest, pa.binary())} if kept_text else {}))

    def stage(sent: DataFrame, merge, k: int) -> DataFrame:
        return sent.groupBy("bucket").applyInArrow(merge, B.SENT).selectExpr("*", f"{k} AS stage").repartition(n, "block")

    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in carry), "n_bytes long, n_removed long, n_spans long, kept_sha256 string", *["kept binary"] * kept_text])
    mine = keyed.groupBy("block")
    ranks = stage(mine.applyInArrow(rank, B.SENT), merge_ranks, 1)
    opens = stage(mine.cogroup(ranks.groupBy("block")).applyInArrow(ask, B.SENT), lambda t: merge_flags(t, False), 2)
    both = ranks.unionByName(opens)
    keys = stage(mine.cogroup(both.groupBy("block")).applyInArrow(deal, B.SENT), lambda t: merge_flags(t, True), 3)
    return mine.cogroup(both.unionByName(keys).groupBy("block")).applyInArrow(remove, schema)
