"""SimHash near-duplicate detection with a binary trie self-join.

A fingerprint is a path in a binary trie of 64 levels.  Two nodes of the same level are walked
down together; a pair of children adds one differing bit when the turns differ, and a pair is
dropped as soon as its bits exceed the budget.  To deal the walk out, the bit string is rotated
into ``budget + 1`` tries whose top levels are another third of the bits: two fingerprints within
the budget agree on one third, so they meet under one top node of that trie.  A top node with too
many leaves is walked some levels further before it is dealt, as pairs of lower nodes whose turns
differ by no more than the budget.  Below, each node pair is walked in one task over the sorted
leaves (a node is a range of them).

Only the links of a spanning forest leave a task, never all pairs of a dense group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callboard.llm.arrays import LOWER, WORD, joined, pieces, raw, spans
from callboard.llm.mixing import row_hash
from callboard.operators.graph import connected_components

SHINGLE_WORDS = 3
BUDGET = 2
#: Leaves under one node of the trie that one task walks.
LEAVES = 8192
#: Leaves gathered for one walk, pairs of leaves that a walk may face, and pairs of leaves of one
#: node pair that are compared at once.
GATHERED = 1 << 15
HELD = 1 << 21
DIRECT = 64
SEED = 42
#: Fingerprints that are joined by a broadcast at most: those of over a HOT-th of all rows each.
HOT = 2000


#: The primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(h: np.ndarray, by: int) -> np.ndarray:
    return (h << np.uint64(by)) | (h >> np.uint64(64 - by))


def xxh64(line: bytes, low: np.ndarray, high: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of every slice line[low:high], all slices at once; those of 32 bytes and more, which
    the hash treats in another way, one by one."""
    size = high - low
    data = np.frombuffer(line + bytes(8), np.uint8)
    eights = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))
    h = np.uint64(seed) + P5 + size.astype(np.uint64)
    short = np.flatnonzero(size < 32)
    for lane in range(3):
        some = short[size[short] >= 8 * (lane + 1)]
        if len(some):
            k = _turned(np.ascontiguousarray(eights[low[some] + 8 * lane]).view("<u8").ravel() * P2, 31) * P1
            h[some] = _turned(h[some] ^ k, 27) * P1 + P4
    at = low + (size & ~7)
    some = short[size[short] & 4 > 0]
    if len(some):
        k = np.ascontiguousarray(eights[at[some], :4]).view("<u4").ravel().astype(np.uint64) * P1
        h[some] = _turned(h[some] ^ k, 23) * P2 + P3
    at = at + (size & 4)
    for byte in range(3):
        some = short[size[short] & 3 > byte]
        h[some] = _turned(h[some] ^ (data[at[some] + byte].astype(np.uint64) * P5), 11) * P1
    h ^= h >> np.uint64(33)
    h *= P2
    h ^= h >> np.uint64(29)
    h *= P3
    h ^= h >> np.uint64(32)
    long = np.flatnonzero(size >= 32)
    digest = xxhash.xxh64_intdigest
    h[long] = np.array([digest(line[a:b], seed) for a, b in zip(low[long].tolist(), high[long].tolist(), strict=True)], np.uint64)
    return h


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each text's word shingles, and the index of each text's first one."""
    starts, ends, firsts = spans(data, offsets, WORD)
    line, places = joined(data, starts, ends)
    sizes = np.diff(firsts)
    counts = np.where(sizes >= words, sizes - words + 1, np.minimum(sizes, 1))
    begins = np.concatenate([[0], np.cumsum(counts)])
    owner = np.repeat(np.arange(len(sizes)), counts)
    low = firsts[:-1][owner] + np.arange(begins[-1]) - begins[:-1][owner]
    high = np.minimum(low + words, firsts[1:][owner]) - 1
    return xxh64(line, places[low], places[high] + (ends - starts)[high]), begins


def majority(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For each text, the bits that over half of its hashes have.

    Eight bits are counted at once in the bytes of a word, over runs of 255 hashes at most.
    """
    sizes = np.diff(begins)
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    runs = -(-sizes[full] // 255)
    heads = np.concatenate([[0], np.cumsum(runs)])[:-1]
    owner = np.repeat(np.arange(len(full)), runs)
    at = begins[:-1][full][owner] + 255 * (np.arange(int(runs.sum())) - heads[owner])
    lane = np.uint64(0x0101010101010101)
    for k in range(8):
        counted = np.add.reduceat((hashes >> np.uint64(k)) & lane, at)
        each = np.add.reduceat(counted.view(np.uint8).reshape(-1, 8), heads, axis=0, dtype=np.int64)
        high = 2 * each > sizes[full][:, None]
        for byte in range(8):
            out[full] |= high[:, byte].astype(np.uint64) << np.uint64(8 * byte + k)
    return out


def fingerprints(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The carried columns and ``fp``, the text's fingerprint as a signed long."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, text):
            data, offsets = raw(part.column(part.schema.get_field_index(text)))
            fp = majority(*shingle_hashes(LOWER[data], offsets))
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in carry), pa.array(fp.view(np.int64))], [*carry, "fp"])

    schema = ", ".join(f"`{c}` {dict(docs.dtypes)[c]}" for c in carry) + ", fp long"
    return docs.select(*carry, text).mapInArrow(of, schema)


def walk(leaves: np.ndarray, roots: np.ndarray, budget: int) -> np.ndarray:
    """All (i, j) under the root pairs whose leaves differ in ``budget`` bits or fewer.

    A node is a range of sorted leaves, and roots has rows (from, to, from, to).  All pairs go
    down together, level by level: a range is split where its next bit turns to one, and a pair
    whose turns differ gains a bit.  A pair with few leaves left is compared leaf by leaf.
    """
    pairs = np.concatenate([roots, np.zeros((len(roots), 1), np.int64)], axis=1)
    found = []
    for bit in range(63, -2, -1):
        l0, l1, r0, r1, bits = pairs.T
        few = (l1 - l0) * (r1 - r0) <= (DIRECT if bit >= 0 else 1 << 62)
        if few.any():
            a, b, c, d, _ = pairs[few].T
            each = (b - a) * (d - c)
            which = np.repeat(np.arange(len(each)), each)
            k = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
            i, j = a[which] + k // (d - c)[which], c[which] + k % (d - c)[which]
            near = np.bitwise_count(leaves[i] ^ leaves[j]) <= budget
            found.append(np.stack([i[near], j[near]], 1))
            pairs = pairs[~few]
            l0, l1, r0, r1, bits = pairs.T
        if not len(pairs) or bit < 0:
            break
        ones = np.concatenate([[0], np.cumsum((leaves & (np.uint64(1) << np.uint64(bit))) != 0)])
        lc, rc = l1 - (ones[l1] - ones[l0]), r1 - (ones[r1] - ones[r0])
        kids = np.concatenate(
            [
                np.stack([l0, lc, r0, rc, bits], 1),
                np.stack([lc, l1, rc, r1, bits], 1),
                np.stack([l0, lc, rc, r1, bits + 1], 1),
                np.stack([lc, l1, r0, rc, bits + 1], 1),
            ]
        )
        pairs = kids[(kids[:, 4] <= budget) & (kids[:, 0] < kids[:, 1]) & (kids[:, 2] < kids[:, 3])]
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _forest(nodes: int, pairs: np.ndarray) -> np.ndarray:
    """At most one link per node, which connect just what the pairs connect."""
    label = np.arange(nodes)
    while len(pairs):
        a, b = label[pairs[:, 0]], label[pairs[:, 1]]
        apart = a != b
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        low = label.copy()
        np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
        while (low[low] != low).any():
            low = low[low]
        label = low[label]
    moved = np.flatnonzero(label != np.arange(nodes))
    return np.stack([label[moved], moved], 1)


def forest(groups: list[tuple[np.ndarray, np.ndarray | None]], budget: int) -> np.ndarray:
    """Links (leaf, leaf) of a spanning forest of each group's close pairs.

    A group is the leaves of one node, or of the two nodes of a pair.  Many groups are walked at
    once, and a dense one in slices, so that a walk holds a bounded number of pairs.
    """
    arrays, roots, at = [], [], 0
    for left, right in groups:
        left = np.sort(left)
        low, high = at, at + len(left)
        arrays.append(left)
        if right is not None:
            arrays.append(np.sort(right))
            low, high = high, high + len(right)
        step = max(1, HELD // max(high - low, 1))
        roots += [(a, min(a + step, at + len(left)), low, high) for a in range(at, at + len(left), step)]
        at = high
    leaves, roots = np.concatenate(arrays), np.array(roots)
    load = np.cumsum((roots[:, 1] - roots[:, 0]) * (roots[:, 3] - roots[:, 2])) // HELD
    links = [_forest(len(leaves), walk(leaves, part, budget)) for part in np.split(roots, np.flatnonzero(np.diff(load)) + 1)]
    return leaves[_forest(len(leaves), np.concatenate(links))]


def _rotate(column, by: int):
    return F.shiftleft(column, by).bitwiseOR(F.shiftrightunsigned(column, 64 - by)) if by else column


def links(fps: DataFrame, budget: int = BUDGET, leaves: int = LEAVES) -> DataFrame:
    """(src, dst) among the distinct values of ``fp`` (long, not null): a spanning forest's links
    of each top node; two fingerprints are connected if and only if a chain of pairs within
    ``budget`` bits joins them."""
    tries = budget + 1
    width = 64 // tries
    turned = fps.select(
        F.explode(F.array(*(F.struct(F.lit(t).alias("trie"), _rotate(F.col("fp"), t * width).alias("path")) for t in range(tries)))).alias("x")
    ).select("x.*")
    node = F.shiftrightunsigned("path", 64 - width)
    sizes = turned.groupBy("trie", node.alias("top")).count().where("count > 1")
    shared = turned.withColumn("top", node).join(sizes, ["trie", "top"])
    # A heavy node is walked further over the bits that part its leaves best, until nodes should be small: leaves that
    # share their next bits, as texts of one template do, are parted by those that they do not share.
    heavy = shared.where(F.col("count") > leaves)
    ones = heavy.groupBy("trie", "top", "count").agg(*(F.sum(F.expr(f"shiftrightunsigned(path, {b}) & 1")).alias(f"b{b}") for b in range(max(64 - width, 1))))
    uneven = F.array_sort(F.array(*(F.struct(F.abs(2 * F.col(f"b{b}") - F.col("count")).alias("off"), F.lit(b).alias("bit")) for b in range(max(64 - width, 1)))))
    levels = F.least(F.lit(20), F.ceil(F.log2(F.col("count") / leaves)).cast("int") + 2)
    bits = ones.select("trie", "top", F.transform(F.slice(uneven, F.lit(1), levels), lambda x: x["bit"]).alias("bits"))
    low = F.aggregate("bits", F.lit(0).cast("long"), lambda s, b: s * 2 + F.call_function("shiftrightunsigned", F.col("path"), b).bitwiseAND(F.lit(1)))
    parted = shared.join(bits, ["trie", "top"], "left").withColumn("levels", F.greatest(F.size("bits"), F.lit(0)))
    dealt = parted.withColumn("low", F.when(F.col("levels") > 0, low).otherwise(F.lit(0).cast("long")))
    turns = [F.expr(f"array(0L{''.join(', ' + ' + '.join(f'{1 << b}L' for b in c) for k in range(1, budget + 1) for c in combinations(range(d), k))})") for d in range(21)]
    masks = F.lit(None)
    for d in range(20, 0, -1):
        masks = F.when(F.col("levels") == d, turns[d]).otherwise(masks)
    masks = F.when(F.col("levels") == 0, F.array(F.lit(0).cast("long"))).otherwise(masks)
    keyed = dealt.select("trie", "top", "path", "low", F.explode(masks).alias("turn")).select(
        "trie", "top", F.least("low", F.expr("low ^ turn")).alias("a"), F.col("turn"), "path", (F.expr("(low ^ turn) < low")).alias("right")
    )
    grouped = keyed.groupBy("trie", "top", "a", "turn").agg(F.collect_list(F.when(~F.col("right"), F.col("path"))).alias("left"), F.collect_list(F.when(F.col("right"), F.col("path"))).alias("other"))
    grouped = grouped.where("(turn = 0 and size(left) > 1) or (turn <> 0 and size(left) > 0 and size(other) > 0)").select("trie", "left", "other", "turn")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = 0
            while low < batch.num_rows:  # groups of about GATHERED leaves together
                high, held = low, 0
                by_trie: dict[int, list] = {}
                while high < batch.num_rows and held < GATHERED:
                    left = batch.column(1)[high].values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                    right = None if batch.column(3)[high].as_py() == 0 else batch.column(2)[high].values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                    by_trie.setdefault(batch.column(0)[high].as_py() * width, []).append((left, right))
                    held += len(left) + (0 if right is None else len(right))
                    high += 1
                low = high
                for by, groups in by_trie.items():
                    found = forest(groups, budget)
                    back = ((found >> np.uint64(by)) | (found << np.uint64(64 - by)) if by else found).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(back[:, 0])), pa.array(np.ascontiguousarray(back[:, 1]))], ["src", "dst"])

    return grouped.mapInArrow(met, "src long, dst long")


def near_duplicates(docs: DataFrame, budget: int = BUDGET, leaves: int = LEAVES, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: the carried columns, ``fingerprint`` (16 hex digits) and
    ``component_id``, the smallest doc_id in its class.

    A null text counts as empty and gets fingerprint zero; a null doc_id never names a class
    unless the whole class has none; repeated rows stay, each with its class.  A text of any length
    counts whole; texts of one fingerprint are of one class; an empty table gives no rows.  Other columns of
    the table are ignored.
    """
    rows = fingerprints(docs, carry).checkpoint()
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies")).checkpoint()
    classes = connected_components(links(distinct.select("fp"), budget, leaves))
    # Only fingerprints with a link need their class's smallest id worked out and joined back.
    linked = distinct.join(classes, distinct.fp == classes.node).select("fp", "component", "low")
    lows = linked.groupBy("component").agg(F.min("low").alias("class_low"))
    named = distinct.join(linked.join(lows, "component").select("fp", "class_low"), "fp", "left").select("fp", "copies", F.coalesce("class_low", "low").alias("component_id")).checkpoint()
    # A fingerprint that many rows share would gather them in one task of a join.  Fewer
    # than HOT fingerprints have over a HOT-th of all rows, so those are named by a broadcast.
    often = named.agg(F.sum("copies")).first()[0] or 0
    hot = F.broadcast(named.where(F.col("copies") > often / HOT).select("fp", "component_id"))
    met = rows.join(hot, "fp", "left_anti").join(named.select("fp", "component_id"), "fp").unionByName(rows.join(hot, "fp"))
    return met.select(*carry, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The document with the smallest id of every class, with its own columns; among rows of one
    id (or none) and class the one with the least text hash, then with the least hash of all columns, and
    of equal rows just one.  Texts of any length count whole; an empty table gives no rows.

    Only ids, text hashes and classes are grouped.  The texts move once, to meet the kept keys.
    """
    key = (F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text"), F.length("text"))
    named = near_duplicates(docs.select("doc_id", "text", F.struct(*key).alias("__key")), budget, carry=("doc_id", "__key"))
    # A null class stands for rows without ids; their fingerprint tells classes of one text apart.
    kept = named.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("fp")).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__key")).alias("low"))
    kept = kept.select(F.col("low.__key").alias("__kept")).distinct()
    keyed = docs.withColumn("__key", F.struct(*key))
    alone = keyed.join(kept, F.col("__key") == F.col("__kept"), "left_semi")
    # Of rows of one id and text the one with the least hash of all columns, found before the shuffle too.
    one = alone.groupBy("__key").agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), row_hash(docs)).alias("__one"))
    return one.select(*(F.col(f"__one.`{c}`") for c in docs.columns))
