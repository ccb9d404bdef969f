import re

import numpy as np
import xxhash
from helpers import AWKWARD, AWKWARD_IDS, table

from callboard.llm import simhash


def brute_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    fps = {}
    for i, text in rows:
        fps.setdefault(brute_fingerprint(text), []).append(i)
    keys = list(fps)
    parent = list(range(len(keys)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(keys)):
        for b in range(a):
            if (keys[a] ^ keys[b]).bit_count() <= 2:
                parent[root(a)] = root(b)
    lows = {}
    for k, key in enumerate(keys):
        lows.setdefault(root(k), []).extend(i for i in fps[key] if i is not None)
    return sorted(((i, f"{key:016x}", min(lows[root(k)], default=None)) for k, key in enumerate(keys) for i in fps[key]), key=str)


def got(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def test_awkward_rows(spark):
    docs = table(spark, AWKWARD, AWKWARD_IDS).withColumnRenamed("lang", "component")
    assert got(simhash.near_duplicates(docs)) == brute(list(zip(AWKWARD_IDS, AWKWARD)))


def test_empty_table(spark):
    assert simhash.near_duplicates(table(spark, ["x"]).limit(0)).count() == 0


def test_near_copies(spark):
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 900, 300)]
    texts = []
    for k in range(120):
        words = list(base)
        words[int(rng.integers(300))] = f"z{k}"
        texts.append(" ".join(words))
    texts += [" ".join(f"v{x}" for x in rng.integers(0, 900, 120)) for _ in range(30)]
    docs = table(spark, texts)
    expected = brute(list(enumerate(texts)))
    assert got(simhash.near_duplicates(docs)) == expected
    # Tiny nodes: the walk goes on below the top node before it is dealt.
    assert got(simhash.near_duplicates(docs, leaves=4)) == expected


def test_walk_finds_all_pairs():
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    leaves = np.unique(np.array([s ^ np.uint64(sum(1 << int(b) for b in rng.integers(0, 64, int(rng.integers(0, 4))))) for s in seeds for _ in range(40)], np.uint64))
    n = len(leaves)
    found = {tuple(p) for p in simhash.walk(leaves, np.array([[0, n // 2, 0, n], [n // 2, n, 0, n]]), 2).tolist()}
    assert found == {(a, b) for a in range(len(leaves)) for b in range(len(leaves)) if (int(leaves[a]) ^ int(leaves[b])).bit_count() <= 2}


def test_driver_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(simhash.near_duplicates(docs)) == brute(rows)


def test_one_dense_node(spark):
    """50,000 fingerprints that share all but 26 low bits: one top node in two tries, parted by the bits that differ."""
    import time

    rng = np.random.default_rng(11)
    low = np.unique(rng.integers(0, 1 << 26, 50_000)).astype(np.int64)
    fps = low | np.int64(0x5A5A_A5A5_0000_0000 | (1 << 40))
    flips = [1 << a for a in range(26)] + [1 << a | 1 << b for a in range(26) for b in range(a)]
    label = np.arange(len(low))
    pairs = []
    for f in flips:
        at = np.minimum(np.searchsorted(low, low ^ f), len(low) - 1)
        near = np.flatnonzero(low[at] == (low ^ f))
        pairs.append(np.stack([near, at[near]], 1))
    forest = simhash._forest(len(low), np.concatenate(pairs))
    while True:
        new = label.copy()
        new[forest[:, 1]] = np.minimum(new[forest[:, 1]], label[forest[:, 0]])
        new = new[new]
        if (new == label).all():
            break
        label = new
    began = time.time()
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long").repartition(8)
    got = np.array([(r.src, r.dst) for r in simhash.links(df, leaves=1000).collect()])
    assert time.time() - began < 90
    place = {int(x): k for k, x in enumerate(fps)}
    linked = np.array([(place[a], place[b]) for a, b in got.tolist()])
    mine = np.arange(len(fps))
    while True:
        new = mine.copy()
        np.minimum.at(new, linked[:, 0], mine[linked[:, 1]])
        np.minimum.at(new, linked[:, 1], mine[linked[:, 0]])
        new = new[new]
        if (new == mine).all():
            break
        mine = new
    assert (mine == label).all() and len(set(label.tolist())) > 100
