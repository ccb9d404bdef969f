import hashlib
from collections import Counter

import numpy as np
from helpers import AWKWARD, AWKWARD_IDS, table

from callboard.llm import repeats


def brute(rows):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + 200] for _, b in texts for k in range(len(b) - 199))
    out = []
    for i, b in texts:
        gone = [False] * len(b)
        last = 0
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                for x in range(max(k, last), k + 200):
                    gone[x] = True
                last = k + 200
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def test_cover():
    assert len({(a - b) % repeats.PERIOD for a in repeats.COVER for b in repeats.COVER}) == repeats.PERIOD


def test_awkward_rows(spark):
    docs = table(spark, AWKWARD, AWKWARD_IDS).withColumnRenamed("lang", "bucket")
    assert got(repeats.repeats(docs)) == brute(list(zip(AWKWARD_IDS, AWKWARD)))


def test_empty_table(spark):
    assert repeats.repeats(table(spark, ["x"]).limit(0)).count() == 0


def test_shared_passages(spark):
    rng = np.random.default_rng(3)
    noise = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    passage, short = noise(260), noise(150)
    texts = [noise(int(rng.integers(50, 900))) + (passage if k % 3 == 0 else short) + noise(int(rng.integers(0, 300))) for k in range(60)]
    texts += [passage[5:205], passage[5:204], "z" * 199, "z" * 200, "y" * 201, texts[1], texts[1]]
    assert got(repeats.repeats(table(spark, texts))) == brute(list(enumerate(texts)))


def test_driver_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(repeats.repeats(docs)) == brute(rows)


def test_fragments_of_resolved_copies(spark):
    """Copies resolve one another by long ranks, yet count as twins for shorter passages of theirs."""
    rng = np.random.default_rng(11)
    noise = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    whole = [noise(int(n)) for n in rng.integers(250, 1500, 12)]
    texts = [t for t in whole for _ in range(2)]
    for t in whole:
        for size in (199, 200, 201, 260, 330, 340):
            at = int(rng.integers(0, max(len(t) - size, 1)))
            texts.append(noise(int(rng.integers(0, 150))) + t[at : at + size] + noise(int(rng.integers(0, 150))))
    texts += [t[-230:] for t in whole[:4]] + [t[:215] for t in whole[:4]] + ["ab" * 400, "ab" * 101, "c" * 5000]
    assert got(repeats.repeats(table(spark, texts, partitions=7))) == brute(list(enumerate(texts)))


def test_one_id_and_none(spark):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abcdef"), 300)) for _ in range(40)] + ["same text " * 30] * 5 + [None] * 5
    for ids in ([7] * 50, [None] * 50):
        assert got(repeats.repeats(table(spark, texts, ids))) == brute(list(zip(ids, texts)))


def test_clashing_columns_are_not_carried(spark):
    docs = table(spark, ["x" * 300, "y"]).withColumnRenamed("lang", "n_spans").withColumnRenamed("source", "block")
    out = repeats.repeats(docs, ("doc_id", "n_spans", "block", "n_chars"), kept_text=True)
    assert out.columns == ["doc_id", "n_chars", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    assert {(r.doc_id, bytes(r.kept)) for r in out.collect()} == {(0, b""), (1, b"y")}
