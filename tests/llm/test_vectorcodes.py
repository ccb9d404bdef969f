import hashlib
import math
import random

import numpy as np
from pyspark.sql import types as T

from callboard.llm import vectorcodes as v

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("code", T.StringType())])


def brute(rows):
    kept = [(i, x, lab) for i, x, lab, *_ in rows if x and all(c is not None and math.isfinite(c) for c in x)]
    kept = sorted(((i is None, i or 0, [math.floor(4096 * float(np.float32(c))) for c in x], lab) for i, x, lab in kept), key=lambda r: r[:3])
    if not kept:
        return []
    x = np.array([r[2] for r in kept], object).reshape(len(kept), 8, -1)
    books = [[list(r[p]) for r in x[:16]] for p in range(8)]

    def assign():
        out = []
        for r in x:
            row = []
            for p in range(8):
                d = [sum((a - b) ** 2 for a, b in zip(r[p], c, strict=True)) for c in books[p]]
                row.append((d.index(min(d)), min(d)))
            out.append(row)
        return out

    for _ in range(6):
        got = assign()
        for p in range(8):
            for e in range(len(books[p])):
                mine = [r[p] for r, g in zip(x, got, strict=True) if g[p][0] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    out = [(None if r[0] else r[1], "".join(f"{e:02x}" for e, _ in g), sum(d for _, d in g), r[3]) for r, g in zip(kept, assign(), strict=True)]
    return sorted(((i, c, e, sum(o[2] for o in out if o[3] == lab), sha) for i, c, e, lab in out), key=str)


def check(spark, rows, partitions=3):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(partitions)
    got = v.digest(*v.compressed(df))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_against_plain_rounds(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (30, 16))
    rows = [(k, [float(c) for c in centres[rng.integers(30)] + rng.normal(0, 0.2, 16)], int(rng.integers(4)) if k % 7 else None) for k in range(400)]
    check(spark, rows)


def test_ties_and_repeated_entries(spark):
    """Few distinct values: equal distances, equal entries and entries that nothing is assigned to."""
    rng = random.Random(4)
    rows = [(k, [rng.choice((0.0, 0.001, -0.001)) for _ in range(8)], k % 3) for k in range(300)]
    check(spark, rows)
    check(spark, [(k, [0.5] * 8, 1) for k in range(40)])


def test_awkward_tables(spark):
    good = [0.1 * k for k in range(8)]
    odd = [(1, None, 1), (2, [None, *good[1:]], 1), (3, [float("nan"), *good[1:]], 1), (4, [float("-inf"), *good[1:]], None), (5, [], 1)]
    rows = [*odd, (6, good, None), (6, good, None), (6, [-c for c in good], 2), (None, good[::-1], 2), (9, [7e3, *good[1:]], 2), (10, [-7e3, *good[1:]], None)]
    check(spark, rows)
    check(spark, odd)
    check(spark, [])
    # A vector of another length than the first one's has no code.
    df = spark.createDataFrame([(1, good, 1, "x"), (2, good[:4], 1, "x"), (3, good + good, 1, "x")], SCHEMA)
    assert [r.vec_id for r in v.digest(*v.compressed(df)).collect()] == [1]


def test_round_trip(spark, sf):
    """With an entry for every row each vector comes back, to the scale's step."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").limit(16)
    codes, books = v.compressed(rows, rounds=1)
    back = {r.vec_id: r.decoded for r in v.decoded(codes, books).collect()}
    for r in rows.collect():
        assert np.abs(np.array(back[r.vec_id]) - np.array(r.embedding)).max() <= 1 / 4096


def test_balls_skip_work():
    """Parts in a ball's core are never measured against another entry."""
    centres = np.array([[0], [1000], [100_000]], np.int64)
    part = np.array([[1], [2], [998], [520], [100_001]], np.int64)
    code = np.array([0, 0, 1, 0, 2], np.uint8)
    squared = np.array([[520**2, 4, 1]])
    balls = v.Codebooks(centres[None], squared, np.ones((1, 3), bool)).neighbours()[0]
    assert [list(near) for near, _ in balls] == [[1], [], []]
    assert v.reassigned(part, code, centres, balls, np.ones(3, bool)).tolist() == [0, 0, 1, 1, 2]
    assert v.reassigned(part, code, centres, balls, np.zeros(3, bool)).tolist() == code.tolist()
