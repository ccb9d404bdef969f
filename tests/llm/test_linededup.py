import hashlib
import random
import re

import numpy as np
import pytest
from helpers import AWKWARD, AWKWARD_IDS, table

from callboard.llm import linededup


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def brute(rows, documents=5):
    held = {}
    for k, (i, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                held.setdefault(key(line), set()).add(("row", k) if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        keep = []
        for line in lines:
            of = held.get(key(line), set())
            named = [x for x in of if not isinstance(x, tuple)]
            keep.append(len(of) < documents or not named or i == max(named))
        left = "\n".join(line for line, k in zip(lines, keep, strict=True) if k)
        out.append((i, len(lines), len(lines) - sum(keep), hashlib.sha256(left.encode()).hexdigest(), left))
    return sorted(out, key=str)


def check(spark, rows, partitions=3):
    docs = table(spark, [t for _, t in rows], [i for i, _ in rows], partitions=partitions).withColumnRenamed("lang", "keep").withColumnRenamed("source", "same")
    expected = brute(rows)
    got = linededup.digest(docs, linededup.bitmaps(docs))
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == [r[:4] for r in expected]
    left = linededup.deduplicated(docs)
    assert set(left.columns) == set(docs.columns)
    assert sorted((r.doc_id, r.text or "") for r in left.where("doc_id is not null").collect()) == sorted((r[0], r[4]) for r in expected if r[0] is not None)
    return expected


LONG = [f"this is line number {k} of the lines that have forty signs" for k in range(60)]


def test_against_brute_force(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(400):
        lines = [rng.choice(LONG[:3]) if rng.random() < 0.3 else rng.choice(LONG) for _ in range(rng.randrange(1, 7))]
        texts.append("\n".join(f" {x.upper()}\t\r" if rng.random() < 0.2 else x for x in lines) + rng.choice(["", "\n", "\n\nshort", "\n" + "é" * 40, "\n" + "é" * 39]))
    rows = list(zip(rng.sample(range(5000), 400), texts))
    assert sum(r[2] for r in check(spark, rows)) > 300


def test_hot_line_over_many_partitions(spark):
    """One line in every document, sorted into more ranges than one."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = [(k, f"{LONG[0]}\nown line of document {k}\n{LONG[k % 50]}") for k in range(3000)]
        assert sum(r[2] > 0 for r in check(spark, rows, 7)) == 2999
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("size", [1, 3, 10_000])
def test_stream_in_batches(size):
    """Batches of any size, and a partition's first and last hash, against counting."""
    import pyarrow as pa

    rng = np.random.default_rng(size)
    rows = sorted({(int(h), int(i)) for h, i in zip(rng.integers(0, 12, 150), rng.integers(0, 40, 150))}, key=lambda r: (r[0], -r[1]))
    batch = pa.RecordBatch.from_pydict({
        "h1": [h for h, _ in rows], "h2": [0] * len(rows), "doc_id": [i for _, i in rows], "same": [i for _, i in rows],
        "n_lines": pa.array([1] * len(rows), pa.int32()), "lines": [b"\0\0\0\0"] * len(rows),
    })
    stream, out = linededup.Stream(5), []
    for a in range(0, len(rows), size):
        out += stream.batch(batch.slice(a, size))
    out += stream.closed(batch.schema)
    said = [r for b in out for r in b.to_pylist()]
    top, n = {h: max(i for g, i in rows if g == h) for h, _ in rows}, {h: sum(g == h for g, _ in rows) for h, _ in rows}
    first, last = rows[0][0], rows[-1][0]
    sums = {r["h1"]: (r["n"], r["doc_id"]) for r in said if r["kind"] == linededup.SUM}
    assert sums == {h: (n[h], top[h]) for h in (first, last)}
    gone = {(r["h1"], r["doc_id"]) for r in said if r["kind"] == linededup.GOES} | {(r["h1"], r["doc_id"]) for r in said if r["kind"] == linededup.OPEN and sums[r["h1"]][0] >= 5 and r["doc_id"] != sums[r["h1"]][1]}
    assert gone == {(h, i) for h, i in rows if n[h] >= 5 and i != top[h]}


def test_awkward_tables(spark):
    check(spark, list(zip(AWKWARD_IDS, AWKWARD)))
    same = f"{LONG[1]}\n\n{LONG[1].upper()}"
    check(spark, [(3, same)] * 6 + [(2, same), (1, LONG[1])])  # three documents, however often repeated
    check(spark, [(3, same)] * 6 + [(2, same), (1, LONG[1]), (0, LONG[1]), (-4, f"  {LONG[1]}"), (3, LONG[1] + "\nother")])
    check(spark, [(None, same)] * 5 + [(None, "x"), (4, "y")])
    check(spark, [(None, same)] * 5 + [(7, same)])
    check(spark, [(k, "\n".join([LONG[2]] * 20_000)) for k in range(6)])
    check(spark, [])
