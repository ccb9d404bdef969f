import re

import numpy as np
import oracle
import pytest
from helpers import AWKWARD, AWKWARD_IDS, table

from callboard.llm import decontaminate, queries


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items):
    windows = {}
    for i, text in items:
        w = words(text)
        for k in range(max(len(w) - 12, 1) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    sizes = {len(w) for w in windows}
    out = []
    for i, text in rows:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if (g := tuple(w[k : k + size])) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[g]
        out.append((i, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in df.collect()), key=str)


@pytest.mark.parametrize("block_bytes", [1 << 25, 300])
def test_against_brute_force(spark, block_bytes):
    rng = np.random.default_rng(2)
    noise = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 40, n))
    items = [noise(30), noise(13), noise(12), "one two", "", None, "same words again same words again same words again same words again same words", noise(14)]
    docs = [*AWKWARD, items[0], noise(20) + " " + items[0].upper() + " " + noise(9), items[1] + ". " + items[2], noise(300) + " " + items[7], " ".join(items[0].split()[3:25])]
    ids = [*AWKWARD_IDS, *range(20, 20 + len(docs) - len(AWKWARD))]
    tests = table(spark, items).selectExpr("doc_id AS item_id", "text")
    df = decontaminate.contamination(table(spark, docs, ids).withColumnRenamed("lang", "hits"), tests, block_bytes=block_bytes, carry=("doc_id",))
    assert got(df) == brute(list(zip(ids, docs)), list(enumerate(items)))


def test_empty(spark):
    tests = table(spark, ["a b"]).selectExpr("doc_id AS item_id", "text")
    docs = table(spark, ["a b c", None])
    assert decontaminate.contamination(docs.limit(0), tests).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(docs, tests.limit(0)).collect())
    clash = docs.withColumnRenamed("lang", "hits").withColumnRenamed("source", "n_words")
    assert sorted(map(str, decontaminate.clean(clash, tests.limit(0)).collect())) == sorted(map(str, clash.collect()))
    assert decontaminate.clean(docs, tests).count() == 1


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf, name):
    assert oracle.same(spark, name, queries.QUERIES[name], queries.ORACLE_SQL[name], sf)
