import math
import random
import re
from collections import Counter

import pytest
from helpers import AWKWARD, AWKWARD_IDS, table

from callboard.llm import lexical


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    n_all, l_all = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            if c:
                m = 25 + (75 * sum(c.values()) * n_all) // l_all
                s = sum(times * math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in Counter(terms(text)).items() if c[t])
                if s > 0:
                    scored.append((-s, i is None, i, s))
        out += [(item, k, i, s) for k, (*_, i, s) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 2000, "item_bytes": 400}])
def test_against_brute_force(spark, sizes):
    rng = random.Random(5)
    vocabulary = [f"w{int(rng.paretovariate(0.6)) % 90}" for _ in range(400)]
    noise = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs = [*AWKWARD, *(noise(rng.randrange(1, 80)) for _ in range(300)), *[noise(30)] * 40, "É Straße x9_y w1.w1"]
    ids = [*AWKWARD_IDS, *rng.sample(range(1000, 9000), len(docs) - len(AWKWARD))]
    asked = [*(noise(k) for k in range(1, 30)), docs[-3], "W1 w1 W2-w2", "lorem 漢字", "nothing known", "", None, "straße É"]
    items = table(spark, asked).selectExpr("doc_id AS item_id", "text", "lang AS score")
    found = lexical.search(table(spark, docs, ids).withColumnRenamed("lang", "item").withColumnRenamed("source", "rank"), items, **sizes)
    assert got(found) == brute(list(zip(ids, docs)), list(enumerate(asked)))


def test_ties_and_repeated_rows(spark):
    docs, ids = ["alpha beta"] * 30 + ["gamma"] * 3, [*range(30, 0, -1), None, None, 7]
    items = table(spark, ["alpha", "gamma beta", "gamma"], [1, 1, None]).selectExpr("doc_id AS item_id", "text")
    assert got(lexical.search(table(spark, docs, ids), items)) == brute(list(zip(ids, docs)), [(1, "alpha"), (1, "gamma beta"), (None, "gamma")])


def test_empty_tables(spark):
    docs = table(spark, ["a b", None, ""])
    items = docs.selectExpr("doc_id AS item_id", "text")
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs.where("text is null"), items).count() == 0


def test_prunes(spark, sf, monkeypatch):
    """Most documents of a block are never scored."""
    import numpy as np
    import pyarrow.parquet as pq

    from callboard.llm.arrays import owners

    docs = pq.read_table(f"{sf}/documents.parquet", columns=["text"]).column(0).combine_chunks()
    items = lexical.Items(pq.read_table(f"{sf}/benchmark.parquet", columns=["text"]).column(0).combine_chunks())
    words, firsts = lexical.terms(docs)
    at, term = items.found(words)
    doc = owners(firsts)[at]
    items.weigh(len(docs), len(words), Counter((np.unique(doc * len(items.vocabulary) + term) % len(items.vocabulary)).tolist()))
    postings = lexical.Postings(items, doc, term, np.diff(firsts))
    scored = []
    monkeypatch.setattr(lexical.bisect, "insort", lambda best, x: (best.append(x), best.sort(), scored.append(x)))
    total = 0
    for asked, times in zip(items.terms, items.times, strict=True):
        best = []
        postings.search(asked, items.weights[asked] * times, [(False, k) for k in range(len(docs))], best, 10)
        total += len(docs)
        assert len(best) == 10
    assert len(scored) < total / 5
