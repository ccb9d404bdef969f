import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import AWKWARD, AWKWARD_IDS, table

from callboard.llm import blocks, langid, lm
from callboard.llm.eliasfano import EliasFano


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, weights=lm.WEIGHTS):
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    texts = [["<s>", "<s>", *words(t), "</s>"] for _, t in rows]
    uni, pair, triple = Counter(), Counter(), Counter()
    for t, h in zip(texts, held, strict=True):
        if not h:
            uni.update(t[2:])
            uni["<s>"] += 1
            pair.update(zip(t[1:], t[2:]))
            pair["<s>", "<s>"] += 1
            triple.update(zip(t, t[1:], t[2:]))
    starts = uni.pop("<s>", 0)
    n, v = sum(uni.values()), len(uni)
    out = []
    for (i, _), t, h in zip(rows, texts, held, strict=True):
        base = score = 0.0
        for a, b, c in zip(t, t[1:], t[2:]):
            p = (uni[c] + 1) / (n + v + 1)
            base += math.log10(p)
            p = (pair[b, c] + weights[1] * p) / ((starts if b == "<s>" else uni[b]) + weights[1])
            p = (triple[a, b, c] + weights[2] * p) / (pair[a, b] + weights[2])
            score += math.log10(p)
        out.append((i, h, len(t) - 2, sum(uni[x] > 0 for x in t[2:]), n, base, score))
    return sorted(out, key=lambda r: (str(r[0]), r[2]))


def same(got, expected, step=1e-9):
    """step: what quantised counts beyond EXACT may add to a token's log10."""
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=lambda r: (str(r[0]), r[2]))
    for g, e in zip(got, expected, strict=True):
        assert g[:5] == e[:5]
        assert g[5] == pytest.approx(e[5], rel=1e-9)
        assert abs(g[6] - e[6]) <= step * g[2] + 1e-9 * abs(e[6])


def test_awkward_rows(spark):
    docs = table(spark, AWKWARD, AWKWARD_IDS).withColumnRenamed("lang", "body").withColumnRenamed("source", "block").withColumnRenamed("n_chars", "held_out")
    same(lm.scored(docs, langid.held_out(7, 2)).collect(), brute(list(zip(AWKWARD_IDS, AWKWARD))), lm.STEP)


def test_empty_table(spark):
    assert lm.scored(table(spark, ["x"]).limit(0), langid.held_out(7, 2)).count() == 0


TEXTS = ["the cat sat on the mat the dog ran"] * 20 + ["the end of the day"] * 9 + [f"the w{k} of w{k % 3}" for k in range(30)] + [None, "unseen"]


def test_small_counts_are_exact(spark):
    texts = [t for t in dict.fromkeys(TEXTS)] * 2
    same(lm.scored(table(spark, texts), langid.held_out(7, 2)).collect(), brute(list(enumerate(texts))))


def test_scores_do_not_depend_on_nodes_and_shards(spark, monkeypatch):
    docs = table(spark, TEXTS)
    plain = sorted(map(str, lm.scored(docs, langid.held_out(7, 2)).collect()))
    monkeypatch.setattr(lm, "SHARD_BYTES", 50)
    monkeypatch.setattr(lm, "SHARDS_A_NODE", 2)
    split = lm.scored(docs, langid.held_out(7, 2)).collect()
    assert sorted(map(str, split)) == plain
    same(split, brute(list(enumerate(TEXTS))), lm.STEP)


def test_continuations_of_a_frequent_context(spark):
    """Seen and unseen continuations of one context, asked one by one."""
    known = sorted({w for t in TEXTS for w in words(t)})
    n = len(TEXTS)
    asked = [f"the {w}" for w in known] + ["the"]
    held = langid.held_out(7, 2)
    ids = [k for k in range(10_000) if zlib.crc32(str(k).encode()) % 7 == 2][: len(asked)]
    learn = [k for k in range(20_000, 40_000) if zlib.crc32(str(k).encode()) % 7 != 2][:n]
    rows = {r.doc_id: r for r in lm.scored(table(spark, [*TEXTS, *asked, "the never"], [*learn, *ids, 10_001 + next(k for k in range(99) if zlib.crc32(str(10_001 + k).encode()) % 7 == 2)]), held).collect()}
    exact = {i: s for i, *_, s in brute([*zip(learn, TEXTS), *zip(ids, asked)])}
    assert all(abs(rows[i].score - exact[i]) < lm.STEP * 3 for i in ids)


def test_driver_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = lm.scored(docs, langid.held_out(7, 2)).collect()
    same(got, brute(rows), lm.STEP)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    folder = spark.conf.get("spark.checkpoint.dir")
    assert not [f for f in os.listdir(folder) if f.startswith("level-")]


def test_one_id_is_spread(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(4000).selectExpr("7L AS doc_id", "concat('text ', id) AS text").repartition(5).write.parquet(path)
    sizes = [r["count"] for r in blocks.dealt(spark.read.parquet(path), 8).groupBy("block").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 700


def test_one_repeated_row_is_spread(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(20_000).selectExpr("7L AS doc_id", "'the same text' AS text").coalesce(1).write.parquet(path)
    sizes = [r["count"] for r in blocks.dealt(spark.read.parquet(path), 8).groupBy("block").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 3000


def test_folder_that_cannot_be_seen(spark, tmp_path):
    assert lm.on_file(str(tmp_path / "absent"), b"abc") == b"abc"


def test_map_outlives_its_file(tmp_path):
    level = lm.on_file(str(tmp_path), b"abc" * 1000)
    assert level[:6] == b"abcabc" and len(level) == 3000 and not os.listdir(tmp_path)
    assert lm.on_file(None, b"abc") == b"abc"


def test_quantised_counts():
    counts = np.concatenate([np.arange(1, 5000), 10 ** np.arange(4, 12)])
    got = lm.VALUES[lm.quantised(counts)]
    assert (got[: lm.EXACT] == counts[: lm.EXACT]).all() and (np.abs(np.log10(got / counts)) <= lm.STEP / 2 + 1e-12).all()


def test_search_stays_in_its_context():
    """A successor that another context has is not found."""
    shape = lm.Keys(56, 1)
    keys = np.array([(3 << 27) | 5, (3 << 27) | 9, (8 << 27) | 7], np.uint64)
    level = lm.Successors.mapped(lm.Successors.build(keys, np.array([1, 2, 200]), shape), shape)
    asked = np.array([(3 << 27) | 5, (3 << 27) | 7, (4 << 27) | 5, (8 << 27) | 5, (8 << 27) | 7], np.uint64)
    assert lm.VALUES[level(asked)].round().tolist() == [1, 0, 0, 0, round(lm.VALUES[lm.quantised(np.array([200]))[0]])]


@pytest.mark.parametrize(("n", "universe"), [(0, 100), (1, 1), (5, 10), (1000, 1 << 40), (3000, 4000), (5000, 1 << 62), (7000, 1 << 22)])
def test_elias_fano(n, universe):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, universe, n)).astype(np.uint64)
    levels, _ = EliasFano.from_buffer(EliasFano.build(values, universe).to_bytes())
    asked = np.concatenate([values, rng.integers(0, universe, 200).astype(np.uint64), np.array([0, universe - 1], np.uint64)])
    assert (levels.get(np.arange(n)) == values).all()
    assert (levels.first(asked) == np.searchsorted(values, asked)).all()
    known = set(values.tolist())
    assert ((levels.find(asked) >= 0) == [x in known for x in asked.tolist()]).all()
