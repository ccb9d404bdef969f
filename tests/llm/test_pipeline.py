import re
from collections import Counter

import test_decontaminate as d
import test_simhash as s
from helpers import AWKWARD, AWKWARD_IDS, table
from pyspark.sql import functions as F

import corpus_pipeline
from callboard.llm import mixing, sharding, simhash


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    columns, before = docs.columns, rows(docs)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        after = rows(out)
        if name != "sharding":
            assert out.columns == columns
        if name == "toxicity":
            assert 0 < len(before) - len(after) < 0.2 * len(before) and set(after) <= set(before)
        if name == "near_dedup":
            assert sorted(i for i, _ in after) == sorted({low for _, _, low in s.brute(before)})
        if name == "decontamination":
            assert sorted(i for i, _ in after) == sorted(i for i, *_, bad in d.brute(before, benchmark) if not bad)
        if name == "mixing":
            size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
            total = sum(size(t) for _, t in before)
            assert abs(sum(size(t) for _, t in after) - 1.5 * total) < 30
            whole = dict(before)
            assert all(whole[i].startswith(t) for i, t in after)
            assert max(Counter(i for i, _ in after).values()) <= 2
        if name == "sharding":
            assert Counter(after) == Counter(before) and {r.shard for r in out.select("shard").distinct().collect()} <= set(sharding.names())
        docs, before = out, after


def test_one_of_each(spark):
    docs = table(spark, [*AWKWARD, *AWKWARD], [*AWKWARD_IDS, *AWKWARD_IDS])
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    classes = {low for _, _, low in s.brute(list(zip(AWKWARD_IDS, AWKWARD)))}
    assert len(got.collect()) == len(classes)
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def _words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text))


def test_mixture_of_equal_rows_by_source(spark):
    """Rows of one id and text in several sources: each source gets its own words, however rows come."""
    texts = [f"text {k} " + "w " * (k % 40) for k in range(200)]
    rows = [(k, t, s) for k, t in enumerate(texts) for s in ("a", "b", None)] + [(7, texts[7], "a")] * 50
    seen = set()
    for n in (1, 3, 7):
        docs = table(spark, [t for _, t, _ in rows], [k for k, *_ in rows], langs=[f"l{k % 5}" for k in range(len(rows))], sources=[s for *_, s in rows], partitions=n)
        plan = {r.source: r.target for r in mixing.targets(mixing.keyed(docs)).collect()}
        out = mixing.mixture(docs).collect()
        for source, target in plan.items():
            assert abs(sum(_words(r.text) for r in out if r.source == source) - target) <= 1, (n, source)
        seen.add(tuple(sorted(map(str, out))))
    assert len(seen) == 1


def test_one_of_each_does_not_depend_on_order(spark):
    rows = [(k, f"some words of text {k}", lang) for k in range(100) for lang in ("de", "en")]
    kept = {tuple(sorted(map(str, simhash.one_of_each(table(spark, [t for _, t, _ in rows], [k for k, *_ in rows], langs=[x for *_, x in rows], partitions=n)).collect()))) for n in (1, 3, 7)}
    assert len(kept) == 1


def test_run_on_awkward_tables(spark, sf, tmp_path):
    """Null ids, null and empty texts, repeated rows and extra columns go through; so does nothing at all."""
    import os

    source = spark.read.parquet(f"{sf}/documents.parquet")
    odd = table(spark, [*AWKWARD, *AWKWARD], [*AWKWARD_IDS, *AWKWARD_IDS]).withColumn("source", F.when(F.col("doc_id") > 4, F.col("source")))
    for name, docs in (("odd", source.unionByName(odd)), ("none", source.limit(0))):
        folder = tmp_path / name
        docs.withColumn("score", F.lit("extra")).withColumn("block", F.lit(1)).withColumn("slot", F.lit("x")).write.parquet(str(folder / "documents.parquet"))
        for other in ("labels", "benchmark"):
            spark.read.parquet(f"{sf}/{other}.parquet").write.parquet(str(folder / f"{other}.parquet"))
        shared = spark.conf.get("spark.checkpoint.dir")
        seen = set(os.listdir(shared))
        out = corpus_pipeline.run(spark, str(folder))
        assert set(docs.columns) | {"score", "block", "slot", "shard"} == set(out.columns)
        assert (out.count() == 0) == (name == "none")
        assert out.where("text is null or trim(text) = ''").count() == 0
        (at,) = (f for f in set(os.listdir(shared)) - seen if f.startswith("corpus-"))
        assert os.listdir(f"{shared}/{at}") == ["4-sharding"]
