"""The stored index, the cover-density rank and the stemmer, against plain versions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from callboard.functions import covers, snowball, textsearch
from callboard.operators import searchindex

#: Pairs of the stemmer's published sample vocabulary.
PAIRS = """в в вавиловка вавиловк вагнера вагнер вагон вагон вагона вагон вагоне вагон вагонов вагон вагоном вагон вагоны вагон важная важн важнее важн важнейшие важн
важнейшими важн важничал важнича важно важн важного важн важности важност важностию важност важность важност важностью важност важную важн вазах ваз вазы ваз вакса вакс вакханка вакханк
вал вал валандался валанда валентина валентин валериановых валерианов валерию валер валетами валет п п па па пава пав павел павел павильон павильон павильонам павильон павла павл
павлиний павлин павлиньи павлин павлиньим павлин павлович павлович павловна павловн павловны павловн павловцы павловц павлыч павлыч пагубная пагубн падает пада падай пада падал пада
падаль падал падать пада падаю пада падающего пада падающие пада падеж падеж пади пад падкой падк падут падут падучая падуч падчерицей падчериц падшая падш""".split()


def test_published_stems(spark):
    df = spark.createDataFrame(list(zip(PAIRS[::2], PAIRS[1::2])), "word string, stem string")
    assert [r.word for r in df.where(snowball.stem(F.col("word")) != F.col("stem")).collect()] == []
    odd = spark.createDataFrame([("",), ("xyz",), ("ёлка",), (None,)], "word string")
    assert [r[0] for r in odd.select(snowball.stem(F.col("word"))).collect()] == ["", "xyz", "елк", None]


def brute_density(places, groups):
    """Shortest stretches that meet the query, found among all stretches."""
    def meets(a, b):
        inside = {p: s for p, s in places if a <= p <= b}
        return any(all(any(all(inside.get(p + k) == w for k, w in enumerate(t)) for p in inside) for t in g) for g in groups)

    spots = [p for p, _ in places]
    good = [(a, b) for a, b in itertools.combinations_with_replacement(spots, 2) if meets(a, b)]
    shortest = [(a, b) for a, b in good if not any((c, d) != (a, b) and a <= c and d <= b for c, d in good)]
    w = sum(0.1 / (1 + (b - a + 1) - sum(a <= p <= b for p in spots)) for a, b in shortest)
    return w / (w + 1)


GROUPS = [[[("a",), ("b",)]], [[("a",), ("b",), ("c",)]], [[("a", "b")]], [[("a",), ("b", "c")], [("d",)]], [[("a", "a")], [("c", "b", "a")]]]


@pytest.mark.parametrize("groups", GROUPS)
def test_cover_density(spark, groups):
    rng = random.Random(str(groups))
    texts = [[rng.choice("abcdxyz") for _ in range(rng.randrange(0, 14))] for _ in range(150)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t array<string>")
    asked = sorted({w for g in groups for t in g for w in t})
    found = df.withColumn("e", covers.entries(F.col("t"), F.array(*map(F.lit, asked))))
    rank = covers.density(F.col("e"), [[F.array(*map(F.lit, t)) for t in g] for g in groups])
    for r in found.select("t", rank.alias("rank")).collect():
        places = [(p, s) for p, s in enumerate(r.t) if s in asked]
        assert abs(r["rank"] - brute_density(places, groups)) < 1e-12, r.t


QUERIES = ["грантов молодым", 'конкурс or "малый бизнес" -итоги', "конкурсс", "стипендия студенческая поддержкаа", "a b", "нет такого", "-итоги", "гранты конкурсы"]


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    rng = random.Random(2)
    words = "конкурс конкурса конкурсы грант гранты грантов малый малого бизнес бизнеса молодым молодые итоги итог студенческая стипендия стипендии поддержка поддержки фонд a b".split()
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 7)))) for k in range(400)] + [(900, None), (901, " "), (902, "Малый-Бизнес")]
    df = spark.createDataFrame(rows, "id long, title string")
    path = str(tmp_path / "index")
    searchindex.build(df.where("id < 200"), path, "id", "title")
    index = searchindex.build(df.where("id >= 200"), path, "id", "title")
    key = lambda r: (r.id, r.by_stems, round(r["rank"], 9), round(r.fuzzy, 9))
    for q in QUERIES:
        assert sorted(map(key, index.search(df, q, "id", "title").collect())) == sorted(map(key, textsearch.searched(df, "title", q).collect())), q
    assert index.search(df, "гранты", "id", "title").count() > 50


def test_index_reads_postings_only(spark, tmp_path):
    """Similar words come from the rarest trigrams and a range of sizes, pushed to the scan."""
    df = spark.range(3000).select("id", F.concat(F.lit("word"), F.hex(F.xxhash64("id"))).alias("title"))
    index = searchindex.build(df, str(tmp_path / "index"), "id", "title")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = index.similar_words("wordabcdef")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(size,7), LessThanOrEqual(size,20)], ReadSchema" in plan
    words = {r.word for r in index.table("words").select("word").collect()}
    term = sorted(words)[7][:-1]
    plain = {r.word for r in index.table("words").select("word").distinct().where(textsearch.word_similarity_of(term, F.col("word")) >= textsearch.THRESHOLD).collect()}
    assert {r.word for r in index.similar_words(term).collect()} == plain and plain
