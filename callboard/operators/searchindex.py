"""A stored search index over titles, so that a query reads the postings it needs and no title else.

Tables, each sorted over range partitions, so that a filter on its first column reads a few row groups:

* ``stems`` (stem, key): titles by the stems of their words;
* ``words`` (word, key): titles by their words;
* ``grams`` (gram, size, word): distinct words by their trigrams, with how many they have;
* ``frequencies`` (gram, words): how many words hold a trigram.

A query names candidates: titles with all stems of one of its alternatives, and titles with words similar to all of its
terms.  Similar words are found by prefix and size: a word that shares enough trigrams with a term has one of the
term's rarest, and not many more or fewer trigrams than the term.  The candidates' titles are then judged as a
scan judges them, so the index changes what is read and never what is found.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callboard.functions import snowball, textsearch

TABLES = ("stems", "words", "grams", "frequencies")
#: So many words are asked for by value, which the scan can prune by; more of them are joined.
LISTED = 1000


def _write(rows: DataFrame, path: str, *order: str) -> None:
    # Ranges over all columns: a word that a third of the titles hold spans several files.
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("append").parquet(path)


def build(rows: DataFrame, path: str, key: str, text: str) -> SearchIndex:
    """Writes the tables for some titles, or adds to the tables that are there.  Keys stand for rows: titles of
    one key are one.  Null and blank titles have no words."""
    # Written once: each table draws its ranges from it and then sorts it.
    held = rows.select(F.col(key).alias("key"), F.explode(F.array_distinct(textsearch.words(F.col(text)))).alias("word")).distinct().checkpoint()
    _write(held, f"{path}/words", "word", "key")
    spark = rows.sparkSession
    # Distinct words are stemmed and cut once, however many titles hold them; those known before are not new.
    distinct = held.select("word").distinct().withColumn("stem", snowball.stem(F.col("word"))).checkpoint()
    _write(held.join(distinct, "word").select("stem", "key").distinct(), f"{path}/stems", "stem", "key")
    pieces = distinct.select("word", textsearch.trigrams(F.col("word")).alias("pieces"))
    if _exists(spark, f"{path}/grams"):
        pieces = pieces.join(spark.read.parquet(f"{path}/grams").select("word").distinct(), "word", "left_anti")
    grams = pieces.select(F.explode("pieces").alias("gram"), F.size("pieces").alias("size"), "word").checkpoint()
    _write(grams, f"{path}/grams", "gram", "size", "word")
    _write(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("words")), f"{path}/frequencies", "gram")
    return SearchIndex(spark, path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


@dataclass(frozen=True)
class SearchIndex:
    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def similar_words(self, term: str, threshold: float = textsearch.THRESHOLD) -> DataFrame:
        """(word, similarity): the index's words whose trigrams are similar to the term's."""
        padded = f"  {term} "
        pieces = list(dict.fromkeys(padded[k : k + 3] for k in range(len(padded) - 2)))
        known = {r["gram"]: r["n"] for r in self.table("frequencies").where(F.col("gram").isin(pieces)).groupBy("gram").agg(F.sum("words").alias("n")).collect()}
        # Of n trigrams a similar word shares ceil(t n); so it has one of the n - ceil(t n) + 1 rarest.
        least = math.ceil(threshold * len(pieces) - 1e-9)
        rare = sorted(pieces, key=lambda g: (known.get(g, 0), g))[: len(pieces) - least + 1]
        asked = [g for g in rare if g in known]
        most = math.floor(len(pieces) / threshold + 1e-9)
        near = self.table("grams").where(F.col("gram").isin(asked) & F.col("size").between(least, most)).select("word").distinct()
        score = textsearch.word_similarity_of(term, F.col("word"))
        return near.select("word", score.alias("similarity")).where(F.col("similarity") >= threshold)

    def _holding(self, found: DataFrame) -> DataFrame:
        """(word, similarity, key) of the titles that hold some words."""
        some = [r["word"] for r in found.select("word").limit(LISTED + 1).collect()]
        words = self.table("words")
        return found.join(words.where(F.col("word").isin(some)) if len(some) <= LISTED else words, "word")

    def similar(self, query: str) -> DataFrame:
        """(key, fuzzy): titles with a word similar to each term of four letters and more, and the least of the
        terms' best similarities."""
        terms = textsearch.long_terms(query)
        if not terms:
            return self.table("words").select("key", F.lit(0.0).alias("fuzzy")).where(F.lit(False))
        best = [self._holding(self.similar_words(t)).groupBy("key").agg(F.max("similarity").alias(f"s{k}")) for k, t in enumerate(terms)]
        every = reduce(lambda a, b: a.join(b, "key"), best)
        scores = [F.col(f"s{k}") for k in range(len(terms))]
        return every.select("key", (F.least(*scores) if len(scores) > 1 else scores[0]).alias("fuzzy"))

    def stemmed(self, query: str) -> DataFrame:
        """(key): titles with all stems of an alternative of the query; phrases and exclusions are left to the
        titles themselves."""
        groups = [sorted({s for t in g if not t.excluded for s in t.stems}) for g in textsearch.parsed(query)]
        groups = [g for g in groups if g]
        asked = sorted({s for g in groups for s in g})
        held = self.table("stems").where(F.col("stem").isin(asked)).groupBy("key").agg(F.collect_set("stem").alias("held"))
        met = reduce(lambda a, b: a | b, (F.size(F.array_intersect("held", F.array(*map(F.lit, g)))) == len(g) for g in groups), F.lit(False))
        return held.where(met).select("key")

    def candidates(self, query: str) -> DataFrame | None:
        """(key) of the titles to look at; None for all of them, where an alternative only excludes."""
        if any(all(t.excluded for t in g) for g in textsearch.parsed(query)):
            return None
        return self.stemmed(query).union(self.similar(query).select("key")).distinct()

    def search(self, rows: DataFrame, query: str, key: str, text: str, order: tuple[Column, ...] = ()) -> DataFrame:
        """The rows that a scan with ``textsearch.searched`` finds, with its by_stems, rank and fuzzy; the closest
        first, then by ``order`` and key."""
        near = self.candidates(query)
        met = rows if near is None else rows.join(near.withColumnRenamed("key", "__key"), F.col(key) == F.col("__key"), "left_semi")
        judged = textsearch.searched(met, text, query)
        return judged.orderBy(F.desc("by_stems"), F.desc("rank"), F.desc("fuzzy"), *order, key)
