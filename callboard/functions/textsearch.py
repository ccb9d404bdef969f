"""Token, stem and trigram search over short texts."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from callboard.functions import covers, snowball

THRESHOLD = 0.55


def tokens(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+", " ")), " "), lambda t: t != ""))


def has_all(text: Column, query: str) -> Column:
    """Every token of the query is a whole token of the text."""
    return F.size(F.array_except(tokens(F.lit(query)), tokens(text))) == 0


#: What a section gives when it holds all tokens, and per token.
WEIGHTS = ((50, 10), (24, 6), (16, 4), (12, 3), (8, 2))
EXACT_TITLE = 100


def relevance(sections: list[Column], query: str) -> Column:
    """100 for an exact title, then per section its weight for all tokens and for each token.

    sections: title, description, source, requirements, rest, in this order.
    """
    wanted = tokens(F.lit(query))
    score = F.when(F.lower(F.trim(sections[0])) == query.strip().lower(), EXACT_TITLE).otherwise(0)
    for section, (whole, each) in zip(sections, WEIGHTS, strict=False):
        hits = F.size(F.array_intersect(wanted, tokens(section)))
        score = score + F.when(hits == F.size(wanted), whole).otherwise(0) + hits * each
    return score


def trigrams(word: Column) -> Column:
    """Three-letter pieces of a word with two blanks before and one after."""
    padded = F.concat(F.lit("  "), word, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(padded) - 2, F.lit(1))), lambda k: F.substring(padded, k, F.lit(3))))


def word_similarity_of(term: str, word: Column) -> Column:
    """The trigrams that a term and a word share over all that they have."""
    padded = f"  {term} "
    wanted = F.array(*map(F.lit, dict.fromkeys(padded[k : k + 3] for k in range(len(padded) - 2))))
    pieces = trigrams(word)
    shared = F.size(F.array_intersect(wanted, pieces))
    return shared / (F.size(wanted) + F.size(pieces) - shared)


def query_words(query: str) -> list[str]:
    """The lower-case words of a query, in order."""
    return "".join(c if c.isalnum() else " " for c in query.lower()).split()


def long_terms(query: str) -> list[str]:
    """The distinct terms of a query that have four letters and more."""
    return [t for t in dict.fromkeys(query_words(query)) if len(t) >= 4]


def _pieces(word: str) -> frozenset[str]:
    padded = f"  {word} "
    return frozenset(padded[k : k + 3] for k in range(len(padded) - 2))


@lru_cache(maxsize=1 << 16)
def _alike(term: str, word: str) -> float:
    """``word_similarity_of`` of two words."""
    a, b = _pieces(term), _pieces(word)
    shared = len(a & b)
    return shared / (len(a) + len(b) - shared)


def fuzzy(text: Column, query: str) -> tuple[Column, Column]:
    """(score, matches): each term of four letters and more must reach THRESHOLD; the score is the
    least among their best similarities to a word.  A query without such terms matches nothing.  Texts are
    scored in Arrow batches, a word that comes again from memory."""
    terms = long_terms(query)
    if not terms:
        return F.lit(0.0), F.lit(False)

    @F.pandas_udf(DoubleType())
    def scored(found: pd.Series) -> pd.Series:
        return found.map(lambda held: min(max((_alike(t, w) for w in held), default=0.0) for t in terms))

    score = scored(tokens(text))
    return score, score >= THRESHOLD


def words(text: Column | str) -> Column:
    """All lower-case runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+", " ")), " "), lambda t: t != "")


def morphology_match(text: Column, query: str) -> Column:
    """Every stem of the query is a stem of the text."""
    wanted = sorted(set(map(snowball.stem_word, query_words(query))))
    return F.size(F.array_except(F.array(*map(F.lit, wanted)).cast("array<string>"), snowball.stems(tokens(text)))) == 0


@dataclass(frozen=True)
class Term:
    """Words that must follow one another, or must not, by their stems."""

    stems: tuple[str, ...]
    excluded: bool = False

    def wanted(self) -> Column:
        return F.array(*map(F.lit, self.stems))


def parsed(query: str) -> list[list[Term]]:
    """The alternatives of a web-style query: ``or`` parts them, a minus excludes, quotes keep words together;
    a term of several words by itself is a phrase."""
    either: list[list[Term]] = [[]]
    for term in re.findall(r'-?"[^"]*"|\S+', query):
        found = query_words(term)
        if term.lower() == "or":
            either.append([])
        elif found:
            either[-1].append(Term(tuple(map(snowball.stem_word, found)), term.startswith("-")))
    return [g for g in either if g]


def web_match(stems: Column, groups: list[list[Term]]) -> Column:
    """Whether a text, by its stems, meets a parsed query: all terms of one of its alternatives must be
    there.  A query without terms matches nothing."""
    line = F.concat(F.lit(" "), F.array_join(stems, " "), F.lit(" "))

    def holds(term: Term) -> Column:
        there = line.contains(f" {' '.join(term.stems)} ")
        return ~there if term.excluded else there

    return reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, map(holds, g)) for g in groups), F.lit(False))


def searched(rows: DataFrame, text: str, query: str) -> DataFrame:
    """The rows whose text meets a query by its stems or by similar words, with by_stems, rank and fuzzy.

    The rank is the cover density of the query's terms (``covers``), 0 for a text that matches by similar words
    alone; words that the query excludes are among those it names.  Each step is a column of its
    own, which the next one reads.
    """
    groups = parsed(query)
    score, _ = fuzzy(F.col(text), query)
    out = rows.withColumn("__stems", snowball.stems(words(F.col(text)))).withColumn("by_stems", web_match(F.col("__stems"), groups)).withColumn("fuzzy", score)
    out = out.where(F.col("by_stems") | (F.col("fuzzy") >= THRESHOLD))
    named = sorted({s for g in groups for t in g for s in t.stems})
    out = out.withColumn("__found", covers.entries(F.col("__stems"), F.array(*map(F.lit, named)).cast("array<string>")))
    dense = covers.density(F.col("__found"), [[t.wanted() for t in g if not t.excluded] for g in groups])
    return out.withColumn("rank", F.when(F.col("by_stems"), dense).otherwise(F.lit(0.0))).drop("__stems", "__found")
