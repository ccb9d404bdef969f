"""The Snowball stemmer for Russian.

A word's endings only count in its region RV, after the first vowel; a derivational ending in R2, after
the second group of a vowel and a consonant.  Steps follow the published algorithm.  Words without Cyrillic
vowels stay as they are.  Columns are stemmed in Arrow batches, a word that comes again from memory.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

VOWELS = "аеиоуыэюя"
#: The endings of the published algorithm, by class; those under AFTER_A follow ``а`` or ``я``.
GERUND_AFTER_A = "в вши вшись"
GERUND = "ив ивши ившись ыв ывши ывшись"
ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею"
PARTICIPLE_AFTER_A = "ем нн вш ющ щ"
PARTICIPLE = "ивш ывш ующ"
REFLEXIVE = "ся сь"
VERB_AFTER_A = "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно"
VERB = "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю"
NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я"
SUPERLATIVE = "ейш ейше"
DERIVATIONAL = "ост ость"


def _ending(plain: str, after_a: str = "") -> re.Pattern:
    """A pattern of the longest of some endings; a match from the left is the longest at the end."""
    either = [*plain.split(), *(f"(?<=[ая]){x}" for x in after_a.split())]
    return re.compile(f"(?:{'|'.join(either)})$")


_HEAD = re.compile(f"[^{VOWELS}]*[{VOWELS}]")
_R2 = re.compile(f"(?:[^{VOWELS}]*[{VOWELS}]+[^{VOWELS}]){{2}}")
_GERUND, _ADJECTIVE, _PARTICIPLE = _ending(GERUND, GERUND_AFTER_A), _ending(ADJECTIVE), _ending(PARTICIPLE, PARTICIPLE_AFTER_A)
_REFLEXIVE, _VERB, _NOUN = _ending(REFLEXIVE), _ending(VERB, VERB_AFTER_A), _ending(NOUN)
_SUPERLATIVE, _DERIVATIONAL = _ending(SUPERLATIVE), _ending(DERIVATIONAL)


def _inflected(rv: str) -> str:
    """RV without its inflection: a gerund's, or an adjective's, a verb's or a noun's after a reflexive one."""
    bare = _GERUND.sub("", rv)
    if bare != rv:
        return bare
    rv = _REFLEXIVE.sub("", rv)
    bare = _ADJECTIVE.sub("", rv)
    if bare != rv:
        return _PARTICIPLE.sub("", bare)
    bare = _VERB.sub("", rv)
    return bare if bare != rv else _NOUN.sub("", rv)


@lru_cache(maxsize=1 << 17)
def stem_word(word: str) -> str:
    """The stem of a lower-case word, ``ё`` as ``е``."""
    word = word.replace("ё", "е")
    first = _HEAD.match(word)
    if not first:
        return word
    head, rv = first[0], _inflected(word[first.end() :])
    rv = rv.removesuffix("и")
    second = _R2.match(word)
    short = _DERIVATIONAL.sub("", rv)
    if second and len(head) + len(short) >= second.end():
        rv = short
    short = _SUPERLATIVE.sub("", rv)
    if short != rv or rv.endswith("нн"):
        return head + (short[:-1] if short.endswith("нн") else short)
    return head + rv.removesuffix("ь")


@F.pandas_udf(ArrayType(StringType()))
def _stems(words: pd.Series) -> pd.Series:
    return words.map(lambda found: None if found is None else [stem_word(w) for w in found])


@F.pandas_udf(StringType())
def _stem(words: pd.Series) -> pd.Series:
    return words.map(stem_word, na_action="ignore")


def stems(words: Column) -> Column:
    """The stem of each of an array of lower-case words."""
    return _stems(words)


def stem(word: Column) -> Column:
    return _stem(word)
