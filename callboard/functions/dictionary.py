"""Names of a dictionary in running text, all in one pass however many names there are.

Names and texts are folded to lower-case words with single blanks between them.  The names of a block become
an Aho-Corasick automaton in each Python worker, and a text runs through it once.  A dictionary beyond one block's size
takes a pass for each block, each written before the next begins.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of the names of one automaton, which takes about fifty times as much.
BLOCK_BYTES = 4 << 20


def line(text: Column) -> Column:
    """A text's lower-case words, each between blanks; null without words."""
    words = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(words != "", F.concat(F.lit(" "), words, F.lit(" ")))


def _automaton(shared: Broadcast):
    """The automaton of these names, built once in each worker."""
    import ahocorasick

    if not hasattr(shared, "automaton"):
        shared.automaton = ahocorasick.Automaton()
        for name in shared.value:
            shared.automaton.add_word(name, name)
        shared.automaton.make_automaton()
    return shared.automaton


def longest(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Of (place, words, name) those that are left when the first, of one place the longest, takes its words."""
    out, free = [], 0
    for place, words, name in sorted(found, key=lambda x: (x[0], -x[1])):
        if place >= free:
            out.append((place, words, name))
            free = place + words
    return out


def spans(text: str | None, automaton, only_longest: bool) -> list[tuple[int, int, str]]:
    """(place, words, name) of the names in a ``line``; places count words."""
    if text is None or not len(automaton):
        return []
    blanks = [k for k, c in enumerate(text) if c == " "]
    found = []
    for end, name in automaton.iter(text):
        place = bisect_left(blanks, end - len(name) + 1)
        found.append((place, bisect_left(blanks, end) - place, name))
    return longest(found) if only_longest else found


MENTION = "place int, words int, name string"


def _pass(rows: DataFrame, names: DataFrame, key: str, only_longest: bool) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast([r["line"] for r in names.collect()])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(shared)
        for batch in batches:
            got = [(k, *m) for k, text in enumerate(batch.column(1).to_pylist()) for m in spans(text, automaton, only_longest)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([m[0] for m in got], pa.int64())), pa.array([m[1] for m in got], pa.int32()), pa.array([m[2] for m in got], pa.int32()), pa.array([m[3] for m in got], pa.string())],
                [key, "place", "words", "name"],
            )

    return rows.mapInArrow(of, f"`{key}` {dict(rows.dtypes)[key]}, {MENTION}")


def mentions(texts: DataFrame, names: DataFrame, key: str, text: str, only_longest: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, place, words, tag): where texts hold names, whole words alone, counted in words from 0.

    names: name, tag; a name may have several tags, and one without a word is never found.  Keys stand for rows.
    With ``only_longest`` a name inside a longer one is not found, nor is one that overlaps an earlier one.
    """
    rows = texts.select(key, line(F.col(text)).alias("line"))
    known = names.select(line(F.col("name")).alias("line"), "tag").where("line is not null").distinct().checkpoint()
    distinct = known.select("line").distinct()
    blocks = max(1, -(-(distinct.agg(F.sum(F.octet_length("line"))).first()[0] or 0) // block_bytes))
    if blocks == 1:
        found = _pass(rows, distinct, key, only_longest)
    else:
        found = None
        for k in range(blocks):
            part = _pass(rows, distinct.where(F.pmod(F.xxhash64("line"), F.lit(blocks)) == k), key, False).checkpoint()
            found = part if found is None else found.unionByName(part)
        if only_longest:
            each = found.groupBy(key).agg(F.collect_list(F.struct("place", "words", "name")).alias("all"))
            kept = F.udf(lambda all_: longest([tuple(m) for m in all_]), f"array<struct<{MENTION.replace(' ', ':').replace(',:', ',')}>>")
            found = each.select(key, F.inline(kept("all")))
    return found.join(known, found["name"] == known["line"]).select(key, "place", "words", "tag")


def tags(texts: DataFrame, names: DataFrame, key: str, text: str, **options) -> DataFrame:
    """(key, tag) once for each tag that a text mentions."""
    return mentions(texts, names, key, text, **options).select(key, "tag").distinct()
