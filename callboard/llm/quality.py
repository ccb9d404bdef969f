"""Line-first cleaning: rules per line, then a rule on what is left of the document.

A line fails when it reads as navigation (several separators between its words), is strewn with
symbols, carries a boilerplate phrase, or neither ends like a sentence nor holds sentence ends.  Failing lines are removed; a document that
loses more than ``LOSS`` of its word characters is rejected.  A few counts over the whole text go
first: documents with few words or with many words in repeated windows are rejected at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from callboard.llm.arrays import LEAD, LOWER, WORD, chained, hashes, mixed, owners, pieces, raw, spans, sums

LEAST_WORDS = 50
#: A document is rejected when 100 times its repeated words are over this many times its words.
REPEATED_PERCENT = 50
#: The share of word characters that a kept document may lose with its failing lines.
LOSS = 0.5
#: A line with at least so many separator words, and one for every so many words, is navigation.
SEPARATORS = 3
SEPARATOR_EVERY = 6
#: A line with at least so many symbols, and this share of its word characters, is strewn.
SYMBOLS = 3
SYMBOL_SHARE = 0.15
#: A line that does not end like a sentence needs a sentence end for every so many words.
SENTENCE_WORDS = 30
#: Phrases of page furniture.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript",
    "javascript is disabled", "lorem ipsum", "click here", "sign up for our newsletter", "subscribe to our", "share on facebook",
    "skip to content", "back to top", "powered by wordpress", "mentions légales", "tous droits réservés", "alle rechte vorbehalten",
    "todos los derechos reservados", "aviso legal",
)
PHRASES = re.compile(b"|".join(re.escape(p.encode()) for p in BOILERPLATE))
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
LINE = np.ones(256, bool)
LINE[0x0A] = False
CLOSING = np.zeros(256, bool)
CLOSING[list(b".!?\"':;)]}")] = True
STOP = np.zeros(256, bool)
STOP[list(b".!?")] = True
#: Sentence ends beyond ASCII: ellipsis, closing quotes, guillemet, CJK stops.
CLOSING_WIDE = tuple(c.encode() for c in "…”’»。！？")
SEPARATOR_WORDS = tuple(c.encode() for c in ("|", "||", ">", ">>", "»", "·", "•", "/", "::", "*", "-", "–"))


def _repeated(words: np.ndarray, doc: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Per text, the words in three-word windows that it has twice or more."""
    n = len(words)
    if n < 3:
        return np.zeros(len(firsts) - 1, np.int64)
    window = chained(words, 3)
    inside = doc[:-2] == doc[2:]
    window, owner, at = window[inside], doc[:-2][inside], np.flatnonzero(inside)
    key = mixed(window + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[at[order[twice]] + k] = True
    return sums(hit, firsts)


def _earlier(lines: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a line equals an earlier one of its text."""
    order = np.lexsort((np.arange(len(lines)), lines, doc))
    out = np.zeros(len(lines), bool)
    out[order[1:]] = (lines[order][1:] == lines[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return out


def measured(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts per text, the lines' spans and which of them fail."""
    starts, ends, firsts = spans(data, offsets, WORD)
    doc = owners(firsts)
    leads = np.concatenate([[0], np.cumsum(LEAD[data])])
    chars = leads[ends] - leads[starts]
    symbols = np.concatenate([[0], np.cumsum(SYMBOL[data])])
    l_starts, l_ends, l_firsts = spans(data, offsets, LINE)
    l_doc = owners(l_firsts)
    low, high = np.searchsorted(starts, l_starts), np.searchsorted(starts, l_ends)
    worded = high > low
    dup = np.zeros(len(l_starts), bool)
    dup[worded] = _earlier(hashes(data, l_starts[worded], l_ends[worded]), l_doc[worded])

    # Separators: words that are one of a few signs.
    sign = np.zeros(len(starts), bool)
    short = np.flatnonzero(ends - starts <= 3)
    for s in SEPARATOR_WORDS:
        fits = short[(ends - starts)[short] == len(s)]
        same = np.ones(len(fits), bool)
        for k, byte in enumerate(s):
            same &= data[starts[fits] + k] == byte
        sign[fits[same]] = True
    signs = np.concatenate([[0], np.cumsum(sign)])
    n_signs = signs[high] - signs[low]
    navigation = (n_signs >= SEPARATORS) & (n_signs * SEPARATOR_EVERY >= high - low)

    boilerplate = np.zeros(len(l_starts), bool)
    if len(l_starts):
        found = np.array([m.span() for m in PHRASES.finditer(LOWER[data].tobytes())], np.int64).reshape(-1, 2)
        line = np.searchsorted(l_starts, found[:, 0], side="right") - 1
        boilerplate[line[found[:, 1] <= l_ends[line]]] = True

    closed = np.zeros(len(l_starts), bool)
    last = ends[np.maximum(high - 1, 0)] - 1 if len(ends) else np.zeros(len(l_starts), np.int64)
    if len(ends):
        closed = CLOSING[data[last]]
        for c in CLOSING_WIDE:
            fits = np.flatnonzero(worded & (last - l_starts + 1 >= len(c)))
            same = np.ones(len(fits), bool)
            for k, byte in enumerate(reversed(c)):
                same &= data[last[fits] - k] == byte
            closed[fits[same]] = True
    if len(ends):
        stops = np.concatenate([[0], np.cumsum(STOP[data[ends - 1]])])
        closed |= (stops[high] - stops[low]) * SENTENCE_WORDS >= np.maximum(high - low, 1)
    c = np.concatenate([[0], np.cumsum(chars)])
    line_chars = c[high] - c[low]
    n_symbols = symbols[l_ends] - symbols[l_starts]
    strewn = (n_symbols >= SYMBOLS) & (n_symbols >= SYMBOL_SHARE * line_chars)
    failed = worded & (navigation | strewn | boilerplate | ~closed)
    return {
        "n_words": np.diff(firsts), "word_chars": sums(chars, firsts), "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": sums(dup, l_firsts), "n_repeat_words": _repeated(hashes(data, starts, ends), doc, firsts), "lost_chars": sums(np.where(failed, line_chars, 0), l_firsts),
        "n_failed_lines": sums(failed, l_firsts), "_line_starts": l_starts, "_line_ends": l_ends, "_failed": failed, "_line_firsts": l_firsts,
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "n_failed_lines")


def judge(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), text: str = "text", loss: float = LOSS, cleaned: bool = False) -> DataFrame:
    """The carried columns, the counts, ``base_failed``, ``kept`` and, on demand, ``cleaned``: the
    text without its failing lines.

    A null text has no words, so it fails the base rule.  Every row is judged by its own text, whole
    however long, so repeated rows and ids agree; of equal lines the first counts as the original;
    an empty table gives no rows.  Columns of ``docs`` with the names of results are not carried.
    One pass over the rows, no shuffle.
    """
    carry = tuple(c for c in carry if c not in (*COUNTS, "base_failed", "kept", "cleaned"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, text):
            data, offsets = raw(part.column(part.schema.get_field_index(text)))
            m = measured(data, offsets)
            failed = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > REPEATED_PERCENT * m["n_words"])
            kept = ~failed & (m["lost_chars"] <= loss * m["word_chars"])
            out = {c: part.column(part.schema.get_field_index(c)) for c in carry} | {c: pa.array(m[c], pa.int64()) for c in COUNTS} | {"base_failed": pa.array(failed), "kept": pa.array(kept)}
            if cleaned:
                drop = np.zeros(len(data) + 1, np.int64)
                np.add.at(drop, m["_line_starts"][m["_failed"]], 1)
                np.add.at(drop, np.minimum(m["_line_ends"][m["_failed"]] + 1, offsets[1:][owners(m["_line_firsts"])[m["_failed"]]]), -1)
                keep = np.cumsum(drop[:-1]) == 0
                out["cleaned"] = pa.array([data[a:b][keep[a:b]].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.string())
            yield pa.RecordBatch.from_pydict(out)

    schema = ", ".join([*(f"`{c}` {dict(docs.dtypes)[c]}" for c in carry), *(f"{c} long" for c in COUNTS), "base_failed boolean, kept boolean", *["cleaned string"] * cleaned])
    return docs.select(*(f"`{c}`" for c in dict.fromkeys([*carry, text]))).mapInArrow(of, schema)
