"""Secret scan: fixed patterns, and a token-efficiency test for random strings.

A byte-pair vocabulary packs ordinary text into few tokens, but a random string has few merges
and so few characters per token.  Candidates are long runs of key characters with letters; known
digests (hex of a digest's length) and identifiers (UUIDs, dates, numbers, runs of plain words
joined by signs) are excluded, and what falls under ``RATIO`` characters per token is reported,
unless a fixed pattern has the place already.  Words in a run would hide a key beside them, so a
run that does not fall under it is tested again without the words at its ends, and then part by
part between its signs.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from callboard.llm.arrays import pieces

#: The patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")
#: Runs of 24 or more hex digits; a shorter run is dropped, so the scan may skip it.
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
PART = re.compile(r"[A-Za-z0-9]+")
PLAIN = re.compile(r"[0-9]+|[A-Z]?[a-z]*|[A-Z]+")
LEAST = 16
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: Characters per token below which a run counts as random.
RATIO = 2.0
STRETCH = 1 << 12
DIGEST_DIGITS = (32, 40, 48, 56, 64, 96, 128)
#: What ``excluded`` knows by itself, where it is a part of a longer run.
KNOWN = re.compile("(?<![A-Za-z0-9])(?:" + UUID.pattern + "".join(f"|[0-9a-f]{{{n}}}|[0-9A-F]{{{n}}}" for n in DIGEST_DIGITS) + ")(?![A-Za-z0-9])")

_encodings: dict[str, object] = {}


def vocabulary_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def _encoding(ranks: bytes, pattern: str):
    key = hashlib.sha256(ranks).hexdigest() + pattern
    if key not in _encodings:
        import tiktoken

        merges = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _encodings[key] = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
    return _encodings[key]


def excluded(run: str) -> bool:
    """Known digests and identifiers, which are not secrets however random they look."""
    if UUID.fullmatch(run) or (len(run) in DIGEST_DIGITS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", run)):
        return True
    if not any(c.isalpha() for c in run):
        return True
    # Words, numbers or dates joined by signs: each part is of one kind.
    parts = re.split(r"[+/_=-]+", run)
    return len(parts) > 1 and all(PLAIN.fullmatch(p) for p in parts)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the fixed patterns, in code points."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(found)


def random_spans(text: str, taken: list[tuple[int, int, int]], encode, ratio: float = RATIO) -> list[tuple[int, int, int]]:
    # Base spans by their starts, each with the furthest end so far: whether a run meets one is a search.
    starts = [start for start, _, _ in taken]
    reach = list(accumulate((end for *_, end in taken), max))

    def found(a: int, b: int) -> bool:
        before = bisect_left(starts, b)
        if b - a < LEAST or (before and reach[before - 1] > a) or excluded(text[a:b]):
            return False
        # Long runs are packed in stretches, since packing takes more than linear time.
        return b - a < ratio * sum(len(encode(text[k : min(k + STRETCH, b)])) for k in range(a, b, STRETCH))

    def runs() -> Iterator[tuple[int, int]]:
        """Candidates, cut at the digests and UUIDs in them."""
        for m in CANDIDATE.finditer(text):
            a = m.start()
            for known in KNOWN.finditer(text, *m.span()):
                yield a, known.start()
                a = known.end()
            yield a, m.end()

    out = []
    for a, b in runs():
        if found(a, b):
            out.append((a, 3, b))
            continue
        parts = [p.span() for p in PART.finditer(text, a, b)]
        rough = [k for k, (c, d) in enumerate(parts) if not PLAIN.fullmatch(text, c, d)]
        if rough and found(c := parts[rough[0]][0], d := parts[rough[-1]][1]):
            out.append((c, 3, d))
        elif len(parts) > 1 or parts and parts[0] != (a, b):
            out += [(c, 3, d) for c, d in parts if found(c, d)]
    return out


def scan(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), text: str = "text", vocabulary: str | None = None, ratio: float = RATIO) -> DataFrame:
    """The carried columns and ``found``, an array of (kind, start, end) sorted by start and kind.

    Offsets are code points, ends exclusive.  Null and empty texts have no spans; an empty table
    gives no rows.  Every row is scanned by its own text, whole however long, so repeated rows and
    ids agree; spans that start together are listed by kind.  A column of ``docs`` named ``found``
    gives way, others are ignored.  One pass, no shuffle; the vocabulary file (under a megabyte) is
    read where the job starts and broadcast.
    """
    carry = tuple(c for c in carry if c != "found")
    import public_tokenizers

    with open(vocabulary or vocabulary_path(), "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), public_tokenizers.PATTERN))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(*shared.value).encode_ordinary
        for part in pieces(batches, text):
            rows = []
            for value in part.column(part.schema.get_field_index(text)).to_pylist():
                base = base_spans(value or "")
                spans = sorted(base + random_spans(value or "", base, encode, ratio))
                rows.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans])
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in carry), pa.array(rows, kind)], [*carry, "found"])

    schema = ", ".join(f"`{c}` {dict(docs.dtypes)[c]}" for c in carry) + ", found array<struct<kind:string,start:int,end:int>>"
    return docs.select(*(f"`{c}`" for c in dict.fromkeys([*carry, text]))).mapInArrow(of, schema)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``scan``."""
    from pyspark.sql import functions as F

    def count(kind: str):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = listed(F.filter("found", lambda s: s["kind"] != "random"))
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), count("random").alias("n_random")
    )
