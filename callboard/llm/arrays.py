"""Whole batches of texts as numpy arrays: word spans, rolling hashes and per-document sums.

Every helper works on the UTF-8 bytes of an Arrow string column, so a batch costs a few array
passes instead of a Python loop over words.  Batches are cut into pieces of half a megabyte
first, which bounds the memory of the temporary arrays; a longer single text is a piece alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

PIECE_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_powers = {True: np.ones(1, np.uint64), False: np.ones(1, np.uint64)}

#: Bytes that end a word under ``[^\x20\x09-\x0D]+``.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD = np.ones(256, bool)
WORD[list(SPACES)] = False
#: Bytes of words under ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (digits, a-z, all beyond ASCII).
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: True for bytes that begin a code point.
LEAD = (np.arange(256) & 0xC0) != 0x80


def filled(column: pa.Array) -> pa.Array:
    """The string column with null as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null("") if column.null_count else column


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): text i is bytes[offsets[i]:offsets[i + 1]]; null is empty."""
    column = filled(column)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of the batches with at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        _, offsets = raw(batch.column(at))
        low = 0
        while low < len(offsets) - 1:
            high = int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1
            high = max(high, low + 1)
            yield batch.slice(low, high - low)
            low = high


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes in class ``inside``, cut at texts, and the
    index of each text's first run (one more entry than texts)."""
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    mask = inside[data]
    before = np.empty_like(mask)
    before[0] = False
    before[1:] = mask[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after = np.empty_like(mask)
    after[-1] = False
    after[:-1] = mask[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(mask & ~before)
    ends = np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def owners(firsts: np.ndarray) -> np.ndarray:
    """The text's index for each of its runs, from ``spans``' third result."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))


def sums(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Per-text sums of values that lie in text order."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[firsts[1:]] - total[firsts[:-1]]


def _power(n: int, inverse: bool) -> np.ndarray:
    """base**i, or base**-i, modulo 2**64 for i < n."""
    have = _powers[inverse]
    base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        _powers[inverse] = have
    return have


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


#: Slices over so many bytes are hashed one by one.
LONG = 64
_KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice by its content and length: eight bytes at a time, each step a
    bijection, and XXH3 for long slices.  No pattern of bytes makes different slices meet, as the
    polynomial of ``Rolling`` does for some of a thousand bytes, so equal hashes mean equal slices
    but for chance (n slices: n * n / 2**65)."""
    size = ends - starts
    words = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    out = mixed((size.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE))
    out = mixed(out ^ (words[starts] & _KEPT[np.minimum(size, 8)]))
    rows = np.flatnonzero((size > 8) & (size <= LONG))
    at, left = starts[rows] + 8, size[rows] - 8
    while len(rows):
        out[rows] = mixed(out[rows] ^ (words[at] & _KEPT[np.minimum(left, 8)]))
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    rows = np.flatnonzero(size > LONG)
    view = memoryview(np.ascontiguousarray(data))
    for k, a, b in zip(rows.tolist(), starts[rows].tolist(), ends[rows].tolist(), strict=True):
        out[k] = xxhash.xxh3_64_intdigest(view[a:b])
    return out


class Rolling:
    """Polynomial hashes modulo 2**64 of any slices of the bytes, after one prefix pass.

    Fit for slices of a few hundred bytes; beyond a thousand some patterns collide by construction
    (``hashes`` has no such pattern).
    """

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.prefix = np.zeros(n + 1, np.uint64)
        if n:
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(n, False)[:n], out=self.prefix[1:])
        self.inverse = _power(n + 1, True)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.prefix[ends] - self.prefix[starts]) * self.inverse[starts])

    def windows(self, length: int) -> np.ndarray:
        """The hash of the ``length`` bytes at every position that has them."""
        n = len(self.prefix) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mixed((self.prefix[length:] - self.prefix[:n]) * self.inverse[:n])


def chained(hashes: np.ndarray, length: int) -> np.ndarray:
    """One hash for every ``length`` neighbouring values, order included."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n]
    return mixed(out)


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """All words, each followed by one space, and where each begins."""
    sizes = ends - starts
    places = np.cumsum(sizes + 1) - (sizes + 1)
    out = np.full(int((sizes + 1).sum()), 0x20, np.uint8)
    kept = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
    out[np.arange(len(kept)) + np.repeat(np.arange(len(sizes)), sizes)] = data[kept]
    return out.tobytes(), places
