"""Looking up what many documents hold in common, without a row per occurrence.

Documents are dealt to blocks of bounded text by a hash.  A block sends every bucket its distinct
keys of that bucket, sorted and packed into one row; a bucket merges what all blocks sent and
answers each block in the order of its keys.  A key that a third of all documents hold is so sent
once a block, never once a document.  Buckets are ranges of the key, so a block's answers, in
bucket order, follow its sorted keys and need no keys of their own.

Blocks and buckets have sizes of their own.  There is at most one row for a block and a bucket, and
never more rows than keys; executors with more memory may take larger ones, which makes fewer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callboard.llm.arrays import pieces, raw

BLOCK_BYTES = 8 << 20
SENT = "block int, bucket int, body binary"


def count(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> tuple[int, int]:
    """(blocks, bytes of text): enough blocks for the text, and one a shuffle partition at least."""
    size = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    return max(-(-size // block_bytes), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), size


def dealt(docs: DataFrame, blocks: int, text: str = "text") -> DataFrame:
    """The rows with ``block``, each block in one partition.

    A row goes by its id, its text and its place in its partition, so that neither one id nor one row
    repeated over and over lands in one block.  All of them are the same when a lost task reads a
    table again; rows that come out of a shuffle should be written first.
    """
    known = ["doc_id"] if "doc_id" in docs.columns else []
    placed = docs.withColumn("__place", F.monotonically_increasing_id())
    key = F.xxhash64(*known, f"`{text}`", "__place")
    return placed.withColumn("block", F.pmod(key, F.lit(blocks)).cast("int")).drop("__place").repartition(blocks, "block")


def texts(table: pa.Table, text: str = "text") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets) of the table's texts, piece by piece, in row order."""
    for part in pieces(table.select([text]).to_batches(), text):
        yield raw(part.column(0))


def bucket_edges(keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Where each bucket's keys begin among sorted keys of ``bits`` bits; one more than buckets."""
    of = ((keys >> np.uint64(bits - 32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.searchsorted(of, np.arange(buckets + 1, dtype=np.uint64))


def planes(values: np.ndarray) -> bytes:
    """Numbers as byte planes, which shuffles compress better than whole numbers; the last byte says
    how many."""
    width = (int(values.max(initial=0)).bit_length() + 7) // 8
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes() + bytes([width])


def from_planes(body: bytes, n: int, at: int = 0) -> tuple[np.ndarray, int]:
    """n numbers, and where what follows them begins; the width stands in the byte at ``at``."""
    out = np.zeros((n, 8), np.uint8)
    width = body[at]
    if n and width:
        out[:, :width] = np.frombuffer(body, np.uint8, width * n, at + 1).reshape(width, n).T
    return out.view("<u8").ravel(), at + 1 + width * n


def pack(keys: np.ndarray, extra: bytes = b"") -> bytes:
    """Sorted keys as the first one and the steps from each to the next, and what belongs to them."""
    first = int(keys[0]) if len(keys) else 0
    steps = planes(np.diff(keys)) if len(keys) else b"\0"
    return len(keys).to_bytes(8, "little") + first.to_bytes(8, "little") + steps[-1:] + steps[:-1] + extra


def unpack(body: bytes) -> tuple[np.ndarray, bytes]:
    n, first = (int.from_bytes(body[a : a + 8], "little") for a in (0, 8))
    steps, at = from_planes(body, max(n - 1, 0), 16)
    keys = np.full(n, first, np.uint64)
    if n:
        keys[1:] += np.cumsum(steps, dtype=np.uint64)
    return keys, body[at:]


def mostly_ones(values: np.ndarray) -> bytes:
    """Small numbers that are mostly 1: a bit for each, and byte planes of the others."""
    one = values == 1
    rest = planes(values[~one])
    return np.packbits(one).tobytes() + rest[-1:] + rest[:-1]


def from_mostly_ones(body: bytes, n: int) -> np.ndarray:
    out = np.unpackbits(np.frombuffer(body, np.uint8, -(-n // 8)), count=n).astype(np.uint64)
    rest = np.flatnonzero(out == 0)
    out[rest] = from_planes(body, len(rest), -(-n // 8))[0]
    return out


def sections(parts: list[bytes]) -> bytes:
    """Several bodies as one."""
    return b"".join(len(p).to_bytes(4, "little") for p in parts) + b"".join(parts)


def section(body: bytes, k: int, of: int) -> bytes:
    """The k-th of so many bodies."""
    sizes = np.frombuffer(body, "<u4", of)
    at = 4 * of + int(sizes[:k].sum())
    return body[at : at + int(sizes[k])]


def rows(block: int, bodies: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table(
        {"block": pa.array([block] * len(bodies), pa.int32()), "bucket": pa.array([b for b, _ in bodies], pa.int32()), "body": pa.array([x for _, x in bodies], pa.binary())}
    )


def answers(table: pa.Table) -> list[bytes]:
    """A block's answers in bucket order."""
    if not table.num_rows:
        return []
    order = np.argsort(table.column("bucket").to_numpy())
    bodies = table.column("body")
    return [bodies[int(k)].as_py() for k in order]
