"""Consistent placement of documents on shards by a permutation-filled lookup table.

Every shard has its own preference order of the slots of a prime-sized table (a start and a
step, both from hashes of its name).  Shards take turns; at its turn a shard claims the next
free slot of its order, until the table is full.  Shards so hold slots within one of each other,
and adding or removing a shard moves few slots.  The table has ``slots`` rows however large the
data is, so it is broadcast, and placing a document is one lookup without a shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime; the broadcast table has as many rows, whatever the input.
SLOTS = 65537
SHARDS = 64


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard's index for every slot; ``slots`` must be prime and no less than the shards."""
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"{slots} slots: not a prime")
    if not 0 < len(shards) <= slots or len(set(shards)) < len(shards):
        raise ValueError("shard names must be distinct, at least one and no more than slots")
    at = [_number(s, "start") % slots for s in shards]
    step = [_number(s, "step") % (slots - 1) + 1 for s in shards]
    table = [-1] * slots
    filled = 0
    while True:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            table[at[k]] = k
            filled += 1
            if filled == slots:
                return table


def placed(df: DataFrame, key: Column, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """All rows and columns, and ``slot`` and ``shard``; existing columns of those names give way.

    Rows with equal keys share a shard.  The key should not be null: all null keys share one slot.
    """
    rows = [(slot, shards[k]) for slot, k in enumerate(lookup_table(shards, slots))]
    table = F.broadcast(df.sparkSession.createDataFrame(rows, "slot int, shard string"))
    return df.drop("slot", "shard").withColumn("slot", F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")).join(table, "slot").select(*(F.col(f"`{c}`") for c in df.columns if c not in ("slot", "shard")), "slot", "shard")


def names(count: int = SHARDS) -> list[str]:
    return [f"shard-{k:05d}" for k in range(count)]


def shard_documents(docs: DataFrame, count: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``placed`` by doc_id.  A document without an id goes by its other small columns, so that
    such rows spread too; repeated ids share a shard; an empty table stays empty."""
    rest = F.concat_ws("\x1f", F.lit("none"), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source", "lang", "n_chars") if c in docs.columns))
    return placed(docs, F.coalesce(F.col("doc_id").cast("string"), rest), names(count), slots)
