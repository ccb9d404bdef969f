"""Mixing sources to target weights with exact word budgets.

Documents get hash-random keys and are range-sorted by (source, key), so a source of any size
spans as many partitions as it needs.  Each partition sums its words in order; the partitions'
totals per source, a small table, become offsets.  A document then knows how many words of its
source lie before it, and the source is cut where its budget ends, inside a document if need be.
A budget beyond one pass takes every document once for each whole epoch and cuts the next one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from callboard.sources.folders import shared_folder

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2.0
SEED = "mix-1"


def _key(seed: str):
    blank = F.lit("")
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), blank), F.coalesce(F.md5(F.col("text").cast("binary")), blank)))


def _size():
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns that have one: rows that differ in any are told apart, however they come."""
    return F.xxhash64(*(f"`{c}`" for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind))


def keyed(docs: DataFrame, seed: str = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, key, same): the words of each document, its hash-random key and the hash of
    the whole row.  A null text has size 0.  Equal keys mean equal id and text."""
    return docs.select("doc_id", "source", _size().alias("size"), _key(seed).alias("key"), row_hash(docs.drop(*carry)).alias("same"), *carry)


def targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """(source, source_size, target): one row per source, null among them.

    Sources by code point, null last, take the weights in turn.  All targets add up to ``share``
    of all words; a target stops at ``epochs`` times its source, and what it leaves is shared by
    weight among the others, until none is above.  With sources sorted by that limit over their
    weight, the first k are full, and k is the least for which the common level of the rest fits
    under the next source's limit.
    """
    sized = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name, by_limit = W.Window.orderBy(F.col("source").asc_nulls_last()), W.Window.orderBy("ratio", F.col("source").asc_nulls_last())
    whole = W.Window.partitionBy().rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing)
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = sized.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (turn + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(epochs))).withColumn("ratio", F.col("cap") / F.col("weight"))
    level = (F.sum("source_size").over(whole) * F.lit(float(share)) - (F.sum("cap").over(by_limit.rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)) - F.col("cap"))) / F.sum("weight").over(
        by_limit.rowsBetween(W.Window.currentRow, W.Window.unboundedFollowing)
    )
    ranked = ranked.withColumn("level", level)
    fits = ranked.withColumn("common", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(whole)["level"])
    return fits.select("source", "source_size", F.least("cap", F.coalesce(F.col("common") * F.col("weight"), F.col("cap"))).alias("target"))


def prefixed(rows: DataFrame) -> DataFrame:
    """``keyed`` rows, written before, and ``before``: the words of the same source that sort before the row.

    Ranges run over the rows' numbers too, so that one row repeated over and over spans partitions."""
    order = ("source", "key", "same", "nth")
    ordered = rows.withColumn("nth", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, carried = object(), 0
        for batch in batches:
            names, sizes = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            codes = names.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            heads = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else []
            before = np.cumsum(sizes) - sizes
            for a, b in zip(heads, [*heads[1:], len(codes)], strict=True):
                name = names[int(a)].as_py()
                carried = carried if name == source else 0
                source = name
                low = before[a]
                before[a:b] += carried - low
                carried = int(before[b - 1] + sizes[b - 1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before)], [*batch.schema.names, "inside"])

    names = ["source", "size", *(c for c in rows.columns if c not in ("source", "size")), "part"]
    ordered = ordered.select(*names)
    inner = ordered.mapInArrow(summed, ", ".join(f"`{c}` {kind}" for c, kind in ordered.dtypes) + ", inside long").checkpoint()
    runs = inner.groupBy("source", "part").agg(F.sum("size").alias("words"))
    order = W.Window.partitionBy("source").orderBy("part").rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    offsets = runs.select(F.col("source").alias("o_source"), F.col("part").alias("o_part"), (F.sum("words").over(order) - F.col("words")).alias("offset"))
    return inner.join(offsets, (F.col("part") == F.col("o_part")) & F.col("source").eqNullSafe(F.col("o_source"))).select(*rows.columns, (F.col("inside") + F.col("offset")).alias("before"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, seed: str = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (its source's), taken (words the
    mix takes, repeats counted), key, and the carried columns.

    Null ids and sources are values like any other; repeated rows are mixed one by one; an empty
    table gives no rows; other columns are ignored.
    """
    rows = keyed(docs, seed, carry).checkpoint()
    plan = targets(rows, weights, share, epochs)
    # One row per source: the targets are small next to the documents, and Spark may broadcast them.
    cut = prefixed(rows).join(plan.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.floor("target") - whole * F.col("source_size")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return cut.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "key", *carry)


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves, with the columns of ``docs``: a document as often as it is
    taken whole, and once cut after the words that its source's budget still holds.  Texts without
    a word are never taken.

    Among rows of one source, id and text a hash of all columns says which is cut, so the result does
    not depend on the order that rows come in.  The numbered rows stay in the session's shared folder.
    """
    path = f"{shared_folder(docs.sparkSession)}/mixture-{uuid.uuid4().hex}"
    # Rows get numbers that last: the plan meets them by number, whatever columns they share.
    docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("__row", F.monotonically_increasing_id()).write.parquet(path)
    full = docs.sparkSession.read.parquet(path)
    plan = mixed(full, carry=("__row",), **options).where("taken > 0").select("__row", F.col("taken").alias("__taken"))
    both = full.join(plan, "__row")
    both = both.withColumn("__size", _size())
    copies = both.select(
        *(F.col(f"`{c}`") for c in docs.columns),
        F.explode(
            F.concat(
                F.array_repeat(F.lit(-1).cast("long"), F.floor(F.col("__taken") / F.col("__size")).cast("int")),
                F.when(F.col("__taken") % F.col("__size") > 0, F.array(F.col("__taken") % F.col("__size"))).otherwise(F.array().cast("array<bigint>")),
            )
        ).alias("__cut"),
    )
    # Pieces of one word and the blanks after it; blanks before the first word are a piece too.
    parts = F.split("text", r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = F.when(F.col("text").rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    short = F.array_join(F.slice(parts, F.lit(1), F.col("__cut").cast("int") + lead), "")
    text = F.when(F.col("__cut") < 0, F.col("text")).otherwise(short)
    out = copies.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__cut") < 0, F.col("n_chars")).otherwise(F.char_length("text").cast("long")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
