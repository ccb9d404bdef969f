"""Vector codes: product quantisation with codebooks fitted by ball k-means over all rows.

A codebook entry is the centre of a ball: the parts assigned to it, whose largest distance is its radius.
An entry can only take parts from a ball if it lies within twice the ball's radius of the
centre: these are the ball's neighbours.  A ball without neighbours, or one where neither the centre nor
a neighbour has moved, keeps its parts unseen.  In the other balls a part is measured against its own
centre; neighbours, sorted by distance, cut the ball into a stable core, which no neighbour reaches, and
rings, each measured against the neighbours that reach it.  All of it is exact in 64-bit integers.

A round is one pass over the rows: codes and parts are kept by Spark, a few sums per entry come back.
Codebooks have a fixed size, and each round depends on the one before it alone, row by row, so a lost
partition is worked out again from the table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096


def largest_component(dims: int) -> int:
    """Integers up to this have squared distances over ``dims`` components that fit 64 bits."""
    return math.isqrt(((1 << 61) - 1) // max(dims, 1))


@dataclass
class Codebooks:
    """Entries by part, ``centres[part, entry, component]``, and what is known of their balls.

    squared: the balls' squared radii, None if nothing is assigned yet; moved: entries that are not where
    they were when the codes were given.
    """

    centres: np.ndarray
    squared: np.ndarray | None = None
    moved: np.ndarray | None = None

    def neighbours(self) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        """Per part and entry: its neighbours, the nearest first, and their squared distances."""
        out = []
        for p, centres in enumerate(self.centres):
            apart = ((centres[:, None, :] - centres[None, :, :]) ** 2).sum(2)
            balls = []
            for j in range(len(centres)):
                order = np.argsort(apart[j], kind="stable")
                order = order[(order != j) & (apart[j][order] <= 4 * self.squared[p][j])]
                balls.append((order, apart[j][order]))
            out.append(balls)
        return out

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.centres.ravel().tolist())).encode()).hexdigest()

    def next(self, sums: np.ndarray, counts: np.ndarray, squared: np.ndarray) -> Codebooks:
        """Entries moved to the middle of their parts; a ball's radius grows by its centre's step."""
        used = counts > 0
        centres = np.where(used[:, :, None], sums // np.maximum(counts, 1)[:, :, None], self.centres)
        step = ((centres - self.centres) ** 2).sum(2)
        radius = np.array([[int(r) if not s else (math.isqrt(int(r)) + math.isqrt(int(s)) + 2) ** 2 for r, s in zip(a, b, strict=True)] for a, b in zip(squared, step, strict=True)], np.int64).reshape(step.shape)
        # Beyond a quarter of the largest number every entry is a neighbour anyway.
        return Codebooks(centres, np.minimum(radius, 1 << 60), step > 0)


def nearest(part: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Of every part the nearest entry, of equal ones the first."""
    out, best = np.zeros(len(part), np.uint8), np.full(len(part), np.iinfo(np.int64).max)
    for j, c in enumerate(centres):
        d = ((part - c) ** 2).sum(1)
        less = d < best
        out[less], best[less] = j, d[less]
    return out


def reassigned(part: np.ndarray, code: np.ndarray, centres: np.ndarray, balls: list[tuple[np.ndarray, np.ndarray]], moved: np.ndarray) -> np.ndarray:
    """The nearest entry of every part, given the ball it was in."""
    out = code.copy()
    order = np.argsort(code, kind="stable")
    edges = np.searchsorted(code[order], np.arange(len(centres) + 1))
    for j, (near, apart) in enumerate(balls):
        if edges[j] == edges[j + 1] or not len(near) or not (moved[j] or moved[near].any()):
            continue
        rows = order[edges[j] : edges[j + 1]]
        own = ((part[rows] - centres[j]) ** 2).sum(1)
        # How many neighbours reach a part: those within twice its distance to the centre.
        reach = np.searchsorted(apart, 4 * own, side="right")
        ring = np.flatnonzero(reach > 0)
        if not len(ring):
            continue
        ring = ring[np.argsort(-reach[ring], kind="stable")]
        held, reach = rows[ring], reach[ring]
        best, who = own[ring].copy(), np.full(len(ring), j)
        inside = np.searchsorted(-reach, -np.arange(1, int(reach[0]) + 1), side="right")
        for k, n in enumerate(inside.tolist()):
            d = ((part[held[:n]] - centres[near[k]]) ** 2).sum(1)
            less = (d < best[:n]) | ((d == best[:n]) & (near[k] < who[:n]))
            best[:n][less], who[:n][less] = d[less], near[k]
        out[held] = who
    return out


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """Equal binary cells as rows of a matrix."""
    if not len(column):
        return np.zeros((0, width), kind)
    size = width * np.dtype(kind).itemsize
    return np.frombuffer(column.buffers()[2], kind, len(column) * width, int.from_bytes(column.buffers()[1][4 * column.offset : 4 * column.offset + 4], "little")).reshape(-1, width) if size else np.zeros((len(column), 0), kind)


def _parts(column: pa.Array, dims: int, parts: int) -> np.ndarray:
    """Vectors in parts; they are kept as 32-bit integers, and every sum is one of 64."""
    return _matrix(column, "<i4", dims).astype(np.int64).reshape(len(column), parts, dims // parts)


def _cells(rows: np.ndarray) -> pa.Array:
    """A matrix's rows as binary cells."""
    body = np.ascontiguousarray(rows)
    width = body.shape[1] * body.itemsize
    return pa.Array.from_buffers(pa.binary(), len(body), [None, pa.py_buffer((np.arange(len(body) + 1, dtype=np.int64) * width).astype(np.int32).tobytes()), pa.py_buffer(body.tobytes())])


def integers(vectors: DataFrame, dims: int | None, vector: str = "embedding", scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """The kept rows with ``body``, their components floor(scale * x) as an array of long."""
    x = F.transform(f"`{vector}`", lambda v: v.cast("double") * F.lit(float(scale)))
    most = F.lit(float(largest_component(dims or parts)))
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < most), F.lit(False)))
    shaped = (F.size(x) == dims) if dims else (F.size(x) > 0) & (F.size(x) % parts == 0)
    return vectors.where(F.col(f"`{vector}`").isNotNull() & shaped & finite).withColumn("body", F.transform(x, lambda v: F.floor(v).cast("long")))


def start(vectors: DataFrame, vec_id: str, vector: str, parts: int, entries: int, scale: int) -> tuple[Codebooks, int]:
    """The codebooks that the rows of the least ids begin with, and the vectors' length."""
    order = (F.col(f"`{vec_id}`").asc_nulls_last(), "body")
    first = integers(vectors, None, vector, scale, parts).orderBy(*order).select(F.size("body").alias("n")).first()
    dims = first["n"] if first else 0
    found = integers(vectors, dims, vector, scale, parts).orderBy(*order).select("body").limit(entries).collect() if dims else []
    rows = np.array([r["body"] for r in found], np.int64).reshape(len(found), parts, -1 if found else 0)
    return Codebooks(np.ascontiguousarray(rows.transpose(1, 0, 2))), dims


def _assigned(df: DataFrame, books: Codebooks, dims: int, schema: str) -> DataFrame:
    """The rows with new codes; one map, row by row."""
    parts = books.centres.shape[0]
    balls = books.neighbours() if books.squared is not None else None

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("code")
            x = _parts(batch.column(at - 1), dims, parts)
            if balls is None:
                codes = np.stack([nearest(x[:, p], books.centres[p]) for p in range(parts)], 1)
            else:
                old = _matrix(batch.column(at), "u1", parts)
                codes = np.stack([reassigned(x[:, p], old[:, p], books.centres[p], balls[p], books.moved[p]) for p in range(parts)], 1)
            yield pa.RecordBatch.from_arrays([_cells(codes.astype(np.uint8)) if k == at else c for k, c in enumerate(batch.columns)], batch.schema.names)

    return df.mapInArrow(of, schema)


def _summed(df: DataFrame, books: Codebooks, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums, counts, squared radii) of all balls: a row for each entry comes to the driver."""
    parts, entries, width = books.centres.shape

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, squared = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = _parts(batch.column(0), dims, parts)
            code = _matrix(batch.column(1), "u1", parts)
            for p in range(parts):
                order = np.argsort(code[:, p], kind="stable")
                which, at = np.unique(code[order, p], return_index=True)
                if not len(which):
                    continue
                rows = x[order, p]
                away = ((rows - books.centres[p][code[order, p]]) ** 2).sum(1)
                sums[p, which] += np.add.reduceat(rows, at, axis=0)
                counts[p, which] += np.diff(np.append(at, len(order)))
                squared[p, which] = np.maximum(squared[p, which], np.maximum.reduceat(away, at))
        flat = sums.reshape(-1, width)
        yield pa.RecordBatch.from_pydict({"ball": pa.array(np.arange(len(flat)), pa.int32()), "n": pa.array(counts.ravel()), "squared": pa.array(squared.ravel()), "sums": pa.array(flat.tolist(), pa.list_(pa.int64()))})

    wide = df.select("body", "code").mapInArrow(of, "ball int, n long, squared long, sums array<long>")
    # Sums of all rows may pass 64 bits, a task's do not.
    total = wide.groupBy("ball").agg(F.sum("n").alias("n"), F.max("squared").alias("squared"), *(F.sum(F.col("sums")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(width)))
    sums, counts, squared = np.zeros((parts * entries, width), object), np.zeros(parts * entries, np.int64), np.zeros(parts * entries, np.int64)
    for r in total.collect():
        counts[r["ball"]], squared[r["ball"]] = r["n"], r["squared"]
        sums[r["ball"]] = [int(r[f"s{k}"]) for k in range(width)]
    middle = sums // np.maximum(counts, 1)[:, None]  # a mean fits 64 bits where its sum may not
    return (middle * np.maximum(counts, 1)[:, None]).reshape(parts, entries, width), counts.reshape(parts, entries), squared.reshape(parts, entries)


def compressed(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, code, error) of every kept row, and the codebooks; ``code`` is a byte for each part.

    Kept are rows whose vector has no null and no non-finite component, and has the length of the vector with
    the least id (a multiple of ``parts``); vectors with components too large for 64-bit distances
    (``largest_component``, over a hundred million) go too.  Codebooks begin with the vectors of the least ids, null last and
    of equal ids by their components, and have fewer entries if there are fewer rows.  Equal distances go to
    the lower entry; entries that nothing is assigned to stay.  Repeated rows count each; an empty
    table gives no rows and empty codebooks.  Other columns are ignored.
    """
    books, dims = start(vectors, vec_id, vector, parts, entries, scale)
    names = {vec_id: "id", label: "label"}
    kinds = dict(vectors.dtypes)
    kept = integers(vectors.select(*(F.col(f"`{a}`") for a in dict.fromkeys([vec_id, label, vector]))), dims or parts, vector, scale, parts)
    bare = kept.select(F.col(f"`{vec_id}`").alias("id"), F.col(f"`{label}`").alias("label"), "body", F.lit(b"").alias("code"))
    schema = f"id {kinds[vec_id]}, label {kinds[label]}, body binary, code binary"

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype("<i4").reshape(batch.num_rows, dims)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _cells(x), batch.column(3)], ["id", "label", "body", "code"])

    df = bare.mapInArrow(packed, schema)
    if not books.centres.shape[1]:
        return df.select("id", "label", "code", F.lit(0).cast("long").alias("error")).where(F.lit(False)).toDF(*names, "code", "error"), books
    for _ in range(rounds):
        old, df = df, _assigned(df, books, dims, schema).persist(StorageLevel.MEMORY_AND_DISK)
        books = books.next(*_summed(df, books, dims))
        if old.is_cached:
            old.unpersist()
    last = _assigned(df, books, dims, schema)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = np.arange(parts)
        for batch in batches:
            x, code = _parts(batch.column(2), dims, parts), _matrix(batch.column(3), "u1", parts)
            away = ((x - books.centres[centres[None, :], code]) ** 2).sum((1, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(away, pa.int64())], ["id", "label", "code", "error"])

    return last.mapInArrow(measured, f"id {kinds[vec_id]}, label {kinds[label]}, code binary, error long").toDF(*names, "code", "error"), books


def decoded(codes: DataFrame, books: Codebooks, code: str = "code", scale: int = SCALE) -> DataFrame:
    """The rows with ``decoded``, the vector that their code stands for."""
    entries = books.centres.shape[1]
    table = F.lit([[float(x) / scale for x in row] for row in books.centres.reshape(-1, books.centres.shape[2])])
    parts = [F.element_at(table, F.conv(F.hex(F.substring(code, p + 1, 1)), 16, 10).cast("int") + (p * entries + 1)) for p in range(books.centres.shape[0])]
    return codes.withColumn("decoded", F.concat(*parts))


def digest(codes: DataFrame, books: Codebooks) -> DataFrame:
    """The contract's columns; equal labels' errors are added up, null labels' together."""
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "__label")
    met = codes.join(sums, F.col("label").eqNullSafe(F.col("__label")))
    return met.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
