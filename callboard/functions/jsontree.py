"""Any JSON in one form, and as rows of its leaves."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _loaded(text: str | None) -> tuple[object, str | None]:
    """(value, problem): JSON that has no form is no value."""

    def constant(name: str):
        raise ValueError(name)

    try:
        return (None, "missing") if text is None else (json.loads(text, parse_constant=constant), None)
    except RecursionError:
        return None, "too_deep"
    except ValueError:
        return None, "invalid_json"


@F.pandas_udf(StringType())
def canonical(text: pd.Series) -> pd.Series:
    """The JSON with the keys of every object in order, at every depth, without blanks, letters as they are; null
    for what is no JSON, and for trees too deep to be read (about a thousand levels)."""

    def of(t: str | None) -> str | None:
        value, problem = _loaded(t)
        return None if problem else json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))

    return text.map(of)


def fingerprint(text: Column) -> Column:
    """SHA-256 of the canonical form: equal for equal trees, whatever the order of their keys."""
    return F.sha2(canonical(text), 256)


def walk(value: object) -> Iterator[tuple[str, str | None]]:
    """(path, value) of every leaf, in order: names and places of arrays joined by dots; strings as they are, other
    leaves as JSON, null as null; an empty object or array is a leaf."""
    stack: list[tuple[str, object]] = [("", value)]
    while stack:
        path, v = stack.pop()
        inner = list(v.items()) if isinstance(v, dict) else list(enumerate(v)) if isinstance(v, list) else []
        if inner:
            stack += [(f"{path}.{k}" if path else str(k), x) for k, x in reversed(inner)]
        else:
            yield path, v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def leaves(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, value, problem): every leaf of each row's JSON in one pass, however deep; a row that cannot be read has
    one row that says why."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, t in enumerate(batch.column(1).to_pylist()):
                value, problem = _loaded(t)
                rows += [(k, None, None, problem)] if problem else [(k, path, v, None) for path, v in walk(value)]
            columns = [pa.array([r[c] for r in rows], pa.string()) for c in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), *columns], [key, "path", "value", "problem"])

    return documents.select(key, F.col(text).cast("string").alias("text")).mapInArrow(of, f"`{key}` {dict(documents.dtypes)[key]}, path string, value string, problem string")
