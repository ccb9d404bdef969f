"""Runs a registered query and its SQL side by side, as the driver does."""

import math
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)) or x is pd.NaT or x is pd.NA:
        return "∅"
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return str(bool(x))
    if isinstance(x, (list, tuple)) or type(x).__name__ == "ndarray":
        return "[" + ",".join(map(_cell, x)) + "]"
    try:
        f = float(x)
        return f"{f:.9g}" if f != int(f) else str(int(f))
    except (TypeError, ValueError, OverflowError):
        return str(x)


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return list(pdf.columns), sorted(tuple(_cell(x) for x in r) for r in pdf.itertuples(index=False))


def same(spark, name, query, sql, sf):
    got, expected = rows(query(spark, sf).toPandas()), rows(connect(sf).sql(sql).df())
    assert got[0] == expected[0], (name, got[0], expected[0])
    assert len(got[1]) == len(expected[1]), (name, len(got[1]), len(expected[1]))
    odd = [(a, b) for a, b in zip(got[1], expected[1], strict=True) if a != b]
    assert not odd, (name, len(odd), odd[:3])
    return len(got[1])
