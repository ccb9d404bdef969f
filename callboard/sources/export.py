"""Research exports: tidy metrics as JSON, CSV and a bar chart, each with the hash of its data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callboard.functions import jsontree

#: The columns of an export as CSV, in order.
CSV_COLUMNS = (
    "metric_key", "value", "unit", "period", "formula", "filter", "missing", "uncertainty", "numerator", "denominator", "sample_size", "limitation", "status",
    "snapshot_ids", "calculation_code_version", "parameters", "exported_at", "input_fingerprints", "data_sha256",
)
REQUIRED = ("snapshot_id", "metric_key", "formula", "unit", "missing_rule", "limitation")


def documented(metrics: DataFrame) -> DataFrame:
    """Metrics whose documentation is complete; others are not exposed."""
    return metrics.where(" and ".join(f"{c} is not null" for c in REQUIRED))


def flattened(documents: DataFrame) -> DataFrame:
    """(snapshot_id, path, value) of every leaf of nested metric documents (JSON text), however deep, in one
    pass; a document that cannot be read is an error."""
    got = jsontree.leaves(documents, "snapshot_id", "metrics").where("problem is null or problem <> 'missing'")
    wrong = F.raise_error(F.concat(F.lit("metrics of snapshot "), F.col("snapshot_id").cast("string"), F.lit(": "), F.col("problem"))).cast("string")
    return got.select("snapshot_id", "path", F.when(F.col("problem").isNotNull(), wrong).otherwise(F.col("value")).alias("value"))


def data_hash(df: DataFrame) -> str:
    """SHA-256 of the rows as JSON, whatever their order."""
    body = df.select(F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("h"))
    lanes = body.agg(*(F.sum(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"l{k}") for k in range(4)), F.count(F.lit(1)).alias("n"))
    return lanes.select(F.sha2(F.concat_ws("|", *lanes.columns), 256)).first()[0]


def write_csv(df: DataFrame, path: str) -> str:
    """Every cell quoted, lines end in CRLF; returns the data's hash."""
    df.write.mode("overwrite").csv(path, header=True, quoteAll=True, lineSep="\r\n", escape='"')
    return data_hash(df)


def metric_rows(metrics: DataFrame, export: dict[str, str]) -> DataFrame:
    """Metrics under the export's columns: those that metrics have, the rest from ``export`` (one value
    for all rows), others null; by metric_key."""
    given = {c: F.col(c).cast("string") if c in metrics.columns else F.lit(export.get(c)).cast("string") for c in CSV_COLUMNS}
    return metrics.select(*(v.alias(c) for c, v in given.items())).orderBy("metric_key")


def write_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return data_hash(df)


def reproducible(snapshots: DataFrame) -> DataFrame:
    """Snapshots that an export must not use, and why: only compatible real ones with a matching
    fingerprint pass."""
    reason = F.when(F.col("data_class") != "real", "not_real").when(~F.col("is_compatible"), "incompatible").when(~F.col("stored_fingerprint").eqNullSafe(F.col("input_fingerprint")), "fingerprint_differs")
    return snapshots.select("snapshot_id", reason.alias("reason")).where("reason is not null")


def svg_bars(rows: list[tuple[str, float]], title: str, data: str, width: int = 640) -> str:
    """A bar chart of at most 50 rows, for a small result already at the driver."""
    from xml.sax.saxutils import escape, quoteattr

    rows = rows[:50]
    most = max((abs(v) for _, v in rows), default=0) or 1
    bars = [
        f'<text x="4" y="{44 + 24 * k}">{escape(name)}</text><rect x="200" y="{32 + 24 * k}" height="16" width="{max(0, value) / most * (width - 280):.1f}"/><text x="{width - 72}" y="{44 + 24 * k}">{value:g}</text>'
        for k, (name, value) in enumerate(rows)
    ]
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{48 + 24 * len(rows)}" data-hash={quoteattr(data)}><title>{escape(title)}</title><text x="4" y="20">{escape(title)}</text>{"".join(bars)}</svg>'
