"""Sources that need no network: a run over a fixture file, and a small data set to try queries on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callboard.sources import packages

NAME, VERSION = "fixture-catalog", "1.0.0"


def dry_run(spark: SparkSession, path: str, source_key: str, prefixes: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(rows, report) of a run that fetches nothing: the package at ``path`` stands for what the source's first
    allowed prefix would give.

    rows: as ``read_json``.  report: one row for the fixture with its resource key and url, the hash of its bytes, how
    many records it has, how many of them are errors or repeat a key, and its status: completed, or failed with a
    reason.  The same file gives the same rows; nothing is written.
    """
    if not prefixes or not prefixes[0].startswith(("http://", "https://")):
        raise ValueError("a fixture source needs an http(s) prefix that it stands for")
    rows, rejected = packages.read_json(spark, path)
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("package"), F.sha2("content", 256).alias("sha256"))
    counts = rows.groupBy("package").agg(F.count(F.lit(1)).alias("records"), F.count_if(~F.col("is_valid")).alias("errors"), F.count_if("is_duplicate").alias("duplicates"))
    told = files.join(counts, "package", "left").join(rejected, "package", "left")
    status = F.when(F.col("reason").isNull(), "completed").otherwise("failed")
    report = told.select(
        F.lit(f"{source_key}:fixture-v1").alias("resource_key"), F.lit(f"{prefixes[0].rstrip('/')}/v1.json").alias("url"), F.lit(f"{NAME} {VERSION}").alias("adapter"), "package", "sha256",
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("records", "errors", "duplicates")), status.alias("status"), "reason",
    )
    return rows, report


def seed(spark: SparkSession, programs: int = 48, sources: int = 6) -> dict[str, DataFrame]:
    """Tables of a small catalogue, the same at every call: sources, programs, themes, geographies.  Every kind of
    funding, a missing deadline, a hidden program and a source without programs are among them."""
    k = F.col("id")
    pick = lambda c, *values: F.element_at(F.array(*map(F.lit, values)), (c % len(values) + 1).cast("int"))
    listed = spark.range(sources).select(F.concat(F.lit("source-"), k).alias("source_key"), pick(k, "fund", "agency", "company").alias("type"), pick(k, "federal", "regional").alias("coverage_level"))
    kind = pick(k, "exact", "minimum", "maximum", "range", "unknown", "not_stated")
    low, high = (k * 10_000 + 5_000).cast("decimal(14,2)"), (k * 20_000 + 50_000).cast("decimal(14,2)")
    rows = spark.range(programs).select(
        k.alias("program_id"), F.concat(F.lit("source-"), k % (sources - 1)).alias("source_key"), F.concat(pick(k, "Grant", "Contest", "Accelerator"), F.lit(" "), k).alias("title"),
        F.when(k % 12 == 11, "hidden").otherwise("published").alias("publication_status"), pick(k, "open", "closed", "upcoming", "unknown").alias("source_status"),
        F.date_add(F.lit("2026-01-01").cast("date"), k.cast("int")).alias("published_at"), F.when(k % 7 != 0, F.date_add(F.lit("2026-03-01").cast("date"), (k * 3).cast("int"))).alias("deadline_on"), kind.alias("value_kind"),
        F.when(kind == "exact", low).alias("exact_amount"), F.when(kind.isin("minimum", "range"), low).alias("min_amount"), F.when(kind.isin("maximum", "range"), high).alias("max_amount"),
    )
    themes = spark.range(programs).select(k.alias("program_id"), F.explode(F.array_distinct(F.array(pick(k, "science", "art", "sport"), pick(k + 1, "science", "health")))).alias("slug"))
    places = spark.range(programs).where(k % 5 != 4).select(k.alias("program_id"), pick(k, "north", "south", "east").alias("slug"))
    return {"sources": listed, "programs": rows, "themes": themes, "geographies": places}
