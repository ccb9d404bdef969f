"""Types of the domain tables and the rules that their rows must keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(14, 2)
#: States of a program's funding; a program without a funding row is a seventh.
NUMERIC_KINDS = ("exact", "minimum", "maximum", "range")
SILENT_KINDS = ("unknown", "not_stated")
MISSING = "missing_record"

PROGRAMS = T.StructType(
    [
        T.StructField("snapshot_id", T.StringType()),
        T.StructField("program_id", T.StringType()),
        T.StructField("source_key", T.StringType()),
        T.StructField("published_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("observed_at", T.TimestampType()),
        T.StructField("deadline_on", T.DateType()),
        T.StructField("value_kind", T.StringType()),
        T.StructField("currency_code", T.StringType()),
        T.StructField("exact_amount", MONEY),
        T.StructField("min_amount", MONEY),
        T.StructField("max_amount", MONEY),
    ]
)
TAXONOMY = T.StructType([T.StructField(c, T.StringType()) for c in ("snapshot_id", "dimension", "program_id", "slug", "name")])
CASES = T.StructType(
    [
        *(T.StructField(c, T.StringType()) for c in ("snapshot_id", "review_case_id", "case_type", "source_key", "status")),
        T.StructField("opened_at", T.TimestampType()),
        T.StructField("has_explicit_conflict", T.BooleanType()),
    ]
)
EXECUTIONS = T.StructType(
    [*(T.StructField(c, T.StringType()) for c in ("snapshot_id", "execution_id", "source_key", "status")), T.StructField("finished_at", T.TimestampType()), T.StructField("dry_run", T.BooleanType())]
)


def funding_violation() -> Column:
    """Why a funding row breaks the tagged union, or null.

    Numeric kinds need a currency of three capitals and just their own positive amounts; unknown
    and not stated need all of them null; no row at all (a null kind) holds nothing either.
    """
    exact, low, high, code = (F.col(c) for c in ("exact_amount", "min_amount", "max_amount", "currency_code"))
    has = {"exact": (True, False, False), "minimum": (False, True, False), "maximum": (False, False, True), "range": (False, True, True)}
    kind = F.col("value_kind")
    out = F.when(kind.isNull() | kind.isin(*SILENT_KINDS), F.when(F.coalesce(exact, low, high).isNotNull() | code.isNotNull(), "amount_or_currency_without_number"))
    out = out.when(~kind.isin(*NUMERIC_KINDS), "unknown_kind").when(code.isNull() | ~code.rlike("^[A-Z]{3}$"), "currency")
    for name, wanted in has.items():
        wrong = F.lit(False)
        for column, present in zip((exact, low, high), wanted, strict=True):
            wrong = wrong | (F.coalesce(column <= 0, F.lit(True)) if present else column.isNotNull())
        out = out.when((kind == name) & wrong, "amounts")
    return out.when((kind == "range") & (low > high), "range_order")


def violations(programs: DataFrame) -> DataFrame:
    """(program_id, rule) of rows that break a rule."""
    return programs.select("program_id", funding_violation().alias("rule")).where("rule is not null")
