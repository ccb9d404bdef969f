"""Five-field cron expressions as predicates over a UTC timestamp column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The least and greatest value of minute, hour, day, month, weekday (0 is Sunday).
BOUNDS = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))


def values(field: str, low: int, high: int) -> set[int]:
    """The numbers that a field's lists, ranges and steps name."""
    out: set[int] = set()
    for part in field.split(","):
        span, _, step = part.partition("/")
        if span == "*":
            a, b = low, high
        else:
            first, dash, last = span.partition("-")
            a = int(first)
            b = int(last) if dash else a
        if not low <= a <= b <= high or (step and int(step) < 1):
            raise ValueError(f"{part!r} does not fit {low}-{high}")
        out |= set(range(a, b + 1, int(step or 1)))
    return out


def due(expression: str, at: Column) -> Column:
    """Whether the minute of ``at`` matches; when both day and weekday are limited, either will do.  A
    field that names every value is not limited, however it is written; one with a step is.  A
    step after a single number has nothing to step to.  ``manual`` is never due."""
    if expression == "manual":
        return F.lit(False)
    fields = expression.split()
    if len(fields) != 5:
        raise ValueError("a schedule has five fields")
    minute, hour, day, month, weekday = (values(f, *b) for f, b in zip(fields, BOUNDS, strict=True))
    weekday = {d % 7 for d in weekday}
    free_day, free_week = len(day) == 31, len(weekday) == 7
    by_day, by_week = F.dayofmonth(at).isin(*day), (F.dayofweek(at) - 1).isin(*weekday)
    days = by_day & by_week if free_day or free_week else by_day | by_week
    return F.minute(at).isin(*minute) & F.hour(at).isin(*hour) & F.month(at).isin(*month) & days
