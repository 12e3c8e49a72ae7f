"""Column expressions for billing rows.

Everything here is a built-in Spark expression, so it stays inside whole-stage
code generation.  Bounds are written as ``column <op> foldable literal`` so that
Catalyst can push them into a Parquet scan or prune partitions with them.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,6)"
TOTAL = "decimal(38,6)"

# The texts a repeated header row leaves in the date column.
HEADER_DATE_TEXTS = ("date", "chargeperiodstart")
# What an untagged resource holds besides NULL.
EMPTY_TAGS = ("{}", "")

AsOf = str | date | datetime | Column | None


def as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def instant(as_of: AsOf = None) -> Column:
    """The reporting moment as a foldable timestamp; wall clock when not given."""
    if as_of is None:
        return F.current_timestamp()
    if isinstance(as_of, Column):
        return as_of
    return F.lit(str(as_of)).cast("timestamp")


def days_before(as_of: AsOf, days: int) -> Column:
    """``as_of`` minus whole days; the time of day is kept."""
    return instant(as_of) - F.make_dt_interval(F.lit(days))


def money(c: str | Column) -> Column:
    """Text or number to DECIMAL(18,6); unreadable values become NULL (A-02)."""
    return as_column(c).try_cast(MONEY)


def day(c: str | Column) -> Column:
    return as_column(c).cast("date")


def total(c: str | Column) -> Column:
    """SUM with one result type for every measure (A-01)."""
    return F.sum(as_column(c)).cast(TOTAL)


def percent(part: Column, whole: Column) -> Column:
    """``part / whole * 100`` as DOUBLE; 0 when ``whole`` is not positive (F-11, A-11)."""
    ratio = part.cast("double") / whole.cast("double") * F.lit(100.0)
    return F.when(whole > 0, ratio).otherwise(F.lit(0.0))


def trailing(c: str | Column, as_of: AsOf, days: int) -> Column:
    """Timestamp within the last ``days`` days, without an upper bound (F-02)."""
    return as_column(c) >= days_before(as_of, days)


def trailing_days(c: str | Column, as_of: AsOf, days: int) -> Column:
    """The *day* of ``c`` is not before ``as_of - days`` (F-02 on a DATE).

    A day counts from its midnight, so the bound is the first midnight at or
    after the cutoff, which leaves the column bare for pushdown.
    """
    cutoff = days_before(as_of, days)
    midnight = F.date_trunc("DAY", cutoff)
    first = F.when(midnight < cutoff, midnight + F.expr("INTERVAL 1 DAY")).otherwise(midnight)
    return as_column(c) >= first


def day_between(c: str | Column, start: Column, end: Column) -> Column:
    """Day of ``c`` within ``[start, end]``, both included (F-03)."""
    c = as_column(c)
    return (c >= start.cast("timestamp")) & (c < F.date_add(end, 1).cast("timestamp"))


def month_start(as_of: AsOf, back: int = 0) -> Column:
    first = F.date_trunc("MM", instant(as_of)).cast("date")
    return F.add_months(first, -back).cast("timestamp")


def in_month(c: str | Column, as_of: AsOf, back: int = 0) -> Column:
    """``c`` falls in the calendar month ``back`` months before ``as_of`` (F-09)."""
    c = as_column(c)
    return (c >= month_start(as_of, back)) & (c < month_start(as_of, back - 1))


def dated(c: str | Column = "date_raw") -> Column:
    """The date text is present and is not a repeated header (F-04)."""
    c = as_column(c)
    return c.isNotNull() & ~F.lower(c).isin(*HEADER_DATE_TEXTS)


def untagged(c: str | Column = "Tags") -> Column:
    """No tags at all (F-08)."""
    c = as_column(c)
    return c.isNull() | c.isin(*EMPTY_TAGS)
