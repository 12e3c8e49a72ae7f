"""Bring any export layout to the canonical, typed columns.

The projections are SQL text: with a hundred columns that is one call into the
JVM instead of several per column.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, TimestampType

from costlens.functions.columns import MONEY, dated
from costlens.sources.schema import (
    ALIASES,
    CANONICAL_SCHEMA,
    DATE_RAW,
    EXPORT_PERIOD,
    EXPORT_SCOPE,
    FOCUS_COLUMNS,
)


PERIOD_START = "BillingPeriodStart"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _moment(c: str, formats: tuple[str, ...]) -> str:
    """Text to timestamp, NULL when it holds no date.

    ISO text is read directly; a bare time of day is not a date.
    """
    iso = (
        f"CASE WHEN try_cast({c} AS date) IS NOT NULL THEN "
        f"coalesce(try_cast({c} AS timestamp), cast(try_cast({c} AS date) AS timestamp)) END"
    )
    others = [f"try_to_timestamp({c}, '{fmt.replace(chr(39), chr(92) + chr(39))}')" for fmt in formats]
    return f"coalesce({', '.join([iso, *others])})" if others else iso


def _typed(c: str, have: DataType, want: DataType, formats: tuple[str, ...]) -> str:
    if have == want:
        return c
    if isinstance(want, DecimalType):
        return f"try_cast({c} AS {MONEY})"
    if isinstance(want, TimestampType):
        return _moment(f"cast({c} AS string)", formats)
    return f"cast({c} AS string)"


def normalize(
    df: DataFrame,
    date_formats: Iterable[str] = (),
    drop_header_rows: bool = False,
    fill: bool = True,
    keep_others: bool = False,
) -> DataFrame:
    """Resolve both vocabularies, type the columns, keep the raw date text (O-11).

    A column may arrive under its canonical name, under an alias, or under both
    when files of two dataset versions were read together; the first readable
    value wins.  Absent columns become typed NULLs, or with ``fill=False`` are left
    out, which spares a table writer dozens of empty columns and makes a report that
    needs one of them fail instead of finding nothing.  An export without billing
    period gets the month of the charge.  ``keep_others`` appends columns that no
    vocabulary declares, as they are.  ``date_formats``
    adds patterns such as ``MM/dd/yyyy`` for exports whose dates are not ISO.  Rows
    are dropped only on request, because some reports count rows whose date cannot
    be read.
    """
    formats = tuple(date_formats)
    present = {f.name.lower(): f for f in df.schema}

    def sources(canonical: str):
        names = (canonical, *ALIASES.get(canonical, ()))
        return [present[n.lower()] for n in names if n.lower() in present]

    out = []
    for field in CANONICAL_SCHEMA:
        found = sources(field.name)
        if field.name == DATE_RAW and not found:
            found = sources("ChargePeriodStart")
        derived = field.name == PERIOD_START and sources("ChargePeriodStart")
        if not found and not derived and not fill:
            continue
        values = [_typed(_quoted(f.name), f.dataType, field.dataType, formats) for f in found]
        if field.name == PERIOD_START and not values:
            charged = [_typed(_quoted(f.name), f.dataType, field.dataType, formats) for f in sources("ChargePeriodStart")]
            values = [f"date_trunc('MM', {c})" for c in charged]
        if not values:
            values = [f"cast(NULL AS {field.dataType.simpleString()})"]
        value = values[0] if len(values) == 1 else f"coalesce({', '.join(values)})"
        out.append(f"{value} AS {_quoted(field.name)}")
    out += [c for c in (EXPORT_SCOPE, EXPORT_PERIOD) if c in present]
    if keep_others:
        names = {n.lower() for c in CANONICAL_SCHEMA.names for n in (c, *ALIASES.get(c, ()))}
        names |= {EXPORT_SCOPE, EXPORT_PERIOD}
        out += [_quoted(f.name) for f in df.schema if f.name.lower() not in names]

    rows = df.selectExpr(*out)
    if drop_header_rows:
        rows = rows.filter(F.col(DATE_RAW).isNull() | dated(DATE_RAW))
    return rows


def declared(df: DataFrame) -> DataFrame:
    """The declared text columns only, in declared order; absent ones are NULL (O-02)."""
    present = {f.name.lower(): f.name for f in df.schema}
    return df.selectExpr(
        *[
            f"cast({_quoted(present[c.lower()]) if c.lower() in present else 'NULL'} AS string) AS {c}"
            for c in FOCUS_COLUMNS
        ]
    )
