"""The one aggregation shape all cost reports share."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costlens.functions.columns import as_column, total

Named = Mapping[str, str | Column]


def ranked(df: DataFrame, by: Sequence[str], ties: Sequence[str] = (), limit: int | None = None):
    """Sort by measures descending, NULLs last, then by ``ties`` so the order is unique.

    With a limit Spark keeps only the best ``limit`` rows of each task (S-01 .. S-04).
    """
    rows = df.orderBy(
        *[F.col(c).desc_nulls_last() for c in by],
        *[F.col(c).asc_nulls_first() for c in ties if c not in by],
    )
    return rows if limit is None else rows.limit(limit)


def cost_rollup(
    df: DataFrame,
    keys: Named,
    sums: Named | None = None,
    distincts: Named | None = None,
    rows: str | None = None,
    order_by: Sequence[str] = (),
    limit: int | None = None,
    by_currency: bool = False,
    fold_case: bool = False,
    approx: bool = False,
) -> DataFrame:
    """GROUP BY ``keys``; SUM, COUNT(DISTINCT) and COUNT(*) as named (A-01 .. A-09).

    Spark combines partial sums before the shuffle and counts distinct values
    in two levels, spread over (key, value), so one key holding most rows is not
    gathered in one task.

    ``by_currency``  also group by billing currency instead of adding currencies up.
    ``fold_case``    text keys and counted ids that differ only in case are the same;
                     a key shows its smallest spelling.
    ``approx``       estimate distinct counts with a sketch.
    """
    keys = dict(keys)
    if by_currency:
        keys.setdefault("BillingCurrency", "BillingCurrency")

    def is_text(c) -> bool:
        return isinstance(c, str) and df.schema[c].dataType.simpleString() == "string"

    group, spelling = [], []
    for name, source in keys.items():
        if fold_case and is_text(source):
            group.append(F.lower(source).alias(f"folded_{name}"))
            spelling.append(F.min(source).alias(name))
        else:
            group.append(as_column(source).alias(name))

    count_distinct = F.approx_count_distinct if approx else F.count_distinct
    sums, distincts = dict(sums or {}), dict(distincts or {})
    counted = {
        name: F.lower(source) if fold_case and is_text(source) else as_column(source)
        for name, source in distincts.items()
    }
    out = [*keys, *sums, *distincts, *([rows] if rows else [])]
    if len(counted) > 1 and not approx:
        # Several distinct counts copy every row once each; so rows are first combined
        # by keys and counted values, and only the result is copied.
        names = [f"group_{i}" for i in range(len(group))]
        first = df.groupBy(
            *[g.alias(n) for g, n in zip(group, names)],
            *[c.alias(f"value_{name}") for name, c in counted.items()],
        ).agg(
            F.count("*").alias("count_rows"),
            *[F.min(source).alias(f"least_{name}") for name, source in keys.items() if is_text(source)],
            *[total(c).alias(f"sum_{name}") for name, c in sums.items()],
        )
        shown = [
            F.min(f"least_{name}").alias(name) if fold_case and is_text(source) else F.col(n).alias(name)
            for (name, source), n in zip(keys.items(), names)
        ]
        grouped = first.groupBy(*names).agg(
            *[c for c, (_, source) in zip(shown, keys.items()) if fold_case and is_text(source)],
            *[total(f"sum_{name}").alias(name) for name in sums],
            *[count_distinct(F.col(f"value_{name}")).alias(name) for name in counted],
            *([F.sum("count_rows").alias(rows)] if rows else []),
        )
        grouped = grouped.select(
            *[
                F.col(name) if fold_case and is_text(source) else F.col(n).alias(name)
                for (name, source), n in zip(keys.items(), names)
            ],
            *out[len(keys) :],
        )
    else:
        measures = [total(c).alias(name) for name, c in sums.items()]
        measures += [count_distinct(c).alias(name) for name, c in counted.items()]
        if rows:
            measures.append(F.count("*").alias(rows))
        grouped = df.groupBy(*group).agg(*spelling, *measures).select(*out)
    return ranked(grouped, order_by, list(keys), limit) if order_by else grouped
