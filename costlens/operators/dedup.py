"""Keep the newest run when cumulative snapshots are already rows of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costlens.scratch import scratch_dir
from costlens.sources.schema import EXPORT_SCOPE

PERIOD_COLUMNS = ("BillingPeriodStart",)


def measured(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read again, so the planner knows its size."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def latest_snapshot(
    df: DataFrame,
    run_col: str,
    period_cols: Sequence[str] | None = None,
    few_periods: bool = False,
) -> DataFrame:
    """Rows of the newest run of each billing period of each export (O-06).

    The key is the billing period, and the export too where its column is present:
    two exports number their runs independently.  The newest run per key is a MAX
    that is combined before the shuffle, and it filters the rows with a semi join: no
    window, hence no task that receives a whole period.  It is written first (one job
    over the key columns), so its size is known before any row moves: within Spark's
    broadcast limit it is sent to the rows, which are not shuffled at all; beyond it both
    sides are, and adaptive execution splits a hot period, as this side needs no grouping.

    ``few_periods``  the caller knows that exports times periods fit every executor's
                     memory: nothing is written, and the filter is sent to the rows.
    A NULL key is a key of its own.
    """
    if period_cols is None:
        scope = [EXPORT_SCOPE] if EXPORT_SCOPE in df.columns else []
        period_cols = [*scope, *PERIOD_COLUMNS]
    keys = [F.col(c).alias(f"latest_{c}") for c in period_cols]
    newest = df.groupBy(*keys).agg(F.max(run_col).alias(f"latest_{run_col}"))
    if few_periods:
        newest = F.broadcast(newest)
    else:
        newest = measured(newest, "newest-runs")
    match = F.lit(True)
    for c in (*period_cols, run_col):
        match = match & df[c].eqNullSafe(newest[f"latest_{c}"])
    return df.join(newest, match, "left_semi")
