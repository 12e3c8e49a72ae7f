"""Dataset types of an export as column selections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Dataset type -> the amount it reports.
DATASETS = {
    "ActualCost": "BilledCost",
    "AmortizedCost": "EffectiveCost",
    "Usage": "ConsumedQuantity",
}
_PRICED = ("Cost", "CostInUsd", "Price")


def as_dataset(df: DataFrame, dataset: str) -> DataFrame:
    """View rows as one dataset type; the amount is the column ``Amount`` (O-10).

    ActualCost shows charges as invoiced, AmortizedCost spreads commitments, and
    Usage shows consumption with every cost and price column removed.
    """
    if dataset not in DATASETS:
        raise ValueError(f"dataset must be one of {sorted(DATASETS)}, not {dataset!r}")
    rows = df.withColumn("Amount", F.col(DATASETS[dataset]))
    if dataset == "Usage":
        rows = rows.drop(*[c for c in df.columns if c.endswith(_PRICED)])
    return rows
