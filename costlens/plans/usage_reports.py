"""Reports over the provider-specific vocabulary, on canonical columns.

Input is the output of ``normalize``; result columns keep the names the reports
have always had.  Costs are US dollars.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costlens.functions.columns import (
    AsOf,
    as_column,
    dated,
    day,
    day_between,
    days_before,
    instant,
    trailing_days,
)
from costlens.operators.absent import rows_absent
from costlens.operators.rollup import cost_rollup

COST = "x_BilledCostInUsd"
GROUP = "x_ResourceGroupName"
FAMILY = "x_SkuServiceFamily"
USED_ON = "ChargePeriodStart"


def _year_month() -> dict[str, Column]:
    return {"Year": F.year(USED_ON).cast("int"), "Month": F.month(USED_ON).cast("int")}


def billing_summary(
    df: DataFrame,
    start: str | date | None = None,
    end: str | date | None = None,
    as_of: AsOf = None,
    **options,
) -> DataFrame:
    """Cost per resource group and service family in a date range (Q-01).

    The range includes both ends and defaults to the last 30 days.
    """
    first = F.lit(str(start)).cast("date") if start else day(days_before(as_of, 30))
    last = F.lit(str(end)).cast("date") if end else day(instant(as_of))
    return cost_rollup(
        df.filter(dated() & day_between(USED_ON, first, last)),
        keys={"resourceGroupName": GROUP, "serviceFamily": FAMILY},
        sums={"TotalCostUSD": COST},
        distincts={"DaysActive": day(USED_ON)},
        rows="TransactionCount",
        order_by=["TotalCostUSD"],
        **options,
    )


def daily_costs(df: DataFrame, as_of: AsOf = None, days_back: int = 30, **options) -> DataFrame:
    """Cost, resources and transactions per day (Q-02)."""
    return cost_rollup(
        df.filter(dated() & trailing_days(USED_ON, as_of, days_back)),
        keys={"BillingDate": day(USED_ON)},
        sums={"DailyCostUSD": COST},
        distincts={"ResourceCount": "ResourceId"},
        rows="TransactionCount",
        order_by=["BillingDate"],
        **options,
    )


def top_resources(df: DataFrame, limit: int = 20, **options) -> DataFrame:
    """The most expensive resources (Q-03)."""
    return cost_rollup(
        df.filter(F.col("ResourceId").isNotNull() & (F.col("ResourceId") != "")),
        keys={"ResourceId": "ResourceId", "resourceGroupName": GROUP, "serviceFamily": FAMILY},
        sums={"TotalCostUSD": COST},
        rows="UsageCount",
        order_by=["TotalCostUSD"],
        limit=limit,
        **options,
    )


def cost_by_location(df: DataFrame, **options) -> DataFrame:
    """Cost, resource groups and service families per location (Q-04)."""
    return cost_rollup(
        df.filter(F.col("RegionName").isNotNull()),
        keys={"resourceLocation": "RegionName"},
        sums={"TotalCostUSD": COST},
        distincts={"ResourceGroups": GROUP, "Services": FAMILY},
        order_by=["TotalCostUSD"],
        **options,
    )


def monthly_trend(df: DataFrame, **options) -> DataFrame:
    """Cost and active days per month; unreadable dates form a NULL month (Q-05)."""
    return cost_rollup(
        df.filter(dated()),
        keys=_year_month(),
        sums={"MonthlyCostUSD": COST},
        distincts={"DaysWithData": day(USED_ON)},
        order_by=["Year", "Month"],
        **options,
    )


def daily_cost_history(df: DataFrame, **options) -> DataFrame:
    """Cost and resources per day over all data, nothing filtered (Q-06)."""
    return cost_rollup(
        df,
        keys={"BillingDate": day(USED_ON)},
        sums={"DailyCostUSD": COST},
        distincts={"ResourceCount": "ResourceId"},
        order_by=["BillingDate"],
        **options,
    )


def top10_resources(df: DataFrame, **options) -> DataFrame:
    """The ten most expensive resources; a missing id counts as one (Q-07)."""
    return cost_rollup(
        df,
        keys={"resourceId": "ResourceId", "resourceGroup": GROUP},
        sums={"TotalCost": COST},
        order_by=["TotalCost"],
        limit=10,
        **options,
    )


def unused_resources(
    df: DataFrame,
    as_of: AsOf = None,
    days: int = 7,
    null_aware: bool = False,
    fold_case: bool = False,
    prefilter: bool = False,
) -> DataFrame:
    """Resources without any positive cost in the last days (Q-08).

    One grouping, marked with whether the resource was used, feeds both sides of the
    anti join, so the rows are read and combined once.  With ``fold_case`` ids and
    groups that differ only in case are the same and show their smallest spelling.
    ``prefilter`` shuffles only resources that may be in use to the anti join.
    """
    used = trailing_days(USED_ON, as_of, days) & (as_column(COST) > 0)
    fold = F.lower if fold_case else F.col
    marked = df.groupBy(fold("ResourceId").alias("id"), fold(GROUP).alias("group")).agg(
        F.min("ResourceId").alias("resourceId"),
        F.min(GROUP).alias("resourceGroup"),
        F.max(F.coalesce(used, F.lit(False))).alias("used"),
    )
    listed = marked.filter("used").select("id")
    absent = rows_absent(marked.select("id", "resourceId", "resourceGroup"), "id", listed, null_aware, prefilter)
    return absent.select("resourceId", "resourceGroup")


def department_chargeback(df: DataFrame, **options) -> DataFrame:
    """Monthly cost per resource group (Q-09)."""
    return cost_rollup(
        df.filter(F.col(GROUP).isNotNull()),
        keys={"Department": GROUP, **_year_month()},
        sums={"MonthlyCharge": COST},
        order_by=["Year", "Month", "MonthlyCharge"],
        **options,
    )
