"""Reports over the open cost specification's vocabulary.

Unless said otherwise a report covers the billing periods that start within the
last 30 days of ``as_of``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costlens.functions.columns import (
    TOTAL,
    AsOf,
    day,
    in_month,
    month_start,
    percent,
    total,
    trailing,
    untagged,
)
from costlens.operators.rollup import cost_rollup, ranked
from costlens.sources.schema import CHARGE_TYPE

PERIOD = "BillingPeriodStart"
WINDOW = 30
CUSTOMER = {"CustomerName": "SubAccountName", "CustomerTenantId": "SubAccountId"}
SERVICE = {"ServiceCategory": "ServiceCategory", "ServiceName": "ServiceName"}
RESOURCES = {"ResourceCount": "ResourceId"}
CUSTOMERS = {"CustomerCount": "SubAccountId"}

# Output name -> canonical column of the summary view, in order.
SUMMARY_COLUMNS = {
    "BillingPeriodStart": "BillingPeriodStart",
    "BillingPeriodEnd": "BillingPeriodEnd",
    "InvoiceIssuerName": "InvoiceIssuerName",
    "ProviderName": "ProviderName",
    "ServiceName": "ServiceName",
    "ServiceCategory": "ServiceCategory",
    "Region": "RegionName",
    "ResourceId": "ResourceId",
    "ResourceName": "ResourceName",
    "ResourceType": "ResourceType",
    "CustomerTenantId": "SubAccountId",
    "CustomerName": "SubAccountName",
    "BilledCost": "BilledCost",
    "BillingCurrency": "BillingCurrency",
    "ContractedCost": "ContractedCost",
    "EffectiveCost": "EffectiveCost",
    "ListCost": "ListCost",
    "UsageQuantity": "ConsumedQuantity",
    "UsageUnit": "ConsumedUnit",
    "ChargeCategory": "ChargeCategory",
    "ChargeFrequency": "ChargeFrequency",
    "ChargeType": CHARGE_TYPE,
    "CommitmentDiscountId": "CommitmentDiscountId",
    "PricingCategory": "PricingCategory",
    "Tags": "Tags",
}


def _recent(df: DataFrame, as_of: AsOf, days: int = WINDOW) -> DataFrame:
    return df.filter(trailing(PERIOD, as_of, days))


def billing_summary_view(df: DataFrame, as_of: AsOf = None) -> DataFrame:
    """The recent rows under their report names (Q-10, F-01, F-02)."""
    return _recent(df, as_of).select(
        *[F.col(source).alias(name) for name, source in SUMMARY_COLUMNS.items()]
    )


def cost_by_customer(df: DataFrame, as_of: AsOf = None, **options) -> DataFrame:
    """Billed and effective cost per customer and currency (Q-11)."""
    return cost_rollup(
        _recent(df, as_of),
        keys={**CUSTOMER, "BillingCurrency": "BillingCurrency"},
        sums={"TotalBilledCost": "BilledCost", "TotalEffectiveCost": "EffectiveCost"},
        distincts=RESOURCES,
        order_by=["TotalBilledCost"],
        **options,
    )


def daily_trend(df: DataFrame, as_of: AsOf = None, date_col: str = PERIOD, **options) -> DataFrame:
    """Cost, customers and resources per day (Q-12; Q-12b with ``ChargePeriodStart``).

    The default groups by the *start of the billing period*, as the report
    always did; pass ``date_col="ChargePeriodStart"`` for the days of the charges.
    """
    return cost_rollup(
        df.filter(trailing(date_col, as_of, WINDOW)),
        keys={"Date": day(date_col)},
        sums={"DailyCost": "BilledCost", "DailyEffectiveCost": "EffectiveCost"},
        distincts={"ActiveCustomers": "SubAccountId", "ActiveResources": "ResourceId"},
        order_by=["Date"],
        **options,
    )


def daily_trend_short(
    df: DataFrame, as_of: AsOf = None, date_col: str = PERIOD, **options
) -> DataFrame:
    """Cost and customers per day (Q-12a)."""
    return cost_rollup(
        df.filter(trailing(date_col, as_of, WINDOW)),
        keys={"Date": day(date_col)},
        sums={"DailyCost": "BilledCost"},
        distincts={"ActiveCustomers": "SubAccountId"},
        order_by=["Date"],
        **options,
    )


def cost_by_service_category(df: DataFrame, as_of: AsOf = None, **options) -> DataFrame:
    """Cost, customers and resources per service (Q-13)."""
    return cost_rollup(
        _recent(df, as_of),
        keys=SERVICE,
        sums={"TotalCost": "BilledCost"},
        distincts={**CUSTOMERS, **RESOURCES},
        order_by=["TotalCost"],
        **options,
    )


def customer_summary(
    df: DataFrame, as_of: AsOf = None, days_back: int = WINDOW, limit: int | None = None, **options
) -> DataFrame:
    """Cost, services and resources per customer (Q-21)."""
    return cost_rollup(
        _recent(df, as_of, days_back),
        keys=CUSTOMER,
        sums={"TotalCost": "BilledCost", "EffectiveCost": "EffectiveCost"},
        distincts={"ServicesUsed": "ServiceName", **RESOURCES},
        order_by=["TotalCost"],
        limit=limit,
        **options,
    )


def top10_customers(df: DataFrame, as_of: AsOf = None, **options) -> DataFrame:
    """The ten customers who spend most (Q-14)."""
    return customer_summary(df, as_of, limit=10, **options)


def cost_by_region(df: DataFrame, as_of: AsOf = None, **options) -> DataFrame:
    """Cost, customers and resources per region (Q-15)."""
    return cost_rollup(
        _recent(df, as_of).filter(F.col("RegionName").isNotNull()),
        keys={"Region": "RegionName"},
        sums={"TotalCost": "BilledCost"},
        distincts={**CUSTOMERS, **RESOURCES},
        order_by=["TotalCost"],
        **options,
    )


def _is_customer(customer_tenant_id: str, options: dict) -> Column:
    """The rows of one customer (F-07); with ``fold_case`` whatever the case of its id."""
    own, wanted = F.col("SubAccountId"), F.lit(customer_tenant_id)
    return F.lower(own) == F.lower(wanted) if options.get("fold_case") else own == wanted


def customer_deep_dive(
    df: DataFrame, customer_tenant_id: str, as_of: AsOf = None, **options
) -> DataFrame:
    """One customer's cost and usage per resource (Q-16)."""
    return cost_rollup(
        _recent(df, as_of).filter(_is_customer(customer_tenant_id, options)),
        keys={
            **SERVICE,
            "ResourceName": "ResourceName",
            "ResourceType": "ResourceType",
            "Region": "RegionName",
            "UsageUnit": "ConsumedUnit",
        },
        sums={"TotalCost": "BilledCost", "TotalUsage": "ConsumedQuantity"},
        order_by=["TotalCost"],
        **options,
    )


def discount_analysis(df: DataFrame, as_of: AsOf = None, **options) -> DataFrame:
    """List against effective cost per customer (Q-17).

    A row that lacks either cost adds to neither side of ``TotalSavings``.
    """
    by_customer = cost_rollup(
        _recent(df, as_of),
        keys={"CustomerName": "SubAccountName"},
        sums={
            "TotalListCost": "ListCost",
            "TotalContractedCost": "ContractedCost",
            "TotalEffectiveCost": "EffectiveCost",
            "TotalSavings": F.col("ListCost") - F.col("EffectiveCost"),
        },
        **options,
    )
    listed, effective = F.col("TotalListCost"), F.col("TotalEffectiveCost")
    keys = ["CustomerName", *(["BillingCurrency"] if "BillingCurrency" in by_customer.columns else [])]
    return ranked(
        by_customer.withColumn("DiscountPercentage", percent(listed - effective, listed)),
        ["TotalSavings"],
        keys,
    )


def month_over_month(
    df: DataFrame, as_of: AsOf = None, by_currency: bool = False, fold_case: bool = False
) -> DataFrame:
    """This calendar month against the last, per customer (Q-18, J-01, F-09).

    The rows are those of a full outer join of two monthly aggregates, found in
    one pass with conditional sums.  NULL keys never match in such a join, hence
    the extra key that keeps their two months apart.  A customer without rows this
    month has a negative change and a NULL percentage; a new one has 0 percent.
    """
    current = in_month(PERIOD, as_of)  # a folded name shows its smallest spelling
    keys = {"CustomerName": "SubAccountName"}
    if by_currency:
        keys["BillingCurrency"] = "BillingCurrency"
    unmatched = reduce(Column.__or__, [F.col(c).isNull() for c in keys.values()])
    both = (
        df.filter((F.col(PERIOD) >= month_start(as_of, 1)) & (F.col(PERIOD) < month_start(as_of, -1)))
        .groupBy(
            *[(F.lower(c) if fold_case else F.col(c)).alias(f"group_{name}") for name, c in keys.items()],
            F.when(unmatched, current).alias("unmatched_month"),
        )
        .agg(
            *[F.min(c).alias(name) for name, c in keys.items()],
            total(F.when(current, F.col("BilledCost"))).alias("this_month"),
            total(F.when(~current, F.col("BilledCost"))).alias("last_month"),
        )
    )
    zero = F.lit(0).cast(TOTAL)
    this, last = F.col("this_month"), F.col("last_month")
    known_this, known_last = F.coalesce(this, zero), F.coalesce(last, zero)
    return ranked(
        both.select(
            *keys,
            known_last.alias("LastMonthCost"),
            known_this.alias("ThisMonthCost"),
            (known_this - known_last).cast(TOTAL).alias("CostChange"),
            percent(this - last, last).alias("PercentChange"),
        ),
        ["ThisMonthCost"],
        [*keys, "LastMonthCost"],
    )


def untagged_resources(df: DataFrame, as_of: AsOf = None, **options) -> DataFrame:
    """Cost of resources without tags (Q-19)."""
    return cost_rollup(
        _recent(df, as_of).filter(untagged()),
        keys={
            "CustomerName": "SubAccountName",
            "ResourceId": "ResourceId",
            "ResourceName": "ResourceName",
            "ServiceName": "ServiceName",
        },
        sums={"Cost": "BilledCost"},
        order_by=["Cost"],
        **options,
    )


def commitment_utilization(df: DataFrame, as_of: AsOf = None, **options) -> DataFrame:
    """Cost and customers per commitment discount (Q-20)."""
    return cost_rollup(
        _recent(df, as_of).filter(F.col("CommitmentDiscountId").isNotNull()),
        keys={
            "CommitmentDiscountId": "CommitmentDiscountId",
            "ChargeCategory": "ChargeCategory",
            "PricingCategory": "PricingCategory",
        },
        sums={"CommitmentCost": "BilledCost", "EffectiveCommitmentCost": "EffectiveCost"},
        distincts={"CustomersUsing": "SubAccountId"},
        order_by=["CommitmentCost"],
        **options,
    )


def customer_trend(
    df: DataFrame, customer_tenant_id: str, as_of: AsOf = None, days_back: int = WINDOW, **options
) -> DataFrame:
    """One customer's cost and services per day (Q-22)."""
    return cost_rollup(
        _recent(df, as_of, days_back).filter(_is_customer(customer_tenant_id, options)),
        keys={"Date": day(PERIOD)},
        sums={"DailyCost": "BilledCost"},
        distincts={"ServicesUsed": "ServiceName"},
        order_by=["Date"],
        **options,
    )


def service_breakdown(df: DataFrame, as_of: AsOf = None, **options) -> DataFrame:
    """Cost and customers per service (Q-23)."""
    return cost_rollup(
        _recent(df, as_of),
        keys=SERVICE,
        sums={"TotalCost": "BilledCost"},
        distincts=CUSTOMERS,
        order_by=["TotalCost"],
        **options,
    )
