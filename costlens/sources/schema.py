"""The canonical billing schema and the names other exports use for its columns."""

from __future__ import annotations

from pyspark.sql.types import DecimalType, StringType, StructField, StructType, TimestampType

# The declared columns of a cost-and-usage export, in file order.
FOCUS_COLUMNS = (
    "BilledCost",
    "BillingAccountId",
    "BillingAccountName",
    "BillingAccountType",
    "BillingCurrency",
    "BillingPeriodEnd",
    "BillingPeriodStart",
    "ChargeCategory",
    "ChargeClass",
    "ChargeDescription",
    "ChargeFrequency",
    "ChargePeriodEnd",
    "ChargePeriodStart",
    "CommitmentDiscountCategory",
    "CommitmentDiscountId",
    "CommitmentDiscountName",
    "CommitmentDiscountStatus",
    "CommitmentDiscountType",
    "ConsumedQuantity",
    "ConsumedUnit",
    "ContractedCost",
    "ContractedUnitPrice",
    "EffectiveCost",
    "InvoiceIssuerName",
    "ListCost",
    "ListUnitPrice",
    "PricingCategory",
    "PricingQuantity",
    "PricingUnit",
    "ProviderName",
    "PublisherName",
    "RegionId",
    "RegionName",
    "ResourceId",
    "ResourceName",
    "ResourceType",
    "ServiceCategory",
    "ServiceName",
    "SkuId",
    "SkuPriceId",
    "SubAccountId",
    "SubAccountName",
    "SubAccountType",
    "Tags",
    "x_AccountId",
    "x_AccountName",
    "x_AccountOwnerId",
    "x_BilledCostInUsd",
    "x_BilledUnitPrice",
    "x_BillingAccountId",
    "x_BillingAccountName",
    "x_BillingExchangeRate",
    "x_BillingExchangeRateDate",
    "x_BillingProfileId",
    "x_BillingProfileName",
    "x_ContractedCostInUsd",
    "x_CostAllocationRuleName",
    "x_CostCenter",
    "x_CustomerId",
    "x_CustomerName",
    "x_EffectiveCostInUsd",
    "x_EffectiveUnitPrice",
    "x_InvoiceId",
    "x_InvoiceIssuerId",
    "x_InvoiceSectionId",
    "x_InvoiceSectionName",
    "x_ListCostInUsd",
    "x_PartnerCreditApplied",
    "x_PartnerCreditRate",
    "x_PricingBlockSize",
    "x_PricingCurrency",
    "x_PricingSubcategory",
    "x_PricingUnitDescription",
    "x_PublisherCategory",
    "x_PublisherId",
    "x_ResellerId",
    "x_ResellerName",
    "x_ResourceGroupName",
    "x_ResourceType",
    "x_ServicePeriodEnd",
    "x_ServicePeriodStart",
    "x_SkuDescription",
    "x_SkuDetails",
    "x_SkuIsCreditEligible",
    "x_SkuMeterCategory",
    "x_SkuMeterId",
    "x_SkuMeterName",
    "x_SkuMeterSubcategory",
    "x_SkuOfferId",
    "x_SkuOrderId",
    "x_SkuOrderName",
    "x_SkuPartNumber",
    "x_SkuRegion",
    "x_SkuServiceFamily",
    "x_SkuTerm",
    "x_SkuTier",
)

# Names of the same facts in provider-specific exports and reports.
# Matching ignores case.
ALIASES = {
    "ChargePeriodStart": ("date",),
    "x_BilledCostInUsd": ("costInUsd",),
    "x_ResourceGroupName": ("resourceGroupName", "resourceGroup"),
    "x_SkuServiceFamily": ("serviceFamily",),
    "RegionName": ("resourceLocation", "Region"),
    "ConsumedQuantity": ("UsageQuantity", "quantity"),
    "ConsumedUnit": ("UsageUnit", "unitOfMeasure"),
    "BilledCost": ("costInBillingCurrency",),
    "EffectiveCost": ("costInBillingCurrency",),
    "ListCost": ("paygCostInBillingCurrency",),
    "BillingCurrency": ("billingCurrencyCode",),
    "BillingAccountName": ("billingAccountName",),
    "BillingPeriodStart": ("billingPeriodStartDate",),
    "BillingPeriodEnd": ("billingPeriodEndDate",),
    "SubAccountId": ("SubscriptionId",),
    "SubAccountName": ("subscriptionName",),
    "ServiceCategory": ("serviceFamily",),
    "ServiceName": ("consumedService", "meterCategory"),
    "ChargeCategory": ("chargeType",),
    "PricingCategory": ("pricingModel",),
    "CommitmentDiscountId": ("reservationId",),
    "x_CostCenter": ("costCenter",),
    "x_SkuMeterId": ("meterId",),
    "x_SkuMeterName": ("meterName",),
}

# Read by the summary view but not part of the declared export.
CHARGE_TYPE = "ChargeType"
# The untouched date text, kept because a report filters on it.
DATE_RAW = "date_raw"
# Where a row came from; present on ingested tables.
EXPORT_SCOPE = "export_scope"
EXPORT_PERIOD = "export_period"
# The export period of a folder without date range.
FLAT_PERIOD = "current"


def silver_type(name: str):
    """DECIMAL for amounts, TIMESTAMP for moments, STRING for the rest."""
    if name.endswith(("PeriodStart", "PeriodEnd", "RateDate")):
        return TimestampType()
    amount = (
        "Cost" in name and name not in ("x_CostAllocationRuleName", "x_CostCenter")
    ) or name.endswith(("Price", "Quantity", "Rate", "BlockSize"))
    return DecimalType(18, 6) if amount else StringType()


RAW_SCHEMA = StructType([StructField(c, StringType()) for c in FOCUS_COLUMNS])
CANONICAL_SCHEMA = StructType(
    [StructField(c, silver_type(c)) for c in FOCUS_COLUMNS]
    + [StructField(CHARGE_TYPE, StringType()), StructField(DATE_RAW, StringType())]
)
