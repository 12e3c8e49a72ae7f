"""DuckDB SQL for every registered query that SQL can express.

Each text restates its report over the same star tables.  ``AS_OF`` below is the
reporting moment of the registered queries.
"""

from __future__ import annotations

from costlens.sources.schema import FOCUS_COLUMNS

AS_OF = "2001-10-15 00:00:00"
TENANT = "t-5"

_STAR = """
FROM lineitem
LEFT JOIN orders ON l_orderkey = o_orderkey
LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN part ON l_partkey = p_partkey
LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey
"""

_EFFECTIVE = """CAST(l_extendedprice AS DECIMAL(12,2))
        * (CAST(1 AS DECIMAL(3,2)) - CAST(l_discount AS DECIMAL(3,2)))"""

_FOCUS = f"""
focus AS (
    SELECT
        CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS BillingPeriodStart,
        CAST(l_shipdate AS TIMESTAMP) AS ChargePeriodStart,
        CASE WHEN l_linenumber % 2 = 0 THEN 'T-' ELSE 't-' END || CAST(o_custkey AS VARCHAR) AS SubAccountId,
        c_name AS SubAccountName,
        p_type AS ServiceCategory,
        CASE WHEN l_linenumber % 2 = 0 THEN upper(p_brand) ELSE p_brand END AS ServiceName,
        '/res/' || CAST(l_partkey AS VARCHAR) AS ResourceId,
        p_name AS ResourceName,
        CAST(p_size AS VARCHAR) AS ResourceType,
        CASE WHEN r_name <> 'MIDDLE EAST' THEN r_name END AS RegionName,
        n_name AS x_ResourceGroupName,
        CASE WHEN l_linenumber % 3 = 0 THEN 'EUR' ELSE 'USD' END AS BillingCurrency,
        CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DECIMAL(18,6)) AS ListCost,
        CAST({_EFFECTIVE} AS DECIMAL(18,6)) AS EffectiveCost,
        CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(0.95 AS DECIMAL(3,2)) AS DECIMAL(18,6)) AS ContractedCost,
        CAST({_EFFECTIVE}
            * (CAST(1 AS DECIMAL(3,2)) + CAST(l_tax AS DECIMAL(3,2))) AS DECIMAL(18,6)) AS BilledCost,
        CAST(l_quantity AS DECIMAL(18,6)) AS ConsumedQuantity,
        l_linestatus AS ConsumedUnit,
        l_returnflag AS ChargeCategory,
        o_orderpriority AS PricingCategory,
        CASE WHEN l_discount >= 0.08 THEN 'ri-' || CAST(l_suppkey AS VARCHAR) END AS CommitmentDiscountId,
        CASE WHEN l_returnflag = 'N' THEN NULL
             WHEN l_returnflag = 'R' THEN '{{}}'
             WHEN l_linestatus = 'O' THEN ''
             ELSE '{{"env":"prod"}}' END AS Tags
    {_STAR}
)"""

_LEGACY = f"""
legacy_text AS (
    SELECT
        CASE WHEN l_linenumber = 7 AND l_returnflag = 'A' THEN 'date'
             WHEN l_linenumber = 6 AND l_returnflag = 'R' THEN NULL
             WHEN l_linenumber = 5 AND l_returnflag = 'R' THEN 'bad'
             ELSE strftime(l_shipdate, '%Y-%m-%d') END AS day_text,
        CASE WHEN l_linenumber = 4 AND l_returnflag = 'N' THEN 'n/a'
             ELSE CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) END AS cost_text,
        CASE WHEN l_linenumber = 3 AND l_returnflag = 'A' THEN ''
             WHEN l_linenumber = 2 AND l_returnflag = 'A' THEN NULL
             ELSE CASE WHEN l_linenumber % 2 = 0 THEN '/RES/' ELSE '/res/' END || CAST(l_partkey AS VARCHAR)
             END AS ResourceId,
        n_name AS resourceGroupName,
        p_type AS serviceFamily,
        CASE WHEN r_name <> 'MIDDLE EAST' THEN r_name END AS resourceLocation
    {_STAR}
),
legacy AS (
    SELECT *,
        TRY_CAST(day_text AS DATE) AS used_on,
        TRY_CAST(cost_text AS DECIMAL(18,6)) AS cost
    FROM legacy_text
)"""

_RECENT = f"BillingPeriodStart >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY"
_DATED = "day_text IS NOT NULL AND day_text <> 'date'"
_UNTAGGED = "(Tags IS NULL OR Tags = '{}' OR Tags = '')"


def _sum(c: str, name: str) -> str:
    return f"CAST(SUM({c}) AS DECIMAL(38,6)) AS {name}"


def _distinct(c: str, name: str) -> str:
    return f"COUNT(DISTINCT {c}) AS {name}"


def _focus(body: str) -> str:
    return f"WITH {_FOCUS}\n{body}"


def _legacy_open(body: str) -> str:
    """Charges under the open names, with the resource ids of the other vocabulary."""
    dirty = """CASE WHEN l_linenumber = 3 AND l_returnflag = 'A' THEN ''
             WHEN l_linenumber = 2 AND l_returnflag = 'A' THEN NULL
             ELSE CASE WHEN l_linenumber % 2 = 0 THEN '/RES/' ELSE '/res/' END || CAST(l_partkey AS VARCHAR)
             END AS ResourceId"""
    return f"WITH {_FOCUS}\n{body}".replace("'/res/' || CAST(l_partkey AS VARCHAR) AS ResourceId", dirty)


def _legacy(body: str) -> str:
    return f"WITH {_LEGACY}\n{body}"


_YEAR_MONTH = 'CAST(year(used_on) AS INTEGER) AS "Year", CAST(month(used_on) AS INTEGER) AS "Month"'

_MONTHLY_TREND = _legacy(f"""
    SELECT {_YEAR_MONTH}, {_sum("cost", "MonthlyCostUSD")}, {_distinct("used_on", "DaysWithData")}
    FROM legacy WHERE {_DATED} GROUP BY 1, 2""")

_UNUSED = f"""
    , recent AS (
        SELECT DISTINCT ResourceId FROM legacy
        WHERE used_on >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND cost > 0)
    SELECT DISTINCT ResourceId AS "resourceId", resourceGroupName AS "resourceGroup"
    FROM legacy b
    WHERE ResourceId IS NOT NULL"""

_CUSTOMER = "SubAccountName AS CustomerName, SubAccountId AS CustomerTenantId"

_CUSTOMER_SUMMARY = f"""
    SELECT {_CUSTOMER}, {_sum("BilledCost", "TotalCost")}, {_sum("EffectiveCost", "EffectiveCost")},
        {_distinct("ServiceName", "ServicesUsed")}, {_distinct("ResourceId", "ResourceCount")}
    FROM focus WHERE {_RECENT} GROUP BY SubAccountName, SubAccountId"""

_MONTH_OVER_MONTH = _focus(f"""
    , cur AS (
        SELECT SubAccountName AS n, CAST(SUM(BilledCost) AS DECIMAL(38,6)) AS c FROM focus
        WHERE month(BillingPeriodStart) = month(TIMESTAMP '{AS_OF}')
          AND year(BillingPeriodStart) = year(TIMESTAMP '{AS_OF}')
        GROUP BY SubAccountName),
    prev AS (
        SELECT SubAccountName AS n, CAST(SUM(BilledCost) AS DECIMAL(38,6)) AS c FROM focus
        WHERE month(BillingPeriodStart) = month(TIMESTAMP '{AS_OF}' - INTERVAL 1 MONTH)
          AND year(BillingPeriodStart) = year(TIMESTAMP '{AS_OF}' - INTERVAL 1 MONTH)
        GROUP BY SubAccountName)
    SELECT COALESCE(cur.n, prev.n) AS CustomerName,
        CAST(COALESCE(prev.c, 0) AS DECIMAL(38,6)) AS LastMonthCost,
        CAST(COALESCE(cur.c, 0) AS DECIMAL(38,6)) AS ThisMonthCost,
        CAST(COALESCE(cur.c, 0) - COALESCE(prev.c, 0) AS DECIMAL(38,6)) AS CostChange,
        CASE WHEN prev.c > 0 THEN CAST(cur.c - prev.c AS DOUBLE) / CAST(prev.c AS DOUBLE) * 100.0::DOUBLE
             ELSE 0.0::DOUBLE END AS PercentChange
    FROM cur FULL OUTER JOIN prev ON cur.n = prev.n""")

_STAR_COLUMNS = (
    "BillingPeriodStart", "ChargePeriodStart", "SubAccountId", "SubAccountName", "ServiceCategory",
    "ServiceName", "ResourceId", "ResourceName", "ResourceType", "RegionName", "x_ResourceGroupName",
    "BillingCurrency", "ListCost", "EffectiveCost", "ContractedCost", "BilledCost", "ConsumedQuantity",
    "ConsumedUnit", "ChargeCategory", "PricingCategory", "CommitmentDiscountId", "Tags",
)
# All declared columns; those the star doesn't have are empty.
_COUNTS = ", ".join(
    (f"COUNT({c})" if c in _STAR_COLUMNS else "CAST(0 AS BIGINT)") + f' AS "n_{c}"' for c in FOCUS_COLUMNS
)

_DAILY_ROWS = """
    SELECT BillingPeriodStart, ChargePeriodStart, SubAccountId, SubAccountName, ServiceName, ResourceId,
        ResourceName, RegionName, BilledCost, EffectiveCost, ListCost, ConsumedQuantity, ChargeCategory, Tags
    FROM focus"""



def _exported(sql: str) -> str:
    """The charges that the newest runs of both exports hold."""
    kept = """focus AS (
    SELECT * FROM charges
    WHERE NOT (ConsumedUnit = 'O' AND month(BillingPeriodStart) % 2 = 1 AND day(ChargePeriodStart) > 15)
)"""
    charges = _FOCUS.replace("focus AS (", "charges AS (", 1)
    return sql.replace(_FOCUS, f"{charges},\n{kept}", 1)


_RUNS = """
    , runs AS (
        SELECT strftime(BillingPeriodStart, '%Y%m%d') AS export_period, ConsumedUnit AS scope, r, run_day
        FROM focus, (VALUES ('15', 15), ('31', 31)) AS runs(r, run_day)
        WHERE day(ChargePeriodStart) <= run_day
          AND NOT (run_day = 31 AND ConsumedUnit = 'O' AND month(BillingPeriodStart) % 2 = 1))"""

_MONTH_TOTALS = _focus(f"""
    SELECT BillingPeriodStart, COUNT(*) AS "RowCount", {_sum("BilledCost", "TotalCost")},
        {_sum("ConsumedQuantity", "TotalUsage")}
    FROM focus GROUP BY BillingPeriodStart""")


def _dataset(amount: str) -> str:
    return _focus(f"""
    SELECT ServiceCategory, ChargeCategory, {_sum(amount, "TotalAmount")}, COUNT(*) AS "RowCount"
    FROM focus GROUP BY ServiceCategory, ChargeCategory""")


ORACLE = {
    # provider-specific vocabulary
    "billing_summary": _legacy(f"""
    SELECT resourceGroupName, serviceFamily, {_sum("cost", "TotalCostUSD")},
        COUNT(*) AS TransactionCount, {_distinct("used_on", "DaysActive")}
    FROM legacy
    WHERE used_on BETWEEN CAST(TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AS DATE) AND CAST(TIMESTAMP '{AS_OF}' AS DATE)
      AND {_DATED}
    GROUP BY resourceGroupName, serviceFamily"""),
    "daily_costs": _legacy(f"""
    SELECT used_on AS BillingDate, {_sum("cost", "DailyCostUSD")},
        {_distinct("ResourceId", "ResourceCount")}, COUNT(*) AS TransactionCount
    FROM legacy
    WHERE used_on >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND {_DATED}
    GROUP BY used_on"""),
    "top_resources": _legacy(f"""
    SELECT ResourceId, resourceGroupName, serviceFamily, {_sum("cost", "TotalCostUSD")},
        COUNT(*) AS UsageCount
    FROM legacy WHERE ResourceId IS NOT NULL AND ResourceId <> ''
    GROUP BY ResourceId, resourceGroupName, serviceFamily
    ORDER BY TotalCostUSD DESC NULLS LAST, ResourceId, resourceGroupName NULLS FIRST, serviceFamily NULLS FIRST
    LIMIT 20"""),
    "cost_by_location": _legacy(f"""
    SELECT resourceLocation, {_distinct("resourceGroupName", "ResourceGroups")},
        {_distinct("serviceFamily", "Services")}, {_sum("cost", "TotalCostUSD")}
    FROM legacy WHERE resourceLocation IS NOT NULL GROUP BY resourceLocation"""),
    "monthly_trend": _MONTHLY_TREND,
    "daily_cost_history": _legacy(f"""
    SELECT used_on AS BillingDate, {_sum("cost", "DailyCostUSD")}, {_distinct("ResourceId", "ResourceCount")}
    FROM legacy GROUP BY used_on"""),
    "top10_resources": _legacy(f"""
    SELECT ResourceId AS "resourceId", resourceGroupName AS "resourceGroup", {_sum("cost", "TotalCost")}
    FROM legacy GROUP BY ResourceId, resourceGroupName
    ORDER BY TotalCost DESC NULLS LAST, ResourceId NULLS FIRST, resourceGroupName NULLS FIRST
    LIMIT 10"""),
    "unused_resources": _legacy(
        _UNUSED + " AND NOT EXISTS (SELECT 1 FROM recent r WHERE r.ResourceId = b.ResourceId)"
    ),
    "unused_resources_prefiltered": _legacy(
        _UNUSED + " AND NOT EXISTS (SELECT 1 FROM recent r WHERE r.ResourceId = b.ResourceId)"
    ),
    "unused_resources_null_aware": _legacy(
        _UNUSED + " AND ResourceId NOT IN (SELECT ResourceId FROM recent)"
    ),
    "unused_resources_null_aware_kept": _legacy(
        _UNUSED.replace("AND cost > 0", "AND cost > 0 AND ResourceId IS NOT NULL")
        + " AND ResourceId NOT IN (SELECT ResourceId FROM recent)"
    ),
    "unused_resources_fold_case": _legacy(f"""
    , recent AS (
        SELECT DISTINCT lower(ResourceId) AS id FROM legacy
        WHERE used_on >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND cost > 0 AND ResourceId IS NOT NULL)
    SELECT MIN(ResourceId) AS "resourceId", MIN(resourceGroupName) AS "resourceGroup"
    FROM legacy WHERE ResourceId IS NOT NULL AND lower(ResourceId) NOT IN (SELECT id FROM recent)
    GROUP BY lower(ResourceId), lower(resourceGroupName)"""),
    "department_chargeback": _legacy(f"""
    SELECT resourceGroupName AS Department, {_YEAR_MONTH}, {_sum("cost", "MonthlyCharge")}
    FROM legacy WHERE resourceGroupName IS NOT NULL GROUP BY 1, 2, 3"""),
    # open specification vocabulary
    "billing_summary_view": _focus(f"""
    SELECT BillingPeriodStart, CAST(NULL AS TIMESTAMP) AS BillingPeriodEnd,
        CAST(NULL AS VARCHAR) AS InvoiceIssuerName, CAST(NULL AS VARCHAR) AS ProviderName,
        ServiceName, ServiceCategory, RegionName AS Region, ResourceId, ResourceName, ResourceType,
        SubAccountId AS CustomerTenantId, SubAccountName AS CustomerName, BilledCost, BillingCurrency,
        ContractedCost, EffectiveCost, ListCost, ConsumedQuantity AS UsageQuantity,
        ConsumedUnit AS UsageUnit, ChargeCategory, CAST(NULL AS VARCHAR) AS ChargeFrequency,
        CAST(NULL AS VARCHAR) AS ChargeType, CommitmentDiscountId, PricingCategory, Tags
    FROM focus WHERE {_RECENT}"""),
    "cost_by_customer": _focus(f"""
    SELECT {_CUSTOMER}, BillingCurrency, {_sum("BilledCost", "TotalBilledCost")},
        {_sum("EffectiveCost", "TotalEffectiveCost")}, {_distinct("ResourceId", "ResourceCount")}
    FROM focus WHERE {_RECENT} GROUP BY SubAccountName, SubAccountId, BillingCurrency"""),
    "focus_daily_trend": _focus(f"""
    SELECT CAST(BillingPeriodStart AS DATE) AS "Date", {_sum("BilledCost", "DailyCost")},
        {_sum("EffectiveCost", "DailyEffectiveCost")}, {_distinct("SubAccountId", "ActiveCustomers")},
        {_distinct("ResourceId", "ActiveResources")}
    FROM focus WHERE {_RECENT} GROUP BY 1"""),
    "focus_daily_trend_short": _focus(f"""
    SELECT CAST(BillingPeriodStart AS DATE) AS "Date", {_sum("BilledCost", "DailyCost")},
        {_distinct("SubAccountId", "ActiveCustomers")}
    FROM focus WHERE {_RECENT} GROUP BY 1"""),
    "focus_daily_trend_charge": _focus(f"""
    SELECT CAST(ChargePeriodStart AS DATE) AS "Date", {_sum("BilledCost", "DailyCost")},
        {_sum("EffectiveCost", "DailyEffectiveCost")}, {_distinct("SubAccountId", "ActiveCustomers")},
        {_distinct("ResourceId", "ActiveResources")}
    FROM focus WHERE ChargePeriodStart >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY GROUP BY 1"""),
    "cost_by_service_category": _focus(f"""
    SELECT ServiceCategory, ServiceName, {_sum("BilledCost", "TotalCost")},
        {_distinct("SubAccountId", "CustomerCount")}, {_distinct("ResourceId", "ResourceCount")}
    FROM focus WHERE {_RECENT} GROUP BY ServiceCategory, ServiceName"""),
    "cost_by_service_category_by_currency": _focus(f"""
    SELECT ServiceCategory, ServiceName, BillingCurrency, {_sum("BilledCost", "TotalCost")},
        {_distinct("SubAccountId", "CustomerCount")}, {_distinct("ResourceId", "ResourceCount")}
    FROM focus WHERE {_RECENT} GROUP BY ServiceCategory, ServiceName, BillingCurrency"""),
    "cost_by_service_category_fold_case": _focus(f"""
    SELECT MIN(ServiceCategory) AS ServiceCategory, MIN(ServiceName) AS ServiceName,
        {_sum("BilledCost", "TotalCost")}, {_distinct("lower(SubAccountId)", "CustomerCount")},
        {_distinct("lower(ResourceId)", "ResourceCount")}
    FROM focus WHERE {_RECENT} GROUP BY lower(ServiceCategory), lower(ServiceName)"""),
    "top10_customers": _focus(
        _CUSTOMER_SUMMARY
        + """ ORDER BY TotalCost DESC NULLS LAST, CustomerName NULLS FIRST, CustomerTenantId NULLS FIRST
    LIMIT 10"""
    ),
    "cost_by_region": _focus(f"""
    SELECT RegionName AS Region, {_distinct("SubAccountId", "CustomerCount")},
        {_sum("BilledCost", "TotalCost")}, {_distinct("ResourceId", "ResourceCount")}
    FROM focus WHERE {_RECENT} AND RegionName IS NOT NULL GROUP BY RegionName"""),
    "customer_deep_dive": _focus(f"""
    SELECT ServiceCategory, ServiceName, ResourceName, ResourceType, RegionName AS Region,
        ConsumedUnit AS UsageUnit, {_sum("BilledCost", "TotalCost")}, {_sum("ConsumedQuantity", "TotalUsage")}
    FROM focus WHERE SubAccountId = '{TENANT}' AND {_RECENT}
    GROUP BY ServiceCategory, ServiceName, ResourceName, ResourceType, RegionName, ConsumedUnit"""),
    "discount_analysis": _focus(f"""
    , s AS (
        SELECT SubAccountName AS CustomerName, {_sum("ListCost", "TotalListCost")},
            {_sum("ContractedCost", "TotalContractedCost")}, {_sum("EffectiveCost", "TotalEffectiveCost")},
            {_sum("ListCost - EffectiveCost", "TotalSavings")}
        FROM focus WHERE {_RECENT} GROUP BY SubAccountName)
    SELECT *, CASE WHEN TotalListCost > 0
            THEN CAST(TotalListCost - TotalEffectiveCost AS DOUBLE) / CAST(TotalListCost AS DOUBLE) * 100.0::DOUBLE
            ELSE 0.0::DOUBLE END AS DiscountPercentage
    FROM s"""),
    "month_over_month": _MONTH_OVER_MONTH,
    "untagged_resources": _focus(f"""
    SELECT SubAccountName AS CustomerName, ResourceId, ResourceName, ServiceName, {_sum("BilledCost", "Cost")}
    FROM focus WHERE {_UNTAGGED} AND {_RECENT}
    GROUP BY SubAccountName, ResourceId, ResourceName, ServiceName"""),
    "commitment_utilization": _focus(f"""
    SELECT CommitmentDiscountId, ChargeCategory, PricingCategory, {_sum("BilledCost", "CommitmentCost")},
        {_sum("EffectiveCost", "EffectiveCommitmentCost")}, {_distinct("SubAccountId", "CustomersUsing")}
    FROM focus WHERE CommitmentDiscountId IS NOT NULL AND {_RECENT}
    GROUP BY CommitmentDiscountId, ChargeCategory, PricingCategory"""),
    "customer_summary": _focus(_CUSTOMER_SUMMARY),
    "customer_trend": _focus(f"""
    SELECT CAST(BillingPeriodStart AS DATE) AS "Date", {_sum("BilledCost", "DailyCost")},
        {_distinct("ServiceName", "ServicesUsed")}
    FROM focus WHERE SubAccountId = '{TENANT}' AND {_RECENT} GROUP BY 1"""),
    "customer_trend_fold_case": _focus(f"""
    SELECT CAST(BillingPeriodStart AS DATE) AS "Date", {_sum("BilledCost", "DailyCost")},
        {_distinct("lower(ServiceName)", "ServicesUsed")}
    FROM focus WHERE lower(SubAccountId) = '{TENANT}' AND {_RECENT} GROUP BY 1"""),
    "legacy_cost_by_customer": _legacy_open(f"""
    SELECT {_CUSTOMER}, BillingCurrency, {_sum("ListCost", "TotalBilledCost")},
        {_sum("ListCost", "TotalEffectiveCost")}, {_distinct("ResourceId", "ResourceCount")}
    FROM focus WHERE {_RECENT} GROUP BY SubAccountName, SubAccountId, BillingCurrency"""),
    "legacy_month_over_month": _MONTH_OVER_MONTH.replace("SUM(BilledCost)", "SUM(ListCost)"),
    "service_breakdown": _focus(f"""
    SELECT ServiceCategory, ServiceName, {_sum("BilledCost", "TotalCost")},
        {_distinct("SubAccountId", "CustomerCount")}
    FROM focus WHERE {_RECENT} GROUP BY ServiceCategory, ServiceName"""),
    # exports, tables, checks
    "dataset_actual_cost": _dataset("BilledCost"),
    "dataset_amortized_cost": _dataset("EffectiveCost"),
    "dataset_usage": _dataset("ConsumedQuantity"),
    "daily_granularity": _focus("""
    SELECT ChargePeriodStart, ChargePeriodStart + INTERVAL 1 DAY AS ChargePeriodEnd,
        strftime(ChargePeriodStart, '%Y-%m-%d') AS date_raw, SubAccountId, ServiceName, ChargeCategory,
        CAST(SUM(BilledCost) AS DECIMAL(18,6)) AS BilledCost,
        CAST(SUM(ConsumedQuantity) AS DECIMAL(18,6)) AS ConsumedQuantity
    FROM focus GROUP BY ChargePeriodStart, SubAccountId, ServiceName, ChargeCategory"""),
    "latest_snapshot": _focus("""
    , snapshots AS (
        SELECT focus.*, run_day FROM focus, (VALUES (7), (14), (21), (31)) AS runs(run_day)
        WHERE day(ChargePeriodStart) <= run_day
          AND run_day <= CASE WHEN ConsumedUnit = 'O' AND month(BillingPeriodStart) % 2 = 1 THEN 21 ELSE 31 END),
    marked AS (
        SELECT *, MAX(run_day) OVER (PARTITION BY ConsumedUnit, BillingPeriodStart) AS newest FROM snapshots)
    SELECT BillingPeriodStart, ChargePeriodStart, ResourceId, SubAccountId, BilledCost,
        ConsumedUnit AS export_scope, CAST(run_day AS INTEGER) AS run_day
    FROM marked WHERE run_day = newest"""),
    "export_files": _focus(f"""{_RUNS}
    SELECT export_period, 'run=' || r AS run, COUNT(DISTINCT scope) AS exports FROM runs GROUP BY export_period, r"""),
    "export_latest_runs": _focus(f"""{_RUNS}
    SELECT export_period, 'run=' || r AS run, COUNT(*) AS exports
    FROM (SELECT export_period, scope, MAX(r) AS r FROM runs GROUP BY export_period, scope)
    GROUP BY export_period, r"""),
    "export_latest_run_overall": _focus("""
    SELECT DISTINCT 'run=31' AS run, CASE ConsumedUnit WHEN 'O' THEN 'scope-open' ELSE 'scope-closed' END AS export
    FROM focus"""),
    "export_settled_runs": _focus(f"""{_RUNS}
    SELECT CAST(0 AS BIGINT) AS settled_late, COUNT(DISTINCT (export_period, scope)) AS settled_now FROM runs"""),
    "export_round_trip": _exported(_focus(_DAILY_ROWS)),
    "export_declared_columns": _exported(_focus(f"""
    SELECT ChargeCategory, COUNT(*) AS "RowCount", {_sum("BilledCost", "TotalCost")}, {_COUNTS}
    FROM focus GROUP BY ChargeCategory""")),
    "export_status": f"""
    SELECT 'Billing data available' AS "Status", 'Export files were found' AS "Message", 'c' AS "Container",
        'daily-focus-cost/YYYYMMDD-YYYYMMDD/GUID/*.csv' AS "ExpectedPattern", 'Read the export' AS "NextStep",
        TIMESTAMP '{AS_OF}' AS "CheckedAt"
    UNION ALL SELECT 'No billing data available yet', 'Waiting for billing export to complete', 'c',
        'none-yet/YYYYMMDD-YYYYMMDD/GUID/*.csv', 'Read the export again once files exist', TIMESTAMP '{AS_OF}'""",
    "drop_view": """
    SELECT COUNT(*) AS row_count, TRUE AS dropped, FALSE AS dropped_again, FALSE AS still_there FROM lineitem""",
    "list_databases": "SELECT 'default' AS database_name, COUNT(*) AS row_count FROM lineitem",
    "preview_contained": "SELECT LEAST(COUNT(*), 10) AS rows_found FROM lineitem",
    "ingest_incremental": _focus(f"""
    SELECT BillingPeriodStart, COUNT(*) AS "RowCount", {_sum("BilledCost", "TotalCost")},
        {_sum("ConsumedQuantity", "TotalUsage")}
    FROM focus
    WHERE (month(BillingPeriodStart) % 2 = 0 OR day(ChargePeriodStart) <= 15)
      AND BillingPeriodStart <> date_trunc('month', TIMESTAMP '{AS_OF}')
    GROUP BY BillingPeriodStart"""),
    "ingest_versions": _focus(f"""
    , loaded AS (SELECT unnest(range(1, 4))::INTEGER AS version, * FROM focus)
    SELECT version, BillingPeriodStart, COUNT(*) AS "RowCount", {_sum("BilledCost", "TotalCost")},
        {_sum("ConsumedQuantity", "TotalUsage")}
    FROM loaded
    WHERE ((version > 1 AND month(BillingPeriodStart) % 2 = 0) OR day(ChargePeriodStart) <= 15)
      AND (version < 3 OR BillingPeriodStart <> date_trunc('month', TIMESTAMP '{AS_OF}'))
    GROUP BY version, BillingPeriodStart"""),
    "rollup_versions": _focus(f"""
    , loaded AS (SELECT unnest(range(1, 4))::INTEGER AS version, * FROM focus)
    SELECT version, {_CUSTOMER}, {_sum("BilledCost", "TotalCost")}, {_sum("EffectiveCost", "EffectiveCost")},
        {_distinct("ServiceName", "ServicesUsed")}, {_distinct("ResourceId", "ResourceCount")}
    FROM loaded
    WHERE ((version > 1 AND month(BillingPeriodStart) % 2 = 0) OR day(ChargePeriodStart) <= 15)
      AND (version < 3 OR BillingPeriodStart <> date_trunc('month', TIMESTAMP '{AS_OF}'))
      AND BillingPeriodStart >= TIMESTAMP '{AS_OF}' - INTERVAL 150 DAY
    GROUP BY version, SubAccountName, SubAccountId"""),
    "distinct_over_days": _focus("""
    SELECT BillingPeriodStart, COUNT(DISTINCT ResourceId) AS "ResourceCount", COUNT(DISTINCT SubAccountId) AS "CustomerCount"
    FROM focus GROUP BY BillingPeriodStart"""),
    "export_multiline": _focus("""
    SELECT BillingPeriodStart, ResourceId, BilledCost, ServiceName,
        CASE WHEN ChargeCategory = 'A' THEN '{"owner": "' || ServiceName || '",' || chr(10) || chr(10)
            || ' "id": "' || ResourceId || '"}' || chr(10) ELSE Tags END AS Tags
    FROM focus"""),
    "ingested_month_over_month": _exported(_MONTH_OVER_MONTH),
    "export_month_to_date": _focus(f"""
    SELECT ChargePeriodStart, SubAccountId, ServiceName, ChargeCategory,
        CAST(SUM(BilledCost) AS DECIMAL(18,6)) AS BilledCost,
        CAST(SUM(ConsumedQuantity) AS DECIMAL(18,6)) AS ConsumedQuantity
    FROM focus
    WHERE ChargePeriodStart >= date_trunc('month', TIMESTAMP '{AS_OF}')
      AND CAST(ChargePeriodStart AS DATE) <= CAST(TIMESTAMP '{AS_OF}' AS DATE)
    GROUP BY ChargePeriodStart, SubAccountId, ServiceName, ChargeCategory"""),
    "export_flat_legacy": _MONTHLY_TREND,
    "typed_table": _MONTH_TOTALS,
    "typed_table_month_over_month": _MONTH_OVER_MONTH,
    "ingest_exports": _exported(_MONTH_TOTALS),
    "row_count": 'SELECT COUNT(*) AS row_count FROM lineitem',
    "health_report": """
    SELECT 'database_exists' AS check_name, TRUE AS ok, CAST(NULL AS BIGINT) AS row_count
    UNION ALL SELECT 'view_exists', TRUE, NULL
    UNION ALL SELECT 'view_has_rows', COUNT(*) > 0, COUNT(*) FROM lineitem""",
}

# Reports on rollups of the ingested exports equal the same reports on the exports' charges.
ROLLED_UP = (
    "cost_by_customer", "focus_daily_trend", "focus_daily_trend_short", "focus_daily_trend_charge",
    "cost_by_service_category", "top10_customers", "cost_by_region", "customer_deep_dive",
    "discount_analysis", "month_over_month", "untagged_resources", "commitment_utilization",
    "customer_summary", "customer_trend", "service_breakdown",
)
ORACLE |= {f"rollup_{name}": _exported(ORACLE[name]) for name in ROLLED_UP}
ORACLE["typed_table_customer_deep_dive"] = ORACLE["customer_deep_dive"]
ORACLE["export_complete_runs"] = _focus(f"""
    SELECT BillingPeriodStart, COUNT(*) AS "RowCount", {_sum("BilledCost", "TotalCost")},
        {_sum("ConsumedQuantity", "TotalUsage")}
    FROM focus WHERE month(BillingPeriodStart) % 2 = 0 OR day(ChargePeriodStart) <= 15
    GROUP BY BillingPeriodStart""")
