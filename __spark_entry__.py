"""

Queries derive billing rows from the given star tables (``costlens.sources.star``)
and report as of one fixed moment.  Reports over a trailing window hand its lower
bound to the scan, where a billing table would prune its period partitions; the
report applies its own predicate all the same.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from datetime import date, datetime, timedelta
from functools import cache
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import Column, DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from costlens.functions.columns import MONEY, money, total  # noqa: E402
from costlens.operators.dataset import DATASETS, as_dataset  # noqa: E402
from costlens.operators import distinct  # noqa: E402
from costlens.operators.dedup import latest_snapshot  # noqa: E402
from costlens.plans import focus_reports as focus  # noqa: E402
from costlens.plans import usage_reports as usage  # noqa: E402
from costlens.scratch import drop_dir, scratch_dir  # noqa: E402
from costlens.sources import views  # noqa: E402
from costlens.sources.exports import (  # noqa: E402
    CSV_OPTIONS,
    export_status,
    latest_runs,
    list_export_files,
    read_export,
    read_runs,
)
from costlens.sources.manifests import complete_only, publish_runs  # noqa: E402
from costlens.sources.normalize import declared, normalize  # noqa: E402
from costlens.sources.schema import FOCUS_COLUMNS  # noqa: E402
from costlens.sources.star import (  # noqa: E402
    FOCUS_STAR_COLUMNS,
    focus_rows,
    legacy_rows,
    legacy_text,
    narrow_rows,
    widened,
)
from costlens.sources.tables import (  # noqa: E402
    read_by_period,
    read_table,
    to_daily,
    write_mtd_export,
    write_mtd_history,
    write_table,
)
from costlens.streaming.ingest import ingest_exports  # noqa: E402
from costlens.streaming.rollups import ROLLUPS, read_rollup  # noqa: E402
from costlens.streaming.version_log import read_version  # noqa: E402
from oracle_queries import AS_OF, ORACLE, TENANT  # noqa: E402

Query = Callable[[SparkSession, str], DataFrame]

_MOMENT = datetime.fromisoformat(AS_OF)
_LAST_30 = str(_MOMENT - timedelta(days=30))
_THIS_MONTH = _MOMENT.replace(day=1)
_LAST_MONTH = str((_THIS_MONTH - timedelta(days=1)).replace(day=1))
_NEXT_MONTH = str((_THIS_MONTH + timedelta(days=32)).replace(day=1))

PERIOD = "BillingPeriodStart"
CUSTOMER = ["SubAccountId", "SubAccountName"]
SERVICE = ["ServiceCategory", "ServiceName"]
COSTS = ["BilledCost", "EffectiveCost"]
RUN_DAYS = (15, 31)


# -- reports ---------------------------------------------------------------


def _focus_report(report, columns, *args, window=(_LAST_30, None), **kwargs) -> Query:
    """A report over the open vocabulary, on exactly the columns it reads."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return report(focus_rows(spark, sf_dir, columns, *window), *args, as_of=AS_OF, **kwargs)

    return query


def _usage_report(report, columns, window=(None, None), **kwargs) -> Query:
    """A report over the provider-specific vocabulary."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return report(legacy_rows(spark, sf_dir, columns, *window), **kwargs)

    return query


OPEN_IN_LEGACY = [
    "date",
    "ResourceId",
    "costInBillingCurrency",
    "billingCurrency",
    "SubscriptionId",
    "subscriptionName",
    "consumedService",
    "billingPeriodStartDate",
]


def _on_legacy(report) -> Query:
    """A report over the open vocabulary on an export of the provider-specific one."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = legacy_text(spark, sf_dir, OPEN_IN_LEGACY)
        return report(normalize(text, fill=False), as_of=AS_OF)

    return query


def _with_ids(columns, **kwargs) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = legacy_rows(spark, sf_dir, columns).where(F.col("ResourceId").isNotNull())
        return usage.unused_resources(rows, **kwargs)

    return query


def _summary_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalize(focus_rows(spark, sf_dir, None, _LAST_30))
    return focus.billing_summary_view(rows, AS_OF)


def _reports() -> dict[str, Query]:
    by_service = [PERIOD, *SERVICE, "BilledCost", "SubAccountId", "ResourceId"]
    summary = [PERIOD, *CUSTOMER, *COSTS, "ServiceName", "ResourceId"]
    trend = [PERIOD, *COSTS, "SubAccountId", "ResourceId"]
    dated_cost = ["date", "costInUsd"]
    group = ["resourceGroupName"]
    family = ["serviceFamily"]
    return {
        "billing_summary": _usage_report(
            usage.billing_summary, [*dated_cost, *group, *family], (_LAST_30, None), as_of=AS_OF
        ),
        "daily_costs": _usage_report(
            usage.daily_costs, [*dated_cost, "ResourceId"], (_LAST_30, None), as_of=AS_OF
        ),
        "top_resources": _usage_report(
            usage.top_resources, ["costInUsd", "ResourceId", *group, *family]
        ),
        "cost_by_location": _usage_report(
            usage.cost_by_location, ["costInUsd", "resourceLocation", *group, *family]
        ),
        "monthly_trend": _usage_report(usage.monthly_trend, dated_cost),
        "daily_cost_history": _usage_report(usage.daily_cost_history, [*dated_cost, "ResourceId"]),
        "top10_resources": _usage_report(
            usage.top10_resources, ["costInUsd", "ResourceId", *group]
        ),
        "unused_resources": _usage_report(
            usage.unused_resources, [*dated_cost, "ResourceId", *group], as_of=AS_OF
        ),
        "unused_resources_prefiltered": _usage_report(
            usage.unused_resources, [*dated_cost, "ResourceId", *group], as_of=AS_OF, prefilter=True
        ),
        "unused_resources_null_aware": _usage_report(
            usage.unused_resources,
            [*dated_cost, "ResourceId", *group],
            as_of=AS_OF,
            null_aware=True,
        ),
        "unused_resources_null_aware_kept": _with_ids(
            [*dated_cost, "ResourceId", *group], as_of=AS_OF, null_aware=True
        ),
        "unused_resources_fold_case": _usage_report(
            usage.unused_resources, [*dated_cost, "ResourceId", *group], as_of=AS_OF, fold_case=True
        ),
        "department_chargeback": _usage_report(
            usage.department_chargeback, [*dated_cost, *group]
        ),
        "billing_summary_view": _summary_view,
        "cost_by_customer": _focus_report(
            focus.cost_by_customer, [PERIOD, *CUSTOMER, *COSTS, "BillingCurrency", "ResourceId"]
        ),
        "focus_daily_trend": _focus_report(focus.daily_trend, trend),
        "focus_daily_trend_short": _focus_report(
            focus.daily_trend_short, [PERIOD, "BilledCost", "SubAccountId"]
        ),
        "focus_daily_trend_charge": _focus_report(
            focus.daily_trend, ["ChargePeriodStart", *trend], date_col="ChargePeriodStart"
        ),
        "cost_by_service_category": _focus_report(focus.cost_by_service_category, by_service),
        "cost_by_service_category_by_currency": _focus_report(
            focus.cost_by_service_category, [*by_service, "BillingCurrency"], by_currency=True
        ),
        "cost_by_service_category_fold_case": _focus_report(
            focus.cost_by_service_category, by_service, fold_case=True
        ),
        "top10_customers": _focus_report(focus.top10_customers, summary),
        "cost_by_region": _focus_report(
            focus.cost_by_region,
            [PERIOD, "RegionName", "BilledCost", "SubAccountId", "ResourceId"],
        ),
        "customer_deep_dive": _focus_report(
            focus.customer_deep_dive,
            [
                PERIOD,
                *SERVICE,
                "SubAccountId",
                "ResourceName",
                "ResourceType",
                "RegionName",
                "ConsumedUnit",
                "ConsumedQuantity",
                "BilledCost",
            ],
            TENANT,
        ),
        "discount_analysis": _focus_report(
            focus.discount_analysis,
            [PERIOD, "SubAccountName", "ListCost", "ContractedCost", "EffectiveCost"],
        ),
        "month_over_month": _focus_report(
            focus.month_over_month,
            [PERIOD, "SubAccountName", "BilledCost"],
            window=(_LAST_MONTH, _NEXT_MONTH),
        ),
        "untagged_resources": _focus_report(
            focus.untagged_resources,
            [PERIOD, "SubAccountName", "ResourceId", "ResourceName", "ServiceName", "Tags", "BilledCost"],
        ),
        "commitment_utilization": _focus_report(
            focus.commitment_utilization,
            [PERIOD, "CommitmentDiscountId", "ChargeCategory", "PricingCategory", "SubAccountId", *COSTS],
        ),
        "customer_summary": _focus_report(focus.customer_summary, summary),
        "customer_trend": _focus_report(
            focus.customer_trend, [PERIOD, "SubAccountId", "ServiceName", "BilledCost"], TENANT
        ),
        "customer_trend_fold_case": _focus_report(
            focus.customer_trend,
            [PERIOD, "SubAccountId", "ServiceName", "BilledCost"],
            TENANT,
            fold_case=True,
        ),
        "legacy_cost_by_customer": _on_legacy(focus.cost_by_customer),
        "legacy_month_over_month": _on_legacy(focus.month_over_month),
        "service_breakdown": _focus_report(
            focus.service_breakdown, [PERIOD, *SERVICE, "BilledCost", "SubAccountId"]
        ),
    }


# -- operators on rows -------------------------------------------------------


def _dataset(name: str) -> Query:
    columns = ["ServiceCategory", "ChargeCategory", DATASETS[name], "ListCost"]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return (
            as_dataset(focus_rows(spark, sf_dir, columns), name)
            .groupBy("ServiceCategory", "ChargeCategory")
            .agg(total("Amount").alias("TotalAmount"), F.count("*").alias("RowCount"))
        )

    return query


DAILY = [
    "ChargePeriodStart",
    "SubAccountId",
    "ServiceName",
    "ChargeCategory",
    "BilledCost",
    "ConsumedQuantity",
]


def _daily_granularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each charge as two hourly rows, with its end and its date text."""
    rows = focus_rows(spark, sf_dir, DAILY)
    hour = F.explode(F.array(F.lit(3), F.lit(17))).alias("hour")
    hourly = rows.select("*", hour)
    start = F.col("ChargePeriodStart") + F.make_dt_interval(hours=F.col("hour"))
    # the first hour has a tenth of the charge
    part = lambda c: F.when(F.col("hour") == 3, tenth(c)).otherwise(F.col(c) - tenth(c)).cast(MONEY).alias(c)
    tenth = lambda c: (F.col(c) * F.lit(0.1).cast("decimal(2,1)")).cast(MONEY)
    return to_daily(
        hourly.select(
            start.alias("ChargePeriodStart"),
            (start + F.expr("INTERVAL 1 HOUR")).alias("ChargePeriodEnd"),
            F.date_format(start, "yyyy-MM-dd HH:mm").alias("date_raw"),
            *[c for c in DAILY[1:] if c not in ("BilledCost", "ConsumedQuantity")],
            part("BilledCost"),
            part("ConsumedQuantity"),
        )
    )


def _latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative snapshots of two exports as rows: each run repeats the month up to its
    day, and in odd months the open one's last run is missing."""
    rows = focus_rows(
        spark,
        sf_dir,
        [PERIOD, "ChargePeriodStart", "ResourceId", "SubAccountId", "BilledCost", "ConsumedUnit"],
    ).withColumnRenamed("ConsumedUnit", "export_scope")
    run_days = F.array(*[F.lit(d) for d in (7, 14, 21, 31)])
    last = F.when((F.col("export_scope") == "O") & (F.month(PERIOD) % 2 == 1), 21).otherwise(31)
    covers = F.filter(run_days, lambda d: (F.dayofmonth("ChargePeriodStart") <= d) & (d <= last))
    return latest_snapshot(rows.withColumn("run_day", F.explode(covers)), "run_day")


def _preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.preview(focus_rows(spark, sf_dir, [PERIOD, "ResourceId", *COSTS]))


# Columns of the charges themselves: a count needs no dimension.
COUNTED = [PERIOD, "ChargePeriodStart", "ResourceId", "BilledCost", "ConsumedQuantity", "Tags"]


def _row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.row_count(views.publish_view(focus_rows(spark, sf_dir, COUNTED), "counted_data"))


def _health_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    views.publish_view(focus_rows(spark, sf_dir, COUNTED), "billing_data")
    return views.health_report(spark, "billing_data")


# -- exports and tables --------------------------------------------------------


def _star_table(spark: SparkSession, sf_dir: str, path: str, used: Column | None = None) -> DataFrame:
    """The star (or the charges of it that are used) written as a typed table, its rows read month by month.

    The table is for the runs written from it; it is dropped once they are.
    """
    rows = narrow_rows(spark, sf_dir, used)
    write_table(rows, path, gather=True)
    return widened(read_by_period(spark, path, schema=rows.schema))


def _even_or_early() -> Column:
    """Charges of runs of day 15, and of later runs of even months."""
    return (F.dayofmonth("ChargePeriodStart") <= 15) | (F.month(PERIOD) % 2 == 0)


@cache
def _exports(spark: SparkSession, sf_dir: str) -> tuple[str, ...]:
    """The star as cumulative CSV exports of two scopes, one plain and one compressed."""
    root = scratch_dir(spark, "exports")
    rows = _star_table(spark, sf_dir, f"{root}/source")
    is_open = F.col("ConsumedUnit").eqNullSafe("O")
    scopes = {"scope-closed": (~is_open, "none"), "scope-open": (is_open, "gzip")}
    for run_day in RUN_DAYS:
        for scope, (belongs, compression) in scopes.items():
            if scope == "scope-open" and run_day == RUN_DAYS[-1]:
                # in odd months this export's last run is missing
                belongs = belongs & (F.month(PERIOD) % 2 == 0)
            write_mtd_history(
                rows.filter(belongs),
                f"{root}/{scope}",
                "daily-focus-cost",
                run_day,
                compression=compression,
                dealt=True,
            )
    drop_dir(spark, f"{root}/source")
    return tuple(f"{root}/{scope}" for scope in scopes)


def prepare_exports(spark: SparkSession, sf_dir: str) -> None:
    """Write the exports that the export queries read, unless this session has them."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    _exports(spark, sf_dir)


def _export_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exports_by_run(list_export_files(spark, _exports(spark, sf_dir)))


def _exports_by_run(files: DataFrame) -> DataFrame:
    return files.groupBy("export_period", "run").agg(F.count_distinct("export_scope").alias("exports"))


def _export_latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = latest_runs(list_export_files(spark, _exports(spark, sf_dir), "daily-focus-cost"))
    return _exports_by_run(runs)


def _export_latest_run_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one newest run of each export, whatever its period."""
    runs = latest_runs(list_export_files(spark, _exports(spark, sf_dir)), mode="global")
    return runs.select("run", F.element_at(F.split("export_scope", "/"), -2).alias("export"))


def _export_settled_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No run counts as settled when a thousand days must have passed."""
    files = list_export_files(spark, _exports(spark, sf_dir))
    waiting = latest_runs(files, settle_seconds=86_400_000).agg(F.count("*").alias("settled_late"))
    return waiting.crossJoin(latest_runs(files, settle_seconds=0).agg(F.count("*").alias("settled_now")))


def _export_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize(read_export(spark, _exports(spark, sf_dir))).select(
        PERIOD,
        "ChargePeriodStart",
        *CUSTOMER,
        "ServiceName",
        "ResourceId",
        "ResourceName",
        "RegionName",
        *COSTS,
        "ListCost",
        "ConsumedQuantity",
        "ChargeCategory",
        "Tags",
    )


def _export_declared_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        declared(read_export(spark, _exports(spark, sf_dir)))
        .groupBy("ChargeCategory")
        .agg(
            F.count("*").alias("RowCount"),
            total(money("BilledCost")).alias("TotalCost"),
            *[F.count(c).alias(f"n_{c}") for c in FOCUS_COLUMNS],
        )
    )


def _export_month_to_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_dir(spark, "month-to-date")
    rows = focus_rows(spark, sf_dir, DAILY, _THIS_MONTH.isoformat(), _NEXT_MONTH)
    write_mtd_export(rows, root, "daily", date.fromisoformat(AS_OF[:10]), "run-a")
    return normalize(read_export(spark, root, "daily")).select(*DAILY)


def _export_flat_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "flat")
    text = legacy_text(spark, sf_dir)
    text.write.options(**CSV_OPTIONS).csv(folder)
    return usage.monthly_trend(normalize(read_export(spark, folder)))


def _month_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy(PERIOD).agg(
        F.count("*").alias("RowCount"),
        total("BilledCost").alias("TotalCost"),
        total("ConsumedQuantity").alias("TotalUsage"),
    )


def _typed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "table")
    write_table(focus_rows(spark, sf_dir, FOCUS_STAR_COLUMNS), path)
    return _month_totals(read_table(spark, path))


def _typed_table_month_over_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "table")
    write_table(focus_rows(spark, sf_dir, FOCUS_STAR_COLUMNS), path)
    return focus.month_over_month(read_table(spark, path), AS_OF)


def _clustered_customer_deep_dive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-16 on a table whose files are clustered by customer."""
    path = scratch_dir(spark, "clustered")
    write_table(focus_rows(spark, sf_dir, FOCUS_STAR_COLUMNS), path, cluster_by=("SubAccountId",))
    return focus.customer_deep_dive(read_table(spark, path), TENANT, AS_OF)


def _ingest_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _exports(spark, sf_dir)[0].rsplit("/", 1)[0]
    work = scratch_dir(spark, "ingest")
    ingest_exports(spark, root, f"{work}/table", f"{work}/checkpoint").awaitTermination()
    return _month_totals(read_table(spark, f"{work}/table", ingested=True))


def _ingested_month_over_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _exports(spark, sf_dir)[0].rsplit("/", 1)[0]
    work = scratch_dir(spark, "ingest")
    ingest_exports(spark, root, f"{work}/table", f"{work}/checkpoint").awaitTermination()
    since = date.fromisoformat(_LAST_MONTH[:10])
    return focus.month_over_month(read_table(spark, f"{work}/table", ingested=True, since=since), AS_OF)


def _ingest_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first load, a newer run of even months, then a run that empties one month."""
    work = scratch_dir(spark, "incremental")
    lake, table, checkpoint = (f"{work}/{x}" for x in ("lake", "table", "checkpoint"))
    rows = _star_table(spark, sf_dir, f"{work}/source", _even_or_early())

    def ingest() -> None:
        ingest_exports(spark, lake, table, checkpoint).awaitTermination()

    write_mtd_history(rows, lake, "daily", 15, dealt=True)
    ingest()
    write_mtd_history(rows.filter(F.month(PERIOD) % 2 == 0), lake, "daily", 31, dealt=True)
    drop_dir(spark, f"{work}/source")
    ingest()
    month = f"{_THIS_MONTH:%Y%m%d}-{_THIS_MONTH:%Y%m}31"
    header = spark.createDataFrame([FOCUS_STAR_COLUMNS], ", ".join(f"`{c}` string" for c in FOCUS_STAR_COLUMNS))
    header.coalesce(1).write.csv(f"{lake}/daily/daterange={month}/run=99")
    ingest()
    return _month_totals(read_table(spark, table, ingested=True))


def _ingest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps of ``ingest_incremental``, each published at once; all three versions stay readable."""
    work = scratch_dir(spark, "versions")
    lake, table, checkpoint = (f"{work}/{x}" for x in ("lake", "table", "checkpoint"))
    rows = _star_table(spark, sf_dir, f"{work}/source", _even_or_early())

    def ingest() -> DataFrame:
        ingest_exports(spark, lake, table, checkpoint, versioned=True).awaitTermination()
        return read_version(spark, table)

    write_mtd_history(rows, lake, "daily", 15, dealt=True)
    versions = [ingest()]
    write_mtd_history(rows.filter(F.month(PERIOD) % 2 == 0), lake, "daily", 31, dealt=True)
    drop_dir(spark, f"{work}/source")
    versions.append(ingest())
    month = f"{_THIS_MONTH:%Y%m%d}-{_THIS_MONTH:%Y%m}31"
    header = spark.createDataFrame([FOCUS_STAR_COLUMNS], ", ".join(f"`{c}` string" for c in FOCUS_STAR_COLUMNS))
    header.coalesce(1).write.csv(f"{lake}/daily/daterange={month}/run=99")
    versions.append(ingest())
    shown = [_month_totals(v).withColumn("version", F.lit(i)) for i, v in enumerate(versions, 1)]
    return shown[0].union(shown[1]).union(shown[2])


@cache
def _rolled_up(spark: SparkSession, sf_dir: str) -> str:
    """The exports as a versioned table with its rollups."""
    root = _exports(spark, sf_dir)[0].rsplit("/", 1)[0]
    work = scratch_dir(spark, "rollups")
    places = root, f"{work}/table", f"{work}/checkpoint"
    ingest_exports(spark, *places, versioned=True, rollups=ROLLUPS).awaitTermination()
    return places[1]


def _on_rollup(report, name: str, *args, **kwargs) -> Query:
    """A report answered from maintained partial sums; no charges are read."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return report(read_rollup(spark, _rolled_up(spark, sf_dir), name), *args, as_of=AS_OF, **kwargs)

    return query


def _rollup_reports() -> dict[str, Query]:
    """By the name of the same report on charges, ``rollup_`` before it."""
    return {
        "rollup_cost_by_customer": _on_rollup(focus.cost_by_customer, "resources"),
        "rollup_focus_daily_trend": _on_rollup(focus.daily_trend, "resources"),
        "rollup_focus_daily_trend_short": _on_rollup(focus.daily_trend_short, "customers"),
        "rollup_focus_daily_trend_charge": _on_rollup(focus.daily_trend, "days", date_col="ChargePeriodStart"),
        "rollup_cost_by_service_category": _on_rollup(focus.cost_by_service_category, "resources"),
        "rollup_top10_customers": _on_rollup(focus.top10_customers, "resources"),
        "rollup_cost_by_region": _on_rollup(focus.cost_by_region, "resources"),
        "rollup_customer_deep_dive": _on_rollup(focus.customer_deep_dive, "resources", TENANT),
        "rollup_discount_analysis": _on_rollup(focus.discount_analysis, "customers"),
        "rollup_month_over_month": _on_rollup(focus.month_over_month, "customers"),
        "rollup_untagged_resources": _on_rollup(focus.untagged_resources, "resources"),
        "rollup_commitment_utilization": _on_rollup(focus.commitment_utilization, "customers"),
        "rollup_customer_summary": _on_rollup(focus.customer_summary, "resources"),
        "rollup_customer_trend": _on_rollup(focus.customer_trend, "customers", TENANT),
        "rollup_service_breakdown": _on_rollup(focus.service_breakdown, "customers"),
    }


def _rollup_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-21 from the rollup after the three steps of ``ingest_versions``."""
    work = scratch_dir(spark, "rollups")
    lake, table, checkpoint = (f"{work}/{x}" for x in ("lake", "table", "checkpoint"))
    rows = _star_table(spark, sf_dir, f"{work}/source", _even_or_early())

    def ingest() -> DataFrame:
        names = ["resources"]
        ingest_exports(spark, lake, table, checkpoint, versioned=True, rollups=names).awaitTermination()
        return focus.customer_summary(read_rollup(spark, table, "resources"), AS_OF, days_back=150)

    write_mtd_history(rows, lake, "daily", 15, dealt=True)
    reports = [ingest()]
    write_mtd_history(rows.filter(F.month(PERIOD) % 2 == 0), lake, "daily", 31, dealt=True)
    drop_dir(spark, f"{work}/source")
    reports.append(ingest())
    month = f"{_THIS_MONTH:%Y%m%d}-{_THIS_MONTH:%Y%m}31"
    header = spark.createDataFrame([FOCUS_STAR_COLUMNS], ", ".join(f"`{c}` string" for c in FOCUS_STAR_COLUMNS))
    header.coalesce(1).write.csv(f"{lake}/daily/daterange={month}/run=99")
    reports.append(ingest())
    shown = [r.withColumn("version", F.lit(i)) for i, r in enumerate(reports, 1)]
    return shown[0].union(shown[1]).union(shown[2])


def _export_multiline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of several lines with doubled quotes, in plain and compressed parts."""
    root = scratch_dir(spark, "multiline")
    shown = [PERIOD, "ResourceId", "BilledCost", "ServiceName", "Tags"]
    rows = focus_rows(spark, sf_dir, [*shown, "ChargePeriodStart", "ChargeCategory", "ConsumedUnit"])
    tags = F.concat(F.lit('{"owner": "'), "ServiceName", F.lit('",\n\n "id": "'), "ResourceId", F.lit('"}\n'))
    rows = rows.withColumn("Tags", F.when(F.col("ChargeCategory") == "A", tags).otherwise(F.col("Tags")))
    is_open = F.col("ConsumedUnit").eqNullSafe("O")
    for scope, belongs, compression in (("plain", ~is_open, "none"), ("packed", is_open, "gzip")):
        write_mtd_history(rows.filter(belongs), f"{root}/{scope}", "daily", 31, compression=compression)
    lake = [f"{root}/plain", f"{root}/packed"]
    return normalize(read_export(spark, lake, "daily", multi_line=True)).select(*shown)


def _distinct_over_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resources and customers a month, from bitmaps of days; nothing but bitmaps is read for the month."""
    work = scratch_dir(spark, "distinct")
    rows = focus_rows(spark, sf_dir, [PERIOD, "ChargePeriodStart", "ResourceId", "SubAccountId"])
    counts = []
    for column, name in (("ResourceId", "ResourceCount"), ("SubAccountId", "CustomerCount")):
        distinct.numbered(rows, column).write.parquet(f"{work}/{column}")
        known = spark.read.parquet(f"{work}/{column}")
        daily = distinct.bitmaps(rows, [PERIOD, "ChargePeriodStart"], column, known)
        daily.write.parquet(f"{work}/{column}-days")
        counts.append(distinct.counted(spark.read.parquet(f"{work}/{column}-days"), [PERIOD], name))
    return counts[0].join(counts[1], PERIOD)


def _export_complete_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newer runs of odd months lack their manifests; the complete ones before them are read."""
    root, source = scratch_dir(spark, "complete"), scratch_dir(spark, "complete-source")
    rows = _star_table(spark, sf_dir, source)
    even = F.month(PERIOD) % 2 == 0
    write_mtd_history(rows, root, "daily", 15, dealt=True)
    write_mtd_history(rows.filter(even), root, "daily", 31, dealt=True)
    publish_runs(spark, root)
    write_mtd_history(rows.filter(~even), root, "daily", 31, dealt=True)
    drop_dir(spark, source)
    runs = latest_runs(complete_only(list_export_files(spark, root, "daily"))).collect()
    return _month_totals(normalize(read_runs(spark, runs), fill=False))


def _export_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export with files, and one that still waits for its first."""
    delivered = _exports(spark, sf_dir)[0]
    rows = [export_status(spark, delivered, "c", name, AS_OF) for name in ("daily-focus-cost", "none-yet")]
    return rows[0].union(rows[1]).select("Status", "Message", "Container", "ExpectedPattern", "NextStep", "CheckedAt")


def _drop_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    views.publish_view(focus_rows(spark, sf_dir, COUNTED), "passing_data")
    counted = views.row_count(spark.table("passing_data")).first()["row_count"]
    dropped = [views.drop_view(spark, "passing_data") for _ in range(2)]
    return spark.createDataFrame(
        [(counted, *dropped, spark.catalog.tableExists("passing_data"))],
        "row_count bigint, dropped boolean, dropped_again boolean, still_there boolean",
    )


def _list_databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default database is listed, with the charges a view in it has."""
    count = views.row_count(focus_rows(spark, sf_dir, COUNTED))
    return views.list_databases(spark).where("database_name = 'default'").crossJoin(count)


def _preview_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rows, each of which is in the source."""
    rows = focus_rows(spark, sf_dir, [PERIOD, "ResourceId", *COSTS])
    shown = views.preview(rows)
    found = shown.join(rows.distinct(), [PERIOD, "ResourceId", *COSTS], "left_semi")
    return found.agg(F.count("*").alias("rows_found"))


# -- contract --------------------------------------------------------------------


def _in_utc(query: Query) -> Query:
    """Billing days are UTC days."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, sf_dir)

    return run


def _corpus() -> tuple[dict[str, Query], dict[str, str]]:
    """Queries and SQL of the corpus operators; none where that subpackage is absent."""
    try:
        import corpus_pipeline
        from costlens.llm.queries import ORACLE_SQL, QUERIES
    except ImportError as missing:
        # the subpackage, or a package that only it needs
        if (missing.name or "").startswith(("pyspark", "costlens.")) and not missing.name.startswith("costlens.llm"):
            raise
        return {}, {}
    sql = {**ORACLE_SQL, "pipeline": corpus_pipeline.ORACLE_SQL}
    return {**QUERIES, "pipeline": corpus_pipeline.run}, {k: v for k, v in sql.items() if v}


def billing_queries() -> dict[str, Query]:
    """Every report, operator, source and sink as name -> f(spark, sf_dir)."""
    registered = {
        **_reports(),
        "dataset_actual_cost": _dataset("ActualCost"),
        "dataset_amortized_cost": _dataset("AmortizedCost"),
        "dataset_usage": _dataset("Usage"),
        "daily_granularity": _daily_granularity,
        "latest_snapshot": _latest_snapshot,
        "preview": _preview,
        "row_count": _row_count,
        "health_report": _health_report,
        "export_files": _export_files,
        "export_latest_runs": _export_latest_runs,
        "export_round_trip": _export_round_trip,
        "export_declared_columns": _export_declared_columns,
        "export_month_to_date": _export_month_to_date,
        "export_flat_legacy": _export_flat_legacy,
        "typed_table": _typed_table,
        "typed_table_month_over_month": _typed_table_month_over_month,
        "typed_table_customer_deep_dive": _clustered_customer_deep_dive,
        "ingest_exports": _ingest_exports,
        "ingest_incremental": _ingest_incremental,
        "ingest_versions": _ingest_versions,
        **_rollup_reports(),
        "rollup_versions": _rollup_versions,
        "distinct_over_days": _distinct_over_days,
        "export_multiline": _export_multiline,
        "ingested_month_over_month": _ingested_month_over_month,
        "export_latest_run_overall": _export_latest_run_overall,
        "export_settled_runs": _export_settled_runs,
        "export_complete_runs": _export_complete_runs,
        "export_status": _export_status,
        "drop_view": _drop_view,
        "list_databases": _list_databases,
        "preview_contained": _preview_contained,
    }
    return {name: _in_utc(query) for name, query in registered.items()}


def queries() -> dict[str, Query]:
    """All registered queries, those on text corpora included."""
    return {**billing_queries(), **_corpus()[0]}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name, wherever SQL can express the query."""
    return {**ORACLE, **_corpus()[1]}


def entry(spark: SparkSession) -> DataFrame:
    """Which customers cost most."""
    return queries()["top10_customers"](spark, "/root/testdata/sf0.001")
