"""Rows that lie by month already are written where they are; a shuffle of the star carries narrow rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from costlens.sources import tables
from costlens.sources.exports import list_export_files, read_export
from costlens.sources.normalize import normalize
from costlens.sources.star import focus_rows
from costlens.sources.tables import read_table, write_mtd_history, write_table
from costlens.streaming.ingest import refresh_periods
from costlens.streaming.version_log import read_version
from tests.helpers import put_csv

MONTHS = 20
SHOWN = ["BillingPeriodStart", "ChargePeriodStart", "ResourceId", "BilledCost"]


@pytest.fixture
def deals(monkeypatch, spark):
    """Ways in which rows were dealt out for a write."""
    frame, seen = type(spark.range(0)), []
    for name in ("hint", "repartition", "repartitionByRange"):
        real = getattr(frame, name)
        monkeypatch.setattr(frame, name, lambda self, *a, _n=name, _r=real: seen.append(_n) or _r(self, *a))
    return seen


def rows_of(df):
    return sorted(map(str, df.select(*SHOWN).collect()))


def charges(spark):
    n = F.col("id")
    # the first month has most rows; some have no cost
    month = F.when(n % 3 > 0, 0).otherwise(n % MONTHS).cast("int")
    start = F.add_months(F.lit("2023-01-01").cast("date"), month).cast("timestamp")
    day = F.timestamp_add("DAY", (n % 28).cast("int"), start)
    return spark.range(0, 6000, 1, 4).select(
        start.alias("BillingPeriodStart"),
        day.alias("ChargePeriodStart"),
        F.concat(F.lit("/res/"), n % 70).alias("ResourceId"),
        F.when(n % 11 > 0, n % 90).cast("decimal(18,6)").alias("BilledCost"),
    )


@pytest.mark.parametrize("tasks", [1, 5])
def test_runs_of_dealt_rows_are_not_shuffled(spark, tmp_path, deals, tasks):
    rows = charges(spark).coalesce(tasks)
    write_mtd_history(rows, str(tmp_path / "plain"), "daily", 15)
    assert deals == ["hint"]
    write_mtd_history(rows, str(tmp_path / "dealt"), "daily", 15, dealt=True)
    assert deals == ["hint"]
    want = rows_of(rows.where("dayofmonth(ChargePeriodStart) <= 15"))
    for name in ("plain", "dealt"):
        assert rows_of(normalize(read_export(spark, str(tmp_path / name)))) == want
    files = list_export_files(spark, str(tmp_path / "dealt"))
    assert files.select("run_path").distinct().count() == MONTHS
    # a file a task and month, though a task has more months than it writes side by side
    assert tables.MONTHS_AT_ONCE < MONTHS
    assert files.count() <= tasks * MONTHS


def test_dealt_tables_are_not_shuffled(spark, tmp_path, deals):
    rows = charges(spark).coalesce(3)
    write_table(rows, str(tmp_path / "t"), dealt=True)
    assert deals == []
    assert rows_of(read_table(spark, str(tmp_path / "t"))) == rows_of(rows)
    # a month that comes again replaces its rows only
    again = rows.where("BillingPeriodStart = '2023-03-01'").limit(7)
    kept = rows.where("BillingPeriodStart <> '2023-03-01'")
    write_table(again, str(tmp_path / "t"), dealt=True)
    assert rows_of(read_table(spark, str(tmp_path / "t"))) == sorted(rows_of(again) + rows_of(kept))


@pytest.mark.parametrize("versioned", [False, True])
def test_ingest_writes_rows_where_it_reads_them(spark, tmp_path, deals, versioned):
    lake, table = tmp_path / "lake", str(tmp_path / "table")
    for scope in ("one", "two"):
        for month in ("01", "02", "03"):
            run = lake / scope / f"2024{month}01-2024{month}28" / "run-1"
            for part in ("a", "b"):
                some = [[f"/res/{part}{i}", f"2024-{month}-02", f"2024-{month}-01", i or ""] for i in range(40)]
                header = ["ResourceId", "ChargePeriodStart", "BillingPeriodStart", "BilledCost"]
                gz = scope == "two"
                put_csv(run / f"part_{part}.csv{'.gz' * gz}", header, some, gz=gz)
    touched = list_export_files(spark, str(lake))
    del deals[:]
    refresh_periods(touched, table, versioned=versioned)
    assert deals == []
    found = read_version(spark, table) if versioned else read_table(spark, table, ingested=True)
    assert rows_of(found) == rows_of(normalize(read_export(spark, [str(lake / "one"), str(lake / "two")])))
    assert found.count() == 2 * 3 * 2 * 40


def test_star_rows_are_dealt_before_columns_are_derived(spark, tmp_path):
    day = datetime(2024, 1, 1)
    items = [
        (i, i % 7, i % 3, i % 5, 1.0 * i, 2.5 * i, 0.09, 0.02, "A", "F", None if i == 4 else day + timedelta(i))
        for i in range(90)
    ]
    schema = (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    )
    spark.createDataFrame(items, schema).write.parquet(str(tmp_path / "lineitem.parquet"))
    columns = ["BillingPeriodStart", "ChargePeriodStart", "ResourceId", "ListCost", "EffectiveCost", "BilledCost"]
    plain = focus_rows(spark, str(tmp_path), columns)
    dealt = focus_rows(spark, str(tmp_path), columns, dealt_by="BillingPeriodStart")
    assert dealt.columns == plain.columns and dealt.dtypes == plain.dtypes
    assert sorted(map(str, dealt.collect())) == sorted(map(str, plain.collect()))
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("RebalancePartitions", 1)
    assert "BilledCost" in above and "BilledCost" not in below and "l_suppkey" not in below.split("Relation")[0]
    # a filter on days is still the scan's
    some = dealt.where("ChargePeriodStart >= timestamp'2024-02-01'")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_shipdate" in some.split("RebalancePartitions", 1)[1].split("Filter", 1)[1]
