"""The exports' source is written by the tasks that join it, and read period by period."""

import glob
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from costlens.sources import tables
from costlens.sources.exports import list_export_files, read_export
from costlens.sources.normalize import normalize
from costlens.sources.tables import read_by_period, read_table, write_mtd_history, write_table
from tests.helpers import plan_of

MONTHS = 40


def charges(spark):
    """Rows of all months in every task; some are undated, some have no cost."""
    n = F.col("id")
    start = F.add_months(F.lit("2021-01-01").cast("date"), (n % MONTHS).cast("int")).cast("timestamp")
    start = F.when(n % 97 > 0, start)
    return spark.range(0, 8000, 1, 4).select(
        start.alias("BillingPeriodStart"),
        F.timestamp_add("DAY", (F.floor(n / MONTHS) % 28).cast("int"), start).alias("ChargePeriodStart"),
        F.concat(F.lit("/res/"), n % 70).alias("ResourceId"),
        F.when(n % 11 > 0, n % 90 / 8).cast("decimal(18,6)").alias("BilledCost"),
    )


def rows_of(df):
    shown = ["BillingPeriodStart", "ChargePeriodStart", "ResourceId", "BilledCost"]
    return sorted(map(str, df.select(*shown).collect()))


@pytest.mark.parametrize("read_bytes", [2**25, 2**12])
def test_a_period_after_the_other(spark, tmp_path, monkeypatch, read_bytes):
    monkeypatch.setattr(tables, "READ_BYTES", read_bytes)
    rows, path = charges(spark), str(tmp_path / "t")
    write_table(rows, path, gather=True)
    found = read_by_period(spark, path)
    assert rows_of(found) == rows_of(read_table(spark, path)) == rows_of(rows)
    tasks = found.groupBy(F.spark_partition_id().alias("task")).agg(
        F.count_distinct(F.coalesce("BillingPeriodStart", F.lit(0).cast("timestamp"))).alias("months")
    )
    months = [r.months for r in tasks.collect()]
    assert max(months) <= tables.MONTHS_AT_ONCE < MONTHS
    assert len(months) > 3 if read_bytes == 2**25 else len(months) > 12
    # so a run has few files though every task that wrote the table met all months
    write_mtd_history(found, str(tmp_path / "lake"), "daily", 31, dealt=True)
    files = list_export_files(spark, str(tmp_path / "lake"))
    assert files.select("run_path").distinct().count() == MONTHS
    if read_bytes == 2**25:
        assert files.count() <= 2 * MONTHS
    assert rows_of(normalize(read_export(spark, str(tmp_path / "lake")))) == rows_of(rows.where("ChargePeriodStart is not null"))


def test_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "t")
    write_table(charges(spark).where("false"), path, gather=True)
    (tmp_path / "t").mkdir(exist_ok=True)
    assert read_by_period(spark, path).count() == 0


def test_the_star_is_not_shuffled_by_month(spark, sf_dir, tmp_path, monkeypatch):
    written = []
    real = tables.write_table
    monkeypatch.setattr(entry, "write_table", lambda df, *a, **k: written.append((df, k)) or real(df, *a, **k))
    found = entry._star_table(spark, sf_dir, str(tmp_path / "t"))
    ((rows, how),) = written
    assert "RebalancePartitions" not in plan_of(rows) and how == {"gather": True}
    assert rows_of(found) == rows_of(rows)


def test_amounts_are_written_as_short_as_they_are(spark, tmp_path):
    values = ["75.5", "100", "0", "-0.000001", "1200.000000", None, "-30.10"]
    rows = spark.range(len(values)).select(
        F.lit("2024-03-02").cast("timestamp").alias("ChargePeriodStart"),
        F.col("id").cast("string").alias("ResourceId"),
        F.get(F.array(*[F.lit(v) for v in values]), F.col("id").cast("int")).cast("decimal(18,6)").alias("BilledCost"),
    )
    write_mtd_history(rows, str(tmp_path / "lake"), "daily", 31)
    lines = [x for f in glob.glob(f"{tmp_path}/lake/daily/*/*/*.csv") for x in open(f).read().splitlines()]
    text = {x.split(",")[1]: x.split(",")[2] for x in lines if not x.startswith("ChargePeriodStart")}
    assert [text[str(i)] for i in range(len(values))] == ["75.5", "100", "0", "-0.000001", "1200", "", "-30.1"]
    back = {r.ResourceId: r.BilledCost for r in normalize(read_export(spark, str(tmp_path / "lake"))).collect()}
    assert [back[str(i)] for i in range(len(values))] == [v if v is None else Decimal(v) for v in values]
