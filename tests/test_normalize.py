"""Both vocabularies to one typed table."""

from datetime import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from costlens.functions.columns import dated, day_between, trailing, trailing_days
from costlens.sources.normalize import normalize


def text(spark, columns, *rows):
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns))


def test_numbers(spark):
    values = ["1.5", "1E-5", "1.2345675", "", "n/a", "1,234.5", "9" * 20, None]
    df = normalize(text(spark, ["id", "costInUsd"], *[(str(i), v) for i, v in enumerate(values)]))
    got = [r[0] for r in df.select("x_BilledCostInUsd").collect()]
    assert got == [
        Decimal("1.500000"),
        Decimal("0.000010"),
        Decimal("1.234568"),
        None,
        None,
        None,
        None,
        None,
    ]


def test_dates(spark):
    values = ["2024-10-14", "2024-10-14T06:00:00Z", "10/14/2024", "bad", "", "12:30", None, "date"]
    rows = text(spark, ["date"], *[(v,) for v in values])
    midnight, six = datetime(2024, 10, 14), datetime(2024, 10, 14, 6)
    iso = [r[0] for r in normalize(rows).select("ChargePeriodStart").collect()]
    assert iso == [midnight, six, None, None, None, None, None, None]
    more = normalize(rows, date_formats=["MM/dd/yyyy", "yyyy'x'MM"])
    assert more.select("ChargePeriodStart").collect()[2][0] == midnight
    assert [r[0] for r in more.select("date_raw").collect()] == values


def test_header_rows_are_kept_unless_asked(spark):
    rows = text(spark, ["Date", "cost"], ("Date", "x"), ("2024-01-01", "1"), (None, "2"), ("bad", "3"))
    assert normalize(rows).count() == 4
    assert normalize(rows, drop_header_rows=True).count() == 3
    assert normalize(rows).filter(dated()).count() == 2


def test_aliases_ignore_case_and_merge_versions(spark):
    old = text(spark, ["DATE", "CostInUSD", "resourceGroup"], ("2024-01-01", "1", "g1"))
    new = text(
        spark, ["ChargePeriodStart", "x_BilledCostInUsd", "x_ResourceGroupName"], ("2024-01-02", "2", "g2")
    )
    both = normalize(old.unionByName(new, allowMissingColumns=True))
    got = both.select("ChargePeriodStart", "x_BilledCostInUsd", "x_ResourceGroupName").collect()
    assert [(r[0].day, int(r[1]), r[2]) for r in got] == [(1, 1, "g1"), (2, 2, "g2")]


def test_report_vocabulary_is_an_alias_too(spark):
    df = normalize(text(spark, ["Region", "UsageQuantity", "UsageUnit"], ("west", "3", "h")))
    assert df.select("RegionName", "ConsumedQuantity", "ConsumedUnit").first() == (
        "west",
        Decimal("3.000000"),
        "h",
    )
    assert df.select("ChargeType").first()[0] is None


def test_normalizing_twice_changes_nothing(spark):
    once = normalize(text(spark, ["date", "costInUsd"], ("bad", "1"), ("2024-01-01", "x")))
    assert normalize(once).collect() == once.collect()
    assert normalize(once).schema == once.schema


def test_without_fill_only_found_columns(spark):
    df = normalize(text(spark, ["date", "costInUsd", "other"], ("2024-01-01", "1", "z")), fill=False)
    assert df.columns == ["BillingPeriodStart", "ChargePeriodStart", "x_BilledCostInUsd", "date_raw"]


def moments(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "t string").select(
        F.col("t").cast("timestamp").alias("t")
    )


def kept(df, condition):
    return [str(r[0]) for r in df.filter(condition).orderBy("t").collect()]


def test_trailing_window_keeps_time_of_day_and_has_no_end(spark):
    df = moments(spark, "2024-01-01 11:59:59", "2024-01-01 12:00:00", "2030-01-01")
    assert kept(df, trailing("t", "2024-01-31 12:00:00", 30)) == [
        "2024-01-01 12:00:00",
        "2030-01-01 00:00:00",
    ]


def test_trailing_days_compares_midnights(spark):
    df = moments(spark, "2024-01-01 23:00:00", "2024-01-02 00:00:00")
    # 1 January begins before the cutoff at noon, so the whole day is out ...
    assert kept(df, trailing_days("t", "2024-01-31 12:00:00", 30)) == ["2024-01-02 00:00:00"]
    # ... and in when the cutoff is its midnight.
    assert len(kept(df, trailing_days("t", "2024-01-31", 30))) == 2


def test_day_range_includes_both_ends(spark):
    df = moments(spark, "2023-12-31 23:59:59", "2024-01-01", "2024-01-02 23:59:59", "2024-01-03")
    between = day_between("t", F.lit("2024-01-01").cast("date"), F.lit("2024-01-02").cast("date"))
    assert kept(df, between) == ["2024-01-01 00:00:00", "2024-01-02 23:59:59"]
