"""A search for one customer reads a small share of a clustered table."""

from glob import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from costlens.plans import focus_reports as focus
from costlens.sources.tables import read_table, write_table

AS_OF = "2024-02-20"
CUSTOMERS = 50


@pytest.fixture(scope="module")
def rows(spark):
    n = F.col("id")
    # every third row is customer 0's; the others are dealt out by a hash, so a file's order says nothing
    customer = F.when(n % 3 == 0, 0).otherwise(F.pmod(F.xxhash64("id"), F.lit(CUSTOMERS)))
    return spark.range(0, 60_000, 1, 8).select(
        F.concat(F.lit("customer-"), customer).alias("SubAccountId"),
        F.concat(F.lit("name "), customer).alias("SubAccountName"),
        F.to_timestamp(F.concat(F.lit("2024-0"), n % 2 + 1, F.lit("-01"))).alias("BillingPeriodStart"),
        F.timestamp_seconds(1_706_745_600 + n * 40).alias("ChargePeriodStart"),
        F.concat(F.lit("/res/"), F.xxhash64("id") % 5000).alias("ResourceId"),
        F.concat(F.lit("r "), F.xxhash64("id") % 5000).alias("ResourceName"),
        F.lit("disk").alias("ServiceName"),
        (n % 1000).cast("decimal(18,6)").alias("BilledCost"),
        F.lit(1).cast("decimal(18,6)").alias("ConsumedQuantity"),
    )


@pytest.fixture(scope="module")
def tables(spark, rows, tmp_path_factory):
    """The same rows, by the day only and by customer, both in many small files."""
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k", "spark.sql.shuffle.partitions": "48"}
    before = {key: spark.conf.get(key) for key in small}
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        folders = [str(tmp_path_factory.mktemp(x)) + "/t" for x in ("plain", "clustered")]
        write_table(rows, folders[0])
        write_table(rows, folders[1], cluster_by=("SubAccountId",))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return folders


def read_by(df):
    """Rows that the scan gave to the filter."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()


def test_other_customers_are_skipped(spark, rows, tables):
    total = rows.count()
    for customer in ("customer-7", "customer-49"):
        wanted = F.col("SubAccountId") == customer
        own = rows.where(wanted).count()
        plain, clustered = (read_by(read_table(spark, t).where(wanted).select("ResourceId")) for t in tables)
        assert plain == total  # without clustering every row group holds every customer
        assert own <= clustered <= total // 10
    assert read_by(read_table(spark, tables[1]).where("SubAccountId = 'nobody'").select("ResourceId")) == 0


def test_a_hot_customer_is_many_files(tables):
    files = glob(f"{tables[1]}/*/*.parquet")
    holding = sum("customer-0" in pq.read_table(f, columns=["SubAccountId"])[0].to_pylist() for f in files)
    assert holding >= 4 and len(files) > holding


def test_reports_are_the_same(spark, rows, tables):
    for customer in ("customer-0", "customer-7", "nobody"):
        for report in (focus.customer_deep_dive, focus.customer_trend):
            want, *got = (
                sorted(map(str, report(t, customer, as_of=AS_OF).collect()))
                for t in (read_table(spark, tables[0]), read_table(spark, tables[1]))
            )
            assert got == [want]
    everything = read_table(spark, tables[1]).select(*rows.columns)
    assert everything.exceptAll(rows).isEmpty() and everything.count() == rows.count()


def test_files_follow_tasks_and_periods(spark, rows, tmp_path):
    """Many periods don't get a file, and its Bloom filter, from every task."""
    many = rows.withColumn("BillingPeriodStart", F.to_timestamp(F.concat(F.lit("20"), 10 + F.pmod(F.xxhash64("ResourceId"), F.lit(40)), F.lit("-01-01"))))
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "100k")
    try:
        write_table(many, f"{tmp_path}/t", cluster_by=("SubAccountId",))
    finally:
        spark.conf.set(key, before)
    assert len(glob(f"{tmp_path}/t/*/*.parquet")) <= 40 + int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert read_table(spark, f"{tmp_path}/t").count() == rows.count()
