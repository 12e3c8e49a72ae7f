"""What must hold when a key holds a third of the rows and nothing fits a broadcast."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from costlens.plans import focus_reports as focus
from costlens.settings import TASK_BYTES, settings_for
from costlens.sources.tables import read_table, write_table
from tests.helpers import physical


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize(
    "name",
    ["top10_customers", "cost_by_region", "unused_resources", "unused_resources_null_aware", "month_over_month"],
)
def test_same_rows_when_every_join_shuffles(spark, sf_dir, no_broadcast, name):
    shuffled = driver.queries()[name](spark, sf_dir)
    plan = physical(shuffled)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and "Cartesian" not in plan
    got = rows_of(shuffled)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    assert got == rows_of(driver.queries()[name](spark, sf_dir))


def skewed(spark, n=30_000):
    """One customer holds a third of the charges and one month nearly all of them."""
    i = F.col("id")
    return spark.range(n).select(
        F.when(i % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), (i % 500).cast("string"))).alias("SubAccountId"),
        F.when(i % 3 == 0, "hot").otherwise("other").alias("SubAccountName"),
        F.concat(F.lit("s"), (i % 7).cast("string")).alias("ServiceName"),
        F.concat(F.lit("/r/"), (i % 1009).cast("string")).alias("ResourceId"),
        F.when(i % 100 == 0, F.lit("2024-09-01")).otherwise("2024-10-01").cast("timestamp").alias("BillingPeriodStart"),
        (F.col("id") % 97).cast("decimal(18,6)").alias("BilledCost"),
        F.lit(1).cast("decimal(18,6)").alias("EffectiveCost"),
    )


def test_hot_customer_against_plain_python(spark):
    df = skewed(spark)
    cost, services, resources = defaultdict(int), defaultdict(set), defaultdict(set)
    for i in range(30_000):
        if i % 100:
            key = "hot" if i % 3 == 0 else f"c{i % 500}"
            cost[key] += i % 97
            services[key].add(i % 7)
            resources[key].add(i % 1009)
    got = {r["CustomerTenantId"]: r for r in focus.customer_summary(df, "2024-10-15").collect()}
    assert set(got) == set(cost)
    for key, r in got.items():
        assert (int(r["TotalCost"]), r["ServicesUsed"], r["ResourceCount"]) == (
            cost[key],
            len(services[key]),
            len(resources[key]),
        )


def test_rows_are_combined_before_the_shuffle(spark):
    plan = physical(focus.customer_summary(skewed(spark), "2024-10-15"))
    assert "Window" not in plan
    below = plan[plan.rindex("Exchange hashpartitioning") :]
    assert "partial_sum" in below and "HashAggregate" in below


def test_a_hot_month_is_written_by_many_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "32k")
    try:
        write_table(skewed(spark), str(tmp_path / "t"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = [len(list(p.glob("*.parquet"))) for p in sorted((tmp_path / "t").glob("Billing*"))]
    assert len(files) == 2 and files[1] > 1
    assert read_table(spark, str(tmp_path / "t")).count() == 30_000


def test_settings_follow_the_data():
    small, large = settings_for(40_000_000, 8), settings_for(100 * 10**12, 4000)
    assert int(small["spark.sql.shuffle.partitions"]) == 16
    # 100 TB: map tasks times partitions stays below 10 ** 10 shuffle blocks
    maps = 100 * 10**12 // int(large["spark.sql.files.maxPartitionBytes"])
    assert 8000 <= int(large["spark.sql.shuffle.partitions"]) and maps * int(large["spark.sql.shuffle.partitions"]) < 10**10
    whole = settings_for(10**12, 400, shuffled_bytes=10**12)
    assert int(whole["spark.sql.shuffle.partitions"]) * TASK_BYTES >= 10**12
    assert int(large["spark.sql.files.maxPartitionBytes"]) == TASK_BYTES
