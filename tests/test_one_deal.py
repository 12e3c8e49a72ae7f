"""Charges of which few meet are dealt once for a rollup's sums and for its clusters."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from costlens.sources.schema import CANONICAL_SCHEMA, EXPORT_PERIOD, EXPORT_SCOPE
from costlens.sources.tables import write_table
from costlens.streaming.rollups import ROLLUPS, read_rollup, refresh_rollups
from costlens.streaming.version_log import WRITE, VersionLog

FOLDER = (EXPORT_SCOPE, EXPORT_PERIOD, WRITE)


def charges(spark, hours, n=600):
    """``n`` resources of one large customer, some small ones and none, each charged ``hours`` times."""
    i, month = F.col("id"), F.col("id") % 2
    rows = spark.range(0, n, 1, 3).select("*", F.explode(F.sequence(F.lit(1), F.lit(hours))).alias("hour"))
    start = F.add_months(F.lit("2024-01-01").cast("date"), month.cast("int")).cast("timestamp")
    own = {
        "BillingPeriodStart": start,
        "ChargePeriodStart": F.timestamp_add("DAY", (i % 20).cast("int"), start),
        "SubAccountId": F.when(i % 10 < 7, "s-1").when(i % 10 < 9, F.concat(F.lit("s-"), i % 30)),
        "ResourceId": F.when(i % 13 > 0, F.concat(F.lit("/res/"), i)),
        "ServiceName": F.concat(F.lit("service "), i),
        "Tags": F.when(i % 3 == 0, "{}").when(i % 3 == 1, '{"a": 1}'),
        "ListCost": F.when(i % 5 > 0, i),
        "EffectiveCost": F.when(F.col("hour") % 2 > 0, i + F.col("hour")),
        "BilledCost": i,
    }
    typed = [own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in CANONICAL_SCHEMA]
    period = F.concat(F.lit("20240"), month + 1, F.lit("01"))
    return rows.select(*typed, F.lit("lake/one").alias(EXPORT_SCOPE), period.alias(EXPORT_PERIOD), F.lit("w").alias(WRITE))


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("name", ROLLUPS)
def test_sums_of_dealt_rows_need_no_other_shuffle(spark, tmp_path, name):
    charges(spark, 3).write.parquet(str(tmp_path / "rows"))
    rollup, rows = ROLLUPS[name], spark.read.parquet(str(tmp_path / "rows"))
    plain = rollup.partials(rows, FOLDER)
    dealt = rollup.partials(rows, FOLDER, dealt_by=(*FOLDER, "SubAccountId"))
    assert dealt.columns == plain.columns and dealt.dtypes == plain.dtypes
    assert rows_of(dealt) == rows_of(plain)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan


def test_a_group_with_many_charges_is_added_up_before_the_shuffle(spark):
    resources = ROLLUPS["resources"]
    assert resources.few_meet(charges(spark, 1), FOLDER)
    assert not resources.few_meet(charges(spark, 3), FOLDER)
    hot = charges(spark, 1).unionByName(charges(spark, 900, n=1))
    assert not resources.few_meet(hot, FOLDER)


@pytest.mark.parametrize("hours", [1, 3])
def test_refreshed_rollups(spark, tmp_path, monkeypatch, hours):
    rows, table = charges(spark, hours), str(tmp_path / "table")
    log = VersionLog(spark, table)
    write_table(rows, log.data, FOLDER, mode="append")
    months = {("lake/one", m): f"{EXPORT_SCOPE}=lake%2Fone/{EXPORT_PERIOD}={m}/{WRITE}=w" for m in ("20240101", "20240201")}
    log.commit(0, months)
    frame, aggregates = type(rows), []
    real = frame.repartitionByRange
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(frame, "repartitionByRange", lambda df, *a: aggregates.append("Aggregate" in plan(df)) or real(df, *a))
    refresh_rollups(spark, table)
    assert aggregates == [hours > 1] * len(ROLLUPS)  # whether the only deal is of charges or of their sums
    for name, rollup in ROLLUPS.items():
        found = read_rollup(spark, table, name)
        want = rollup.partials(rows, FOLDER).select(*found.columns)
        assert rows_of(found) == rows_of(want)
        for file in (tmp_path / "table" / "rollups" / name / "data").rglob("*.parquet"):
            group = pq.ParquetFile(file).metadata.row_group(0)
            assert {group.column(c).compression for c in range(group.num_columns)} == {"ZSTD"}
            customers = pq.read_table(file, columns=["SubAccountId"], partitioning=None)["SubAccountId"].to_pylist()
            assert customers == sorted(customers, key=lambda x: (x is not None, x))
