"""Rollups are refreshed in portions of the charges' folders, which a shuffle knows by number."""

import os

import pytest
from pyspark.sql import functions as F

from costlens.sources.schema import EXPORT_PERIOD, EXPORT_SCOPE
from costlens.sources.tables import write_table
from costlens.streaming import rollups
from costlens.streaming.rollups import ROLLUPS, read_rollup, refresh_rollups
from costlens.streaming.version_log import KEYS, WRITE, VersionLog
from tests.helpers import plan_of
from tests.test_one_deal import charges, rows_of

FOLDER = (*KEYS, WRITE)
SCOPES = ("lake/one", "lake/a=b %41/ü #'x", "lake/one/more")


def charged(spark, table, hours):
    """A versioned table of three exports, two months each; its rows."""
    one = charges(spark, hours, n=60).cache()
    rows = one
    for scope in SCOPES[1:]:
        rows = rows.unionByName(one.withColumn(EXPORT_SCOPE, F.lit(scope)))
    log = VersionLog(spark, table)
    write_table(rows, log.data, FOLDER, mode="append")
    escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    keys = [(s, m) for s in SCOPES for m in ("20240101", "20240201")]
    log.commit(0, {(s, m): f"{EXPORT_SCOPE}={escaped(s)}/{EXPORT_PERIOD}={m}/{WRITE}=w" for s, m in keys})
    return rows


@pytest.mark.parametrize("hours", [1, 3])
@pytest.mark.parametrize("portion, writes", [(2**30, 1), (1, 6)])
def test_portions_add_up_to_the_whole(spark, tmp_path, monkeypatch, hours, portion, writes):
    table = str(tmp_path / "t")
    rows = charged(spark, table, hours)
    written = []
    real = rollups.write_table
    monkeypatch.setattr(rollups, "PORTION_BYTES", portion)
    monkeypatch.setattr(rollups, "write_table", lambda df, *a, **k: written.append(df) or real(df, *a, **k))
    refresh_rollups(spark, table)
    assert len(written) == writes * len(ROLLUPS)
    for name, rollup in ROLLUPS.items():
        log = VersionLog(spark, f"{table}/rollups/{name}")
        assert log.versions() == [1] and len(log.manifest(1)) == 6  # published at once
        found = read_rollup(spark, table, name)
        assert rows_of(found) == rows_of(rollup.partials(rows, FOLDER).select(*found.columns))
    if hours == 1:  # the one shuffle of charges has no names of folders
        dealt = [x for x in plan_of(written[0]).splitlines() if "rangepartitioning" in x]
        assert dealt and all("rangepartitioning(folder" in x for x in dealt)
        assert not any(EXPORT_SCOPE in x or WRITE in x for x in dealt)


def test_portions_are_as_large_as_allowed(spark, tmp_path, monkeypatch):
    log = VersionLog(spark, str(tmp_path / "t"))
    sizes = {"a": 40, "b": 40, "c": 90, "d": 250, "e": 10, "f": 0}
    monkeypatch.setattr(VersionLog, "size_of", lambda self, folder: sizes[folder])
    monkeypatch.setattr(rollups, "PORTION_BYTES", 100)
    assert rollups._portions(log, ["f", *"abcde"]) == [["a", "b"], ["c"], ["d"], ["e", "f"]]
    assert rollups._portions(log, []) == []


def test_size_and_values_of_a_folder(spark, tmp_path):
    charged(spark, str(tmp_path / "t"), 1)
    log = VersionLog(spark, str(tmp_path / "t"))
    for key, folder in log.manifest(1).items():
        home = f"{log.data}/{folder}"
        held = [os.path.join(home, f) for f in os.listdir(home) if not f.endswith(".crc")]
        assert log.size_of(folder) == sum(map(os.path.getsize, held)) > 0
        assert log.values_of(folder) == [*key, "w"]


def test_bloom_filters_are_as_large_as_their_values_need(spark, tmp_path):
    n = F.col("id")
    rows = spark.range(0, 2000, 1, 1).select(
        F.lit("2024-01-01").cast("timestamp").alias("BillingPeriodStart"), F.concat(F.lit("customer "), n % 40).alias("SubAccountId")
    )
    write_table(rows, str(tmp_path / "t"), cluster_by=("SubAccountId",))
    files = [*(tmp_path / "t").rglob("*.parquet")]
    assert files and all(f.stat().st_size < 20_000 for f in files)  # 120 KB each when they were made for 100,000
    assert spark.read.parquet(str(tmp_path / "t")).where("SubAccountId = 'customer 7'").count() == 50
