"""Writers, tables, views and incremental ingest."""

import glob
import re
from datetime import date, datetime, timedelta, timezone
from decimal import Decimal

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from costlens.plans import focus_reports as focus
from costlens.scratch import scratch_dir
from costlens.sources import views
from costlens.sources.exports import list_export_files, read_export
from costlens.sources.normalize import normalize
from costlens.sources.star import FOCUS_STAR_COLUMNS, focus_rows
from costlens.sources.tables import (
    read_table,
    to_daily,
    write_mtd_export,
    write_mtd_history,
    write_table,
)
from costlens.streaming.ingest import ingest_exports, refresh_periods
from tests.helpers import physical, put_csv

COLUMNS = ["ResourceId", "BillingPeriodStart", "ChargePeriodStart", "BilledCost", "Tags"]
HEADER = ["ResourceId", "BilledCost", "ChargePeriodStart", "BillingPeriodStart"]


def charges(spark, *rows):
    schema = ", ".join(f"{c} string" for c in COLUMNS)
    return normalize(spark.createDataFrame([tuple(r) for r in rows], schema), fill=False).drop("date_raw")


ROWS = [
    ("a", "2024-09-01", "2024-09-02 08:00:00", "1", '{"k":"v, \\"w\\""}'),
    ("a", "2024-09-01", "2024-09-02 09:00:00", "2", '{"k":"v, \\"w\\""}'),
    ("b", "2024-09-01", "2024-09-10", "4", ""),
    ("b", "2024-09-01", "2024-09-11", "8", None),
    ("c", "2024-08-01", "2024-08-31", "16", None),
    ("d", "2024-10-01", "2024-10-01", "32", None),
]


def as_set(df):
    return sorted(
        (r["ResourceId"], str(r["ChargePeriodStart"])[:10], float(r["BilledCost"]), r["Tags"] or "-")
        for r in df.collect()
    )


def test_days_are_added_up(spark):
    daily = to_daily(charges(spark, *ROWS))
    assert daily.count() == 5
    assert daily.filter("ResourceId = 'a'").first()["BilledCost"] == Decimal(3)
    assert daily.schema == charges(spark, *ROWS).schema


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_month_to_date_round_trip(spark, tmp_path, compression):
    df = charges(spark, *ROWS)
    folder = write_mtd_export(df, str(tmp_path), "exp", date(2024, 9, 10), "r1", compression=compression)
    assert folder.endswith("/exp/20240901-20240930/r1")
    back = normalize(read_export(spark, str(tmp_path), "exp"))
    assert as_set(back) == [
        ("a", "2024-09-02", 3.0, '{"k":"v, \\"w\\""}'),
        ("b", "2024-09-10", 4.0, "-"),
    ]
    assert back.filter("ResourceId = 'b'").first()["Tags"] == ""
    # The next day's run holds the month again; only it is read.
    write_mtd_export(df, str(tmp_path), "exp", date(2024, 9, 11), "r0", compression=compression)
    assert len(as_set(normalize(read_export(spark, str(tmp_path), "exp")))) == 3
    # Writing a run again replaces it.
    write_mtd_export(df, str(tmp_path), "exp", date(2024, 9, 11), "r0", compression=compression)
    assert read_export(spark, str(tmp_path), "exp").count() == 3


def test_december_ends_with_the_year(spark, tmp_path):
    folder = write_mtd_export(charges(spark, *ROWS), str(tmp_path), "e", date(2024, 12, 3), "r")
    assert "/20241201-20241231/" in folder


def test_parts_hold_a_bounded_number_of_records(spark, tmp_path):
    folder = write_mtd_export(
        charges(spark, *ROWS), str(tmp_path), "e", date(2024, 9, 30), "r", max_records_per_file=1
    )
    assert len(glob.glob(f"{folder}/*.csv")) == 3


def test_snapshots_deduplicate_to_the_original(spark, sf_dir, tmp_path):
    rows = focus_rows(spark, sf_dir, FOCUS_STAR_COLUMNS)
    for run_day in (10, 31):
        write_mtd_history(rows, str(tmp_path), "exp", run_day)
    listed = list_export_files(spark, str(tmp_path), "exp")
    months = rows.select("BillingPeriodStart").distinct().count()
    assert listed.select("export_period").distinct().count() == months
    back = normalize(read_export(spark, str(tmp_path), "exp"))
    compare = ["BillingPeriodStart", "SubAccountName", "ResourceId", "BilledCost", "Tags"]
    assert back.count() == rows.count()
    assert back.select(*compare).exceptAll(rows.select(*compare)).count() == 0


def test_table_prunes_periods_and_replaces_only_its_own(spark, tmp_path):
    path = str(tmp_path / "t")
    write_table(charges(spark, *ROWS), path)
    table = read_table(spark, path)
    assert table.count() == 6 and "x_SkuTier" in table.columns
    recent = focus.cost_by_region(table, "2024-10-15")
    plan = physical(recent)
    assert "BillingPeriodStart" in plan.split("PartitionFilters: [")[1].split("]")[0]
    write_table(charges(spark, ("z", "2024-09-01", "2024-09-05", "1", None)), path)
    got = {r["ResourceId"] for r in read_table(spark, path).collect()}
    assert got == {"z", "c", "d"}


def test_views_and_checks(spark):
    df = charges(spark, *ROWS)
    assert views.publish_view(df, "billing").count() == 6
    views.publish_view(df.limit(0), "billing")
    report = {r["check_name"]: (r["ok"], r["row_count"]) for r in views.health_report(spark, "billing").collect()}
    assert report == {
        "database_exists": (True, None),
        "view_exists": (True, None),
        "view_has_rows": (False, 0),
    }
    assert views.drop_view(spark, "billing") and not views.drop_view(spark, "billing")
    gone = {r["check_name"]: r["ok"] for r in views.health_report(spark, "billing", "nowhere").collect()}
    assert gone == {"database_exists": False, "view_exists": False}
    assert "default" in [r[0] for r in views.list_databases(spark).collect()]
    assert views.preview(df, 2).count() == 2


def test_a_check_does_not_hide_a_broken_view(spark, tmp_path):
    put_csv(tmp_path / "x.csv", ["a"], [["x"]])
    broken = spark.read.csv(str(tmp_path / "x.csv"), header=True).select(F.raise_error(F.lit("boom")).alias("a"))
    broken.filter("a IS NULL").createOrReplaceTempView("broken")
    with pytest.raises(Exception, match="boom"):
        views.health_report(spark, "broken").collect()


def test_scratch_follows_the_cluster_setting(spark):
    first, second = scratch_dir(spark, "x"), scratch_dir(spark, "x")
    assert first != second and first.startswith(spark.conf.get("spark.checkpoint.dir"))


# -- ingest ---------------------------------------------------------------------------

SEP, OCT = "20240901-20240930", "20241001-20241031"


def put(folder, *names, part=0, age=0, month="09"):
    rows = [[n, "1", f"2024-{month}-02", f"2024-{month}-01"] for n in names]
    return put_csv(folder / f"part_{part}.csv", HEADER, rows, age=age)


@pytest.fixture
def lake(spark, tmp_path):
    root = tmp_path / "lake"
    root.mkdir()

    def ingest():
        ingest_exports(
            spark, str(root), str(tmp_path / "table"), str(tmp_path / "checkpoint")
        ).awaitTermination()
        table = read_table(spark, str(tmp_path / "table"), ingested=True)
        return sorted(r["ResourceId"] for r in table.collect())

    return root, ingest


def test_ingest_follows_the_newest_run(spark, lake):
    root, ingest = lake
    put(root / "e" / SEP / "r1", "a", age=500)
    put(root / "e" / OCT / "r1", "o", age=500, month="10")
    assert ingest() == ["a", "o"]
    # A newer cumulative run corrects its month and leaves the other alone.
    put(root / "e" / SEP / "r2", "a2", "b", age=300)
    assert ingest() == ["a2", "b", "o"]
    # More parts of the same run may arrive later.
    put(root / "e" / SEP / "r2", "c", part=1, age=200)
    assert ingest() == ["a2", "b", "c", "o"]
    # An older run that shows up late changes nothing.
    put(root / "e" / SEP / "r0", "stale", age=400)
    assert ingest() == ["a2", "b", "c", "o"]
    # Nothing new, nothing changes.
    assert ingest() == ["a2", "b", "c", "o"]


def test_ingest_keeps_scopes_apart(spark, lake):
    root, ingest = lake
    put(root / "s1" / "e" / SEP / "r1", "a")
    put(root / "s2" / "e" / SEP / "r1", "b")
    assert ingest() == ["a", "b"]
    put(root / "s2" / "e" / SEP / "r2", "c")
    assert ingest() == ["a", "c"]


def test_a_newest_run_without_rows_empties_its_month(spark, lake):
    root, ingest = lake
    put(root / "s 1" / SEP / "r1", "a", age=100)
    put(root / "s 1" / OCT / "r1", "b", age=100, month="10")
    put(root / "s 2" / SEP / "r1", "c", age=100)
    assert ingest() == ["a", "b", "c"]
    put(root / "s 1" / SEP / "r2")
    assert ingest() == ["b", "c"]
    put(root / "s 1" / SEP / "r3", "d")
    assert ingest() == ["b", "c", "d"]


def test_a_wide_header_alone_empties_its_month_too(spark, lake):
    root, ingest = lake
    put(root / "e" / SEP / "r1", "a", age=100)
    assert ingest() == ["a"]
    wide = [*HEADER, *[f"a_long_column_name_number_{i}" for i in range(400)]]
    put_csv(root / "e" / SEP / "r2" / "part_0.csv", wide, [])
    assert ingest() == []


def test_a_half_written_run_waits(spark, tmp_path):
    root, table = tmp_path / "lake", str(tmp_path / "table")

    def ingest(as_of):
        ingest_exports(
            spark, str(root), table, str(tmp_path / "checkpoint"), settle_seconds=600, as_of=as_of
        ).awaitTermination()
        return sorted(r["ResourceId"] for r in read_table(spark, table, ingested=True).collect())

    now = datetime.now(timezone.utc).replace(tzinfo=None)
    put(root / "e" / SEP / "r1", "a", "b", age=3600)
    assert ingest(now) == ["a", "b"]
    put(root / "e" / SEP / "r2", "half")
    assert ingest(now) == ["a", "b"]
    # No new file arrives, yet the run is taken once it has settled.
    assert ingest(now + timedelta(hours=1)) == ["half"]
    assert ingest(now + timedelta(hours=1)) == ["half"]


def test_files_overwritten_in_place(spark, lake):
    root, ingest = lake
    put(root / "flat", "a", age=100)
    assert ingest() == ["a"]
    put(root / "flat", "a", "b")
    assert ingest() == ["a", "b"]
    put(root / "flat", "c", age=-100)
    assert ingest() == ["c"]


def test_an_ingested_table_prunes(spark, lake, tmp_path):
    root, ingest = lake
    put(root / "e" / SEP / "r1", "a")
    put(root / "e" / OCT / "r1", "b", month="10")
    put(root / "flat", "f")
    ingest()
    recent = read_table(spark, str(tmp_path / "table"), ingested=True, since=date(2024, 10, 1))
    assert sorted(r["ResourceId"] for r in recent.collect()) == ["b", "f"]
    filters = re.search(r"PartitionFilters: \[(.*?)\]", physical(recent))[1]
    assert "export_period" in filters


def test_charge_days_have_statistics(spark, tmp_path):
    write_table(charges(spark, *ROWS), str(tmp_path / "t"))
    for file in (tmp_path / "t").rglob("*.parquet"):
        group = pq.ParquetFile(file).metadata.row_group(0)
        column = next(
            group.column(i) for i in range(group.num_columns) if group.column(i).path_in_schema == "ChargePeriodStart"
        )
        assert column.is_stats_set and column.statistics.has_min_max


def test_hourly_rows_of_all_columns_become_daily(spark):
    hours = [
        {"ResourceId": "a", "ChargePeriodStart": f"2024-09-02T{h:02}:00:00Z", "BilledCost": "1",
         "ChargePeriodEnd": f"2024-09-0{2 + (h + 1) // 24}T{(h + 1) % 24:02}:00:00Z", "x_PartnerCreditApplied": "True"}
        for h in range(24)
    ]
    text = spark.createDataFrame(hours, ", ".join(f"{k} string" for k in hours[0]))
    daily = to_daily(normalize(text))
    (one,) = daily.collect()
    assert len(daily.columns) >= 96 and one["BilledCost"] == 24 and one["x_PartnerCreditApplied"] == "True"
    assert (str(one["ChargePeriodStart"]), str(one["ChargePeriodEnd"])) == ("2024-09-02 00:00:00", "2024-09-03 00:00:00")
    assert one["date_raw"] == "2024-09-02"


def test_first_ingest_of_an_empty_run(spark, lake):
    root, ingest = lake
    put(root / "e" / SEP / "r1")
    assert ingest() == []


def test_ingest_of_flat_folders(spark, lake):
    root, ingest = lake
    put(root / "flat", "a")
    put(root / "flat" / SEP / "r1", "b")
    assert ingest() == ["a", "b"]


def test_repeating_a_batch_gives_the_same_table(spark, tmp_path):
    root, table = tmp_path / "lake", str(tmp_path / "table")
    put(root / "e" / SEP / "r1", "a", "b")
    arrivals = list_export_files(spark, str(root))
    for _ in range(2):
        refresh_periods(arrivals, table)
        assert read_table(spark, table, ingested=True).count() == 2
