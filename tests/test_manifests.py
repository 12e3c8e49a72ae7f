"""Half a run is passed over without a waiting time."""

import json
import time

from pyspark.sql import functions as F

from costlens.sources.exports import latest_runs, list_export_files, read_runs
from costlens.sources.manifests import complete_only, publish_runs
from costlens.streaming.ingest import ingest_exports
from costlens.streaming.version_log import read_version
from tests.helpers import put_csv

JAN, FEB = "20240101-20240131", "20240201-20240229"
HEADER = ["ResourceId", "BilledCost", "BillingPeriodStart"]


def put(lake, month, run, part, ids, age=0):
    rows = [[i, "1", f"2024-{month[4:6]}-01"] for i in ids]
    return put_csv(lake / "e" / month / run / f"{part}.csv", HEADER, rows, age=age)


def ids(spark, lake):
    runs = latest_runs(complete_only(list_export_files(spark, str(lake)))).collect()
    return sorted(r["ResourceId"] for r in read_runs(spark, runs).collect())


def test_only_complete_runs_are_read(spark, tmp_path):
    put(tmp_path, JAN, "r1", "a", ["old"], age=9_000)
    put(tmp_path, FEB, "r[1]", "a", ["feb"], age=9_000)  # a name that is a pattern
    assert ids(spark, tmp_path) == []  # no manifest at all
    assert publish_runs(spark, str(tmp_path)) == 2
    assert publish_runs(spark, str(tmp_path)) == 0  # those that exist stay
    # half a run whose files are old enough for any waiting time
    part = put(tmp_path, JAN, "r2", "a", ["new-a"], age=7_000)
    assert ids(spark, tmp_path) == ["feb", "old"]
    manifest = part.parent / "manifest.json"
    size = part.stat().st_size
    other = "new-b"
    for text in ("", "no json", "{}", '{"blobCount": 2}'):
        manifest.write_text(text)
        assert ids(spark, tmp_path) == ["feb", "old"]
    whole = put(tmp_path, JAN, "elsewhere", "b", [other], age=8_000).stat().st_size
    manifest.write_text(json.dumps({"blobCount": 2, "byteCount": size + whole, "dataRowCount": 2}))
    assert ids(spark, tmp_path) == ["feb", "old"]  # one part of two
    second = put(tmp_path, JAN, "r2", "b", [other], age=7_000)
    assert ids(spark, tmp_path) == ["feb", "new-a", "new-b"]
    second.write_text(second.read_text() + "more")  # still being written
    assert ids(spark, tmp_path) == ["feb", "old"]


def test_flat_folders_and_empty_ones(spark, tmp_path):
    put_csv(tmp_path / "flat" / "p.csv", HEADER, [["x", "1", "2024-01-01"]])
    assert ids(spark, tmp_path) == ["x"]
    (tmp_path / "none").mkdir()
    assert ids(spark, tmp_path / "none") == []


def test_ingest_waits_for_the_manifest(spark, tmp_path):
    lake, table = tmp_path / "lake", str(tmp_path / "t")

    def load():
        places = str(lake), table, str(tmp_path / "c")
        ingest_exports(spark, *places, versioned=True, manifests=True).awaitTermination()
        return sorted(r["ResourceId"] for r in read_version(spark, table).select(F.col("ResourceId")).collect())

    put(lake, JAN, "r1", "a", ["old"])
    publish_runs(spark, str(lake))
    assert load() == ["old"]
    time.sleep(0.02)
    put(lake, JAN, "r2", "a", ["new-a"])
    assert load() == ["old"]
    put(lake, JAN, "r2", "b", ["new-b"])
    publish_runs(spark, str(lake))
    assert load() == ["new-a", "new-b"]
    time.sleep(0.02)
    put(lake, JAN, "r3", "a", ["last"])
    assert load() == ["new-a", "new-b"]
    publish_runs(spark, str(lake))
    assert load() == ["last"]  # no new part arrived, only the manifest
