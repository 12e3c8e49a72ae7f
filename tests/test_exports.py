"""Finding runs and reading them by column name."""

import os
from datetime import date, datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from costlens.sources import exports
from costlens.sources.exports import (
    LISTING,
    export_status,
    latest_runs,
    list_export_files,
    read_export,
)
from costlens.sources.normalize import declared, normalize
from costlens.sources.schema import CANONICAL_SCHEMA, FOCUS_COLUMNS
from tests.helpers import plan_of, put_csv

HEADER = ["ResourceId", "BilledCost", "ChargePeriodStart"]
SEP, OCT = "20240901-20240930", "20241001-20241031"


def ids(df):
    return sorted(r["ResourceId"] for r in df.select("ResourceId").collect())


def row(name, cost="1.0", day="2024-09-02"):
    return [name, cost, day]


def test_all_parts_of_the_newest_run_and_nothing_else(spark, tmp_path):
    # The older run's id sorts after the newer one's.
    put_csv(tmp_path / "exp" / SEP / "zz" / "g1" / "part_0.csv", HEADER, [row("a")], age=100)
    put_csv(tmp_path / "exp" / SEP / "aa" / "g2" / "part_0.csv", HEADER, [row("a")])
    put_csv(tmp_path / "exp" / SEP / "aa" / "g2" / "part_1.csv", HEADER, [row("b")])
    df = read_export(spark, str(tmp_path), "exp")
    assert ids(df) == ["a", "b"]
    assert len(df.inputFiles()) == 2
    assert all("/aa/" in f for f in df.inputFiles())


def test_each_period_keeps_its_last_run_unless_global(spark, tmp_path):
    put_csv(tmp_path / "exp" / SEP / "r1" / "p.csv", HEADER, [row("a")], age=300)
    put_csv(tmp_path / "exp" / SEP / "r2" / "p.csv", HEADER, [row("a"), row("b")], age=200)
    put_csv(tmp_path / "exp" / OCT / "r3" / "p.csv", HEADER, [row("c")], age=100)
    assert ids(read_export(spark, str(tmp_path))) == ["a", "b", "c"]
    assert ids(read_export(spark, str(tmp_path), mode="global")) == ["c"]
    with pytest.raises(ValueError):
        latest_runs(list_export_files(spark, str(tmp_path)), mode="newest")


def test_runs_whose_folder_shows_another_last_day_are_one_period(spark, tmp_path):
    put_csv(tmp_path / "e" / "20240901-20240907" / "r1" / "p.csv", HEADER, [row("a")], age=50)
    put_csv(tmp_path / "e" / "20240901-20240914" / "r2" / "p.csv", HEADER, [row("a"), row("b")])
    assert ids(read_export(spark, str(tmp_path))) == ["a", "b"]


PARTS = st.lists(
    st.tuples(
        st.sampled_from(["s1", "s2"]),
        st.sampled_from(["20240901", "20241001", "current"]),
        st.sampled_from(["r1", "r2", "r3"]),
        st.integers(0, 4),
        st.integers(0, 9),
    ),
    max_size=25,
)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(parts=PARTS)
def test_selection_against_plain_python(spark, parts):
    """Any mix of scopes, periods, runs, parts and equal times."""
    start = datetime(2024, 11, 1)
    listing = [
        (f"f{i}", f"p{i}", start + timedelta(seconds=at), size, scope, period, run, f"{scope}/{period}/{run}")
        for i, (scope, period, run, at, size) in enumerate(parts)
    ]
    modified, files, size_of = {}, {}, {}
    for scope, period, run, at, size in parts:
        key = (scope, period, run)
        modified[key] = max(modified.get(key, 0), at)
        files[key] = files.get(key, 0) + 1
        size_of[key] = size_of.get(key, 0) + size
    newest, newest_overall = {}, {}
    for (scope, period, run), at in modified.items():
        entry = (at, run, f"{scope}/{period}/{run}", period)
        newest[scope, period] = max(newest.get((scope, period), entry), entry)
        newest_overall[scope] = max(newest_overall.get(scope, entry), entry)
    frame = spark.createDataFrame(listing, LISTING)
    chosen = latest_runs(frame).collect()
    assert {(r["export_scope"], r["export_period"]): r["run"] for r in chosen} == {
        k: v[1] for k, v in newest.items()
    }
    for r in chosen:
        key = (r["export_scope"], r["export_period"], r["run"])
        assert (r["files"], r["bytes"]) == (files[key], size_of[key])
    overall = latest_runs(frame, mode="global").collect()
    assert {r["export_scope"]: (r["export_period"], r["run"]) for r in overall} == {
        k: (v[3], v[1]) for k, v in newest_overall.items()
    }


def test_older_periods_can_be_left_out(spark, tmp_path):
    put_csv(tmp_path / "e" / SEP / "r" / "p.csv", HEADER, [row("a")])
    put_csv(tmp_path / "e" / OCT / "r" / "p.csv", HEADER, [row("b")])
    put_csv(tmp_path / "flat" / "p.csv", HEADER, [row("c")])
    df = read_export(spark, str(tmp_path), since=date(2024, 10, 1))
    assert ids(df) == ["b", "c"] and len(df.inputFiles()) == 2


def test_equal_times_are_decided_by_run_id(spark, tmp_path):
    for run in ("r1", "r2"):
        p = put_csv(tmp_path / "e" / SEP / run / "p.csv", HEADER, [row(run)])
        os.utime(p, (1_700_000_000, 1_700_000_000))
    assert ids(read_export(spark, str(tmp_path))) == ["r2"]


def test_a_run_still_being_written_is_passed_over(spark, tmp_path):
    put_csv(tmp_path / "e" / SEP / "r1" / "p.csv", HEADER, [row("old")], age=7200)
    put_csv(tmp_path / "e" / SEP / "r2" / "p.csv", HEADER, [row("new")])
    assert ids(read_export(spark, str(tmp_path))) == ["new"]
    assert ids(read_export(spark, str(tmp_path), settle_seconds=3600)) == ["old"]


@pytest.mark.parametrize(
    "where",
    [
        "x.csv",
        f"{SEP}/x.csv",
        f"{SEP}/run/x.csv",
        f"{SEP}/run/guid/x.csv",
        f"daterange={SEP}/run=1/x.csv",
    ],
)
def test_every_depth(spark, tmp_path, where):
    put_csv(tmp_path / "exp" / where, HEADER, [row("a"), row("b")])
    assert ids(read_export(spark, str(tmp_path), "exp")) == ["a", "b"]


def test_flat_files_beside_dated_folders_are_their_own_run(spark, tmp_path):
    put_csv(tmp_path / "exp" / "x.csv", HEADER, [row("flat")])
    put_csv(tmp_path / "exp" / SEP / "r1" / "x.csv", HEADER, [row("old")], age=9)
    put_csv(tmp_path / "exp" / SEP / "r2" / "x.csv", HEADER, [row("new")])
    assert ids(read_export(spark, str(tmp_path), "exp")) == ["flat", "new"]


def test_exports_and_roots_do_not_compete(spark, tmp_path):
    put_csv(tmp_path / "s1" / "e1" / SEP / "r1" / "x.csv", HEADER, [row("a")], age=99)
    put_csv(tmp_path / "s1" / "e2" / SEP / "r1" / "x.csv", HEADER, [row("b")], age=50)
    put_csv(tmp_path / "s2" / "e1" / SEP / "r1" / "x.csv", HEADER, [row("c")])
    roots = [str(tmp_path / "s1"), str(tmp_path / "s2"), str(tmp_path / "absent")]
    with pytest.raises(FileNotFoundError, match="absent"):
        read_export(spark, roots)
    assert ids(read_export(spark, roots, missing_ok=True)) == ["a", "b", "c"]
    assert ids(read_export(spark, roots, "e1", missing_ok=True)) == ["a", "c"]
    df = read_export(spark, roots, lineage=True, missing_ok=True)
    origin = {r["ResourceId"]: (r["export_scope"], r["export_period"]) for r in df.collect()}
    assert origin["c"][0].endswith("/s2/e1")
    assert {period for _, period in origin.values()} == {"20240901"}


def test_listing_reads_no_content(spark, tmp_path):
    put_csv(tmp_path / "exp" / SEP / "r1" / "g" / "x.csv", HEADER, [row("a")])
    files = list_export_files(spark, str(tmp_path)).collect()
    assert [(f["export_period"], f["run"]) for f in files] == [("20240901", "r1")]
    assert files[0]["run_path"].endswith(f"{SEP}/r1")


def test_columns_bind_by_name_across_layouts(spark, tmp_path):
    put_csv(tmp_path / "e" / SEP / "r" / "p.csv", HEADER, [row("a", "1.5")])
    put_csv(
        tmp_path / "e" / OCT / "r" / "p.csv",
        ["Extra", "ChargePeriodStart", "ResourceId"],
        [["x", "2024-10-02", "b"]],
    )
    got = {r["ResourceId"]: r for r in normalize(read_export(spark, str(tmp_path))).collect()}
    assert str(got["a"]["BilledCost"]) == "1.500000" and got["b"]["BilledCost"] is None
    assert got["b"]["ChargePeriodStart"].month == 10


def test_a_stray_part_fails_loudly(spark, tmp_path):
    put_csv(tmp_path / "e" / SEP / "r" / "p0.csv", HEADER, [row("a")])
    put_csv(tmp_path / "e" / SEP / "r" / "p1.csv", HEADER[::-1], [row("b")[::-1], row("c")[::-1]])
    with pytest.raises(Exception, match="CSV header does not conform"):
        read_export(spark, str(tmp_path)).collect()


def test_byte_order_mark_and_empty_part(spark, tmp_path):
    p = put_csv(tmp_path / "e" / SEP / "r" / "p0.csv", HEADER, [row("é")])
    p.write_bytes(b"\xef\xbb\xbf" + p.read_bytes())
    (tmp_path / "e" / SEP / "r" / "p1.csv").write_bytes(b"")
    assert ids(read_export(spark, str(tmp_path))) == ["é"]


def test_quoted_text_null_and_empty(spark, tmp_path):
    folder = tmp_path / "e" / SEP / "r"
    folder.mkdir(parents=True)
    (folder / "p.csv").write_text(
        'ResourceId,Tags\na,"{""env"":""a,b""}"\nb,\nc,""\nd,{}\ne,"back\\slash"\n'
    )
    got = {r["ResourceId"]: r["Tags"] for r in read_export(spark, str(tmp_path)).collect()}
    assert got == {"a": '{"env":"a,b"}', "b": None, "c": "", "d": "{}", "e": "back\\slash"}


def test_line_breaks_inside_quotes_need_multi_line(spark, tmp_path):
    put_csv(tmp_path / "e" / SEP / "r" / "p.csv", ["ResourceId", "Tags"], [["a", '{"k":\n"v"}'], ["b", "x"]])
    df = read_export(spark, str(tmp_path), multi_line=True)
    assert {r["ResourceId"]: r["Tags"] for r in df.collect()} == {"a": '{"k":\n"v"}', "b": "x"}


def test_compressed_parts(spark, tmp_path):
    put_csv(tmp_path / "e" / SEP / "r" / "p0.csv.gz", HEADER, [row("a")], gz=True)
    put_csv(tmp_path / "e" / SEP / "r" / "p1.csv", HEADER, [row("b")])
    assert ids(read_export(spark, str(tmp_path))) == ["a", "b"]


def test_runs_of_empty_parts_have_no_rows(spark, tmp_path):
    put_csv(tmp_path / "e" / SEP / "r" / "p0.csv.gz", None, [], gz=True)
    put_csv(tmp_path / "e" / OCT / "r" / "p0.csv.gz", None, [], gz=True)
    put_csv(tmp_path / "e" / OCT / "r" / "p1.csv.gz", HEADER, [row("a")], gz=True)
    assert ids(read_export(spark, str(tmp_path))) == ["a"]


def test_no_files_gives_an_empty_declared_frame(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    for root in (tmp_path / "absent", tmp_path / "empty"):
        df = read_export(spark, str(root), missing_ok=True)
        assert df.columns == list(FOCUS_COLUMNS) and df.count() == 0
        assert normalize(df).schema == CANONICAL_SCHEMA
    put_csv(tmp_path / "header" / SEP / "r" / "p.csv", HEADER, [])
    assert read_export(spark, str(tmp_path / "header")).count() == 0


def test_declared_columns_only(spark, tmp_path):
    put_csv(tmp_path / "e" / SEP / "r" / "p.csv", ["extra", "BILLEDCOST"], [["x", "2"]])
    df = declared(read_export(spark, str(tmp_path)))
    assert df.columns == list(FOCUS_COLUMNS)
    assert df.select("BilledCost", "Tags").first() == ("2", None)


def test_status_before_and_after_the_first_files(spark, tmp_path):
    waiting = export_status(spark, str(tmp_path), "costs", "exp", as_of="2024-09-03").first()
    assert waiting["Status"] == "No billing data available yet"
    assert str(waiting["CheckedAt"]) == "2024-09-03 00:00:00"
    put_csv(tmp_path / "exp" / SEP / "r" / "p.csv", HEADER, [row("a")])
    found = export_status(spark, str(tmp_path), "costs", "exp").first()
    assert found["Status"] == "Billing data available"
    assert set(found.asDict()) == {
        "Status",
        "Message",
        "StorageAccount",
        "Container",
        "ExpectedPattern",
        "NextStep",
        "CheckedAt",
    }


def test_period_of_paths_with_blanks(spark, tmp_path):
    put_csv(tmp_path / "my exports" / SEP / "r 1" / "p.csv", HEADER, [row("a")])
    df = read_export(spark, str(tmp_path), lineage=True)
    assert df.select(F.col("export_period")).first()[0] == "20240901"


def test_folders_may_hold_pattern_characters(spark, tmp_path):
    put_csv(tmp_path / "team [x]" / SEP / "r{1}" / "p.csv", HEADER, [row("a")])
    put_csv(tmp_path / "flat*" / "p.csv", HEADER, [row("b")])
    assert ids(read_export(spark, str(tmp_path))) == ["a", "b"]


def test_header_of_a_run_whose_smallest_part_is_blank(spark, tmp_path):
    put_csv(tmp_path / "e" / SEP / "r" / "p0.csv", None, [])
    (tmp_path / "e" / SEP / "r" / "p0.csv").write_text("\n")
    put_csv(tmp_path / "e" / SEP / "r" / "p1.csv", HEADER, [row("a")])
    assert ids(read_export(spark, str(tmp_path))) == ["a"]


def jobs_of(spark, action):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(group := f"g{id(action)}", "counted")
    try:
        df = action()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(tracker.getJobIdsForGroup(group)), df


def test_many_runs_and_scopes_need_no_more_jobs_or_scans(spark, tmp_path):
    seen = []
    for n in (3, 40):
        for i in range(n):
            put_csv(tmp_path / f"t{n}" / f"scope{i}" / SEP / "r" / "p.csv", HEADER, [row(f"{i}")])
        jobs, df = jobs_of(spark, lambda n=n: read_export(spark, str(tmp_path / f"t{n}"), lineage=True))
        assert df.select("export_scope").distinct().count() == n
        seen.append((jobs, plan_of(df).split("== Physical Plan ==")[1].count("FileScan csv")))
    assert seen[0][1] == seen[1][1] == 1
    # three listings, of files, headers and rows, may take a job each beyond 32 paths
    assert seen[1][0] <= seen[0][0] + 3


def test_first_lines_hold_no_texts(spark, tmp_path):
    """Headers are found without an aggregate that sorts whole lines."""
    long_ = "\n".join(f"{i},{'x' * 50}" for i in range(2000))
    (tmp_path / "a.csv").write_text(f"\n \na,b\n{long_}\n")
    (tmp_path / "b.csv").write_text(f"c,d\n{long_}\n")
    (tmp_path / "c.csv").write_text("\n\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        found = exports.first_lines(spark, [str(tmp_path)])
        assert sorted((r.file[-5:], r.line) for r in found.collect()) == [("a.csv", "a,b"), ("b.csv", "c,d")]
        assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
