"""Records with line breaks: chunks of any size, compressed parts, odd quotes."""

import csv
import gzip
import io
import random

import pytest

from costlens.sources import exports
from costlens.sources.exports import read_export
from costlens.sources.records import records

HEADER = ["id", "Tags", "note\nof two lines"]


def rows_of(n, seed=3):
    draw = random.Random(seed)
    bits = ['"', "\n", ",", "a", "é", " ", '""', "\r\n", "{}", ""]
    return [[str(i), "".join(draw.choices(bits, k=draw.choice([0, 1, 3, 12]))), draw.choice(["x", "\n\n\n"])] for i in range(n)]


def text_of(rows, header=HEADER, end="\n"):
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(header)
    writer.writerows(rows)
    return out.getvalue()


def plain_records(text):
    """Split where the number of quotes so far is even."""
    out, inside, now = [], False, ""
    for line in text.split("\n"):
        now = f"{now}\n{line}" if inside else line
        inside ^= line.count('"') % 2 == 1
        if not inside:
            out.append(now.removesuffix("\r"))
    return [x for x in out if x.strip()]


@pytest.mark.parametrize("chunk", [1, 2, 7, 20_000])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_of_any_chunk(spark, tmp_path, chunk, end):
    texts = [text_of(rows_of(60, seed), end=end) for seed in (1, 2)] + ["\n\n" + text_of(rows_of(3)), "", "\n"]
    for i, text in enumerate(texts):
        (tmp_path / f"p{i}.csv").write_bytes(text.encode())
    got = records(spark, [str(tmp_path)], chunk=chunk).where("trim(record) != ''").collect()
    assert sorted(r.record for r in got) == sorted(x for t in texts for x in plain_records(t))
    assert sorted(r.record for r in got if r.is_header) == sorted(plain_records(t)[0] for t in texts if t.strip())


def test_byte_ranges_and_compressed_parts(spark, tmp_path):
    rows = rows_of(4000)
    (tmp_path / "flat").mkdir()
    (tmp_path / "flat" / "a.csv").write_bytes(text_of(rows[:2500]).encode())
    (tmp_path / "flat" / "b.csv.gz").write_bytes(gzip.compress(text_of(rows[2500:]).encode()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        found = records(spark, [str(tmp_path / "flat")], chunk=100)
        assert found.rdd.getNumPartitions() > 1
        want = [x for part in (rows[:2500], rows[2500:]) for x in plain_records(text_of(part))]
        assert sorted(r.record for r in found.where("trim(record) != ''").collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_one_compressed_part_is_put_together_by_several_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    (tmp_path / "b.csv.gz").write_bytes(gzip.compress(text_of(rows_of(3000)).encode()))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = records(spark, [str(tmp_path)], chunk=200)
        tasks = found.select(F.spark_partition_id().alias("p")).groupBy("p").count().where("count > 50").count()
        assert tasks > 3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_fields_equal_a_csv_reader(spark, tmp_path, monkeypatch):
    rows = [[i, t.replace("\r\n", "\n"), x] for i, t, x in rows_of(300)]
    run = tmp_path / "20240101-20240131" / "run"
    run.mkdir(parents=True)
    (run / "part_0.csv").write_bytes(text_of(rows[:200], ["id", "Tags", "note"]).encode())
    (run / "part_1.csv.gz").write_bytes(gzip.compress(("﻿" + text_of(rows[200:], ["id", "Tags", "note"])).encode()))
    monkeypatch.setattr(exports, "records", lambda *a: records(*a, chunk=9))
    got = read_export(spark, str(tmp_path), multi_line=True, lineage=True).collect()
    shown = sorted((r.id, r.Tags or "", r.note) for r in got)
    assert shown == sorted(tuple(r) for r in rows)
    assert {r.export_period for r in got} == {"20240101"}


def test_a_stray_header_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,Tags\n1,x\n")
    (tmp_path / "b.csv").write_text("Tags,id,more,of,it\nx,1,2,3,4\n")
    with pytest.raises(Exception, match="header differs"):
        read_export(spark, str(tmp_path), multi_line=True).collect()
