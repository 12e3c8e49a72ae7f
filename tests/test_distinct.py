"""Distinct counts from bitmaps and sketches of days, against COUNT(DISTINCT)."""

import pytest
from pyspark.sql import functions as F

from costlens.operators import distinct


@pytest.fixture(scope="module")
def rows(spark):
    n = F.col("id")
    value = F.when(n % 7 == 0, None).otherwise(F.concat(F.lit("r-"), (n * n) % 4001))
    # group 0 has most of the rows, group 3 only null values
    group = F.when(n % 3 > 0, 0).when(n % 21 == 0, 3).otherwise(n % 2 + 1)
    return spark.range(20_000).select((n % 31).alias("day"), group.alias("group"), value.alias("v"))


def exact(rows, keys):
    return {tuple(r)[:-1]: r.n for r in rows.groupBy(*keys).agg(F.countDistinct("v").alias("n")).collect() if r.n}


def test_days_add_up_exactly(spark, rows, tmp_path):
    early, folder = rows.where("day < 10"), str(tmp_path / "dictionary")
    distinct.numbered(early, "v").write.parquet(folder)
    first = spark.read.parquet(folder)
    before = {r.value: r.number for r in first.collect()}
    distinct.numbered(rows, "v", first).write.mode("append").parquet(folder)
    dictionary = spark.read.parquet(folder)
    found = {r.value: r.number for r in dictionary.collect()}
    assert len(set(found.values())) == len(found) == dictionary.count() == rows.agg(F.countDistinct("v")).first()[0]
    assert before.items() <= found.items()  # numbers never change
    assert distinct.numbered(rows, "v", dictionary).count() == 0
    maps = distinct.bitmaps(rows, ["day", "group"], "v", dictionary)
    for keys in (["day", "group"], ["group"], ["day"]):
        assert {tuple(r)[:-1]: r.n for r in distinct.counted(maps, keys, "n").collect()} == exact(rows, keys)
    assert max(len(r.bits) for r in maps.collect()) <= distinct.BUCKET // 8


def test_sketches_stay_within_their_error(rows):
    days = rows.groupBy("day", "group").agg(distinct.sketch("v").alias("s"))
    for keys in (["group"], ["day"]):
        truth = exact(rows, keys)
        got = {tuple(r)[:-1]: r.n for r in distinct.estimated(days, keys, "s", "n").collect()}
        assert all(abs(got[k] - n) <= 4 * 0.8 / 64 * n + 1 for k, n in truth.items())


def test_no_values(spark, rows):
    none = rows.where("v is null")
    dictionary = distinct.numbered(none, "v")
    assert dictionary.count() == 0
    assert distinct.counted(distinct.bitmaps(none, ["day"], "v", dictionary), ["day"], "n").count() == 0
