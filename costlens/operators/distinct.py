"""Distinct counts that can be added up over days (A-05 .. A-07).

COUNT(DISTINCT) of a month can't be had from those of its days.  Bitmaps can: a
dictionary gives every text a number once, a day's numbers set bits, and the union of
days is a bitwise OR.  Numbers lie densely in blocks, one a task that assigned them, so bitmaps
stay short; a group's bitmap is as many rows as it has buckets of 32,768 numbers, and no row
grows with the data.  HLL sketches beside them estimate the same in a fixed few bytes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers of one bucket, as Spark's bitmap functions have it.
BUCKET = 32_768


def numbered(values: DataFrame, column: str, known: DataFrame | None = None) -> DataFrame:
    """New entries (``value``, ``number``) of a dictionary: the values that ``known`` lacks.

    Append them to the table that ``known`` was read from.  Each task numbers its own values
    after a start of its own; one count a task reaches the driver.  Write the result before use:
    it is the same only while its input is.
    """
    spark = values.sparkSession
    new = values.select(F.col(f"`{column}`").cast("string").alias("value")).where("value is not null").distinct()
    first = 1
    if known is not None:
        new = new.join(known, "value", "left_anti")
        last = known.agg(F.max("number")).first()[0] or 0
        first = -(-last // BUCKET) * BUCKET + 1  # bucket k holds BUCKET * (k - 1) + 1 and up
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A number within the task is the lower part of the increasing id.
    placed = new.repartition(tasks, "value").sortWithinPartitions("value").select(
        "value",
        F.spark_partition_id().alias("task"),
        (F.monotonically_increasing_id() % F.lit(2**33)).alias("within"),
    )
    starts = {}
    for r in sorted(placed.groupBy("task").agg(F.count("*").alias("n")).collect(), key=lambda r: r.task):
        starts[r.task] = first
        first += -(-r.n // BUCKET) * BUCKET
    if not starts:
        return placed.select("value", F.col("within").alias("number"))
    start = F.get(F.split(F.lit(",".join(str(starts.get(k, 0)) for k in range(max(starts) + 1))), ","), F.col("task"))
    return placed.select("value", (start.cast("long") + F.col("within")).alias("number"))


def bitmaps(rows: DataFrame, keys: Sequence[str], column: str, dictionary: DataFrame) -> DataFrame:
    """Per group and bucket the bitmap of the values that occur; null values set no bit.

    Combined before the shuffle by (group, bucket), so a group with most of the rows is no task's alone.
    """
    named = dictionary.select(F.col("value").alias(column), "number")
    pairs = rows.select(*keys, F.col(column).cast("string").alias(column)).where(F.col(column).isNotNull()).distinct()
    found = pairs.join(named, column)
    return found.groupBy(*keys, F.bitmap_bucket_number("number").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits")
    )


def merged(maps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bitmaps of coarser groups, by bitwise OR."""
    return maps.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def counted(maps: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Exact distinct counts of groups, from bitmaps of the same or finer ones."""
    return merged(maps, keys).groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias(name))


def sketch(column: str | Column, bits: int = 12) -> Column:
    """HLL sketch of a group's values; its standard error is about 0.8 / sqrt(2 ** bits)."""
    return F.hll_sketch_agg(column, F.lit(bits))


def estimated(sketches: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """Estimated distinct counts of groups, from sketches of the same or finer ones."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg(column)).alias(name))
