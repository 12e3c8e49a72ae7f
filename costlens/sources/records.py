"""CSV records that hold line breaks, found side by side in parts of a file.

Whether a line starts a record depends on the quotes before it: a line break inside an
open quote belongs to a field.  The parity of quotes is an associative scan.  Every
chunk of lines counts its own quotes, the counts of one file's chunks are added up (one
row a chunk), and each chunk then knows whether it begins inside a quote; doubled quotes
count twice and cancel out.  So a large file is cut at any line and still read by many
tasks, and a compressed one, which a single task has to unpack, is dealt out in chunks of
``CHUNK`` lines before any record is put together or parsed.

Only records that cross the border of a chunk meet again, a few rows a chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Lines that one task puts together at a time.
CHUNK = 20_000
_PLACE = ["file", "block", "part"]


def _lines(spark: SparkSession, paths: list[str], glob: str, chunk: int) -> DataFrame:
    """Physical lines with their file, the byte range they were read in and their order."""
    text = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .option("lineSep", "\n")
        .text(paths)
        .select(
            "value",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            # ascending within a byte range, which one task reads from end to end
            F.monotonically_increasing_id().alias("n"),
        )
    )
    quotes = F.char_length("value") - F.char_length(F.replace("value", F.lit('"'), F.lit("")))
    return text.select("*", F.floor(F.col("n") / chunk).alias("part"), (quotes % 2).alias("odd"))


def _joined(rows: Column) -> Column:
    """Texts of (place, text) rows in order, with the line breaks between them."""
    return F.array_join(F.transform(F.array_sort(rows), lambda r: r["value"]), "\n")


def records(spark: SparkSession, paths: Sequence[str], glob: str = "*.csv*", chunk: int = CHUNK) -> DataFrame:
    """``file``, ``record`` and ``is_header`` (the first with text in its file) of all CSV records."""
    lines = _lines(spark, list(paths), glob, chunk)
    # One row a chunk: whether it holds an odd number of quotes, and its first line with text.
    chunks = lines.groupBy(*_PLACE).agg(
        (F.sum("odd") % 2).alias("odds"), F.min(F.when(F.trim("value") != "", F.col("n"))).alias("text")
    )
    before = Window.partitionBy("file").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("file").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = chunks.select(
        *_PLACE,
        (F.coalesce(F.sum("odds").over(before), F.lit(0)) % 2).alias("inside"),
        F.first("text", ignorenulls=True).over(every).alias("header"),
    )
    # Inside a chunk both cases are worked out; the carried parity then says which holds.
    so_far = Window.partitionBy(*_PLACE).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scanned = lines.withColumn("parity", (F.sum("odd").over(so_far) - F.col("odd")) % 2)
    start = lambda p: F.last(F.when(F.col("parity") == p, F.col("n")), ignorenulls=True).over(so_far)
    scanned = scanned.select("*", start(0).alias("outside_start"), start(1).alias("inside_start"))
    placed = scanned.join(carried, _PLACE).select(
        *_PLACE,
        "n",
        "value",
        "odd",
        "header",
        F.when(F.col("inside") == 0, F.col("outside_start")).otherwise(F.col("inside_start")).alias("start"),
    )
    is_header = F.col("start") == F.col("header")
    parts = placed.groupBy(*_PLACE, "start", "header").agg(
        _joined(F.collect_list(F.struct("n", "value"))).alias("value"), (F.sum("odd") % 2).alias("odd")
    )
    whole_ = F.col("start").isNotNull() & (F.col("odd") == 0)
    within = parts.where(whole_).select("file", F.col("value").alias("record"), is_header.alias("is_header"))
    # What crosses a border: the open end of a chunk and the beginnings of those that follow.
    order = Window.partitionBy("file").orderBy("block", "part", F.col("start").asc_nulls_first())
    opens = F.sum(F.col("start").isNotNull().cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    loose = parts.where(~whole_).withColumn("number", opens)
    place = F.struct("block", "part", F.col("start"), "value")
    crossing = loose.groupBy("file", "number").agg(
        _joined(F.collect_list(place)).alias("record"), F.coalesce(F.max(is_header), F.lit(False)).alias("is_header")
    )
    found = within.union(crossing.select("file", "record", "is_header"))
    # A carriage return before the line break ends the record with it.
    return found.select("file", F.regexp_replace("record", "\r$", "").alias("record"), F.coalesce("is_header", F.lit(False)).alias("is_header"))


def parsed(found: DataFrame, columns: Sequence[str], options: dict[str, str]) -> DataFrame:
    """The fields of ``records`` as text columns, with ``file``; other headers than ``columns`` fail."""
    names = [f"c{i}" for i in range(len(columns))]
    schema = ", ".join(f"{c} string" for c in names)
    text = F.when(F.col("is_header"), F.ltrim(F.col("record"), F.lit("﻿"))).otherwise(F.col("record"))
    rows = found.where(F.trim("record") != "").select("file", "is_header", "record", F.from_csv(text, schema, options).alias("v"))
    shown = F.array(*[F.lower(F.col("v")[c]) for c in names])
    same = shown == F.array(*[F.lit(c.lower()) for c in columns])
    stray = F.raise_error(F.concat(F.lit("header differs from its run's in "), F.col("file")))
    # a header of other columns stops the read; the right one is left out
    data = F.when(~F.col("is_header"), True).when(same, False).otherwise(stray.cast("boolean"))
    return rows.where(data).select("file", *[F.col("v")[a].alias(b) for a, b in zip(names, columns, strict=True)])
