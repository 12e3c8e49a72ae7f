"""Writers and readers for month-to-date exports and typed tables."""

from __future__ import annotations

from collections.abc import Mapping
from contextlib import contextmanager
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StringType, StructField, StructType, TimestampType

from costlens.sources.exports import CSV_OPTIONS
from costlens.sources.schema import CANONICAL_SCHEMA, DATE_RAW, EXPORT_PERIOD, EXPORT_SCOPE

PERIOD_COLUMN = "BillingPeriodStart"
_ADDITIVE = ("Cost", "CostInUsd", "Quantity")


def _whole_days(field: StructField, date_col: str) -> Column:
    """A moment of the charge widened to its day: starts to midnight, ends to the next one."""
    c = F.col(f"`{field.name}`")
    if field.name == DATE_RAW:
        day = F.date_trunc("DAY", date_col)
        return F.coalesce(F.date_format(day, "yyyy-MM-dd"), c)
    if not isinstance(field.dataType, TimestampType):
        return c
    if field.name == date_col or field.name.endswith("PeriodStart"):
        return F.date_trunc("DAY", c)
    if field.name.endswith("PeriodEnd"):
        last = c - F.expr("INTERVAL 1 MICROSECOND")
        return F.date_trunc("DAY", last) + F.expr("INTERVAL 1 DAY")
    return c


def to_daily(df: DataFrame, date_col: str = "ChargePeriodStart") -> DataFrame:
    """Rows of one day that differ only in amounts become one row (daily granularity of O-09).

    Every period column is widened to whole days and the raw date text becomes the
    day, so hourly rows meet.  Costs and quantities are added up; prices and rates are
    kept as keys.
    """
    moneys = [
        f.name
        for f in df.schema
        if isinstance(f.dataType, DecimalType) and f.name.endswith(_ADDITIVE)
    ]
    keys = [_whole_days(f, date_col).alias(f.name) for f in df.schema if f.name not in moneys]
    types = {f.name: f.dataType for f in df.schema}
    # The amounts keep their type; a sum it cannot hold raises under ANSI rules.
    return (
        df.groupBy(*keys)
        .agg(*[F.sum(c).cast(types[c]).alias(c) for c in moneys])
        .select(*df.columns)
    )


def _number_text(name: str) -> Column:
    """A decimal without the zeros that end its fraction."""
    text = F.col(f"`{name}`").cast("string")
    plain = F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))
    return F.when(text.contains("E"), text).otherwise(plain)


def _export_text(df: DataFrame) -> DataFrame:
    """Timestamps in ISO form with a zone, amounts as short as they are; everything else by its plain text."""

    def text(f: StructField) -> Column:
        if isinstance(f.dataType, TimestampType):
            return F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ssXXX")
        if isinstance(f.dataType, DecimalType) and f.dataType.scale > 0:
            return _number_text(f.name)
        return F.col(f.name)

    return df.select(*[text(f).alias(f.name) for f in df.schema])


def _csv_writer(df: DataFrame, compression: str, max_records_per_file: int):
    return (
        df.write.mode("overwrite")
        .options(**CSV_OPTIONS)
        # white space at the ends of a text is part of it
        .options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        .option("compression", compression)
        .option("maxRecordsPerFile", max_records_per_file)
    )


def write_mtd_export(
    df: DataFrame,
    root: str,
    export_name: str,
    run_date: date,
    run_id: str,
    date_col: str = "ChargePeriodStart",
    compression: str = "none",
    max_records_per_file: int = 1_000_000,
    daily: bool = True,
) -> str:
    """Write one cumulative run: the month of ``run_date`` up to that day (O-09, O-12).

    Writing the same run again replaces it.  Returns the run folder.
    """
    first = run_date.replace(day=1)
    last = date(first.year + first.month // 12, first.month % 12 + 1, 1).toordinal() - 1
    span = f"{first:%Y%m%d}-{date.fromordinal(last):%Y%m%d}"
    folder = f"{root.rstrip('/')}/{export_name}/{span}/{run_id}"
    c = F.col(date_col)
    rows = df.filter(
        (c >= F.lit(str(first)).cast("timestamp"))
        & (c < F.date_add(F.lit(str(run_date)).cast("date"), 1).cast("timestamp"))
    )
    if daily:
        rows = to_daily(rows, date_col)
    with while_writing(df.sparkSession):
        _csv_writer(_export_text(rows), compression, max_records_per_file).csv(folder)
    return folder


def write_mtd_history(
    df: DataFrame,
    root: str,
    export_name: str,
    run_day: int,
    date_col: str = "ChargePeriodStart",
    compression: str = "none",
    max_records_per_file: int = 1_000_000,
    daily: bool = False,
    dealt: bool = False,
) -> str:
    """Write the run of day-of-month ``run_day`` for every month present, in one job (O-09).

    Rows are rebalanced by month first: a month that holds most of the data is
    split over many tasks and small months share one, so the number of files
    follows the data and no task holds a whole month.  Rows that lie by month already
    (``dealt``), as those of a table partitioned by month do, are written where they are.
    """
    rows = df.filter(F.dayofmonth(date_col) <= run_day)
    if daily:
        rows = to_daily(rows, date_col)
    month = F.date_trunc("MM", date_col)
    rows = rows.select(
        "*",
        F.concat_ws(
            "-", F.date_format(month, "yyyyMMdd"), F.date_format(F.last_day(month), "yyyyMMdd")
        ).alias("daterange"),
        F.lit(f"{run_day:02d}").alias("run"),
    )
    folder = f"{root.rstrip('/')}/{export_name}"
    text = _export_text(rows)
    writer = (
        _csv_writer(text if dealt else text.hint("rebalance", "daterange"), compression, max_records_per_file)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("daterange", "run")
    )
    # the few months of a task are written side by side, without sorting its rows by month
    with while_writing(df.sparkSession, {"spark.sql.maxConcurrentOutputFileWriters": str(MONTHS_AT_ONCE)} if dealt else {}):
        writer.csv(folder)
    return folder


#: Months that a task writes side by side; further ones are sorted first.
MONTHS_AT_ONCE = 16
#: Bytes of a row group's Bloom filter of a clustered column at most (for about 100,000 values); it gets the
#: smallest of the halves of that, down to 1 KB, that its values fit.
BLOOM_BYTES, BLOOM_SIZES = 2**17, 8
#: Codec of typed tables.
COMPRESSION = "zstd"
#: Shuffled bytes that a task gets at least which writes every period it meets.
GATHERED_BYTES = 8 * 2**20
#: Bytes of a period's typed files that a task reads (about 150 MB of CSV).
READ_BYTES = 32 * 2**20


def write_table(
    df: DataFrame,
    path: str,
    partition_by: tuple[str, ...] = (PERIOD_COLUMN,),
    mode: str = "overwrite",
    cluster_by: tuple[str, ...] = (),
    dealt: bool = False,
    gather: bool = False,
) -> None:
    """Typed Parquet partitioned by billing period (O-13).

    Overwriting replaces only the partitions present in ``df``.  The rebalance
    splits a period that holds most of the rows and merges small ones; sorting
    within each task by charge day gives the files narrow min/max statistics, so
    day ranges skip row groups.

    ``cluster_by`` brings rows with equal values, such as a customer's, to few files of their
    period and sorts by them (F-07): a search for one value skips other files by Bloom
    filters and dictionaries, and other row groups by their ranges.  It is the same one
    shuffle, by sampled ranges of period and value: a task writes to few periods, so there
    are about as many files as tasks and periods, and as many Bloom filters.  Ranges go on
    by the whole row, so a value that holds most of a period is still split over several tasks.

    ``dealt`` rows lie by period (and cluster) already: each task has few periods, so they are
    sorted and written where they are, without another shuffle.

    ``gather`` writes rows of any order where they are too: every task that made them, such as a join's, writes
    a file of each period it meets.  That is for tables that :func:`read_by_period` reads next, which
    brings the files of a period together: it moves compressed columns where a shuffle moves rows.
    """
    days = [c for c in ("ChargePeriodStart",) if c in df.columns and c not in (*partition_by, *cluster_by)]
    if dealt or gather:
        placed = df
    elif cluster_by:
        placed = df.repartitionByRange(*partition_by, *cluster_by, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    else:
        placed = df.hint("rebalance", *partition_by)
    writer = (
        placed.sortWithinPartitions(*partition_by, *cluster_by, *days)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", COMPRESSION)
        .partitionBy(*partition_by)
    )
    for c in cluster_by:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer = writer.option(f"parquet.bloom.filter.candidates.number#{c}", str(BLOOM_SIZES))
    if cluster_by:
        writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true").option("parquet.bloom.filter.max.bytes", str(BLOOM_BYTES))
    # Timestamps as microseconds: INT96, the default, has no min/max.
    settings = {"spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS"}
    if cluster_by:  # ranges are merged up to the advisory size, not to a number of tasks
        settings["spark.sql.adaptive.coalescePartitions.parallelismFirst"] = "false"
        settings["spark.sql.adaptive.coalescePartitions.minPartitionSize"] = "1b"
    elif gather:
        settings["spark.sql.adaptive.coalescePartitions.minPartitionSize"] = f"{GATHERED_BYTES}b"
    with while_writing(df.sparkSession, settings):
        writer.parquet(path)


#: A write's shuffle files go when it has ended, not when the driver's memory is next cleaned up.
DROPS_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def while_writing(spark: SparkSession, settings: Mapping[str, str] = {}):
    """The session with these settings for one write, whose shuffles take no disk after it."""
    settings = DROPS_SHUFFLES | settings
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def read_table(
    spark: SparkSession, path: str, ingested: bool = False, since: date | None = None
) -> DataFrame:
    """A table written by :func:`write_table`.

    The schema is stated, not inferred, so columns that some files lack are NULL.
    ``since`` leaves out billing periods that began before that day.  An ingested
    table is partitioned by export and export period, which the billing period of a
    row doesn't prune by itself; folders without date range are always read.
    """
    origin = (EXPORT_SCOPE, EXPORT_PERIOD) if ingested else ()
    schema = StructType([*CANONICAL_SCHEMA, *[StructField(c, StringType()) for c in origin]])
    rows = spark.read.schema(schema).parquet(path)
    if since and ingested:
        # ``current`` sorts after every date.
        rows = rows.filter(F.col(EXPORT_PERIOD) >= f"{since:%Y%m%d}")
    elif since:
        rows = rows.filter(F.col(PERIOD_COLUMN) >= F.lit(str(since)).cast("timestamp"))
    return rows


def read_by_period(
    spark: SparkSession, path: str, partition: str = PERIOD_COLUMN, schema: StructType | None = None
) -> DataFrame:
    """A table written by :func:`write_table`; each task reads files of few periods that follow each other.

    One scan of all periods packs files by size whatever their period; here every ``MONTHS_AT_ONCE`` periods
    are a scan of their own, in as many tasks as their bytes fill, so rows can be written
    period by period where they are read.  One row a period reaches the driver.  ``schema`` is
    that of a table with other columns than the canonical ones.
    """
    rows = spark.read.schema(schema).parquet(path) if schema else read_table(spark, path)
    files = rows.groupBy(F.col(partition).alias("period"), "_metadata.file_path").agg(
        F.max("_metadata.file_size").alias("bytes")
    )
    # as text, which the driver's time zone doesn't change
    per_period = files.groupBy(F.col("period").cast("string").alias("period")).agg(F.sum("bytes").alias("bytes"))
    sizes = {r.period: r.bytes for r in per_period.collect()}
    kind, known = rows.schema[partition].dataType, sorted(p for p in sizes if p is not None)
    groups = [known[i : i + MONTHS_AT_ONCE] for i in range(0, len(known), MONTHS_AT_ONCE)]
    parts = [(F.col(partition).isin([F.lit(p).cast(kind) for p in g]), sum(sizes[p] for p in g)) for g in groups]
    if None in sizes:
        parts.append((F.col(partition).isNull(), sizes[None]))
    # a union of single tasks would be one task
    scans = [rows.where(own).coalesce(max(2, -(-size // READ_BYTES))) for own, size in parts]
    return reduce(DataFrame.unionAll, scans) if scans else rows
