"""Find cumulative export runs in a lake folder and read the newest of each period.

A daily export rewrites the whole month so far, so reading every file counts a
day up to thirty times.  Selection therefore works on the *file listing*: older
runs are never opened.  Layouts understood below an export folder:

    <daterange>/<run>/<guid>/part_*.csv
    <daterange>/<run>/*.csv
    <daterange>/*.csv
    *.csv                                  (overwritten in place: one current run)

where ``<daterange>`` is ``YYYYMMDD-YYYYMMDD``.  A segment may carry a
``name=`` prefix, as partitioned writers leave it.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import date
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from costlens.functions.columns import AsOf, instant
from costlens.sources.records import parsed, records
from costlens.sources.schema import EXPORT_PERIOD, EXPORT_SCOPE, FLAT_PERIOD, RAW_SCHEMA

CSV_GLOB = "*.csv*"
# Folders looked for at a time when one is missing.
ROOT_PROBES = 16

# <scope>/<daterange>/[<run>/...]<file>; the last date range of a path counts.
_DATED = r"^(.*)/(?:[^/=]+=)?(\d{8})-\d{8}/"
_RUN = r"^.*/(?:[^/=]+=)?\d{8}-\d{8}/([^/]+)/"
RUN_DIR = r"^(.*/(?:[^/=]+=)?\d{8}-\d{8}/[^/]+)/.+$"
_PARENT = r"^(.*)/[^/]+$"

LISTING = (
    "file string, path string, modificationTime timestamp, length bigint, "
    "export_scope string, export_period string, run string, run_path string"
)
# Quotes are doubled inside quoted fields, so JSON in a tag column survives.
CSV_OPTIONS = {"header": True, "encoding": "UTF-8", "quote": '"', "escape": '"'}

# An unquoted empty field is NULL by itself; naming a text no field holds as the NULL
# marker leaves a quoted empty field an empty string.
_NEVER = "\x00"


def scope_of(file: str) -> Column:
    """Export folder a file belongs to: everything above the date range."""
    dated = F.regexp_extract(file, _DATED, 1)
    return F.when(dated != "", dated).otherwise(F.regexp_extract(file, _PARENT, 1))


def period_of(file: str) -> Column:
    """First day of the billing period, or ``current`` for a flat folder.

    Cumulative runs of one month share the first day whatever last day their
    folder name shows, so the first day alone identifies the period.
    """
    start = F.regexp_extract(file, _DATED, 2)
    return F.when(start != "", start).otherwise(F.lit(FLAT_PERIOD))


def _as_list(paths: str | Iterable[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def _listing(spark: SparkSession, folders: list[str]) -> DataFrame | None:
    """Listing of the CSV files below the folders; None when one does not exist."""
    try:
        return (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", CSV_GLOB)
            .load(folders)
        )
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _csv_files(spark: SparkSession, folders: list[str], missing_ok: bool) -> DataFrame | None:
    """Listing of the CSV files below the folders; None when none of them exists."""
    files = _listing(spark, folders)
    if files is not None:
        return files
    with ThreadPoolExecutor(ROOT_PROBES) as pool:
        exists = list(pool.map(lambda f: _listing(spark, [f]) is not None, folders))
    missing = [f for f, there in zip(folders, exists) if not there]
    if missing and not missing_ok:
        raise FileNotFoundError(f"export folders do not exist: {missing}")
    found = [f for f in folders if f not in missing]
    return _listing(spark, found) if found else None


def literal(path: str) -> str:
    """A listed path as a pattern that matches only itself."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def list_export_files(
    spark: SparkSession,
    roots: str | Iterable[str],
    export_name: str | None = None,
    missing_ok: bool = False,
) -> DataFrame:
    """One row per CSV file under the roots, without reading any content (O-03, O-04, O-08).

    Roots may be patterns.  One that does not exist is an error, or with
    ``missing_ok`` contributes no rows.
    """
    below = f"/{export_name}" if export_name else ""
    folders = [f"{root.rstrip('/')}{below}" for root in _as_list(roots)]
    files = _csv_files(spark, folders, missing_ok)
    if files is None:
        return spark.createDataFrame([], LISTING)
    files = files.select(
        F.col("_metadata.file_path").alias("file"), "path", "modificationTime", "length"
    )
    run_dir = F.regexp_extract("path", RUN_DIR, 1)
    escaped = lambda c: F.regexp_replace(c, r"([\\{}\[\]*?])", r"\\$1")
    return files.select(
        "*",
        scope_of("file").alias(EXPORT_SCOPE),
        period_of("file").alias(EXPORT_PERIOD),
        F.regexp_extract("file", _RUN, 1).alias("run"),
        # Files outside a run folder are addressed one level deep, so that reading
        # them does not descend into dated folders beside them.
        F.when(run_dir != "", escaped(run_dir))
        .otherwise(F.concat(escaped(F.regexp_extract("path", _PARENT, 1)), F.lit("/" + CSV_GLOB)))
        .alias("run_path"),
    )


def latest_runs(
    files: DataFrame,
    mode: str = "per_period",
    settle_seconds: int = 0,
    as_of: AsOf = None,
    since: date | None = None,
) -> DataFrame:
    """The newest run of each billing period, all its parts together (O-05).

    ``mode="global"`` keeps only the newest run of each export.  Run ids need not
    sort by time, so the modification time decides and the id breaks ties.  A run
    touched within ``settle_seconds`` counts as still being written and is passed
    over in favour of the one before it.  ``since`` leaves out billing periods that
    began before that day, which a report over recent months need not read.
    """
    if mode not in ("per_period", "global"):
        raise ValueError(f"mode must be 'per_period' or 'global', not {mode!r}")
    if since:
        # ``current`` sorts after every date, so flat folders are always kept.
        files = files.filter(F.col(EXPORT_PERIOD) >= f"{since:%Y%m%d}")
    runs = files.groupBy(EXPORT_SCOPE, EXPORT_PERIOD, "run", "run_path").agg(
        F.max("modificationTime").alias("modified"),
        F.count("*").alias("files"),
        F.sum("length").alias("bytes"),
        # The part to take the header from: the least to read.
        F.min_by(
            F.struct("path", "file"), F.when(F.col("length") > 0, F.struct("length", "path"))
        ).alias("sample"),
    )
    if settle_seconds:
        settled = instant(as_of) - F.make_dt_interval(secs=F.lit(settle_seconds))
        runs = runs.filter(F.col("modified") <= settled)
    keys = [EXPORT_SCOPE] if mode == "global" else [EXPORT_SCOPE, EXPORT_PERIOD]
    newest = F.max_by(F.struct("*"), F.struct("modified", "run", "run_path"))
    return runs.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(newest.alias("r")).select("r.*")


def first_lines(spark: SparkSession, paths: list[str], whole_runs: bool = False) -> DataFrame:
    """``file`` and ``line``, the first with text of each file, in one job whatever the number of files.

    The least place of a file's lines is found by numbers alone, so no task sorts or holds
    texts; the one line at that place is then picked from a second look at the same splits.
    """
    lines = (
        spark.read.option("recursiveFileLookup", whole_runs)
        .option("pathGlobFilter", CSV_GLOB)
        .text(paths)
        .select(
            "value",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            # ascending within a byte range, which one task reads from end to end
            F.monotonically_increasing_id().alias("n"),
        )
        .filter("trim(value) != ''")
    )
    blocks = lines.groupBy("file", "block").agg(F.min("n").alias("n"))
    first = blocks.groupBy("file").agg(F.min_by("n", "block").alias("n"))
    found = lines.join(F.broadcast(first), ["file", "n"])  # one row a run
    return found.select("file", F.col("value").alias("line"))


def _first_lines(spark: SparkSession, paths: list[str], whole_runs: bool = False) -> dict[str, str]:
    return {r["file"]: r["line"] for r in first_lines(spark, paths, whole_runs).collect()}  # one row per run


def layouts_of(spark: SparkSession, runs: Sequence[Row]) -> dict[tuple[str, ...], list[Row]]:
    """Runs by header, so that one reader serves all runs of one layout.

    The headers of all runs' smallest parts are read in one job; only runs whose
    smallest part has blank lines alone are looked at whole.  Runs without any text
    have no rows and are left out.
    """
    runs = sorted((r for r in runs if r["sample"]), key=lambda r: r["run_path"])
    if not runs:
        return {}
    lines = _first_lines(spark, [literal(r["sample"]["path"]) for r in runs])
    blank = [r for r in runs if r["sample"]["file"] not in lines]
    others = _first_lines(spark, [r["run_path"] for r in blank], True) if blank else {}
    layouts: dict[tuple[str, ...], list[Row]] = {}
    for run in runs:
        file = run["sample"]["file"]
        home = re.match(RUN_DIR, file)
        below = f"{home[1] if home else file.rpartition('/')[0]}/"
        line = lines.get(file) or next((x for f, x in sorted(others.items()) if f.startswith(below)), None)
        if line:
            columns = tuple(next(csv.reader([line.lstrip("\ufeff")])))
            layouts.setdefault(columns, []).append(run)
    return layouts


def _with_origin(rows: DataFrame, file: Column, depth: int, flat: bool) -> DataFrame:
    """Name the export and period of every row.

    All scopes have ``depth`` path segments, so both are cut from the path by
    position; a pattern match per row would cost more than parsing the row.
    """
    folder = F.substring_index(F.substring_index(file, "/", depth + 1), "/", -1)
    # The folder ends in YYYYMMDD-YYYYMMDD.
    period = F.lit(FLAT_PERIOD) if flat else F.left(F.right(folder, F.lit(17)), F.lit(8))
    scope = F.substring_index(file, "/", depth)
    return rows.select("*", scope.alias(EXPORT_SCOPE), period.alias(EXPORT_PERIOD))


def read_runs(
    spark: SparkSession,
    runs: Sequence[Row],
    multi_line: bool = False,
    lineage: bool = False,
    layouts: dict[tuple[str, ...], list[Row]] | None = None,
) -> DataFrame:
    """All rows of the given runs as text, bound by column *name* (O-01, O-12, O-20).

    Spark binds a CSV schema by position, so runs are grouped by their header and
    each group is read with its own column order.  ``enforceSchema=False`` makes a
    stray part with another header fail instead of shifting columns.  Compressed
    parts are read as they are.  ``lineage`` adds the export and period; the plan has
    one scan per layout and depth of folders, not one per export.

    ``multi_line`` accepts line breaks inside quotes: lines are read in parallel and records
    put together from them (:mod:`costlens.sources.records`), which also deals a large
    compressed part out to many tasks before it is parsed.
    """

    def read(columns: tuple[str, ...], group: list[Row]) -> DataFrame:
        if multi_line:
            found = records(spark, [r["run_path"] for r in group], CSV_GLOB)
            return parsed(found, columns, {"quote": '"', "escape": '"', "nullValue": _NEVER})
        return (
            spark.read.options(**CSV_OPTIONS, nullValue=_NEVER)
            .option("enforceSchema", False)
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", CSV_GLOB)
            .schema(StructType([StructField(c, StringType()) for c in columns]))
            .csv([r["run_path"] for r in group])
        )

    parts = []
    for columns, group in (layouts_of(spark, runs) if layouts is None else layouts).items():
        if not lineage:
            rows = read(columns, group)
            parts.append(rows.drop("file") if multi_line else rows)
            continue
        origins: dict[tuple[int, bool], list[Row]] = {}
        for r in group:
            key = (r[EXPORT_SCOPE].count("/") + 1, r[EXPORT_PERIOD] == FLAT_PERIOD)
            origins.setdefault(key, []).append(r)
        for origin, some in origins.items():
            file = F.col("file") if multi_line else F.col("_metadata.file_path")
            rows = _with_origin(read(columns, some), file, *origin)
            parts.append(rows.drop("file") if multi_line else rows)
    if not parts:
        empty = RAW_SCHEMA.fields
        if lineage:
            empty = [*empty, *[StructField(c, StringType()) for c in (EXPORT_SCOPE, EXPORT_PERIOD)]]
        return spark.createDataFrame([], StructType(empty))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_export(
    spark: SparkSession,
    roots: str | Iterable[str],
    export_name: str | None = None,
    mode: str = "per_period",
    settle_seconds: int = 0,
    as_of: AsOf = None,
    since: date | None = None,
    multi_line: bool = False,
    lineage: bool = False,
    missing_ok: bool = False,
) -> DataFrame:
    """The latest data of one or several exports as text columns (O-01 .. O-08).

    Only run folders reach the driver: one row per export and billing period.
    An empty folder, or with ``missing_ok`` a missing one, gives an empty frame with the
    declared columns.
    """
    files = list_export_files(spark, roots, export_name, missing_ok)
    runs = latest_runs(files, mode, settle_seconds, as_of, since).collect()
    return read_runs(spark, runs, multi_line, lineage)


def export_status(
    spark: SparkSession,
    root: str,
    container: str,
    export_name: str,
    as_of: AsOf = None,
) -> DataFrame:
    """One row saying what is awaited while an export has no files yet (O-14)."""
    waiting = list_export_files(spark, root, export_name, missing_ok=True).limit(1).count() == 0
    # The texts shown before and after the first delivery.
    status = "No billing data available yet" if waiting else "Billing data available"
    message = (
        "Waiting for billing export to complete" if waiting else "Export files were found"
    )
    step = "Read the export again once files exist" if waiting else "Read the export"
    return spark.range(1).select(
        F.lit(status).alias("Status"),
        F.lit(message).alias("Message"),
        F.lit(root).alias("StorageAccount"),
        F.lit(container).alias("Container"),
        F.lit(f"{export_name}/YYYYMMDD-YYYYMMDD/GUID/*.csv").alias("ExpectedPattern"),
        F.lit(step).alias("NextStep"),
        instant(as_of).alias("CheckedAt"),
    )
