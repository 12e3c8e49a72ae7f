"""Keep a typed table in step with an export folder."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import datetime
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from costlens.functions.columns import AsOf
from costlens.sources.exports import (
    CSV_GLOB,
    latest_runs,
    layouts_of,
    list_export_files,
    literal,
    period_of,
    read_runs,
    scope_of,
)
from costlens.sources.manifests import complete_only
from costlens.sources.normalize import normalize
from costlens.sources.schema import EXPORT_PERIOD, EXPORT_SCOPE, FLAT_PERIOD
from costlens.sources.tables import read_table, write_table
from costlens.streaming.rollups import refresh_rollups
from costlens.streaming.version_log import Conflict, VersionLog

# The columns of a file listing source.
_FILES = "path string, modificationTime timestamp, length bigint, content binary"
_KEYS = [EXPORT_SCOPE, EXPORT_PERIOD]
_PENDING = f"{EXPORT_SCOPE} string, {EXPORT_PERIOD} string, at timestamp, waits boolean"
_VERSIONS = f"{EXPORT_SCOPE} string, path string, modificationTime timestamp"

Key = tuple[str, str]
# Times a refresh is repeated because another job published the same months meanwhile.
CONFLICTS = 5


def _key(r: Row) -> Key:
    return r[EXPORT_SCOPE], r[EXPORT_PERIOD]


def _clear(spark: SparkSession, table: str, emptied: set[Key]) -> None:
    """Empty the partitions of periods whose newest run has no rows.

    Overwriting partitions by their rows cannot do that.
    """
    rows = read_table(spark, table, ingested=True)
    keys = spark.createDataFrame(sorted(emptied), f"{EXPORT_SCOPE} string, {EXPORT_PERIOD} string")
    folder = F.regexp_extract("_metadata.file_path", "^(.*)/[^/]+$", 1).alias("folder")
    stale = rows.select(*_KEYS, folder).join(F.broadcast(keys), _KEYS)  # periods of one batch
    folders = stale.select("folder").distinct()
    nothing = spark.createDataFrame([], rows.drop(*_KEYS).schema)
    for r in folders.collect():
        nothing.write.mode("overwrite").parquet(unquote(r["folder"]))


def _filled(rows: DataFrame, write: Callable[[DataFrame], None]) -> set[Key]:
    """Write rows; the keys that got any are learnt from the write itself."""
    seen = Observation()
    write(rows.observe(seen, F.collect_set(F.struct(*_KEYS)).alias("keys")))
    try:
        return {_key(k) for k in seen.get["keys"]}
    except Py4JJavaError:
        # A plan that Spark finds to be empty while it runs reports nothing.
        if not rows.isEmpty():
            raise
        return set()


def refresh_periods(
    arrivals: DataFrame,
    table: str,
    date_formats: Iterable[str] = (),
    settle_seconds: int = 0,
    as_of: AsOf = None,
    versioned: bool = False,
    manifests: bool = False,
) -> set[Key]:
    """Rewrite the table partitions of every (export, period) named in ``arrivals``.

    What is written depends only on the full listing of those periods: the parts of
    a run may arrive in different batches, a late older run does not replace a
    newer one, and repeating a batch after a failure gives the same table.  A run
    touched within ``settle_seconds`` may be half written: the one before it stays, and
    its key is returned, because no new file may ever ask for it again.

    With ``manifests`` the same holds for a run whose parts don't agree with its manifest yet
    (:mod:`costlens.sources.manifests`).

    ``versioned`` publishes all touched months in one step as the next version of the
    table (:mod:`costlens.streaming.version_log`); else a reader may see some of them replaced
    and others not yet.

    Run folders hold one export and period each, so a task reads few of them and
    writes their rows where it reads them.
    """
    spark = arrivals.sparkSession
    # Only exports x periods reach the driver, never a row or file name.
    touched = {_key(r) for r in arrivals.select(*_KEYS).distinct().collect()}
    if not touched:
        return set()
    folders = set()
    for scope, period in touched:
        folder = literal(unquote(scope))
        folders.add(folder if period == FLAT_PERIOD else f"{folder}/*{period}-*")
    files = list_export_files(spark, sorted(folders))
    newest = [r for r in latest_runs(files).collect() if _key(r) in touched]
    runs = newest
    if settle_seconds or manifests:
        whole = complete_only(files) if manifests else files
        settled = latest_runs(whole, settle_seconds=settle_seconds, as_of=as_of)
        runs = [r for r in settled.collect() if _key(r) in touched]
    chosen = {_key(r): r["run_path"] for r in runs}
    waiting = {_key(r) for r in newest if chosen.get(_key(r)) != r["run_path"]}
    if not runs:
        return waiting
    layouts = layouts_of(spark, runs)
    rows = normalize(read_runs(spark, runs, lineage=True, layouts=layouts), date_formats, fill=False)
    if versioned:
        # Without layouts there are no rows to write, only months to empty.
        VersionLog(spark, table).publish(rows, chosen, _filled if layouts else lambda *_: set())
        return waiting
    filled: set[Key] = set()
    if layouts:
        filled = _filled(rows, lambda df: write_table(df, table, tuple(_KEYS), dealt=True))
    else:
        write_table(rows, table, tuple(_KEYS))
    emptied = set(chosen) - filled
    if emptied:
        _clear(spark, table, emptied)
    return waiting


class _State:
    """What the stream's own checkpoint can't know, as two append-only tables beside it."""

    def __init__(self, spark: SparkSession, checkpoint: str):
        self.spark = spark
        self.home = f"{checkpoint.rstrip('/')}-state"

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.home}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def pending(self) -> set[Key]:
        """Keys whose newest run was passed over when they were last refreshed."""
        last = F.max_by("waits", "at").alias("waits")
        rows = self._table("pending", _PENDING).groupBy(*_KEYS).agg(last).where("waits")
        return {_key(r) for r in rows.collect()}

    def note(self, refreshed: set[Key], waiting: set[Key]) -> None:
        """Remember who waits; who no longer does is noted too."""
        now = datetime.now()
        news = [(*k, now, k in waiting) for k in sorted(refreshed & (self.pending() | waiting))]
        if news:
            rows = self.spark.createDataFrame(news, _PENDING).coalesce(1)
            rows.write.mode("append").parquet(f"{self.home}/pending")

    def overwritten(self, root: str) -> set[Key]:
        """Folders without date range of which a known file has another time now."""
        files = list_export_files(self.spark, root, missing_ok=True)
        flat = files.where(F.col(EXPORT_PERIOD) == FLAT_PERIOD).select(EXPORT_SCOPE, "path", "modificationTime")
        known = self._table("flat", _VERSIONS)
        news = flat.join(known, ["path", "modificationTime"], "left_anti").select(*flat.columns)
        changed = news.join(known.select("path").distinct(), "path", "left_semi")
        keys = {(r[EXPORT_SCOPE], FLAT_PERIOD) for r in changed.select(EXPORT_SCOPE).distinct().collect()}
        if not news.isEmpty():
            self._new_versions = news
        return keys

    def keep_versions(self) -> None:
        """Called once the overwritten folders are in the table."""
        news = getattr(self, "_new_versions", None)
        if news is not None:
            news.write.mode("append").parquet(f"{self.home}/flat")


def ingest_exports(
    spark: SparkSession,
    root: str,
    table: str,
    checkpoint: str,
    date_formats: Iterable[str] = (),
    settle_seconds: int = 0,
    as_of: AsOf = None,
    versioned: bool = False,
    rollups: Iterable[str] = (),
    manifests: bool = False,
) -> StreamingQuery:
    """Process the files that arrived since the last call, then stop (ST-01).

    The stream only says *which* periods changed; it reads no file content.  The
    table is partitioned by export and period, so a changed month is replaced
    without touching the others.  Files that a reseller's export overwrites in place
    are found by their time, and runs passed over as unsettled or incomplete are tried again, both
    before the stream starts.  The caller waits with ``awaitTermination()``.

    With ``versioned`` the months of a batch are published together, read the table with
    :func:`costlens.streaming.version_log.read_version`.  The ``rollups`` named are brought in step after
    every batch, and before the first one in case an earlier call died on the way.
    """
    formats, rollups = tuple(date_formats), tuple(rollups)
    if rollups and not versioned:
        raise ValueError("rollups need a versioned table")
    refresh_rollups(spark, table, rollups)
    state = _State(spark, checkpoint)

    def refresh(keys: DataFrame, session: SparkSession = spark) -> None:
        for left in range(CONFLICTS, -1, -1):
            try:
                waiting = refresh_periods(keys, table, formats, settle_seconds, as_of, versioned, manifests)
                break
            except Conflict:
                if not left:
                    raise
        refresh_rollups(session, table, rollups)
        touched = {_key(r) for r in keys.select(*_KEYS).distinct().collect()}
        _State(session, checkpoint).note(touched, waiting)

    again = state.pending() | state.overwritten(root)
    if again:
        refresh(spark.createDataFrame(sorted(again), f"{EXPORT_SCOPE} string, {EXPORT_PERIOD} string"))
    state.keep_versions()
    arrivals = (
        spark.readStream.format("binaryFile")
        .schema(_FILES)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", CSV_GLOB)
        .load(root)
        .select(
            scope_of("_metadata.file_path").alias(EXPORT_SCOPE),
            period_of("_metadata.file_path").alias(EXPORT_PERIOD),
        )
    )
    return (
        arrivals.writeStream.foreachBatch(lambda batch, _: refresh(batch, batch.sparkSession))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
