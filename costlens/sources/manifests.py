"""Runs that say themselves when they are complete (O-05, O-09).

A run is written in two steps: its parts, then a manifest that names how many there are
and how many bytes they hold.  A run is taken once the parts found agree with its manifest, so
a half-written one is passed over however old its files are, without a waiting time.
A run without a readable manifest is not complete; folders without date range have no
runs and are taken as they are.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costlens.sources.exports import RUN_DIR, list_export_files
from costlens.sources.schema import EXPORT_PERIOD, FLAT_PERIOD

# The manifest's name and the fields that are read.
MANIFEST = "manifest.json"
PARTS, BYTES = "blobCount", "byteCount"


def publish_runs(spark: SparkSession, root: str) -> int:
    """Write the manifest of every run below ``root`` that lacks one; the number written.

    To be called by whoever wrote the runs, after their last part.  A manifest appears whole, by a
    rename.  One row a run reaches the driver.
    """
    files = list_export_files(spark, root).where(F.col(EXPORT_PERIOD) != FLAT_PERIOD)
    runs = files.groupBy(F.regexp_extract("path", RUN_DIR, 1).alias("folder")).agg(
        F.count("*").alias(PARTS), F.sum("length").alias(BYTES)
    )
    fs, conf, written = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration(), 0
    for r in runs.collect():
        folder = fs.Path(r["folder"])
        system, place = folder.getFileSystem(conf), fs.Path(folder, MANIFEST)
        if system.exists(place):
            continue
        draft = fs.Path(folder, f"_{uuid.uuid4().hex}")
        out = system.create(draft, False)
        out.write(json.dumps({PARTS: r[PARTS], BYTES: r[BYTES]}).encode())
        out.close()
        written += bool(system.rename(draft, place))
    return written


def _manifests(spark: SparkSession, folders: list[str]) -> DataFrame:
    """The manifest of each run folder; null fields where it can't be read."""
    fields = F.from_json(F.col("content").cast("string"), f"{PARTS} bigint, {BYTES} bigint")
    try:
        found = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", MANIFEST)
            .load(folders)
        )
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"folder string, {PARTS} bigint, {BYTES} bigint")
    folder = F.regexp_extract("path", RUN_DIR, 1).alias("folder")
    return found.select(folder, fields.alias("m")).select("folder", f"m.{PARTS}", f"m.{BYTES}")


def complete_only(files: DataFrame) -> DataFrame:
    """Of a listing (:func:`costlens.sources.exports.list_export_files`) the files of complete runs.

    Manifests are looked for in the folders of the listing's runs, which the driver holds.
    """
    spark = files.sparkSession
    folder = F.regexp_extract("path", RUN_DIR, 1).alias("folder")
    dated = files.where(F.col(EXPORT_PERIOD) != FLAT_PERIOD)
    runs = dated.groupBy(folder, "run_path").agg(F.count("*").alias("parts"), F.sum("length").alias("bytes"))
    # run_path is the folder as a pattern that matches only itself
    places = [r["run_path"] for r in runs.select("run_path").collect()]
    if not places:
        return files
    whole = runs.join(_manifests(spark, places), "folder").where(f"parts = {PARTS} and bytes = {BYTES}")
    kept = dated.join(whole.select("run_path"), "run_path", "left_semi").select(*files.columns)
    return files.where(F.col(EXPORT_PERIOD) == FLAT_PERIOD).unionByName(kept)
