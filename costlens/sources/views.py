"""Views, previews and checks on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def publish_view(df: DataFrame, name: str) -> DataFrame:
    """Create or replace a view for SQL users (O-15)."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def drop_view(spark: SparkSession, name: str) -> bool:
    """Drop a view if it exists (O-15)."""
    return spark.catalog.dropTempView(name)


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    """Any ``n`` rows (O-16, S-05)."""
    return df.limit(n)


def row_count(df: DataFrame) -> DataFrame:
    """Number of rows as a one-row frame (O-17)."""
    return df.agg(F.count("*").alias("row_count"))


def list_databases(spark: SparkSession) -> DataFrame:
    """Names of the databases in the catalog (O-18)."""
    return spark.sql("SHOW DATABASES").select(F.col("namespace").alias("database_name"))


def health_report(spark: SparkSession, view: str, database: str = "default") -> DataFrame:
    """Does the database exist, does the view exist, how many rows has it (O-17, O-18).

    The row count is part of the returned plan; errors in the view surface
    when the report is read instead of being swallowed.
    """
    has_database = spark.catalog.databaseExists(database)
    has_view = spark.catalog.tableExists(view)

    def check(name: str, ok: bool) -> DataFrame:
        return spark.range(1).select(
            F.lit(name).alias("check_name"),
            F.lit(ok).alias("ok"),
            F.lit(None).cast("bigint").alias("row_count"),
        )

    checks = [check("database_exists", has_database), check("view_exists", has_view)]
    if has_view:
        checks.append(
            row_count(spark.table(view)).select(
                F.lit("view_has_rows").alias("check_name"),
                (F.col("row_count") > 0).alias("ok"),
                "row_count",
            )
        )
    return reduce(DataFrame.unionByName, checks)
