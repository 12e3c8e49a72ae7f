import csv
import gzip
import os
from pathlib import Path

from pyspark.sql import DataFrame


def put_csv(path, header, rows, gz=False, age=0):
    """A CSV file as an export writes it; ``age`` seconds old."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    opener = gzip.open if gz else open
    with opener(path, "wt", encoding="utf-8", newline="") as f:
        writer = csv.writer(f, lineterminator="\n")
        if header:
            writer.writerow(header)
        writer.writerows(rows)
    if age:
        moment = path.stat().st_mtime - age
        os.utime(path, (moment, moment))
    return path


def plan_of(df: DataFrame) -> str:
    return df._jdf.queryExecution().toString()


def physical(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
