"""Partial sums of a versioned table, kept in step month by month (Q-11 .. Q-23).

A rollup is a smaller table of charges: rows that agree in its keys are added up, and
the columns keep their names; a month's files are clustered by customer.  So the reports of :mod:`costlens.plans.focus_reports` run on it as
they are: a sum of partial sums is the sum, and a distinct count is exact as long as what it
counts is one of the keys.

    rollups/<name>/data/<export>/<period>/write=<own id>-<id of the charges' folder>
    rollups/<name>/versions/<number>.json

A rollup folder is a function of one charges folder, which never changes, and bears its id.
Comparing two manifests therefore says which months are out of step; only those are read again,
and a refresh that died or was left out is made up for by the next one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from costlens.functions.columns import total, untagged
from costlens.sources.schema import CANONICAL_SCHEMA
from costlens.sources.tables import write_table
from costlens.streaming.version_log import KEYS, WRITE, Conflict, Key, VersionLog, read_folders

TAGGED = "tagged"
CHARGES = "ChargeCount"
# Times a refresh is repeated because another job published the same months meanwhile.
CONFLICTS = 5
#: Share of the charges that must be left as sums for adding them up in one place only.
FEW_MEET = 0.8
#: Bits of the hash that a customer's charges are dealt by.
DEALT = 0xFFFF
#: Bytes of charges' files that are added up at a time; their shuffle takes up to three times as much.
PORTION_BYTES = 2**30
#: Number of a folder while its charges are added up, which a shuffle moves instead of its long names.
FOLDER = "folder"


@dataclass(frozen=True)
class Rollup:
    """What rows are added up by, and what is added up.

    ``apart`` are summed columns whose differences are summed too: rows that lack one are kept
    apart from rows that have it, so the difference of two sums is the sum of the differences.
    """

    keys: tuple[str, ...]
    sums: tuple[str, ...]
    apart: tuple[str, ...] = ()

    @property
    def charge_columns(self) -> list[StructField]:
        return [CANONICAL_SCHEMA[c] for c in (*self.keys, *self.sums)]

    @property
    def columns(self) -> list[StructField]:
        wide = CANONICAL_SCHEMA["BilledCost"].dataType.__class__(38, 6)
        return [
            *[CANONICAL_SCHEMA[c] for c in self.keys],
            *[StructField(c, wide) for c in self.sums],
            StructField(CHARGES, LongType()),
        ]

    def _keyed(self, rows: DataFrame, also: Iterable[str]) -> tuple[DataFrame, list[str]]:
        """Rows with all that they are grouped by as columns, and the names of these."""
        if "Tags" in self.keys:
            rows = rows.withColumn("Tags", F.when(~untagged(), F.lit(TAGGED)))
        rows = rows.withColumns({f"no_{c}": F.col(c).isNull() for c in self.apart})
        return rows, [*also, *self.keys, *[f"no_{c}" for c in self.apart]]

    def partials(self, rows: DataFrame, also: Iterable[str] = (), dealt_by: Iterable[str] = ()) -> DataFrame:
        """One row per combination of keys; ``Tags`` only says whether there are any.

        With ``dealt_by``, some of the columns grouped by, rows are dealt by ranges of those, and within
        them of all that they are grouped by, and are added up there: sums lie clustered without another
        shuffle, but no task adds up rows before this one.
        """
        rows, by = self._keyed(rows, also)
        if dealt_by:
            # It follows from the others, so the groups are the same.
            rows, by = rows.withColumn("dealt", F.xxhash64(*by).bitwiseAND(F.lit(DEALT)).cast("int")), [*by, "dealt"]
            rows = rows.repartitionByRange(*dealt_by, "dealt")
        sums = rows.groupBy(*by).agg(*[total(c).alias(c) for c in self.sums], F.count("*").alias(CHARGES))
        return sums.drop("dealt", *[f"no_{c}" for c in self.apart])

    def few_meet(self, rows: DataFrame, also: Iterable[str] = ()) -> bool:
        """Whether sums are nearly as many as the charges, so that no task needs to add up any before a shuffle.

        No group then has more than the rest of the charges, about a fifth.
        """
        rows, by = self._keyed(rows, also)
        groups = F.approx_count_distinct(F.xxhash64(*by), 0.02)
        return rows.agg(groups >= FEW_MEET * F.count("*")).first()[0]


_PERIOD = "BillingPeriodStart"
_CUSTOMER = (_PERIOD, "BillingCurrency", "SubAccountId", "SubAccountName", "ServiceCategory", "ServiceName")

#: The rollups by name, and the reports that each one answers.
ROLLUPS = {
    # Q-12a, Q-17, Q-18, Q-20, Q-22, Q-23
    "customers": Rollup(
        (*_CUSTOMER, "CommitmentDiscountId", "ChargeCategory", "PricingCategory"),
        ("BilledCost", "EffectiveCost", "ListCost", "ContractedCost"),
        apart=("ListCost", "EffectiveCost"),
    ),
    # Q-11 to Q-16, Q-19, Q-21
    "resources": Rollup(
        (*_CUSTOMER, "RegionName", "ResourceId", "ResourceName", "ResourceType", "ConsumedUnit", "Tags"),
        ("BilledCost", "EffectiveCost", "ConsumedQuantity"),
    ),
    # Q-12b
    "days": Rollup(
        (_PERIOD, "ChargePeriodStart", "BillingCurrency", "SubAccountId", "ResourceId"),
        ("BilledCost", "EffectiveCost"),
    ),
}


def _log(spark: SparkSession, table: str, name: str) -> VersionLog:
    return VersionLog(spark, f"{table.rstrip('/')}/rollups/{name}")


def _source(folder: str) -> str:
    """The id of the charges' folder that a folder holds, or holds the sums of."""
    return folder.rsplit("=", 1)[1].rsplit("-", 1)[-1]


def _sources(manifest: dict[Key, str]) -> dict[Key, str]:
    return {k: _source(f) for k, f in manifest.items()}


def _portions(charges: VersionLog, folders: Iterable[str]) -> list[list[str]]:
    """Folders in portions of ``PORTION_BYTES`` at most, or of one folder."""
    portions, room = [], 0
    for folder in sorted(folders):
        size = charges.size_of(folder)
        if size > room or not portions:
            portions.append([])
            room = PORTION_BYTES
        portions[-1].append(folder)
        room -= size
    return portions


def _add_up(charges: VersionLog, own: VersionLog, rollup: Rollup, folders: list[str], write: str) -> None:
    """Write the sums of some of the charges' folders; no manifest names them yet."""
    spark, names, customer = charges.spark, (*KEYS, WRITE), ("SubAccountId",)
    numbered = [(i, *charges.values_of(f)) for i, f in enumerate(folders)]
    numbers = F.broadcast(spark.createDataFrame(numbered, f"{FOLDER} int, {', '.join(f'{c} string' for c in names)}"))
    rows = read_folders(charges, folders, rollup.charge_columns)
    of_folder = reduce(and_, [rows[c].eqNullSafe(numbers[c]) for c in names])
    rows = rows.join(numbers, of_folder).select(FOLDER, *[c.name for c in rollup.charge_columns])
    dealt = rollup.few_meet(rows, [FOLDER])
    sums = rollup.partials(rows, [FOLDER], dealt_by=(FOLDER, *customer) if dealt else ())
    sums = sums.join(numbers, FOLDER).drop(FOLDER)
    sums = sums.withColumn(WRITE, F.concat(F.lit(f"{write}-"), F.col(WRITE)))
    write_table(sums, own.data, names, mode="append", cluster_by=customer, dealt=dealt)


def _refresh(charges: VersionLog, name: str) -> None:
    own = _log(charges.spark, charges.table, name)
    base = own.latest()
    known, now = own.manifest(base), charges.manifest(charges.latest())
    has, wanted = _sources(known), _sources(now)
    stale = {k: f for k, f in now.items() if has.get(k) != wanted[k]}
    gone = known.keys() - now.keys()
    write = uuid.uuid4().hex
    for folders in _portions(charges, stale.values()):
        _add_up(charges, own, ROLLUPS[name], folders, write)
    filled = {k: f.replace(f"/{WRITE}=", f"/{WRITE}={write}-") for k, f in stale.items()}
    if filled or gone:
        own.commit(base, filled, gone)


def refresh_rollups(spark: SparkSession, table: str, names: Iterable[str] = tuple(ROLLUPS)) -> None:
    """Bring rollups in step with the newest version of a table.

    Reads the charges of months that were published since, and no others.
    """
    charges = VersionLog(spark, table)
    for name in names:
        for left in range(CONFLICTS, -1, -1):
            try:
                _refresh(charges, name)
                break
            except Conflict:
                if not left:
                    raise


def read_rollup(
    spark: SparkSession, table: str, name: str, version: int | None = None, since: date | None = None
) -> DataFrame:
    """A rollup as a table of charges with fewer rows; reports run on it as on the table.

    The newest state by default, which is that of a whole version of the table though not
    always of the newest.  With ``version`` the sums of just that version; ``LookupError`` if the
    rollup never was in step with it.  ``since`` leaves out export periods that began before that day.
    """
    own = _log(spark, table, name)
    held = own.manifest(own.latest())
    if version is not None:
        wanted = _sources(VersionLog(spark, table).manifest(version))
        states = (own.manifest(v) for v in [*reversed(own.versions()), 0])
        held = next((m for m in states if _sources(m) == wanted), None)
        if held is None:
            raise LookupError(f"rollup {name} was never in step with version {version}")
    # ``current``, the period of undated folders, sorts after every date.
    folders = [f for (_, period), f in held.items() if not since or period >= f"{since:%Y%m%d}"]
    return read_folders(own, folders, ROLLUPS[name].columns).drop(WRITE)
