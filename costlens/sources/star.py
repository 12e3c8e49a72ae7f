"""Billing rows derived from an order-and-lineitem star schema.

Used to check and time the reports on tables that are not billing exports.  A
line item is a charge, an order's customer is the sub account, a part is the
resource.  Dimension keys are unique, so LEFT joins keep every charge exactly
once, and a dimension none of the requested columns needs is not joined.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from costlens.functions.columns import MONEY
from costlens.sources.normalize import normalize
from costlens.sources.schema import CANONICAL_SCHEMA, DATE_RAW

# Columns are read by name; stating them avoids a schema job per table.  Dates are
# read as instants, whose bounds Spark can compare with row-group statistics.
_TABLES = {
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp"
    ),
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}

_LIST = "cast(l_extendedprice AS decimal(12,2))"
_EFFECTIVE = f"{_LIST} * (cast(1 AS decimal(3,2)) - cast(l_discount AS decimal(3,2)))"
_BILLED = f"{_EFFECTIVE} * (cast(1 AS decimal(3,2)) + cast(l_tax AS decimal(3,2)))"

_COMMITTED = "l_discount >= 0.08"

# canonical column -> (expression, tables it needs besides lineitem)
_FOCUS = {
    "BillingPeriodStart": ("date_trunc('MM', l_shipdate)", ()),
    "ChargePeriodStart": ("l_shipdate", ()),
    # Ids, services and currencies come in two spellings each, as real exports mix them.
    "SubAccountId": ("concat(if(l_linenumber % 2 = 0, 'T-', 't-'), o_custkey)", ("orders",)),
    "SubAccountName": ("c_name", ("orders", "customer")),
    "ServiceCategory": ("p_type", ("part",)),
    "ServiceName": ("if(l_linenumber % 2 = 0, upper(p_brand), p_brand)", ("part",)),
    "ResourceId": ("concat('/res/', l_partkey)", ()),
    "ResourceName": ("p_name", ("part",)),
    "ResourceType": ("cast(p_size AS string)", ("part",)),
    "RegionName": (
        "nullif(r_name, 'MIDDLE EAST')",
        ("orders", "customer", "nation", "region"),
    ),
    "x_ResourceGroupName": ("n_name", ("orders", "customer", "nation")),
    "BillingCurrency": ("if(l_linenumber % 3 = 0, 'EUR', 'USD')", ()),
    "ListCost": (f"cast({_LIST} AS {MONEY})", ()),
    "EffectiveCost": (f"cast({_EFFECTIVE} AS {MONEY})", ()),
    "ContractedCost": (f"cast({_LIST} * cast(0.95 AS decimal(3,2)) AS {MONEY})", ()),
    "BilledCost": (f"cast({_BILLED} AS {MONEY})", ()),
    "ConsumedQuantity": (f"cast(l_quantity AS {MONEY})", ()),
    "ConsumedUnit": ("l_linestatus", ()),
    "ChargeCategory": ("l_returnflag", ()),
    "PricingCategory": ("o_orderpriority", ("orders",)),
    "CommitmentDiscountId": (f"if({_COMMITTED}, concat('ri-', l_suppkey), null)", ()),
    "Tags": (
        "CASE WHEN l_returnflag = 'N' THEN NULL WHEN l_returnflag = 'R' THEN '{}' "
        "WHEN l_linestatus = 'O' THEN '' ELSE '{\"env\":\"prod\"}' END",
        (),
    ),
}

FOCUS_STAR_COLUMNS = tuple(_FOCUS)

_DAYS = ("BillingPeriodStart", "ChargePeriodStart")
# Costs that an intermediate table needn't hold, and what they are derived from, which takes less.
_DERIVABLE = ("ListCost", "EffectiveCost", "ContractedCost")
_COST_PARTS = {"l_extendedprice": _LIST, "l_discount": "cast(l_discount AS decimal(3,2))"}

# provider-specific column -> the same, with text as dirty as real exports have it
_LEGACY = {
    "date": (
        "CASE WHEN l_linenumber = 7 AND l_returnflag = 'A' THEN 'date' "
        "WHEN l_linenumber = 6 AND l_returnflag = 'R' THEN NULL "
        "WHEN l_linenumber = 5 AND l_returnflag = 'R' THEN 'bad' "
        "ELSE date_format(l_shipdate, 'yyyy-MM-dd') END",
        (),
    ),
    "costInUsd": (
        "CASE WHEN l_linenumber = 4 AND l_returnflag = 'N' THEN 'n/a' "
        f"ELSE cast({_LIST} AS string) END",
        (),
    ),
    "ResourceId": (
        "CASE WHEN l_linenumber = 3 AND l_returnflag = 'A' THEN '' "
        "WHEN l_linenumber = 2 AND l_returnflag = 'A' THEN NULL "
        "ELSE concat(if(l_linenumber % 2 = 0, '/RES/', '/res/'), l_partkey) END",
        (),
    ),
    "resourceGroupName": _FOCUS["x_ResourceGroupName"],
    "serviceFamily": _FOCUS["ServiceCategory"],
    "resourceLocation": _FOCUS["RegionName"],
    "costInBillingCurrency": (f"cast({_LIST} AS string)", ()),
    "billingCurrency": _FOCUS["BillingCurrency"],
    "SubscriptionId": _FOCUS["SubAccountId"],
    "subscriptionName": _FOCUS["SubAccountName"],
    "consumedService": _FOCUS["ServiceName"],
    "billingPeriodStartDate": ("date_format(date_trunc('MM', l_shipdate), 'yyyy-MM-dd')", ()),
}
# What a report over this vocabulary reads; the rest is for the open one's reports.
LEGACY_STAR_COLUMNS = tuple(_LEGACY)[:6]


# Line-item columns of which most rows hold few values: bits, the value as a number below two to the
# power of these, and the value of such a number {n}.  63 bits in all, so the sum of all isn't negative.
_FEW_BITS = {
    "l_linenumber": (7, "cast(l_linenumber AS bigint)", "cast({n} AS int)"),
    "l_quantity": (12, "try_cast(l_quantity AS bigint)", "cast({n} AS double)"),
    "l_discount": (7, "try_cast(round(l_discount * 100) AS bigint)", "{n} / 100D"),
    "l_tax": (7, "try_cast(round(l_tax * 100) AS bigint)", "{n} / 100D"),
    "l_returnflag": (7, "cast(ascii(l_returnflag) AS bigint)", "chr({n})"),
    "l_linestatus": (7, "cast(ascii(l_linestatus) AS bigint)", "chr({n})"),
    "l_shipdate": (16, "cast(unix_date(cast(l_shipdate AS date)) AS bigint)", "cast(date_from_unix_date(cast({n} AS int)) AS timestamp)"),
}


def _packed(rows: DataFrame) -> DataFrame:
    """Line items for a shuffle: the columns of few bits in one number if all of a row fit exactly, else as they are.

    A shuffle writes rows, not columns, and takes eight bytes or more of each value.  A supplier is
    kept only where a commitment names it, a price in the hundredths that all costs are derived from.
    """
    fits, code, shift = [], [], 0
    for c, (bits, number, value) in _FEW_BITS.items():
        fits.append(f"{number} BETWEEN 0 AND {2**bits - 1} AND {value.format(n=number)} = {c}")
        code.append(f"shiftleft({number}, {shift})")
        shift += bits
    rows = rows.withColumn("few_bits", F.expr(f"CASE WHEN {' AND '.join(fits)} THEN {' + '.join(code)} END"))
    return rows.selectExpr(
        "l_orderkey",
        "l_partkey",
        f"if({_COMMITTED}, l_suppkey, NULL) AS l_suppkey",
        f"{_LIST} AS l_extendedprice",
        "few_bits",
        f"if(few_bits IS NULL, struct({', '.join(_FEW_BITS)}), NULL) AS as_is",
    )


def _unpacked(rows: DataFrame) -> DataFrame:
    """The columns of :func:`_packed` rows beside their others."""
    columns, shift = {}, 0
    for c, (bits, _, value) in _FEW_BITS.items():
        number = f"(shiftrightunsigned(few_bits, {shift}) & {2**bits - 1}L)"
        columns[c] = F.expr(f"if(few_bits IS NULL, as_is.{c}, {value.format(n=number)})")
        shift += bits
    return rows.withColumns(columns).drop("few_bits", "as_is")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(_TABLES[table]).parquet(f"{sf_dir}/{table}.parquet")


def _charges(
    spark: SparkSession,
    sf_dir: str,
    needed: set[str],
    used_from: str | None = None,
    used_before: str | None = None,
    packed: bool = False,
    used: Column | None = None,
) -> DataFrame:
    """Line items in a span of days, joined to the needed tables only.

    Of whole tables orders are joined to their customers first, so line items, the largest, are
    shuffled once for all of these columns and once for the parts, and the names of nations and regions,
    of which there are few, come last; a span of days is the smaller side, and takes one table after the other.
    ``packed`` line items are half as wide on these two ways; all of their columns are needed then.
    ``used`` is a condition on the days and periods of charges, which is met before that.

    No join hints: which side is small enough to broadcast is decided by Spark
    from its measured size, and skewed keys are split by adaptive execution.
    """
    rows = _read(spark, sf_dir, "lineitem")
    if used is not None:
        rows = rows.withColumns({c: F.expr(_FOCUS[c][0]) for c in _DAYS}).where(used).drop(*_DAYS)
    if packed:
        rows = _packed(rows)
    if used_from:
        rows = rows.filter(F.col("l_shipdate") >= F.lit(used_from).cast("timestamp"))
    if used_before:
        rows = rows.filter(F.col("l_shipdate") < F.lit(used_before).cast("timestamp"))
    of_order = {"customer": "o_custkey = c_custkey"}
    places = {"nation": "c_nationkey = n_nationkey", "region": "n_regionkey = r_regionkey"}

    def joined(left: DataFrame, joins: dict[str, str]) -> DataFrame:
        for table, on in joins.items():
            if table in needed:
                left = left.join(_read(spark, sf_dir, table), F.expr(on), "left")
        return left

    part, order = {"part": "l_partkey = p_partkey"}, "l_orderkey = o_orderkey"
    if used_from or used_before:
        return joined(rows, {"orders": order, **of_order, **part, **places})
    if "orders" in needed:
        rows = rows.join(joined(_read(spark, sf_dir, "orders"), of_order), F.expr(order), "left")
    rows = joined(rows, {**part, **places})
    return _unpacked(rows) if packed else rows


def focus_rows(
    spark: SparkSession,
    sf_dir: str,
    columns: Iterable[str] | None = None,
    used_from: str | None = None,
    used_before: str | None = None,
    dealt_by: str | None = None,
) -> DataFrame:
    """Charges with the given canonical columns; with all of them, typed, by default.

    ``dealt_by`` brings the rows of a value of that column together, such as a billing period's: the
    joined rows are shuffled, which are half as wide as the columns derived from them.
    """
    wanted = list(columns) if columns is not None else [c for c in _TYPES if c != DATE_RAW]
    needed = {t for c in wanted for t in _FOCUS.get(c, ("", ()))[1]}
    rows = _charges(spark, sf_dir, needed, used_from, used_before)
    if dealt_by:
        rows = rows.withColumn("dealt_by", F.expr(_FOCUS[dealt_by][0])).hint("rebalance", "dealt_by")
    return rows.selectExpr(*[_derived(c) for c in wanted])


_TYPES = {f.name: f.dataType for f in CANONICAL_SCHEMA}


def _derived(c: str) -> str:
    return f"cast({_FOCUS[c][0] if c in _FOCUS else 'NULL'} AS {_TYPES[c].simpleString()}) AS {c}"


def narrow_rows(spark: SparkSession, sf_dir: str, used: Column | None = None) -> DataFrame:
    """Whole charges for an intermediate table: the star's canonical columns, three costs of them as what they are derived from.

    ``used`` is a condition on the days and periods of the charges that are wanted.
    """
    rows = _charges(spark, sf_dir, {t for _, tables in _FOCUS.values() for t in tables}, packed=True, used=used)
    parts = [f"{e} AS {c}" for c, e in _COST_PARTS.items()]
    return rows.selectExpr(*[_derived(c) for c in _FOCUS if c not in _DERIVABLE], *parts)


def widened(rows: DataFrame) -> DataFrame:
    """The star's canonical columns of :func:`narrow_rows`."""
    return rows.selectExpr(*[_derived(c) if c in _DERIVABLE else c for c in _FOCUS])


def legacy_text(
    spark: SparkSession,
    sf_dir: str,
    columns: Iterable[str] | None = None,
    used_from: str | None = None,
    used_before: str | None = None,
) -> DataFrame:
    """Charges as a provider-specific export holds them: text, partly unreadable."""
    wanted = list(columns) if columns is not None else list(LEGACY_STAR_COLUMNS)
    needed = {t for c in wanted for t in _LEGACY[c][1]}
    rows = _charges(spark, sf_dir, needed, used_from, used_before)
    return rows.selectExpr(*[f"{_LEGACY[c][0]} AS `{c}`" for c in wanted])


def legacy_rows(spark: SparkSession, sf_dir: str, *args, **kwargs) -> DataFrame:
    """The same after ``normalize``."""
    return normalize(legacy_text(spark, sf_dir, *args, **kwargs))
