"""Edge rows of the reports, and the plans they must have."""

from collections import defaultdict
from datetime import date
from decimal import Decimal

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from costlens.operators.absent import may_be_listed, rows_absent
from costlens.operators.dataset import as_dataset
from costlens.operators.dedup import latest_snapshot
from costlens.operators.rollup import cost_rollup
from costlens.plans import focus_reports as focus
from costlens.plans import usage_reports as usage
from costlens.sources.normalize import normalize
from costlens.sources.star import focus_rows, legacy_rows
from tests.helpers import physical, plan_of

AS_OF = "2024-10-15 00:00:00"


def billing(spark, columns, *rows):
    """Canonical rows from text."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return normalize(spark.createDataFrame([tuple(r) for r in rows], schema))


def numbers(values):
    return [None if v is None else float(v) for v in values]


# -- month over month -------------------------------------------------------------

MONTHS = ["SubAccountName", "BillingPeriodStart", "BilledCost"]
SPEND = [
    ("both", "2024-10-01", "30"),
    ("both", "2024-09-01", "20"),
    ("gone", "2024-09-01", "5"),
    ("new", "2024-10-01", "7"),
    (None, "2024-10-01", "1"),
    (None, "2024-09-01", "2"),
    ("free", "2024-09-01", "0"),
    ("free", "2024-10-01", "4"),
    ("unread", "2024-10-01", "x"),
    ("unread", "2024-09-01", "8"),
    ("late", "2024-11-01", "9"),
    ("early", "2024-08-31", "9"),
]


def literal_join(df):
    """The report as it is written in SQL: two aggregates and a full outer join."""
    df.createOrReplaceTempView("spend")
    side = """SELECT SubAccountName AS n, SUM(BilledCost) AS c FROM spend
              WHERE month(BillingPeriodStart) = {m} AND year(BillingPeriodStart) = 2024
              GROUP BY SubAccountName"""
    return df.sparkSession.sql(f"""
        SELECT coalesce(c.n, p.n), coalesce(p.c, 0), coalesce(c.c, 0),
               coalesce(c.c, 0) - coalesce(p.c, 0),
               CASE WHEN p.c > 0 THEN cast(c.c - p.c AS double) / cast(p.c AS double) * 100 ELSE 0 END
        FROM ({side.format(m=10)}) c FULL OUTER JOIN ({side.format(m=9)}) p ON c.n = p.n""")


def test_month_over_month_equals_the_full_outer_join(spark):
    df = billing(spark, MONTHS, *SPEND)
    got = focus.month_over_month(df, AS_OF)
    want = literal_join(df).collect()
    key = lambda r: (str(r[0]), *numbers(r[1:4]))
    rows = [(r[0], *numbers(r[1:])) for r in sorted(got.collect(), key=key)]
    assert rows == [(r[0], *numbers(r[1:])) for r in sorted(want, key=key)]
    by_name = {r[0]: r[1:] for r in rows if r[0]}
    assert by_name["gone"] == (5, 0, -5, None)
    assert by_name["new"] == (0, 7, 7, 0)
    assert by_name["free"] == (0, 4, 4, 0)
    assert by_name["unread"] == (8, 0, -8, None)
    assert "late" not in by_name and "early" not in by_name
    assert len([r for r in rows if r[0] is None]) == 2


def test_month_over_month_across_a_year_end(spark):
    df = billing(spark, MONTHS, ("a", "2023-12-01", "1"), ("a", "2024-01-01", "3"), ("a", "2023-01-01", "9"))
    assert numbers(focus.month_over_month(df, "2024-01-31").first()[1:]) == [1, 3, 2, 200]


def test_month_over_month_by_currency(spark):
    df = billing(
        spark,
        [*MONTHS, "BillingCurrency"],
        ("a", "2024-10-01", "1", "EUR"),
        ("a", "2024-09-01", "2", "USD"),
        ("a", "2024-10-01", "4", "USD"),
        ("a", "2024-09-01", "8", None),
        ("a", "2024-10-01", "16", None),
    )
    got = {(r[1], *numbers(r[2:4])) for r in focus.month_over_month(df, AS_OF, by_currency=True).collect()}
    assert got == {("EUR", 0, 1), ("USD", 2, 4), (None, 8, 0), (None, 0, 16)}


def test_month_over_month_is_one_scan_and_one_grouping(spark, sf_dir):
    df = focus_rows(spark, sf_dir, ["BillingPeriodStart", "SubAccountId", "SubAccountName", "BilledCost"])
    plan = physical(focus.month_over_month(df, "2001-10-15"))
    assert plan.count("lineitem.parquet") == 1
    assert "FullOuter" not in plan


# -- other open-vocabulary reports ----------------------------------------------------


def test_discount_needs_a_positive_list_cost(spark):
    df = billing(
        spark,
        ["SubAccountName", "BillingPeriodStart", "ListCost", "EffectiveCost"],
        ("half", "2024-10-01", "10", "5"),
        ("zero", "2024-10-01", "0", "5"),
        ("negative", "2024-10-01", "-3", "1"),
        ("no list", "2024-10-01", None, "1"),
        ("no effective", "2024-10-01", "4", None),
        ("mixed", "2024-10-01", "4", "1"),
        ("mixed", "2024-10-01", None, "1"),
    )
    got = {
        r["CustomerName"]: numbers((r["TotalSavings"], r["DiscountPercentage"]))
        for r in focus.discount_analysis(df, AS_OF).collect()
    }
    assert got["half"] == [5, 50]
    assert got["zero"] == [-5, 0]
    assert got["negative"] == [-4, 0]
    assert got["no list"] == [None, 0]
    assert got["no effective"] == [None, None]
    # The incomplete row counts in the totals but not in the savings.
    assert got["mixed"] == [3, 50]


def test_untagged_forms(spark):
    tags = [None, "", "{}", '{"a":"b"}', " "]
    df = billing(
        spark,
        ["ResourceId", "BillingPeriodStart", "BilledCost", "Tags"],
        *[(str(i), "2024-10-01", "1", t) for i, t in enumerate(tags)],
    )
    got = focus.untagged_resources(df, AS_OF).collect()
    assert sorted(r["ResourceId"] for r in got) == ["0", "1", "2"]


def test_period_and_charge_days_differ(spark):
    df = billing(
        spark,
        ["BillingPeriodStart", "ChargePeriodStart", "BilledCost"],
        ("2024-10-01", "2024-10-02", "1"),
        ("2024-10-01", "2024-10-03", "2"),
    )
    by_period = focus.daily_trend(df, AS_OF).collect()
    by_charge = focus.daily_trend(df, AS_OF, date_col="ChargePeriodStart").collect()
    assert [r["Date"] for r in by_period] == [date(2024, 10, 1)]
    assert [r["Date"] for r in by_charge] == [date(2024, 10, 3), date(2024, 10, 2)]


def test_customer_id_is_a_value_not_sql(spark):
    df = billing(
        spark,
        ["SubAccountId", "BillingPeriodStart", "BilledCost"],
        ("a", "2024-10-01", "1"),
        ("b' OR '1'='1", "2024-10-01", "2"),
    )
    assert numbers([focus.customer_trend(df, "b' OR '1'='1", AS_OF).first()["DailyCost"]]) == [2]
    assert focus.customer_trend(df, "x' OR '1'='1", AS_OF).count() == 0


def test_currencies_can_be_kept_apart(spark):
    df = billing(
        spark,
        ["ServiceName", "BillingCurrency", "BillingPeriodStart", "BilledCost"],
        ("s", "USD", "2024-10-01", "1"),
        ("s", "EUR", "2024-10-01", "2"),
    )
    assert focus.service_breakdown(df, AS_OF).count() == 1
    assert focus.service_breakdown(df, AS_OF, by_currency=True).count() == 2


def test_case_can_be_folded(spark):
    df = billing(
        spark,
        ["ServiceName", "SubAccountId", "BillingPeriodStart", "BilledCost"],
        ("Vm", "A", "2024-10-01", "1"),
        ("VM", "a", "2024-10-01", "2"),
    )
    assert focus.service_breakdown(df, AS_OF).count() == 2
    folded = focus.service_breakdown(df, AS_OF, fold_case=True)
    assert [tuple(r) for r in folded.collect()] == [(None, "VM", Decimal(3), 1)]
    assert "SortAggregate" not in physical(df.groupBy(F.lower("ServiceName")).count())


def test_approximate_counts_are_close(spark, sf_dir):
    df = focus_rows(spark, sf_dir, ["ServiceCategory", "ResourceId", "BilledCost"])
    exact, approx = (
        cost_rollup(df, {"k": "ServiceCategory"}, {"s": "BilledCost"}, {"n": "ResourceId"}, approx=a)
        for a in (False, True)
    )
    n = {r["k"]: r["n"] for r in exact.collect()}
    assert all(abs(r["n"] - n[r["k"]]) <= 0.2 * n[r["k"]] for r in approx.collect())


def test_top_customers_plan(spark, sf_dir):
    df = normalize(focus_rows(spark, sf_dir))
    assert "TakeOrderedAndProject" in physical(focus.top10_customers(df, "2001-10-15"))


def test_only_needed_dimensions_are_joined(spark, sf_dir):
    plan = physical(focus_rows(spark, sf_dir, ["BillingPeriodStart", "BilledCost"]))
    assert "Join" not in plan and "orders.parquet" not in plan


def test_scan_gets_bounds_and_columns(spark, sf_dir):
    rows = focus_rows(spark, sf_dir, ["BillingPeriodStart", "BilledCost"], "2001-09-15")
    plan = plan_of(rows)
    assert "GreaterThanOrEqual(l_shipdate,2001-09-15" in plan
    scan = next(line for line in plan.splitlines() if "ReadSchema" in line)
    assert "l_partkey" not in scan.split("ReadSchema")[1]


# -- provider-specific reports ---------------------------------------------------------

USE = ["date", "costInUsd", "ResourceId", "resourceGroup"]


def test_unused_resources_and_nulls(spark):
    rows = [
        ("2024-10-14", "1", "busy", "g"),
        ("2024-09-01", "1", "busy", "g"),
        ("2024-09-01", "1", "idle", "g"),
        ("2024-09-01", "1", "idle", "h"),
        ("2024-10-14", "0", "free", "g"),
        ("2024-10-14", "bad", "unread", "g"),
        ("2024-10-14", "1", None, "g"),
    ]
    df = billing(spark, USE, *rows)
    got = sorted(tuple(r) for r in usage.unused_resources(df, AS_OF).collect())
    assert got == [("free", "g"), ("idle", "g"), ("idle", "h"), ("unread", "g")]
    # One NULL id with recent cost empties the literal NOT IN ...
    assert usage.unused_resources(df, AS_OF, null_aware=True).count() == 0
    # ... and without it both readings agree.
    clean = billing(spark, USE, *rows[:-1])
    literal = usage.unused_resources(clean, AS_OF, null_aware=True).collect()
    assert sorted(map(tuple, literal)) == got


def test_unused_resources_never_needs_a_nested_loop(spark, sf_dir):
    df = legacy_rows(spark, sf_dir)
    for null_aware in (False, True):
        plan = plan_of(usage.unused_resources(df, "2001-10-15", null_aware=null_aware))
        assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
        assert ", true)" not in [l for l in plan.splitlines() if "LeftAnti" in l][-1]


def test_unreadable_values(spark):
    df = billing(
        spark,
        USE,
        ("bad", "1", "r", "g"),
        ("date", "1", "r", "g"),
        (None, "1", "r", "g"),
        ("2024-10-01", "n/a", "r", "h"),
    )
    trend = [tuple(r) for r in usage.monthly_trend(df).collect()]
    assert trend == [(2024, 10, None, 1), (None, None, Decimal(1), 0)]
    # Nothing is filtered in the history: all three undated rows share a NULL day.
    history = [tuple(r) for r in usage.daily_cost_history(df).collect()]
    assert history == [(date(2024, 10, 1), None, 1), (None, Decimal(3), 1)]
    charge = [tuple(r) for r in usage.department_chargeback(df).collect()]
    assert charge == [("h", 2024, 10, None), ("g", None, None, Decimal(3))]


def test_default_range_is_the_last_thirty_days(spark):
    df = billing(
        spark,
        USE,
        ("2024-09-15", "1", "r", "g"),
        ("2024-09-14", "2", "r", "g"),
        ("2024-10-15", "4", "r", "g"),
        ("2024-10-16", "8", "r", "g"),
    )
    summary = usage.billing_summary(df, as_of="2024-10-15 09:30:00").first()
    assert (float(summary["TotalCostUSD"]), summary["TransactionCount"], summary["DaysActive"]) == (5, 2, 2)
    chosen = usage.billing_summary(df, "2024-09-14", date(2024, 9, 15)).first()
    assert float(chosen["TotalCostUSD"]) == 3
    # Daily costs have no upper bound, and the cutoff day began before 09:30.
    days = [r["BillingDate"].day for r in usage.daily_costs(df, "2024-10-15 09:30:00").collect()]
    assert days == [16, 15]


def test_top_resources_skip_missing_ids_and_break_ties(spark):
    df = billing(
        spark,
        USE,
        ("2024-10-01", "1", "b", "g"),
        ("2024-10-01", "1", "a", "g"),
        ("2024-10-01", "9", "", "g"),
        ("2024-10-01", "9", None, "g"),
    )
    assert [r["ResourceId"] for r in usage.top_resources(df, limit=2).collect()] == ["a", "b"]
    assert [r["resourceId"] for r in usage.top10_resources(df).collect()] == [None, "", "a", "b"]


# -- operators -----------------------------------------------------------------------------


@pytest.mark.parametrize("few_periods", [True, False])
def test_latest_snapshot_against_plain_python(spark, few_periods):
    rows = [(p, r, v) for p in ("a", "b", None) for r in (1, 2, 3) for v in range(r) if p != "b" or r < 3]
    df = spark.createDataFrame(rows, "period string, run int, v int")
    newest = defaultdict(int)
    for p, r, _ in rows:
        newest[p] = max(newest[p], r)
    want = sorted((str(p), r, v) for p, r, v in rows if r == newest[p])
    kept = latest_snapshot(df, "run", ["period"], few_periods)
    assert sorted((str(p), r, v) for p, r, v in kept.collect()) == want
    assert "Window" not in physical(kept)


def test_latest_snapshot_of_two_exports(spark):
    rows = [("s1", "p", 1), ("s1", "p", 2), ("s2", "p", 1)]
    df = spark.createDataFrame(rows, "export_scope string, BillingPeriodStart string, run int")
    assert sorted(tuple(r) for r in latest_snapshot(df, "run").collect()) == [rows[1], rows[2]]


def test_latest_snapshot_is_sent_to_rows_that_stay_where_they_are(spark):
    df = spark.range(20_000).selectExpr("id % 7 period", "id % 5 run", "id v")
    assert "Exchange hashpartitioning" not in physical(latest_snapshot(df, "run", ["period"]))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        shuffled = latest_snapshot(df, "run", ["period"])
        assert "Broadcast" not in physical(shuffled)
        got = shuffled.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == latest_snapshot(df, "run", ["period"]).count() == sum(i % 5 == 4 for i in range(20_000))


@pytest.mark.parametrize("prefilter", [False, True])
@pytest.mark.parametrize("listed", [0, 500, 1_000])
def test_absent_rows_by_the_share_that_is_listed(spark, listed, prefilter):
    key = F.when(F.col("id") % 11 != 0, F.concat(F.lit("k"), (F.col("id") % 1_000).cast("string")))
    df = spark.range(5_000).select(key.alias("key"), F.col("id").alias("maybe"), F.lit(1).alias("bits"))
    names = spark.range(1_000).selectExpr(f"CASE WHEN id < {listed} THEN concat('k', id) END key", "id other")
    got = rows_absent(df, "key", names, prefilter=prefilter)
    assert got.columns == df.columns
    want = [(f"k{i % 1_000}", i, 1) for i in range(5_000) if i % 11 and i % 1_000 >= listed]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert rows_absent(df, "key", names, True, prefilter).count() == (len(want) if listed == 1_000 else 0)


def test_absent_rows_of_empty_sides(spark):
    df = spark.createDataFrame([("a",), (None,)], "key string")
    assert [r.key for r in rows_absent(df, "key", df.limit(0), prefilter=True).collect()] == ["a"]
    assert rows_absent(df.limit(0), "key", df, prefilter=True).count() == 0


def test_only_rows_that_may_be_listed_reach_the_anti_join(spark):
    df = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    names = df.where("key like 'k1___'")
    maybe = may_be_listed(F.col("key"), names, "key")
    seen = df.filter(maybe)
    assert names.join(seen, "key", "left_anti").count() == 0
    assert 1_000 <= seen.count() <= 1_010


def test_unused_resources_compare_ids_in_any_case(spark):
    rows = [("2024-10-14", "1", "/Sub/VM1", "g"), ("2024-09-01", "1", "/sub/vm1", "g"), ("2024-09-01", "1", "x", "g")]
    got = usage.unused_resources(billing(spark, USE, *rows), AS_OF, fold_case=True).collect()
    assert [r["resourceId"] for r in got] == ["x"]


def test_reports_fail_on_missing_columns(spark):
    df = normalize(spark.createDataFrame([("2024-10-01", "1")], "date string, costInUsd string"), fill=False)
    with pytest.raises(AnalysisException):
        focus.cost_by_customer(df, AS_OF)


def test_undeclared_columns_are_kept_on_request(spark):
    df = normalize(spark.createDataFrame([("2024-10-01", "x")], "date string, myOwn string"), keep_others=True)
    assert df.first()["myOwn"] == "x"


def test_dataset_types(spark):
    df = billing(
        spark,
        ["BilledCost", "EffectiveCost", "ListUnitPrice", "ConsumedQuantity"],
        ("1", "2", "3", "4"),
    )
    assert float(as_dataset(df, "ActualCost").first()["Amount"]) == 1
    assert float(as_dataset(df, "AmortizedCost").first()["Amount"]) == 2
    used = as_dataset(df, "Usage")
    assert float(used.first()["Amount"]) == 4
    assert not [c for c in used.columns if c.endswith(("Cost", "CostInUsd", "Price"))]
    with pytest.raises(ValueError):
        as_dataset(df, "Forecast")
