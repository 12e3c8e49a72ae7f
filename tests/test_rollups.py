"""Reports on maintained rollups equal those on the charges, whatever became of the months."""

import random
import time
from collections import Counter

import pytest

from costlens.plans import focus_reports as focus
from costlens.sources.schema import EXPORT_PERIOD
from costlens.streaming import rollups
from costlens.streaming.ingest import ingest_exports
from costlens.streaming.rollups import ROLLUPS, read_rollup, refresh_rollups
from costlens.streaming.version_log import VersionLog, read_version
from tests.helpers import put_csv

JAN, FEB, MAR = "20240101-20240131", "20240201-20240229", "20240301-20240331"
AS_OF = "2024-02-20 13:30:00"
HEADER = [
    "BillingPeriodStart", "ChargePeriodStart", "BillingCurrency", "SubAccountId", "SubAccountName", "ServiceCategory",
    "ServiceName", "RegionName", "ResourceId", "ResourceName", "ResourceType", "ConsumedUnit", "Tags",
    "CommitmentDiscountId", "ChargeCategory", "PricingCategory", "BilledCost", "EffectiveCost", "ListCost",
    "ContractedCost", "ConsumedQuantity",
]

# report, its arguments, the rollup that answers it
REPORTS = [
    (focus.cost_by_customer, (), {}, "resources"),
    (focus.cost_by_customer, (), {"fold_case": True}, "resources"),
    (focus.daily_trend, (), {}, "resources"),
    (focus.daily_trend, (), {"date_col": "ChargePeriodStart"}, "days"),
    (focus.daily_trend, (), {"date_col": "ChargePeriodStart", "by_currency": True}, "days"),
    (focus.daily_trend_short, (), {}, "customers"),
    (focus.cost_by_service_category, (), {}, "resources"),
    (focus.cost_by_service_category, (), {"by_currency": True, "fold_case": True}, "resources"),
    (focus.top10_customers, (), {}, "resources"),
    (focus.cost_by_region, (), {}, "resources"),
    (focus.customer_deep_dive, ("s-1",), {}, "resources"),
    (focus.customer_deep_dive, ("S-1",), {"fold_case": True}, "resources"),
    (focus.discount_analysis, (), {}, "customers"),
    (focus.month_over_month, (), {}, "customers"),
    (focus.month_over_month, (), {"by_currency": True, "fold_case": True}, "customers"),
    (focus.untagged_resources, (), {}, "resources"),
    (focus.commitment_utilization, (), {}, "customers"),
    (focus.customer_summary, (), {"days_back": 60}, "resources"),
    (focus.customer_trend, ("s-1",), {"days_back": 60}, "customers"),
    (focus.service_breakdown, (), {}, "customers"),
]


def charges(month, n, seed):
    draw = random.Random(seed)
    start = f"{month[:4]}-{month[4:6]}-"
    for _ in range(n):
        i = draw.choice([1, 1, 1, 2, 3])  # one customer has most rows
        cost = lambda: draw.choice(["", "0", "1.25", "-3.000001", f"{draw.randrange(10**6)}.5", "no number"])
        yield [
            f"{start}01", f"{start}{draw.randrange(1, 29):02d}T{draw.choice(['00', '13'])}:30:00", draw.choice(["EUR", "USD", ""]),
            draw.choice([f"s-{i}", f"S-{i}", ""]), draw.choice([f"name {i}", f"Name {i}", ""]), draw.choice(["Compute", "compute", ""]),
            draw.choice(["vm", "disk", ""]), draw.choice(["eu", "us", ""]), draw.choice([f"/res/{draw.randrange(9)}", ""]),
            draw.choice(["a", "b", ""]), "t", draw.choice(["h", ""]), draw.choice(["", "{}", '{"a": "1"}', '{"b": "2"}']),
            draw.choice(["", "c-1", "c-2"]), draw.choice(["Usage", "Purchase"]), draw.choice(["Standard", ""]),
            cost(), cost(), cost(), cost(), cost(),
        ]


def put(tmp_path, month, run, rows):
    put_csv(tmp_path / "lake" / "e" / month / run / "p.csv", HEADER, rows)
    time.sleep(0.02)


def load(spark, tmp_path, names=tuple(ROLLUPS)):
    places = [str(tmp_path / x) for x in ("lake", "t", "c")]
    ingest_exports(spark, *places, versioned=True, rollups=names).awaitTermination()
    return places[1]


def same(a, b):
    assert a.dtypes == b.dtypes
    assert Counter(map(tuple, a.collect())) == Counter(map(tuple, b.collect()))


def all_reports_agree(spark, table, version=None):
    rows = read_version(spark, table, version)
    for report, args, options, name in REPORTS:
        same(
            report(read_rollup(spark, table, name, version), *args, as_of=AS_OF, **options),
            report(rows, *args, as_of=AS_OF, **options),
        )


def test_reports_after_a_load_a_newer_run_and_an_emptied_month(spark, tmp_path):
    put(tmp_path, JAN, "r1", charges(JAN, 150, 1))
    put(tmp_path, FEB, "r1", charges(FEB, 150, 2))
    table = load(spark, tmp_path)
    all_reports_agree(spark, table)
    first = {n: VersionLog(spark, f"{table}/rollups/{n}").manifest(1) for n in ROLLUPS}
    put(tmp_path, FEB, "r2", charges(FEB, 250, 3))
    put(tmp_path, MAR, "r1", charges(MAR, 40, 4))
    load(spark, tmp_path)
    all_reports_agree(spark, table)
    for name, before in first.items():  # January was not computed again
        log = VersionLog(spark, f"{table}/rollups/{name}")
        now = log.manifest(log.latest())
        assert {p for (_, p), f in before.items() if f in now.values()} == {JAN[:8]}
    put(tmp_path, FEB, "r3", [])
    load(spark, tmp_path)
    all_reports_agree(spark, table)
    periods = {r[0] for r in read_rollup(spark, table, "days").select(EXPORT_PERIOD).distinct().collect()}
    assert periods == {JAN[:8], MAR[:8]}
    for version in (1, 2):  # earlier versions stay readable
        all_reports_agree(spark, table, version)
    for name in ROLLUPS:
        rollup = read_rollup(spark, table, name)
        files = rollup.inputFiles()
        assert files and all(f"/rollups/{name}/data/" in f for f in files)  # no charges are scanned
        assert rollup.agg({"ChargeCount": "sum"}).first()[0] == read_version(spark, table).count()


def test_a_refresh_that_dies_is_made_up_for(spark, tmp_path, monkeypatch):
    put(tmp_path, JAN, "r1", charges(JAN, 30, 1))
    table = load(spark, tmp_path, ["customers"])
    put(tmp_path, JAN, "r2", charges(JAN, 60, 5))

    def dies(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(rollups, "write_table", dies)
        with pytest.raises(Exception, match="lost"):
            load(spark, tmp_path, ["customers"])
    # the charges are published, the rollup still shows the whole old state
    assert read_version(spark, table).count() == 60
    old = read_rollup(spark, table, "customers")
    assert old.agg({"ChargeCount": "sum"}).first()[0] == 30
    with pytest.raises(LookupError):
        read_rollup(spark, table, "customers", version=2)
    load(spark, tmp_path, ["customers"])  # nothing new arrived
    assert read_rollup(spark, table, "customers", version=2).agg({"ChargeCount": "sum"}).first()[0] == 60
    assert old.agg({"ChargeCount": "sum"}).first()[0] == 30  # a frame keeps the state it began with


def test_two_refreshes_at_once(spark, tmp_path, monkeypatch):
    put(tmp_path, JAN, "r1", charges(JAN, 30, 1))
    table = load(spark, tmp_path, ["days"])
    put(tmp_path, JAN, "r2", charges(JAN, 50, 2))
    load(spark, tmp_path, [])
    write, first = rollups.write_table, []

    def overtaken(*args, **kwargs):
        if not first:
            first.append(1)
            refresh_rollups(spark, table, ["days"])  # the other one publishes before
        write(*args, **kwargs)

    monkeypatch.setattr(rollups, "write_table", overtaken)
    refresh_rollups(spark, table, ["days"])
    assert read_rollup(spark, table, "days", version=2).agg({"ChargeCount": "sum"}).first()[0] == 50
    assert VersionLog(spark, f"{table}/rollups/days").versions() == [1, 2]


def test_empty_tables_and_wrong_uses(spark, tmp_path):
    table = str(tmp_path / "t")
    refresh_rollups(spark, table)
    for report, args, options, name in REPORTS:
        assert report(read_rollup(spark, table, name), *args, as_of=AS_OF, **options).count() == 0
    with pytest.raises(ValueError):
        ingest_exports(spark, str(tmp_path), table, str(tmp_path / "c"), rollups=["days"])
    with pytest.raises(KeyError):
        read_rollup(spark, table, "unheard of")
