"""The report's tables on a small feature table."""

import datetime as dt

import pytest

from barwise.operators import report

FEATURES = "ticker string, date date, sector string, market_cap_category string, exchange string, close double, daily_return double, sma_50 double, sma_200 double, roc_252 double, vol_20d double, rsi_14 double, beta double, pe_ratio double, dividend_yield double"


@pytest.fixture(scope="module")
def features(spark):
    rows = []
    for i, t in enumerate("ABCDEF"):
        for d in range(5):
            r = 0.01 * ((i + d) % 3 - 1)
            rows.append((t, dt.date(2020, 1, 1 + d), "X" if i < 4 else "Y", "Large Cap", "LSE", 10.0 + i, r, 9.0, 11.0, None if t == "F" else 0.1 * i, 0.2, 50.0, 1.0 + 0.1 * i, 10.0, 0.0))
    return spark.createDataFrame(rows, FEATURES)


def test_sectors_and_market_in_one_pass(features):
    got = {r.name: r for r in report.sectors(features).collect()}
    assert {k: r.n_equities for k, r in got.items()} == {"X": 4, "Y": 2, "all": 6}
    assert got["X"].avg_beta == pytest.approx(1.15) and got["all"].avg_beta == pytest.approx(1.25)


def test_bundle_holds_every_table(spark, features):
    scenarios = spark.createDataFrame([("Bull", 0.2, 0.1)], "scenario_name string, scenario_return double, scenario_vol double")
    got = {(r.section, r.name, r.metric): r.value for r in report.bundle(features, scenarios, n=2).collect()}
    assert got["kpi", "market", "total_equities"] == 5 and got["scenario", "Bull", "scenario_return"] == 0.2
    assert [k[1] for k, v in sorted(got.items(), key=lambda x: x[1] or 0) if k[0] == "top" and k[2] == "position"] == ["E", "D"]
    assert got["bottom", "A", "position"] == 1 and got["bottom", "B", "position"] == 2
    assert got["risk", "market", "best_day"] >= got["risk", "market", "worst_day"]
    assert {k[0] for k in got} == {"kpi", "sector", "top", "bottom", "scenario", "risk"}


def test_bundle_of_nothing(spark, features):
    none = spark.createDataFrame([], "scenario_name string, scenario_return double")
    got = {(r.section, r.name, r.metric): r.value for r in report.bundle(features.limit(0), none).collect()}
    assert got["kpi", "market", "total_equities"] == 0 and not any(k[0] in ("top", "scenario", "risk") for k in got)
