"""Every query agrees with its SQL on the smallest tables."""

import re

import duckdb
import pytest

import __spark_entry__ as entry_module
from conftest import SF
from barwise.operators import market
from barwise.functions import windows
from barwise.plans import frames
from barwise.plans.frames import Frames
from barwise.sources import derived
from oracle_check import compare, connect

QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_flagship(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0 and df.columns[0] == "sector"


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert compare(df, duck, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_queries_without_sql_give_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_nested_history_is_ordered_and_bounded(spark):
    t = Frames(spark, SF)
    for r in market.equity_detail(t.returns, t.clean_fundamentals).collect():
        days = [h.date for h in r.history]
        assert days == sorted(days) and len(days) <= 252


@pytest.mark.parametrize("name", ["scan_bars", "top_performers"])
def test_bars_are_hash_aggregated(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_ticker_filter_reaches_the_scan(spark):
    plan = Frames(spark, SF).proxy_bars._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_suppkey,0)" in plan



def test_tiny_falls_are_rounded_by_the_same_rule(spark, tmp_path):
    """A fall of less than half the last digit shown is 0.000000 on both sides, as rounding is decimal."""
    tables = connect(SF)
    for table in ("region", "nation", "supplier"):
        tables.execute(f"COPY {table} TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
    tables.execute(f"""COPY (SELECT * REPLACE (2000000000.0 - date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS l_extendedprice,
        1.0::DOUBLE AS l_quantity) FROM lineitem) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)""")
    duck = duckdb.connect()
    for table in ("region", "nation", "supplier", "lineitem"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet')")
    df = QUERIES["equity_detail"](spark, str(tmp_path))
    assert " 0.000000" in df.first().history
    assert compare(df, duck, SQL["equity_detail"]) == ""


@pytest.mark.parametrize("months", [2, 3])
@pytest.mark.parametrize("name", ["portfolio_risk_bundle", "portfolio_metrics", "portfolio_vs_benchmark"])
def test_portfolios_of_few_months(spark, tmp_path, name, months):
    """Many tickers share few months: two have no skewness and no kurtosis, three no kurtosis. A missing figure is null."""
    tables = connect(SF)
    for table in ("region", "nation", "supplier"):
        tables.execute(f"COPY {table} TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
    tables.execute(f"""COPY (SELECT * FROM lineitem WHERE l_suppkey <> 1 OR l_shipdate >= DATE '1995-01-01'
        AND l_shipdate < DATE '1995-01-01' + INTERVAL {months} MONTH) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)""")
    duck = duckdb.connect()
    for table in ("region", "nation", "supplier", "lineitem"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet')")
    df = QUERIES[name](spark, str(tmp_path))
    assert compare(df, duck, SQL[name]) == ""
    if name == "portfolio_risk_bundle":
        (whole,) = df.filter("ticker = 'PORTFOLIO'").collect()
        assert whole.kurtosis is None and (whole.skewness is None) == (months == 2)


@pytest.fixture
def exchanges(spark, monkeypatch):
    """The sizes of a query's exchanges by ticker or supplier, where a task is given 100 rows; and how many tasks these make."""
    monkeypatch.setattr(frames, "n_tasks", lambda spark, rows: windows.n_tasks(spark, rows, 100))
    monkeypatch.setattr(derived, "LINES_PER_TASK", 100)

    def found(name, key="(?:ticker|l_suppkey)"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        return [int(n) for n in re.findall(rf"hashpartitioning\({key}#[^()]*, (\d+)\)", plan)]

    return found, derived.n_lines(spark, SF) // 100


@pytest.mark.parametrize("name", ["feature_set", "moving_averages", "m_rolling", "dq_report", "gold_fact", "export_features"])
def test_tasks_follow_the_rows(exchanges, name):
    """What a task holds does not grow with the table. (The one ticker that betas are taken against has few rows.)"""
    found, n = exchanges
    assert len([size for size in found(name) if size >= n]) >= 2


@pytest.mark.parametrize("name", ["silver_features", "moving_averages_full", "dq_score"])
def test_tasks_of_layers_and_scores_follow_the_rows(exchanges, name):
    found, n = exchanges
    assert len([size for size in found(name) if size >= n]) >= 2


def test_calendar_frames_keep_the_dealing(exchanges):
    found, n = exchanges
    assert found("m_rolling", "ticker") == [n]


def test_rankings_are_computed_once(spark):
    plan = QUERIES["portfolio_attribution"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_suppkey" not in plan
