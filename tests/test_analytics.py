import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barwise.functions.percentiles import exact_percentiles
from barwise.operators import correlation, market, measures, portfolio, risk, scenario, signals

RNG = np.random.default_rng(7)


@pytest.mark.parametrize("xs", [
    RNG.normal(0, 1, 1001), np.zeros(50), [1.0], [1.0, 2.0], RNG.integers(-3, 4, 500).astype(float),
    np.concatenate([RNG.normal(0, 1e-9, 300), [1e12, -1e15]]), RNG.pareto(0.5, 400),
])
def test_exact_percentiles(spark, xs):
    xs = [float(x) for x in xs]
    df = spark.createDataFrame([(1, x) for x in xs], "grp int, v double")
    probs = [0.0, 0.01, 0.05, 0.5, 0.77, 1.0]
    got = {r.p: r.percentile for r in exact_percentiles(df, "v", probs, ["grp"]).collect()}
    want = dict(zip(probs, np.percentile(xs, [100 * p for p in probs])))
    for p in probs:
        assert got[p] == pytest.approx(want[p], rel=1e-9, abs=1e-12)


def test_correlation_in_blocks_matches_pandas(make_returns):
    m = RNG.normal(0, 0.01, (60, 23))
    m[RNG.random(m.shape) < 0.2] = np.nan
    names = [f"T{i:02d}" for i in range(23)]
    series = {n: [None if np.isnan(x) else x for x in m[:, i]] for i, n in enumerate(names)}
    df = make_returns(series)
    want = pd.DataFrame(m, columns=names).corr(min_periods=40)
    for block in (4, 256):
        got = correlation.pairwise_correlation(df, min_common=40, block=block).collect()
        pairs = {(r.ticker_a, r.ticker_b): r.correlation for r in got}
        assert len(pairs) == len(got)
        expected = {(a, b) for a in names for b in names if a < b and not np.isnan(want.loc[a, b])}
        assert set(pairs) == expected
        for (a, b), c in pairs.items():
            assert c == pytest.approx(want.loc[a, b], abs=1e-9)


def test_pair_sums_are_finished_in_their_group(spark, make_returns):
    """The common dates of a pair of series are not shuffled by pair; a value that is no number, and a constant series."""
    days = [0.1, -0.2, 0.3, 0.0, 0.2]
    df = make_returns({"A": days, "B": days[::-1], "C": [0.5] * 5, "D": [*days[:4], float("nan")], "E": [*days[:2], None, None, None]})
    found = correlation.pairwise_correlation(df, min_common=3)
    assert "hashpartitioning(a#" not in found._jdf.queryExecution().executedPlan().toString()
    pairs = {(r.ticker_a, r.ticker_b): r for r in found.collect()}
    assert set(pairs) == {(a, b) for a in "ABCD" for b in "ABCD" if a < b} and {r.n_common for r in pairs.values()} == {5}
    assert pairs["A", "B"].correlation == pytest.approx(np.corrcoef(days, days[::-1])[0, 1])
    assert pairs["A", "C"].correlation is None and pairs["C", "D"].correlation is None and np.isnan(pairs["B", "D"].correlation)


def test_a_group_gets_packed_series(spark, make_returns, monkeypatch):
    """What is shuffled is a row for a series and block, however many dates it has; a block is bounded in values too."""
    def counted(_):
        def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = sum(b.num_rows for b in batches)
            yield pa.RecordBatch.from_arrays([pa.array(["a"]), pa.array(["b"]), pa.array([n]), pa.array([None], pa.float64())],
                                             ["a", "b", "n_common", "correlation"])

        return run

    monkeypatch.setattr(correlation, "_block_pairs", counted)
    df = make_returns({f"T{i:02d}": RNG.normal(0, 0.01, 60) for i in range(40)})
    for limits, n_blocks in (({}, correlation.SPREAD), ({"values": 100}, 25)):
        found = correlation.pairwise_correlation(df, min_common=5, **limits).collect()
        assert sum(r.n_common for r in found) == 40 * n_blocks and len(found) <= n_blocks * (n_blocks + 1) // 2


def test_a_group_in_panels_and_slices(monkeypatch):
    """Tables bounded in series on both sides and in dates give the pairs that whole ones give."""
    monkeypatch.setattr(correlation, "_PANEL", 3)
    monkeypatch.setattr(correlation, "_SLICE", 5)
    monkeypatch.setattr(correlation, "_DAYS", 7)
    m = RNG.normal(0.3, 0.01, (30, 23))
    m[RNG.random(m.shape) < 0.3] = np.nan
    names, own = [f"T{i:02d}" for i in range(23)], RNG.integers(0, 2, 23)
    want = pd.DataFrame(m, columns=names).corr(min_periods=5)
    got = []
    for bi, bj in ((0, 0), (0, 1), (1, 1)):
        mine = [i for i in RNG.permutation(23) if own[i] in (bi, bj)]
        known = [np.flatnonzero(~np.isnan(m[:, i])).astype(np.int32) for i in mine]
        rows = pa.table({"k": [names[i] for i in mine], "d": pa.array(known, pa.list_(pa.int32())),
                         "v": pa.array([m[d, i] for d, i in zip(known, mine)], pa.list_(pa.float64())), "own": own[mine]})
        for batch in correlation._block_pairs(5)((pa.scalar(bi), pa.scalar(bj)), iter(rows.to_batches(max_chunksize=4))):
            got += batch.to_pylist()
    pairs = {(r["a"], r["b"]): r["correlation"] for r in got}
    assert len(pairs) == len(got)
    assert set(pairs) == {(a, b) for a in names for b in names if a < b and not np.isnan(want.loc[a, b])}
    assert all(c == pytest.approx(want.loc[p], abs=1e-9) for p, c in pairs.items())


def reference_metrics(r):
    """Brute force on one series."""
    r = pd.Series(r).dropna()
    tot = (1 + r).prod() - 1
    ann = (1 + tot) ** (1 / max(len(r) / 252, 1)) - 1
    vol = r.std() * np.sqrt(252)
    cum = (1 + r).cumprod()
    mdd = (cum / cum.cummax() - 1).min()
    var95 = r.mean() - 1.6449 * r.std()
    down = r[r < 0].std() * np.sqrt(252)
    return {
        "total_return": tot, "annualised_return": ann, "annualised_volatility": vol,
        "sharpe_ratio": (ann - 0.05) / vol, "max_drawdown": mdd, "calmar_ratio": ann / abs(mdd),
        "sortino_ratio": (ann - 0.05) / down if down > 0 else 0.0,
        "var_95": var95, "cvar_95": r[r <= var95].mean() if (r <= var95).any() else var95, "skewness": r.skew(), "kurtosis": r.kurtosis(),
        "win_rate": (r > 0).mean(), "best_day": r.max(), "worst_day": r.min(),
    }


def test_risk_metrics(make_returns):
    series = {"A": list(RNG.normal(0.0004, 0.015, 252)), "B": [0.01, None, 0.02, None, -0.015] * 50, "C": [0.1]}
    got = {r.ticker: r.asDict() for r in risk.risk_metrics(make_returns(series)).collect()}
    assert set(got) == {"A", "B"}
    for t in got:
        for k, v in reference_metrics(series[t]).items():
            assert got[t][k] == pytest.approx(v, abs=1.1 * 10 ** -risk.METRICS[k]), (t, k)
    assert got["A"]["var_99"] <= got["A"]["var_95"] and got["A"]["cvar_95"] <= got["A"]["var_95"]


def test_no_loss_and_constant_series(make_returns):
    got = {r.ticker: r for r in risk.risk_metrics(make_returns({"Z": [0.0] * 10, "U": [0.01, 0.02, 0.03]})).collect()}
    assert got["Z"].sharpe_ratio == 0.0 and got["Z"].calmar_ratio == 0.0 and got["Z"].skewness == 0.0
    assert got["U"].max_drawdown == 0.0 and got["U"].calmar_ratio == 0.0


def weights_table(spark, weights):
    return spark.createDataFrame(list(weights.items()), "ticker string, weight double")


def test_portfolio_ignores_unknown_and_normalises(make_returns, spark):
    a, b = RNG.normal(0, 0.01, 100), RNG.normal(0, 0.01, 100)
    a[3] = np.nan
    df = make_returns({"A": [None if np.isnan(x) else x for x in a], "B": list(b)})
    held = weights_table(spark, {"A": 3.0, "B": 1.0, "GHOST": 5.0})
    got = portfolio.metrics(df, held).first()
    want = reference_metrics(pd.Series(0.75 * a + 0.25 * b))
    assert got.total_return == pytest.approx(want["total_return"], abs=1e-6)
    assert got.max_drawdown == pytest.approx(want["max_drawdown"], abs=1e-6)
    assert got.weights == {"A": 0.75, "B": 0.25}
    path = portfolio.series(portfolio.holding(df, held))
    bundle = {r.ticker: r.weight for r in portfolio.bundle(df, held, path).collect()}
    assert bundle == {"A": 0.75, "B": 0.25, "PORTFOLIO": 1.0}


def test_bundle_keeps_the_days_of_each_ticker(make_returns, spark):
    """Ticker rows are those of the daily returns, whatever days the tickers share; the portfolio row is compounded."""
    a, b = list(RNG.normal(0, 0.01, 200)), list(RNG.normal(0, 0.01, 200))
    a[7], b[8] = 0.9, -0.8
    df = make_returns({"A": [x if i % 2 else None for i, x in enumerate(a)], "B": [x if i % 2 == 0 else None for i, x in enumerate(b)], "C": [0.5] * 3})
    held = weights_table(spark, {"A": 1.0, "B": 3.0, "GHOST": 9.0})
    months = portfolio.compound(df)
    got = {r.ticker: r.asDict() for r in portfolio.bundle(df, held, portfolio.series(portfolio.holding(months, held)), 12).collect()}
    own = {r.ticker: r.asDict() for r in risk.risk_metrics(df).collect()}
    assert set(got) == {"A", "B", "PORTFOLIO"}
    for t in "AB":
        assert {k: v for k, v in got[t].items() if k != "weight"} == own[t]
    assert got["A"]["best_day"] == pytest.approx(0.9) and got["B"]["worst_day"] == pytest.approx(-0.8)
    frame = df.toPandas().dropna()
    frame["month"] = pd.to_datetime(frame["date"]).dt.to_period("M")
    wide = frame.groupby(["month", "ticker"])["daily_return"].apply(lambda r: (1 + r).prod() - 1).unstack()
    r = 0.25 * wide["A"] + 0.75 * wide["B"]
    years = max(len(r) / 12, 1)
    assert got["PORTFOLIO"]["annualised_return"] == pytest.approx((1 + r).prod() ** (1 / years) - 1, abs=1e-6)
    assert got["PORTFOLIO"]["annualised_volatility"] == pytest.approx(r.std() * 12**0.5, abs=1e-6)


def test_equal_weights_over_the_universe(make_returns, spark):
    m = RNG.normal(0.0005, 0.01, (252, 40))
    df = make_returns({f"T{i:03d}": list(m[:, i]) for i in range(40)})
    got = portfolio.metrics(df, weights_table(spark, {f"T{i:03d}": 1.0 for i in range(40)})).first()
    want = reference_metrics(m.mean(axis=1))
    for k in ("total_return", "annualised_return", "annualised_volatility", "sharpe_ratio", "max_drawdown", "var_95", "cvar_95"):
        assert got[k] == pytest.approx(want[k], abs=1.1 * 10 ** -risk.METRICS[k]), k
    assert len(got.weights) == 40 and sum(got.weights.values()) == pytest.approx(1.0)


def test_extreme_returns_are_kept(make_returns, spark):
    """Moves beyond one half count like any other."""
    xs = [0.9, -0.6, 2.5, 0.01, -0.7] * 10
    got = portfolio.metrics(make_returns({"A": xs}), weights_table(spark, {"A": 1.0})).first()
    assert got.total_return == pytest.approx(reference_metrics(xs)["total_return"], rel=1e-5)


def test_portfolio_against_itself(make_returns, spark):
    df = make_returns({"A": list(RNG.normal(0.001, 0.01, 252))})
    bench = df.select("date", F.col("daily_return").alias("mkt_return"))
    got = portfolio.metrics(df, weights_table(spark, {"A": 1.0}), benchmark=bench).first()
    assert got.beta == pytest.approx(1.0) and got.information_ratio is None


def test_rounding_is_done_once(spark):
    from barwise.functions.expr import half_up

    df = spark.createDataFrame([(0.123449996, -0.00125, 1e17)], "a double, b double, c double")
    assert tuple(df.select(half_up("a", 4), half_up("b", 4), half_up("c", 4)).first()) == (0.1234, -0.0013, 1e17)


def test_sector_scenarios(spark):
    df = spark.createDataFrame([("Technology",), ("Elsewhere",)], "sector string")
    got = {r.sector: r.sector_return for r in scenario.sector_scenario_returns(df, "bear").collect()}
    assert got == {"Technology": -0.42, "Elsewhere": -0.3}
    assert scenario.sector_scenario_returns(df, "stagflation").first().multiplier == 1.0
    with pytest.raises(KeyError):
        scenario.sector_scenario_returns(df, "boom")


def test_capture(spark):
    df = spark.createDataFrame([("A", 1.0), ("B", None)], "ticker string, beta double")
    (row,) = scenario.capture_ratios(df).collect()
    assert (row.upside_capture, row.downside_capture, row.capture_ratio) == (1.0, 1.0, 1.0)


@pytest.mark.parametrize("dd,vol,roc,label", [
    (-0.20, 0.22, 0.0, "Bear"), (-0.19, 0.22, 0.5, "Volatile"), (-0.05, 0.21, 0.03, "Bull"),
    (-0.06, 0.1, 0.03, "Recovery"), (-0.20, 0.1, 0.01, "Recovery"), (-0.21, 0.1, 0.01, "Normal"),
    (None, None, 0.03, "Bull"), (-0.3, 0.5, None, "Normal"), (0.0, 0.0, 0.0, "Normal"),
])
def test_row_regimes(spark, dd, vol, roc, label):
    df = spark.createDataFrame([(dd, vol, roc)], "drawdown double, vol_20d double, roc_20 double")
    assert scenario.with_market_scenario(df).first().market_scenario == label


def test_rule_regimes(spark):
    rows = [(-0.25, -0.06, 0.3, 31.0), (-0.1, 0.0, 0.22, 25.0), (-0.01, 0.05, 0.1, 15.0), (-0.15, 0.02, 0.1, 28.0), (-0.15, 0.02, 0.1, None)]
    df = spark.createDataFrame(rows, "spx_drawdown_pct double, momentum_20d double, realized_vol_20d double, vix_level double")
    rules = scenario.rule_table(spark)
    assert [r.regime for r in scenario.classify_regimes(df, rules).collect()] == ["Bear", "Volatile", "Bull", "Recovery", "Normal"]
    assert {r.regime for r in scenario.classify_regimes(df.drop("vix_level"), rules).collect()} == {"Normal"}
    # rules are data: a table changes them, ties of priority go to the smaller name, without rules all is the default
    own = spark.createDataFrame([("Up", 2, "vix_level", "<", 26.0), ("Any", 2, "momentum_20d", ">", -1.0), ("Exact", 1, "vix_level", "==", 31.0)], scenario.RULE)
    assert [r.regime for r in scenario.classify_regimes(df, own).collect()] == ["Exact", "Any", "Any", "Any", "Any"]
    assert {r.regime for r in scenario.classify_regimes(df, own.limit(0)).collect()} == {"Normal"}
    plan = scenario.classify_regimes(df, rules)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_sketched_tail_is_close(make_returns):
    xs = [float(x) for x in RNG.normal(0, 0.02, 4000)]
    df = make_returns({"A": xs})
    exact, near = risk.tail_risk(df, ["sector"]).first(), risk.approximate_tail_risk(df, ["sector"]).first()
    assert near["var_95"] == pytest.approx(exact["var_95"], abs=1e-3) and near["var_99"] == pytest.approx(exact["var_99"], abs=2e-3)
    assert exact["cvar_95"] == pytest.approx(np.mean([x for x in xs if x <= np.percentile(xs, 5)]), rel=1e-9)


def test_signal_score_defaults(spark):
    df = spark.createDataFrame([(None, None, None), (0.1, 50.0, 0.2), (9.0, 10.0, 0.01), (-9.0, 90.0, 3.0)], "roc_252 double, rsi_14 double, vol_20d double")
    assert [r.signal_score for r in signals.with_signal_score(df).collect()] == [40.0, 50.0, 86.5, 0.0]


def test_signal_buckets(spark):
    df = spark.createDataFrame(
        [("A", "S", 1.0, 0.31, 0.1, 20.0, 1.0, 5.0), ("B", "S", 1.0, -0.5, None, 80.0, 1.0, None), ("C", "S", 1.0, None, 0.1, 50.0, 1.0, 1.0)],
        "ticker string, sector string, latest_close double, return_1y double, vol_20d double, rsi_14 double, beta double, pe_ratio double")
    got = {r.ticker: (r.composite_score, r.signal) for r in signals.investment_signals(df).collect()}
    assert got == {"A": (5.0, "Strong Buy"), "B": (1.0, "Strong Sell")}


@pytest.mark.parametrize("inclusive,label", [(True, "Normal"), (False, "Low Volatility")])
def test_volatility_boundary(spark, inclusive, label):
    # Two returns whose sample deviation annualises to 0.20 after rounding.
    x = 0.20 / np.sqrt(252) / np.sqrt(2)
    df = spark.createDataFrame([("A", dt.date(2020, 1, 1), float(x)), ("B", dt.date(2020, 1, 1), float(-x))], "ticker string, date date, daily_return double")
    assert market.volatility_regime(df, inclusive=inclusive, digits=4).first().vol_regime == label


def test_screener_sorting_and_total(spark):
    df = spark.createDataFrame([("A", 0.1), ("B", None), ("C", 0.3)], "ticker string, return_1y double")
    down = market.screener(df, limit=2).collect()
    assert [r.ticker for r in down] == ["C", "A"] and down[0].total == 3
    assert [r.ticker for r in market.screener(df, descending=False).collect()] == ["B", "A", "C"]
    assert [r.ticker for r in market.screener(df, offset=2).collect()] == ["B"]
    with pytest.raises(ValueError):
        market.screener(df, limit=501)


def test_week_ends_on_friday(make_bars):
    got = {str(r.week): r.close for r in market.weekly_close(make_bars({"A": [1.0, 2.0, 3.0, 4.0]})).collect()}
    assert got == {"2020-01-03": 3.0, "2020-01-10": 4.0}  # 1 January 2020 was a Wednesday


def test_calendar(make_bars):
    days = market.calendar(make_bars({"A": [1.0] * 10}))
    assert days.count() == 8
    assert str(market.trading_days_ago(days, 1).first().date) == "2020-01-10"
    assert str(market.trading_days_ago(days, 3).first().date) == "2020-01-08"


def test_volume_ratio_counts_ties(make_bars):
    bars = make_bars({t: [1.0] * 4 for t in "ABCDEFGHIJK"})
    row = measures.volume(bars).first()
    # 11 tickers a day: the 20th earlier row falls on the second day back, so 22 rows count.
    assert row.volume_ratio_20d == pytest.approx(11 * 103 / np.mean([102, 101]))


def test_tail_risk_of_groups(make_returns):
    xs = list(RNG.normal(0, 0.02, 500))
    row = risk.tail_risk(make_returns({"A": xs}), ["sector"]).first()
    v = np.percentile(xs, 5)
    assert row.var_95 == pytest.approx(v) and row.cvar_95 == pytest.approx(np.mean([x for x in xs if x <= v]))
