import datetime as dt

import numpy as np
import pandas as pd
import pytest

from barwise.functions.rolling import long_frame, sample_dev
from barwise.operators import features, layers
from conftest import ordered


def walk(n, seed=0, start=100.0):
    rng = np.random.default_rng(seed)
    return [float(x) for x in start * np.exp(np.cumsum(rng.normal(0, 0.02, n)))]


def test_first_return_is_null(make_bars):
    rows = ordered(features.with_returns(make_bars({"A": [10.0, 11.0], "B": [5.0]})), "ticker", "daily_return", "log_return")
    assert rows[0][1:] == (None, None) and rows[2][1:] == (None, None)
    assert rows[1][1] == pytest.approx(0.1) and rows[1][2] == pytest.approx(np.log(1.1))


def test_zero_base_gives_null(make_bars):
    rows = ordered(features.with_returns(make_bars({"A": [0.0, 11.0]})), "daily_return")
    assert rows[1][0] is None


def test_partial_and_full_frames(make_bars):
    bars = make_bars({"A": [float(i) for i in range(1, 31)]})
    part = [r[0] for r in ordered(features.with_moving_averages(bars), "sma_20")]
    full = [r[0] for r in ordered(features.with_moving_averages(bars, full=True), "sma_20")]
    assert None not in part and part[0] == 1.0
    assert full[:19] == [None] * 19 and full[19] == pytest.approx(10.5)
    assert part[19:] == full[19:]


@pytest.mark.parametrize("n", [200, 252])
def test_long_frames_match_pandas(make_bars, n):
    closes = {"A": walk(700, 1), "B": walk(n, 2), "C": walk(3, 3)}
    df = long_frame(make_bars(closes), n, {"_f": ("close",)}).withColumn("dev", sample_dev("_f"))
    got = pd.DataFrame(ordered(df, "ticker", "_f_n", "_f_mean", "dev"), columns=["t", "n", "mean", "dev"])
    for t, xs in closes.items():
        roll = pd.Series(xs).rolling(n, min_periods=1)
        mine = got[got.t == t].reset_index(drop=True)
        assert (mine["n"] == roll.count()).all()
        np.testing.assert_allclose(mine["mean"], roll.mean(), rtol=1e-12)
        np.testing.assert_allclose(mine["dev"].astype(float), roll.std(), rtol=1e-8)


def test_long_frame_of_constants_has_no_deviation(make_bars):
    df = long_frame(make_bars({"A": [0.1] * 600}), 252, {"_f": ("close",)}).withColumn("dev", sample_dev("_f"))
    assert {r[0] for r in ordered(df, "dev")} == {None, 0.0}


def test_long_frame_skips_nulls(make_returns):
    xs = [None if i % 5 == 0 else float(i % 7) for i in range(600)]
    df = long_frame(make_returns({"A": xs}), 252, {"_f": ("daily_return",)})
    roll = pd.Series(xs, dtype=float).rolling(252, min_periods=1)
    got = ordered(df, "_f_n", "_f_mean")
    np.testing.assert_allclose([g[0] for g in got], roll.count())
    np.testing.assert_allclose([np.nan if g[1] is None else g[1] for g in got], roll.mean())


def test_rolling_beta(make_bars):
    a, m = walk(400, 1), walk(400, 2)
    rows = ordered(features.with_rolling_beta(make_bars({"A": a, "M": m}), "M").filter("ticker = 'A'"), "rolling_beta_252")
    ra, rm = pd.Series(a).pct_change(), pd.Series(m).pct_change()
    window = slice(400 - 252, 400)
    cov = np.cov(ra[window], rm[window], ddof=0)
    assert rows[-1][0] == pytest.approx(cov[0, 1] / (cov[1, 1] + 1e-8), rel=1e-9)
    assert rows[0][0] is None


def test_rolling_beta_without_proxy(make_bars):
    rows = ordered(features.with_rolling_beta(make_bars({"A": walk(5)}), "SPY"), "rolling_beta_252")
    assert {r[0] for r in rows} == {None}


def test_sample_beta_and_sharpe_need_full_windows(make_returns, spark):
    r = make_returns({"A": np.random.default_rng(0).normal(0, 0.01, 300)})
    market = features.market_returns(r)
    beta = ordered(features.with_rolling_beta_sample(r, market), "rolling_beta")
    assert beta[250][0] is None and beta[251][0] == pytest.approx(1.0)
    sharpe = ordered(features.with_rolling_sharpe(r), "rolling_sharpe")
    assert sharpe[250][0] is None and sharpe[251][0] is not None
    flat = ordered(features.with_rolling_sharpe(make_returns({"A": [0.001] * 260})), "rolling_sharpe")
    assert {x[0] for x in flat} == {None}


def test_rsi_range_and_first_row(make_bars):
    xs = [r[0] for r in ordered(features.with_rsi(make_bars({"A": walk(60)})), "rsi_14")]
    assert all(0 <= x <= 100 for x in xs) and xs[0] == 0.0
    up = [r[0] for r in ordered(features.with_rsi(make_bars({"A": [float(i) for i in range(1, 30)]})), "rsi_14")]
    assert up[-1] > 99


def test_obv_counts_missing_return_as_fall(make_bars):
    rows = ordered(features.with_volume_features(make_bars({"A": [1.0, 2.0, 1.0]})), "obv")
    assert [r[0] for r in rows] == [-100, 1, -101]


def test_first_true_range_skips_missing_close(make_bars):
    assert ordered(features.with_atr(make_bars({"A": [5.0, 9.0]})), "true_range") == [(2.0,), (5.0,)]


def test_drawdowns_never_positive(make_bars):
    bars = make_bars({"A": walk(100), "B": [float(i) for i in range(1, 50)]})
    log = [r[0] for r in ordered(features.with_cumulative(bars), "drawdown") if r[0] is not None]
    mult = [r for r in ordered(features.with_growth_drawdown(bars), "ticker", "drawdown") if r[1] is not None]
    assert max(log) <= 0 and max(r[1] for r in mult) <= 0
    assert {r[1] for r in mult if r[0] == "B"} == {0.0}


@pytest.mark.parametrize("n", [1, 40, 128, 129, 700])
def test_ema_is_recursive(make_bars, n):
    xs = walk(n)
    got = ordered(features.ema_exact(make_bars({"A": xs, "B": [5.0] * 3})), "ticker", "ema_12", "macd", "macd_signal")
    fast, slow = (pd.Series(xs).ewm(span=k, adjust=False).mean() for k in (12, 26))
    np.testing.assert_allclose([g[1] for g in got if g[0] == "A"], fast, rtol=1e-9)
    np.testing.assert_allclose([g[2] for g in got if g[0] == "A"], fast - slow, atol=1e-9)
    np.testing.assert_allclose([g[3] for g in got if g[0] == "A"], (fast - slow).ewm(span=9, adjust=False).mean(), atol=1e-9)
    np.testing.assert_allclose([g[1:] for g in got if g[0] == "B"], [(5.0, 0.0, 0.0)] * 3, atol=1e-12)


def test_feature_set_matches_single_operators(make_bars):
    bars = make_bars({"A": walk(300, 1), "B": walk(300, 2)})
    one = ordered(features.feature_set(bars), "momentum_zscore", "rsi_14", "vol_60d", "sma_200", "atr_14", "obv")
    for i, single in enumerate([
        ordered(features.with_momentum(bars), "momentum_zscore"),
        ordered(features.with_rsi(bars), "rsi_14"),
        ordered(features.with_volatility(bars), "vol_60d"),
        ordered(features.with_moving_averages(bars), "sma_200"),
        ordered(features.with_atr(bars), "atr_14"),
        ordered(features.with_volume_features(bars), "obv"),
    ]):
        for a, b in zip(one, single):
            assert (a[i] is None and b[0] is None) or a[i] == pytest.approx(b[0], rel=1e-9)


def test_labels(spark):
    df = spark.createDataFrame([(2.0, 1.0, 71.0), (1.0, 2.0, 29.0), (1.0, None, 50.0)], "sma_50 double, sma_200 double, rsi_14 double")
    rows = [tuple(r)[3:] for r in features.with_labels(df).collect()]
    assert rows == [("Golden Cross", "Overbought"), ("Death Cross", "Oversold"), ("Death Cross", "Neutral")]


def test_silver_drops_short_histories(make_bars):
    out = layers.silver(make_bars({"A": walk(260), "B": walk(20)}))
    assert {r.ticker for r in out.select("ticker").distinct().collect()} == {"A"}


def test_one_shuffle_by_ticker(make_bars):
    plan = features.feature_set(make_bars({"A": walk(5)}))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_calendar_frames_follow_the_days(spark):
    """Gaps, repeated dates, nulls and frames that end on block borders, against the frame taken literally."""
    from barwise.functions.rolling import calendar_frame, population_dev

    rng = np.random.default_rng(12)
    start = dt.date(1969, 11, 1)
    rows = []
    for t in ("A", "B"):
        days = sorted(rng.choice(420, 150, replace=False)) if t == "A" else [0, 1, 2, 3, 30, 31, 60, 61, 62, 62, 62, 93, 300]
        rows += [(t, start + dt.timedelta(days=int(d)), None if i % 11 == 5 else float(rng.normal(1e6, 1)), i) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "ticker string, date date, x double, i int")
    for days in (30, 1, 365):
        got = calendar_frame(df, days, {"_f": "x"}).withColumn("dev", population_dev("_f"))
        assert got.count() == len(rows)
        for r in got.collect():
            frame = [x for t, d, x, _ in rows if t == r["ticker"] and x is not None and 0 <= (r["date"] - d).days <= days]
            assert r["_f_n"] == len(frame)
            if frame:
                assert r["_f_mean"] == pytest.approx(np.mean(frame), rel=1e-12)
                assert r["dev"] == pytest.approx(np.std(frame), rel=1e-6, abs=1e-6)
    plan = calendar_frame(df, 30, {"_f": "x"})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "-30" not in plan
