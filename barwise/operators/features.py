"""Per-ticker features over bars.

One shuffle by ticker serves everything. Short frames are plain window aggregates over one sort by
(ticker, date); frames of 200 rows and more are built from blocks (see ``functions.rolling``).
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from barwise.functions.expr import ANNUAL, change
from barwise.functions.rolling import long_frame, sample_dev
from barwise.functions.windows import running, timeline, trailing

EPS = 1e-8  # Fixed value: keeps band and strength ratios finite.


# ---- column groups ---------------------------------------------------------------------------
# A group is (windows, derived): window aggregates, each stated once, and arithmetic over them.
# Names with a leading underscore are dropped at the end.

LONG = 200  # frames from this length on are built from blocks


def add(df, *groups):
    """Evaluate groups together: one select for all windows, one for the arithmetic."""
    windows = {k: v for g in groups for k, v in g[0].items()}
    derived = {k: v for g in groups for k, v in g[1].items()}
    if windows:
        df = df.withColumns(windows)
    if derived:
        df = df.withColumns(derived)
    return df.drop(*[c for c in windows if c.startswith("_")])


def return_columns():
    prev = F.lag("close").over(timeline())
    return (
        {"prev_close": prev},
        {
            "daily_return": change("close", "prev_close"),
            "log_return": F.log(F.try_divide(F.col("close"), F.col("prev_close"))),
        },
    )


def roc_columns(spans=(20, 60, 252)):
    return (
        {f"_close_{n}": F.lag("close", n).over(timeline()) for n in spans},
        {f"roc_{n}": change("close", f"_close_{n}") for n in spans},
    )


def guarded(aggregate, values, n, name, full):
    """A window aggregate, null until ``n`` values exist when ``full``."""
    frame = trailing(n)
    if not full:
        return {name: aggregate.over(frame)}, {}
    count, raw = f"_n_{values.strip('_')}_{n}", f"_{name}"
    return (
        {raw: aggregate.over(frame), count: F.count(values).over(frame)},
        {name: F.when(F.col(count) == n, F.col(raw))},
    )


def joined(*groups):
    out = ({}, {})
    for g in groups:
        out[0].update(g[0])
        out[1].update(g[1])
    return out


def sma_columns(spans=(20, 50), full=False):
    return joined(*[guarded(F.avg("close"), "close", n, f"sma_{n}", full) for n in spans])


def long_sma(df, n, full=False):
    df = long_frame(df, n, {"_c": ("close",)})
    mean = F.when(F.col("_c_n") == n, F.col("_c_mean")) if full else F.col("_c_mean")
    return df.withColumn(f"sma_{n}", mean).drop("_c_n", "_c_mean", "_c_ss")


def with_sma(df, spans=(20, 50, 200), full=False):
    for n in (n for n in spans if n >= LONG):
        df = long_sma(df, n, full)
    return add(df, sma_columns([n for n in spans if n < LONG], full))


def ema_proxy_columns(fast=12, slow=26):
    """Equal-weight stand-ins for the exponential averages, and their difference."""
    return (
        {f"ema_{n}": F.avg("close").over(trailing(n)) for n in (fast, slow)},
        {"macd": F.col(f"ema_{fast}") - F.col(f"ema_{slow}")},
    )


def bollinger_columns(n=20, width=2.0, full=False, position="bb_position"):
    base = joined(
        guarded(F.avg("close"), "close", n, "bb_mid", full),
        guarded(F.stddev_samp("close"), "close", n, "bb_std", full),
    )
    # With full frames the guards above are themselves derived columns.
    pick = (lambda c: base[1][c]) if full else F.col
    mid, dev = pick("bb_mid"), pick("bb_std")
    upper, lower = mid + width * dev, mid - width * dev
    return joined(
        base,
        ({}, {
            "bb_upper": upper,
            "bb_lower": lower,
            position: (F.col("close") - lower) / (upper - lower + EPS),
        }),
    )


def strength(gain, loss):
    """Relative-strength index from an average gain and an average loss."""
    return 100 - 100 / (1 + gain / (loss + EPS))


def rsi_columns(n=14):
    """On returns, partial frames; a missing return counts as no gain and no loss."""
    r, frame = F.col("daily_return"), trailing(n)
    return (
        {
            "_gain": F.avg(F.when(r > 0, r).otherwise(0.0)).over(frame),
            "_loss": F.avg(F.when(r < 0, -r).otherwise(0.0)).over(frame),
        },
        {f"rsi_{n}": strength(F.col("_gain"), F.col("_loss"))},
    )


def rsi_full_columns(moves, n=14):
    """On any move column, null until ``n`` moves exist."""
    x, frame = F.col(moves), trailing(n)
    return (
        {
            "_gain": F.avg(F.greatest(x, F.lit(0.0))).over(frame),
            "_loss": F.avg(-F.least(x, F.lit(0.0))).over(frame),
            "_n_moves": F.count(x).over(frame),
        },
        {f"rsi_{n}": F.when(F.col("_n_moves") == n, strength(F.col("_gain"), F.col("_loss")))},
    )


def volatility_columns(spans=(20, 60), source="log_return", full=False):
    raw = joined(
        *[guarded(F.stddev_samp(source), source, n, f"_dev_{n}d", full) for n in spans]
    )
    pick = (lambda c: raw[1][c]) if full else F.col
    return raw[0], {f"vol_{n}d": pick(f"_dev_{n}d") * ANNUAL for n in spans}


def with_true_range(df):
    prev = F.col("prev_close")
    return df.withColumn(
        "true_range",
        F.greatest(
            F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)
        ),
    )


def atr_columns(n=14):
    return {f"atr_{n}": F.avg("true_range").over(trailing(n))}, {}


def volume_columns(n=20):
    """Volume against its average, and running signed volume (no return counts as a fall)."""
    signed = F.when(F.col("daily_return") >= 0, F.col("volume")).otherwise(-F.col("volume"))
    mean = f"avg_vol_{n}d"
    return (
        {mean: F.avg("volume").over(trailing(n)), "obv": F.sum(signed).over(running())},
        {"volume_ratio": F.col("volume") / (F.col(mean) + 1)},
    )


def drawdown_columns(cumulative="cum_return"):
    return (
        {"cum_max_return": F.max(cumulative).over(running())},
        {"drawdown": F.col(cumulative) - F.col("cum_max_return")},
    )


def growth_drawdown(growth="growth", name="drawdown"):
    """Drawdown of a compounded series from its running peak."""
    return (
        {"_peak": F.max(growth).over(running())},
        {name: F.try_divide(F.col(growth) - F.col("_peak"), F.col("_peak"))},
    )


def _zscore(df, prefix="_z"):
    dev = sample_dev(prefix)
    return df.withColumn(
        "momentum_zscore", (F.col("roc_252") - F.col(f"{prefix}_mean")) / (dev + EPS)
    ).drop(f"{prefix}_n", f"{prefix}_mean", f"{prefix}_ss")


def _population_beta(df, name, prefix="_b"):
    """Population covariance over population variance, from a frame of (own, market) returns."""
    cov = F.try_divide(F.col(f"{prefix}_sxy"), F.col(f"{prefix}_n"))
    var = F.try_divide(F.col(f"{prefix}_syy"), F.col(f"{prefix}_m"))
    beta = cov / (var + EPS)
    return df.withColumn(name, beta).drop(*[f"{prefix}_{c}" for c in ("n", "sxy", "m", "syy")])


# ---- operators -------------------------------------------------------------------------------

def with_returns(bars):
    return add(bars, return_columns())


def with_moving_averages(bars, spans=(20, 50, 200), full=False):
    df = with_sma(bars, spans, full)
    return df if full else add(df, ema_proxy_columns())


def with_bollinger(bars, **kw):
    return add(bars, bollinger_columns(**kw))


def with_rsi(bars, n=14):
    return add(with_returns(bars), rsi_columns(n))


def with_momentum(bars):
    return _zscore(long_frame(add(bars, roc_columns()), 252, {"_z": ("roc_252",)}))


def with_volatility(bars, spans=(20, 60)):
    return add(with_returns(bars), volatility_columns(spans))


def with_atr(bars, n=14):
    return add(with_true_range(with_returns(bars)), atr_columns(n))


def with_volume_features(bars):
    return add(with_returns(bars), volume_columns())


def with_cumulative(bars):
    total = ({"cum_return": F.sum("log_return").over(running())}, {})
    return add(add(with_returns(bars), total), drawdown_columns())


def with_growth_drawdown(bars):
    growth = ({"growth": F.product(1 + F.col("daily_return")).over(running())}, {})
    return add(add(with_returns(bars), growth), growth_drawdown())


def proxy_returns(bars, proxy):
    """Return series of one ticker, one row per date. Give ``bars`` of that ticker alone where the source can."""
    one = with_returns(bars.filter(F.col("ticker") == proxy))
    return one.groupBy("date").agg(F.first("daily_return").alias("mkt_return"))


def market_returns(returns):
    """Equal-weight mean return per date."""
    return returns.groupBy("date").agg(F.avg("daily_return").alias("mkt_return"))


def join_market(frame, market):
    """Attach a per-date market return. No hint: adaptive execution broadcasts it by measured size."""
    return frame.join(market, "date", "left")


def with_rolling_beta(bars, proxy, n=252, proxy_bars=None):
    """Population covariance over population variance; null throughout if the proxy is absent."""
    frame = join_market(with_returns(bars), proxy_returns(bars if proxy_bars is None else proxy_bars, proxy))
    frame = long_frame(frame, n, {"_b": ("daily_return", "mkt_return")})
    return _population_beta(frame, f"rolling_beta_{n}").drop("mkt_return")


def with_rolling_beta_sample(returns, market, n=252):
    """Sample covariance over sample variance on full windows; null where the variance is zero."""
    df = long_frame(join_market(returns, market), n, {"_b": ("daily_return", "mkt_return")})
    ratio = F.try_divide(F.col("_b_sxy"), F.col("_b_syy"))
    return df.withColumn("rolling_beta", F.when(F.col("_b_n") == n, ratio)).drop(
        "_b_n", "_b_sxy", "_b_m", "_b_syy"
    )


def with_rolling_sharpe(returns, n=252, risk_free=0.05):
    df = long_frame(returns, n, {"_r": ("daily_return",)})
    ratio = F.try_divide(F.col("_r_mean") * 252 - risk_free, sample_dev("_r") * ANNUAL)
    return df.withColumn("rolling_sharpe", F.when(F.col("_r_n") == n, ratio)).drop(
        "_r_n", "_r_mean", "_r_ss"
    )


def with_rolling_var(returns, n=60, z=1.6449):
    """Parametric value at risk on full windows."""
    mean, dev = F.avg("daily_return").over(trailing(n)), F.stddev_samp("daily_return").over(trailing(n))
    windows = {"_mean": mean, "_dev": dev, "_n": F.count("daily_return").over(trailing(n))}
    value = F.when(F.col("_n") == n, F.col("_mean") - z * F.col("_dev"))
    return add(returns, (windows, {"rolling_var": value}))


def feature_set(bars, proxy=None, drop_first=False, proxy_bars=None):
    """All features at once. ``drop_first`` removes rows without a return before anything else is
    computed, so every later frame starts one bar later."""
    if drop_first:
        frame = with_returns(bars).filter(F.col("daily_return").isNotNull())
        # The previous close is taken again among the rows that remain.
        frame = add(frame.drop("prev_close"), ({"prev_close": F.lag("close").over(timeline())}, {}),
                    roc_columns())
    else:
        frame = add(bars, return_columns(), roc_columns())
    year = {"_z": ("roc_252",)}
    if proxy is not None:
        frame = join_market(frame, proxy_returns(bars if proxy_bars is None else proxy_bars, proxy))
        year["_b"] = ("daily_return", "mkt_return")
    frame = _zscore(long_frame(frame, 252, year))
    if proxy is not None:
        frame = _population_beta(frame, "rolling_beta_252").drop("mkt_return")
    frame = long_sma(frame, 200)
    frame = add(
        with_true_range(frame),
        sma_columns(),
        ema_proxy_columns(),
        bollinger_columns(),
        rsi_columns(),
        volatility_columns(),
        atr_columns(),
        volume_columns(),
        ({"cum_return": F.sum("log_return").over(running())}, {}),
    )
    return add(frame, drawdown_columns()).drop("prev_close", "bb_std")


def with_labels(features):
    """Moving-average cross and strength labels (an unknown cross counts as bearish)."""
    cross = F.when(F.col("sma_50") > F.col("sma_200"), "Golden Cross").otherwise("Death Cross")
    rsi = F.col("rsi_14")
    state = F.when(rsi > 70, "Overbought").when(rsi < 30, "Oversold").otherwise("Neutral")
    return features.withColumns({"ma_signal": cross, "rsi_signal": state})


EMA_BLOCK = 128


def exponential(df, value, span, out):
    """The recursive average ``a * x + (1 - a) * before`` with a = 2 / (span + 1), seeded with the first value.

    Rows are cut into blocks of 128. Inside a block the recursion is a weighted running sum, whose weights stay within
    (1 - a)**-128; what a block leaves to the next is carried along the few blocks of a ticker with an array fold."""
    a = 2.0 / (span + 1)
    keep, x, pos = 1.0 - a, F.col(value), F.col("_row") % EMA_BLOCK
    inside = Window.partitionBy("ticker", "_block").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    weight = F.when(F.col("_row") == 0, 1.0).otherwise(a)
    df = df.withColumn("_own", F.pow(F.lit(keep), pos) * F.sum(weight * x * F.pow(F.lit(keep), -pos)).over(inside))
    ends = F.when(pos == EMA_BLOCK - 1, F.col("_own"))
    # the ends of the full blocks before this one, oldest first: one value per 128 rows
    before = Window.partitionBy("ticker").orderBy("_block").rangeBetween(Window.unboundedPreceding, -1)
    carried = F.aggregate(F.collect_list(ends).over(before), F.lit(0.0), lambda acc, e: acc * F.lit(keep**EMA_BLOCK) + e)
    return df.withColumn(out, F.col("_own") + F.pow(F.lit(keep), pos + 1) * carried).drop("_own")


def ema_exact(bars, spans=(12, 26), signal=9):
    """Recursive exponential averages, seeded with the first close, plus MACD and its signal line."""
    fast, slow = (f"ema_{n}" for n in spans)
    rows = bars.select("ticker", "date", "close").withColumn("_row", F.row_number().over(timeline()) - 1)
    rows = rows.withColumn("_block", F.floor(F.col("_row") / EMA_BLOCK))
    for span, name in zip(spans, (fast, slow)):
        rows = exponential(rows, "close", span, name)
    rows = exponential(rows.withColumn("macd", F.col(fast) - F.col(slow)), "macd", signal, "macd_signal")
    return rows.select("ticker", "date", fast, slow, "macd", "macd_signal")
