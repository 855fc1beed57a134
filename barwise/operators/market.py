"""Sector, ranking, breadth, regime and calendar queries over bars and features."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from barwise.constants import RISK_FREE
from barwise.functions.expr import ANNUAL, change, count_if, half_up, scalar, share_if


def since(df, days, as_of=None):
    """Rows dated within ``days`` calendar days before ``as_of`` (default: the last date)."""
    end = F.lit(as_of).cast("date") if as_of is not None else scalar(df, F.max("date"))
    return df.filter(F.col("date") >= F.date_sub(end, days))


def performance(risk_free=RISK_FREE, ret="daily_return"):
    """Annualised mean, deviation and their ratio as (mean, deviation, ratio) columns."""
    mean, dev = F.avg(ret) * 252, F.stddev_samp(ret) * ANNUAL
    return mean, dev, F.try_divide(mean - risk_free, dev)


def sector_performance(returns, fundamentals, days=252, as_of=None):
    mean, dev, ratio = performance()
    facts = since(returns.select("ticker", "date", "daily_return"), days, as_of)
    return (
        facts.join(fundamentals.select("ticker", "sector", "beta", "pe_ratio"), "ticker")
        .groupBy("sector")
        .agg(
            F.count_distinct("ticker").alias("n_equities"),
            half_up(mean, 4).alias("annualised_avg_return"),
            half_up(dev, 4).alias("annualised_volatility"),
            half_up(ratio, 4).alias("sharpe_ratio"),
            half_up(F.avg("beta"), 3).alias("avg_beta"),
            half_up(F.avg("pe_ratio"), 2).alias("avg_pe"),
            half_up(share_if(F.col("daily_return") > 0, F.col("daily_return")), 4).alias("win_rate"),
        )
        .orderBy(F.desc("annualised_avg_return"), "sector")
    )


def sector_performance_features(features, days=252, as_of=None):
    mean, dev, ratio = performance()
    return (
        since(features, days, as_of)
        .filter(F.col("daily_return").isNotNull())
        .groupBy("sector")
        .agg(
            F.count_distinct("ticker").alias("n_equities"),
            half_up(mean, 4).alias("ann_avg_return"),
            half_up(dev, 4).alias("ann_volatility"),
            half_up(ratio, 4).alias("sharpe_ratio"),
            half_up(F.avg("beta"), 3).alias("avg_beta"),
            half_up(F.avg("pe_ratio"), 2).alias("avg_pe"),
            half_up(share_if(F.col("daily_return") > 0, F.col("daily_return")), 4).alias("win_rate"),
            half_up(F.min("drawdown"), 4).alias("max_drawdown"),
        )
        .orderBy(F.desc("ann_avg_return"), "sector")
    )


def sector_summary_1y(returns, as_of=None):
    end = F.lit(as_of).cast("date") if as_of else scalar(returns, F.max("date"))
    mean, dev, ratio = performance()
    positive = F.avg((F.coalesce(F.col("daily_return") > 0, F.lit(False))).cast("double"))
    return (
        returns.filter(F.col("date") >= F.add_months(end, -12))
        .groupBy("sector")
        .agg(
            F.count_distinct("ticker").alias("n_equities"),
            half_up(mean, 4).alias("avg_return_1y"),
            half_up(dev, 4).alias("volatility"),
            half_up(positive, 4).alias("win_rate"),
            half_up(ratio, 4).alias("sharpe"),
        )
    )


def top_performers(bars, fundamentals, days=252, as_of=None, n=50):
    """Return since the first bar of the look-back, joined to fundamentals, best ``n``.

    Latest and first close come from one aggregation that combines before its shuffle.
    """
    end = F.lit(as_of).cast("date") if as_of else scalar(bars, F.max("date"))
    inside = F.col("date") >= F.date_sub(end, days)
    perf = (
        bars.groupBy("ticker")
        .agg(
            F.max_by("close", "date").alias("latest_close"),
            F.min_by("close", F.when(inside, F.col("date"))).alias("close_1y"),
            F.max(F.when(inside, 1)).alias("seen"),
        )
        .filter("seen = 1")
        .withColumn("return_1y", half_up(change("latest_close", "close_1y"), 4))
    )
    dim = fundamentals.select(
        "ticker", "sector", "market_cap_category", "exchange", "beta", "pe_ratio", "dividend_yield"
    )
    return (
        perf.join(dim, "ticker")
        .select(
            "ticker", "sector", "market_cap_category", "exchange", "latest_close", "return_1y",
            "beta", "pe_ratio", "dividend_yield",
        )
        .orderBy(F.col("return_1y").desc_nulls_last(), "ticker")
        .limit(n)
    )


def latest_per_ticker(df, columns=None):
    """Each ticker's last row, by an aggregation that combines before its shuffle."""
    cols = [c for c in (columns or df.columns) if c != "ticker"]
    return (
        df.groupBy("ticker")
        .agg(F.max_by(F.struct(*cols), "date").alias("last"))
        .select("ticker", *[F.col(f"last.{c}").alias(c) for c in cols])
    )


RANKED = ["sector", "market_cap_category", "exchange", "close", "roc_252", "vol_20d", "rsi_14", "beta", "pe_ratio", "dividend_yield"]


def equity_rankings(features):
    """Latest features per ticker with a one-year return, best first."""
    last = latest_per_ticker(features, RANKED).filter(F.col("roc_252").isNotNull())
    return last.select(
        "ticker", "sector", "market_cap_category", "exchange",
        half_up("close", 2).alias("latest_close"),
        half_up("roc_252", 4).alias("return_1y"),
        half_up("vol_20d", 4).alias("vol_20d"),
        half_up("rsi_14", 1).alias("rsi_14"),
        half_up("beta", 3).alias("beta"),
        half_up("pe_ratio", 2).alias("pe_ratio"),
        half_up("dividend_yield", 4).alias("div_yield"),
    ).orderBy(F.desc("return_1y"), "ticker")


def top_bottom(rankings, n=20):
    """Both ends of the ranking, each a top-k that never sorts the whole table."""
    best = rankings.orderBy(F.desc("return_1y"), "ticker").limit(n).withColumn("side", F.lit("top"))
    worst = rankings.orderBy("return_1y", "ticker").limit(n).withColumn("side", F.lit("bottom"))
    return best.unionByName(worst)


def screener(
    equities, sectors=None, market_caps=None, exchanges=None, min_beta=None, max_beta=None,
    min_pe=None, max_pe=None, min_return=None, max_return=None, sort_by="return_1y",
    descending=True, limit=100, offset=0,
):
    """Filtered, sorted page of equities, each row with the total match count."""
    if not 0 < limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    df = equities
    for name, values in (
        ("sector", sectors), ("market_cap_category", market_caps), ("exchange", exchanges)
    ):
        if values:
            df = df.filter(F.col(name).isin(list(values)))
    for name, low, high in (
        ("beta", min_beta, max_beta), ("pe_ratio", min_pe, max_pe),
        ("return_1y", min_return, max_return),
    ):
        if low is not None:
            df = df.filter(F.col(name) >= low)
        if high is not None:
            df = df.filter(F.col(name) <= high)
    key = F.col(sort_by).desc_nulls_last() if descending else F.col(sort_by).asc_nulls_first()
    page = df.orderBy(key, "ticker").offset(offset).limit(limit)
    return page.withColumn("total", df.agg(F.count(F.lit(1))).scalar())


def equity_snapshot(features, fundamentals):
    """One row per listed equity: fundamentals with latest price features, null where it never
    traded."""
    last = latest_per_ticker(
        features, ["close", "daily_return", "roc_252", "vol_20d", "rsi_14", "momentum_zscore"]
    ).select(
        "ticker", "close", F.col("daily_return").alias("return_1d"),
        F.col("roc_252").alias("return_1y"), "vol_20d", "rsi_14", "momentum_zscore",
    )
    return fundamentals.join(last, "ticker", "left")


def equity_history(returns, n=252, ticker=None):
    """The last ``n`` bars per ticker, newest rank 1. The rank filter cuts before the shuffle."""
    df = returns if ticker is None else returns.filter(F.col("ticker") == ticker.upper())
    w = Window.partitionBy("ticker").orderBy(F.desc("date"))
    return df.withColumn("bar_no", F.row_number().over(w)).filter(F.col("bar_no") <= n)


def equity_detail(returns, fundamentals, n=252, ticker=None):
    """Fundamentals with the last ``n`` bars nested, oldest first; at most ``n`` per ticker."""
    bar = F.struct(
        "date", half_up("close", 2).alias("close"), half_up("log_return", 6).alias("return")
    )
    nested = (
        equity_history(returns, n, ticker)
        .groupBy("ticker")
        .agg(F.sort_array(F.collect_list(bar)).alias("history"))
    )
    return fundamentals.join(nested, "ticker")


def list_sectors(fundamentals):
    return fundamentals.select("sector").distinct().orderBy("sector")


def volatility_regime(returns, high=0.35, normal=0.20, inclusive=True, digits=None):
    """Cross-sectional volatility per date with its 20-day mean and a label.

    The running mean is taken after aggregating to one row per date, so its single partition holds
    the calendar only.
    """
    vol = F.stddev_samp("daily_return") * ANNUAL
    daily = (
        returns.filter(F.col("daily_return").isNotNull())
        .groupBy("date")
        .agg((half_up(vol, digits) if digits is not None else vol).alias("cross_sectional_vol"))
    )
    v = F.col("cross_sectional_vol")
    middle = v >= normal if inclusive else v > normal
    return daily.select(
        "date",
        v,
        F.avg(v).over(Window.orderBy("date").rowsBetween(-19, 0)).alias("rolling_20d_vol"),
        F.when(v > high, "High Volatility").when(middle, "Normal").otherwise("Low Volatility")
        .alias("vol_regime"),
    )


def market_breadth(features, days=252, as_of=None):
    """Counts per date. Bars are unique per (ticker, date), so rows count tickers."""
    above50 = count_if(F.col("close") > F.col("sma_50"))
    return (
        since(features, days, as_of)
        .filter(F.col("sma_50").isNotNull())
        .groupBy("date")
        .agg(
            F.count("ticker").alias("total_tickers"),
            above50.alias("above_sma50"),
            count_if(F.col("close") > F.col("sma_200")).alias("above_sma200"),
            count_if(F.col("rsi_14") > 70).alias("overbought"),
            count_if(F.col("rsi_14") < 30).alias("oversold"),
            half_up(F.try_divide(above50.cast("double"), F.count("ticker")), 4).alias("breadth_pct"),
        )
    )


def latest_rows(per_date, n):
    return per_date.orderBy(F.desc("date")).limit(n)


def sector_weights(rows):
    """Equity-count weight per sector. The total runs over one row per sector."""
    counts = rows.groupBy("sector").agg(F.count_distinct("ticker").alias("n_eq"))
    return counts.withColumn(
        "portfolio_weight", F.col("n_eq") / F.sum("n_eq").over(Window.partitionBy())
    )


def sharpe_contribution(sector_perf, scenario_rows):
    w = F.col("portfolio_weight")
    return (
        sector_perf.join(sector_weights(scenario_rows), "sector")
        .select(
            "sector", "n_equities", "ann_avg_return", "ann_volatility", "sharpe_ratio",
            half_up(w, 4).alias("portfolio_weight"),
            half_up(F.col("sharpe_ratio") * w, 4).alias("sharpe_contribution"),
        )
    )


def portfolio_attribution(rankings):
    """Equal-weight contribution per sector.

    The universe size is a scalar over the rankings rather than an unpartitioned window, so rows
    are never gathered in one task.
    """
    df = rankings.filter(F.col("return_1y").isNotNull())
    size = df.agg(F.count(F.lit(1))).scalar()
    weighted = df.withColumn("weight", F.lit(1.0) / size)
    return weighted.groupBy("sector").agg(
        F.count(F.lit(1)).alias("n_stocks"),
        half_up(F.avg("weight"), 6).alias("avg_weight"),
        half_up(F.sum("weight"), 4).alias("total_weight"),
        half_up(F.sum(F.col("return_1y") * F.col("weight")), 4).alias("return_contribution"),
        half_up(F.avg("return_1y"), 4).alias("avg_sector_return"),
        half_up(F.avg("vol_20d"), 4).alias("avg_vol"),
        half_up(F.avg("beta"), 3).alias("avg_beta"),
    )


def portfolio_return_eq(rankings, digits=4):
    df = rankings.filter(F.col("return_1y").isNotNull())
    size = df.agg(F.count(F.lit(1))).scalar()
    return df.agg(F.sum("return_1y").alias("total")).select(
        half_up(F.try_divide(F.col("total"), size), digits).alias("eq_weight_portfolio_return")
    )


# ---- resampling ------------------------------------------------------------------------------

def week_ending(date="date"):
    """The Friday that closes the week of a date."""
    return F.next_day(F.date_sub(F.col(date), 1), "FRI")


def weekly_close(bars):
    return bars.groupBy("ticker", week_ending().alias("week")).agg(
        F.max_by("close", F.when(F.col("close").isNotNull(), F.col("date"))).alias("close")
    )


def weekly_sector_return(returns):
    return (
        returns.groupBy("sector", week_ending().alias("week"))
        .agg(F.avg("daily_return").alias("avg_return"))
    )


def weekly_close_arrays(bars):
    """Weekly closes per ticker as one ordered list, dates alongside; a list spans the calendar."""
    weeks = F.sort_array(F.collect_list(F.struct("week", "close")))
    return (
        weekly_close(bars)
        .groupBy("ticker")
        .agg(weeks.alias("w"))
        .select("ticker", F.col("w.week").alias("weeks"), F.col("w.close").alias("closes"))
    )


def weekly_sector_arrays(returns):
    weeks = F.sort_array(F.collect_list(F.struct("week", "avg_return")))
    return (
        weekly_sector_return(returns)
        .groupBy("sector")
        .agg(weeks.alias("w"))
        .select("sector", F.col("w.week").alias("weeks"), F.col("w.avg_return").alias("returns"))
    )


def monthly_returns(returns):
    """Compounded return per ticker and month."""
    return (
        returns.filter(F.col("daily_return").isNotNull())
        .groupBy("ticker", "sector", F.trunc("date", "month").alias("month"))
        .agg((F.product(1 + F.col("daily_return")) - 1).alias("monthly_return"))
    )


def monthly_heatmap(returns):
    """Mean monthly return by sector and calendar month, months across."""
    names = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
    return (
        monthly_returns(returns)
        .withColumn("m", F.date_format("month", "MMM"))
        .groupBy("sector")
        .pivot("m", names)
        .agg(F.avg("monthly_return"))
    )


def market_index(returns):
    """Equal-weight index per date: return, level, cumulative return and drawdown."""
    daily = (
        returns.filter(F.col("daily_return").isNotNull())
        .groupBy("date")
        .agg(F.avg("daily_return").alias("index_return"), F.count(F.lit(1)).alias("n_tickers"))
    )
    # One row per date from here on. Growth is summed in logs: compounding decades of dates overflows.
    path = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    level = daily.withColumn("cum_log_return", F.sum(F.log1p("index_return")).over(path))
    peak = F.max("cum_log_return").over(path)
    return level.select(
        "date", "n_tickers", "index_return", "cum_log_return",
        (100 * F.exp("cum_log_return")).alias("index_level"),
        F.expm1("cum_log_return").alias("cum_return"),
        F.expm1(F.col("cum_log_return") - peak).alias("drawdown"),
    )


def histogram(df, value, low, high, bins):
    """Counts per equal-width bin; bin 0 is below ``low`` and ``bins + 1`` at or above ``high``."""
    width = (high - low) / bins
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("bin_start", F.lit(low) + (F.col("bin") - 1) * width)
    )


# ---- calendar --------------------------------------------------------------------------------

def calendar(df, start=None, end=None):
    """Weekdays from the first to the last date of ``df`` (or the given ends) with date parts."""
    span = df.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).select(
        (F.lit(start).cast("date") if start else F.col("lo")).alias("lo"),
        (F.lit(end).cast("date") if end else F.col("hi")).alias("hi"),
    )
    days = span.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("date"))
    return days.filter(F.weekday("date") < 5).select(
        "date",
        F.year("date").alias("year"),
        F.quarter("date").alias("quarter"),
        F.month("date").alias("month_num"),
        F.date_format("date", "MMM").alias("month_name"),
        F.weekofyear("date").alias("week"),
        F.date_format("date", "EEE").alias("day_of_week"),
        F.lit(1).alias("is_trading_day"),
    )


def trading_days_ago(days, n):
    """The ``n``-th weekday back from the last one, which counts as the first."""
    w = Window.orderBy(F.desc("date"))
    return (
        days.select("date").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n)
        .agg(F.min("date").alias("date"))
    )
