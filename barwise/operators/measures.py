"""Business measures over the bars in view.

Measures follow one scope rule: return terms are taken per group, while volatility, tail and
breadth terms cover the whole selection. Whole-selection terms are scalar subqueries, so no table
is joined to a single row and nothing is fetched to the driver. Percentages of a zero base are null.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from barwise.constants import RISK_FREE, Z_SCORES
from barwise.functions.expr import ANNUAL, change, count_if, scalar
from barwise.functions.rolling import calendar_frame, population_dev
from barwise.operators.risk import selection_tail_risk
from barwise.operators.scenario import capm, scenario_array
from barwise.operators.signals import signal_label

HORIZONS = {"return_1m": 1, "return_3m": 3, "return_6m": 6, "return_1y": 12}
ANNUALISED = {"return_3y_ann": 3, "return_5y_ann": 5, "return_10y_ann": 10, "return_20y_ann": 20}


def last_two_dates(df):
    """The last and the previous date as an array; a set of dates is bounded by the calendar."""
    return df.agg(F.slice(F.sort_array(F.collect_set("date"), False), 1, 2)).scalar()


def core(returns, by=("sector",)):
    d = F.col("date")
    df = returns.withColumn("_ends", last_two_dates(returns))
    last, prev = F.col("_ends")[0], F.try_element_at("_ends", F.lit(2))
    seen = F.when(F.col("close").isNotNull(), F.struct("date", "ticker"))
    week = F.when((d >= F.date_sub(last, 7)) & (d <= last), seen)
    close = F.col("close")
    agg = df.groupBy(*by).agg(
        F.avg("daily_return").alias("daily_return"),
        F.max_by("close", seen).alias("latest_close"),
        F.max("close").alias("latest_close_literal"),
        F.avg(F.when(d == last, close)).alias("today"),
        F.avg(F.when(d == prev, close)).alias("yesterday"),
        F.min_by("close", week).alias("week_start"),
        F.min(F.when(week.isNotNull(), close)).alias("week_low"),
    )
    return agg.select(
        *by, "daily_return", "latest_close", "latest_close_literal",
        change("today", "yesterday").alias("return_1d"),
        # Without a bar inside the week there is no start.
        F.when(F.col("week_low").isNotNull(), change("latest_close", "week_start")).alias("return_5d"),
        change("latest_close_literal", "week_low").alias("return_5d_literal"),
    )


def _months_back(end, months):
    return F.add_months(end, -months)


def horizon(bars, by=("sector",)):
    """Mean close up to the end against mean close up to the horizon's start."""
    df = bars.select(*by, "date", "close").withColumn("_end", scalar(bars, F.max("date")))
    end, d, close = F.col("_end"), F.col("date"), F.col("close")
    spans = {**HORIZONS, **{k: 12 * v for k, v in ANNUALISED.items()}}
    agg = df.groupBy(*by).agg(
        F.avg(F.when(d <= end, close)).alias("_now"),
        *[F.avg(F.when(d <= _months_back(end, m), close)).alias(k) for k, m in spans.items()],
    )
    total = {k: change("_now", k) for k in spans}
    return agg.select(
        *by,
        *[total[k].alias(k) for k in HORIZONS],
        *[(F.pow(1 + total[k], 1.0 / y) - 1).alias(k) for k, y in ANNUALISED.items()],
    )


def horizon_asof(bars, by=("ticker",)):
    """Close at or before the end against close at or before the horizon's start."""
    df = bars.select(*by, "date", "close").withColumn("_end", scalar(bars, F.max("date")))
    end, d = F.col("_end"), F.col("date")
    spans = {**HORIZONS, **{k: 12 * v for k, v in ANNUALISED.items()}}
    agg = df.filter(F.col("close").isNotNull()).groupBy(*by).agg(
        F.max_by("close", d).alias("_now"),
        *[F.max_by("close", F.when(d <= _months_back(end, m), d)).alias(f"_v_{k}")
          for k, m in spans.items()],
        *[F.min(F.when(d <= _months_back(end, m), d)).alias(f"_d_{k}") for k, m in spans.items()],
    )
    # A start before the first bar has no close to compare with.
    total = {
        k: F.when(F.col(f"_d_{k}").isNotNull(), change("_now", f"_v_{k}")) for k in spans
    }
    return agg.select(
        *by,
        *[total[k].alias(k) for k in HORIZONS],
        *[(F.pow(1 + total[k], 1.0 / y) - 1).alias(k) for k, y in ANNUALISED.items()],
    )


def selection_stats(returns):
    """Whole-selection spread and win counts as one struct."""
    r = F.col("daily_return")
    return returns.agg(
        F.struct(
            F.stddev_pop(r).alias("dev"),
            F.stddev_pop(F.when(r < 0, r)).alias("down_dev"),
            count_if(r > 0).cast("double").alias("wins"),
            count_if(r != 0).cast("double").alias("moves"),
            F.avg(r).alias("mean"),
        )
    ).scalar()


def selection_drawdown(returns):
    """Lowest cumulative log return below the selection's overall peak. Dates are aggregated before
    they are put in order."""
    daily = returns.groupBy("date").agg(F.sum(F.log1p("daily_return")).alias("x"))
    path = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return (
        daily.withColumn("cum", F.sum("x").over(path)).agg(F.min("cum") - F.max("cum")).scalar()
    )


def risk(returns, fundamentals, by=("sector",), risk_free=RISK_FREE):
    tails = selection_tail_risk(returns)
    groups = returns.groupBy(*by).agg((F.avg("daily_return") * 252).alias("annualised_return"))
    betas = fundamentals.groupBy(*by).agg(F.avg("beta").alias("average_beta"))
    df = (
        groups.join(betas, list(by), "left")
        .withColumns(
            {
                "_s": selection_stats(returns),
                "_t": tails,
                "max_drawdown": selection_drawdown(returns),
            }
        )
    )
    ann = F.col("annualised_return")
    vol = F.col("_s.dev") * ANNUAL
    return df.select(
        *by, "annualised_return",
        vol.alias("annualised_volatility"),
        F.try_divide(ann - risk_free, vol).alias("sharpe_ratio"),
        F.try_divide(ann - risk_free, F.col("_s.down_dev") * ANNUAL).alias("sortino_ratio"),
        F.col("_t.var_95").alias("var_95"),
        F.col("_t.var_99").alias("var_99"),
        F.col("_t.cvar_95").alias("cvar_95"),
        "max_drawdown",
        F.try_divide(F.col("_s.wins"), F.col("_s.moves")).alias("win_rate"),
        "average_beta",
        F.try_divide(ann, F.abs("max_drawdown")).alias("calmar_ratio"),
    )


def breadth(returns):
    """Advance and decline on the last date, and tickers at a 52-week high."""
    r, d = F.col("daily_return"), F.col("date")
    df = returns.withColumn("_last", scalar(returns, F.max("date")))
    last = F.col("_last")
    today = d == last
    per_ticker = df.groupBy("ticker").agg(
        count_if(today & (r > 0)).alias("up"),
        count_if(today & (r < 0)).alias("down"),
        F.max(F.when(today, F.col("close"))).alias("close_today"),
        F.max(F.when((d >= F.date_sub(last, 365)) & (d < last), F.col("high"))).alias("high_52w"),
    )
    fresh = F.col("close_today") >= F.coalesce("high_52w", F.lit(0.0))
    up, down = F.sum("up"), F.sum("down")
    return per_ticker.agg(
        F.try_divide(up.cast("double"), up + down).alias("market_breadth"),
        up.alias("n_advancing"),
        down.alias("n_declining"),
        count_if(fresh).alias("new_52w_highs"),
    )


def scenario(returns, fundamentals, keys=("bull", "base", "bear", "stagflation", "rate_shock"),
             risk_free=RISK_FREE):
    stats = returns.agg(
        F.stddev_pop("daily_return").alias("dev"), F.avg("daily_return").alias("mean")
    ).withColumn("beta", scalar(fundamentals, F.avg("beta")))
    df = stats.withColumn("_s", F.explode(scenario_array(keys))).select("dev", "mean", "beta", "_s.*")
    ret = capm(F.col("beta"), F.col("mkt_return_shock"), risk_free)
    day_vol = F.col("dev") * F.col("vol_multiplier")
    vol = day_vol * ANNUAL
    return df.select(
        "scenario_name",
        ret.alias("scenario_return"),
        vol.alias("scenario_vol"),
        F.try_divide(ret - risk_free, vol).alias("scenario_sharpe"),
        (F.col("mean") - Z_SCORES[0.95] * day_vol).alias("scenario_var_95"),
        (-2 * vol).alias("scenario_max_drawdown"),
    )


def sector(returns, universe, risk_free=RISK_FREE):
    """Sector mean of the tickers' one-year return, against selection volatility, with weights."""
    one_year = horizon(returns, ("sector", "ticker")).groupBy("sector").agg(
        F.avg("return_1y").alias("sector_return_1y")
    )
    weights = universe.groupBy("sector").agg(F.sum("weight_pct").alias("sector_weight"))
    vol = scalar(returns, F.stddev_pop("daily_return")) * ANNUAL
    df = one_year.join(weights, "sector", "left").withColumn(
        "sector_sharpe", F.try_divide(F.col("sector_return_1y") - risk_free, vol)
    )
    return df.withColumn(
        "sector_sharpe_contribution", F.col("sector_sharpe") * F.col("sector_weight") / 100
    )


def volume(bars, by=("sector",)):
    """Totals per group, and last-date volume against the mean row volume of the latest 20 earlier
    rows of the selection (rows of the 20th row's date all count).

    The 20 latest rows are found on per-date counts, so rows are never ranked globally.
    """
    daily = bars.groupBy("date").agg(
        F.sum("volume").alias("v"), F.count("volume").alias("c"), F.count(F.lit(1)).alias("n")
    )
    newer = Window.orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, -1)
    base = (
        daily.filter(F.col("date") < scalar(bars, F.max("date")))
        .withColumn("before", F.coalesce(F.sum("n").over(newer), F.lit(0)))
        .filter("before < 20")
        .agg(F.try_divide(F.sum("v").cast("double"), F.sum("c")))
        .scalar()
    )
    df = bars.select(*by, "date", "volume").withColumn("_last", scalar(bars, F.max("date")))
    per_day = df.groupBy(*by, "date").agg(
        F.sum("volume").alias("v"), F.max(F.col("date") == F.col("_last")).alias("is_last")
    )
    return (
        per_day.groupBy(*by)
        .agg(
            F.sum("v").alias("total_volume"),
            F.avg("v").alias("avg_daily_volume"),
            F.sum(F.when(F.col("is_last"), F.col("v"))).alias("today"),
        )
        .withColumn("volume_ratio_20d", F.try_divide(F.col("today").cast("double"), base))
        .drop("today")
    )


def rolling(returns):
    """Trailing one-year ratio and quarter volatility per ticker over calendar-day frames, merged from day blocks."""
    df = calendar_frame(returns, 365, {"_y": "daily_return"})
    df = calendar_frame(df, 90, {"_q": "daily_return"})
    ratio = F.try_divide(F.col("_y_mean") * 252 - RISK_FREE, population_dev("_y") * ANNUAL)
    df = df.withColumns({"rolling_252d_sharpe": ratio, "rolling_60d_vol": population_dev("_q") * ANNUAL})
    return df.drop(*[c for c in df.columns if c.startswith(("_y_", "_q_"))])


def volatility_label(vol):
    return F.when(vol > 0.35, "High Volatility").when(vol > 0.20, "Normal").otherwise("Low Volatility")


def signal(returns):
    """Per ticker: one-year return, 21-day strength approximation and the two labels."""
    r, d = F.col("daily_return"), F.col("date")
    ends = returns.groupBy("ticker").agg(F.max("date").alias("_last"))
    # Both sides are grouped by ticker, so one partitioning serves the join and the aggregation.
    recent = returns.join(ends, "ticker").filter(d >= F.date_sub("_last", 21))
    strength = recent.groupBy("ticker").agg(
        F.coalesce(F.avg(F.when(r > 0, r)), F.lit(0.0)).alias("up"),
        F.abs(F.coalesce(F.avg(F.when(r < 0, r)), F.lit(0.0))).alias("down"),
    )
    vol = scalar(returns, F.stddev_pop("daily_return")) * ANNUAL
    rsi = 100 - 100 / (1 + F.col("up") / (F.col("down") + 0.000001))
    return (
        horizon(returns, ("ticker",)).select("ticker", "return_1y")
        .join(strength, "ticker")
        .select("ticker", "return_1y", rsi.alias("rsi_14"))
        .withColumn("signal_label", signal_label(use_volatility=False))
        .withColumn("volatility_regime", volatility_label(vol))
    )


def sector_rotation(bars):
    """Quadrants by three- and one-month return around zero, and rank by one-year return."""
    x, y = F.col("return_3m"), F.col("return_1m")
    sectors = (
        horizon_asof(bars, ("sector", "ticker"))
        .groupBy("sector")
        .agg(*[F.avg(c).alias(c) for c in ("return_1m", "return_3m", "return_1y")])
    )
    quadrant = (
        F.when((x >= 0) & (y >= 0), "Leading").when(x >= 0, "Weakening")
        .when(y < 0, "Lagging").otherwise("Improving")
    )
    # One row per sector.
    rank = F.rank().over(Window.orderBy(F.col("return_1y").desc_nulls_last()))
    return sectors.withColumns({"quadrant": quadrant, "momentum_rank": rank})
