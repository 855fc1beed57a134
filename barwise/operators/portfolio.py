"""Weighted portfolios: returns per period, the portfolio's series, and its risk against a benchmark.

``weights`` is a table (ticker, weight) with one row per ticker. Tickers without returns drop out and the others are scaled
to 1. A portfolio has a return on a date if every known ticker has one (the dates are aligned). Where tickers share few
trading days, their returns are first compounded per month or another period, and figures are annualised by the number of
such periods in a year.

Everything is one pass: the returns of held tickers are summed by date and by ticker. The second sum is one row per held
ticker and gives the total weight, the number of tickers and the weights as one scalar.
"""

from pyspark.sql import functions as F

from barwise.constants import RISK_FREE, TRADING_DAYS
from barwise.operators.risk import METRICS, risk_profile, rounded

PERIODS = {"week": 52, "month": 12, "quarter": 4, "year": 1}
LONG_RUN = ["total_return", "annualised_return", "annualised_volatility", "sharpe_ratio", "sortino_ratio", "max_drawdown",
            "calmar_ratio", "var_95", "cvar_95", "var_99"]
AGAINST = {"beta": 4, "alpha": 4, "treynor_ratio": 4, "information_ratio": 4}


def compound(returns, period="month", by=("ticker",), ret="daily_return"):
    """Compounded return of each group and calendar period: by, date (the period's first day), ``ret``."""
    r = F.col(ret)
    return (
        returns.filter(r.isNotNull())
        .groupBy(*by, F.trunc("date", period).alias("date"))
        .agg((F.product(1 + r) - 1).alias(ret))
    )


def holding(returns, weights, ret="daily_return"):
    """ticker, date, ``ret``, weight of the held tickers; dates without a return are out."""
    return returns.filter(F.col(ret).isNotNull()).select("ticker", "date", ret).join(weights.select("ticker", "weight"), "ticker")


def stake(held):
    """The known part of the weights as one struct scalar: total, n and weights (a map that sums to 1)."""
    known = held.groupBy("ticker").agg(F.max("weight").alias("weight"))
    entries = F.sort_array(F.collect_list(F.struct("ticker", "weight")))  # an entry per held ticker
    one = known.agg(F.sum("weight").alias("total"), F.count("weight").alias("n"), F.map_from_entries(entries).alias("each"))
    shares = F.transform_values("each", lambda _, w: F.try_divide(w, F.col("total")))
    return one.select(F.struct("total", "n", shares.alias("weights"))).scalar()


def series(held, ret="daily_return"):
    """The portfolio's return on every date on which all its tickers have one. ``held``: as from ``holding``."""
    known = stake(held)
    by_date = held.groupBy("date").agg(F.sum(F.col("weight") * F.col(ret)).alias("sum"), F.count("weight").alias("n"))
    return by_date.filter(F.col("n") == known["n"]).select("date", F.try_divide("sum", known["total"]).alias(ret))


def metrics(returns, weights, benchmark=None, periods=TRADING_DAYS, risk_free=RISK_FREE, ret="daily_return"):
    """One row of portfolio metrics with the weights taken; with a ``benchmark`` (date, mkt_return) also beta, alpha, Treynor
    and information ratio on the common dates. ``periods``: how many of the dates make a year."""
    held = holding(returns, weights, ret)
    path = series(held, ret).withColumn("portfolio", F.lit("portfolio"))
    if benchmark is not None:
        path = path.join(benchmark.select("date", "mkt_return"), "date", "left")
    found = risk_profile(path, ["portfolio"], ret=ret, risk_free=risk_free, periods=periods, market=benchmark is not None and "mkt_return")
    digits = {k: METRICS[k] for k in LONG_RUN} | (AGAINST if benchmark is not None else {})
    return rounded(found, ["portfolio"], digits).withColumn("weights", stake(held)["weights"])


def bundle(returns, weights, path, path_periods=TRADING_DAYS, risk_free=RISK_FREE):
    """Metrics of each held ticker from its own daily returns, whether or not the others trade on these days, and of the
    portfolio from its series ``path`` (date, daily_return) with ``path_periods`` dates a year."""
    held = holding(returns, weights)
    known = stake(held)
    parts = rounded(risk_profile(held, ["ticker"], risk_free=risk_free), ["ticker"]).join(weights.select("ticker", "weight"), "ticker")
    parts = parts.withColumn("weight", F.try_divide("weight", known["total"]))
    whole = risk_profile(path.withColumn("ticker", F.lit("PORTFOLIO")), ["ticker"], risk_free=risk_free, periods=path_periods)
    return parts.unionByName(rounded(whole, ["ticker"]).withColumn("weight", F.lit(1.0)))
