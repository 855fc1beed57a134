"""Risk metrics of return series."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from barwise.constants import RISK_FREE, TRADING_DAYS, Z_SCORES
from barwise.functions.expr import half_up
from barwise.functions.percentiles import exact_percentiles

METRICS = {
    "total_return": 6, "annualised_return": 6, "annualised_volatility": 6, "sharpe_ratio": 4,
    "sortino_ratio": 4, "max_drawdown": 6, "calmar_ratio": 4, "var_95": 6, "cvar_95": 6,
    "var_99": 6, "win_rate": 4, "best_day": 6, "worst_day": 6, "skewness": 4, "kurtosis": 4,
}


def risk_profile(returns, by, ret="daily_return", risk_free=RISK_FREE, min_obs=2, periods=TRADING_DAYS, market=None):
    """Fifteen metrics per group of a return series (one row per group and date), of which ``periods`` make a year. With the
    name of a ``market`` return column also beta, alpha, treynor_ratio and information_ratio, on the dates that have one.

    A group is a ticker, a scenario or a portfolio: its rows are bounded by the calendar, so the
    running product and the final aggregation share one shuffle on ``by``. Groups with fewer than
    ``min_obs`` returns are left out.
    """
    r = F.col("_r")
    group = Window.partitionBy(*by)
    path = group.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    df = (
        returns.select(*by, "date", F.col(ret).alias("_r"), *([F.col(market).alias("_m")] if market else []))
        .filter(r.isNotNull())
        .withColumns(
            {
                "_growth": F.product(1 + r).over(path),
                "_mean": F.avg(r).over(group),
                "_dev": F.stddev_samp(r).over(group),
            }
        )
        .withColumns(
            {
                "_peak": F.max("_growth").over(path),
                "_var95": F.col("_mean") - Z_SCORES[0.95] * F.col("_dev"),
            }
        )
    )
    loss = F.when(r < 0, r)
    n = F.count(r).cast("double")
    m = F.col("_m")
    against = {
        "cov": F.covar_samp(r, m), "var": F.var_samp(m), "bm": F.avg(m) * periods, "te": F.stddev_samp(r - m) * periods**0.5,
    } if market else {}
    agg = df.groupBy(*by).agg(
        F.count(r).alias("n"),
        (F.product(1 + r) - 1).alias("total_return"),
        F.stddev_samp(r).alias("dev"),
        F.avg(r).alias("mean"),
        F.stddev_samp(loss).alias("down_dev"),
        F.count(loss).alias("n_down"),
        F.min(F.try_divide(F.col("_growth") - F.col("_peak"), F.col("_peak"))).alias("max_drawdown"),
        F.avg(F.when(r <= F.col("_var95"), r)).alias("tail_mean"),
        F.try_divide(F.count(F.when(r > 0, 1)).cast("double"), n).alias("win_rate"),
        F.max(r).alias("best_day"),
        F.min(r).alias("worst_day"),
        F.skewness(r).alias("g1"),
        F.kurtosis(r).alias("g2"),
        *[a.alias(k) for k, a in against.items()],
    ).filter(F.col("n") >= min_obs)

    n = F.col("n").cast("double")
    agg = agg.withColumns(
        {
            "annualised_return": F.pow(
                1 + F.col("total_return"),
                1 / F.greatest(n / periods, F.lit(1.0)),
            ) - 1,
            "annualised_volatility": F.col("dev") * periods**0.5,
            "var_95": F.col("mean") - Z_SCORES[0.95] * F.col("dev"),
            "var_99": F.col("mean") - Z_SCORES[0.99] * F.col("dev"),
        }
    )
    excess = F.col("annualised_return") - risk_free
    vol = F.col("annualised_volatility")
    downside = F.when(F.col("n_down") > 1, F.col("down_dev") * periods**0.5).otherwise(vol)
    ratio = lambda top, base: F.when(base > 0, F.try_divide(top, base)).otherwise(0.0)
    # Bias-corrected shape of the sample; a constant series has none.
    skew = F.when(
        n >= 3,
        F.when(F.col("dev") == 0, 0.0).otherwise(
            F.col("g1") * F.try_divide(F.sqrt(n * (n - 1)), n - 2)
        ),
    )
    kurt = F.when(
        n >= 4,
        F.when(F.col("dev") == 0, 0.0).otherwise(
            F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)
        ),
    )
    ann, bm, te = F.col("annualised_return"), F.col("bm"), F.col("te")
    moves = F.col("var") > 0
    beta = F.when(moves, F.try_divide(F.col("cov"), F.col("var")))
    compared = [
        beta.alias("beta"), (ann - (risk_free + beta * (bm - risk_free))).alias("alpha"),
        F.try_divide(ann - risk_free, beta).alias("treynor_ratio"),
        F.when(moves & (te > 0), F.try_divide(ann - bm, te)).alias("information_ratio"),
    ] if market else []
    return agg.select(
        *by, "n",
        "total_return", "annualised_return", "annualised_volatility",
        ratio(excess, vol).alias("sharpe_ratio"),
        ratio(excess, downside).alias("sortino_ratio"),
        "max_drawdown",
        ratio(F.col("annualised_return"), -F.col("max_drawdown")).alias("calmar_ratio"),
        "var_95",
        F.coalesce("tail_mean", "var_95").alias("cvar_95"),
        "var_99", "win_rate", "best_day", "worst_day",
        skew.alias("skewness"), kurt.alias("kurtosis"), "mean", *compared,
    )


def rounded(profile, by, digits=METRICS):
    return profile.select(*by, *[half_up(c, d).alias(c) for c, d in digits.items()])


def risk_metrics(returns, risk_free=RISK_FREE):
    return rounded(risk_profile(returns, ["ticker"], risk_free=risk_free), ["ticker"])


def _tails(found, levels):
    """Columns var_NN of each level and cvar_NN of the first from rows of (p, percentile, tail_mean)."""
    at = lambda level, c: F.max(F.when(F.col("p") == round(1 - level, 10), F.col(c)))
    name = lambda level: f"var_{round(level * 100)}"
    return [*[at(lv, "percentile").alias(name(lv)) for lv in levels], at(levels[0], "tail_mean").alias("c" + name(levels[0]))]


def tail_risk(returns, by, levels=(0.95, 0.99)):
    """Historical value at risk per level and expected shortfall at the first, per group of any size: exact percentiles
    and the means up to them, from one selection over two reads of the returns."""
    found = exact_percentiles(returns, "daily_return", [round(1 - lv, 10) for lv in levels], by)
    return found.groupBy(*by).agg(*_tails(found, levels))


def selection_tail_risk(returns, levels=(0.95, 0.99)):
    """The same over all rows as one struct scalar: var_95, var_99, cvar_95."""
    found = exact_percentiles(returns, "daily_return", [round(1 - lv, 10) for lv in levels])
    one = found.agg(*_tails(found, levels))
    return one.select(F.struct(*one.columns)).scalar()


def approximate_tail_risk(returns, by, levels=(0.95, 0.99), accuracy=10_000):
    """Value at risk by a mergeable quantile sketch in one read: ranks are off by at most 1 / ``accuracy`` of a group, and
    no value between two returns is given."""
    probs = [round(1 - lv, 10) for lv in levels]
    found = returns.groupBy(*by).agg(F.percentile_approx("daily_return", probs, accuracy).alias("q"))
    return found.select(*by, *[F.col("q")[i].alias(f"var_{round(lv * 100)}") for i, lv in enumerate(levels)])
