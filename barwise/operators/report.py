"""The tables of the market report from one feature table.

Callers store the feature columns once (``FEATURES``); every table then reads only those it needs of them. The tables are one
result in long form: section, name, metric, value.
"""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from barwise.functions.expr import half_up
from barwise.operators import market
from barwise.operators.features import market_returns
from barwise.operators.risk import risk_profile, rounded

FEATURES = ["ticker", "date", "sector", "market_cap_category", "exchange", "close", "daily_return", "sma_50", "sma_200", "roc_252",
            "vol_20d", "rsi_14", "beta", "pe_ratio", "dividend_yield"]
RISK = ["annualised_volatility", "max_drawdown", "var_95", "var_99", "cvar_95", "win_rate", "best_day", "worst_day"]


def _long(df, section, name, metrics):
    """A row for every metric of every row."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return df.select(F.lit(section).alias("section"), F.col(name).alias("name"), F.explode(cells).alias("c")).select("section", "name", "c.*")


def sectors(features, days=252, as_of=None):
    """Every sector and the whole market (``all``) in one pass over the look-back."""
    mean, dev, ratio = market.performance()
    rows = market.since(features, days, as_of).filter(F.col("daily_return").isNotNull())
    both = rows.groupingSets([[F.col("sector")], []], "sector").agg(
        F.grouping("sector").alias("whole"), F.count_distinct("ticker").alias("n_equities"),
        half_up(mean, 4).alias("avg_return"), half_up(dev, 4).alias("volatility"), half_up(ratio, 4).alias("sharpe"),
        half_up(F.avg("beta"), 3).alias("avg_beta"),
    )
    return both.withColumn("name", F.when(F.col("whole") == 1, "all").otherwise(F.col("sector"))).drop("whole", "sector")


def ends(rankings, n=10):
    """Both ends of the ranking with their position; each is a top-k, so its window holds ``n`` rows."""
    sides = []
    for side, order in (("top", F.desc("return_1y")), ("bottom", F.asc("return_1y"))):
        rows = rankings.orderBy(order, "ticker").limit(n)
        sides.append(rows.withColumn("position", F.row_number().over(Window.orderBy(order, "ticker"))).withColumn("side", F.lit(side)))
    return sides[0].unionByName(sides[1])


def bundle(features, scenarios, n=10, as_of=None):
    """All tables: ``kpi``, ``sector``, ``top``, ``bottom``, ``scenario`` and ``risk``. ``scenarios``: a row per scenario, as from
    ``measures.scenario``."""
    rankings = market.equity_rankings(features)
    kpi = rankings.agg(
        F.count("ticker").alias("total_equities"), half_up(F.avg("return_1y"), 3).alias("avg_return_1y"), half_up(F.avg("vol_20d"), 3).alias("avg_vol")
    ).withColumn("name", F.lit("market"))
    placed = ends(rankings, n)
    shown = ["position", "return_1y", "vol_20d", "beta", "pe_ratio"]
    series = market_returns(features.filter(F.col("daily_return").isNotNull())).withColumn("name", F.lit("market"))
    risk = rounded(risk_profile(series, ["name"], ret="mkt_return"), ["name"])
    parts = [
        _long(kpi, "kpi", "name", ["total_equities", "avg_return_1y", "avg_vol"]),
        _long(sectors(features, as_of=as_of), "sector", "name", ["n_equities", "avg_return", "volatility", "sharpe", "avg_beta"]),
        _long(placed.filter("side = 'top'"), "top", "ticker", shown),
        _long(placed.filter("side = 'bottom'"), "bottom", "ticker", shown),
        _long(scenarios, "scenario", "scenario_name", [c for c in scenarios.columns if c != "scenario_name"]),
        _long(risk, "risk", "name", RISK),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)
