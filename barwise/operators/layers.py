"""Bronze, silver and gold tables as plain functions over frames."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from barwise.constants import RISK_FREE
from barwise.functions.expr import ANNUAL, count_if, half_up
from barwise.functions.windows import running
from barwise.operators import cleanse, features
from barwise.operators.scenario import with_market_scenario
from barwise.operators.signals import with_signal_score


def bronze(text, tasks=None):
    """Typed, one row per (ticker, date), with lineage. With ``tasks`` rows are dealt by ticker to so many tasks first, which
    serves what follows too; for rows that do not repeat without bound."""
    typed = cleanse.conform_bars(text)
    if tasks is not None:
        typed = typed.repartition(tasks, "ticker")
    return bronze_rows(typed)


def bronze_rows(typed):
    """One row per (ticker, date) of typed bars, with lineage."""
    return cleanse.with_lineage(cleanse.dedup_bars(typed), stamp="_bronze_loaded_at")


def silver(bronze_bars, min_days=252, outlier=0.50):
    """Sane bars with returns, liquid tickers only, extreme moves flagged. Returns are taken before
    the liquidity gate; both use the ticker window."""
    df = bronze_bars.filter(cleanse.sane(low_tolerance=0.001))
    df = features.with_returns(df).withColumn(
        "_n_days", F.count("date").over(Window.partitionBy("ticker"))
    )
    return (
        df.filter(F.col("_n_days") >= min_days)
        .withColumn("is_outlier", F.coalesce(F.abs("daily_return") > outlier, F.lit(False)))
        .drop("_n_days", "prev_close")
    )


def silver_features(silver_bars):
    """Full-window features; strength from price differences, volatility from simple returns."""
    prev = F.lag("close").over(features.timeline())
    moves = (
        {"_prev": prev},
        {"move": F.col("close") - F.col("_prev"), "r": features.change("close", "_prev")},
    )
    df = features.add(silver_bars, moves, features.roc_columns((20, 252)))
    df = features.long_sma(df, 200, full=True)
    df = features.add(
        df,
        features.sma_columns(full=True),
        features.rsi_full_columns("move"),
        features.volatility_columns(source="r", full=True),
        features.bollinger_columns(full=True, position="bb_pct"),
        ({"growth": F.product(1 + F.col("r")).over(running())}, {}),
    )
    return features.add(df, features.growth_drawdown()).drop("move", "r", "growth", "bb_mid", "bb_std")


def gold_fact(silver_feature_rows):
    """Fact rows with regime, score and partition columns."""
    df = with_signal_score(with_market_scenario(silver_feature_rows))
    return df.withColumns({"year": F.year("date"), "quarter": F.quarter("date")})


def sector_scenario_agg(fact, risk_free=RISK_FREE):
    r = F.col("daily_return")
    agg = (
        fact.filter(r.isNotNull())
        .groupBy("sector", "market_scenario")
        .agg(
            F.count_distinct("ticker").alias("n_equities"),
            (F.avg(r) * 252).alias("avg_return_ann"),
            (F.stddev_samp(r) * ANNUAL).alias("volatility_ann"),
            F.try_divide(count_if(r > 0).cast("double"), F.count(r)).alias("win_rate"),
            F.avg("rsi_14").alias("avg_rsi"),
            F.avg("vol_20d").alias("avg_vol_20d"),
        )
    )
    vol = F.col("volatility_ann")
    sharpe = (F.col("avg_return_ann") - risk_free) / F.when(vol == 0, 1e-8).otherwise(vol)
    agg = agg.withColumn("sharpe", sharpe)
    values = ["avg_return_ann", "volatility_ann", "win_rate", "avg_rsi", "avg_vol_20d", "sharpe"]
    return agg.select(
        "sector", "market_scenario", "n_equities", *[half_up(c, 4).alias(c) for c in values]
    )


def medallion(text, min_days=252, tasks=None):
    """All layers, lazily: each is a frame over the one before. ``tasks``: as for ``bronze``."""
    b = bronze(text, tasks)
    s = silver(b, min_days)
    f = silver_features(s)
    g = gold_fact(f)
    return {"bronze": b, "silver": s, "features": f, "gold": g, "sector_agg": sector_scenario_agg(g)}


def export_features(bars):
    """Distribution copy: full-window features on returns, drawdown in percent, four digits."""
    df = features.long_sma(features.with_returns(bars), 200, full=True)
    df = features.add(
        df,
        features.sma_columns(full=True),
        features.rsi_full_columns("daily_return"),
        features.volatility_columns((20,), source="daily_return", full=True),
        ({"growth": F.product(1 + F.col("daily_return")).over(running())}, {}),
    )
    df = features.add(df, features.growth_drawdown(name="drawdown_pct"))
    df = df.withColumn("drawdown_pct", 100 * F.col("drawdown_pct"))
    values = [
        "open", "high", "low", "close", "daily_return", "sma_20", "sma_50", "sma_200", "rsi_14",
        "vol_20d", "drawdown_pct",
    ]
    return df.select(
        "ticker", "date", "volume", "sector", *[half_up(c, 4).alias(c) for c in values]
    )


# The columns of the published export.
EXPORT_FUNDAMENTALS = [
    "ticker", "name", "sector", "sub_industry", "beta", "market_cap_cat", "weight_pct", "pe_ratio",
    "dividend_yield", "roe", "debt_to_equity", "market_cap",
]


def export_fundamentals(fundamentals):
    return fundamentals.select(*[c for c in EXPORT_FUNDAMENTALS if c in fundamentals.columns])
