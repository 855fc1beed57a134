"""Investment scores and labels."""

from pyspark.sql import functions as F

from barwise.functions.expr import half_up


def _bucket(value, *cuts, rising):
    """Score 5 down to 1 by thresholds; a null scores 1."""
    c = F.col(value)
    out = F.when((c > cuts[0]) if rising else (c < cuts[0]), 5)
    for score, cut in zip((4, 3, 2), cuts[1:]):
        out = out.when((c > cut) if rising else (c < cut), score)
    return out.otherwise(1)


def composite_score():
    """Weighted 1-5 buckets of momentum, strength, volatility and value."""
    return (
        0.40 * _bucket("return_1y", 0.30, 0.15, 0.00, -0.15, rising=True)
        + 0.20 * _bucket("rsi_14", 30, 45, 55, 70, rising=False)
        + 0.20 * _bucket("vol_20d", 0.20, 0.30, 0.40, 0.50, rising=False)
        + 0.20 * _bucket("pe_ratio", 10, 18, 25, 40, rising=False)
    )


def signal_label(use_volatility=True):
    ret, rsi = F.col("return_1y"), F.col("rsi_14")
    strong = (ret > 0.20) & (rsi < 65)
    if use_volatility:
        strong &= F.col("vol_20d") < 0.40
    return (
        F.when(strong, "Strong Buy")
        .when((ret > 0.05) & (rsi < 70), "Buy")
        .when(ret > -0.05, "Hold")
        .when(ret > -0.20, "Sell")
        .otherwise("Strong Sell")
    )


def investment_signals(rankings):
    return (
        rankings.filter(F.col("return_1y").isNotNull())
        .select(
            "ticker", "sector", "latest_close", "return_1y", "vol_20d", "rsi_14", "beta", "pe_ratio",
            half_up(composite_score(), 2).alias("composite_score"),
            signal_label().alias("signal"),
        )
        .orderBy(F.desc("composite_score"), "ticker")
    )


def signal_mix(signals):
    return signals.groupBy("signal").agg(F.count(F.lit(1)).alias("n"))


def with_signal_score(features):
    """0-100 score; a missing or zero input takes its neutral default."""
    def neutral(name, default):
        return F.coalesce(F.nullif(F.col(name), F.lit(0.0)), F.lit(default))

    raw = (
        50.0
        + F.least(F.lit(25.0), neutral("roc_252", 0.0) * 100)
        + (50.0 - neutral("rsi_14", 50.0)) * 0.3
        - neutral("vol_20d", 0.2) * 50.0
    )
    return features.withColumn(
        "signal_score", half_up(F.least(F.greatest(raw, F.lit(0.0)), F.lit(100.0)), 1)
    )
