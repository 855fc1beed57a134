"""Scenario returns, capture ratios and market regimes."""

from pyspark.sql import functions as F

from barwise.constants import (
    REGIME_RULES, REGIME_SENSITIVITY, REGIME_SHOCKS, RISK_FREE, SCENARIOS, SECTOR_ALIASES, SECTOR_SENSITIVITY,
)
from barwise.functions.expr import ANNUAL, half_up


def _chosen(keys):
    """The scenarios named in ``keys``; unknown names are skipped."""
    by_key = {s[0]: s for s in SCENARIOS}
    return [by_key[k] for k in keys if k in by_key]


def scenario_array(keys):
    """The chosen scenarios as an array literal: exploding it needs no join."""
    return F.array(
        *[
            F.struct(
                F.lit(k).alias("scenario"), F.lit(label).alias("scenario_name"),
                F.lit(shock).alias("mkt_return_shock"), F.lit(mult).alias("vol_multiplier"),
                F.lit(shift).alias("correlation_shift"),
            )
            for k, label, shock, mult, shift in _chosen(keys)
        ]
    )


def with_scenarios(df, keys=("bull", "base", "bear", "stagflation", "rate_shock")):
    return df.withColumn("_s", F.explode(scenario_array(keys))).select(*df.columns, "_s.*")


def capm(beta, market, risk_free=RISK_FREE):
    return risk_free + beta * (market - risk_free)


def scenario_returns(fundamentals, keys=("bull", "base", "bear", "stagflation", "rate_shock"),
                     risk_free=RISK_FREE):
    """Expected return of every ticker under every scenario; an absent or zero beta counts as 1."""
    beta = F.coalesce(F.nullif(F.col("beta"), F.lit(0.0)), F.lit(1.0))
    df = with_scenarios(fundamentals.select("ticker", "sector", beta.alias("beta")), keys)
    return df.select(
        "ticker", "sector", "scenario_name", "mkt_return_shock", "vol_multiplier",
        half_up(capm(F.col("beta"), F.col("mkt_return_shock"), risk_free), 4).alias("ticker_return"),
        half_up("beta", 3).alias("beta"),
    )


def capture_ratios(betas, epsilon=0.0, risk_free=RISK_FREE, round_ratio=False):
    """Bull, base and bear returns with capture of the market's move, one row per ticker."""
    shock = {s[0]: s[2] for s in SCENARIOS}
    df = betas.filter(F.col("beta").isNotNull())
    exact = {k: capm(F.col("beta"), F.lit(shock[k]), risk_free) for k in ("bull", "base", "bear")}
    shown = {k: half_up(v, 4) for k, v in exact.items()}
    source = shown if round_ratio else exact
    df = df.withColumns({f"return_{k}": v for k, v in shown.items()}).withColumns(
        {
            "upside_capture": half_up(source["bull"] / shock["bull"], 4),
            "downside_capture": half_up(source["bear"] / shock["bear"], 4),
        }
    )
    ratio = F.try_divide(F.col("upside_capture"), F.abs("downside_capture") + epsilon)
    return df.withColumn("capture_ratio", half_up(ratio, 4) if round_ratio else ratio)


def sector_scenario_averages(captures, digits=4):
    return captures.groupBy("sector").agg(
        F.count_distinct("ticker").alias("n_equities"),
        *[half_up(F.avg(f"return_{k}"), digits).alias(f"avg_{k}_return") for k in ("bull", "base", "bear")],
        half_up(F.avg("capture_ratio"), digits).alias("avg_capture_ratio"),
        half_up(F.avg("beta"), 3).alias("avg_beta"),
    )


def _multiplier(cells, sector, key):
    """Lookup in a fixed table {(sector, key): multiplier} as a map literal; missing entries count as 1."""
    entries = [F.struct(F.lit(f"{s}|{k}").alias("k"), F.lit(float(v)).alias("v")) for (s, k), v in cells.items()]
    found = F.try_element_at(
        F.map_from_entries(F.array(*entries)), F.concat_ws("|", sector, key)
    )
    return F.coalesce(found, F.lit(1.0))


def sector_scenario_returns(sectors, key):
    """Shock times sector multiplier for each row of ``sectors`` (a ``sector`` column)."""
    chosen = _chosen([key])
    if not chosen:
        raise KeyError(f"unknown scenario: {key}")
    cells = {(s, k): v for s, row in SECTOR_SENSITIVITY.items() for k, v in row.items()}
    mult = _multiplier(cells, F.col("sector"), F.lit(key))
    return sectors.select(
        "sector", F.lit(key).alias("scenario"), mult.alias("multiplier"),
        half_up(F.lit(chosen[0][2]) * mult, 4).alias("sector_return"),
    )


def sector_regime_returns(rows):
    """Regime shock times sector multiplier for (sector, market_scenario) rows. Long and short
    sector names both match."""
    cells = {(s, k): v for k, row in REGIME_SENSITIVITY.items() for s, v in row.items()}
    cells |= {(SECTOR_ALIASES[s], k): v for (s, k), v in cells.items() if s in SECTOR_ALIASES}
    regime = F.lower("market_scenario")
    mult = _multiplier(cells, F.col("sector"), regime)
    shock = F.lit(None).cast("double")
    for k, (move, _) in REGIME_SHOCKS.items():
        shock = F.when(regime == k, move).otherwise(shock)
    return rows.withColumns({"multiplier": mult, "sector_return": half_up(shock * mult, 4)})


# ---- regimes ---------------------------------------------------------------------------------

def with_market_scenario(features):
    """Row-level regime from drawdown, 20-day volatility and 20-day rate of change."""
    dd = F.coalesce("drawdown", F.lit(0.0))
    vol = F.coalesce(F.nullif(F.col("vol_20d"), F.lit(0.0)), F.lit(0.15))
    roc = F.col("roc_20")
    stormy = vol >= 0.22
    label = (
        F.when(roc.isNull(), "Normal")
        .when(stormy & (dd <= -0.20), "Bear")
        .when(stormy, "Volatile")
        .when((roc >= 0.03) & (dd >= -0.05), "Bull")
        .when((roc >= 0.01) & (dd >= -0.20), "Recovery")
        .otherwise("Normal")
    )
    return features.withColumn("market_scenario", label)


RULE = "regime string, priority int, metric string, comparison string, threshold double"


def rule_table(spark, rules=REGIME_RULES):
    """Conditions as rows: regime, priority, metric, comparison, threshold; a regime's rows must all hold."""
    return spark.createDataFrame([(label, priority, metric, op, float(t)) for label, priority, metric, op, t in rules], RULE)


def classify_regimes(metrics, rules, default="Normal"):
    """The regime of lowest priority whose conditions all hold. ``rules``: a table as from ``rule_table``. A metric that is
    missing or null fails its condition.

    The rules become one array, a scalar of a few entries, so every row is judged where it lies: no join, no shuffle."""
    condition = F.struct("metric", "comparison", "threshold")
    grouped = rules.groupBy("priority", "regime").agg(F.collect_list(condition).alias("conditions"))
    every = grouped.agg(F.collect_list(F.struct("priority", "regime", "conditions")).alias("rules")).scalar()
    kind = dict(metrics.dtypes)
    numbers = [c for c in metrics.columns if kind[c] in ("double", "float", "int", "bigint", "smallint", "tinyint") or kind[c].startswith("decimal")]
    known = F.create_map(*[x for c in numbers for x in (F.lit(c), F.col(c).cast("double"))])

    def holds(c):
        value = F.try_element_at(F.col("_known"), c["metric"])
        tests = {"<=": value <= c["threshold"], ">=": value >= c["threshold"], "<": value < c["threshold"], ">": value > c["threshold"], "==": value == c["threshold"]}
        out = F.lit(False)
        for name, test in tests.items():
            out = F.when(c["comparison"] == name, F.coalesce(test, F.lit(False))).otherwise(out)
        return out

    met = F.filter("_rules", lambda r: F.forall(r["conditions"], holds))
    first = F.array_min(F.transform(met, lambda r: F.struct(r["priority"], r["regime"])))
    rows = metrics.withColumns({"_known": known, "_rules": every})
    return rows.withColumn("regime", F.coalesce(first["regime"], F.lit(default))).drop("_known", "_rules")


def idiosyncratic_volatility(returns, keys=("bull", "base", "bear", "stagflation", "rate_shock")):
    """ticker, scenario_name, idio_vol: each ticker's annualised volatility, scaled by the scenario's multiplier."""
    own = returns.groupBy("ticker").agg((F.stddev_samp("daily_return") * ANNUAL).alias("vol")).filter("vol IS NOT NULL")
    rows = own.withColumn("s", F.explode(scenario_array(keys)))
    return rows.select("ticker", F.col("s.scenario_name").alias("scenario_name"), (F.col("vol") * F.col("s.vol_multiplier")).alias("idio_vol"))
