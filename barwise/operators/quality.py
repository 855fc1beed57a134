"""Data-quality checks as one report table.

Row-level checks share a single aggregation, which can also run as an observation of rows being written. Duplicates and
price moves need rows grouped by key: rows are first summed by day and price step, so a key never gathers in one task.
"""

import math
from dataclasses import dataclass, field

from pyspark.sql import Window
from pyspark.sql import functions as F

from barwise.constants import NUMERIC_RANGES
from barwise.functions.expr import change, count_if, half_up


@dataclass
class QualityConfig:
    """Limits of the checks."""

    null_threshold: float = 0.01
    move_limit: float = 0.50
    move_share: float = 0.001
    freshness_hours: int = 48
    min_rows: int = 1
    strict: bool = True
    required: list = field(default_factory=lambda: ["ticker", "date", "close"])
    ranges: dict = field(default_factory=lambda: dict(NUMERIC_RANGES))


class QualityError(ValueError):
    """A strict report holds failed checks."""


NO_COLUMNS = "CAST(array() AS array<string>)"


def inconsistent(tolerance=0.001):
    """Any of five price-ordering faults; an unknown comparison is not a fault."""
    high, low = F.col("high") * (1 + tolerance), F.col("low") * (1 - tolerance)
    tests = [
        F.col("high") < F.col("low"),
        F.col("close") > high, F.col("close") < low,
        F.col("open") > high, F.col("open") < low,
    ]
    out = F.coalesce(tests[0], F.lit(False))
    for t in tests[1:]:
        out = out | F.coalesce(t, F.lit(False))
    return out


def _check(name, status, metric=None, threshold=None, affected=None, columns=None, detail=None):
    return F.struct(
        F.lit(name).alias("check_name"),
        status.alias("status"),
        (metric if metric is not None else F.lit(None)).cast("double").alias("metric"),
        F.lit(threshold).cast("double").alias("threshold"),
        (affected if affected is not None else F.lit(0)).cast("long").alias("affected_rows"),
        (columns if columns is not None else F.expr(NO_COLUMNS)).alias("affected_cols"),
        (detail if detail is not None else F.lit("")).alias("detail"),
    )


def _fail_if(condition, bad="FAIL"):
    return F.when(condition, bad).otherwise("PASS")


def row_measures(columns, cfg, null_columns=None, where=None):
    """What the row-level checks count, as named aggregates over one scan: also fit for ``DataFrame.observe``. ``where``
    limits them to some rows."""
    have = set(columns)
    keep = F.lit(True) if where is None else where
    out = {"n": count_if(keep), "max_date": F.max(F.when(keep, F.col("date"))) if "date" in have else F.max(F.lit(None).cast("date"))}
    if {"open", "high", "low", "close"} <= have:
        out["bad_prices"] = count_if(keep & inconsistent())
    for c in null_columns or columns:
        if c in have:
            out[f"null_{c}"] = count_if(keep & F.col(c).isNull())
    for c, (lo, hi) in cfg.ranges.items():
        if c in have:
            out[f"range_{c}"] = count_if(keep & ((F.col(c) < lo) | (F.col(c) > hi)))
    return out


def row_checks(base, columns, cfg, as_of=None):
    """The row-level checks from one row of measures."""
    have = set(columns)
    nulls = [c.removeprefix("null_") for c in base.columns if c.startswith("null_")]
    ranges = [c.removeprefix("range_") for c in base.columns if c.startswith("range_")]
    prices = "bad_prices" in base.columns
    n = F.greatest(F.col("n"), F.lit(1)).cast("double")

    rates = {c: F.col(f"null_{c}") / n for c in nulls}
    named = lambda found: F.filter(F.array(*found), lambda c: c.isNotNull()) if found else F.expr(NO_COLUMNS)
    breached = named([F.when(rates[c] > cfg.null_threshold, F.lit(c)) for c in nulls])
    outside = named([F.when(F.col(f"range_{c}") > 0, F.lit(c)) for c in ranges])
    worst = F.array_max(F.array(*rates.values())) if nulls else F.lit(0.0)
    missing = [c for c in cfg.required if c not in have]
    missing_cols = F.array(*[F.lit(c) for c in missing]) if missing else F.expr(NO_COLUMNS)
    now = F.lit(as_of).cast("timestamp") if as_of is not None else F.current_timestamp()
    hours = (F.unix_timestamp(now) - F.unix_timestamp(F.col("max_date").cast("timestamp"))) / 3600.0

    few = F.col("n") < cfg.min_rows
    bad = F.col("bad_prices") if prices else F.lit(0)
    checks = [
        _check("row_count", _fail_if(few), F.col("n"), cfg.min_rows, F.when(few, F.col("n")).otherwise(0),
               detail=F.format_string("%d rows", F.col("n"))),
        _check("required_columns", F.lit("FAIL" if missing else "PASS"), columns=missing_cols),
        _check("null_rates", _fail_if(F.size(breached) > 0), worst, cfg.null_threshold, columns=breached),
        _check("numeric_ranges", _fail_if(F.size(outside) > 0), columns=outside),
        _check("ohlc_consistency", _fail_if(bad > 0), bad if prices else None, affected=bad),
        _check("freshness", _fail_if(F.coalesce(hours > cfg.freshness_hours, F.lit(False)), "WARN"),
               half_up(hours, 1), cfg.freshness_hours),
    ]
    return base.select(F.explode(F.array(*checks)).alias("c")).select("c.*")


def quality_checks(df, layer, config=None, null_columns=None, as_of=None):
    """One row per check. ``as_of`` (a timestamp) replaces the clock in the freshness check."""
    cfg = config or QualityConfig()
    base = df.agg(*[a.alias(k) for k, a in row_measures(df.columns, cfg, null_columns).items()])
    report = row_checks(base, df.columns, cfg, as_of)
    if {"ticker", "date"} <= set(df.columns):
        report = report.unionByName(keyed_checks(df, cfg))
    return report.select(F.lit(layer).alias("layer"), "*")


def close_moves(df, limit):
    """ticker, date, n (rows) and moves: how often a ticker's close, in the order of (date, close), changes by more than
    ``limit`` from one distinct value to the next.

    Rows are first summed by (ticker, date, step of a geometric scale); a step is so narrow that no extreme move fits into
    it, so its smallest and largest close say all. A ticker with any number of rows thus leaves every map task as one row a
    day and step, and the two windows below see days and steps, not rows.
    """
    v = F.col("close").cast("double")
    steps = math.ceil(2 / math.log2(1 + limit))
    scale = F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * (F.floor(F.log2(F.abs(v)) * steps) + 2000 * steps))
    day = df.groupBy("ticker", "date", scale.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"))
    before = F.lag("high").over(Window.partitionBy("ticker", "date").orderBy(F.col("low").asc_nulls_first()))
    far = lambda new, old: F.coalesce(F.abs(change(new, old)) > limit, F.lit(False))
    days = day.withColumn("before", before).groupBy("ticker", "date").agg(
        F.sum("n").alias("n"), count_if(far("low", "before")).alias("inside"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.max(F.col("low").isNull()).alias("unknown"),
    )
    # An unknown close comes first in its day and breaks the chain from the day before.
    last = F.lag("high").over(Window.partitionBy("ticker").orderBy("date"))
    days = days.withColumn("last", last)
    return days.select("ticker", "date", "n", (F.col("inside") + (~F.col("unknown") & far("low", "last")).cast("long")).alias("moves"))


def keyed_checks(df, cfg):
    """Duplicates and extreme moves of rows keyed by (ticker, date). Given returns are judged row by row; of closes, the
    moves between neighbours; without either no move can be found and the check passes."""
    have = set(df.columns)
    n = F.count(F.lit(1)).alias("n")
    if "daily_return" in have:
        extreme = count_if(F.abs("daily_return") > cfg.move_limit)
        keys = df.groupBy("ticker", "date").agg(n, extreme.alias("moves"))
    elif "close" in have:
        keys = close_moves(df, cfg.move_limit)
    else:
        keys = df.groupBy("ticker", "date").agg(n).withColumn("moves", F.lit(0))
    agg = keys.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("moves"), F.lit(0)).alias("extreme"),
    )
    share = F.col("extreme") / F.greatest(F.col("n"), F.lit(1)).cast("double")
    repeats = F.col("n") - F.col("keys")
    checks = [
        _check("price_moves", _fail_if(share > cfg.move_share, "WARN"), share, cfg.move_limit, F.col("extreme")),
        _check("duplicates", _fail_if(repeats > 0), repeats, affected=repeats),
    ]
    return agg.select(F.explode(F.array(*checks)).alias("c")).select("c.*")


def quality_score(report):
    """One row per layer: check counts and the score (minus 10 per failure, 3 per warning)."""
    count = lambda s: count_if(F.col("status") == s)
    return (
        report.groupBy("layer")
        .agg(count("PASS").alias("passed"), count("WARN").alias("warned"), count("FAIL").alias("failed"))
        .withColumn(
            "overall_score",
            F.greatest(F.lit(0.0), 100.0 - 10.0 * F.col("failed") - 3.0 * F.col("warned")),
        )
    )


def report_json(report, run_id="run"):
    """One JSON document per layer. A report holds a handful of checks."""
    checks = F.sort_array(
        F.collect_list(F.struct(*[c for c in report.columns if c != "layer"]))
    )
    nested = report.groupBy("layer").agg(checks.alias("checks"))
    return (
        nested.join(quality_score(report), "layer")
        .select("layer", F.to_json(F.struct(F.lit(run_id).alias("run_id"), "*")).alias("report"))
    )


def assert_quality(df, layer, config=None, **kw):
    """Run the checks; in strict mode raise when any failed. Collects the check rows only."""
    cfg = config or QualityConfig()
    rows = quality_checks(df, layer, cfg, **kw).collect()
    failed = sorted(r["check_name"] for r in rows if r["status"] == "FAIL")
    if cfg.strict and failed:
        raise QualityError(f"{layer}: {len(failed)} check(s) failed: {', '.join(failed)}")
    return rows
