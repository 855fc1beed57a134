"""Cleansing of bars and fundamentals: conform, filter, deduplicate, history gate, lineage."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from barwise.functions.expr import first_per_key

PRICES = ["open", "high", "low", "close"]


def conform_bars(text):
    """Coerce loosely typed bars; an unreadable number or date becomes null."""
    return text.select(
        F.upper(F.trim("ticker")).alias("ticker"),
        F.col("date").try_cast("date").alias("date"),
        *[F.col(c).try_cast("double").alias(c) for c in PRICES],
        F.col("volume").try_cast("long").alias("volume"),
        "sector",
    )


def sane(low_tolerance=0.0, high_tolerance=0.001):
    """Price ordering within tolerances; a null in any operand fails it."""
    return (
        (F.col("high") >= F.col("low"))
        & (F.col("close") >= F.col("low") * (1 - low_tolerance))
        & (F.col("close") <= F.col("high") * (1 + high_tolerance))
    )


def filter_bars(bars, start=None, end=None, tickers=None, low_tolerance=0.0):
    """Date range, ticker list, null closes and price sanity: one filter that reaches the scan."""
    keep = F.col("close").isNotNull() & sane(low_tolerance)
    if start is not None:
        keep &= F.col("date") >= F.lit(start).cast("date")
    if end is not None:
        keep &= F.col("date") <= F.lit(end).cast("date")
    if tickers is not None:
        keep &= F.col("ticker").isin(list(tickers))
    return bars.filter(keep)


def dedup_bars(bars):
    """One bar per (ticker, date): the smallest by price and volume, so the survivor is fixed."""
    order = [F.col(c).asc_nulls_first() for c in [*PRICES, "volume"]]
    return first_per_key(bars, ["ticker", "date"], *order)


def min_history(bars, days, count_repeats=False):
    """Keep tickers with at least ``days`` bars and leave one bar per date.

    The gate is a count over the ticker's own window, which later per-ticker windows share, so it
    costs no join. ``count_repeats`` counts repeated bars too: repeats are counted per
    (ticker, date) before anything is grouped by ticker, so they never pile up in one task.
    """
    rest = [c for c in bars.columns if c not in ("ticker", "date")]
    ordered = [*PRICES, "volume"] + [c for c in rest if c not in (*PRICES, "volume")]
    one = bars.groupBy("ticker", "date").agg(
        F.min(F.struct(*ordered)).alias("bar"), F.count(F.lit(1)).alias("copies")
    )
    weight = F.col("copies") if count_repeats else F.lit(1)
    total = F.sum(weight).over(Window.partitionBy("ticker"))
    return (
        one.withColumn("n_days", total)
        .filter(F.col("n_days") >= days)
        .select("ticker", "date", *[F.col(f"bar.{c}").alias(c) for c in rest])
        .select(*bars.columns)
    )


def cleanse_bars(bars, min_days=1, low_tolerance=0.0, count_repeats=True, **limits):
    """Filter, gate on history and deduplicate. The strict variant counts history before removing
    repeats; the tolerant one (``low_tolerance`` > 0) after."""
    return min_history(
        filter_bars(bars, low_tolerance=low_tolerance, **limits), min_days, count_repeats
    )


def cleanse_fundamentals(fundamentals, tickers=None, drop_negative_pe=False, pe_cap=200):
    """Blank extreme ratios, floor yields at zero, keep one row per ticker."""
    df = fundamentals
    if tickers is not None:
        df = df.filter(F.col("ticker").isin(list(tickers)))
    pe, div = F.col("pe_ratio"), F.col("dividend_yield")
    bad = pe > pe_cap
    if drop_negative_pe:
        bad |= pe < 0
    df = df.withColumns(
        {
            "pe_ratio": F.when(~F.coalesce(bad, F.lit(False)), pe),
            "dividend_yield": F.when(div < 0, 0.0).otherwise(div),
        }
    )
    order = [F.col(c).asc_nulls_first() for c in df.columns if c != "ticker"]
    return first_per_key(df, ["ticker"], *order)


def with_lineage(df, source="vendor", stamp="_loaded_at"):
    return df.withColumns({stamp: F.current_timestamp(), "_source": F.lit(source)})


def normalise_universe(universe):
    """Dashes for dots in symbols, numeric betas, one row per symbol."""
    df = universe.withColumns(
        {
            "ticker": F.translate("ticker", ".", "-"),
            "beta": F.col("beta").try_cast("double"),
        }
    )
    return first_per_key(df, ["ticker"], F.col("weight_pct").asc_nulls_first())


def universe_filter(universe, sectors=None):
    df = normalise_universe(universe)
    return df.filter(F.col("sector").isin(list(sectors))) if sectors else df


def universe_sector_summary(universe):
    return universe.groupBy("sector").agg(
        F.count("ticker").alias("n_stocks"), F.sum("weight_pct").alias("total_weight")
    )


def enrich(bars, fundamentals, columns=None):
    """Left join of per-ticker attributes; the row count stays. An attribute the bars also carry is
    taken from the fundamentals first. No hint: Spark broadcasts the dimension only while it is
    small, and joins on the ticker partitioning beyond that."""
    wanted = [c for c in (columns or fundamentals.columns) if c != "ticker"]
    shared = [c for c in wanted if c in bars.columns]
    dim = fundamentals.select(
        "ticker", *[F.col(c).alias(f"_{c}" if c in shared else c) for c in wanted]
    )
    df = bars.join(dim, "ticker", "left")
    for c in shared:
        df = df.withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return df


def missing_fundamentals(bars, fundamentals):
    """Tickers that trade but have no fundamentals."""
    return bars.select("ticker").distinct().join(
        fundamentals.select("ticker").distinct(), "ticker", "left_anti"
    )


def ingest_report(bars, fundamentals, max_null_share=None):
    """Row and ticker counts, date coverage, null-close share and uncovered tickers in one row.

    Counted on the bars as read, before null closes are filtered. With ``max_null_share`` the query
    fails when the share is above it.
    """
    covered = fundamentals.select("ticker").distinct().withColumn("covered", F.lit(1))
    per_ticker = (
        bars.groupBy("ticker")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count(F.when(F.col("close").isNull(), 1)).alias("nulls"),
            F.min("date").alias("lo"),
            F.max("date").alias("hi"),
        )
        .join(covered, "ticker", "left")
    )
    share = F.coalesce(F.try_divide(F.sum("nulls").cast("double"), F.sum("n")), F.lit(0.0))
    out = per_ticker.agg(
        F.sum("n").alias("bar_rows"),
        F.count("ticker").alias("bar_tickers"),
        F.count(F.when(F.col("covered").isNull(), 1)).alias("tickers_missing_fundamentals"),
        F.min("lo").alias("min_date"),
        F.max("hi").alias("max_date"),
        share.alias("null_close_pct"),
    ).withColumn(
        "fundamental_tickers",
        fundamentals.agg(F.count_distinct("ticker")).scalar(),
    )
    if max_null_share is not None:
        over = F.col("null_close_pct") > max_null_share
        message = F.concat(F.lit("Null close rate exceeds the limit: "), F.col("null_close_pct"))
        out = out.withColumn(
            "null_close_pct", F.when(over, F.raise_error(message)).otherwise(F.col("null_close_pct"))
        )
    return out


def incremental_load(cached, incoming):
    """Append bars of tickers not cached yet and keep one bar per (ticker, date).

    The scan for known tickers reads that one column only.
    """
    known = cached.select("ticker").distinct()
    fresh = incoming.join(known, "ticker", "left_anti")
    return dedup_bars(cached.unionByName(fresh))


def wide_bars(bars, fields=("open", "high", "low", "close", "volume")):
    """The vendor's wide layout: one row per date with the fields of every ticker. The tickers are the keys of a map, so no
    list of them is needed to build the row, and the plan does not grow with them."""
    cell = F.struct("ticker", F.struct(*[F.col(f).cast("double").alias(f) for f in fields]).alias("bar"))
    return bars.groupBy("date").agg(F.map_from_entries(F.collect_list(cell)).alias("cells"))


def wide_to_long(wide):
    """Wide rows to bars; days without a close are dropped. ``wide`` holds either a map ``cells`` (ticker to fields) or a
    column ``field|ticker`` for each of them, as in a file with such a header; the names then are the list of tickers. Each wide
    row explodes where it lies: no shuffle."""
    if "cells" in wide.columns:
        return wide.select("date", F.explode("cells").alias("ticker", "bar")).select("ticker", "date", "bar.*").filter(F.col("close").isNotNull())
    named = [c.split("|", 1) for c in wide.columns if "|" in c]
    fields = list(dict.fromkeys(f for f, _ in named))
    have = {(f, t) for f, t in named}

    def leg(t):
        cell = lambda f: F.col(f"`{f}|{t}`") if (f, t) in have else F.lit(None)
        return F.struct(F.lit(t).alias("ticker"), *[cell(f).cast("double").alias(f) for f in fields])

    legs = F.array(*[leg(t) for t in dict.fromkeys(t for _, t in named)])
    return (
        wide.select("date", F.explode(legs).alias("leg"))
        .select("leg.ticker", "date", *[f"leg.{f}" for f in fields])
        .filter(F.col("close").isNotNull())
    )


def returns_wide(returns):
    """Dates by tickers: one row per date, with the returns of the tickers that have one as a map."""
    known = returns.filter(F.col("daily_return").isNotNull())
    return known.groupBy("date").agg(F.map_from_entries(F.collect_list(F.struct("ticker", "daily_return"))).alias("returns"))


def returns_pivot(returns, tickers):
    """Dates by the columns of chosen tickers."""
    return (
        returns.filter(F.col("daily_return").isNotNull() & F.col("ticker").isin(list(tickers)))
        .groupBy("date")
        .pivot("ticker", list(tickers))
        .agg(F.first("daily_return"))
    )
