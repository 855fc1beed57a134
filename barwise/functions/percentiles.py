"""Exact interpolated percentiles, and means of the values up to them, of groups of any size.

Spark's ``percentile`` keeps a group's distinct values in one task's memory. That is fine for groups
bounded by the calendar (one ticker), but not for a sector or the whole table. Here the wanted order
statistics are narrowed down by two histograms whose size does not depend on the row count, and only
the few values left in the wanted bins are ranked. The histograms carry sums beside counts, so the
mean of all values up to a percentile falls out of the same selection. Every step combines before its
shuffle, so a group holding most rows is spread over all tasks. The rows are read twice: for the first
histogram, and for the distinct values of the wanted bins.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

FINE_BINS = 4096


def _log_bin(x):
    """Monotone bin number by sign and magnitude, 32 bins per power of two, about 130k at most."""
    magnitude = F.floor(F.log2(F.abs(x)) * 32) + 40000
    return F.when(x == 0, F.lit(0)).otherwise(F.signum(x).cast("long") * magnitude).cast("long")


def _below(df, by, order):
    """Add counts and sums of the entries before (``n_below``, ``sum_below``); ``df`` has n and sum."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns(
        {"n_below": F.coalesce(F.sum("n").over(before), F.lit(0)), "sum_below": F.coalesce(F.sum("sum").over(before), F.lit(0.0))}
    )


def exact_percentiles(df, value, probs, by=()):
    """One row per group and probability: ``by`` columns, ``p``, ``percentile``, ``tail_mean`` (of the values up to the
    percentile) and ``tail_n``. Without ``by`` the whole table is one group: what is wanted of it then is a handful of
    bins, which are joined by their numbers."""
    by = list(by)
    x = F.col("x")
    rows = df.select(*by, F.col(value).cast("double").alias("x")).filter(x.isNotNull()).withColumn("bin", _log_bin(x))
    # At most two bins per probability where there is one group; otherwise joins are sized at run time.
    small = (lambda d: d) if by else F.broadcast

    # Coarse histogram: counts, sums and value range per magnitude bin.
    coarse = rows.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sum"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    coarse = _below(coarse, by, "bin").withColumn("total", F.sum("n").over(Window.partitionBy(*by)))

    # Wanted ranks (zero-based, fractional); a target is one of the two neighbours of a rank.
    position = F.col("p") * (F.col("total") - 1)
    targets = (
        coarse.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .withColumn("frac", position - F.floor(position))
        .withColumn("rank", F.explode(F.array(F.floor(position), F.ceil(position))))
        .filter((F.col("rank") >= F.col("n_below")) & (F.col("rank") < F.col("n_below") + F.col("n")))
        .withColumn("side", F.when(F.col("rank") == F.floor(position), 0).otherwise(1))
    )
    bins = targets.select(*by, "bin", "lo", "hi").distinct()
    wanted = targets.select(*by, "bin", "rank", "n_below", "sum_below").distinct()

    # The distinct values of the wanted bins, and a fine histogram of them.
    width = (F.col("hi") - F.col("lo")) / FINE_BINS
    cell = F.least(F.coalesce(F.floor(F.try_divide(x - F.col("lo"), width)), F.lit(0)), F.lit(FINE_BINS - 1))
    values = rows.join(small(bins), [*by, "bin"]).groupBy(*by, "bin", cell.alias("cell"), "x").agg(F.count(F.lit(1)).alias("n"))
    values = values.withColumn("sum", x * F.col("n"))
    fine = values.groupBy(*by, "bin", "cell").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"))
    fine = _below(fine, [*by, "bin"], "cell").withColumnsRenamed({"n_below": "n_cells", "sum_below": "sum_cells"}).drop("sum")
    local = F.col("rank") - F.col("n_below")
    wanted = (
        wanted.join(fine, [*by, "bin"])
        .filter((local >= F.col("n_cells")) & (local < F.col("n_cells") + F.col("n")))
        .select(*by, "bin", "cell", "rank", (F.col("n_below") + F.col("n_cells")).alias("n_before"), (F.col("sum_below") + F.col("sum_cells")).alias("sum_before"))
    )

    # Rank the distinct values left in the wanted fine bins.
    cells = wanted.select(*by, "bin", "cell").distinct()
    left = _below(values.join(small(cells), [*by, "bin", "cell"]), [*by, "bin", "cell"], "x")
    local = F.col("rank") - F.col("n_before")
    found = (
        wanted.join(left, [*by, "bin", "cell"])
        .filter((local >= F.col("n_below")) & (local < F.col("n_below") + F.col("n")))
        .select(
            *by, "rank", "x", (F.col("n_before") + F.col("n_below") + F.col("n")).alias("upto"),
            (F.col("sum_before") + F.col("sum_below") + F.col("sum")).alias("upto_sum"),
        )
    )
    lower = F.col("side") == 0
    weight = F.when(lower, 1 - F.col("frac")).otherwise(F.col("frac"))
    # A whole-number rank has both neighbours on one value: side 0 twice with weight 1 and frac 0.
    return (
        targets.select(*by, "p", "frac", "rank", "side").distinct()
        .join(found, [*by, "rank"])
        .groupBy(*by, "p")
        .agg(
            F.sum(weight * x).alias("percentile"), F.max(F.when(lower, F.col("upto_sum") / F.col("upto"))).alias("tail_mean"),
            F.max(F.when(lower, F.col("upto"))).alias("tail_n"),
        )
    )
