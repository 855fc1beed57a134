"""Mean, deviation and co-movement over long trailing row frames.

Spark evaluates a sliding frame by visiting all its rows again for every output row, which is fine
for 20 rows and slow for 252. Here the timeline is cut into blocks as long as the frame. A frame then
is the tail of one block plus the head of the next, and both are running aggregates, computed once
per row. The two parts are merged with the pairwise update of means and squared deviations, so
nothing is subtracted from a growing total and precision is that of a direct computation.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

NOISE = 1e-26  # squared deviations this small against the squared mean are rounding residue


def _parts(x, y=None):
    """Running aggregates of one block part, over rows where all inputs are known."""
    if y is None:
        return {"n": F.count(x), "x": F.avg(x), "xx": F.var_pop(x)}
    both = x.isNotNull() & y.isNotNull()
    bx, by = F.when(both, x), F.when(both, y)
    return {
        "n": F.count(bx), "x": F.avg(bx), "y": F.avg(by),
        "xy": F.covar_pop(bx, by),
        # The spread of y is taken over all its known values, paired or not.
        "m": F.count(y), "my": F.avg(y), "yy": F.var_pop(y),
    }


def _merge(head, tail, n, mean, spread):
    """Merge counts, means and a spread of two parts into (count, mean, summed spread)."""
    n1, n2 = F.coalesce(head[n], F.lit(0)), F.coalesce(tail[n], F.lit(0))
    total = n1 + n2
    means = []
    gap = F.lit(1.0)
    for m in mean:
        a, b = F.coalesce(head[m], F.lit(0.0)), F.coalesce(tail[m], F.lit(0.0))
        means.append(F.try_divide(n1 * a + n2 * b, total))
        gap = gap * (a - b)
    if len(mean) == 1:
        gap = gap * gap
    inner = n1 * F.coalesce(head[spread], F.lit(0.0)) + n2 * F.coalesce(tail[spread], F.lit(0.0))
    return total, means, inner + F.coalesce(F.try_divide(gap * n1 * n2, total), F.lit(0.0))


def long_frame(df, n, frames, key="ticker", order="date"):
    """Add statistics of the last ``n`` rows for each entry ``prefix: (x,)`` or ``prefix: (x, y)``.

    For every prefix: ``_n`` (known rows), ``_mean`` and ``_ss`` (summed squared deviations) of x;
    with y instead ``_n`` (rows with both known), ``_sxy`` (summed co-deviations), ``_m`` and
    ``_syy`` (count and squared deviations of y). All entries share the added local sorts; rows stay
    partitioned by ``key``, so nothing is shuffled.
    """
    cols, i, block = list(df.columns), "_row", "_block"
    aggs = {
        f"{prefix}_{k}": a
        for prefix, xy in frames.items()
        for k, a in _parts(*[F.col(c) for c in xy], *[None] * (2 - len(xy))).items()
    }
    df = df.withColumn(i, F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)
    df = df.withColumn(block, F.floor(F.col(i) / n))
    part = Window.partitionBy(key, block)
    upto = (Window.unboundedPreceding, Window.currentRow)
    backward = part.orderBy(F.desc(order)).rowsBetween(*upto)
    forward = part.orderBy(order).rowsBetween(*upto)
    df = df.withColumns({f"{k}__tail": a.over(backward) for k, a in aggs.items()})
    # The same sort serves the block heads and the step back to the tail of the block before.
    back = Window.partitionBy(key).orderBy(block, order)
    df = df.withColumns(
        {
            **{f"{k}__head": a.over(forward) for k, a in aggs.items()},
            **{f"{k}__prev": F.lag(f"{k}__tail", n - 1).over(back) for k in aggs},
        }
    )
    # The last row of a block has the whole frame in its head.
    open_block = (F.col(i) + 1) % n != 0
    out = {}
    for prefix, xy in frames.items():
        names = [k[len(prefix) + 1:] for k in aggs if k.startswith(f"{prefix}_")]
        head = {k: F.col(f"{prefix}_{k}__head") for k in names}
        tail = {k: F.when(open_block, F.col(f"{prefix}_{k}__prev")) for k in names}
        if len(xy) == 1:
            count, (mean,), ss = _merge(head, tail, "n", ["x"], "xx")
            out[f"{prefix}_n"], out[f"{prefix}_mean"] = count, mean
            out[f"{prefix}_ss"] = F.when(ss > NOISE * count * mean * mean, ss).otherwise(0.0)
        else:
            out[f"{prefix}_n"], _, out[f"{prefix}_sxy"] = _merge(head, tail, "n", ["x", "y"], "xy")
            m, (my,), syy = _merge(head, tail, "m", ["my"], "yy")
            out[f"{prefix}_m"] = m
            out[f"{prefix}_syy"] = F.when(syy > NOISE * m * my * my, syy).otherwise(0.0)
    return df.withColumns(out).select(*cols, *out)


def calendar_frame(df, days, frames, key="ticker", date="date"):
    """Add ``_n``, ``_mean`` and ``_ss`` (as ``long_frame``) over the rows of the last ``days`` days up to each row's date,
    for each entry ``prefix: x``.

    The calendar is cut into blocks as long as the frame, so a frame is the tail of one block and the head of the next, each
    a running aggregate. Where the frame begins is looked up: the rows of a block, moved by the frame's length, stand where
    the frame leaves them behind, and in reverse order the last of them at or before a row holds its tail. Work a row
    is constant, nothing is subtracted from a growing total, and rows stay partitioned by ``key``."""
    length, cols = days + 1, list(df.columns)
    day = F.datediff(F.col(date), F.lit("1970-01-01").cast("date"))
    aggs = {f"{p}_{k}": a for p, x in frames.items() for k, a in _parts(F.col(x)).items()}
    # Days from the key's first one: the window also deals the rows by key, which serves everything below.
    first = F.min(day).over(Window.partitionBy(key))
    df = df.withColumn("_day", day - first).withColumn("_block", F.floor(F.col("_day") / length))
    part, upto = Window.partitionBy(key, "_block"), (Window.unboundedPreceding, Window.currentRow)
    # By value, so rows of one date share their frame.
    heads = {f"{k}__head": a.over(part.orderBy("_day").rangeBetween(*upto)) for k, a in aggs.items()}
    tails = {k: a.over(part.orderBy(F.desc("_day")).rangeBetween(*upto)) for k, a in aggs.items()}
    df = df.withColumns(heads).withColumns({f"{k}__tail": a for k, a in tails.items()})
    own = F.struct(*cols, "_block", *heads)
    tail = F.struct("_block", *[F.col(f"{k}__tail").alias(k) for k in aggs])
    nothing = lambda s: F.lit(None).cast(df.select(s.alias("s")).schema["s"].dataType)
    row = F.struct(F.col("_day").alias("at"), own.alias("own"), nothing(tail).alias("tail"))
    left_behind = F.struct((F.col("_day") + days).alias("at"), nothing(own).alias("own"), tail.alias("tail"))
    both = df.select(key, F.explode(F.array(row, left_behind)).alias("e")).select(key, "e.*")
    back = Window.partitionBy(key).orderBy(F.desc("at"), F.col("tail").isNull()).rowsBetween(*upto)
    found = both.withColumn("seen", F.last("tail", ignorenulls=True).over(back)).filter("own IS NOT NULL")
    inside = F.col("seen._block") == F.col("own._block") - 1
    out = {}
    for prefix in frames:
        names = ("n", "x", "xx")
        head = {k: F.col(f"own.{prefix}_{k}__head") for k in names}
        older = {k: F.when(inside, F.col(f"seen.{prefix}_{k}")) for k in names}
        count, (mean,), ss = _merge(head, older, "n", ["x"], "xx")
        out[f"{prefix}_n"], out[f"{prefix}_mean"] = count, mean
        out[f"{prefix}_ss"] = F.when(ss > NOISE * count * mean * mean, ss).otherwise(0.0)
    # The key itself, not its copy: rows are known to stay where they are.
    return found.select(*[F.col(key) if c == key else F.col(f"own.{c}").alias(c) for c in cols], *[c.alias(k) for k, c in out.items()])


def population_dev(prefix):
    """Population standard deviation of a frame; null without a row."""
    return F.sqrt(F.try_divide(F.col(f"{prefix}_ss"), F.col(f"{prefix}_n")))


def sample_dev(prefix):
    """Sample standard deviation of a frame; null below two rows."""
    n = F.col(f"{prefix}_n")
    return F.when(n > 1, F.sqrt(F.try_divide(F.col(f"{prefix}_ss"), n - 1)))
