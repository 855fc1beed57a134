"""Small column helpers."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwise.constants import TRADING_DAYS

ANNUAL = TRADING_DAYS**0.5


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def change(new, old) -> Column:
    """Relative change; null when the base is zero or null."""
    return F.try_divide(col(new) - col(old), col(old))


def half_up(c, digits) -> Column:
    """Decimal rounding, ties away from zero."""
    return F.round(col(c), digits)


def count_if(condition) -> Column:
    return F.count(F.when(condition, 1))


def share_if(condition, base) -> Column:
    """Share of rows meeting ``condition`` among non-null ``base``."""
    return F.try_divide(count_if(condition).cast("double"), F.count(base))


def scalar(df: DataFrame, aggregate) -> Column:
    """A whole-table aggregate as an uncorrelated scalar subquery (no join, no driver round trip)."""
    return df.agg(aggregate).scalar()


def pick(df: DataFrame, spec: str) -> DataFrame:
    """Project and round: ``'ticker, close:2, daily_return:6'``."""
    out = []
    for item in spec.replace("\n", " ").split(","):
        name, _, digits = item.strip().partition(":")
        out.append(half_up(name, int(digits)).alias(name) if digits else F.col(name))
    return df.select(*out)


def first_per_key(df: DataFrame, keys, *order) -> DataFrame:
    """One row per key by a total order.

    The rank filter lets Spark cut every map task's output to one row per key before the shuffle,
    so a key that repeats without bound never piles up in one task.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")
