"""Window frames over one ticker's bars.

Bars carry one row per (ticker, date) once they are deduplicated, so a ticker's window partition is
bounded by the trading calendar (a few ten thousand rows for a century of days) however large the
table is. Every frame below shares one partitioning and ordering, so Spark shuffles and sorts once.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F


ROWS_PER_TASK = 200_000


def n_tasks(spark, rows, per_task=ROWS_PER_TASK):
    """A number of tasks that follows the rows, so that what a task holds does not grow with the table; small tables still
    use all cores."""
    return max(-(-rows // per_task), min(spark.sparkContext.defaultParallelism, -(-rows // 10_000)), 1)


def timeline(key="ticker", order="date"):
    return Window.partitionBy(key).orderBy(order)


def trailing(n, key="ticker", order="date"):
    """The last ``n`` rows up to the current one (fewer at the start)."""
    return timeline(key, order).rowsBetween(1 - n, Window.currentRow)


def running(key="ticker", order="date"):
    return timeline(key, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
