"""The incremental bar load, run over a folder of arriving files."""

from pyspark.sql import types as T

from barwise import schemas
from barwise.operators.cleanse import dedup_bars


def load_new_bars(spark, source, target, checkpoint):
    """Take every file not seen yet, keep bars whose (ticker, date) the target lacks, append them and stop.

    A ticker's files may arrive in any number of lots. Stored rows are not rewritten, so of two bars of one date the one
    that arrived first stays. A batch that runs again after a failure overwrites its own folder.
    """

    def append(batch, batch_id):
        rows = batch
        known = _earlier(spark, target, batch_id)
        if known is not None:
            rows = rows.join(known.select("ticker", "date"), ["ticker", "date"], "left_anti")
        dedup_bars(rows).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    stream = spark.readStream.schema(schemas.BARS).parquet(source)
    query = (
        stream.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(schemas.BARS).parquet(target)


def _earlier(spark, target, batch_id):
    """Bars written by earlier batches, or None before the first."""
    if batch_id == 0:
        return None
    fields = [*schemas.BARS.fields, T.StructField("batch", T.LongType())]
    rows = spark.read.schema(T.StructType(fields)).parquet(target)
    return rows.filter(rows["batch"] < batch_id)
