"""File readers and writers: Parquet, CSV, JSON."""

import contextlib
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import functions as F

#: The codec of tables that take much disk: a tenth to a third less than the default on prices, at no more time.
DENSE = "zstd"


def conform(df, schema):
    """Cast to a declared schema by column name; unknown columns are dropped."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def read_parquet(spark, path, schema=None):
    """Parquet scan; filters, column pruning and partition pruning reach the reader."""
    df = spark.read.parquet(path)
    return conform(df, schema) if schema is not None else df


def read_csv(spark, path, schema):
    return spark.read.option("header", True).schema(schema).csv(path)


def write_parquet(df, path, partition_by=(), files_per_partition=1, observe=None, compression=None):
    """Overwrite ``path``. With ``partition_by``, rows of one partition value are spread over
    ``files_per_partition`` tasks, so a value holding most rows does not land in one task. ``observe``: an Observation and
    its aggregates by name, taken of the rows as they are written."""
    if partition_by:
        if files_per_partition > 1:
            spread = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_partition))
            df = df.repartition(*[F.col(c) for c in partition_by], spread)
        else:
            # An optimizer hint: adaptive execution splits oversized partition values by itself.
            df = df.hint("rebalance", *partition_by)
    _writer(df, partition_by, observe, compression).parquet(path)
    return path


def _writer(df, partition_by, observe, compression):
    if observe is not None:
        # Above the shuffle, so that it runs in the writing tasks, each of which counts once however often it is retried.
        observation, aggregates = observe
        df = df.observe(observation, *[a.alias(k) for k, a in aggregates.items()])
    writer = df.write.mode("overwrite")
    if compression:
        writer = writer.option("compression", compression)
    return writer.partitionBy(*partition_by) if partition_by else writer


def write_small(df, path):
    """One Parquet file; only for aggregates whose size does not grow with the rows."""
    df.coalesce(1).write.mode("overwrite").parquet(path)
    return path


def write_csv(df, path):
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_json(df, path):
    df.write.mode("overwrite").json(path)
    return path


def register_views(**frames):
    """Name frames for use in SQL text. The names are the session's: a second frame of one name replaces the first."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)


@contextlib.contextmanager
def shared_views(**frames):
    """Views for several SQL jobs of one run: gives their names, which are unique in the session, and keeps their rows cached
    in two copies on the executors' disks, so that a lost executor costs no recomputation. What the jobs give must be
    written inside the block; at its end cache and views are gone."""
    names = {}
    try:
        for name, df in frames.items():
            unique = f"{name}_{uuid.uuid4().hex}"
            df.createOrReplaceTempView(unique)
            df.sparkSession.catalog.cacheTable(unique, StorageLevel.DISK_ONLY_2)
            names[name] = unique
        yield names
    finally:
        for name, unique in names.items():
            catalog = frames[name].sparkSession.catalog
            catalog.uncacheTable(unique)
            catalog.dropTempView(unique)


def write_bucketed(df, table, key="ticker", order="date", buckets=64, path=None, partition_by=(), observe=None, compression=None):
    """A table whose files are dealt by ``key`` and sorted by (key, order): windows and joins by the key read it without a
    shuffle. ``path``: where its files lie (default: the warehouse). With ``partition_by`` a bucket is a file in each partition
    value that it has rows of. ``observe``: as for ``write_parquet``."""
    # Dealt as the buckets are, so that every task writes one file a bucket; rows dealt so already are not shuffled.
    writer = _writer(df.repartition(buckets, key), partition_by, observe, compression).format("parquet").bucketBy(buckets, key).sortBy(key, order)
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)


def replace_partitions(df, path, partition_by):
    """Overwrite those partitions of a partitioned folder that ``df`` has rows of, and leave the others."""
    df.hint("rebalance", *partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)
    return path


def stored(df):
    """Write ``df`` to a fresh shared folder and read it back: it is computed once and its lineage ends there."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark):
    """A fresh folder all executors can reach.

    It lies under ``spark.checkpoint.dir``. Only a local session may go without that setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"
