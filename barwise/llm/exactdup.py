"""Exact deduplication by a stateful stream.

A Structured Streaming aggregation keeps, per digest of the normalised text and without expiry, the number of rows, the
smallest identifier and a locator (file and row) of its content. The state lives in RocksDB on the executors' disks and
is uploaded to the checkpoint folder with every batch, so a later run over the same checkpoint reads only new files.
After the stream has caught up, the state is read as a table. Digests hit more than once have their full bytes
compared; rows of one digest with different bytes are grouped by the bytes instead.

Cases: null and empty texts equal each other (both normalise to the empty string); an identifier that is null loses to
any other; among rows with the same smallest identifier the first locator is kept; repeated rows are members of their
group; an empty table gives an empty result; other columns are ignored whatever their names.
"""

from pyspark.sql import functions as F

from barwise.llm.common import BLANKS, stored
from barwise.sources.files import shared_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def sha256(text):
    return F.sha2(text, 256)


def _rows(docs, id_col, text_col, digest, with_text=False):
    """(id, digest, file, row[, text]) of a file-backed table, batch or stream."""
    norm = normalised(F.col(text_col))
    out = docs.select(
        F.col(id_col).alias("id"), digest(norm).alias("digest"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
        *([norm.alias("norm")] if with_text else []),
    )
    return out


def _keeper():
    """Smallest identifier first, nulls last; ties by locator."""
    return F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "file", "row"))


def run_stream(spark, path, schema, checkpoint, id_col="doc_id", text_col="text", digest=sha256, files_per_batch=10_000):
    """Bring the keyed state in ``checkpoint`` up to date with the Parquet files of ``path``."""
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")  # many small stores
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    # As a pattern the path may also be a single file, which the file source refuses by its plain name.
    path = f"{path[:-1]}[{path[-1]}]"
    source = session.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    state = _rows(source, id_col, text_col, digest).groupBy("digest").agg(
        _keeper().alias("keep"), F.count("*").alias("n")
    )
    query = (
        state.writeStream.format("noop").outputMode("update")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def read_state(spark, checkpoint):
    """The keyed state as a table: digest, keep (identifier and locator), n."""
    state = spark.read.format("statestore").load(checkpoint)
    value = state.schema["value"].dataType
    keep, n = (f.name for f in value.fields)
    return state.select(
        F.col("key.digest").alias("digest"), F.col("value").getField(keep).alias("keep"),
        F.col("value").getField(n).alias("n"),
    )


def exact_groups(spark, path, id_col="doc_id", text_col="text", digest=sha256, checkpoint=None, files_per_batch=10_000):
    """One row per row of the Parquet table at ``path``: id, digest, keep_id, keep_file, keep_row, group_size, kept."""
    docs = spark.read.parquet(path)
    checkpoint = checkpoint or shared_folder(spark)
    run_stream(spark, path, docs.schema, checkpoint, id_col, text_col, digest, files_per_batch)
    state = stored(read_state(spark, checkpoint))

    def members(rows, groups, on):
        keep = F.col("keep")
        return rows.join(groups, on).select(
            "id", "digest", keep["id"].alias("keep_id"), keep["file"].alias("keep_file"), keep["row"].alias("keep_row"),
            F.col("n").alias("group_size"), ((F.col("file") == keep["file"]) & (F.col("row") == keep["row"])).alias("kept"),
        )

    # Full bytes of every digest hit more than once. Equal texts combine before the shuffle, however hot their group.
    hit = state.filter("n > 1").select("digest")
    texts = _rows(docs, id_col, text_col, digest, with_text=True).join(hit, "digest", "left_semi")
    by_bytes = texts.groupBy("digest", "norm").agg(_keeper().alias("keep"), F.count("*").alias("n"))
    torn = stored(by_bytes.groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1").select("digest"))
    rows = _rows(docs, id_col, text_col, digest)
    if torn.isEmpty():
        return members(rows, state, "digest")
    apart = _rows(docs, id_col, text_col, digest, with_text=True).join(torn, "digest", "left_semi")
    return members(rows, state.join(torn, "digest", "left_anti"), "digest").unionByName(
        members(apart, by_bytes.join(torn, "digest", "left_semi"), ["digest", "norm"])
    )
