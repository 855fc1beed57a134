"""Token-id output: one wavelet matrix file per shard, written and read by Spark.

Documents are range-partitioned by identifier and sorted; each task encodes its documents and closes a shard at
``SHARD_TOKENS`` ids, so a shard's memory is bounded (one document is never split over shards). A file is the bytes of one
shard. Spark's text writer stores them, one row per file, so any file system that Spark reaches will do, and a repeated
task writes the same shard again; the line feed that it appends lies behind the last block and is never read.

Cases: a null or empty text is the end id alone; null identifiers come first; rows of one identifier go by their text
and repeated rows follow each other; an empty table gives no shard and an empty result; other columns are ignored.
Identifiers are integers.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window, functions as F

from barwise.llm import vocab, wavelet
from barwise.llm.common import stored
from barwise.sources.files import shared_folder

SHARD_TOKENS = 1 << 22
_STEP_BYTES = 4 << 20  # text encoded at a time, about


def _shards(path, end_id, shard_tokens):
    def run(batches):
        cache = vocab.cache(path)
        dtype, number = cache.dtype, TaskContext.get().partitionId() << 32
        bits = max(int(max(cache.vocab.size - 1, end_id)).bit_length(), 1)
        docs, lengths, data, total = [], [], [], 0

        def shard():
            ids = np.concatenate(data)
            return pa.RecordBatch.from_arrays([pa.array([wavelet.dump(number, ids, bits, docs, lengths)], pa.binary())], ["payload"])

        for batch in batches:
            step = max(len(batch) * _STEP_BYTES // max(batch.nbytes, 1), 1)
            for at in range(0, len(batch), step):
                some = batch.slice(at, step)
                ids, counts = cache.encode(some.column("text"))
                ids, counts = np.insert(ids, np.cumsum(counts), end_id).astype(dtype), (counts + 1).tolist()
                begin, end = 0, 0  # of the ids that wait for their shard
                for id_, n in zip(some.column("id").to_pylist(), counts):
                    docs.append(id_)
                    lengths.append(n)
                    total, end = total + n, end + n
                    if total >= shard_tokens:
                        data.append(ids[begin:end])
                        yield shard()
                        number, begin = number + 1, end
                        docs, lengths, data, total = [], [], [], 0
                if begin < end:
                    data.append(ids[begin:end])
        if docs:
            yield shard()

    return run


def write_shards(docs, path, folder, end_id, id_col="doc_id", text_col="text", shard_tokens=SHARD_TOKENS):
    """Write the ids of all texts in ascending order of the identifiers."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange("id", tie).sortWithinPartitions("id", tie, "text")
    shards = ordered.mapInArrow(_shards(path, end_id, shard_tokens), "payload binary")
    shards.select(F.col("payload").cast("string")).write.option("maxRecordsPerFile", 1).text(folder)


def _read(batches):
    for batch in batches:
        for data in batch.column("content"):
            number, matrix, doc_ids, lengths = wavelet.parse(data.as_buffer().to_pybytes())
            narrow = "<u2" if len(matrix.planes) <= 16 else "<u4"
            ids = memoryview(matrix.decode(narrow).astype("<u4").tobytes())
            ends = np.cumsum(lengths)
            crc = [zlib.crc32(ids[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([number] * len(crc), pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())],
                ["shard", "id", "local", "n_tokens", "ids_crc32"],
            )


def read_documents(spark, folder):
    """From the files, one row per document: id, start (ids before it), n_tokens, ids_crc32."""
    files = spark.read.format("binaryFile").load(folder).select("content")
    docs = stored(files.mapInArrow(_read, "shard long, id long, local long, n_tokens long, ids_crc32 long"))
    sizes = docs.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # one row per file
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("shard", F.coalesce(before, F.lit(0)).alias("base"))
    return docs.join(bases, "shard").select("id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def encode(docs, path, end_id, id_col="doc_id", text_col="text", shard_tokens=SHARD_TOKENS):
    """Write the shards to a fresh shared folder and describe the documents from them."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    write_shards(docs, path, folder, end_id, id_col, text_col, shard_tokens)
    return read_documents(spark, folder)
