"""Token counts from distinct pre-tokens.

Each distinct pre-token of the corpus is encoded once, for its number of pieces. Documents become pre-token frequencies;
those are joined to the counts and summed, so no ids are ever materialised per document. The most frequent pre-tokens
(at most ``HOT`` of them, so a bounded broadcast) are summed while the frequencies are formed; all others are joined by
key, which no pre-token dominates any more.

Cases: null and empty texts have 0 bytes and 0 tokens; every row is counted for itself, also repeated ones and those
without an identifier; an empty table gives an empty result; other columns are ignored.
"""

from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from barwise.llm.common import stored
from barwise.llm.vocab import load

#: Pre-tokens broadcast at most, some 30 bytes each.
HOT = 1 << 18
_FLUSH = 1_000_000


def _distinct(path):
    def run(batches):
        vocab, seen = load(path), Counter()

        def table():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["pretoken", "docs"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(set(vocab.pretokens(text or "")))
                if len(seen) > _FLUSH:
                    yield table()
                    seen = Counter()
        if seen:
            yield table()

    return run


def _pieces(path):
    def run(batches):
        vocab = load(path)
        for batch in batches:
            n = [len(i) for i in vocab.ids(batch.column("pretoken").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], ["pretoken", "docs", "pieces"])

    return run


def vocabulary(docs, path, text_col="text"):
    """Each distinct pre-token with the number of documents that hold it and its pieces."""
    found = docs.select(F.col(text_col).alias("text")).mapInArrow(_distinct(path), "pretoken string, docs long")
    return found.groupBy("pretoken").agg(F.sum("docs").alias("docs")).mapInArrow(_pieces(path), "pretoken string, docs long, pieces long")


def hottest(vocab, most=HOT):
    """The pieces of the most frequent pre-tokens, at most ``most``: a cut is read off a histogram of the counts."""
    grade = F.floor(F.log2("docs") * 16)
    bins = sorted(vocab.groupBy(grade.alias("grade")).count().collect(), reverse=True)  # at most 16 a power of two
    total, cut = 0, None
    for grade_, n in bins:
        total += n
        if total > most:
            break
        cut = grade_
    if cut is None:
        return {}
    rows = vocab.filter(grade >= cut).select("pretoken", "pieces").toArrow()
    return dict(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()))


def _frequencies(path, hot, id_type):
    """Per document a row with its bytes and the pieces of hot pre-tokens, and a row for each other pre-token."""

    def run(batches):
        vocab, known = load(path), hot.value
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows, ids, keys, n_bytes, n = [], [], [], [], []
            for id_, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                row += 1
                total, rest = 0, []
                for p, times in Counter(vocab.pretokens(text or "")).items():
                    pieces = known.get(p)
                    if pieces is None:
                        rest.append((p, times))
                    else:
                        total += pieces * times
                # no pre-token begins with #
                for key, size, count in [(f"#{row}", len((text or "").encode()), total), *((p, 0, c) for p, c in rest)]:
                    rows.append(row)
                    ids.append(id_)
                    keys.append(key)
                    n_bytes.append(size)
                    n.append(count)
                if len(rows) > 100_000:
                    yield _batch(rows, ids, keys, n_bytes, n, id_type)
                    rows, ids, keys, n_bytes, n = [], [], [], [], []
            if rows:
                yield _batch(rows, ids, keys, n_bytes, n, id_type)

    return run


def _batch(rows, ids, keys, n_bytes, n, id_type):
    return pa.RecordBatch.from_arrays(
        [pa.array(rows, pa.int64()), pa.array(ids, id_type), pa.array(keys, pa.string()), pa.array(n_bytes, pa.int64()), pa.array(n, pa.int64())],
        ["row", "id", "pretoken", "n_bytes", "n"],
    )


def token_counts(docs, path, id_col="doc_id", text_col="text", hot=HOT):
    """One row per document: id, n_bytes (UTF-8), n_tokens."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    vocab = stored(vocabulary(docs, path, text_col))
    known = spark.sparkContext.broadcast(hottest(vocab, hot))
    id_type = docs.schema[id_col].dataType
    parts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _frequencies(path, known, to_arrow_type(id_type)),
        f"row long, id {id_type.simpleString()}, pretoken string, n_bytes long, n long",
    )
    joined = parts.join(vocab.select("pretoken", "pieces"), "pretoken", "left")
    return joined.groupBy("row", "id").agg(
        F.sum("n_bytes").alias("n_bytes"), F.sum(F.col("n") * F.coalesce("pieces", F.lit(1))).alias("n_tokens")
    ).select("id", "n_bytes", "n_tokens")
