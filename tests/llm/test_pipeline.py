"""The pipeline, stage by stage, against plain Python on the smallest tables."""

import collections
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from barwise.llm import mixing
from test_neardup import brute_classes
from test_operators import SF, brute_hits, brute_targets


def test_stages(spark, tmp_path):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "benchmark_decontamination", "source_mixing", "binary_output"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(-1, None, None, None, 0), (-2, "12 34", "en", "src0", 5)], docs.schema)
    out, given = {}, docs.union(extra)
    for name, stage in stages.items():
        stage(spark, given, SF).write.parquet(str(tmp_path / name))
        given = spark.read.parquet(str(tmp_path / name))
        out[name] = given.collect()
        if name != "binary_output":
            assert given.columns == docs.columns
    source = {r.doc_id: r for r in docs.collect()}
    assert {r.doc_id for r in out["language_id"]} == set(source)  # all but the two added
    rows = sorted(out["language_id"])
    first = {rows[c].doc_id for c in brute_classes([r.text for r in rows])}
    assert sorted(r.doc_id for r in out["near_dedup"]) == sorted(first)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {i for i in first if not brute_hits(source[i].text, items, 10)[1]}
    assert sorted(r.doc_id for r in out["benchmark_decontamination"]) == sorted(clean)
    sizes = collections.Counter()
    for i in clean:
        sizes[source[i].source] += len(source[i].text.split())
    taken, longest = collections.Counter(), max(len(source[i].text.split()) for i in clean)
    for r in out["source_mixing"]:
        assert source[r.doc_id] == r
        taken[r.source] += len(r.text.split())
    for s, t in brute_targets(sizes, (5, 2, 1), 3.0).items():
        assert abs(taken[s] - t) <= longest
    assert max(collections.Counter(r.doc_id for r in out["source_mixing"]).values()) <= 3
    from tokenizers import Tokenizer

    library, start, expected = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for i, t in sorted((r.doc_id, r.text) for r in out["source_mixing"]):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")
        expected.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, out["binary_output"])) == sorted(expected)


def test_run_equals_stages_and_reruns(spark):
    once, again = (sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) for _ in range(2))
    assert once == again and once


def test_hash_is_the_same_in_any_engine(spark):
    import hashlib

    rows = spark.range(20).select("id", mixing.hash60(F.col("id")).alias("h")).collect()
    assert all(r.h == int(hashlib.md5(f"{r.id}:mix-1".encode()).hexdigest()[:15], 16) for r in rows)
