"""Stages on rows with awkward columns, and the language model against enumeration of all paths."""

import itertools

import numpy as np
import pytest

import corpus_pipeline
from barwise.llm import crf, decontaminate, langid, mixing, neardup

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars long, _id string, _key long, `a.b` int, row map<string,int>, id string, hash string"


@pytest.fixture(scope="module")
def awkward(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 1, 2, {"k": i or 0}, "y", "z") for i, t, s in rows], KIND)

    return make


ROWS = [
    (1, "one two three four five six seven eight", "a"), (2, "one two three four five six seven eight", "b"), (2, None, "b"),
    (3, "the benchmark item in the middle of a text", None), (3, "the benchmark item in the middle of a text", None), (None, "nobody knows this one", "a"), (4, "", "a"),
]


def test_stages_keep_awkward_columns(spark, awkward):
    docs = awkward(ROWS)
    items = spark.createDataFrame([(9, "benchmark item")], "item_id long, text string")
    seen = lambda df: sorted((str(r["doc_id"]), r["text"] or "", r["a.b"], r["row"]["k"], r["_id"]) for r in df.collect())
    clean = decontaminate.clean(docs, items)
    assert clean.columns == docs.columns and seen(clean) == sorted((str(i), t or "", 2, i or 0, "x") for i, t, _ in ROWS if i != 3)
    one = neardup.keep_one(docs)
    assert one.columns == docs.columns and [r[:2] for r in seen(one)] == sorted([("1", ROWS[0][1]), ("2", ""), ("3", ROWS[3][1]), ("4", ""), ("None", ROWS[5][1])])
    mixed = mixing.take(docs, (5, 2, 1), 3.0)
    assert mixed.columns == docs.columns and set(seen(mixed)) <= set(seen(docs))
    kept = langid.known_language(docs, langid.fit(docs))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {1, 3}


def test_pipeline_on_an_empty_table_and_with_clashing_columns(spark, awkward, tmp_path):
    for name, rows in (("empty", []), ("clash", ROWS)):
        folder = tmp_path / name
        awkward(rows).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([(9, "benchmark item")], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
        got = corpus_pipeline.run(spark, str(folder)).collect()
        assert bool(got) == bool(rows) and all(r["n_tokens"] > 1 for r in got) and 3 not in {r["doc_id"] for r in got}


def test_signs_are_no_letters(spark):
    assert crf.text_words("² ½ Ⅷ ①") == [] and crf.text_words("x²y abc½") == ["x", "y", "abc"] and not crf.has_letter("² ½ 7 _")
    assert crf.text_words("ñandú Straße 中文") == ["ñandú", "straße", "中文"]
    docs = spark.createDataFrame([(i, "alpha beta gamma delta", "xx") for i in range(9)] + [(100, "² ½", None), (101, None, None)], "doc_id long, text string, lang string")
    got = {r["id"]: r["lang_pred"] for r in langid.languages(docs, langid.fit(docs)).collect()}
    assert got[100] == got[101] == "und" and got[0] == "xx"


def test_forward_backward_enumerates_all_paths():
    rng = np.random.default_rng(3)
    lengths, k = np.array([5, 4, 1]), 3
    scores, move, start = rng.random((5, 3, k)) + 0.1, rng.random((k, k)) + 0.1, rng.random(k) + 0.1
    post = crf.forward_backward(scores, lengths, move, start)[0]
    for s, n in enumerate(lengths):
        mass = np.zeros((n, k))
        for path in itertools.product(range(k), repeat=int(n)):
            w = start[path[0]] * np.prod([scores[t, s, y] for t, y in enumerate(path)]) * np.prod([move[a, b] for a, b in itertools.pairwise(path)])
            for t, y in enumerate(path):
                mass[t, y] += w
        assert post[:n, s] == pytest.approx(mass / mass.sum(1, keepdims=True))


def test_training_follows_the_gradient():
    """One small step lowers the loss (by enumeration) along the computed gradient as differences do."""
    snippets = [("a", ["aba", "bab", "aab"]), ("b", ["xyx", "yxy", "xxy"]), ("a", ["abb"]), ("b", ["yyx", "xyy"])]
    model = crf.Model(["a", "b"], [frozenset(), frozenset()])
    rng = np.random.default_rng(1)
    model.transitions += rng.normal(0, 0.3, (2, 2)).astype(np.float32)
    coded = [([model.features(w) for w in words], [("a", "b").index(lang)] * len(words)) for lang, words in snippets]

    def loss(transitions):
        total, words = 0.0, 0
        for parts, truth in coded:
            weight = lambda path: sum(model.weights[p][:, y].sum() for p, y in zip(parts, path)) + sum(transitions[a, b] for a, b in itertools.pairwise(path))
            total -= weight(truth) - np.log(sum(np.exp(weight(p)) for p in itertools.product((0, 1), repeat=len(parts))))
            words += len(parts)
        return total / words

    before = model.transitions.copy().astype(float)
    want = np.zeros((2, 2))
    for i, j in itertools.product((0, 1), repeat=2):
        up, down = before.copy(), before.copy()
        up[i, j] += 1e-4
        down[i, j] -= 1e-4
        want[i, j] = (loss(up) - loss(down)) / 2e-4
    grown = [np.zeros_like(x) for x in (model.weights, model.transitions, model.start)]
    crf._step(model, [g + 0 for g in grown], coded, 0.0)
    grown = [np.zeros_like(x) for x in grown]
    crf._step(model, grown, coded, 0.0)
    assert np.sqrt(grown[1]) == pytest.approx(np.abs(want), abs=2e-3)


def test_overlapping_sequences_are_one_chain():
    rng = np.random.default_rng(5)
    words = [rng.choice(["aba", "bab", "xyx", "yxy", "axa"]) for _ in range(3 * crf.SEQUENCE + 7)]
    model = crf.fit([("a", ["aba", "bab", "aab", "aba"] * 5), ("b", ["xyx", "yxy", "xxy", "yxy"] * 5)] * 20)
    rows = model.rows(words)
    found = crf.sequences(rows)
    assert [s for _, _, s in found] == [crf.SEQUENCE] * 3 + [7]
    pieces = model.marginals([s for s, _, _ in found], [(lead, size) for _, lead, size in found])
    assert pieces == pytest.approx(model.marginals([rows]), abs=1e-5)


def test_sample_by_hash_thresholds(spark):
    rows = spark.range(30_000).selectExpr("id", "CASE WHEN id % 50 = 0 THEN 'rare' WHEN id % 997 = 1 THEN 'few' ELSE 'hot' END AS lang")
    rows = rows.union(rows.filter("id < 40"))
    import collections

    from pyspark.sql import Window, functions as F

    by = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    want = rows.withColumn("n", F.row_number().over(by)).filter("n <= 300").select("id", "lang")
    count = lambda df: collections.Counter((r["id"], r["lang"]) for r in df.collect())
    assert count(langid._smallest(rows, 300)) == count(want)
