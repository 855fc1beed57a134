"""Near duplicates against brute force; sketches against exact similarities."""

import collections
import random
import re

import numpy as np
import pyarrow as pa

from barwise.llm import darts, neardup
from barwise.llm.shingles import distinct, shingles, words

LATER = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def word_list(text):
    return LATER.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def shingle_counts(text, size=5):
    w = word_list(text)
    if not w:
        return collections.Counter()
    return collections.Counter(tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1)))


def brute_classes(texts, weights="set"):
    sets = [shingle_counts(t) for t in texts]
    if weights == "set":
        sets = [collections.Counter(set(s)) for s in sets]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = collections.defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            by[x].add(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in by[x] if j < i}:
            least = sum((s & sets[j]).values())
            if least >= 0.8 * (sum(s.values()) + sum(sets[j].values()) - least):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


def test_word_hashes_follow_words(monkeypatch):
    from barwise.llm import shingles as module

    monkeypatch.setattr(module, "_BLOCK", 16)
    draw = random.Random(1)
    texts = ["".join(draw.choices(["a", "B", "é", " ", ".", "xyz", "\n"], k=draw.randint(0, 60))) for _ in range(200)] + [None, "w" * 100]
    hashes, owner = words(pa.array(texts))
    expected = [(i, w) for i, t in enumerate(texts) for w in word_list(t)]
    assert owner.tolist() == [i for i, _ in expected]
    names = collections.defaultdict(set)
    for h, (_, w) in zip(hashes.tolist(), expected):
        names[w].add(h)
    assert all(len(v) == 1 for v in names.values()) and len(set.union(*names.values())) == len(names)
    got = collections.Counter(shingles(hashes, owner, len(texts))[1].tolist())
    assert got == {i: n for i, t in enumerate(texts) if (n := sum(shingle_counts(t).values()))}


def test_sketches_estimate_weighted_similarity():
    rng = np.random.default_rng(5)
    k, errors = 1024, []
    for _ in range(6):
        pool = rng.integers(0, 2**63, 60).astype(np.uint64)
        a, b = rng.choice([0.25, 0.5, 1, 2, 3, 7], 60), rng.choice([0.25, 0.5, 1, 2, 3, 7], 60)
        a[rng.random(60) < 0.3] = 0
        b[:30] = a[:30]
        sides = [(pool[w > 0], w[w > 0]) for w in (a, b)]
        e, w = np.concatenate([s[0] for s in sides]), np.concatenate([s[1] for s in sides])
        of = np.repeat([0, 1], [len(s[0]) for s in sides])
        both = darts.sketch(e, of, w, 2, k)
        assert (both != 0).all()
        errors.append((both[0] == both[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert max(map(abs, errors)) < 4 * 0.5 / k**0.5 and abs(np.mean(errors)) < 2 * 0.5 / (6 * k) ** 0.5


def corpus():
    draw = random.Random(3)
    new = lambda n: [f"w{draw.randint(0, 3000)}" for _ in range(n)]
    texts = [None, "", "...", "one two", "One, two!", "one two", "a b c d e", "a b c d e f"]
    for _ in range(12):
        base = new(draw.choice([8, 60, 400]))
        for _ in range(draw.randint(1, 8)):
            w = list(base)
            for _ in range(draw.randint(0, max(1, len(w) // 60))):
                w[draw.randrange(len(w))] = "edit" + str(draw.randint(0, 99))
            texts.append(" ".join(w))
        texts.append(" ".join(base[: len(base) // 2] + new(len(base) // 2)))
    passage = new(60)
    texts += [" ".join(new(10) + passage + new(10)) for _ in range(30)]
    base = new(150)
    texts += [" ".join(base[:i] + ["odd" + str(i)] + base[i + 1 :]) for i in range(120)]
    draw.shuffle(texts)
    return texts


def check(spark, texts, weights):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, label string")
    rows = neardup.classes(docs, weights=weights).collect()
    got = {r.id: r.class_id for r in rows}
    assert len(rows) == len(texts)
    assert [got[i] for i in range(len(texts))] == brute_classes(texts, weights)
    sizes = collections.Counter(got.values())
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.id == r.class_id) for r in rows)
    return docs, got


def test_classes_equal_brute_force(spark):
    docs, got = check(spark, corpus(), "set")
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))
    check(spark, corpus()[:150] + ["x y z " * 30, "x y z " * 28, "x y z " * 10], "count")


def test_odd_rows(spark):
    schema = "doc_id long, text string, id string, key string, bands int, digest string"
    rows = [(1, "a b c d e f g", "p", None, 1, "d")] * 3 + [(None, "a b c d e f g", "q", "k", 2, None), (None, None, None, None, None, None), (7, "", "r", "k", 3, "d")]
    docs = spark.createDataFrame(rows, schema)
    out = neardup.classes(docs).collect()
    assert sorted((r.class_id or 0, r.class_size, r.kept) for r in out) == [(0, 1, True), (1, 4, False), (1, 4, False), (1, 4, False), (1, 4, True), (7, 1, True)]
    assert sorted(neardup.keep_one(docs).collect(), key=str) == sorted([rows[0], rows[4], rows[5]], key=str)
    empty = spark.createDataFrame([], schema)
    assert neardup.classes(empty).collect() == [] and neardup.keep_one(empty).collect() == []


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    expected = brute_classes([r.text for r in rows])
    got = {r.id: r.class_id for r in neardup.classes(docs).collect()}
    assert got == {r.doc_id: rows[e].doc_id for r, e in zip(rows, expected)}
