"""The prefix trie against nested dictionaries, and the radix tree against sorted keys."""

import collections
import hashlib
import random
import re
import zlib

import pytest

from barwise.llm import queries, trie
from barwise.llm.radix import RadixTree


def brute(conversations, members=()):
    """Node rows of id -> list of (role, text)."""
    for c in members:
        conversations.setdefault(c, [])
    nodes = collections.defaultdict(set)
    for c, said in conversations.items():
        for d in range(len(said) + 1):
            nodes[tuple(said[:d])].add(c)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    kids = collections.Counter(p[:-1] for p in nodes if p)
    out = collections.Counter()
    for p, inside in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        ends = sorted(c for c in inside if len(conversations[c]) == len(p))
        out[
            min(inside), len(p), min(nodes[p[:-1]]) if p else None, len(inside), kids[p], sum(not kids[q] for q in below),
            sum((len(nodes[q]) - 1) * words(q) for q in below), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ] += 1
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_words", "ends"]


def made(seed, n=60, turns=6, texts=3):
    rng = random.Random(seed)
    return {c * 3 - 20: [(rng.choice(["user", "assistant"]), f"word {rng.randrange(texts)}  more") for _ in range(rng.randint(1, turns))] for c in range(n)}


def table(spark, conversations):
    rows = [(c, i, r, t, "k", 1) for c, said in conversations.items() for i, (r, t) in enumerate(said)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key string, `a.b` int")


@pytest.mark.parametrize("options", [{}, {"budget": 7}, {"budget": 5, "segment": 2}, {"segment": 1}])
def test_nodes(spark, options):
    said = made(len(options)) | {1000: [("user", "x")] * 9, 1001: [("user", "x")] * 9, 1002: [("user", "x")] * 4}
    extra = spark.createDataFrame([(5000,), (-5000,)], "id long")
    got = trie.prefix_trie(trie.turns(table(spark, said)), extra.union(spark.createDataFrame([(c,) for c in said], "id long")), **options)
    assert collections.Counter(tuple(r[c] for c in COLUMNS) for r in got.collect()) == brute(dict(said), [5000, -5000])


def test_odd_rows(spark):
    rows = [
        (1, 0, None, None), (2, 0, "", ""), (3, None, "user", "first"), (3, 1, "user", "second"), (None, 0, "user", "nobody"),
        (4, 0, "use", "rfirst"), (5, 0, "user", "first"), (5, 0, "user", "first"), (6, 0, "user", "long " * 100_000),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    nodes = trie.prefix_trie(trie.turns(df))
    said = {1: [("", "")], 2: [("", "")], 3: [("user", "first"), ("user", "second")], 4: [("use", "rfirst")],
            5: [("user", "first")] * 2, 6: [("user", "long " * 100_000)]}
    assert collections.Counter(tuple(r[c] for c in COLUMNS) for r in nodes.collect()) == brute(said)
    texts = collections.Counter((r["role"], r["text"]) for r in trie.node_turns(nodes, df).collect())
    assert texts == collections.Counter([("", ""), ("user", "first"), ("user", "first"), ("user", "second"), ("use", "rfirst"), ("user", "long " * 100_000)])
    assert trie.prefix_trie(trie.turns(df.limit(0))).collect() == []


def test_query_with_shared_heads(spark, tmp_path):
    said = {c: v for c, v in made(9, n=90, turns=5, texts=4).items()}
    del said[40 if 40 in said else -20]
    table(spark, said).write.parquet(str(tmp_path / "conversations.parquet"))
    rebuilt = {}
    for c, own in said.items():
        head = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        rebuilt[c] = said.get(base, [])[:head] + own[head:]
    assert any(not v for v in rebuilt.values())  # some have no turn left
    got = queries.op12_prefix_trie(spark, str(tmp_path)).withColumnsRenamed({"saved_tokens": "saved_words", "ends_sha256": "ends"}).collect()
    assert collections.Counter(tuple(r[c] for c in COLUMNS) for r in got) == brute(rebuilt)


def test_radix_tree_layouts():
    rng = random.Random(4)
    for letters in (2, 12, 40, 256):
        tree, keys = RadixTree(), collections.Counter()
        for _ in range(3000):
            key = bytes(rng.randrange(letters) for _ in range(rng.randint(0, 3))) + b"tail" * rng.randrange(2)
            tree.insert(key, len(keys))
            keys[key] += 1
        paths, sizes = [], set()
        for node, up, path in tree.walk():
            paths.append((paths[up] if up >= 0 else b"") + path)
            sizes.add(node.size)
            assert len(node.values) == keys[paths[-1]] and (node.values or up < 0 or len(node.items()) > 1)
            assert all(node.child(b) is c for b, c in node.items()) and len(node.items()) <= node.size
        assert {p for p, (node, _, _) in zip(paths, tree.walk()) if node.values} == set(keys)
        assert max(sizes) == {2: 4, 12: 16, 40: 48, 256: 256}[letters]
