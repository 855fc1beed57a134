"""Conversation repair against an enumeration of all edit sequences."""

import hashlib
import itertools
import random
import re

import pytest

from barwise.llm import queries, repair

SF = "/root/testdata/sf0.001"
GOOD = re.compile(r"(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        solid = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")
        out.append(3 if not solid else 2 if (role, text) in seen else 0 if solid[-1] in ".!?" else 1)
        seen.add((role, text))
    return out


def brute(rows):
    """(cost, audit, repaired lines) by trying every edit of every turn with up to two insertions in each gap."""
    found = []
    gaps = ["", "u", "a", "ua", "au"]

    def go(i, cost, audit, lines):
        for extra in gaps:
            said = lines + [({"u": "user", "a": "assistant"}[c], "") for c in extra]
            at, edits = cost + 3 * len(extra), audit + "I" * len(extra)
            if i == len(rows):
                if GOOD.fullmatch("".join(r[:1] or "-" for r, _ in said)):
                    found.append((at, edits, said))
                continue
            (role, text), fault = rows[i], flags[i]
            go(i + 1, at + 4, edits + "D", said)
            if fault < 2:
                go(i + 1, at + 3 * fault, edits + "K", said + [(role, text)])
                for other in ("user", "assistant"):
                    go(i + 1, at + 3 + 3 * fault, edits + "R", said + [(other, text)])

    flags = faults(rows)
    go(0, 0, "", [])
    cost, audit, said = min(found, key=lambda f: f[:2])
    return cost, audit, "\n".join(f"{r}:{t}" for r, t in said)


def check(spark, conversations, **options):
    """``conversations``: id -> list of (turn, role, text); compares all columns with the enumeration."""
    rows = [(c, *r, "x", 1) for c, rs in conversations.items() for r in rs]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key string, `a.b` int")
    got = {r["id"]: r for r in repair.repair_digests(df, **options).collect()}
    assert set(got) == set(conversations)
    for c, rs in conversations.items():
        said = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rs]
        digest = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
        said.sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))
        rs = [(r, x) for _, r, x in said]
        turns = [t for t, _, _ in said if t is not None]
        cost, audit, text = brute(rs)
        flags, pairs = faults(rs), [a[0][:1] + b[0][:1] for a, b in itertools.pairwise(rs)]
        expected = {
            "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": flags.count(3), "duplicate": flags.count(2),
            "truncated": flags.count(1), "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit,
            "digest": hashlib.sha256(text.encode()).hexdigest(),
        }
        assert {k: got[c][k] for k in expected} == expected, rs


@pytest.mark.parametrize("block", [repair.BLOCK, 2])
def test_all_short_conversations(spark, block):
    rng = random.Random(block)
    roles, texts = ["system", "user", "assistant", "tool", "usher", "", None], ["One.", "Two!", "cut off", " \t", "", None, "One. \n"]
    made = {}
    for c in range(60):
        n = rng.randint(1, 4)
        made[c] = [(rng.choice([None, *range(5)]), rng.choice(roles[: 3 if c % 2 else 7]), rng.choice(texts)) for _ in range(n)]
    made[-1] = [(0, "user", "Same."), (0, "user", "Same."), (0, "user", "Same.")]
    made[None] = [(7, "assistant", "No question before.")]
    made[99] = [(0, "user", "Why?"), (1, "assistant", "Long. " * 30_000)]
    check(spark, made, block=block)


def test_long_conversation_in_blocks(spark):
    """All turns by the user: the best edits to the two last roles never meet, so nothing can be decided early."""
    rows = [(5, i, "user", f"Turn {i}.") for i in range(2001)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole, = repair.audits(df).collect()
    parts, = repair.audits(df, block=7).collect()
    assert whole == parts and whole["cost"] == 3 * 1001
    turns = [(r["position"], r["edit"], r["role"]) for r in repair.repaired_turns(df, repair.audits(df, block=7)).collect()]
    assert [t[2] for t in turns] == ["user", "assistant"] * 1001
    assert "".join(t[1] for t in turns) == parts["audit"]


def test_empty_table_and_situations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair_digests(df).collect() == []
    steps, finals = repair.automaton()
    assert len(steps) == 12 * len(finals) < 1 << 16


def test_query_returns_every_conversation(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Text {t}.") for c in range(40) for t in range(2)]
    rows.append((41, None, None, None))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.op11_conversation_repair(spark, str(tmp_path)).collect()
    assert sorted(r["conv_id"] for r in got) == [*range(40), 41]
    nothing = [r for r in got if not r["audit"]]
    assert nothing and all(r["repaired_sha256"] == hashlib.sha256(b"").hexdigest() and r["cost"] == 0 for r in nothing)
