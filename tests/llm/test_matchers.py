"""License automata against a backtracking matcher, and mined associations against all token subsets."""

import itertools
import random

from barwise.llm import licenses, urls


def backtrack(text, words, at):
    """Every place where a run from ``at`` may end, by trying all readings of the markup."""
    pieces = licenses._MARK.split(text)

    def read(i, at):
        if i == len(pieces):
            return {at}
        piece = pieces[i]
        if i % 2 == 0:
            wanted = licenses.text_words(piece)
            return read(i + 1, at + len(wanted)) if words[at : at + len(wanted)] == wanted else set()
        if piece == "end":
            return read(i + 1, at)
        if piece == "optional":
            depth, j = 1, i
            while depth:
                j += 1
                if j % 2:
                    depth += {"optional": 1, "end": -1}.get(pieces[j], 0)
            return read(i + 1, at) | read(j + 1, at)
        least, most = map(int, piece.split()[1:])
        return set().union(*[read(i + 1, at + n) for n in range(least, most + 1) if at + n <= len(words)])

    return read(0, at)


def test_automaton_reads_as_backtracking_does():
    rng = random.Random(2)
    templates = [
        ("a", "one <<any 0 2>> two <<optional>>three <<optional>>four <<end>>five<<end>> six"), ("b", "<<optional>>two<<end>> two three"),
        ("c", "six <<any 1 3>> six"), ("d", "<<any 0 1>> five five"), ("a", "four four"),
    ]
    assert all(licenses._MARK.search(t) for _, t in templates[:4])
    automaton = licenses.Automaton(templates)
    vocabulary = "one two three four five six seven".split()
    for n in range(400):
        words = [rng.choice(vocabulary[: 2 + n % 6]) for _ in range(rng.randint(0, 14))]
        want = {}
        for i in range(len(words)):
            for label, text in templates:
                for end in backtrack(text, words, i):
                    if end > i:
                        want[label, i] = max(want.get((label, i), -1), end - 1)
        assert sorted(automaton.places(words)) == sorted((label, i, j) for (label, i), j in want.items()), words


def test_associations_are_those_of_all_subsets(spark):
    rng = random.Random(6)
    tokens = ["casino", "win", "news", "shop", "blog"]
    rows = []
    for i in range(400):
        basket = sorted(t for t in tokens if rng.random() < 0.45)
        blocked = rng.random() < (0.97 if {"casino", "win"} <= set(basket) else 0.95 if "shop" in basket else 0.1)
        rows.append((basket, blocked, f"d{i % 2}", "en"))
    df = spark.createDataFrame(rows, "tokens array<string>, label boolean, domain string, language string")
    got = {tuple(r["tokens"]): r["confidence"] for r in urls.associations(df).collect()}

    def share(part, key=None):
        some = [r for r in rows if set(part) <= set(r[0]) and (key is None or (r[2], r[3])[key[0]] == key[1])]
        return sum(r[1] for r in some) / len(some) if some else 0.0, len(some)

    full, z = sum(bool(r[0]) for r in rows), urls.Z
    accepted = {}
    for k in range(1, len(tokens) + 1):
        for part in itertools.combinations(sorted(tokens), k):
            p, n = share(part)
            if n == 0 or p < urls.CONFIDENCE or p * n < urls.SUPPORT * full:
                continue
            above = True
            for which in (0, 1):
                inside = [r for r in rows if set(part) <= set(r[0])]
                base = {v: share((), (which, v))[0] for v in {r[2 + which] for r in rows}}
                expected = sum(base[r[2 + which]] for r in inside) / n
                bound = (p + z * z / (2 * n) - z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)
                above &= bound > expected
            if above and not any(set(a) < set(part) for a in accepted):
                accepted[part] = p
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in accepted.items()}
