"""A linear-chain conditional random field over words; the states are languages.

A word's features are its affixes, its character n-grams (hashed) and the lexicons it is in; a state scores a word by the
sum of its weights for them, and two neighbouring states by a learned transition. Marginals come from forward-backward,
vectorised over many sequences at once.
"""

import re
import zlib
from collections import Counter
from itertools import chain

import numpy as np

LETTERS = re.compile(r"[^\W\d_]{1,40}")  # a longer run is several words of the chain
BUCKETS = 1 << 15
#: Words of a sequence. Longer texts are several, each read with so many words of its neighbours on both sides: what a word
#: tells of its surroundings fades within a few words, so marginals are those of the whole chain.
SEQUENCE, OVERLAP = 512, 32
_PIECE = 1 << 20


def text_words(text):
    """Lower-cased runs of letters, those of over 40 letters in consecutive pieces, cut from a long text piece by piece."""
    text, out, at = text.lower(), [], 0
    while at < len(text):
        end = at + _PIECE
        while end < len(text) and text[end].isalpha():
            end += 1
        found = LETTERS.findall(text, at, end)
        if not all(map(str.isalpha, found)):
            # the expression takes signs such as superscripts and fractions for letters
            found = "".join(c if c.isalpha() else " " for c in " ".join(found)).split()
        out += found
        at = end
    return out


def has_letter(text):
    return any(c.isalpha() for c in text or "")


def sequences(rows):
    """(rows of the sequence with its neighbours, where its own begin, how many they are) for a text of any length."""
    out = []
    for at in range(0, len(rows), SEQUENCE):
        begin, end = max(at - OVERLAP, 0), min(at + SEQUENCE, len(rows))
        out.append((rows[begin : end + OVERLAP], at - begin, end - at))
    return out


class _Hashes(dict):
    """Bucket of each piece of a word; the same few pieces come again and again."""

    def __missing__(self, piece):
        if len(self) >= 1 << 19:
            self.clear()
        self[piece] = found = zlib.crc32(piece.encode("utf-8", "surrogatepass")) % BUCKETS
        return found


_bucket = _Hashes().__getitem__


def _features(word):
    marked = f"^{word}$"
    n = len(marked)
    out = [f"p{marked[1:k]}" for k in range(2, min(n, 5))] + [f"s{marked[-k:-1]}" for k in range(2, min(n, 5))]
    out += [marked[i : i + k] for k in (2, 3) for i in range(n - k + 1)]
    return list(map(_bucket, out))


def _grown(held, more, n):
    """``held`` with ``more`` as its rows up to ``n``; room doubles, so adding costs what is added."""
    at = n - len(more)
    if held is None or n > len(held):
        room = np.zeros((max(2 * n, 1024), *more.shape[1:]), more.dtype)
        if at:
            room[:at] = held[:at]
        held = room
    held[at:n] = more
    return held


class Model:
    def __init__(self, langs, lexicons):
        self.langs, self.lexicons = langs, lexicons
        n = len(langs)
        # the rows after the hashed ones: in the lexicon of each language, and a constant
        self.weights = np.zeros((BUCKETS + n + 1, n), np.float32)
        self.transitions, self.start = np.zeros((n, n), np.float32), np.zeros(n, np.float32)
        # what ``calibrate`` learns: hashed features seen, mean and deviation of the unseen share of a new word, lowest mean marginal
        self.seen, self.unseen, self.lowest = None, (1.0, 0.0), 0.0
        self._rows, self._scores, self._unseen = {}, None, None

    def __getstate__(self):
        return self.__dict__ | {"_rows": {}, "_scores": None, "_unseen": None}

    def features(self, word):
        lexical = [BUCKETS + i for i, words in enumerate(self.lexicons) if word in words]
        return _features(word) + lexical + [BUCKETS + len(self.langs)]

    def rows(self, words, most=300_000):
        """Index of each word into ``scores``; at most ``most`` words are kept between calls."""
        if len(self._rows) > most:
            self._rows, self._scores, self._unseen = {}, None, None
        known = self._rows
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            parts = [self.features(w) for w in new]
            flat = np.fromiter(chain.from_iterable(parts), np.int64)
            begin = np.cumsum([0] + [len(p) for p in parts[:-1]])
            scores = np.add.reduceat(self.weights[flat], begin)
            scores = np.exp(scores - scores.max(1, keepdims=True))
            for w in new:
                known[w] = len(known)
            self._scores = _grown(self._scores, scores, len(known))
            if self.seen is not None:
                hashed = flat < BUCKETS
                new_to_it = np.zeros(len(flat))
                new_to_it[hashed] = ~self.seen[flat[hashed]]
                unseen = np.add.reduceat(new_to_it, begin) / np.add.reduceat(hashed.astype(float), begin) * [len(w) > 3 for w in new]
                self._unseen = _grown(self._unseen, unseen, len(known))
        get = known.__getitem__
        return np.fromiter(map(get, words), np.int64, len(words))

    def unseen_share(self, rows):
        """Sum over the distinct words among ``rows`` of the share of their hashed features that no learned word has (0 in
        words of under four letters), and the number of these words."""
        rows = np.unique(rows)
        return (float(self._unseen[rows].sum()) if self._unseen is not None else 0.0), len(rows)

    def accepts(self, score, n_words, unseen, distinct):
        """Whether a text can be of the languages learned; both bounds tighten with its length.

        Its distinct words may have as many unseen features as new words of the languages have, a tenth for names and codes,
        and four standard errors. Runs of under four letters, of which keys and codes consist, count as seen.
        Its mean marginal must be on the way from chance to half as far above it as the lowest labelled snippet."""
        mean, dev = self.unseen
        if unseen > distinct * (mean + 0.1) + 4 * max(dev, 0.1) * distinct**0.5:
            return False
        chance = 1 / max(len(self.langs), 1)
        return len(self.langs) < 2 or score >= chance + max(self.lowest - chance, 0) / 2 * n_words / (n_words + 20)

    def calibrate(self, snippets):
        """Learn the bounds of ``accepts`` from the (language, words) snippets that the model was fitted on. A feature of a
        word counts as unseen there if no other distinct word has it, so copies of texts change nothing."""
        words = list(dict.fromkeys(w for _, snippet in snippets for w in snippet))
        if not words:
            return
        parts = [sorted(set(_features(w))) for w in words]
        flat = np.concatenate([np.array(p) for p in parts])
        counts = np.bincount(flat, minlength=BUCKETS)
        self.seen = counts > 0
        shares = np.add.reduceat((counts[flat] == 1).astype(float), np.cumsum([0] + [len(p) for p in parts[:-1]])) / [len(p) for p in parts]
        self.unseen = float(shares.mean()), float(shares.std())
        rows = [self.rows(snippet, most=1 << 60) for _, snippet in snippets if snippet]
        post, ends = self.marginals(rows), np.cumsum([len(r) for r in rows])
        sums = np.add.reduceat(post, ends - [len(r) for r in rows])
        self.lowest = float((sums.max(1) / [len(r) for r in rows]).min())
        self._rows, self._scores, self._unseen = {}, None, None

    def marginals(self, sequences, own=None):
        """Per-word probabilities (words, languages) of row arrays from ``rows``, in order. ``own``: for each sequence where the
        words asked for begin and how many they are."""
        order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
        lengths = np.array([len(sequences[i]) for i in order])
        grid = np.zeros((lengths[0], len(order)), np.int64)
        for column, i in enumerate(order):
            grid[: len(sequences[i]), column] = sequences[i]
        post = forward_backward(self._scores[grid], lengths, np.exp(self.transitions), np.exp(self.start))[0]
        out = [None] * len(order)
        for column, i in enumerate(order):
            lead, size = own[i] if own else (0, lengths[column])
            out[i] = post[lead : lead + size, column]
        return np.concatenate(out)


def forward_backward(scores, lengths, move, start):
    """Posteriors of ``scores`` (time, sequence, state), lengths descending; and alpha, beta for the pairwise ones."""
    alpha, beta = np.zeros_like(scores), np.ones_like(scores)
    active = [int((lengths > t).sum()) for t in range(len(scores))]
    for t, n in enumerate(active):
        a = (alpha[t - 1, :n] @ move if t else start) * scores[t, :n]
        alpha[t, :n] = a / a.sum(1, keepdims=True)
    for t in range(len(scores) - 2, -1, -1):
        n = active[t + 1]
        b = (scores[t + 1, :n] * beta[t + 1, :n]) @ move.T
        beta[t, :n] = b / b.sum(1, keepdims=True)
    post = alpha * beta
    return post / np.maximum(post.sum(2, keepdims=True), 1e-30), alpha, beta


def lexicons(snippets, langs, most=2000):
    """Per language the words seen at least twice and for the most part in it."""
    counts = {l: Counter() for l in langs}
    for lang, words in snippets:
        counts[lang].update(words)
    total = sum(counts.values(), Counter())
    return [
        frozenset(w for w, n in counts[l].most_common(most) if n >= 2 and n > 0.8 * total[w]) for l in langs
    ]


def fit(snippets, epochs=4, batch=64, rate=0.3, seed=7):
    """Learn from (language, words) snippets. Sequences are one to three of them in a row, so switches are seen."""
    langs = sorted({l for l, _ in snippets})
    model = Model(langs, lexicons(snippets, langs))
    if len(langs) < 2:
        model.calibrate(snippets)
        return model
    at, rng = {l: i for i, l in enumerate(langs)}, np.random.default_rng(seed)
    cache = {}
    coded = []
    for lang, words in snippets:
        parts = [cache.get(w) or cache.setdefault(w, model.features(w)) for w in words]
        coded.append((at[lang], parts))
    grown = [np.full_like(x, 1e-2) for x in (model.weights, model.transitions, model.start)]
    for _ in range(epochs):
        order, sequences = list(rng.permutation(len(coded))), []
        while order:
            some = [coded[order.pop()] for _ in range(min(int(rng.integers(1, 4)), len(order)))]
            sequences.append(([p for _, parts in some for p in parts], [y for y, parts in some for _ in parts]))
        for b in range(0, len(sequences), batch):
            _step(model, grown, sequences[b : b + batch], rate)
    model.calibrate(snippets)
    return model


def _step(model, grown, sequences, rate):
    sequences = sorted(sequences, key=lambda s: -len(s[0]))
    lengths = np.array([len(s[0]) for s in sequences])
    steps, n, k = lengths[0], len(sequences), len(model.langs)
    words = [p for s in sequences for p in s[0]]
    flat = np.fromiter((f for p in words for f in p), np.int64)
    sizes = np.array([len(p) for p in words])
    raw = np.add.reduceat(model.weights[flat], np.cumsum(sizes) - sizes)
    which = np.repeat(np.arange(n), lengths)
    when = np.concatenate([np.arange(l) for l in lengths])
    scores = np.ones((steps, n, k), np.float32)
    scores[when, which] = np.exp(raw - raw.max(1, keepdims=True))
    truth = np.concatenate([s[1] for s in sequences])
    move, start = np.exp(model.transitions), np.exp(model.start)
    post, alpha, beta = forward_backward(scores, lengths, move, start)
    gap = post[when, which]
    gap[np.arange(len(truth)), truth] -= 1
    gap /= len(truth)
    d_weights = np.zeros_like(model.weights)
    np.add.at(d_weights, flat, np.repeat(gap, sizes, axis=0))
    d_move = np.zeros_like(model.transitions)
    inner = (when[1:] > 0) & (which[1:] == which[:-1])
    t, s = when[1:][inner], which[1:][inner]
    pair = alpha[t - 1, s][:, :, None] * move * (scores[t, s] * beta[t, s])[:, None, :]
    d_move += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
    np.subtract.at(d_move, (truth[:-1][inner], truth[1:][inner]), 1)
    d_move /= len(truth)
    firsts = np.flatnonzero(when == 0)
    for x, g, d in zip((model.weights, model.transitions, model.start), grown, (d_weights, d_move, gap[firsts].sum(0))):
        g += d * d
        x -= rate * d / np.sqrt(g)
