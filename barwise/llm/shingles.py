"""Hashes of words and of word shingles, vectorised over the UTF-8 bytes of many texts."""

import numpy as np
import pyarrow as pa

_U = np.uint64
_PRIME = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_PRIME), -1, 1 << 64))
_BLOCK = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: bytes that are part of a word: digits, letters, and all of characters beyond ASCII
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def mix(x):
    """A bijection of 64-bit numbers that scatters them."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base, n):
    with np.errstate(over="ignore"):
        out = np.full(n, base, _U)
        out[:1] = 1
        return np.cumprod(out, dtype=_U)


_UP, _DOWN = _powers(_PRIME, _BLOCK * 2), _powers(_INVERSE, _BLOCK * 2)


def words(texts):
    """(hash of each word in order, index of its text) for an Arrow array of strings; a null text has no words."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data or b"", np.uint8)[: offsets[-1]]
    hashes, places, at = [], [], int(offsets[0])
    starts = offsets[:-1]
    while at < len(data):
        end = min(at + _BLOCK, len(data))
        # a block ends where a word ends
        while end < len(data) and _WORD[data[end]] and not _starts(starts, end):
            step = data[end : end + 4096]
            stop = np.flatnonzero(~_WORD[step])
            nxt = int(np.searchsorted(starts, end + 1))
            limit = int(starts[nxt]) if nxt < len(starts) else len(data)
            end = min(end + (int(stop[0]) if len(stop) else len(step)), limit)
        h, p = _block(data[at:end], starts, at)
        hashes.append(h)
        places.append(p)
        at = end
    if not hashes:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    hashes, places = np.concatenate(hashes), np.concatenate(places)
    return hashes, np.searchsorted(offsets, places, "right") - 1


def _starts(starts, at):
    i = int(np.searchsorted(starts, at))
    return i < len(starts) and starts[i] == at


def _block(data, starts, base):
    inside = _WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    # texts lie next to each other without a separator
    cuts = starts[np.searchsorted(starts, base + 1) : np.searchsorted(starts, base + len(data))] - base
    first[cuts] |= inside[cuts]
    last[cuts - 1] |= inside[cuts - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = (_UP, _DOWN) if len(data) <= len(_UP) else (_powers(_PRIME, len(data)), _powers(_INVERSE, len(data)))
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum((_LOWER[data].astype(_U) + _U(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(_U)), begin + base


def shingles(hashes, owner, n_texts, size=5):
    """(hash, text) of every run of ``size`` words inside a text; a shorter text with words is one shingle."""
    n = len(hashes)
    counts = np.bincount(owner, minlength=n_texts)
    out, of = [], []
    if n >= size:
        whole = owner[: n - size + 1] == owner[size - 1 :]
        h = np.zeros(n - size + 1, _U)
        for k in range(size):
            h = mix(h + _PRIME) + hashes[k : n - size + 1 + k]
        out.append(mix(h[whole]))
        of.append(owner[: n - size + 1][whole])
    begins = np.cumsum(counts) - counts
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        h = counts[short].astype(_U)
        for k in range(size - 1):
            there = counts[short] > k
            h = np.where(there, mix(h + _PRIME) + hashes[np.minimum(begins[short] + k, n - 1)], h)
        out.append(mix(h))
        of.append(short)
    if not out:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(of)


def distinct(hashes, owner):
    """Distinct (hash, text) pairs, sorted by text and hash, with their multiplicity."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    return h[at], o[at], np.diff(np.append(at, len(h)))
