"""DartMinHash: sketches of weighted sets by throwing hashed darts.

Each element owns a strip of the plane, as wide as its weight, along a rank axis. Darts fall on the strips as a Poisson
process that depends on the element alone: ``k`` of them per unit of area, each with a hashed coordinate out of ``k``. A
coordinate keeps its earliest dart. Two sets agree at a coordinate with probability equal to their weighted Jaccard
similarity. Only ranks up to (ln k + 2) / total weight are looked at, about k (ln k + 2) darts for a set of any size;
sets with an empty coordinate look twice as far until none is empty.

A strip is cut into cells of widths 1, 1, 2, 4, ... so that the darts of a cell do not depend on the weight; a dart
counts if it falls within the weight.
"""

import numpy as np

from barwise.llm.shingles import mix

_U = np.uint64
_SCALE = 1.0 / (1 << 53)


def _uniform(x):
    """In (0, 1]."""
    return ((x >> _U(11)).astype(np.float64) + 1.0) * _SCALE


def _cells(elements, owner, weights):
    """The cells that reach into each element's weight: seed, text, where the cell begins, its width, the weight."""
    level = np.where(weights <= 1, 0, np.ceil(np.log2(np.maximum(weights, 1)))).astype(np.int64)
    each = level + 1
    at = np.repeat(np.arange(len(elements)), each)
    cell = np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)
    begin = np.where(cell == 0, 0.0, 2.0 ** (cell - 1))
    width = np.where(cell == 0, 1.0, begin)
    return mix(elements[at] + cell.astype(_U) * _U(0xD1B54A32D192ED03)), owner[at], begin, width, weights[at]


def sketch(elements, owner, weights, n_texts, k):
    """Array (n_texts, k) of dart hashes; rows of texts without elements are zero. ``elements`` are distinct in a text."""
    out = np.zeros((n_texts, k), _U)
    if not len(elements):
        return out
    seed, text, begin, width, weight = _cells(elements, owner, weights.astype(np.float64))
    total = np.bincount(owner, weights, n_texts)
    far = np.zeros(n_texts)
    far[total > 0] = (np.log(k) + 2.0) / total[total > 0]
    missing = np.flatnonzero(total > 0)
    while len(missing):
        mine = np.isin(text, missing)
        best = _throw(seed[mine], text[mine], begin[mine], width[mine], weight[mine], far, k)
        full = np.bincount(best[0], minlength=n_texts) == k
        done = full[best[0]]
        out[best[0][done], best[1][done]] = best[2][done]
        missing = missing[~full[missing]]
        far[missing] *= 2
    return out


def _throw(seed, text, begin, width, weight, far, k):
    """(text, coordinate, dart) of the earliest dart of each coordinate that got one."""
    texts, coordinates, ranks, darts = [], [], [], []
    rank, turn = np.zeros(len(seed)), 0
    while len(seed):
        turn += 1
        dart = mix(seed + _U(turn * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        rank = rank - np.log(_uniform(dart)) / (k * width)
        near = rank <= far[text]
        seed, text, begin, width, weight, rank, dart = (x[near] for x in (seed, text, begin, width, weight, rank, dart))
        place = mix(dart ^ _U(0xA0761D6478BD642F))
        hit = begin + width * _uniform(mix(place)) <= weight
        texts.append(text[hit])
        coordinates.append((place[hit] % _U(k)).astype(np.int64))
        ranks.append(rank[hit])
        darts.append(dart[hit])
    text, coordinate = np.concatenate(texts), np.concatenate(coordinates)
    order = np.lexsort((np.concatenate(ranks), coordinate, text))
    text, coordinate = text[order], coordinate[order]
    first = np.ones(len(order), bool)
    first[1:] = (text[1:] != text[:-1]) | (coordinate[1:] != coordinate[:-1])
    return text[first], coordinate[first], np.concatenate(darts)[order][first]


def bands(sketches, rows):
    """Array (n_texts, k / rows): a hash of each run of ``rows`` coordinates and of its place."""
    n, k = sketches.shape
    out = np.zeros((n, k // rows), _U)
    out += np.arange(k // rows, dtype=_U) * _U(0xD1B54A32D192ED03)
    for r in range(rows):
        out = mix(out) + sketches[:, r::rows][:, : k // rows]
    return mix(out)
