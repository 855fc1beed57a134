"""A wavelet matrix of token ids with the table of its documents: one shard of the binary output."""

import struct

import numpy as np
import zstandard

_HEAD = struct.Struct("<4sqqqB")
_MAGIC = b"WVM1"


class Bits:
    """A bit vector with rank and select."""

    def __init__(self, packed, n):
        self.n = n
        self.words = np.frombuffer(packed.ljust(-(-n // 64) * 8 + 8, b"\0"), "<u8")
        self.ones = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.ones[1:])
        self.total = int(self.ones[-1])

    def get(self, i):
        return (self.words[i >> 6] >> np.uint64(i & 63)) & np.uint64(1)

    def rank1(self, i):
        """Ones before position i."""
        low = (np.uint64(1) << np.uint64(i & 63)) - np.uint64(1)
        return int(self.ones[i >> 6]) + int(np.bitwise_count(self.words[i >> 6] & low))

    def select(self, bit, k):
        """Position of the k-th (from 0) ``bit``."""
        upto = self.ones if bit else np.arange(len(self.ones)) * 64 - self.ones
        w = int(np.searchsorted(upto, k, "right")) - 1
        inside = np.unpackbits(self.words[w : w + 1].view(np.uint8), bitorder="little")
        return w * 64 + int(np.flatnonzero(inside == bit)[k - int(upto[w])])

    def unpack(self):
        return np.unpackbits(self.words.view(np.uint8), count=self.n, bitorder="little").view(bool)


class WaveletMatrix:
    def __init__(self, planes, n):
        self.planes, self.n = planes, n
        self.zeros = [n - p.total for p in planes]

    @staticmethod
    def packed(ids, bits):
        """The bit planes of ids, highest bit first; each is stable-partitioned by the plane above."""
        out, ids, spare = [], ids.copy(), np.empty_like(ids)
        for b in reversed(range(bits)):
            plane = (ids & ids.dtype.type(1 << b)).astype(bool)
            out.append(np.packbits(plane, bitorder="little").tobytes())
            ones, zeros = np.flatnonzero(plane), np.flatnonzero(np.logical_not(plane, out=plane))
            np.take(ids, zeros, out=spare[: len(zeros)], mode="clip")
            np.take(ids, ones, out=spare[len(zeros) :], mode="clip")
            ids, spare = spare, ids
        return out

    def access(self, i):
        value = 0
        for plane, zeros in zip(self.planes, self.zeros):
            bit, ones = int(plane.get(i)), plane.rank1(i)
            i = zeros + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, value, low, high):
        for b, plane, zeros in zip(reversed(range(len(self.planes))), self.planes, self.zeros):
            one_low, one_high = plane.rank1(low), plane.rank1(high)
            low, high = (zeros + one_low, zeros + one_high) if value >> b & 1 else (low - one_low, high - one_high)
        return low, high

    def count(self, value, low=0, high=None):
        """Occurrences of a token between two positions."""
        if value >> len(self.planes):
            return 0
        low, high = self._range(value, low, self.n if high is None else high)
        return high - low

    def occurrence(self, value, k):
        """Position of the k-th (from 0) occurrence of a token."""
        low, high = self._range(value, 0, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        i = low + k
        for b, plane, zeros in zip(range(len(self.planes)), reversed(self.planes), reversed(self.zeros)):
            i = plane.select(1, i - zeros) if value >> b & 1 else plane.select(0, i)
        return i

    def decode(self, dtype="<u4"):
        """All ids in order, by undoing the partitions from the lowest plane up."""
        out, before = np.zeros(self.n, dtype), np.empty(self.n, dtype)
        for b, plane, zeros in zip(range(len(self.planes)), reversed(self.planes), reversed(self.zeros)):
            bits = plane.unpack()
            out[zeros:] |= out.dtype.type(1 << b)
            before[np.flatnonzero(bits)] = out[zeros:]
            before[np.flatnonzero(np.logical_not(bits, out=bits))] = out[:zeros]
            out, before = before, out
        return out


def dump(number, ids, bits, doc_ids, lengths):
    """The bytes of one shard. ``doc_ids`` may hold None."""
    known = np.array([i is not None for i in doc_ids], np.uint8)
    docs = np.array([0 if i is None else i for i in doc_ids], "<i8")
    pack = zstandard.ZstdCompressor(level=1).compress
    blocks = [pack(x.tobytes()) for x in (known, docs, np.asarray(lengths, "<i8"))]
    blocks += [pack(p) for p in WaveletMatrix.packed(ids, bits)]
    head = _HEAD.pack(_MAGIC, number, len(ids), len(docs), bits)
    return head + struct.pack(f"<{len(blocks)}q", *map(len, blocks)) + b"".join(blocks)


def parse(data):
    """(number, wavelet matrix, doc_ids, lengths) of a shard."""
    magic, number, n, n_docs, bits = _HEAD.unpack_from(data)
    if magic != _MAGIC:
        raise ValueError("not a shard")
    sizes = struct.unpack_from(f"<{bits + 3}q", data, _HEAD.size)
    at, blocks, unpack = _HEAD.size + 8 * len(sizes), [], zstandard.ZstdDecompressor().decompress
    for size in sizes:
        blocks.append(unpack(data[at : at + size]))
        at += size
    known, docs, lengths = np.frombuffer(blocks[0], np.uint8), np.frombuffer(blocks[1], "<i8"), np.frombuffer(blocks[2], "<i8")
    ids = [int(d) if k else None for k, d in zip(known, docs)]
    return number, WaveletMatrix([Bits(b, n) for b in blocks[3:]], n), ids, lengths
