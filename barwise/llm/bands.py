"""Quality rules from compression bands, beside word and line counts.

A whole text and each of its fixed chunks is compressed with zstandard. Compressed size over size must lie inside a band
that depends on the length in bytes, because the frame of a short text costs a large share and a long text repeats its
vocabulary: below the band a text repeats itself, above it a text is no prose (digests, encoded data). A text is rejected
if its own ratio lies outside its band, or if chunks outside theirs hold more than half of its bytes.

The counts (words: runs without white space): ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
``n_repeat_words`` (words in a five-word window that occurs twice or more, compared exactly). ``base_failed`` is the plain
rule on them: too few words, or too many repeated ones.

Rows are judged one by one where they lie: nothing is shuffled and no group exists. A text needs a few times its own size
in memory (4 bytes a word, its distinct words, its distinct lines).

Cases: a null or empty text has no words, fails the base rule and has ratio null and no chunks; a text of under 64 bytes is
not judged by compression; a text of a million words is read whole, chunk by chunk; ties do not exist, as each row is judged
alone; repeated rows get the same result each; an empty table gives an empty result; other columns are left alone.
"""

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from barwise.llm.common import quoted

#: bytes a text must stay below, least and largest ratio; None: no bound. Set by reading prose of four languages with wide
#: margins: prose stays above 1.3 times the lower bound and below 0.95 of the upper one.
BANDS = [
    (64, None, None),
    (128, 0.45, None),
    (256, 0.40, 0.98),
    (512, 0.36, 0.82),
    (1024, 0.32, 0.75),
    (2048, 0.28, 0.70),
    (4096, 0.25, 0.65),
    (8192, 0.22, 0.62),
    (16384, 0.20, 0.60),
    (None, 0.17, 0.58),
]
CHUNK = 4096
LEVEL = 3
FEWEST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5  # words, percent, words

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True

KINDS = {
    **dict.fromkeys(["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"], pa.int64()),
    "ratio": pa.float64(), "n_chunks": pa.int64(), "n_bad_chunks": pa.int64(), "verdict": pa.string(),
}
RESULT = ", ".join(f"{name} {'string' if kind == pa.string() else 'double' if kind == pa.float64() else 'long'}" for name, kind in KINDS.items())


def base_failed(n_words, n_repeat_words):
    """The plain rule, for numbers and for columns."""
    return (n_words < FEWEST_WORDS) | (100 * n_repeat_words > MOST_REPEATED * n_words)


def outside(size, compressed, bands=BANDS):
    """'repetitive' or 'incompressible' if the ratio leaves the band of this size, else None."""
    for below, low, high in bands:
        if below is None or size < below:
            ratio = compressed / size if size else 0.0
            if low is not None and ratio < low:
                return "repetitive"
            if high is not None and ratio > high:
                return "incompressible"
            return None
    return None


def repeated_words(ids, window=WINDOW):
    """How many positions of the word numbers ``ids`` lie in a window that occurs at least twice. Windows are compared by
    exact ranks, each one word longer than the one before."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    base = np.uint64(ids.max() + 1)
    words = ids.astype(np.uint64)
    rank = words
    for k in range(1, window):
        # below 2^32 ranks and 2^32 words, so that a pair fits
        _, rank = np.unique(rank[:-1] * base + words[k:], return_inverse=True)
        rank = rank.astype(np.uint64)
    often = np.bincount(rank.astype(np.int64))[rank.astype(np.int64)] > 1
    hit = np.zeros(len(ids), bool)
    for k in range(window):
        hit[k : k + n] |= often
    return int(hit.sum())


def counts(data):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of UTF-8 bytes."""
    raw = np.frombuffer(data, np.uint8)
    numbers = {}
    ids = np.fromiter((numbers.setdefault(m.group(), len(numbers)) for m in _WORD.finditer(data)), np.uint32)
    starts = (raw & 0xC0) != 0x80  # first bytes of characters
    seen, again = set(), 0
    for line in data.split(b"\n"):
        if _WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(ids), int((starts & ~_BLANK[raw]).sum()), int(_SYMBOL[raw].sum()), again, repeated_words(ids)


def judged(data, pack, chunk=CHUNK, bands=BANDS):
    """(ratio, n_chunks, n_bad_chunks, verdict) of UTF-8 bytes; ``pack`` gives the compressed bytes."""
    if not data:
        return None, 0, 0, None
    whole = len(pack(data))
    pieces = [data[at : at + chunk] for at in range(0, len(data), chunk)]
    found = [outside(len(p), whole if len(pieces) == 1 else len(pack(p)), bands) for p in pieces]
    verdict = outside(len(data), whole, bands)
    bad = [f for f in found if f]
    if verdict is None and 2 * sum(len(p) for p, f in zip(pieces, found) if f) > len(data):
        verdict = max(sorted(set(bad)), key=bad.count)
    return whole / len(data), len(pieces), len(bad), verdict


def _rows(chunk, bands, level):
    def run(batches):
        pack = zstandard.ZstdCompressor(level=level).compress
        for batch in batches:
            out = []
            for data in batch.column("text").cast(pa.binary()):
                data = data.as_py() or b""
                out.append((*counts(data), *judged(data, pack, chunk, bands)))
            columns = list(zip(*out)) if out else [()] * len(KINDS)
            arrays = [pa.array(c, k) for c, k in zip(columns, KINDS.values())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], ["id", *KINDS])

    return run


def quality_rules(docs, id_col="doc_id", text_col="text", chunk=CHUNK, bands=BANDS, level=LEVEL):
    """One row per document: id, the counts, ratio, n_chunks, n_bad_chunks, verdict (why compression rejects the text, else
    null), base_failed and kept."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    found = source.mapInArrow(_rows(chunk, list(bands), level), f"id {id_type}, {RESULT}")
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & F.col("verdict").isNull())


def keep_good(docs, text_col="text", chunk=CHUNK, bands=BANDS, level=LEVEL):
    """The documents that pass, with their own columns whatever their names; rows stay where they are."""
    packed = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"))

    def run(batches):
        pack = zstandard.ZstdCompressor(level=level).compress
        for batch in batches:
            texts = [data.as_py() or b"" for data in batch.column("row").field(text_col).cast(pa.binary())]
            stay = [not base_failed(*counts(data)[::4]) and judged(data, pack, chunk, bands)[3] is None for data in texts]
            yield batch.filter(pa.array(stay, pa.bool_()))

    return packed.mapInArrow(run, packed.schema).select("row.*")
