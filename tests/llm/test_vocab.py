"""Pre-token encoding equals the libraries' encoding of whole texts; wavelet matrices give their ids back."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from barwise.llm import vocab, wavelet

PARTS = [
    "the", "Then", " ", "  ", "    ", "\n", "\n\n", "\r\n", "\t", ".", ",", "!!", "é", "ß", "日本", "😀", "▁", "▁▁", "1234", "x'll",
    "<s>", "</s>", "<0x0A>", " ", " ", "\x00", "\x1c", "a" * 50, "'s", "-", "$$$", "﻿",
]
SPECIAL = ["<|endoftext|>", "<|startoftext|>"]


def texts(n, seed, extra=()):
    draw = random.Random(seed)
    parts = PARTS + list(extra)
    fixed = ["", " ", "  ", "\n", "▁", "a ", " a", "a  b", "\n a", "a \n", "a\n\nb ", *SPECIAL]
    return fixed + ["".join(draw.choices(parts, k=draw.randint(1, 25))) for _ in range(n)]


def test_pieces_of_whole_texts():
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    v, library = vocab.load(path), SentencePieceProcessor(model_file=path)
    assert v.cuts
    for t in texts(2000, 1, SPECIAL):
        got = [i for part in (v.ids(v.pretokens(t)) if t else []) for i in part]
        assert got == library.encode(t), repr(t)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens_of_whole_texts(name):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    library, all_texts = Tokenizer.from_file(path), texts(2000, 2) + texts(200, 3, SPECIAL)
    cache = vocab.Cache(path, most=300)
    for at in range(0, len(all_texts), 50):
        some = all_texts[at : at + 50]
        flat, counts = cache.encode(pa.array(some))
        ends = np.cumsum(counts)
        for t, a, b in zip(some, ends - counts, ends):
            assert flat[a:b].tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
    assert [x.tolist() for x in cache.encode(pa.array([None, ""]))] == [[], [0, 0]]


def test_new_pretokens_are_looked_up_once(monkeypatch):
    """A new pre-token costs one lookup, and the first ones of texts go to the library together."""
    class Rows(dict):
        n = 0

        def get(self, *a):
            Rows.n += 1
            return super().get(*a)

    cache, calls = vocab.Cache(public_tokenizers.path("byte_bpe_50k.json")), []
    cache.rows, encode = Rows(), cache.vocab._encode
    monkeypatch.setattr(cache.vocab, "_encode", lambda some: calls.append(len(some)) or encode(some))
    some = [f"head{i} one{i} two{i}" for i in range(100)]
    for kind in (pa.string(), pa.large_string()):
        flat, counts = cache.encode(pa.array(some, kind))
        assert flat.tolist() == [i for e in encode(some) for i in e] and counts.sum() == len(flat)
        assert Rows.n <= 100 + 300  # heads, distinct parts
        Rows.n = 0
    assert len(calls) == 2


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_beside_marks(name):
    """Words between marks and line feeds, with the apostrophe, digits and letters of other scripts that forbid a cut."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    library, cache, draw = Tokenizer.from_file(path), vocab.Cache(path), random.Random(5)
    parts = ["word", "Straße", "señor", "it's", "x'll", "'s", "don't", "a1", "日本", "ª", "²", "Ω", "×", *".,!-_&$'^=|@~", "...", "###", "\n", "\n\n", "\t", "\r", " ", "\x85"]
    some = [" ".join("".join(draw.choices(parts, k=draw.randint(1, 5))) for _ in range(draw.randint(1, 30))) for _ in range(1000)]
    for kind in (pa.string(), pa.large_string()):
        flat, counts = cache.encode(pa.array(some, kind))
        ends = np.cumsum(counts)
        for t, a, b in zip(some, ends - counts, ends):
            assert flat[a:b].tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_words_go_to_the_library_once(monkeypatch):
    """A word is encoded once, whatever marks and line feeds it has behind it or in front."""
    cache, sent = vocab.Cache(public_tokenizers.path("byte_bpe_50k.json")), []
    encode = cache.vocab._encode
    monkeypatch.setattr(cache.vocab, "_encode", lambda some: sent.extend(some) or encode(some))
    some = ["so word word. word, word### word!\nword a.b.c"]
    flat, counts = cache.encode(pa.array(some))
    assert flat.tolist() == encode(some)[0].tolist() and counts.tolist() == [len(flat)]
    assert "".join(sent).count("word") == 2  # behind a space, and behind the line feed


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_wavelet_matrix(n):
    ids = np.random.default_rng(n).integers(0, 300, n).astype("<u2")
    lengths = [n] if n else []
    number, matrix, docs, sizes = wavelet.parse(wavelet.dump(7, ids, 9, [None][: len(lengths)], lengths) + b"\n")
    assert (number, docs, list(sizes)) == (7, [None][: len(lengths)], lengths)
    assert matrix.decode().tolist() == ids.tolist()
    for i in range(0, n, 7):
        assert matrix.access(i) == ids[i]
        assert matrix.count(int(ids[i])) == (ids == ids[i]).sum()
        assert matrix.count(int(ids[i]), i, n) == (ids[i:] == ids[i]).sum()
        places = np.flatnonzero(ids == ids[i])
        assert matrix.occurrence(int(ids[i]), len(places) - 1) == places[-1]
    assert matrix.count(511) == 0 and matrix.count(1 << 12) == 0
    with pytest.raises(IndexError):
        matrix.occurrence(511, 0)
