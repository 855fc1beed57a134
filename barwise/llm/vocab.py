"""Pre-tokens of public tokenizer files: parts of a text that the library encodes alike alone and in place.

A pre-token is a string whose first character names its kind. ``pretokens`` cuts a text, ``ids`` encodes pre-tokens with
the file's own library. Where a file's rules allow no cut, a text is one pre-token.
"""

import operator
import os
import re
from itertools import chain, groupby, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WHOLE = "="  # a whole text
TOGETHER = 500  # pre-tokens encoded as one text
#: white space characters, and each beside a space
_BESIDE = [(c, " " + c, c + " ") for c in map(chr, range(0x3001)) if c.isspace()]
_spaced = operator.methodcaller("startswith", " ")
_open, _caches = {}, {}


def _after(mark, strings):
    """Each of an Arrow array's strings with a mark in front."""
    return pc.binary_join_element_wise(pa.scalar("", strings.type), strings, pa.scalar(mark, strings.type))


class Pieces:
    """A sentencepiece model. No piece holds a space after another character, or a line feed, so a text can be cut before
    each run of spaces and before each line feed."""

    words = None

    _cut = re.compile(r" +[^ \n]*|\n[^ \n]*")

    def __init__(self, path):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        self.processor = SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        spec, pieces = model.normalizer_spec, [p.piece for p in model.pieces if p.type in (1, 4)]
        self.cuts = (
            spec.name == "identity" and spec.add_dummy_prefix and not spec.remove_extra_whitespaces
            and not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
            and not any(p.type == 4 for p in model.pieces)
        )
        self.size = len(model.pieces)

    def splits(self, text):
        """Whether the text is cut at its spaces and nowhere else."""
        return False

    def flat_ids(self, pretokens):
        ids = self.ids(pretokens)
        return np.fromiter(chain.from_iterable(ids), np.int64), np.array([len(i) for i in ids], np.int64)

    def pretokens(self, text):
        if not text:
            return []
        if not self.cuts:
            return [WHOLE + text]
        return self._cut.findall(" " + text.replace("▁", " "))

    def ids(self, pretokens):
        # The library puts a space before every input. That is the first one of a pre-token with spaces; one with a line
        # feed gets a lone space in front, which is taken off again. A lone space it would not see at all.
        texts = [p if p[0] == "\n" else "\n" if p == " " else p[1:] for p in pretokens]
        out = self.processor.encode(texts, num_threads=1)
        return [i[1:] if p[0] == "\n" else i[:1] if p == " " else i for p, i in zip(pretokens, out)]


class Tokens:
    """A tokenizers file. With the byte-level pre-tokenizer a text can be cut before each space that stands between two
    characters that are not white space. A text with the string of an added token is left whole.

    In its rule a token of letters ends before any other character, one of punctuation without an apostrophe before a letter
    or a line feed, and a lone line feed between characters that are not white space is a token. ``words`` matches pre-tokens
    made of these alone; its groups, all but the first as ``^``, are pre-tokens whose ids in a row are those of the whole."""

    _letters, _marks = "A-Za-zÀ-ÖØ-öø-ɏ", r"!-&(-/:-@\[-`{-~"
    words = rf"\A(?P<a>[ ^][{_letters}]+)(?P<b>[{_marks}]*\n?)(?P<c>[{_letters}]*)(?P<d>[{_marks}]*)\z"

    def __init__(self, path):
        import json

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share the cores already
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.cuts = (
            pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and not spec.get("normalizer")
        )
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.size = self.tokenizer.get_vocab_size()
        self._bytes = None
        self._cut = re.compile(r"(?<=\S) (?=\S)")

    def splits(self, text):
        """Whether the text is cut at its spaces and nowhere else."""
        return bool(text) and self.cuts and not any(t in text for t in self.special) and self._lone(text)

    def pretokens(self, text):
        if not text:
            return []
        if not self.cuts or any(t in text for t in self.special):
            return [WHOLE + text]
        parts = text.split(" ") if self._lone(text) else self._cut.split(text)
        # all parts but the first follow a space
        return ["^" + parts[0], *map(" ".__add__, parts[1:])]

    def _lone(self, text):
        """Whether every space stands between two characters that are not white space."""
        if text[0] == " " or text[-1] == " ":
            return False
        for c, after, before in _BESIDE:
            if c in text and (after in text or before in text):
                return False
        return True

    def ids(self, pretokens):
        flat, lengths = self.flat_ids(pretokens)
        ends = np.cumsum(lengths).tolist()
        flat = flat.tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def flat_ids(self, pretokens):
        """Ids of pre-tokens in a row, and the number of ids of each. Those that begin with a space are encoded many at a
        time as one text, and told apart by the bytes of its tokens: cheaper for the library than as many short texts."""
        ids, lengths = [], []
        for spaced, run in groupby(pretokens, _spaced):
            run = list(run)
            for at in range(0, len(run), TOGETHER):
                some = run[at : at + TOGETHER]
                if spaced:
                    self._together(some, ids, lengths)
                else:
                    self._apart([p[1:] for p in some], ids, lengths)
        if not ids:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(ids), np.concatenate(lengths)

    def _encode(self, texts):
        return [np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _apart(self, texts, ids, lengths):
        each = self._encode(texts)
        ids += each
        lengths.append(np.array([len(i) for i in each], np.int64))

    def _together(self, parts, ids, lengths):
        if self._bytes is None:
            self._bytes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.size)], np.int64)
        (found,) = self._encode(["".join(parts)])
        ends = np.cumsum(self._bytes[found])
        wanted = np.cumsum(np.fromiter(map(len, map(str.encode, parts)), np.int64, len(parts)))
        at = np.searchsorted(ends, wanted)
        if at[-1] < len(ends) and (ends[at] == wanted).all():
            ids.append(found)
            lengths.append(np.diff(at, prepend=-1))
        else:
            self._apart(parts, ids, lengths)


def load(path):
    """The tokenizer of a file, opened once in each process."""
    if path not in _open:
        _open[path] = Pieces(path) if path.endswith(".model") else Tokens(path)
    return _open[path]


class Cache:
    """Ids of texts by way of their pre-tokens, each of which is encoded once. It holds ``most`` pre-tokens and starts
    anew beyond; results don't depend on it."""

    def __init__(self, path, most=1_000_000):
        self.vocab, self.most = load(path), most
        self.dtype = np.dtype("<u2" if self.vocab.size <= 1 << 16 else "<u4")
        self._clear()

    def _clear(self):
        self.rows, self.used = {}, 0  # pre-token: row; ids in use
        self.flat, self.begin, self.length = np.zeros(1 << 16, self.dtype), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _learn(self, pretokens):
        """Encode new pre-tokens and append them as rows."""
        for at in range(0, len(pretokens), 50_000):
            some = pretokens[at : at + 50_000]
            ids, lengths = self.vocab.flat_ids(some)
            n, row = self.used + len(ids), len(self.rows)
            if n > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(max(n, len(self.flat)), self.dtype)])
            if row + len(some) > len(self.begin):
                more = np.zeros(max(row + len(some), len(self.begin)), np.int64)
                self.begin, self.length = np.concatenate([self.begin, more]), np.concatenate([self.length, more])
            self.flat[self.used : n] = ids
            self.length[row : row + len(some)] = lengths
            self.begin[row : row + len(some)] = self.used + np.cumsum(lengths) - lengths
            self.rows.update(zip(some, range(row, row + len(some))))
            self.used = n

    def _lookup(self, pretokens):
        found = np.fromiter(map(self.rows.get, pretokens, repeat(-1)), np.int64, len(pretokens))
        unknown = np.flatnonzero(found < 0)
        if len(unknown):
            missing, row = [pretokens[i] for i in unknown.tolist()], len(self.rows)
            new = sorted(dict.fromkeys(missing), key=_spaced, reverse=True)  # those that begin with a space go to the library together
            self._learn(new)
            # New pre-tokens are appended, so those that are missing once and in order need no second look.
            once = new == missing
            found[unknown] = np.arange(row, row + len(new)) if once else np.fromiter(map(self.rows.get, missing), np.int64, len(missing))
        return found

    def _encoded(self, pretokens, single):
        """The ids of each pre-token as an Arrow array of bytes. All but the ``single`` ones are cut into words, which recur
        more than what stands between two spaces."""
        cut, groups = np.zeros(len(pretokens), bool), []
        if self.vocab.words:
            found = pc.extract_regex(pretokens.filter(pa.array(~single)), self.vocab.words)
            cut[~single] = found.is_valid().to_numpy(zero_copy_only=False)
            groups = found.drop_null().flatten()
        columns = [(0, np.flatnonzero(~cut), pretokens.filter(pa.array(~cut)))]
        for k, group in enumerate(groups):
            kept = pc.not_equal(group, "")
            words = group if k == 0 else _after("^", group.filter(kept))
            columns.append((k, np.flatnonzero(cut)[kept.to_numpy(zero_copy_only=False)], words))
        coded = pa.concat_arrays([words for *_, words in columns]).dictionary_encode()
        codes, numbers, at = coded.indices.to_numpy(), np.full((len(pretokens), 4), -1), 0
        for k, places, words in columns:
            numbers[places, k] = codes[at : at + len(words)]
            at += len(words)
        used = numbers >= 0
        row = self._lookup(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[numbers[used]]
        lengths = self.length[row]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        flat = self.flat[np.repeat(self.begin[row] - ends[:-1], lengths) + np.arange(ends[-1])]
        offsets = ends[np.concatenate([[0], np.cumsum(used.sum(1))])] * self.dtype.itemsize
        return pa.Array.from_buffers(pa.large_binary(), len(pretokens), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])

    def encode(self, texts):
        """(ids of all texts in a row, number of ids of each text) for an Arrow array of strings; null counts as empty."""
        texts = texts.fill_null("")
        if len(self.rows) > self.most:
            self._clear()
        strings = texts.to_pylist()
        plain = np.array([self.vocab.splits(t) for t in strings], bool)
        pretokens, single, places, n = [], np.zeros(0, bool), [None] * len(strings), 0
        if plain.any():
            # Arrow splits and numbers the distinct parts; only these are looked up one by one.
            parts = pc.split_pattern(texts.filter(pa.array(plain)), " ")
            coded, edges = parts.flatten().dictionary_encode(), parts.offsets.to_numpy() - parts.offsets[0].as_py()
            single = pc.utf8_is_alpha(coded.dictionary).to_numpy(zero_copy_only=False)
            place, firsts = coded.indices.to_numpy().copy(), edges[:-1]
            pretokens = [_after(" ", coded.dictionary), _after("^", coded.dictionary.take(pa.array(place[firsts])))]
            place[firsts] = np.arange(len(single), len(single) + len(firsts))
            n = len(single) + len(firsts)
            for i, a, b in zip(np.flatnonzero(plain).tolist(), edges[:-1].tolist(), edges[1:].tolist()):
                places[i] = place[a:b]
        numbers = {}  # of the other texts' pre-tokens
        for i in np.flatnonzero(~plain).tolist():
            some = self.vocab.pretokens(strings[i])
            places[i] = np.array([numbers.setdefault(p, n + len(numbers)) for p in some], np.int64)
        pretokens = pa.concat_arrays([*pretokens, pa.array(list(numbers), texts.type)])
        single = np.pad(single, (0, len(pretokens) - len(single)))
        edges = np.cumsum([0] + [len(p) for p in places])
        if not edges[-1]:
            return np.zeros(0, self.dtype), np.zeros(len(strings), np.int64)
        taken = self._encoded(pretokens, single).take(pa.array(np.concatenate(places)))
        _, offsets, data = taken.buffers()
        ends = np.frombuffer(offsets, np.int64, len(taken) + 1) // self.dtype.itemsize
        return np.frombuffer(data, self.dtype, ends[-1]), np.diff(ends[edges])


def cache(path):
    """The cache of a file, shared by the tasks that a process runs."""
    if path not in _caches:
        _caches[path] = Cache(path)
    return _caches[path]
