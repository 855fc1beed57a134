"""License scans by template-markup matching.

A template is license wording with markup: ``<<optional>> ... <<end>>`` may be left out, ``<<any 1 12>>`` stands for that
many words of any kind; everything else is mandatory. Templates are compiled into automata over words (lower-cased A-Z,
runs of letters, digits and characters beyond ASCII). A text is accepted where a run of its words leads an automaton to
its end: the mandatory wording is there exactly, in order. From each start the longest accepted run counts. Base phrases
are templates without markup, of which every place counts.

Cases: null and empty texts have no words and no places; overlapping places all count; repeated rows get the same result
each; an empty table gives an empty result; other columns are ignored.
"""

import re

import pyarrow as pa
from pyspark.sql import functions as F

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_MARK = re.compile(r"<<\s*(optional|end|any\s+\d+\s+\d+)\s*>>")

# Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# License wording shared by templates.
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of <<any 1 12>> to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
_ISC = "Permission to use, copy, modify, <<optional>>and<<end>> <<optional>>or<<end>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_2 = (
    _BSD + " <<optional>>1<<end>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    " <<optional>>2<<end>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer"
    " in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = " Neither the name of <<any 1 16>> nor the names of <<any 1 6>> may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY <<any 1 16>> AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL <<any 1 16>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"
)

# Public license notices and whole licenses with markup. The opening of a license is a notice of its own.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("cc-by-4.0", "Licensed under <<optional>>a<<end>> <<optional>>the<<end>> CC BY 4.0 <<optional>>International<<end>> <<optional>>license<<end>>"),
    ("cc-by-4.0", "Creative Commons Attribution 4.0 International <<optional>>Public<<end>> License"),
    ("cc-by-nc-4.0", "Licensed under <<optional>>a<<end>> <<optional>>the<<end>> CC BY-NC 4.0 <<optional>>International<<end>> <<optional>>license<<end>>"),
    ("cc-by-nc-4.0", "Creative Commons Attribution-NonCommercial 4.0 International <<optional>>Public<<end>> License"),
    ("cc-by-sa-4.0", "Licensed under <<optional>>a<<end>> <<optional>>the<<end>> CC BY-SA 4.0 <<optional>>International<<end>> <<optional>>license<<end>>"),
    ("gpl-2.0", "licensed under the <<optional>>terms of the<<end>> GNU General Public License <<optional>>as published by the Free Software Foundation<<end>> <<optional>>either<<end>> version 2 <<optional>>of the License<<end>> <<optional>>or (at your option) any later version<<end>>"),
    ("gpl-3.0", "licensed under the <<optional>>terms of the<<end>> GNU General Public License <<optional>>as published by the Free Software Foundation<<end>> <<optional>>either<<end>> version 3 <<optional>>of the License<<end>> <<optional>>or (at your option) any later version<<end>>"),
    ("mit", "<<optional>>Released<<end>> under the MIT License"),
    ("mit-notice", _MIT),
    ("mit", _MIT + " The above copyright notice and this permission notice <<optional>>(including the next paragraph)<<end>> shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<any 1 16>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"),
    ("isc-notice", _ISC),
    ("isc", _ISC + " THE SOFTWARE IS PROVIDED AS IS AND <<any 1 16>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<any 1 16>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE"),
    ("bsd-notice", _BSD),
    ("bsd-2-clause", _BSD_2 + _BSD_END),
    ("bsd-3-clause", _BSD_2 + "<<optional>>3<<end>>" + _BSD_NAMES + _BSD_END),
    ("bsd-4-clause", _BSD_2 + "<<optional>>3<<end>> All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by <<any 1 20>> <<optional>>4<<end>>" + _BSD_NAMES + _BSD_END),
]


def text_words(text):
    """Words as UTF-8; ``bytes.lower`` touches A-Z alone."""
    return _WORD.findall((text or "").encode().lower())


class Automaton:
    """The union of templates: states with moves by word, by any word, and for free."""

    def __init__(self, templates):
        self.by_word, self.by_any, self.free, self.ends = [], [], [], {}
        start = self._state()
        for label, text in templates:
            at = self._state()
            self.free[start].append(at)
            self._compile(label, text, at)
        self._start = self._closed({start})
        self.first = frozenset(w for s in self._start for w in self.by_word[s])
        self.open_start = any(self.by_any[s] for s in self._start)
        self._known = {}

    def _state(self):
        self.by_word.append({})
        self.by_any.append([])
        self.free.append([])
        return len(self.free) - 1

    def _compile(self, label, text, at):
        begin, pieces, opened = at, _MARK.split(text), []
        for i, piece in enumerate(pieces):
            if i % 2 == 0:
                for word in text_words(piece):
                    nxt = self._state()
                    self.by_word[at].setdefault(word, []).append(nxt)
                    at = nxt
            elif piece == "optional":
                opened.append(at)
            elif piece == "end":
                nxt = self._state()
                self.free[at].append(nxt)
                self.free[opened.pop()].append(nxt)
                at = nxt
            else:
                least, most = map(int, piece.split()[1:])
                tail = []
                for n in range(most):
                    if n >= least:
                        tail.append(at)
                    nxt = self._state()
                    self.by_any[at].append(nxt)
                    at = nxt
                for s in tail:
                    self.free[s].append(at)
        if opened:
            raise ValueError(f"unclosed region: {text}")
        if at in self._closed({begin}):
            raise ValueError(f"no wording: {text}")
        self.ends[at] = label

    def _closed(self, states):
        seen, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def _move(self, states, word):
        key = (states, word if any(word in self.by_word[s] for s in states) else None)
        if key not in self._known:
            nxt = {t for s in states for t in self.by_any[s]}
            if key[1] is not None:
                nxt |= {t for s in states for t in self.by_word[s].get(word, ())}
            closed = self._closed(nxt)
            self._known[key] = closed, tuple(sorted({self.ends[s] for s in closed if s in self.ends}))
        return self._known[key]

    def places(self, words):
        """(label, first word, last word) of the longest accepted run of each label from each start."""
        if not self.open_start and self.first.isdisjoint(words):
            return []
        out = []
        for i, word in enumerate(words):
            if not self.open_start and word not in self.first:
                continue
            states, found = self._start, {}
            for j in range(i, len(words)):
                states, labels = self._move(states, words[j])
                for label in labels:
                    found[label] = j
                if not states:
                    break
            out += [(label, i, j) for label, j in sorted(found.items())]
        return out


def _scan(phrases, templates):
    kind = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))

    def run(batches):
        base, full = Automaton([(label, text) for text, label in phrases.items()]), Automaton(templates)
        for batch in batches:
            n_words, at_base, at_full = [], [], []
            for text in batch.column("text").to_pylist():
                words = text_words(text)
                n_words.append(len(words))
                for out, found in ((at_base, base.places(words)), (at_full, full.places(words))):
                    out.append([{"label": l, "first": i, "last": j} for l, i, j in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n_words, pa.int64()), pa.array(at_base, kind), pa.array(at_full, kind)],
                ["id", "n_words", "base", "matches"],
            )

    return run


def scan(docs, phrases=None, templates=None, id_col="doc_id", text_col="text"):
    """One row per document: id, n_words, base and matches (arrays of label, first, last: word positions from 0)."""
    place = "array<struct<label: string, first: bigint, last: bigint>>"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(
        _scan(PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates),
        f"id {docs.schema[id_col].dataType.simpleString()}, n_words bigint, base {place}, matches {place}",
    )
