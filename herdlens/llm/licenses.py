"""License scans by template markup.

A template is license wording with <<beginOptional>> ... <<endOptional>> around wording that may be left out (they
nest) and <<var;...;match="...">> for wording that may be replaced. `match` is `.+` (one word or more, without bound),
`.{m,n}` (m to n words) or `(a|b|c)` (one of the words). Words are runs of letters and digits, A-Z lower-cased, as in
texts.

A template becomes an automaton over words: one position for each word it can take, skips over what is optional, and
for `.+` a position that can follow itself. A set of positions is one integer, so a step is a look-up of the word's
positions, a shift and the skips. Spans of a text that an automaton accepts hold all mandatory wording exactly and in
order. Once a span is accepted, unbounded regions that are open take no more words, so one license doesn't run on into
the next; optional wording after it may still make the span longer.

Texts are searched as 64-bit hashes of their words; what is found is then confirmed on the words themselves.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textarrays import ALNUM, blocks, text_buffers, words

# The phrases of the contract, and notices and texts of public licenses.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = {
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;name="holders";original="THE AUTHORS OR COPYRIGHT HOLDERS";match=".+">> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "mit-notice": '<<var;name="verb";original="Released";match="(released|licensed|distributed|available|published)">> under <<beginOptional>>the terms of<<endOptional>> the MIT license',
    "apache-2.0": 'Licensed under <<beginOptional>>the terms of<<endOptional>> the Apache License, Version 2.0 <<beginOptional>>(the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 <<beginOptional>>Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.<<endOptional>><<endOptional>>',
    "gpl-notice": 'Licensed under the <<beginOptional>>terms of the<<endOptional>> <<beginOptional>>GNU<<endOptional>> <<beginOptional>>Lesser<<endOptional>> General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>><<beginOptional>>either<<endOptional>> version <<var;name="version";original="3";match="(1|2|3)">> <<beginOptional>>or <<beginOptional>>(at your option) any<<endOptional>> later <<beginOptional>>version<<endOptional>><<endOptional>><<endOptional>>',
    "cc-by-nc": 'Licensed under <<beginOptional>>the terms of<<endOptional>> <<beginOptional>>the<<endOptional>> CC BY-NC <<beginOptional>><<var;name="major";original="4";match="(1|2|3|4)">>.<<var;name="minor";original="0";match="(0|5)">><<endOptional>>',
    "bsd": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. <<beginOptional>><<beginOptional>>3.<<endOptional>> Neither the name of <<var;name="organization";original="the copyright holder";match=".+">> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.<<endOptional>> THIS SOFTWARE IS PROVIDED BY <<var;name="providers";original="THE COPYRIGHT HOLDERS AND CONTRIBUTORS";match=".+">> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;name="holders";original="THE COPYRIGHT HOLDER OR CONTRIBUTORS";match=".+">> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "isc": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name="author";original="THE AUTHOR";match=".+">> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;name="author";original="THE AUTHOR";match=".+">> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "zlib": 'This software is provided \'as-is\', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: <<beginOptional>>1.<<endOptional>> The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. <<beginOptional>>2.<<endOptional>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. <<beginOptional>>3.<<endOptional>> This notice may not be removed or altered from any source distribution.',
    "unlicense": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.',
    "mpl-2.0": 'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at <<var;name="scheme";original="http";match="(http|https)">>://mozilla.org/MPL/2.0/.',
    "copyright-notice": 'Copyright <<beginOptional>>(c)<<endOptional>> <<var;name="years and holder";original="2024 The Authors";match=".{1,60}">> all rights reserved',
}

_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MARKUP = re.compile(r"<<(.*?)>>", re.S)


def text_words(text: str) -> list[str]:
    return _WORDS.findall(text.translate({i: i + 32 for i in range(65, 91)}))


def word_hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(words(raw, np.array([0, len(raw)]), ALNUM)[0][0])


class Automaton:
    """positions: for each, the words it takes (None: any). skips: (from, to) without a word, from before to. again:
    positions that may follow themselves."""

    def __init__(self, template: str):
        self.positions: list[frozenset[str] | None] = []
        self.skips: list[tuple[int, int]] = []
        self.again: list[int] = []
        opened, at = [], 0
        for m in [*_MARKUP.finditer(template), None]:
            self.positions += [frozenset([w]) for w in text_words(template[at : m.start() if m else len(template)])]
            if not m:
                break
            at, tag = m.end(), m[1].strip()
            if tag == "beginOptional":
                opened.append(len(self.positions))
            elif tag == "endOptional":
                if not opened:
                    raise ValueError("endOptional without beginOptional")
                self.skips.append((opened.pop(), len(self.positions)))
            elif tag.startswith("var;") and (match := re.search(r'match="(.*?)"', tag)):
                self._free(match[1])
            else:
                raise ValueError(f"unknown markup: {tag}")
        if opened:
            raise ValueError("beginOptional without endOptional")
        self.end = len(self.positions)
        self._compile()

    def _free(self, match: str) -> None:
        if match == ".+":  # the first word, then any number of others
            self.positions += [None, None]
            at = len(self.positions) - 1
            self.again.append(at)
            self.skips.append((at, at + 1))
        elif m := re.fullmatch(r"\.\{(\d+),(\d+)\}", match):
            least, most = int(m[1]), int(m[2])
            self.positions += [None] * most
            self.skips += [(i, i + 1) for i in range(len(self.positions) - (most - least), len(self.positions))]
        elif re.fullmatch(r"\([^()|.*+]+(\|[^()|.*+]+)*\)", match) and all(len(text_words(w)) == 1 for w in match[1:-1].split("|")):
            self.positions.append(frozenset(text_words(w)[0] for w in match[1:-1].split("|")))
        else:
            raise ValueError(f"match not supported: {match}")

    def _compile(self) -> None:
        self.skips.sort()
        self.takes, self.any = {}, 0  # positions by word, and by its hash
        for i, accepted in enumerate(self.positions):
            if accepted is None:
                self.any |= 1 << i
            for word in accepted or ():
                for key in (word, word_hash(word)):
                    self.takes[key] = self.takes.get(key, 0) | 1 << i
        self.skip_bits = [(1 << a, 1 << b) for a, b in self.skips]
        self.skip_from = sum({a for a, _ in self.skip_bits})
        self.loops = sum(1 << i for i in self.again)
        self.start = self.closure(1)
        self.accept = 1 << self.end
        if self.start & (self.any | self.accept):
            raise ValueError("a template must begin with given wording")
        self.starts = [h for h, bits in self.takes.items() if bits & self.start and not isinstance(h, str)]

    def closure(self, state: int) -> int:
        if state & self.skip_from:
            for a, b in self.skip_bits:
                if state & a:
                    state |= b
        return state

    def longest(self, words) -> int:
        """Number of words of the longest accepted span at the beginning of words, or of their hashes; 0: there is none."""
        state, found = self.start, 0
        for n, word in enumerate(words, 1):
            taken = state & (self.takes.get(word, 0) | self.any)
            state = self.closure(taken << 1 | taken & self.loops)
            if state & self.accept:
                found = n
                state &= ~self.loops  # an open region takes no more words
            if not state:
                break
        return found


class Scanner:
    """Phrases and automata over the word hashes of many texts at once."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.phrases = [(text_words(p), [np.uint64(word_hash(w)) for w in text_words(p)], label) for p, label in sorted(phrases.items())]
        self.templates = {label: Automaton(t) for label, t in sorted(templates.items())}
        self.starts = np.array(sorted({h for a in self.templates.values() for h in a.starts}), np.uint64)

    def scan(self, hashes: np.ndarray, bounds: np.ndarray):
        """(text, label, whether a template's, first, words) of every place. Words count from the text's start."""
        text_of = lambda at: np.searchsorted(bounds, at, side="right") - 1
        for _, phrase, label in self.phrases:
            at = np.flatnonzero(hashes[: max(0, len(hashes) - len(phrase) + 1)] == phrase[0])
            for j in range(1, len(phrase)):
                at = at[hashes[at + j] == phrase[j]]
            for i, t in zip(at, text_of(at)):
                if i + len(phrase) <= bounds[t + 1]:
                    yield int(t), label, False, int(i - bounds[t]), len(phrase)
        at = np.flatnonzero(np.isin(hashes, self.starts)) if len(self.starts) else []
        for i, t in zip(at, text_of(at) if len(at) else []):
            for label, automaton in self.templates.items():
                if automaton.takes.get(int(hashes[i]), 0) & automaton.start and (n := automaton.longest(_one_by_one(hashes[i : bounds[t + 1]]))):
                    yield int(t), label, True, int(i - bounds[t]), n

    def confirmed(self, words: list[str], label: str, template: bool, first: int, n: int) -> int:
        """How many words the place has by the words themselves; 0 if hashes alone were alike."""
        if template:
            return self.templates[label].longest(words[first:])
        return n if any(words[first : first + n] == phrase for phrase, _, own in self.phrases if own == label) else 0


def _one_by_one(hashes: np.ndarray):
    """Python integers, in growing pieces: most automata stop after a few words."""
    at, step = 0, 64
    while at < len(hashes):
        yield from hashes[at : at + step].tolist()
        at, step = at + step, 8 * step


def _scan(phrases, templates):
    def run(batches):
        scanner = Scanner(phrases, templates)
        span = pa.struct([("label", pa.string()), ("template", pa.bool_()), ("first_word", pa.int64()), ("n_words", pa.int64())])
        for batch in batches:
            texts = batch.column("text")
            data, offsets = text_buffers(texts)
            for a, b in blocks(offsets):
                hashes, bounds = words(data[offsets[a] : offsets[b]], offsets[a : b + 1], ALNUM)
                found, own = [[] for _ in range(b - a)], {}
                for t, label, template, first, n in scanner.scan(hashes, bounds):
                    if t not in own:
                        own[t] = text_words(texts[a + t].as_py())
                    if n := scanner.confirmed(own[t], label, template, first, n):
                        found[t].append({"label": label, "template": template, "first_word": first, "n_words": n})
                for f in found:
                    f.sort(key=lambda s: (s["first_word"], s["template"], s["label"]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(bounds)), pa.array(found, pa.list_(span))], [batch.schema.names[0], "n_words", "spans"])

    return run


SPANS = "array<struct<label: string, template: boolean, first_word: bigint, n_words: bigint>>"


def scan(docs: DataFrame, phrases=None, templates=None, id_column: str = "doc_id") -> DataFrame:
    """id, n_words and spans (label, template or phrase, first word, words) of each text, in one pass without a shuffle.

    Null and empty texts have no words and no spans. Overlapping spans all stay; of one template the longest at each
    start. Spans have no bound but their text's end. Repeated rows get equal results, an empty table none; columns but the id and text play no part.
    """
    kind = dict(docs.dtypes)[id_column]
    run = _scan(PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates)
    return docs.select(id_column, "text").mapInArrow(run, f"`{id_column}` {kind}, n_words bigint, spans {SPANS}")
