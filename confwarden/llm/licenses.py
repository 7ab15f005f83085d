"""License scans: a generalised suffix automaton of license texts gives matching statistics."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from confwarden.llm import words as w

# Phrases that count wherever their words stand, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Widely used notices and short licences, as their publishers word them.
_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
    LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
_REDISTRIBUTION = """Redistribution and use in source and binary forms, with or without modification, are permitted
    provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright
    notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
    above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
    materials provided with the distribution."""
_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
    WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
    PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
    INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
    GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
    LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
    OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TEMPLATES = {
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this
        file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License.""",
    "bsd-2-clause": f"{_REDISTRIBUTION} {_DISCLAIMER}",
    "bsd-3-clause": f"""{_REDISTRIBUTION} 3. Neither the name of the copyright holder nor the names of its contributors
        may be used to endorse or promote products derived from this software without specific prior written
        permission. {_DISCLAIMER}""",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the
        GNU General Public License as published by the Free Software Foundation, either version 3 of the
        License, or (at your option) any later version. This program is distributed in the hope that it will be
        useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
        PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of
        the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/. This work is
        licensed under the GNU General Public License, version 3.""",
    "isc": """ISC License. Permission to use, copy, modify, and/or distribute this software for any purpose with or
        without fee is hereby granted, provided that the above copyright notice and this permission notice appear in
        all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
        SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    "mit": f"""Released under the MIT License. Permission is hereby granted, free of charge, to any person
        obtaining a copy of this software and associated documentation files (the "Software"), to deal in the
        Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
        furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
        shall be included in all copies or substantial portions of the Software. {_WARRANTY} IN NO EVENT SHALL THE
        AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
        CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a
        copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
}

# Words by which a short passage names its licence.
NAMES = ("apache", "bsd", "commons", "gnu", "gpl", "isc", "mit", "mozilla", "mpl")


def license_words(text):
    return text.translate(w.ALNUM).split()


class Automaton:
    """Suffix automaton of several word sequences.

    ``ended[state]``: places (template, end) at which the state's longest string ends as a
    prefix of what was added; the places of all its strings are those of the states that link
    to it, directly or not.
    """

    def __init__(self, sequences):
        self.next, self.link, self.length, self.ended = [{}], [-1], [0], [[]]
        for template, words in sequences:
            last = 0
            for end, word in enumerate(words, 1):
                last = self._extend(last, word)
                self.ended[last].append((template, end))
        self.above = [[] for _ in self.link]
        for state, link in enumerate(self.link):
            if link >= 0:
                self.above[link].append(state)
        self.known = {}

    def places(self, state):
        """All places (template, end) where the state's strings end, sorted; worked out once."""
        have = self.known.get(state)
        if have is None:
            found, todo = [], [state]
            while todo:
                at = todo.pop()
                found += self.ended[at]
                todo += self.above[at]
            have = self.known[state] = sorted(found)
        return have

    def _state(self, length, following, link):
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.ended.append([])
        return len(self.next) - 1

    def _split(self, p, q, word):
        """A copy of ``q`` for the strings that go on from ``p``."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last, word):
        q = self.next[last].get(word)
        if q is not None:  # an earlier sequence has this string
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p != -1 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        return new

    def matches(self, words, start, end, least):
        """Longest matches of at least ``least`` words in ``words[start:end]``.

        Follows the matching statistic (the longest string ending at each word that occurs in
        a template) and gives ``(first word, length, places)`` where it stops growing; a place
        is a template and the number of its first matching word.
        """
        state = length = 0
        for i in range(start, end + 1):
            word = words[i] if i < end else None
            if length >= least and word not in self.next[state]:
                yield i - length, length, [(t, e - length) for t, e in self.places(state)]
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1


def chain(matches, gap):
    """Matches of one template in order, with short gaps on both sides, as covered spans.

    Of the places where a match stands in a template the one that goes on from an open span is
    taken, the nearest first; else the first.  Gives ``(template, first word, end word,
    template words covered, words that no other template has)``.
    """
    open_spans, done = {}, []
    for start, length, places in matches:
        by_template = {}
        for template, place in places:
            by_template.setdefault(template, []).append(place)
        own = length if len(by_template) == 1 else 0
        for template, mine in by_template.items():
            have = open_spans.get(template)
            if have and 0 <= start - have[1] <= gap:
                near = [p for p in mine if 0 <= p - have[2] <= gap]
                if near:
                    covered, alone = have[3] + length, have[4] + own
                    open_spans[template] = (have[0], start + length, min(near) + length, covered, alone)
                    continue
            if have:
                done.append((template, have))
            open_spans[template] = (start, start + length, mine[0] + length, length, own)
    return [(t, s[0], s[1], s[3], s[4]) for t, s in [*done, *open_spans.items()]]


def chosen(spans, words, sizes, full, long):
    """The spans that label a document.

    A span needs ``full`` covered words and words that no other template has; with less than
    ``long`` covered words it also has to name a licence, as everyday phrases of licences do not.
    Of spans over the same words the ones that cover most of them stay; templates that share all
    of these are told apart by nothing, and the one of which the largest share is covered stays.
    """
    kept = []
    for t, a, b, n, alone in sorted(spans, key=lambda s: (-s[3], -s[3] / sizes[s[0]], s[0], s[1])):
        if n < full or any(a < y and x < b for _, x, y, _ in kept):
            continue
        if n < long and not (alone and any(x in _NAMED for x in words[a:b])):
            continue
        kept.append((t, a, b, n))
    return sorted((t, a, b, round(min(1.0, n / sizes[t]), 4)) for t, a, b, n in kept)


_NAMED = {x.encode() for x in NAMES}


def _compiled(templates):
    texts = {k: license_words(v.encode()) for k, v in templates.items()}
    return Automaton(sorted(texts.items())), {k: len(v) for k, v in texts.items()}


def _runs(known, least):
    """Runs of at least ``least`` words of which every one occurs in a template."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], known, [0]))))
    return [(int(a), int(b)) for a, b in edges.reshape(-1, 2) if b - a >= least]


def scan(words, automaton, sizes, least, full, long, gap):
    """Places of phrases ``[(start, label)]`` and spans ``[(label, start, end, covered share)]``."""
    lead = {}
    for phrase, label in PHRASES.items():
        parts = phrase.encode().split()
        lead.setdefault(parts[0], []).append((parts, label))
    present = set(words)
    places = []
    if not present.isdisjoint(lead):
        for i, word in enumerate(words):
            places += [(i, l) for parts, l in lead.get(word, ()) if words[i : i + len(parts)] == parts]
    vocabulary = automaton.next[0].keys()
    spans = []
    if not present.isdisjoint(vocabulary):
        known = np.fromiter(map(vocabulary.__contains__, words), np.int8, len(words))
        found = [m for a, b in _runs(known, least) for m in automaton.matches(words, a, b, least)]
        spans = chosen(chain(found, gap), words, sizes, full, long)
    return places, spans


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
    "labels string, score double, spans array<struct<label:string,start:long,end:long,covered:double>>"
)


def _scan_all(templates, least, full, long, gap):
    def run(batches):
        automaton, sizes = _compiled(templates)
        for batch in w.slices(batches, 1):
            rows = []
            for text in w.texts(batch.column(1)):
                words = license_words(text)
                places, spans = scan(words, automaton, sizes, least, full, long, gap)
                base = {label for _, label in places}
                rows.append(
                    {
                        "n_words": len(words),
                        "n_base": len(places),
                        "first_word": min((i for i, _ in places), default=None),
                        "last_word": max((i for i, _ in places), default=None),
                        "base_labels": ",".join(sorted(base)),
                        "labels": ",".join(sorted(base | {s[0] for s in spans})),
                        "score": max([s[3] for s in spans], default=0.5 if places else 0.0),
                        "spans": [dict(zip(("label", "start", "end", "covered"), s, strict=True)) for s in spans],
                    }
                )
            types = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64()}
            types |= {"base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}
            span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())])
            types["spans"] = pa.list_(span)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in types.items())],
                ["doc_id", *types],
            )

    return run


def license_scan(docs, templates=None, least=4, full=5, long=12, gap=3, id_col="doc_id", text_col="text"):
    """Phrases and covered spans of license texts in every whole text.

    Words are runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased.
    A document is streamed through one suffix automaton of all ``templates`` (label to text, by
    default ``TEMPLATES``; they go to every task); matches of ``least`` words or more are chained
    while both sides skip no more than ``gap`` words.  See ``chosen`` for the chains that label
    their span.  ``score`` is the largest share of a template that a span covers, 0.5 if there
    are phrases only, else 0.  Only runs of words that occur in a template are followed,
    which loses nothing.  Null and empty texts: no words, no labels, null places.  Ties between
    templates go to the larger covered share, then to the earlier name.  One row per row of
    ``docs``, so rows that repeat are labelled alike.
    """
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(
        _scan_all(templates or TEMPLATES, least, full, long, gap), SCHEMA
    )
