"""License scans by a positional index of rare words.

Templates are whole licences and notices as word lists. The index lists for each of their words the templates and places, and
its inverse document frequency, counted over all documents (one pass; only the templates' words are counted, so a fixed number
of counts reaches the driver). In a text, a template can only stand if at most a fifth of its places have words that the text
lacks. Of those that the text has, its words of the greatest inverse document frequency are looked up: six places more than may
still be edited, so six of them at least agree on where the template begins. The postings' relative places are intersected:
each occurrence of a word gives the places where the template would begin; inserted and dropped words move the places behind
them, by no more than as many words as may differ, so places that near are pooled. Where enough of the places agree, the
template is verified word by word at each place and by alignment, and its label needs its key phrase within the words that it
covers. Places and phrases are over whole texts.

Base phrases are counted wherever their words stand consecutively, and give their labels whatever the index says.

Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased.

Defined results: a null or empty text has no words, no labels and score 0. The score is the greatest share of a verified
template's words without the changed, dropped and inserted ones, 0 without one. Without documents no word is rarer than
another, and words are taken in their own order, as ties always are. Repeated rows get a row each; other columns don't matter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.llm.common import slices

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Label, key phrase, public text of a licence or notice.
NOTICES = (
    ("mit", "permission is hereby granted free of charge", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or
sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall
be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("mit", "permission is hereby granted free of charge", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mit", "mit license", "Released under the MIT License"),
    ("apache", "apache license version 2 0", "Licensed under the Apache License, Version 2.0"),
    ("apache", "apache license version 2 0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "apache license version 2 0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of
the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl", "gnu general public license", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "gnu general public license", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("gpl-3", "gnu general public license version 3", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "gnu lesser general public license", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "gnu affero general public license", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "redistribution and use in source and binary forms", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "redistribution and use in source and binary forms", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder
nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT
HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("isc", "permission to use copy modify and or distribute", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("isc", "permission to use copy modify and or distribute", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "altered source versions must be plainly marked", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely,
subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product,
an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("mpl", "mozilla public license", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "creative commons attribution 4 0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "creative commons attribution sharealike", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "cc by nc 4 0", "Licensed under CC BY-NC 4.0"),
    ("cc0", "cc0 1 0 universal", "This work is dedicated to the public domain under CC0 1.0 Universal"),
    ("unlicense", "free and unencumbered software released into the public domain", "This is free and unencumbered software released into the public domain"),
    ("unlicense", "free and unencumbered software released into the public domain", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright
laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to
the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""),
)

KEEP = bytes(range(48, 58)) + bytes(range(97, 123)) + bytes(range(128, 256))
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b in KEEP else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


@dataclass(frozen=True)
class Template:
    label: str
    key: bytes
    words: tuple[bytes, ...]


def templates(notices=NOTICES) -> list[Template]:
    return [Template(label, b" " + b" ".join(words_of(key)) + b" ", tuple(words_of(text))) for label, key, text in notices]


class Index:
    """rare_words: how many of the looked up places agree at least, if a template has so many; share: the share of all the
    template's words that must be left when changed, dropped and inserted words are taken away."""

    def __init__(self, frequency: dict[bytes, int], n_docs: int, notices=NOTICES, phrases=PHRASES, *, rare_words: int = 6, share: float = 0.8):
        self.templates, self.share, self.rare_words = templates(notices), share, rare_words
        self.phrases = [(b" " + b" ".join(words_of(p)) + b" ", label) for p, label in phrases.items()]
        idf = {w: math.log((1 + n_docs) / (1 + frequency.get(w, 0))) for t in self.templates for w in t.words}
        #: Words by their number, the rarest first.
        self.number = {w: k for k, w in enumerate(sorted(idf, key=lambda w: (-idf[w], w)))}
        #: Of each template: its words' numbers, and its places, that of the rarest word first.
        self.words = [np.array([self.number[w] for w in t.words], np.int64) for t in self.templates]
        self.places = [np.lexsort((np.arange(len(w)), w)) for w in self.words]
        self.edits = [math.floor((1 - share) * len(t.words) + 1e-9) for t in self.templates]

    def looked_up(self, k: int, has: np.ndarray) -> tuple[np.ndarray, int]:
        """The template's places that are looked up in a text that has these words, and how many of them agree at least."""
        held = self.places[k][has[self.words[k][self.places[k]]]]
        left = self.edits[k] - (len(self.words[k]) - len(held))  # that may be edited among those
        if left < 0:
            return held[:0], 1
        some = held[: left + self.rare_words]
        return some, max(1, len(some) - left)

    def regions(self, k: int, votes: list[tuple[int, int]], needed: int) -> Iterator[tuple[int, int]]:
        """First and last start of where votes (start, place) of enough different places are near; overlaps are merged."""
        votes.sort()
        e, reach, low, held, found = self.edits[k], len(self.templates[k].words) + 2 * self.edits[k], 0, Counter(), None
        for start, place in votes:
            held[place] += 1
            while votes[low][0] < start - e:
                held[votes[low][1]] -= 1
                if not held[votes[low][1]]:
                    del held[votes[low][1]]
                low += 1
            if len(held) >= needed:
                if found and votes[low][0] <= found[1] + reach:
                    found = found[0], start
                else:
                    if found:
                        yield found
                    found = votes[low][0], start
        if found:
            yield found

    def best(self, k: int, words: list[bytes], numbers: np.ndarray, first: int, last: int) -> int:
        """The most words of the template that are left in a verified place or alignment that begins there, else 0."""
        t, e, own, left = self.templates[k], self.edits[k], self.words[k], 0
        n = len(own)
        covered = lambda a, b: t.key in b" " + b" ".join(words[max(0, a) : max(0, b)]) + b" "
        padded = np.full(last - first + n, -1, np.int64)  # the words from the first start to behind the last place
        low, high = max(0, first), min(len(numbers), last + n)
        padded[low - first : high - first] = numbers[low:high]
        equal = np.zeros(last - first + 1, np.int64)
        for j in range(n):
            equal += padded[j : j + last - first + 1] == own[j]
        for at in np.argsort(-equal, kind="stable"):
            if equal[at] < self.share * n or equal[at] <= left:
                break
            if covered(first + at, first + at + n):
                left = int(equal[at])
        if left == n:
            return n
        begin, end = max(0, first - e), max(0, min(len(numbers), last + n + e))
        # cost and begin of the template's first j words that end here, in one number, so that the least has the least begin
        place, one = np.arange(n + 1, dtype=np.int64), np.int64(1 << 40)
        cost = place * one + begin
        for i in range(begin, end):
            new = np.empty(n + 1, np.int64)
            new[0] = i + 1
            np.minimum(cost[:-1] + (own != numbers[i]) * one, cost[1:] + one, out=new[1:])
            cost = np.minimum.accumulate(new - place * one) + place * one
            edits, begun = divmod(int(cost[n]), int(one))
            if edits <= e and n - edits > left and covered(begun, i + 1):
                left = n - edits
        return left

    def scan(self, text: str | None) -> tuple:
        words = words_of(text)
        line = b" " + b" ".join(words) + b" "
        starts, base = [], set()
        for phrase, label in self.phrases:
            at, word, counted = line.find(phrase), 0, 0
            while at >= 0:
                word, counted = word + line.count(b" ", counted, at), at  # on from the last place
                starts.append(word)
                base.add(label)
                at = line.find(phrase, at + 1)
        labels, score = set(base), 0.0
        may = [k for k, t in enumerate(self.templates) if t.key in line]
        if may:
            numbers = np.array([self.number.get(w, -1) for w in words], np.int64)
            has = np.bincount(numbers + 1, minlength=len(self.number) + 1)[1:] > 0
            order = np.argsort(numbers, kind="stable")
            ends = np.searchsorted(numbers[order], np.arange(len(self.number) + 1))
            for k in may:
                places, needed = self.looked_up(k, has)
                votes = [(int(at) - int(p), int(p)) for p in places for at in order[ends[self.words[k][p]] : ends[self.words[k][p] + 1]]]
                left = max((self.best(k, words, numbers, *region) for region in self.regions(k, votes, needed)), default=0)
                if left:
                    labels.add(self.templates[k].label)
                    score = max(score, left / len(self.words[k]))
        first, last = (min(starts), max(starts)) if starts else (None, None)
        return len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score


RESULT = "struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string,labels:string,score:double>"
RESULT_ARROW = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def document_frequencies(docs: DataFrame, text_col: str, notices=NOTICES) -> tuple[dict[bytes, int], int]:
    """How many documents hold each word of the templates, and how many documents there are."""
    wanted = {w for t in templates(notices) for w in t.words}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for part in slices(batch.column(0)):
                for text in part:
                    found.update(wanted.intersection(words_of(text)))
                found[b""] += len(part)
        yield pa.record_batch([pa.array([w.decode() for w in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word string, n bigint")
    counted = {r[0].encode(): r[1] for r in rows.groupBy("word").agg(F.sum("n")).collect()}  # a row per template word
    return counted, counted.pop(b"", 0)


def build_index(docs: DataFrame, text_col: str = "text", **options) -> Index:
    return Index(*document_frequencies(docs, text_col), **options)


def scan_column(text: Column, index: Index) -> Column:
    """A struct: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    names = [f.name for f in RESULT_ARROW]

    @F.arrow_udf(RESULT)
    def license_scan(texts: pa.Array) -> pa.Array:
        return pa.array([dict(zip(names, index.scan(t), strict=True)) for part in slices(texts) for t in part], RESULT_ARROW)

    return license_scan(text.cast("string"))

