"""License scan: stated phrases, and text blocks that contain a license notice nearly whole.

A block contains a template when it holds at least `percent` of the template's distinct
words. The words are ordered by how many blocks of the whole corpus hold them. A block
with o of a template's m words has one among the template's m - o + 1 rarest (prefix),
holds at least o words of the templates (length), and has enough of them from its first
match on (position); only what passes is compared in full.
"""

from __future__ import annotations

from math import ceil, log2
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import counts
from lexmill.llm import textscan as ts

# The phrases of the base scan and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# Customary notices of public licenses, by paragraph: a block of a text is a paragraph too.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("mit", "Released under the terms of the MIT license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/"),
    ("gpl", "Distributed under the GNU GPL version 3 or later"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License"),
    ("lgpl", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc0", "The author has waived all copyright and related rights to this work and dedicated it to the public domain CC0 1.0 Universal"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)

#: Words of all templates are counted in a vector of this size.
VOCABULARY = 1_024
CODES, SEPARATORS = ts.byte_codes(lower=True), ts.separators(white_space_only=False)


def _words(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    return ts.scan_words(data, np.array([0, len(data)]), CODES, SEPARATORS).hashes


def block_step(n_words: int) -> int:
    """Half the length of the blocks that a template of so many words is looked for in: a power of two with room for a quarter more words."""
    return max(16, 1 << ceil(log2(max(1.0, 1.25 * n_words))))


class Templates(NamedTuple):
    """Template words by number: their hashes (sorted), and each template's label, word numbers and block step."""

    hashes: np.ndarray
    labels: list[str]
    sets: list[np.ndarray]
    steps: list[int]


def templates(of=TEMPLATES) -> Templates:
    words = [_words(text) for _, text in of]
    sets = [np.unique(w) for w in words]
    hashes = np.unique(np.concatenate(sets))
    if len(hashes) > VOCABULARY:
        raise ValueError(f"templates of more than {VOCABULARY} distinct words")
    return Templates(hashes, [label for label, _ in of], [np.searchsorted(hashes, s) for s in sets], [block_step(len(w)) for w in words])


def _template_words(words: ts.Words, data: np.ndarray, known: Templates):
    """(text, paragraph, place in it, word number) of every template word; a paragraph ends at a blank line or with its text."""
    number = np.searchsorted(known.hashes, words.hashes)
    hit = np.flatnonzero(known.hashes[np.minimum(number, len(known.hashes) - 1)] == words.hashes)
    doc = words.doc()
    line = np.searchsorted(np.flatnonzero(data == 10), words.start)
    new = np.ones(len(doc), dtype=np.int64)
    new[1:] = (np.diff(line) > 1) | (np.diff(doc) > 0)
    paragraph = np.cumsum(new)
    place = np.arange(len(doc)) - np.flatnonzero(new)[paragraph - 1] if len(doc) else paragraph
    return doc[hit], paragraph[hit], place[hit], number[hit]


def _blocks(paragraph: np.ndarray, place: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, index of the word) for every block a word lies in: runs of 2 * step words of a paragraph, one every step words.

    Whatever is no longer than step words lies in one of them whole.
    """
    window = place // step
    one = (paragraph << 32) + window
    before = np.flatnonzero(window > 0)
    return np.concatenate([one, one[before] - 1]), np.concatenate([np.arange(len(one)), before])


def _count_paragraphs(known: Templates):
    def run(batches):
        sums = np.zeros(VOCABULARY, dtype=np.int64)
        for batch in batches:
            for _, _, data, at in ts.chunks(batch.column(0)):
                _, paragraph, _, number = _template_words(ts.scan_words(data, at, CODES, SEPARATORS), data, known)
                sums += np.bincount(np.unique(paragraph * VOCABULARY + number) % VOCABULARY, minlength=VOCABULARY)
        yield counts.rows(sums)

    return run


class _Index(NamedTuple):
    """Templates over word ranks (0: rarest), and for each block step and rank the templates that have it in their prefix."""

    rank: np.ndarray
    sets: list[np.ndarray]
    required: list[int]
    postings: dict[int, dict[int, list[tuple[int, int]]]]


def prefix_index(known: Templates, frequency: np.ndarray, percent: int) -> _Index:
    order = np.argsort(frequency[: len(known.hashes)], kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    sets = [np.sort(rank[s]) for s in known.sets]
    required = [ceil(percent * len(s) / 100 - 1e-9) for s in sets]
    postings: dict[int, dict[int, list[tuple[int, int]]]] = {step: {} for step in sorted(set(known.steps))}
    for t, (s, o) in enumerate(zip(sets, required, strict=True)):
        for pos, r in enumerate(s[: len(s) - o + 1].tolist()):
            postings[known.steps[t]].setdefault(r, []).append((t, pos))
    return _Index(rank, sets, required, postings)


def contained(ranks: np.ndarray, index: _Index, step: int) -> dict[int, float]:
    """Templates of this step that a block holds, by the sorted ranks of its template words, with the share of their words."""
    tried: dict[int, bool] = {}
    for at, r in enumerate(ranks.tolist()):
        for t, pos in index.postings[step].get(r, ()):
            o, m = index.required[t], len(index.sets[t])
            if t not in tried:  # the first match of both, so nothing before it counts
                tried[t] = len(ranks) >= o and min(m - pos, len(ranks) - at) >= o
    found = {}
    for t, possible in tried.items():
        if possible:
            shared = len(np.intersect1d(ranks, index.sets[t], assume_unique=True))
            if shared >= index.required[t]:
                found[t] = shared / len(index.sets[t])
    return found


def phrase_places(words: ts.Words, phrases=PHRASES) -> list[tuple[np.ndarray, str]]:
    """For each phrase the indices of the words where it starts, inside one text, and its label."""
    out, h = [], words.hashes
    last = np.repeat(words.first[1:], np.diff(words.first))
    for phrase, label in phrases:
        own = _words(phrase)
        start = np.flatnonzero(h == own[0])
        start = start[start + len(own) <= last[start]]
        for k in range(1, len(own)):
            start = start[h[start + k] == own[k]]
        out.append((start, label))
    return out


def scan(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", of=TEMPLATES) -> DataFrame:
    """License phrases and contained license notices of every whole text.

    Returns doc_id, n_words, n_base (places of all phrases), first_word and last_word (the
    smallest and largest start, null without one), base_labels, labels (with those of the
    contained templates; both sorted and comma-joined) and score (1 with a phrase, else
    the largest contained share of a template, else 0). Null and empty texts have no words
    and empty labels, repeated rows repeat, a null id stays null, an empty table gives an
    empty result, further columns are ignored. Words are told apart by 64-bit hashes. A
    template is looked for in blocks of up to four times its length, so that a long
    paragraph does not hold it by chance.
    """
    known = templates(of)
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    frequency = counts.total(texts.mapInArrow(_count_paragraphs(known), counts.SCHEMA), VOCABULARY)
    index = prefix_index(known, frequency, percent)

    def run(batches):
        for batch in batches:
            for row, end, data, at in ts.chunks(batch.column(1)):
                n = end - row
                words = ts.scan_words(data, at, CODES, SEPARATORS)
                n_base, first, last = np.zeros(n, dtype=np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                base: list[set[str]] = [set() for _ in range(n)]
                more: list[set[str]] = [set() for _ in range(n)]
                score = np.zeros(n)
                doc = words.doc()
                for start, label in phrase_places(words):
                    own, word = doc[start], start - words.first[doc[start]]
                    n_base += np.bincount(own, minlength=n)
                    np.minimum.at(first, own, word)
                    np.maximum.at(last, own, word)
                    for k in np.unique(own):
                        base[k].add(label)
                        score[k] = 1.0
                owner, paragraph, place, number = _template_words(words, data, known)
                for step, postings in index.postings.items():
                    block, word = _blocks(paragraph, place, step)
                    order = np.lexsort((index.rank[number[word]], block))
                    block, ranks, word = block[order], index.rank[number[word]][order], word[order]
                    new = np.ones(len(block), dtype=bool)
                    new[1:] = (np.diff(block) != 0) | (np.diff(ranks) != 0)
                    block, ranks, word = block[new], ranks[new], word[new]
                    for b in np.unique(block[np.isin(ranks, list(postings))]):
                        lo, hi = np.searchsorted(block, (b, b + 1))
                        for t, share in contained(ranks[lo:hi], index, step).items():
                            k = owner[word[lo]]
                            more[k].add(known.labels[t])
                            score[k] = max(score[k], share)
                none = n_base == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, n),
                        pa.array(np.diff(words.first)),
                        pa.array(n_base),
                        pa.array(first, mask=none),
                        pa.array(last, mask=none),
                        pa.array([",".join(sorted(x)) for x in base]),
                        pa.array([",".join(sorted(x | y)) for x, y in zip(base, more, strict=True)]),
                        pa.array(score),
                    ],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    columns = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, columns)
