"""Licence scan: text similarity to templates, then inheritance along directories.

The whole text, and all windows of consecutive lines up to a length, are compared with
templates of headers and licence texts by the cosine of sparse TF-IDF vectors, so headers
are found however they are wrapped and whatever the text goes on with. Two exact bounds
spare most of the work: a cosine is at most the length of the part of a template whose terms
the text has, so texts that have too little of every template are done after one look at
their terms; and terms whose weights are together below the least cosine can't make a match
alone, so only windows with a line that has one of a template's other terms are compared.

Whole licence texts tell licences apart that begin alike, and outrank headers; licences that
come closer than a margin are named together. A file that is mostly licence text, or is
named like one, is the licence file of its directory; files without a licence of their own
take that of the nearest directory above them, found by an equi-join of their directories'
ancestors with those that have licence files.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Passages that licence texts share.
MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
BSD_OPENING = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
BSD_TWO = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_THIRD = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_REST = ", provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
#: Licences, the opening words of their texts and notices, and whole texts.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("BSD-2-Clause OR BSD-3-Clause", BSD_OPENING),
    ("BSD-2-Clause", f"{BSD_OPENING}: {BSD_TWO} {BSD_DISCLAIMER}"),
    ("BSD-3-Clause", f"{BSD_OPENING}: {BSD_TWO} {BSD_THIRD} {BSD_DISCLAIMER}"),
    ("MIT", f"{MIT_GRANT} {AS_IS}"),
    ("ISC", ISC_GRANT + ISC_REST),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("ISC", ISC_GRANT),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0 Creative Commons Attribution International"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("CC0-1.0", "CC0 1.0 Universal public domain dedication"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)
#: Parameters: least cosine with a template, and with one of few words; words up to which these are few; least cosine of a whole text that makes it a licence file.
LEAST, SHORT_LEAST, SHORT_WORDS, FILE_LEAST = 0.6, 0.8, 12, 0.6
#: Parameters: words from which a template is a whole text, the cosine from which it outranks headers, and the cosine by which the best must be ahead of other licences.
WHOLE_WORDS, WHOLE_LEAST, MARGIN = 80, 0.85, 0.005
#: Parameter: a window has at most so many times the words of the longest template, or is a single line.
SPAN = 2
#: Words of any text, which are no terms.
COMMON = frozenset("the of to and or in is a for this that be by with on any not are as it from at an you may use all other but no its above".split())
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz")
LICENCE_NAME = "(?i)^(licen[sc]e|copying|unlicense)([._-].*)?$"
WORD = re.compile(r"[a-z]+|\d+(?:\.\d+)*")


def terms(text: str) -> list[str]:
    """The terms of a lower-cased text, in order."""
    return [w for w in WORD.findall(text) if w not in COMMON]


class Matcher:
    """Templates as unit TF-IDF vectors with an inverted list for each term."""

    def __init__(self, templates: Sequence[tuple[str, str]] = TEMPLATES) -> None:
        self.names = [n for n, _ in templates]
        counts = [Counter(terms(t.lower())) for _, t in templates]
        sizes = [sum(c.values()) for c in counts]
        df = Counter(w for c in counts for w in c)
        self.idf = {w: math.log((1 + len(counts)) / (1 + n)) + 1 for w, n in df.items()}
        self.unknown = math.log(1 + len(counts)) + 1  # weight of a term that no template has
        self.span = SPAN * max(sizes, default=0)
        self.least = [SHORT_LEAST if n < SHORT_WORDS else LEAST for n in sizes]
        self.whole = [n >= WHOLE_WORDS for n in sizes]
        self.terms: dict[str, list[tuple[int, float]]] = {}
        self._finder = self._given = None  # of ``hinted``
        self.telling: set[str] = set()  # every window that matches a template has one of these
        for i, c in enumerate(counts):
            norm = math.sqrt(sum((n * self.idf[w]) ** 2 for w, n in c.items()))
            weights = {w: n * self.idf[w] / norm for w, n in c.items()}
            rest = 0.0
            for w in sorted(weights, key=lambda w: (weights[w], w)):
                rest += weights[w] ** 2
                if rest >= self.least[i] ** 2 - 1e-9:
                    self.telling.add(w)
            for w, v in weights.items():
                self.terms.setdefault(w, []).append((i, v))

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_finder": None, "_given": None}

    def hinted(self, text: str) -> bool:
        """False if no window of a lower-cased text can match, told without its words: a term can only be there where its letters are and none beside them; terms of one sign are taken to be."""
        if self._finder is None:
            self._finder = ahocorasick.Automaton()
            self._given = [0.0] * len(self.names)
            for w, templates in self.terms.items():
                if len(w) == 1:
                    for i, v in templates:
                        self._given[i] += v * v
                else:
                    self._finder.add_word(w, w)
            self._finder.make_automaton()
        held, seen = self._given[:], set()
        for end, w in self._finder.iter(text):
            if w not in seen and not (text[end + 1 : end + 2] in LETTERS and w[-1] in LETTERS) and not (text[end - len(w) : end - len(w) + 1] in LETTERS and w[0] in LETTERS):
                seen.add(w)
        for w in seen:
            for i, v in self.terms[w]:
                held[i] += v * v
        return any(h >= least * least - 1e-9 for h, least in zip(held, self.least, strict=True))

    def possible(self, words: set[str]) -> bool:
        """False if no window of a text of these words can match: too little of every template is there."""
        held = [0.0] * len(self.names)
        for w in words & self.terms.keys():
            for i, v in self.terms[w]:
                held[i] += v * v
        return any(h >= least * least - 1e-9 for h, least in zip(held, self.least, strict=True))

    def cosines(self, words: Sequence[str]) -> list[float]:
        """The cosine with each template."""
        dots, square = [0.0] * len(self.names), 0.0
        for w, n in Counter(words).items():
            value = n * self.idf.get(w, self.unknown)
            square += value * value
            for i, v in self.terms.get(w, ()):
                dots[i] += value * v
        return [d / math.sqrt(square) for d in dots] if square else dots

    def match(self, text: str) -> tuple[float, str | None]:
        """Largest cosine of a whole text and its licence (ties: the earlier template)."""
        found = self.cosines(terms(text.lower()))
        best = max(range(len(found)), key=lambda i: (found[i], -i), default=-1)
        return (found[best], self.names[best]) if found and found[best] else (0.0, None)

    def windows(self, words: list[list[str]]) -> list[float]:
        """The best cosine with each template over all windows of lines (``words`` of each) that can match one."""
        best = [0.0] * len(self.names)
        counts, dots = {}, {}
        sizes = [len(w) for w in words]
        least = min(self.least)

        def line(k: int) -> Counter:
            if k not in counts:
                counts[k] = Counter(words[k])
                dots[k] = [(i, n * self.idf[w] * v) for w, n in counts[k].items() for i, v in self.terms.get(w, ())]
            return counts[k]

        after = -1  # starts up to here are done
        for g in (k for k, w in enumerate(words) if not self.telling.isdisjoint(w)):
            start, total = g, sizes[g]
            while start > after + 1 and total + sizes[start - 1] <= self.span:
                start -= 1
                total += sizes[start]
            for first in range(max(start, after + 1), g + 1):
                held: dict[str, int] = {}
                sums, square, total = [0.0] * len(self.names), 0.0, 0
                for k in range(first, len(words)):
                    total += sizes[k]
                    if k > first and total > self.span:
                        break
                    if not sizes[k]:
                        continue
                    for w, n in line(k).items():
                        before = held.get(w, 0)
                        held[w] = before + n
                        square += self.idf.get(w, self.unknown) ** 2 * n * (n + 2 * before)
                    for i, v in dots[k]:
                        sums[i] += v
                    if k >= g and max(sums) >= least * math.sqrt(square) - 1e-9:
                        length = math.sqrt(square)
                        best = [max(b, v / length) for b, v in zip(best, sums, strict=True)]
            after = g
        return best

    def decide(self, found: Sequence[float]) -> tuple[float, str | None]:
        """Cosine and licence from the best cosine with each template: whole texts before headers, licences within the margin together."""
        fine = [(self.whole[i] and c >= WHOLE_LEAST, c, i) for i, c in enumerate(found) if c >= self.least[i] - 1e-9]
        if not fine:
            return 0.0, None
        rank, score, _ = max(fine, key=lambda f: (f[0], f[1], -f[2]))
        names = {n for r, c, i in fine if r == rank and c > score - MARGIN for n in self.names[i].split(" OR ")}
        single = {self.names[i] for r, c, i in fine if r == rank and c > score - MARGIN and " OR " not in self.names[i]}
        return score, " OR ".join(sorted(single or names))

    def scan(self, text: str | None) -> tuple[float, str | None, float]:
        """Cosine and licence of a text by itself and by its windows, and the largest cosine of the whole text alone."""
        if not text or not self.hinted(text := text.lower()):
            return 0.0, None, 0.0
        lines = [terms(x) for x in text.split("\n")]
        if not self.possible(set().union(*lines)):
            return 0.0, None, 0.0
        whole = self.cosines([w for x in lines for w in x])
        return *self.decide([max(a, b) for a, b in zip(whole, self.windows(lines), strict=True)]), max(whole)


def parent(path: Column) -> Column:
    """Directory of a path: what is before the last '/', or '' at the top."""
    return F.when(F.locate("/", path) > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def scan(files: DataFrame, path: Column, passed: Sequence[str] = ("doc_id",), matcher: Matcher | None = None) -> DataFrame:
    """The licence of every row of ``files`` (text, and what ``path`` reads).

    Adds path, own_licence, own_score, licence, origin ('own', 'inherited' or null) and
    from_directory, in place of columns so called. Null and empty texts have no licence of their own; a null path has no
    directory and inherits nothing; of several licence files in a directory the best match
    counts (ties: the name); repeated rows each get a row; an empty table gives an empty
    one; other columns are ignored.
    """
    held = files.sparkSession.sparkContext.broadcast(matcher or Matcher())
    passed = [c for c in passed if c not in ("path", "own_licence", "own_score", "licence", "origin", "from_directory", "whole", "directory")]
    chosen = files.select(*passed, path.alias("path"), "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [held.value.scan(t) for t in frame.pop("text")]
            yield frame.assign(own_licence=[n for _, n, _ in found], own_score=[s for s, _, _ in found], whole=[w for _, _, w in found])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "text")
    own = materialize(chosen.mapInPandas(run, f"{schema}, own_licence string, own_score double, whole double").withColumn("directory", parent(F.col("path"))))  # texts are scanned once
    is_file = F.col("own_licence").isNotNull() & ((F.col("whole") >= FILE_LEAST) | F.regexp_extract("path", "[^/]*$", 0).rlike(LICENCE_NAME))
    holders = own.where(is_file & F.col("directory").isNotNull()).groupBy(F.col("directory").alias("holder")).agg(F.max_by("own_licence", F.struct("own_score", "own_licence")).alias("inherited"))
    directories = own.where(F.col("own_licence").isNull() & F.col("directory").isNotNull()).select("directory").distinct()
    steps = F.split("directory", "/")
    above = directories.select("directory", F.explode(F.sequence(F.lit(0), F.size(steps))).alias("depth"))
    above = above.withColumn("holder", F.when(F.col("depth") == 0, "").otherwise(F.array_join(F.slice(F.split("directory", "/"), 1, F.greatest("depth", F.lit(1))), "/")))
    nearest = above.join(holders, "holder").groupBy("directory").agg(F.max_by(F.struct("inherited", "holder"), "depth").alias("up")).select(F.col("directory").alias("of"), "up")
    out = own.join(nearest, (F.col("directory") == F.col("of")) & F.col("own_licence").isNull(), "left")
    return out.select(
        *passed, "path", "own_licence", "own_score",
        F.coalesce("own_licence", "up.inherited").alias("licence"),
        F.when(F.col("own_licence").isNotNull(), "own").when(F.col("up").isNotNull(), "inherited").alias("origin"),
        F.col("up.holder").alias("from_directory"),
    )
