"""License scans by template-markup matching.

A template is wording with optional regions `{? ... ?}` and replaceable regions `{* name max *}` (up to max words of any
kind). It is compiled into an automaton over words and accepts a place where all mandatory wording stands word by word, so a
license that lacks its disclaimer is not accepted.
All starts of a text are followed in one pass; a text goes to a template's automaton only if it has the template's longest
mandatory run of words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import slices, texts

#: Phrases and their labels. Fixed values.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Wording of public licenses, whole, of the notices by which longer licenses ask to be named, whole ("-notice"), and of
#: sentences that name a license ("-mention"). Fixed values.
TEMPLATES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
        is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
        {? (including the next paragraph) ?} shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND {? NON ?} {? NONINFRINGEMENT ?} {? INFRINGEMENT ?}. IN NO EVENT SHALL
        {* holder 20 *} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "mit-0": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
        is furnished to do so.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
        {* holder 20 *} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and {? / or ?} distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND {* author 12 *} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {* author 12 *} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
        NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0bsd": """Permission to use, copy, modify, and {? / or ?} distribute this software for any purpose with or without fee is hereby granted.
        THE SOFTWARE IS PROVIDED "AS IS" AND {* author 12 *} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {* author 12 *} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
        NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: {? 1. ?} Redistributions of source code must retain the above copyright notice, this list of conditions and
        the following disclaimer. {? 2. ?} Redistributions in binary form must reproduce the above copyright notice, this list of
        conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY {* holder 20 *} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {* holder 20 *} BE
        LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
        PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
        THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF
        THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: {? 1. ?} Redistributions of source code must retain the above copyright notice, this list of conditions and
        the following disclaimer. {? 2. ?} Redistributions in binary form must reproduce the above copyright notice, this list of
        conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        {? 3. ?} Neither the name of {* holder 20 *} nor the names of {* their 4 *} contributors may be used to endorse or promote products
        derived from this software without specific prior written permission.
        THIS SOFTWARE IS PROVIDED BY {* holder 20 *} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {* holder 20 *} BE
        LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
        PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
        THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF
        THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
        damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
        commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: {? 1. ?} The origin of
        this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a
        product, an acknowledgment in the product documentation would be appreciated but is not required. {? 2. ?} Altered source versions
        must be plainly marked as such, and must not be misrepresented as being the original software. {? 3. ?} This notice may not be
        removed or altered from any source distribution.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
        sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate
        any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at
        large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in
        perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
        WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
        PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
        ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
        SOFTWARE.""",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use {* work 6 *} except in compliance with the
        License. You may obtain a copy of the License at {* place 12 *} Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
        implied. See the License for the specific language governing permissions and limitations under the License.""",
    "gpl-2.0-notice": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation; {? either ?} version 2 of the License {? , or (at your option) any later version ?}. This
        program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "gpl-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, {? either ?} version 3 of the License {? , or (at your option) any later version ?}. This
        program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "lgpl-notice": """is free software you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
        published by the Free Software Foundation {? either ?} version {* number 4 *} of the License {? , or (at your option) any later
        version ?}. {* name 4 *} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty
        of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "agpl-3.0-notice": """is free software you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as
        published by the Free Software Foundation, {? either ?} version 3 of the License {? , or (at your option) any later version ?}.
        {* name 4 *} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
    "mpl-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
        with this file, You can obtain one at {* place 8 *} MPL/2.0""",
    "mit-mention": "{? released ?} under the {? terms of the ?} MIT license",
    "apache-2.0-mention": "licensed under the Apache License, version 2.0",
    "gpl-2.0-mention": "GNU General Public License, {? {* publisher 10 *} ?} version 2 {? of the License ?} {? or {* option 4 *} any later version ?}",
    "gpl-3.0-mention": "GNU General Public License, {? {* publisher 10 *} ?} version 3 {? of the License ?} {? or {* option 4 *} any later version ?}",
    "lgpl-mention": "GNU Lesser General Public License {? {* publisher 10 *} ?} {? version 2.1 ?} {? version 3 ?}",
    "agpl-3.0-mention": "GNU Affero General Public License {? {* publisher 10 *} ?} version 3",
    "mpl-2.0-mention": "subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by-4.0": "{? licensed ?} under {? a ?} {? the ?} CC BY 4.0",
    "cc-by-nc-4.0": "{? licensed ?} under {? a ?} {? the ?} CC BY-NC 4.0",
    "cc-by-nc-nd-4.0": "{? licensed ?} under {? a ?} {? the ?} CC BY-NC-ND 4.0",
    "cc-by-nc-sa-4.0": "{? licensed ?} under {? a ?} {? the ?} CC BY-NC-SA 4.0",
    "cc-by-nd-4.0": "{? licensed ?} under {? a ?} {? the ?} CC BY-ND 4.0",
    "cc-by-sa-4.0": "{? licensed ?} under {? a ?} {? the ?} CC BY-SA 4.0",
    "cc-attribution": "under {? a ?} {? the ?} Creative Commons Attribution {? NonCommercial ?} {? NoDerivatives ?} {? ShareAlike ?} {? {* version 3 *} International ?} License",
    "cc0": "{? released ?} under {? the ?} CC0 {? 1.0 ?} {? universal ?}",
    "all-rights-reserved": "all rights reserved",
    "spdx": "SPDX-License-Identifier: {* id 6 *}",
}
#: Endings of the labels of what names a license without its wording.
MENTIONS = ("-mention", "spdx", "all-rights-reserved")

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Every phrase and every mandatory run holds one of these.
_MARKS = re.compile(rb"licen|permi|cc by|all rights|redistri|gnu |creative commons|cc0|free |warrant")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


@dataclass(frozen=True)
class Automaton:
    """States 0 to n; step[s] is a word, or None for any word; skip[s] are the states reached from s without a word."""

    step: tuple[bytes | None, ...]
    skip: tuple[tuple[int, ...], ...]
    anchor: bytes

    @property
    def end(self) -> int:
        return len(self.step)

    def closure(self, state: int) -> set[int]:
        seen, todo = {state}, [state]
        while todo:
            for t in self.skip[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen

    def spans(self, words: list[bytes]) -> list[tuple[int, int]]:
        """Places (first word, end) that the automaton accepts, the longest one from each start, without overlaps."""
        first = self.closure(0)
        opening = {self.step[s] for s in first if s < self.end}
        active: dict[int, int] = {}
        found: dict[int, int] = {}
        for i, w in enumerate(words):
            if w in opening:
                for s in first:
                    active.setdefault(s, i)
            if not active:
                continue
            moved: dict[int, int] = {}
            for s, start in active.items():
                if s < self.end and (self.step[s] is None or self.step[s] == w):
                    for t in self.closure(s + 1):
                        moved[t] = min(start, moved.get(t, start))
            if self.end in moved:
                found[moved[self.end]] = i + 1
            active = {s: start for s, start in moved.items() if s < self.end}
        out: list[tuple[int, int]] = []
        for start, end in sorted(found.items()):
            if not out or start >= out[-1][1]:
                out.append((start, end))
        return out


def compile_template(markup: str) -> Automaton:
    """The automaton of a template. Optional regions may nest; a template needs at least one mandatory word."""
    step: list[bytes | None] = []
    skip: list[set[int]] = [set()]
    opened: list[int] = []
    runs: list[list[bytes]] = [[]]
    for part in re.findall(r"\{\*\s*\w+\s+\d+\s*\*\}|\{\?|\?\}|[^{}?]+|[{}?]", markup):
        if part == "{?":
            opened.append(len(step))
            runs.append([])
        elif part == "?}":
            skip[opened.pop()].add(len(step))
            runs.append([])
        elif part.startswith("{*"):
            most, at = int(part.split()[-2]), len(step)
            step += [None] * most
            skip += [set() for _ in range(most)]
            for k in range(most):
                skip[at + k].add(at + most)
            runs.append([])
        else:
            for w in words_of(part.encode()):
                step.append(w)
                skip.append(set())
                if not opened:
                    runs[-1].append(w)
    if opened or not any(runs):
        raise ValueError("optional regions must be closed, and some wording must be mandatory")
    return Automaton(tuple(step), tuple(tuple(sorted(x)) for x in skip), b" ".join(max(runs, key=lambda r: sum(map(len, r)))))


@cache
def _compiled() -> tuple[tuple[str, Automaton], ...]:
    return tuple((name, compile_template(markup)) for name, markup in TEMPLATES.items())


@dataclass(frozen=True)
class Scan:
    n_words: int
    starts: tuple[int, ...]
    base: tuple[str, ...]
    spans: tuple[tuple[str, int, int], ...]

    @property
    def labels(self) -> list[str]:
        return sorted({*self.base, *(name for name, _, _ in self.spans)})

    @property
    def score(self) -> float:
        """1 if whole wording or a whole notice is accepted, 0.75 for a sentence that names a license, 0.5 for a phrase alone, else 0."""
        if any(not name.endswith(MENTIONS) for name, _, _ in self.spans):
            return 1.0
        return 0.75 if self.spans else 0.5 if self.starts else 0.0


def scan(text: bytes) -> Scan:
    """All phrase places and all accepted template places of a text."""
    words = words_of(text)
    joined = b" ".join(words)
    if not _MARKS.search(joined):
        return Scan(len(words), (), (), ())
    padded = b" " + joined + b" "
    starts, base = [], []
    for phrase, label in PHRASES:
        want = phrase.encode().split()
        if b" " + phrase.encode() + b" " not in padded:
            continue
        places = [i for i in range(len(words) - len(want) + 1) if words[i] == want[0] and words[i : i + len(want)] == want]
        starts += places
        base.append(label)
    spans = [(name, a, b) for name, automaton in _compiled() if b" " + automaton.anchor + b" " in padded for a, b in automaton.spans(words)]
    return Scan(len(words), tuple(sorted(starts)), tuple(sorted(base)), tuple(spans))


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<name: string, first: long, stop: long>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans = pa.list_(pa.struct([("name", pa.string()), ("first", pa.int64()), ("stop", pa.int64())]))
    for batch in slices(batches):
        found = [scan(t) for t in texts(batch.column("_text"))]
        columns = {
            "n_words": pa.array([s.n_words for s in found], pa.int64()),
            "n_base": pa.array([len(s.starts) for s in found], pa.int64()),
            "first_word": pa.array([min(s.starts, default=None) for s in found], pa.int64()),
            "last_word": pa.array([max(s.starts, default=None) for s in found], pa.int64()),
            "base_labels": pa.array([",".join(s.base) for s in found], pa.string()),
            "labels": pa.array([",".join(s.labels) for s in found], pa.string()),
            "score": pa.array([s.score for s in found], pa.float64()),
            "spans": pa.array([[{"name": n, "first": a, "stop": b} for n, a, b in s.spans] for s in found], spans),
        }
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns.values()], ["doc_id", *columns])


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (accepted places).

    Null texts count as empty: no words, no labels, score 0, as an empty table has no rows. Very long texts are read whole, in one
    pass for each template whose longest mandatory run they have. Ids may be null or repeated; other columns are not read.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text")).mapInArrow(_scan, SCHEMA)


def pattern(markup: str) -> str:
    """The template as a regular expression over words, each followed by one space: what SQL can compare with."""
    out = []
    for part in re.findall(r"\{\*\s*\w+\s+\d+\s*\*\}|\{\?|\?\}|[^{}?]+|[{}?]", markup):
        if part == "{?":
            out.append("(?:")
        elif part == "?}":
            out.append(")?")
        elif part.startswith("{*"):
            out.append(f"(?:[^ ]+ ){{0,{int(part.split()[-2])}}}")
        else:
            out += [f"{w.decode()} " for w in words_of(part.encode())]
    return "".join(out)
