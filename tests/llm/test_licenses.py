from __future__ import annotations

import random
import re

import pytest

from stratalog.llm import licenses, queries
from stratalog.llm.licenses import TEMPLATES, compile_template, scan, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text: str | None) -> tuple:
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES:
        want = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(want)] == want:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_query_is_the_brute_force(spark, edge_docs):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    for r in queries.op8_licenses(spark, "/root/testdata/sf0.01").collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(docs[r["doc_id"]])
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    got = licenses.scan_documents(edge_docs)
    assert sorted(str(tuple(r)[1:6]) for r in got.collect()) == sorted(str(brute(r["text"])) for r in edge_docs.collect())


GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject
to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software. """
DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION
OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the
License for the specific language governing permissions and limitations under the License."""
TEXTS = {
    "The MIT License. MIT LICENSE": ({"mit"}, 2, 0.5),
    "x (cc) CC-BY, cc_by and ccby": ({"cc-by"}, 2, 0.5),
    "Licensed under CC BY-NC 4.0.": ({"cc-by", "cc-by-nc-4.0"}, 1, 1.0),
    "Released under the MIT License.": ({"mit", "mit-mention"}, 1, 0.75),
    "Licensed under the Apache License, Version 2.0.": ({"apache", "apache-2.0-mention"}, 1, 0.75),
    APACHE: ({"apache", "apache-2.0-mention", "apache-2.0-notice"}, 1, 1.0),
    APACHE.replace("specific ", ""): ({"apache", "apache-2.0-mention"}, 1, 0.75),
    "GNU General Public License, as published by the FSF, version 3 or (at your option) any later version": ({"gpl", "gpl-3.0-mention"}, 1, 0.75),
    "GNU General Public License, version 9": ({"gpl"}, 1, 0.5),
    GRANT + DISCLAIMER: ({"mit"}, 0, 1.0),
    "Copyright 2020 A. B. " + GRANT.replace("permission notice", "permission notice (including the next paragraph)") + DISCLAIMER.replace("AUTHORS OR COPYRIGHT HOLDERS", "FOO, INC."): ({"mit"}, 0, 1.0),
    GRANT: (set(), 0, 0.0),
    DISCLAIMER: (set(), 0, 0.0),
    GRANT + DISCLAIMER.replace("OTHER DEALINGS", "DEALINGS"): (set(), 0, 0.0),
    GRANT.replace("sublicense, ", "") + DISCLAIMER: (set(), 0, 0.0),
    ISC: ({"isc"}, 0, 1.0),
    ISC.replace("and/or", "and"): ({"isc"}, 0, 1.0),
    ISC.replace("any purpose", "some purpose"): (set(), 0, 0.0),
    "SPDX-License-Identifier: BSD-3-Clause": ({"spdx"}, 0, 0.75),
    "a license, a permit and all of the rights": (set(), 0, 0.0),
    "": (set(), 0, 0.0),
}


@pytest.mark.parametrize("text", TEXTS)
def test_labels_and_scores(text):
    labels, places, score = TEXTS[text]
    s = scan(text.encode())
    assert (set(s.labels), len(s.starts), s.score) == (labels, places, score)


def test_every_template_accepts_its_own_wording():
    for name, markup in TEMPLATES.items():
        full = re.sub(r"\{\*.*?\*\}", "anything at all", re.sub(r"\{\?|\?\}", " ", markup))
        least = markup
        while re.search(r"\{\?[^{}]*\?\}", least := re.sub(r"\{\*.*?\*\}", "", least)):
            least = re.sub(r"\{\?[^{}]*\?\}", " ", least)
        for text in (full, f"before {least} after"):
            assert name in scan(text.encode()).labels, (name, text)


def test_automaton():
    a = compile_template("a {? b {? c ?} ?} {* x 2 *} d")
    assert a.anchor in (b"a", b"d")
    for text, ok in (("a d", 1), ("a b d", 1), ("a b c d", 1), ("a c d", 1), ("a b c x y d", 1), ("a x y z d", 0), ("b d", 0), ("a", 0)):
        assert bool(a.spans(words_of(text.encode()))) == ok, text
    assert a.spans(words_of(b"a d a b d")) == [(0, 2), (2, 5)]
    for bad in ("{? a ?}", "a {? b", ""):
        with pytest.raises(ValueError, match="mandatory|closed"):
            compile_template(bad)


def test_empty_table(no_docs):
    assert licenses.scan_documents(no_docs).count() == 0


def test_a_license_inside_a_very_long_text():
    filler = "some words of the software and its license, free of any, "
    s = scan((filler * 40_000 + GRANT + DISCLAIMER + filler * 40_000).encode())
    assert s.labels == ["mit"] and [b - a for _, a, b in s.spans] == [len(words_of((GRANT + DISCLAIMER).encode()))]


@pytest.mark.parametrize("name", TEMPLATES)
def test_patterns_accept_what_automata_accept(name):
    rng = random.Random(name)
    automaton, regex = compile_template(TEMPLATES[name]), re.compile(r"(?:^|(?<= ))" + licenses.pattern(TEMPLATES[name]))
    full = words_of(re.sub(r"\{\*.*?\*\}", "any thing", re.sub(r"\{\?|\?\}", " ", TEMPLATES[name])).encode())
    for _ in range(60):
        words = [w for w in full if rng.random() > rng.choice((0, 0.01, 0.1))]
        if rng.random() < 0.3 and words:
            words.insert(rng.randrange(len(words)), rng.choice(full))
        text = b" ".join(words).decode() + " "
        assert bool(automaton.spans(words)) == bool(regex.search(text)), text
