"""License scans: an exact set-similarity join of text blocks with license templates.

The tokens of the templates are ordered by how many blocks of the whole corpus hold them, rarest first. A block that holds at
least a share ``threshold`` of a template's tokens must hold one of the template's first ``|T| - need + 1`` tokens in that order
(prefix filter), must have ``need`` tokens itself (length filter), and the tokens left after the first shared one, in both,
must suffice (positional filter). What passes is verified in full, so every block that meets the threshold is found.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import documents, small_batches, text_or_empty

#: Word phrases that give a base label wherever they stand.
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
#: Short notices as they stand above or below a text, and the paragraphs of license texts; the label is what a match adds.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    # Whole license texts, paragraph by paragraph.
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
)
THRESHOLD = 0.9

_LETTERS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def words(text: str) -> list[bytes]:
    """Runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` in the text with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "replace").lower().translate(_LETTERS).split()


class TemplateJoin:
    """Templates ordered by token frequency, with an index from prefix tokens to templates."""

    def __init__(self, templates: Iterable[tuple[str, str]], frequency: Mapping[bytes, int], threshold: float = THRESHOLD) -> None:
        self.order = lambda w: (frequency.get(w, 0), w)
        self.labels, self.tokens, self.need = [], [], []
        self.index: dict[bytes, list[tuple[int, int]]] = {}
        for label, text in templates:
            own = sorted(set(words(text)), key=self.order)
            if not own:
                continue
            need = max(1, math.ceil(threshold * len(own) - 1e-9))
            t = len(self.labels)
            self.labels.append(label)
            self.tokens.append(frozenset(own))
            self.need.append(need)
            for i, w in enumerate(own[: len(own) - need + 1]):
                self.index.setdefault(w, []).append((t, i))
        self.vocabulary = frozenset().union(*self.tokens) if self.tokens else frozenset()
        self.least = min(self.need, default=0)

    def matches(self, block: frozenset[bytes] | set[bytes]) -> dict[int, float]:
        """Template index to containment (share of the template's tokens in the block), for those at the threshold or above."""
        if len(block) < self.least:
            return {}
        mine = sorted(block & self.vocabulary, key=self.order)
        if not any(w in self.index for w in mine):
            return {}
        found, seen = {}, set()
        for j, w in enumerate(mine):
            for t, i in self.index.get(w, ()):
                if t in seen:
                    continue
                seen.add(t)
                need, size = self.need[t], len(self.tokens[t])
                if len(mine) >= need and 1 + min(size - i - 1, len(mine) - j - 1) >= need and (n := len(self.tokens[t] & block)) >= need:
                    found[t] = n / size
        return found


def blocks(text: str) -> list[str]:
    """Lines; a license notice of several lines is also a block as a paragraph (lines up to a blank one)."""
    lines = text.split("\n")
    if len(lines) == 1:
        return lines
    out, run = list(lines), []
    for line in [*lines, ""]:
        if line.strip():
            run.append(line)
        else:
            if 1 < len(run):
                out.append("\n".join(run))
            run = []
    return out


def token_frequency(docs: DataFrame, templates: Iterable[tuple[str, str]] = TEMPLATES, text_col: str = "text") -> dict[bytes, int]:
    """In how many blocks of all texts each template token stands. At most one row a template token reaches the driver."""
    vocabulary = frozenset(w for _, text in templates for w in words(text))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for b in batches:
            for t in b["text"]:
                if not vocabulary.isdisjoint(words(t)):
                    for block in blocks(t):
                        held.update(vocabulary.intersection(words(block)))
        yield pd.DataFrame({"token": list(held), "n": list(held.values())}).astype({"n": "int64"})

    small_batches(docs)
    rows = docs.select(text_or_empty(text_col).alias("text")).mapInPandas(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["token"]): r["n"] for r in rows}


def scan(text: str, join: TemplateJoin, phrases: Mapping[tuple[str, ...], str]) -> tuple:
    all_words = words(text)
    keys = {tuple(w.encode() for w in p): label for p, label in phrases.items()}
    places, base, joined = [], set(), set(all_words)
    for p, label in keys.items():
        if joined.issuperset(p):
            at = -1
            while True:
                try:
                    at = all_words.index(p[0], at + 1)
                except ValueError:
                    break
                if tuple(all_words[at : at + len(p)]) == p:
                    places.append(at)
                    base.add(label)
    labels, score = set(base), 0.0
    if not joined.isdisjoint(join.index):
        for block in blocks(text):
            for t, c in join.matches(set(words(block))).items():
                labels.add(join.labels[t])
                score = max(score, c)
    first, last = (min(places), max(places)) if places else (None, None)
    return len(all_words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), max(score, 1.0 if base else 0.0)


def license_scan(
    docs: DataFrame,
    templates: Iterable[tuple[str, str]] = TEMPLATES,
    phrases: Mapping[tuple[str, ...], str] = PHRASES,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: ``id_col, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``score``: the largest containment of a template in a block, 1 where a base phrase stands. Null and empty texts have no
    words and no labels. Repeated rows give equal rows. Extra columns are ignored; an empty table gives no rows.
    """
    templates = tuple(templates)
    join_args = (templates, token_frequency(docs, templates, text_col), threshold)
    held: list[TemplateJoin] = []

    @F.pandas_udf("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
    def udf(texts: pd.Series) -> pd.DataFrame:
        if not held:
            held.append(TemplateJoin(*join_args))
        made = pd.DataFrame([scan(t, held[0], phrases) for t in texts], columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
        return made.astype({"first_word": "Int64", "last_word": "Int64"})

    return docs.select(F.col(id_col), udf(text_or_empty(text_col)).alias("_l")).select(id_col, "_l.*")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))
