"""License scan by conditional compression.

Texts that have a word of every notice are read for the words that decide. Wherever a template could stand, it is
confirmed by the exact differences of wording between it and that part of the text: few words may differ, and none of
those that decide which license it is. The words found are then compressed alone and with the template as a raw
zstandard dictionary: what the template does not help to compress is no finding, and of findings that overlap that which
saves most bytes stays, of equal ones the longest.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import cache
from importlib.resources import files

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Notices and opening paragraphs as published, with the words that decide.
TEMPLATES: tuple[tuple[str, str, str], ...] = (
    ("MIT", "mit", "Released under the MIT License."),
    ("MIT", "mit", "Licensed under the MIT License."),
    ("MIT", "mit", "This project is licensed under the terms of the MIT license."),
    ("Apache-2.0", "apache 2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0", "gnu general 2", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "gnu general 3", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "gnu lesser general 3", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "gnu affero general 3", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "mozilla 2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("BSD-2-Clause", "bsd 2-clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "bsd 3-clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "cc by 4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "cc by-sa 4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "cc by-nc 4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "cc by-nd 4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "cc by-nc-sa 4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "attribution 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "attribution-sharealike 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "dedicated public domain", "This work is dedicated to the public domain."),
    ("LicenseRef-reserved", "all rights reserved", "All rights reserved."),
    ("MIT", "permission hereby granted free charge sublicense", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("ISC", "permission granted fee", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "apache 2.0 compliance", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("GPL-3.0-or-later", "gnu general 3 later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "gnu general 2 later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("MPL-2.0", "mozilla 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD", "redistribution binary permitted", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("Unlicense", "unencumbered public domain", "This is free and unencumbered software released into the public domain."),
)

#: What follows the opening paragraph in whole texts, by its place in ``TEMPLATES``.
_REST = (
    ("MIT", "permission hereby granted free charge sublicense", 20, 'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", "permission granted fee", 21, 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-2-Clause", "redistribution binary permitted", 26, '1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", "redistribution binary permitted neither endorse", 26, '1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("Unlicense", "unencumbered public domain", 27, 'Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.'),
)
#: Files of ``texts`` with whole licenses; the words that decide are those of the title and its date.
_FILES = (
    ("GPL-2.0", "gnu general 2 june 1991", "GPL-2"), ("GPL-3.0", "gnu general 3 29 june", "GPL-3"),
    ("LGPL-2.1", "gnu lesser general 2.1 february 1999", "LGPL-2.1"), ("LGPL-3.0", "gnu lesser general 3 29 june", "LGPL-3"),
    ("Apache-2.0", "apache 2.0 january 2004", "Apache-2.0"), ("MPL-2.0", "mozilla 2.0", "MPL-2.0"), ("CC0-1.0", "cc0 1.0", "CC0-1.0"),
)


@cache
def whole() -> tuple[tuple[str, str, str], ...]:
    """Whole license texts, without the advice that some carry behind their terms."""
    at = files("decant.llm") / "texts"
    rest = tuple((name, deciding, f"{TEMPLATES[i][2]} {text}") for name, deciding, i, text in _REST)
    return rest + tuple((name, deciding, (at / f"{file}.txt").read_text().split("END OF TERMS AND CONDITIONS")[0]) for name, deciding, file in _FILES)


#: An SPDX tag names its license itself: an identifier, or several with operators.
_ID = r"\(*[A-Za-z0-9](?:[A-Za-z0-9.+-]*[A-Za-z0-9+])?\)*"
SPDX = re.compile(rf"(?i:SPDX-License-Identifier):[ \t]*({_ID}(?:[ \t]+(?:AND|OR|WITH)[ \t]+{_ID})*)")
#: Words one of which every template has, whatever stands between them.
ANCHOR = r"(?i)licen[sc]e|rights[\W_]+reserved|public[\W_]+domain|permission[\W_]+(?:is|to)|redistribution[\W_]+and[\W_]+use"
TOKEN = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
#: Share of a template's words that may differ.
DIFFER = 0.1

FOUND = "license string, template int, start int, end int, saved int, differences int"


@dataclass
class Template:
    number: int
    license: str
    text: str
    words: list[str]
    deciding: frozenset[str]


def templates(rows: Sequence[tuple[str, str, str]] = TEMPLATES) -> list[Template]:
    return [Template(i, name, text, TOKEN.findall(text.lower()), frozenset(deciding.split())) for i, (name, deciding, text) in enumerate(rows)]


class Scanner:
    """Notices in one text."""

    def __init__(self, rows: Sequence[tuple[str, str, str]] = TEMPLATES):
        import zstandard as z

        self.alone, self.anchor = z.ZstdCompressor(level=12, write_content_size=False), re.compile(ANCHOR)
        self.own = [(t, Counter(t.words)) for t in templates(rows)]
        self.given = [z.ZstdCompressor(level=12, write_content_size=False, dict_data=z.ZstdCompressionDict(" ".join(t.words).encode(), dict_type=z.DICT_TYPE_RAWCONTENT)) for t, _ in self.own]

    def __call__(self, text: str) -> list[tuple]:
        """(license, template, start, end, saved, differences) in code points, by start."""
        if not self.anchor.search(text):
            return []
        spans = [m.span() for m in TOKEN.finditer(text)]
        words = [text[a:b].lower() for a, b in spans]
        at: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            at.setdefault(w, []).append(i)
        out = [(m[1], -1, *m.span(), 0, 0) for m in SPDX.finditer(text)]
        for t, counts in self.own:
            for a, b, n in _places(t, counts, words, at):
                raw = " ".join(words[a:b]).encode("utf-8", "replace")
                saved = len(self.alone.compress(raw)) - len(self.given[t.number].compress(raw))
                if saved > 0:
                    out.append((t.license, t.number, spans[a][0], spans[b - 1][1], saved, n))
        best: list[tuple] = []
        # one finding for a stretch of text: the one that saves most, then covers most, then differs least
        for f in sorted(set(out), key=lambda f: (-f[4], f[2] - f[3], f[5], f[1])):
            if all(f[3] <= g[2] or f[2] >= g[3] for g in best):
                best.append(f)
        return sorted(best, key=lambda f: f[2])


def _places(t: Template, counts: Counter, words: list[str], at: dict[str, list[int]]) -> Iterator[tuple[int, int, int]]:
    """Where the template stands in the words, and how many words differ there: not too many and no deciding one.

    ``at`` holds the places of each word.
    """
    if not all(w in at for w in t.deciding):
        return
    room = max(1, int(DIFFER * len(t.words))) if len(t.words) > 5 else 0
    free: list[str] | None = None
    # wherever the first word of the template stands and, failing that, its second
    for lead in (0, 1) if room else (0,):
        for start in at.get(t.words[lead], ()):
            past = start + len(t.words) - lead + room
            if any((i := bisect_left(at[w], start)) == len(at[w]) or at[w][i] >= past for w in t.deciding):
                continue
            part = (free or words)[start:past]
            # words that the part lacks differ in any case
            if part[0] != t.words[lead] or not t.deciding <= set(part) or len(t.words) - (counts & Counter(part)).total() > room:
                continue
            steps = SequenceMatcher(None, t.words, part, autojunk=False).get_opcodes()
            end = max((d for tag, _, _, _, d in steps if tag == "equal"), default=0)
            matched = {w for tag, a, b, _, _ in steps if tag == "equal" for w in t.words[a:b]}
            # words replaced, left out or put in; what follows the last common word is not part of the notice
            differences = sum(max(b - a, min(d, end) - min(c, end)) for tag, a, b, c, d in steps if tag != "equal")
            if differences <= room and t.deciding <= matched:
                yield start, start + end, differences
                free = free or list(words)
                free[start : start + end] = [""] * end  # the same template may stand again behind


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rows: Sequence[tuple[str, str, str]] | None = None) -> DataFrame:
    """One row per notice found: ``license``, ``template``, ``start``, ``end`` (code points), ``saved`` bytes, ``differences``.

    Without ``rows`` the templates are ``TEMPLATES`` and ``whole()``. SPDX tags are rows too: their license is the
    expression as written, their template -1. Whole texts are scanned. Null texts and texts without a notice have no row; repeated rows are scanned each; a text
    with several notices has a row for each. Other columns are not read. Empty input gives no rows.
    """
    rows = rows or (*TEMPLATES, *whole())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rows)
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
        names = ["key", *[x.split()[0] for x in FOUND.split(", ")]]
        for b in batches:
            found = [(k, *f) for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for f in scanner(t.as_py())]
            cols = list(zip(*found, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    d = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).filter(F.col("text").rlike(ANCHOR))
    return d.mapInArrow(run, f"key bigint, {FOUND}").withColumnRenamed("key", key)
