"""License scans by conditional compression.

Whole texts are searched, whatever their line breaks. For each template, the places are found where so many words in a
row, as a notice with few changes can have, hold enough of the template's words: no notice lies elsewhere. Texts with none of
the words that every such notice has one of need no closer look. Places that overlap are one candidate block. A block is compressed by zstandard alone and with each of its templates as raw
dictionary, lowered and less all but the words; templates are ranked by the share of bytes that the dictionary saves.
All of them are confirmed by wording: the words are aligned, and those missing, added inside or replaced must be few,
and none with a digit (a version) may be missing. Of confirmed notices that overlap, the one with the most equal words
counts, ``CHANGE_COST`` words less for each changed one, then the better ranked. What is left of the block is searched again, so one can hold several licenses.

Every whole text is scanned in one pass, with no shuffle; memory is one text with its words and the templates. Defined
cases: null and empty texts have no blocks; repeated rows and doc_ids get the same answer each, as does a null doc_id;
very long texts are one text like any other; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import difflib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame

from parley.llm.tables import small_batches

# Names and wording of public license notices and texts (without copyright lines).
TEMPLATES = {
    "0BSD-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "Apache-2.0-text": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "GPL-3.0-header-short": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-3.0-terms": "Distributed under the terms of the GNU General Public License v3.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "MIT-short": "Released under MIT.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-3-Clause-line": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

TEMPLATES |= {f"SPDX-{name}": f"SPDX-License-Identifier: {name}" for name in ("AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-or-later", "ISC", "LGPL-2.1-or-later", "MIT", "MPL-2.0")}

WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
LEVEL = 3
#: Most words missing, added or replaced, as a share of the template's words.
MOST_CHANGED = 0.1
CHANGE_COST = 4


@dataclass(frozen=True)
class Finding:
    start: int
    end: int
    license: str
    saved: float
    changed: int


class Scanner:
    def __init__(self, templates: dict[str, str] | None = None) -> None:
        self.templates = dict(sorted((templates or TEMPLATES).items()))
        self.words = {name: [w.lower() for w in WORD.findall(text)] for name, text in self.templates.items()}
        self.versions = {name: [i for i, w in enumerate(words) if any(c.isdigit() for c in w)] for name, words in self.words.items()}
        self.spare = {name: int(MOST_CHANGED * len(words)) for name, words in self.words.items()}
        self.number = {w: i for i, w in enumerate(sorted({w for words in self.words.values() for w in words}), 1)}
        self.names = list(self.templates)
        self.member = np.array([np.isin(np.arange(len(self.number) + 1), [self.number[w] for w in self.words[name]]) for name in self.names])
        self.least = np.array([len(self.words[name]) - self.spare[name] for name in self.names])
        self.anchors = self.anchor_words()
        self.plain = zstandard.ZstdCompressor(level=LEVEL)
        self.given = {
            name: zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            for name, words in self.words.items()
        }

    def anchor_words(self) -> list[str]:
        """Words of which a text with a notice holds one at least: of each template one more than may be missing, the longest."""
        chosen: set[str] = set()
        for name, words in self.words.items():
            wanted = sorted(set(words), key=lambda w: (w not in chosen, -len(w), w))
            chosen |= set(wanted[: self.spare[name] + 1])
        return sorted(chosen)

    def ranking(self, text: str) -> list[tuple[float, str]]:
        """Share of bytes that each template saves, largest first; equal ones by name."""
        return self.ranked([w.lower() for w in WORD.findall(text)], self.templates)

    def ranked(self, words: list[str], names: Iterable[str]) -> list[tuple[float, str]]:
        data = " ".join(words).encode("utf-8", "surrogatepass")
        alone = len(self.plain.compress(data))
        return sorted(((1 - len(self.given[name].compress(data)) / alone, name) for name in names), key=lambda x: (-x[0], x[1]))

    def confirmed(self, words: list[str], name: str) -> tuple[int, int, int] | None:
        """Range within the words and number of changed words, if the wording is the template's but for a few words."""
        template = self.words[name]
        pieces = [p for p in difflib.SequenceMatcher(None, template, words, autojunk=False).get_matching_blocks() if p.size]
        if not pieces:
            return None
        first, last = pieces[0], pieces[-1]
        equal = sum(p.size for p in pieces)
        inside = last.b + last.size - first.b
        changed = max(len(template), inside) - equal
        kept = {i for p in pieces for i in range(p.a, p.a + p.size)}
        if changed > MOST_CHANGED * len(template) or any(i not in kept for i in self.versions[name]):
            return None
        return first.b, last.b + last.size, changed

    def scan(self, text: str | None) -> tuple[int, list[Finding]]:
        """Number of candidate blocks, and what is confirmed in the text, by place."""
        low = (text or "").lower()
        if not any(word in low for word in self.anchors):
            return 0, []
        blocks, found = self.search(text)
        return blocks, sorted(found, key=lambda f: (f.start, f.end, f.license))

    def places(self, numbers: np.ndarray) -> list[tuple[int, int, str]]:
        """Word ranges that can be a template's notice: as long as the longest, with enough of its words, the first included."""
        out = []
        ends = np.arange(len(numbers))
        there = np.bincount(numbers, minlength=len(self.number) + 1)
        for k in np.flatnonzero(self.member @ there >= self.least):  # most texts hold too few words of every template
            name = self.names[k]
            size, spare = len(self.words[name]), self.spare[name]
            held = self.member[k][numbers]
            so_far = np.concatenate([[0], np.cumsum(held)])
            stop = np.minimum(ends + size + spare, len(numbers))
            out += [(int(at), int(stop[at]), name) for at in np.flatnonzero(held & (so_far[stop] - so_far[:-1] >= size - spare))]
        return sorted(out)

    def search(self, text: str) -> tuple[int, list[Finding]]:
        """Candidate blocks, and confirmed notices: of those that overlap the one with the most equal words less the cost of changed ones, then the best ranked; then what is left."""
        spans = [m.span() for m in WORD.finditer(text)]
        words = [text[a:b].lower() for a, b in spans]
        numbers = np.array([self.number.get(w, 0) for w in words], dtype=np.int64)
        todo, out, blocks = [(0, len(words))], [], 0
        while todo:
            start, end = todo.pop()
            for low, high, places in stretches(self.places(numbers[start:end])):
                blocks += (start, end) == (0, len(words))
                saved = {name: share for share, name in self.ranked(words[start + low : start + high], {name for _, _, name in places})}
                hits = set()
                for a, b, name in places:
                    hit = self.confirmed(words[start + a : start + b], name)
                    if hit:
                        hits.add((CHANGE_COST * hit[2] - (hit[1] - hit[0]), -saved[name], name, start + a + hit[0], start + a + hit[1], hit[2]))
                taken: list[tuple[int, int]] = []
                for _, share, name, first, stop, changed in sorted(hits):
                    k = bisect.bisect(taken, (first, stop))
                    if (not k or taken[k - 1][1] <= first) and (k == len(taken) or stop <= taken[k][0]):
                        taken.insert(k, (first, stop))
                        out.append(Finding(spans[first][0], spans[stop - 1][1], name, round(-share, 6), changed))
                if taken:
                    cuts = [start + low, *[x for pair in taken for x in pair], start + high]
                    todo += [(a, b) for a, b in zip(cuts[::2], cuts[1::2], strict=True) if a < b]
        return blocks, out


def stretches(places: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, list[tuple[int, int, str]]]]:
    """Ranges of places that overlap, with their places."""
    group: list[tuple[int, int, str]] = []
    end = 0
    for place in places:
        if group and place[0] >= end:
            yield group[0][0], end, group
            group = []
        end = max(end, place[1]) if group else place[1]
        group.append(place)
    if group:
        yield group[0][0], end, group


RESULT = "n_blocks long, n_confirmed long, n_exact long, licenses string, spans string"


def licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row for each document: candidate blocks, confirmed and word-for-word notices, their names and places."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates)
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                blocks, found = scanner.scan(text)
                rows.append((blocks, len(found), sum(f.changed == 0 for f in found), ",".join(sorted({f.license for f in found})), ",".join(f"{f.license}:{f.start}:{f.end}" for f in found)))
            out = pd.DataFrame(rows, columns=["n_blocks", "n_confirmed", "n_exact", "licenses", "spans"])
            out.insert(0, "doc_id", pdf["doc_id"].reset_index(drop=True))
            yield out

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, {RESULT}")
