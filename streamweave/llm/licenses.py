"""License scans by conditional compression.

Texts in which a trigger word occurs (found by one pattern on the JVM side) are cut into candidate blocks: for each trigger, each
template and each place of that trigger in the template, the words of the text where the template would stand, alone and with a few
more on either side; line ends are blanks, comment signs and list marks are no words. Blocks that lack too many of the template's words, or one of
those that name a license or its version, could not be confirmed and go. Every other block is compressed by zstandard alone and
with the template as a raw-content dictionary, in lower case; the bytes saved, as a share of the template's own compressed size, tell the candidates.
Each one that reaches ``gain`` is confirmed by its exact wording: block and template are aligned word by word, and the words that
were left out, put in or replaced are the result's differences.

The agreement is the share of matched words in the template, or in the wording if that is longer by more than one word. A finding
needs ``agree``; it may not lack a version or a word that names its license, nor hold a word that names another one (``Lesser``,
``NonCommercial``); a template of less than four words has to stand as it is. What a finding leaves of its block on either side is searched again.

Defined results: texts that are null or hold no trigger give no row; overlapping findings of one text keep the one with most matched
words, less its differences (ties: the earlier, then the first template); repeated rows each give their rows; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import bisect
import difflib
import functools
import heapq
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrowed, schema, task

# The wording of public licenses and of the usual notices.
_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
    "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF "
    "THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must "
    "retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of "
    "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
)
_GNU = (
    "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the "
    "License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
)
_GNU_NAMES = {"GPL": "General Public License", "LGPL": "Lesser General Public License", "AGPL": "Affero General Public License"}
_GNU_VERSIONS = (("GPL", "2"), ("GPL", "3"), ("LGPL", "2.1"), ("LGPL", "3"), ("AGPL", "3"))
_CC_NAMES = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
_CC_VERSIONS = {"4.0": "International", "3.0": "Unported"}
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "MIT notice": "Released under the MIT License.",
    **{f"{k}-{v if '.' in v else v + '.0'} notice": f"This work is licensed under the GNU {_GNU_NAMES[k]}, version {v}." for k, v in _GNU_VERSIONS},
    **{f"CC-{k}-4.0 notice": f"Licensed under CC {k} 4.0." for k in _CC_NAMES},
    **{f"CC-{k}-{v} full notice": f"This work is licensed under a Creative Commons {name} {v} {where} License." for v, where in _CC_VERSIONS.items() for k, name in _CC_NAMES.items()},
    "BSD notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "Reserved-rights notice": "All rights reserved.",
    "Reserved-rights notice (are)": "All rights are reserved.",
    "Some-rights notice": "Some rights reserved.",
    "No-rights notice": "No rights reserved.",
    "Copyright notice (c)": "Copyright (c)",
    "Copyright notice ©": "Copyright ©",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
        "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause": f"{_BSD} {_WARRANTY}",
    "BSD-3-Clause": f"{_BSD} {_BSD_NAMES} {_WARRANTY}",
    "Apache-2.0 header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    **{
        f"{k}-{v if '.' in v else v + '.0'} header": _GNU.format(what="library" if k == "LGPL" else "program", name=_GNU_NAMES[k], version=v)
        for k, v in _GNU_VERSIONS
    },
    "MPL-2.0 header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source "
        "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
}
# Words, or parts of words joined by hyphens, that tell one license from another.
NAMES = frozenset(
    "affero lesser library gpl lgpl agpl gnu apache mit isc bsd mozilla mpl attribution sharealike noncommercial noderivatives noderivs by sa nc nd cc zero".split()
)
TRIGGER = (
    r"(?i)licen[cs]e|copyright|permission[\s\xa0#*/]+(?:is|to)|redistribution|warranty|creative[\s\xa0#*/]+commons|spdx|rights[\s\xa0#*/]+(?:are[\s\xa0#*/]+)?reserved|public[\s\xa0#*/]+domain"
)
_WORD = re.compile(r"\S+")
_MARK = re.compile(r"\(?(?:[0-9]{1,2}|[A-Za-z])[.)]")
_NUMBER = re.compile(r"v?[0-9]+(?:\.[0-9]+)*")


def _fold(word: str) -> str:
    """A word as it is compared: lower-case, without the punctuation around it; 2.0 and v2 are 2, and an address is without its scheme."""
    w = word.lower().strip(".,;:()\"'!?*/#<>[]{}_|“”‘’`-–—")
    if _NUMBER.fullmatch(w):
        return re.sub(r"(?:\.0)+$", "", w.lstrip("v"))
    return re.sub(r"^https?://(?:www\.)?", "", w)


def _words(text: str) -> tuple[list[tuple[int, int]], list[str]]:
    """Where the words of a text stand, and what they are compared as: signs alone are no words, nor are list marks behind the end of a sentence."""
    spans, folded, before = [], [], "."
    for m in _WORD.finditer(text):
        w = m.group()
        f = _fold(w)
        if f and not (before[-1] in ".:;" and _MARK.fullmatch(w) and w not in ("(c)", "(C)")):
            spans.append(m.span())
            folded.append(f)
        before = w if f else before
    return spans, folded


def _names(word: str) -> bool:
    """Whether a folded word tells one license from another."""
    return not NAMES.isdisjoint(word.split("-"))


class Scanner:
    def __init__(self, templates: dict[str, str]):
        import zstandard as z

        self.names = list(templates)
        self.shown, self.folded, self.anchors, self.must = [], [], [], []
        self.trigger = re.compile(TRIGGER)
        for t in templates.values():
            spans, folded = _words(t)
            self.shown.append([t[a:b] for a, b in spans])
            self.folded.append(folded)
            self.must.append({w for w in folded if _names(w) or _NUMBER.fullmatch(w)})
            self.anchors.append(self.hits(t, [a for a, _ in spans]))
        self.plain = z.ZstdCompressor(level=3)
        raw = [" ".join(t.lower().split()).encode() for t in templates.values()]
        self.own = [len(self.plain.compress(t)) for t in raw]
        self.given = [z.ZstdCompressor(level=3, dict_data=z.ZstdCompressionDict(t, dict_type=z.DICT_TYPE_RAWCONTENT)) for t in raw]

    def hits(self, text: str, starts: list[int]) -> list[tuple[int, str]]:
        """The words in which triggers begin, and which trigger it is."""
        found = {(bisect.bisect_right(starts, m.start()) - 1, re.sub(r"[^a-z]+", " ", m.group().lower()).replace("licence", "license")) for m in self.trigger.finditer(text)}
        return sorted(x for x in found if x[0] >= 0)

    def windows(self, at: int, trigger: str, n_words: int):
        """Candidate blocks about a trigger in word ``at``: for each template and each place of the trigger in it, the words where it would stand, alone and with some on either side."""
        for k, t in enumerate(self.folded):
            more = 10 + len(t) // 5
            for p, same in self.anchors[k]:
                if same == trigger:
                    for m in (0, more):
                        low, high = max(0, at - p - m), min(n_words, at - p + len(t) + m)
                        if high > low:
                            yield k, low, high

    def possible(self, words: list[str], k: int, agree: float) -> bool:
        """Whether the words hold enough of the template's for it to be confirmed."""
        there = set(words)
        t = self.folded[k]
        return self.must[k] <= there and sum(w in there for w in t) >= agree * len(t) - 1e-9

    def reduction(self, block: str, k: int) -> float:
        """Bytes that the template saves on the block, as a share of the template's own compressed size: what else stands in the block does not dilute it."""
        raw = " ".join(block.lower().split()).encode()
        return (len(self.plain.compress(raw)) - len(self.given[k].compress(raw))) / self.own[k]

    def confirm(self, mine: list[str], k: int):
        """Best aligned span of the words: first word, word behind the last, agreement, differences as words (what, template's from, to, own from, to), and the longest run."""
        t = self.folded[k]
        got = [m for m in difflib.SequenceMatcher(None, mine, t, autojunk=False).get_matching_blocks() if m.size]
        if not got:
            return None
        core = max(got, key=lambda m: m.size)
        # only what stands within the template's length of the longest run
        low, high = core.a - core.b - 5, core.a + len(t) - core.b + 5
        got = [m for m in got if m.a >= low and m.a + m.size <= high]
        best = (0.0, 0)
        for i in range(len(got)):  # a word that happens to stand far off does not belong to it
            matched = 0
            for j in range(i, len(got)):
                matched += got[j].size
                long = got[j].a + got[j].size - got[i].a
                share = matched / max(len(t), long - 1)
                if (share, matched) > best:
                    best, first, last = (share, matched), got[i].a, got[j].a + got[j].size
        share = best[0]
        told = [x for x in difflib.SequenceMatcher(None, mine[first:last], t, autojunk=False).get_opcodes() if x[0] != "equal"]
        told = [(op, b1, b2, first + a1, first + a2) for op, a1, a2, b1, b2 in told]
        if len(t) < 4 and told:
            share = 0.0
        for _, b1, b2, a1, a2 in told:
            if any(w in self.must[k] for w in t[b1:b2]) or any(_names(w) and w not in self.must[k] for w in mine[a1:a2]):
                share = 0.0  # another license
        return first, last, share, told, core.a, core.a + core.size

    def scan(self, text: str, agree: float, gain: float):
        spans, words = _words(text)
        starts = [a for a, _ in spans]
        found: list[tuple] = []
        seen, tried = set(), set()

        def offer(k: int, low: int, high: int, size: float):
            """Confirm the template in the words from ``low`` to ``high``."""
            if (k, low, high) in seen or not self.possible(words[low:high], k, agree):
                return
            seen.add((k, low, high))
            got = self.confirm(words[low:high], k)
            if got and got[2] < agree:  # the longest run may be a piece of another notice
                offer(k, low, low + got[4], size)
                offer(k, low + got[5], high, size)
            elif got:
                first, last, share, told = low + got[0], low + got[1], got[2], got[3]
                shown = self.shown[k]
                said = [
                    f"{op} '{' '.join(shown[b1:b2])}' -> '{text[spans[low + a1][0] : spans[low + a2 - 1][1]] if a2 > a1 else ''}'"
                    for op, b1, b2, a1, a2 in told
                ]
                matched = len(shown) - sum(b2 - b1 for _, b1, b2, _, _ in told)
                heapq.heappush(found, (len(told) - matched, first, k, -size, low, high, last, share, said))

        for at, trigger in self.hits(text, starts):
            for k, low, high in self.windows(at, trigger, len(spans)):
                if (k, low, high) not in tried:
                    tried.add((k, low, high))
                    if self.possible(words[low:high], k, agree):
                        size = self.reduction(text[starts[low] : spans[high - 1][1]], k)
                        if size >= gain:
                            offer(k, low, high, size)
        taken: list[tuple[int, int]] = []  # words, in order
        while found:
            _, first, k, size, low, high, last, share, told = heapq.heappop(found)
            i = bisect.bisect_left(taken, (first, last))
            if (i == 0 or taken[i - 1][1] <= first) and (i == len(taken) or taken[i][0] >= last):
                taken.insert(i, (first, last))
                a, z = starts[first], spans[last - 1][1]
                yield self.names[k], a, z, text[a:z], share, -size, told
            # on in what is left of the block beside what is taken
            i = bisect.bisect_left(taken, (low, low))
            i -= i > 0 and taken[i - 1][1] > low
            while i < len(taken) and taken[i][0] < high:
                offer(k, low, taken[i][0], -size)
                low = taken[i][1]
                i += 1
            offer(k, low, high, -size)


@functools.lru_cache(2)
def _scanner() -> Scanner:
    return Scanner(TEMPLATES)


def scan(docs: DataFrame, agree: float = 0.9, gain: float = 0.15) -> DataFrame:
    """Findings in ``docs`` (doc_id, text): ``doc_id, license, begin, end`` (characters), ``wording, agreement, reduction, differences``."""
    docs = narrowed(docs, doc_id="bigint", text="string").where(F.col("text").rlike(TRIGGER))

    @task("licenses")
    def run(batches):
        import pyarrow as pa

        s = _scanner()
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.string())]
        names = ["doc_id", "license", "begin", "end", "wording", "agreement", "reduction", "differences"]
        for batch in batches:
            rows = [(i, *f) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for f in s.scan(t, agree, gain)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(8)], names=names)

    return docs.mapInArrow(
        run, schema(doc_id="bigint", license="string", begin="bigint", end="bigint", wording="string", agreement="double", reduction="double", differences="array<string>")
    )
