"""License scans by conditional compression.

Candidate blocks (a license's cues, and around each as many words as the longest template may take,
across line breaks and comment marks) are compressed by zstandard with each template as raw
dictionary, both as words and single spaces, in windows of about twice the template's length. How much
smaller a window gets at best than without a dictionary ranks the templates. In that order, every
template whose words the block holds is tried, and confirmed only by its exact wording: words are
aligned, and the words of the template that lack and the words put in between are counted. Numbers
must agree.

Whole licenses are bodies of several templates, their paragraphs. Paragraphs that were confirmed in the
order of a body are put together; what a body lacks counts as differences, so that a license file with
a paragraph removed is told from a whole one.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .bpe import slices, texts_of
from .common import small_batches

SCHEMA = "doc_id long, n_blocks long, n_found long, licenses string, spans string, bodies string"

#: The wording of license notices, and of the paragraphs of whole licenses (#).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "MIT#copies": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT#disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC#disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD#source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSD#binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD#names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD#disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Zlib#disclaimer": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Zlib#grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "Zlib#origin": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
    "Zlib#altered": "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    "Zlib#notice": "This notice may not be removed or altered from any source distribution.",
    "Unlicense#grant": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Unlicense#dedication": "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "Unlicense#disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
}
#: The paragraphs of whole licenses, in their order.
BODIES = {
    "BSD-2-Clause": ("BSD-3-Clause", "BSD#source", "BSD#binary", "BSD#disclaimer"),
    "BSD-3-Clause": ("BSD-3-Clause", "BSD#source", "BSD#binary", "BSD#names", "BSD#disclaimer"),
    "ISC": ("ISC", "ISC#disclaimer"),
    "MIT": ("MIT-notice", "MIT#copies", "MIT#disclaimer"),
    "Unlicense": ("Unlicense", "Unlicense#grant", "Unlicense#dedication", "Unlicense#disclaimer"),
    "Zlib": ("Zlib#disclaimer", "Zlib#grant", "Zlib#origin", "Zlib#altered", "Zlib#notice"),
}
#: Code points between paragraphs of one body at most, besides those of the paragraphs that lack there.
GAP = 200
#: Each template holds more cues than words of it may differ, so that no confirmed notice is without one.
CUE = re.compile(r"licen[sc]e|copyright|permission|redistribut|warrant|public[^a-z0-9]+domain|free[^a-z0-9]+(?:software|of[^a-z0-9]+charge)|permitted[^a-z0-9]+provided|associated[^a-z0-9]+documentation|unencumbered|merchantab|liab(?:le|ility)|misrepresent|original[^a-z0-9]+software|source[^a-z0-9]+(?:distribution|code[^a-z0-9]+form)|compiled[^a-z0-9]+binary|product[^a-z0-9]+documentation", re.I)
STEMS = ("licen", "copyright", "permission", "redistribut", "warrant", "domain", "software", "charge", "permitted", "documentation", "unencumbered", "merchantab", "liab", "misrepresent", "source", "compiled")
WORD = re.compile(r"[A-Za-z0-9]+(?:[.'-][A-Za-z0-9]+)*")
#: The percentage of a template's words that may differ.
DIFFER = 5
#: Words of a block on either side of its cues: a notice with a cue in it lies inside, whatever its lines.
REACH = max(n + DIFFER * n // 100 for n in (len(WORD.findall(t)) for t in TEMPLATES.values()))


def blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) of candidate blocks, in code points: cues with REACH words on either side; those that meet are one."""
    low = text.lower()
    if not any(s in low for s in STEMS) or not CUE.search(text):
        return []
    starts, ends = array("q"), array("q")
    for m in WORD.finditer(text):
        starts.append(m.start())
        ends.append(m.end())
    out: list[list[int]] = []
    for m in CUE.finditer(text):
        lo = max(0, bisect_right(starts, m.start()) - 1 - REACH)
        hi = min(len(starts), bisect_left(starts, m.end()) + REACH)
        if out and lo <= out[-1][1]:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return [(starts[a], ends[b - 1]) for a, b in out if b > a]


@cache
def compressors() -> tuple[zstandard.ZstdCompressor, dict[str, zstandard.ZstdCompressor], dict[str, list[str]]]:
    plain = zstandard.ZstdCompressor(level=3, write_content_size=False)
    words = {k: WORD.findall(v.lower()) for k, v in TEMPLATES.items()}
    raw = {k: " ".join(v).encode() for k, v in words.items()}
    own = {k: zstandard.ZstdCompressor(level=3, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for k, v in raw.items()}
    return plain, own, words


def wording(block: list[str], template: list[str]) -> tuple[int, int, int] | None:
    """(first word, word behind the last, differences) of the template in the block; None: not there."""
    found = [m for m in SequenceMatcher(None, block, template, autojunk=False).get_matching_blocks() if m.size]
    if not found:
        return None
    a, b, same = found[0].a, found[-1].a + found[-1].size, sum(m.size for m in found)
    lack = [w for w in template if any(c.isdigit() for c in w)]
    own = block[a:b]
    if any(w not in own for w in lack):
        return None
    return a, b, len(template) - same + (b - a) - same


def holds(own: set[str], template: list[str]) -> bool:
    """Whether words `own` may confirm the template: no more than may differ lack, and no number does."""
    lack = [w for w in template if w not in own]
    return len(lack) <= DIFFER * len(template) // 100 and not any(c.isdigit() for w in lack for c in w)


def reduction(block: list[str], plain: zstandard.ZstdCompressor, own: zstandard.ZstdCompressor, template: list[str]) -> int:
    """By how many bytes the template makes a window of the block smaller, at best. Windows overlap by
    half, so that one holds the whole of any place; those without the template's words are left out."""
    step, best = len(template) + DIFFER * len(template) // 100, 0
    for lo in range(0, len(block), step):
        part = block[lo : lo + 2 * step]
        if holds(set(part), template):
            raw = " ".join(part).encode()
            best = max(best, len(plain.compress(raw)) - len(own.compress(raw)))
    return best


def scan_block(block: str) -> list[tuple[str, int, int, int]]:
    """(license, start, end, differences) in a block, found one by one, each the best by compression."""
    plain, own, words = compressors()
    places = [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(block)]
    seen = [p[0] for p in places]
    there = set(seen)
    able = [k for k in own if holds(there, words[k])]
    if not able:
        return []
    saved = sorted((-reduction(seen, plain, own[k], words[k]), -len(words[k]), k) for k in able)
    taken, out = [False] * len(places), []
    # What is there word for word goes before what another template would hold with differences.
    for share, k in [(share, k) for share in (0, DIFFER) for _, _, k in saved]:
        free, start = [], 0
        for i in range(len(places) + 1):  # the stretches that no other template has
            if i == len(places) or taken[i]:
                if i > start:
                    free.append((start, i))
                start = i + 1
        for lo, hi in free:
            while hi > lo and (hit := exact(seen, words[k], lo, hi, share)):
                a, b, differ = hit
                out.append((k, places[a][1], places[b - 1][2], differ))
                for i in range(a, b):
                    taken[i] = True
                lo = b
    return out


def exact(block: list[str], template: list[str], lo: int, hi: int, share: int) -> tuple[int, int, int] | None:
    """The template's first place in block[lo:hi] with differences of no more than `share` percent of its words."""
    most = share * len(template) // 100
    first = set(template[: most + 1])
    for i in range(lo, hi):
        if block[i] in first:
            part = block[i : min(hi, i + len(template) + most)]
            hit = wording(part, template) if holds(set(part), template) else None
            if hit and hit[2] <= most and hit[0] == 0:
                return i, i + hit[1], hit[2]
    return None


def scan(text: str) -> tuple[int, list[tuple[str, int, int, int]]]:
    found = blocks(text)
    hits = sorted({(k, lo + a, lo + b, d) for lo, hi in found for k, a, b, d in scan_block(text[lo:hi])}, key=lambda x: (x[1], x[2], x[0]))
    return len(found), hits


def bodies(hits: list[tuple[str, int, int, int]]) -> list[tuple[str, int, int, int, int]]:
    """(license, start, end, paragraphs, differences) of the bodies that confirmed paragraphs (in the order
    of their places) make: from the first one on, each that follows in a body's order, as near as what
    lacks between them allows. The body with most paragraphs is taken, then that which lacks least. A
    paragraph that lacks counts all its words as differences."""
    out, i = [], 0
    while i < len(hits):
        best = None
        for name, parts in BODIES.items():
            taken, last = [], -1
            for k, start, _, _ in hits[i:]:
                at = parts.index(k) if k in parts else -1
                if at <= last or taken and start - taken[-1][2] > GAP + sum(len(TEMPLATES[p]) for p in parts[last + 1 : at]):
                    break
                taken.append(hits[i + len(taken)])
                last = at
            if taken:
                lack = sum(len(WORD.findall(TEMPLATES[p])) for p in parts if p not in {t[0] for t in taken})
                found = (-len(taken), lack, name, taken)
                best = min(best or found, found)
        if best:
            n, lack, name, taken = best
            out.append((name, taken[0][1], taken[-1][2], -n, lack + sum(t[3] for t in taken)))
        i += -best[0] if best else 1
    return out


def names(hits: list[tuple[str, int, int, int]], whole: list[tuple[str, int, int, int, int]]) -> list[str]:
    """The licenses of what was found: of paragraphs those of their bodies, of other notices their own."""
    parts = {p for x in BODIES.values() for p in x}
    return sorted({k.removesuffix("-notice") for k, *_ in hits if k not in parts} | {b[0] for b in whole})


def licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_blocks, n_found (wordings), licenses (distinct, sorted, comma-joined), spans
    (wording:start:end:differences, in code points, comma-joined), bodies
    (license:start:end:paragraphs/of:differences, comma-joined; whole where all paragraphs are there) for
    every row of `docs`.

    Null or empty text: no blocks. Null id: passed on. Repeated rows: each scanned. Ties: of wordings
    that save the same, the longer one is tried first, then by name; of bodies with the same paragraphs
    that which lacks fewer words, then by name. Very long texts: whole. Empty table: no rows. Other
    columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = [scan(t) for t in texts_of(part)]
                whole = [bodies(h) for _, h in rows]
                yield pa.record_batch([
                    part.column("doc_id"), pa.array([n for n, _ in rows], pa.int64()), pa.array([len(h) for _, h in rows], pa.int64()),
                    pa.array([",".join(names(h, b)) for (_, h), b in zip(rows, whole, strict=True)], pa.string()),
                    pa.array([",".join(f"{k}:{a}:{b}:{d}" for k, a, b, d in h) for _, h in rows], pa.string()),
                    pa.array([",".join(f"{k}:{a}:{b}:{n}/{len(BODIES[k])}:{d}" for k, a, b, n, d in x) for x in whole], pa.string()),
                ], [x.split()[0] for x in SCHEMA.split(", ")])

    small_batches(docs.sparkSession)
    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(run, SCHEMA)
