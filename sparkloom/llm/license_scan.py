"""License scan by conditional compression.

Words that license notices use (``TRIGGERS``) mark places of a text.  Around each place as many
words as the longest template can span, on both sides and over line ends, are a candidate block;
blocks that meet are one.  Each block is compressed alone and with each template as a raw
zstandard dictionary; the larger the saving, the more of the template's wording is in the block.
The ranking is gone through from the largest saving on, and each template confirmed by words: it holds
in a window of the block when nearly all its words stand there in order and few words differ (missing, or
between).  The longest common subsequence of all windows with one end comes from one backward pass
over bits.  The confirmed template with the largest saving wins; among those within ``CLOSE`` of it, where
sizes are a matter of some bytes, exact wording decides, and no lower saving is looked at.  Its words
are taken out of the block and the rest is judged again, so a block may hold several notices.

Every template has two trigger words, or is so short that it only holds whole, so no notice is
missed for lack of a trigger but one that has lost all of them.

Defined results: null or empty text has no blocks.  Of equal savings the template with more words found
wins, then fewer differences, then the template's name.  A text without trigger words is never compressed.  Empty tables give
empty results; repeated rows are each scanned; extra columns are ignored.
"""

from __future__ import annotations

import difflib
import functools
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.shared import short_batches

# Short notices, and openings, headers and bodies of public license texts.
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND '
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, "
    "STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'
TEMPLATES = {
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "BSD": _BSD,
    "BSD-2-Clause-text": f"{_BSD}: 1. {_BSD_SOURCE} 2. {_BSD_BINARY} {_BSD_DISCLAIMER}",
    "BSD-3-Clause-text": f"{_BSD}: 1. {_BSD_SOURCE} 2. {_BSD_BINARY} 3. {_BSD_NAMES} {_BSD_DISCLAIMER}",
    "BSL-1.0-text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": _ISC,
    "ISC-text": f'{_ISC} THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES '
    "OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "LGPL-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-text": _MIT,
    "MIT-whole-text": f"{_MIT}, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "all-rights-reserved": "All rights reserved.",
}
# Parts of words.
TRIGGERS = ("licen", "copyright", "reserved", "distribut", "granted", "waived", "permi", "warrant", "public", "mozilla")
LEVEL, LEAST_WORDS = 3, 0.9
#: Savings this near to the largest confirmed one are told apart by wording.
CLOSE = 0.05

_WORD = re.compile(r"[a-z0-9.+-]*[a-z0-9]")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def most_differences(template: list[str]) -> int:
    """Words that may differ where a template holds."""
    return max(1, len(template) // 5)


def reach_of(templates: dict[str, str]) -> int:
    """The words that the longest template can span."""
    return max((len(w) + most_differences(w) for w in map(words_of, templates.values())), default=0)


@functools.lru_cache(maxsize=1 << 16)
def _triggers(word: str) -> bool:
    return any(t in word for t in TRIGGERS)


def blocks(text: str, reach: int) -> list[list[str]]:
    """The words within ``reach`` of a trigger, in runs."""
    small = text.lower()
    if not any(t in small for t in TRIGGERS):
        return []
    words = _WORD.findall(small)
    out: list[list[int]] = []
    for i in (i for i, w in enumerate(words) if _triggers(w)):
        if out and i - reach <= out[-1][1]:
            out[-1][1] = i + reach + 1
        else:
            out.append([max(0, i - reach), i + reach + 1])
    return [words[a:b] for a, b in out]


@functools.lru_cache(maxsize=8)
def _compressors(templates: tuple[tuple[str, str], ...]):
    import zstandard

    made = []
    for name, text in templates:
        known = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.append((name, zstandard.ZstdCompressor(level=LEVEL, dict_data=known)))
    return zstandard.ZstdCompressor(level=LEVEL), made


def savings(block: str, templates: dict[str, str]) -> list[tuple[str, float]]:
    """Templates by the share of the compressed size that they save, best first."""
    alone, others = _compressors(tuple(sorted(templates.items())))
    data = block.encode()
    size = len(alone.compress(data))
    return sorted(((name, (size - len(c.compress(data))) / size) for name, c in others), key=lambda x: (-x[1], x[0]))


def fits(block: list[str], template: list[str]) -> list[tuple[int, int, int, int]]:
    """Windows where the template holds, none over another, best first: words found, words that differ, first and past place.

    A window starts with one of the first words of the template and ends with one of the last: so
    few may be missing.  Only windows with enough of the template's words are looked at.
    """
    n, most = len(template), most_differences(template)
    width, want, have = n + most, Counter(template), Counter()
    if not n or (want & Counter(block)).total() / n < LEAST_WORDS:
        return []
    spare = n - math.ceil(LEAST_WORDS * n - 1e-9) + 1
    opening, closing = set(template[:spare]), set(template[-spare:])
    # Bits of a word: where it stands in the template, from the end, as windows are read backwards.
    bits: dict[str, int] = {}
    for k, w in enumerate(reversed(template)):
        bits[w] = bits.get(w, 0) | 1 << k
    full, common, found = (1 << n) - 1, 0, []
    for i, w in enumerate(block):
        if i >= width and (old := block[i - width]) in want:
            common -= have[old] <= want[old]
            have[old] -= 1
        if w not in want:
            continue
        have[w] += 1
        common += have[w] <= want[w]
        if common / n < LEAST_WORDS or w not in closing:
            continue
        state, best = full, None
        for start in range(i, max(-1, i - width), -1):
            own = bits.get(block[start])
            if not own:
                continue
            met = state & own
            state = (state + met | state - met) & full
            same = n - state.bit_count()  # words in order
            if same / n >= LEAST_WORDS and block[start] in opening:
                differ = n + i + 1 - start - 2 * same
                if differ <= most and (best is None or (-same, differ) < best[:2]):
                    best = (-same, differ, start, i + 1)
        if best:
            found.append(best)
    out, taken = [], set()
    for same, differ, start, past in sorted(found):
        own = range(start, past)
        if taken.isdisjoint(own):
            taken.update(own)
            out.append((-same, differ, start, past))
    return out


def wording(window: list[str], template: list[str]) -> tuple[list[str], list[str]]:
    """The template's words that the window lacks, and the window's words that the template lacks, in order."""
    missing, added = [], []
    for kind, a, b, c, d in difflib.SequenceMatcher(None, template, window, autojunk=False).get_opcodes():
        if kind != "equal":
            missing += template[a:b]
            added += window[c:d]
    return missing, added


def scan_words(words: list[str], templates: dict[str, str]) -> list[tuple[str, float, int, list[str], list[str]]]:
    """Confirmed templates of a block in its order: name, saving, number of words that differ, words missing, words added."""
    own_words = {name: words_of(text) for name, text in templates.items()}
    plain = {name: " ".join(w) for name, w in own_words.items() if w}
    place, out = list(range(len(words))), []
    while words:
        held: list[tuple[int, int, str, float, list]] = []
        for name, saving in savings(" ".join(words), plain):
            if held and saving < held[0][3] - CLOSE * abs(held[0][3]):
                break
            if own := fits(words, own_words[name]):
                held.append((-own[0][0], own[0][1], name, saving, own))
        if not held:
            break
        _, _, name, saving, own = min(held)
        out += [(place[start], name, saving, differ, *(wording(words[start:past], own_words[name]) if differ else ([], []))) for _, differ, start, past in own]
        gone = {i for _, _, start, past in own for i in range(start, past)}
        words, place = [w for i, w in enumerate(words) if i not in gone], [p for i, p in enumerate(place) if i not in gone]
    return [x[1:] for x in sorted(out, key=lambda x: x[0])]


def scan_block(block: str, templates: dict[str, str]) -> list[tuple[str, float, int]]:
    """Confirmed templates of a text taken as one block: name, saving, words that differ."""
    return [x[:3] for x in scan_words(words_of(block), templates)]


@functools.lru_cache(maxsize=4096)
def _cached(words: tuple[str, ...], templates: tuple[tuple[str, str], ...]) -> list[tuple[str, float, int, list[str], list[str]]]:
    return scan_words(list(words), dict(templates))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """``id_col``, n_blocks, found: array of (license, saving, n_differences, missing, added) in the order of the text."""
    fixed = tuple(sorted((templates or TEMPLATES).items()))
    reach = reach_of(dict(fixed))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.list_(pa.string())
        kind = pa.list_(pa.struct([("license", pa.string()), ("saving", pa.float64()), ("n_differences", pa.int64()), ("missing", words), ("added", words)]))
        for rb in batches:
            counts, found = [], []
            for text in rb.column("text").to_pylist():
                own = blocks(text or "", reach)
                counts.append(len(own))
                # Short blocks recur; long ones are not worth keeping.
                per_block = [_cached(tuple(b), fixed) if len(b) < 4 * reach else scan_words(b, dict(fixed)) for b in own]
                found.append([{"license": a, "saving": round(s, 6), "n_differences": d, "missing": m, "added": x} for b in per_block for a, s, d, m, x in b])
            yield pa.RecordBatch.from_arrays([rb.column(id_col), pa.array(counts, pa.int64()), pa.array(found, kind)], names=[id_col, "n_blocks", "found"])

    short_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    found = "array<struct<license:string,saving:double,n_differences:long,missing:array<string>,added:array<string>>>"
    return docs.select(id_col, F.col(text_col).alias("text")).mapInArrow(run, f"{id_col} {kind}, n_blocks long, found {found}")
