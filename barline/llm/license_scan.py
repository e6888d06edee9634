"""License scan: notices in documents by the Dice coefficient over word bigrams.

A text's words are its runs of letters and digits, lower-cased; line ends, sentence ends and comment marks don't count. A template
is compared with windows of the words: Dice = 2 * shared bigrams / (bigrams of the window + bigrams of the template), repeats
counted. For a coefficient of T the sizes must satisfy T / (2 - T) <= window / template <= (2 - T) / T, which rules out all
templates that a text is too short for, and all windows of other sizes. The best windows start and end at bigrams of the template,
and need at least T / (2 - T) times the template's bigrams in reach of each other, so only such places are looked at.

Each text is scanned in its row, in Arrow batches; the templates travel with the function.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least coefficient of a match.
THRESHOLD = 0.8
#: Characters of a text whose words are listed at once; a longer text's are found one by one.
WORDS_AT_ONCE = 1 << 20
#: Public licence notices and texts, by SPDX name where there is one.
TEMPLATES = {
    "0BSD": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "AGPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "All rights reserved": "All rights reserved.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-2-Clause conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-3-Clause line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSL-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "CC-BY-4.0 line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-2.0 notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "ISC permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.1 notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MIT line": "Released under the MIT License.",
    "MIT permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <http://unlicense.org/>',
    "Unlicense line": "This is free and unencumbered software released into the public domain.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}

_WORD = re.compile(r"[^\W_]+")


def bigrams(text: str) -> list[tuple[str, str]]:
    words = _WORD.findall(text.lower())
    return list(zip(words, words[1:], strict=False))


class Scanner:
    """Finds windows of texts that are alike to templates."""

    def __init__(self, templates: dict[str, str] | None = None, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.counts = {name: Counter(bigrams(text)) for name, text in sorted((templates or TEMPLATES).items())}
        self.sizes = {name: counts.total() for name, counts in self.counts.items()}
        self.holders: dict[tuple[str, str], list[str]] = {}  # the templates that have a bigram
        for name, counts in self.counts.items():
            for gram in counts:
                self.holders.setdefault(gram, []).append(name)

    def hits(self, text: str) -> tuple[dict[str, list[tuple[int, tuple[str, str]]]], int]:
        """By template, places of its bigrams in the text; and the text's number of bigrams."""
        text, n, found = text.lower(), -1, {}
        words = _WORD.findall(text) if len(text) <= WORDS_AT_ONCE else (m.group() for m in _WORD.finditer(text))
        before, holders = "", self.holders.get
        for n, word in enumerate(words):
            for name in holders((before, word), ()):
                found.setdefault(name, []).append((n - 1, (before, word)))
            before = word
        return found, n

    def windows(self, name: str, hits: list[tuple[int, tuple[str, str]]]) -> list[tuple[float, str, int, int]]:
        """(coefficient, template, first bigram, last bigram): of windows that overlap, the one of the highest coefficient."""
        size, wanted = self.sizes[name], self.counts[name]
        ratio = self.threshold / (2 - self.threshold)
        least, widest = math.ceil(ratio * size - 1e-9), math.floor(size / ratio + 1e-9)
        found: list[tuple[float, str, int, int]] = []
        for i in range(len(hits) - least + 1):
            start = hits[i][0]
            if hits[i + least - 1][0] - start >= widest:
                continue
            left, shared, best = dict.fromkeys(wanted, 0), 0, None
            for at, gram in hits[i : i + widest]:
                if at - start >= widest:
                    break
                if left[gram] < wanted[gram]:
                    left[gram] += 1
                    shared += 1
                    dice = 2 * shared / (at - start + 1 + size)
                    if dice >= self.threshold and (best is None or dice > best[0]):
                        best = dice, name, start, at
            if best is None:
                continue
            if found and found[-1][3] >= start:
                if best[0] > found[-1][0]:
                    found[-1] = best
            else:
                found.append(best)
        return found

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(template, coefficient, first word, number of words) of the matches, in the text's order. Of matches that overlap, the
        one that shares the most bigrams with its template stays (a licence rather than a part of it), ties to the higher
        coefficient and the first name."""
        hits, n = self.hits(text or "")
        ratio = self.threshold / (2 - self.threshold)
        found = []
        for name, places in hits.items():
            if ratio * self.sizes[name] <= min(n, len(places)) + 1e-9:
                found += self.windows(name, places)
        chosen: list[tuple[float, str, int, int]] = []
        for match in sorted(found, key=lambda x: (-round(x[0] * (x[3] - x[2] + 1 + self.sizes[x[1]])), -x[0], x[1], x[2])):
            at = bisect.bisect(chosen, match[2], key=lambda x: x[2])
            if (at == 0 or chosen[at - 1][3] < match[2]) and (at == len(chosen) or match[3] < chosen[at][2]):
                chosen.insert(at, match)
        return [(name, dice, start, stop - start + 2) for dice, name, start, stop in chosen]


def scan(docs: DataFrame, text: str = "text", into: str = "licenses") -> DataFrame:
    """docs with an array of structs (template, dice, start, words): every window of the text that matches a template.

    [] for a null or empty text, or one without matches; whole texts are scanned, however long. A column of that name is
    replaced; rows are scanned each by itself, repeated ones too. An empty table gives no rows.
    """
    kind = "array<struct<template:string,dice:double,start:int,words:int>>"

    @F.arrow_udf(kind)
    def matches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner()
        to = pa.list_(pa.struct([("template", pa.string()), ("dice", pa.float64()), ("start", pa.int32()), ("words", pa.int32())]))
        for texts in batches:
            rows = [[{"template": a, "dice": b, "start": c, "words": d} for a, b, c, d in scanner.scan(t.as_py())] for t in texts]
            yield pa.array(rows, to)

    return docs.withColumn(into, matches(F.col(text)))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, license (template of the highest coefficient, ties to the longest window and then the first name; null without a
    match), dice, n_notices (windows that match, none of which overlap) and flagged of every row."""
    best = F.array_sort(F.transform("licenses", lambda x: F.struct((-x["dice"]).alias("order"), (-x["words"]).alias("length"), x["template"].alias("template"))))
    found = scan(docs.select("doc_id", "text")).withColumn("best", F.get(best, F.lit(0)))
    return found.select(
        "doc_id",
        F.col("best.template").alias("license"),
        (-F.col("best.order")).alias("dice"),
        F.size("licenses").cast("long").alias("n_notices"),
        F.col("best").isNotNull().alias("flagged"),
    )
