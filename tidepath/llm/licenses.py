"""Licence scans by sentences and rules, in DataFrame functions only.

Normalised sentences of known licence texts have identifiers. A document's sentences are looked up, wrapped over
lines or not, and the sequence of identifiers found is matched against ordered rules, longest first; what a rule has matched is not
matched again by a later one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and notices, by identifier.
SENTENCES = {
    1: "Released under the MIT License.",
    2: "Licensed under the Apache License, Version 2.0.",
    3: "Licensed under CC BY-NC 4.0.",
    4: "This work is licensed under the GNU General Public License, version 3.",
    10: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    11: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    12: "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    13: "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    14: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    15: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    16: "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    17: "This software is provided 'as-is', without any express or implied warranty.",
    18: "In no event will the authors be held liable for any damages arising from the use of this software.",
    19: "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    20: "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    21: "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    22: "See the License for the specific language governing permissions and limitations under the License.",
    23: "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    25: "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    26: "Distributed under the Boost Software License, Version 1.0.",
    27: "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    28: "This is free and unencumbered software released into the public domain.",
    29: "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    30: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    31: "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    32: "See the GNU General Public License for more details.",
    33: "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    34: "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    35: "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    36: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    37: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    40: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    41: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    42: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    43: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    44: "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    50: "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    51: "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    52: "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    53: "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    54: "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    55: "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    56: "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    60: "This work is dedicated to the public domain.",
    61: "This project is licensed under the MIT License.",
    62: "This project is licensed under the Apache License 2.0.",
    63: "This project is licensed under the BSD 3-Clause License.",
}
# Rules in the order they apply.
RULES = [
    ("mit-full", "MIT", (10, 11, 12, 13)),
    ("mit-terms", "MIT", (10, 11, 12)),
    ("isc-full", "ISC", (14, 16)),
    ("0bsd-full", "0BSD", (15, 16)),
    ("zlib-full", "Zlib", (17, 18, 19)),
    ("apache-header", "Apache-2.0", (20, 21, 23, 22)),
    ("apache-header-short", "Apache-2.0", (20, 21, 22)),
    ("mpl2-header", "MPL-2.0", (25,)),
    ("unlicense-full", "Unlicense", (28, 29)),
    ("gpl3-header", "GPL-3.0-or-later", (30, 31, 32)),
    ("gpl2-header", "GPL-2.0-or-later", (33, 31, 32)),
    ("gpl2-only-header", "GPL-2.0-only", (34, 31, 32)),
    ("bsd-3-full", "BSD-3-Clause", (40, 41, 42, 43, 44)),
    ("bsd-3", "BSD-3-Clause", (40, 41, 42, 43)),
    ("bsd-2-full", "BSD-2-Clause", (40, 41, 42, 44)),
    ("bsd-2", "BSD-2-Clause", (40, 41, 42)),
    ("mit-short", "MIT", (10, 11)),
    ("isc-start", "ISC", (14,)),
    ("apache-start", "Apache-2.0", (20,)),
    ("unlicense-start", "Unlicense", (28,)),
    ("gpl3-start", "GPL-3.0-or-later", (30,)),
    ("gpl2-start", "GPL-2.0-or-later", (33,)),
    ("gpl2-only-start", "GPL-2.0-only", (34,)),
    ("lgpl21-start", "LGPL-2.1-or-later", (35,)),
    ("lgpl3-start", "LGPL-3.0-or-later", (36,)),
    ("agpl3-start", "AGPL-3.0-or-later", (37,)),
    ("boost-notice", "BSL-1.0", (26,)),
    ("epl2-notice", "EPL-2.0", (27,)),
    ("mit-notice", "MIT", (1,)),
    ("mit-project", "MIT", (61,)),
    ("apache-notice", "Apache-2.0", (2,)),
    ("apache-project", "Apache-2.0", (62,)),
    ("bsd-3-project", "BSD-3-Clause", (63,)),
    ("cc-by-nc-notice", "CC-BY-NC-4.0", (3,)),
    ("gpl3-notice", "GPL-3.0-only", (4,)),
    ("cc-by-notice", "CC-BY-4.0", (50,)),
    ("cc-by-sa-notice", "CC-BY-SA-4.0", (51,)),
    ("cc-by-nc-full", "CC-BY-NC-4.0", (52,)),
    ("cc-by-nd-notice", "CC-BY-ND-4.0", (53,)),
    ("cc-by-nc-sa-notice", "CC-BY-NC-SA-4.0", (54,)),
    ("cc-by-nc-nd-notice", "CC-BY-NC-ND-4.0", (55,)),
    ("cc0-notice", "CC0-1.0", (56,)),
    ("public-domain", "Public-Domain", (60,)),
]
SPLIT = r"(?<=[.!?;:])[\x20\x09-\x0D]+|[\x0A-\x0D]+"
NOISE = r"[^a-z0-9]+"
#: In lower-cased text capitals are free for marks: where a sentence ends by a terminal, and by a line end alone.
END, LINE = "E", "L"
#: What stands between words of one sentence: a blank, or line ends with lines or comment prefixes between them that have no words.
BETWEEN = f"(?: |{LINE}[{LINE}{END}]*)"


def normalise(sentence: str) -> str:
    return re.sub(NOISE, " ", sentence.lower()).strip()


def split_known(sentences: dict[int, str]) -> tuple[list[tuple[int, str]], dict[int, tuple[int, ...]]]:
    """The known pieces (id, normalised text), and the pieces of each sentence: a known sentence is split as documents are."""
    pieces: dict[str, int] = {}
    parts = {k: tuple(pieces.setdefault(n, len(pieces)) for x in re.split(r"(?<=[.!?;:])\s+|[\n-\r]+", s) if (n := normalise(x))) for k, s in sentences.items()}
    return [(i, t) for t, i in pieces.items()], parts


def _anchors(pieces: list[tuple[int, str]]) -> list[str]:
    """Words such that every known piece has one: a sentence without any of them is unknown, so it need not be normalised."""
    left, chosen = [set(t.split()) for _, t in pieces], []
    while left:
        words = {w for s in left for w in s}
        best = max(sorted(words), key=lambda w: sum(w in s for s in left) * min(len(w), 8) ** 2)
        chosen.append(best)
        left = [s for s in left if best not in s]
    return chosen


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[int, str] | None = None, rules: list | None = None) -> DataFrame:
    """doc_id, licenses, rules, n_sentences, first_sentence, last_sentence for each row in which a rule matches; others give no row.

    licenses and rules are sorted distinct names joined by commas; positions count a document's sentences from 0.
    A known sentence may be wrapped over lines, with comment prefixes of signs (*, #, //, ;), and has the
    position of its first line; at one place the longest known sentence counts. A rule matches where its
    sentences follow each other in the sequence of known sentences, whatever unknown ones stand between. Null
    and empty texts match nothing; a repeated row gives its own result.
    """
    pieces, parts = split_known(sentences or SENTENCES)
    lower = F.lower("text")
    has_anchor = None
    for w in _anchors(pieces):
        has_anchor = lower.contains(w) if has_anchor is None else has_anchor | lower.contains(w)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(has_anchor)
    marked = F.regexp_replace(F.regexp_replace(lower, r"(?<=[.!?;:])[\x20\x09-\x0D]+", END), r"[\x0A-\x0D]+", LINE)
    plain = F.regexp_replace(F.regexp_replace(marked, rf"[^a-z0-9{END}{LINE}]+", " "), f" ?([{END}{LINE}]) ?", "$1")
    longest = sorted((t.split() for _, t in pieces), key=lambda x: (-len(x), x))
    any_known = "|".join(BETWEEN.join(x) for x in longest)
    # the known sentences and, outside of them, the marks, in order
    steps = F.regexp_extract_all(F.trim(plain), F.lit(f"(?<![a-z0-9 ])(?:{any_known})(?![a-z0-9 ])|[{END}{LINE}]"), F.lit(0))
    rows = rows.select("doc_id", steps.alias("steps"))
    is_mark = lambda x: x.isin(END, LINE)
    rows = rows.select("doc_id", "steps", F.filter("steps", lambda x: ~is_mark(x)).alias("known")).filter(F.size("known") > 0)
    ids = F.create_map(*[F.lit(x) for i, t in pieces for x in (t, i)])
    marks = lambda x: F.length(F.regexp_replace(x, f"[^{END}{LINE}]+", ""))
    leading = F.regexp_extract(F.array_join("steps", ""), f"^[{END}{LINE}]*", 0)
    # of the marks, those before the last known sentence
    trailing = F.regexp_extract(F.reverse(F.array_join("steps", "")), f"^[{END}{LINE}]*", 0)
    last = marks(F.array_join("steps", "")) - F.length(trailing) - marks(F.element_at("known", -1))
    found = F.transform("known", lambda x: F.element_at(ids, F.regexp_replace(x, f"[{END}{LINE}]+", " ")))
    per = rows.select("doc_id", found.alias("found"), F.length(leading).alias("first_sentence"), last.alias("last_sentence"))
    left: Column = F.concat(F.lit(","), F.array_join(F.transform("found", lambda x: x.cast("string")), ",,"), F.lit(","))
    per = per.withColumn("left", left)
    named = []
    for name, spdx, ids in rules or RULES:
        pattern = "".join(f",{p}," for i in ids for p in parts[i])
        per = per.withColumn(f"r_{len(named)}", F.col("left").contains(pattern)).withColumn("left", F.replace("left", F.lit(pattern), F.lit("|")))
        named.append((name, spdx))
    take = lambda k: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.col(f"r_{i}"), F.lit(x[k])) for i, x in enumerate(named)])))), ",")
    return per.select("doc_id", take(1).alias("licenses"), take(0).alias("rules"), F.size("found").alias("n_sentences"), "first_sentence", "last_sentence").filter("licenses <> ''")
