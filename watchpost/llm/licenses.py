"""License scans by canonical digests, in DataFrame functions only.

A text is brought into a canonical form: A-Z lower-cased, copyright lines gone, equivalent spellings made one, everything
but letters and digits turned into single spaces. The SHA-256 of the whole canonical text is hash-joined with the digests of
known licence texts. Each line is made canonical in the same pass, and lines that are a licence notice as a whole are
looked up in the digests of known notices.

Spellings need no look at texts that are far longer than any known one: they change a word by at most `_SLACK` letters, so only
canonical texts within that reach of a known length can match, and only those are rewritten and digested.

Defined cases: null and empty texts, and texts of punctuation alone, match nothing; a known text given twice under different
names takes the first name in order; rows that repeat a doc_id are each scanned. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchpost.llm.common import lower_ascii

# Licence texts and names that must equal the public ones.
_MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_BODY = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org/>"""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_GPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""

#: Licence texts, under their names and with the title that may stand before them.
TEXTS: list[tuple[str, str]] = [
    *((name, f"{title}{body}") for name, titles, body in (
        ("MIT", ("", "MIT License\n\n", "The MIT License\n\n", "The MIT License (MIT)\n\n"), _MIT_BODY),
        ("ISC", ("", "ISC License\n\n", "The ISC License\n\n"), f"{_ISC_BODY}\n\n{_ISC_END}"),
        ("0BSD", ("", "Zero-Clause BSD\n\n", "BSD Zero Clause License\n\n"), f"{_ISC_BODY.split(', provided')[0]}.\n\n{_ISC_END}"),
        ("BSD-2-Clause", ("", "BSD 2-Clause License\n\n", "The 2-Clause BSD License\n\n"), f"{_BSD_HEAD}\n\n{_BSD_END}"),
        ("BSD-3-Clause", ("", "BSD 3-Clause License\n\n", "The 3-Clause BSD License\n\n"), f"{_BSD_HEAD}\n\n{_BSD_NAMES}\n\n{_BSD_END}"),
        ("Unlicense", ("",), _UNLICENSE),
        ("Zlib", ("", "zlib License\n\n", "The zlib/libpng License\n\n"), _ZLIB),
        ("Apache-2.0", ("",), _APACHE_NOTICE),
        ("MPL-2.0", ("",), _MPL_NOTICE),
        ("GPL-2.0", ("",), _GPL_NOTICE.format(n=2)),
        ("GPL-3.0", ("",), _GPL_NOTICE.format(n=3)),
    ) for title in titles),
]
#: Whole texts of long licences, and those that have an end of terms up to there: name, length and words of the
#: canonical text, its SHA-256. Each holds the word licence.
WHOLE: list[tuple[str, int, int, str]] = [
    ("Apache-2.0", 9818, 1587, "7f3470d008308097961c53e56250a1a6cd0cb848a916dc15092d085e6d2e0753"),
    ("Apache-2.0", 8803, 1417, "7690818e56690768555c23e2a9e1bd3fafe07d480a8c6aa90ca3dcec91e173dc"),
    ("Artistic-1.0-Perl", 5832, 982, "7f4e244304ead0e9f2b7143653ae7f6ac6120b733bdca4e38df4fc0c173cd6a8"),
    ("CC0-1.0", 6689, 1085, "4f0f2460054039727d9349df12a36b06f675ac1ac5714dea9c6b47e2902b8406"),
    ("GFDL-1.2", 19583, 3315, "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", 22018, 3732, "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GPL-1.0", 11764, 2066, "1f231247856e736329d0b1ca4841eebfa464227ffd39648c2f86ae604ffb88d6"),
    ("GPL-1.0", 9414, 1640, "485c654369a314feed7a477ce9b48156a341e5d2bbe6ff6dc9af42bc13a43510"),
    ("GPL-2.0", 17116, 2974, "c546972978b8a035b4b2f228ac8d55b1598218f8568113183c1198ebb0889d38"),
    ("GPL-2.0", 14482, 2503, "f895b5613a51e073eccbb5aecc8d8b152ef39ae2acc8b2eb9fc4b11ac1db3a63"),
    ("GPL-3.0", 33405, 5683, "5725838a3ab0b43c9b3eb5bfa24b85b77adcaf3ae956c22259df3ef9700f2ad3"),
    ("GPL-3.0", 30967, 5240, "e374363c7f6b48786da7f9eafed69be1f0e485123aefdf628a53f08352b53516"),
    ("LGPL-2.0", 24129, 4199, "565119bb0dcf5c396f9506a585e8f354662c017a20a99f1ad88de128e0fd3e80"),
    ("LGPL-2.0", 22276, 3864, "2bef69bcf60396a3fc661c8c44257edfb20b8f6876ea592f4732b87446338ee4"),
    ("LGPL-2.1", 25216, 4400, "eca75eaada1ce7417495847f5deab96982ff790fe8d2f64944d806e134f734d0"),
    ("LGPL-2.1", 23364, 4064, "d74190eb254968ffaca621350afbbf4a2d2a8e8c88b6baabae94cb60aefb6e68"),
    ("LGPL-3.0", 7104, 1231, "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", 22317, 3755, "9ae1cf032d3ccc5eee5d4b4fb4723c25e696447f0666bd5d8f2228cd16474233"),
    ("MPL-2.0", 14270, 2413, "08d9ecf388394bc24cafcf6a6808413174206563e79350b03cda79c6dd11425b"),
]
#: How notices name a licence.
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT License", "MIT"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0", "Apache-2.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2", "GPL v2", "GPL-2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3", "GPL v3", "GPL-3.0"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPL v3", "LGPL-3.0"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPL v3", "AGPL-3.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "BSD-3-Clause"),
    "ISC": ("ISC License", "ISC"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL-2.0"),
    "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "CC0-1.0"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0",),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0",),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0",),
}
PHRASES = ("Licensed under {}.", "Licensed under the {}.", "Released under {}.", "Released under the {}.", "Distributed under {}.", "Distributed under the {}.", "This work is licensed under {}.", "This work is licensed under the {}.", "This work is licensed under a {}.", "This project is licensed under the {}.", "This software is released under the {}.", "This file is licensed under the {}.", "SPDX-License-Identifier: {}")
#: Equivalent spellings: whole words in canonical text, and what they become.
SPELLINGS = (("licen[cs]e", "license"), ("licen[cs]es", "licenses"), ("licen[cs]ed", "licensed"), ("sub ?licen[cs]e", "sublicense"), ("non ?infringement", "noninfringement"), ("acknowledge?ment", "acknowledgment"), ("recogni[sz]e", "recognize"), ("organi[sz]ation", "organization"), ("non ?commercial", "noncommercial"), ("as is", "asis"), ("https?", "http"), ("merchantibility", "merchantability"))
_SLACK = 2
COPYRIGHT = r"(?m)^[^a-z0-9\n]*(copyright[ \t]*(\(c\)|©|[<\[{]?[ \t]*([0-9]{4}|year|yyyy)|by )|\(c\)[ \t]|©|all rights reserved)[^\n]*$"
#: Everything in ASCII but letters, digits and the line break, and the usual typographic marks.
MARKS = r"[\x00-\x09\x0b-\x2f\x3a-\x60\x7b-\x7f\x{a0}\x{a9}\x{ab}\x{bb}\x{2010}-\x{2015}\x{2018}-\x{201f}\x{2022}\x{2026}]+"


def _spelling(pattern: str) -> str:
    return rf"\b{pattern}\b"


def _canonical(text: str) -> str:
    """The canonical form of a known text; documents get theirs by the same patterns in Spark."""
    text = text.translate({c: c + 32 for c in range(65, 91)})
    text = re.sub(COPYRIGHT, "", text)
    text = re.sub(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", MARKS), " ", text)
    text = re.sub(r"[ \n]+", " ", text).strip(" ")
    return _respelled(text)


def _respelled(text: str) -> str:
    for pattern, into in SPELLINGS:
        text = re.sub(_spelling(pattern), into, text)
    return text


def known_texts() -> dict[str, str]:
    """Canonical text -> licence."""
    out: dict[str, str] = {}
    for name, text in TEXTS:
        out.setdefault(_canonical(text), name)
    return out


def known_notices() -> dict[str, str]:
    """Canonical notice line -> licence."""
    out: dict[str, str] = {}
    for name, spoken in NAMES.items():
        for s in spoken:
            for phrase in PHRASES:
                out.setdefault(_canonical(phrase.format(s)), name)
    return out


def _reach(known: dict[str, str]) -> int:
    """No text can become a known one that is longer than this before its spellings are made one."""
    return max(len(k) + _SLACK * (k.count(" ") + 1) for k in known)


def _rewritten(text: Column) -> Column:
    for pattern, into in SPELLINGS:
        text = F.regexp_replace(text, _spelling(pattern), into)
    return text


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, license: of the whole text or null, notices: licences of notice lines in order of name, joined by commas,
    n_notices: notice lines) for each row. One broadcast join with the known digests, no shuffle."""
    texts, notices = known_texts(), known_notices()
    reach, line_reach = _reach(texts), _reach(notices)
    far = max([reach, *(n + _SLACK * words for _, n, words, _ in WHOLE)])
    lowered = docs.select("doc_id", lower_ascii(F.coalesce("text", F.lit(""))).alias("t"))
    # Few texts have a copyright line, and a plain search is cheaper than the pattern.
    marked = F.col("t").contains("copyright") | F.col("t").contains("(c)") | F.col("t").contains("©") | F.col("t").contains("all rights reserved")
    spaced = lowered.select("doc_id", F.regexp_replace(F.when(marked, F.regexp_replace("t", COPYRIGHT, "")).otherwise(F.col("t")), MARKS, " ").alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(x) <= line_reach + 2)
    # A notice holds one of these words in any spelling.
    lines = F.filter(lines, lambda x: x.contains("licen") | x.contains("under"))
    whole = F.trim(F.regexp_replace("t", "[ \n]+", " "))
    letters = F.length(F.translate("t", " \n", ""))
    # Only what a known text's length allows, and beyond the short ones only what names a licence, is worth making canonical to the end.
    short = spaced.select("doc_id", F.when((letters <= reach) | (letters <= far) & F.col("t").contains("licen"), whole).alias("whole"), lines.alias("lines"))
    table = F.create_map(*[F.lit(x) for text, name in notices.items() for x in (hashlib.sha256(text.encode()).hexdigest(), name)])
    found = F.filter(F.transform("lines", lambda x: F.element_at(table, F.sha2(_rewritten(F.trim(x)), 256))), lambda x: x.isNotNull())
    digest = F.when(F.length("whole").between(1, far), F.sha2(_rewritten(F.col("whole")), 256))
    digested = short.select("doc_id", digest.alias("digest"), F.when(F.size("lines") > 0, found).otherwise(F.array().cast("array<string>")).alias("found"))
    known = docs.sparkSession.createDataFrame([(hashlib.sha256(t.encode()).hexdigest(), name) for t, name in texts.items()] + [(digest, name) for name, _, _, digest in WHOLE], "digest string, license string")
    return digested.join(F.broadcast(known), "digest", "left").select("doc_id", "license", F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notices"), F.size("found").cast("long").alias("n_notices"))


def duckdb_sql() -> str:
    """The scan for DuckDB over a view `documents`."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def respelled(x: str) -> str:
        for pattern, into in SPELLINGS:
            x = f"regexp_replace({x}, {quoted(_spelling(pattern))}, {quoted(into)}, 'g')"
        return x

    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    texts = ", ".join(f"({quoted(t)}, {quoted(name)})" for t, name in known_texts().items())
    notices = ", ".join(f"({quoted(t)}, {quoted(name)})" for t, name in known_notices().items())
    digests = ", ".join(f"({quoted(digest)}, {quoted(name)})" for name, _, _, digest in WHOLE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(regexp_replace({low}, {quoted(COPYRIGHT)}, '', 'g'), {quoted(MARKS)}, ' ', 'g') AS t FROM documents),
texts(whole, license) AS (VALUES {texts}),
digests(digest, license) AS (VALUES {digests}),
notices(line, license) AS (VALUES {notices}),
w AS (SELECT r, doc_id, {respelled("trim(regexp_replace(t, '[ ' || chr(10) || ']+', ' ', 'g'), ' ')")} AS whole FROM d),
s AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
l AS (SELECT s.r, n.license FROM (SELECT r, {respelled("trim(regexp_replace(line, ' +', ' ', 'g'), ' ')")} AS line FROM s WHERE line LIKE '%licen%' OR line LIKE '%under%') s JOIN notices n ON s.line = n.line),
f AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(*) AS n_notices FROM l GROUP BY r)
SELECT w.doc_id, coalesce(texts.license, digests.license) AS license, coalesce(f.notices, '') AS notices, coalesce(f.n_notices, 0) AS n_notices
FROM w LEFT JOIN texts ON w.whole = texts.whole LEFT JOIN digests ON sha256(w.whole) = digests.digest LEFT JOIN f ON w.r = f.r
"""
