"""License scan by canonical digest lookup (operator 7).

A text is put into canonical form (lower case, copyright lines removed, punctuation to single spaces, equivalent
spellings unified), digested, and hash-joined with the digests of known licence texts and notices.  Entire units are
looked up: the whole text, and every line of it, since notices stand on lines of their own.  A digest is computed for
each line whose canonical form is as long as a known one; others cannot match.  The table of known texts is a constant
of this module (under 300 rows) and what a caller adds, so its broadcast is bounded; everything is a map over the
documents.

A copyright line is one of at most ``LINE`` characters that begins, after signs, with the copyright sign, with "(c)"
and a year, or with "copyright" and a sign, a year (or a place for one), "by" or a capitalised holder; or that consists
of "all rights reserved".  A licence's own words after "copyright" stay, wherever its lines are wrapped.

Defined results: null and empty texts match nothing; ties (one canonical form under two names) go to the first name;
repeated rows get equal rows; an empty table gives none; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Equivalent spellings (first is replaced by second), after lower-casing and removal of punctuation.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("merchantibility", "merchantability"),
    ("organisation", "organization"), ("organisations", "organizations"), ("authorised", "authorized"), ("recognised", "recognized"), ("favour", "favor"),
    ("noncommercial", "non commercial"), ("whilst", "while"), ("analogue", "analog"), ("centre", "center"), ("percent", "per cent"), ("https", "http"), ("v2", "version 2"), ("v3", "version 3"),
)

# Licence texts and notices by name, as published.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
BSD3 = BSD2.replace("\nTHIS SOFTWARE", "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\nTHIS SOFTWARE")
ZERO_BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
UNLICENSE_OPENING = "This is free and unencumbered software released into the public domain."
UNLICENSE = UNLICENSE_OPENING + """
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""
BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
GPL_NOTICE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."

# Names used in notices, and identifiers of the SPDX list.
NOTICES = ("Licensed under", "Released under", "Distributed under", "This work is licensed under", "This project is licensed under", "This file is licensed under")
PHRASES = (
    ("MIT", "the MIT License"), ("Apache-2.0", "the Apache License, Version 2.0"), ("BSD-2-Clause", "the BSD 2-Clause License"), ("BSD-3-Clause", "the BSD 3-Clause License"), ("ISC", "the ISC License"),
    ("MPL-2.0", "the Mozilla Public License, version 2.0"), ("GPL-2.0", "the GNU General Public License, version 2"), ("GPL-3.0", "the GNU General Public License, version 3"),
    ("LGPL-2.1", "the GNU Lesser General Public License, version 2.1"), ("LGPL-3.0", "the GNU Lesser General Public License, version 3"), ("AGPL-3.0", "the GNU Affero General Public License, version 3"),
    ("CC0-1.0", "CC0 1.0"), ("Unlicense", "the Unlicense"), ("BSL-1.0", "the Boost Software License, Version 1.0"), ("Zlib", "the zlib License"),
)
CREATIVE = tuple(f"CC-{kind}-{version}" for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for version in ("2.0", "2.5", "3.0", "4.0"))
SPDX = (
    "0BSD", "AFL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-1.1", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-2-Clause-Patent", "BSD-3-Clause", "BSD-3-Clause-Clear", "BSD-4-Clause", "BSL-1.0", "BlueOak-1.0.0",
    "CC0-1.0", "CDDL-1.0", "CDDL-1.1", "CECILL-2.1", "ECL-2.0", "EPL-1.0", "EPL-2.0", "EUPL-1.1", "EUPL-1.2", "FTL", "GFDL-1.3-or-later", "GPL-1.0-or-later", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later",
    "HPND", "ISC", "LGPL-2.0-or-later", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "LPPL-1.3c", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "MS-PL", "MS-RL", "MulanPSL-2.0", "NCSA", "ODbL-1.0", "OFL-1.1", "OSL-3.0",
    "PostgreSQL", "PSF-2.0", "Python-2.0", "Ruby", "SSPL-1.0", "UPL-1.0", "Unlicense", "Vim", "W3C", "WTFPL", "X11", "ZPL-2.1", "Zlib",
)
KNOWN = (
    ("MIT", MIT), ("MIT", "MIT License\n" + MIT), ("MIT", "The MIT License\n" + MIT), ("MIT", "The MIT License (MIT)\n" + MIT),
    ("ISC", ISC), ("ISC", "ISC License\n" + ISC), ("0BSD", ZERO_BSD), ("0BSD", "BSD Zero Clause License\n" + ZERO_BSD),
    ("BSD-2-Clause", BSD2), ("BSD-2-Clause", "BSD 2-Clause License\n" + BSD2), ("BSD-3-Clause", BSD3), ("BSD-3-Clause", "BSD 3-Clause License\n" + BSD3),
    ("Zlib", ZLIB), ("Zlib", "zlib License\n" + ZLIB), ("BSL-1.0", BOOST), ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n" + BOOST), ("Unlicense", UNLICENSE), ("Unlicense", UNLICENSE_OPENING),
    ("Apache-2.0", APACHE_HEADER), ("GPL-3.0-or-later", GPL_NOTICE), ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    *((name, f"{start} {phrase}.") for name, phrase in PHRASES for start in NOTICES),
    *((name, f"{start} {name.replace('CC-', 'CC ').rpartition('-')[0]} {name.rpartition('-')[2]}.") for name in CREATIVE for start in NOTICES[:4]),
    *((name, f"SPDX-License-Identifier: {name}") for name in (*SPDX, *CREATIVE)),
)
#: Length and SHA-256 of the canonical form of whole licences as their stewards publish them.
WHOLE = (
    ("Apache-2.0", 9883, "dbb777d3ad1fb948fbe99e6748cbd3fea3f269381f3f7efe3f4259a28a9269c9"),
    ("Artistic-1.0-Perl", 5653, "f7fec2048e2502b8b653a12ac095bcb0601f72bbd1d535b2e8adf8e097d2f915"),
    ("CC0-1.0", 6692, "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", 19583, "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", 22018, "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GPL-1.0", 11766, "ec8a6b7d70e9f225b63d3962ed5b4721373f5535d7b967a06722b0d621f6892a"),
    ("GPL-2.0", 17118, "331b500eb3c5ee796906547305df82fff4a35b3aa03c1d3ea84d32078292b2e6"),
    ("GPL-3.0", 33406, "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("LGPL-2.0", 24130, "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", 25217, "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", 7104, "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", 22448, "118b2c814d7e3fa57c85f71b240c6a47d353e8acce9164ed6f28305ba85202b2"),
    ("MPL-2.0", 14342, "2ae5d4417f09cff2e3412d0e35c4ee2439f6c18ca69d7d9cc799b33614c368a5"),
)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LINE = 300
COPYRIGHT = (
    r"^[^\p{L}\p{N}©]*(?:©|\((?i:c)\)[\s:]*(?:[0-9]{4}|©)|(?i:copyright)[\s:]*(?:©|\((?i:c)\)|[<\[{(]*(?i:year|yyyy)\b|[0-9]{4}|(?i:by)\s)|Copyright\s+\p{Lu}\p{Ll})"
    r"|^[^\p{L}\p{N}]*(?i:all rights reserved)[^\p{L}\p{N}]*$"
)


def canonical(text: str) -> str:
    """The canonical form in plain Python, for the table of known texts and for tests."""
    text = "\n".join(x for x in text.split("\n") if len(x) > LINE or not regex.search(COPYRIGHT, x))
    text = "".join(c.lower() if c in UPPER else c for c in text)
    words = regex.sub(r"[^\p{L}\p{N}]+", " ", text).split()
    return " ".join(dict(SPELLINGS).get(w, w) for w in words)


def canonical_lines(text: Column) -> Column:
    """The canonical form with the lines kept apart: words have spaces of their own on either side."""
    lines = F.filter(F.split(text, "\n"), lambda x: (F.length(x) > LINE) | ~x.rlike(COPYRIGHT))
    text = F.regexp_replace(F.translate(F.array_join(lines, "\n"), UPPER, UPPER.lower()), r"[^\p{L}\p{N}\n]+", " ")
    text = F.concat(F.lit(" "), F.replace(F.replace(text, F.lit(" "), F.lit("  ")), F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for a, b in SPELLINGS:
        text = F.replace(text, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.regexp_replace(text, " +", " ")


def digest(text: str) -> str:
    return hashlib.sha256(canonical(text).encode()).hexdigest()


def known_digests(more: Iterable[tuple[str, str]] = ()) -> list[tuple[str, str, int]]:
    """(digest, licence, length of the canonical form), the first name of each; ``more`` are a caller's (name, text)."""
    out: dict[str, tuple[str, int]] = {}
    for name, text in (*KNOWN, *more):
        out.setdefault(digest(text), (name, len(canonical(text))))
    for name, length, sha in WHOLE:
        out.setdefault(sha, (name, length))
    return sorted((d, *x) for d, x in out.items())


def known_table(spark: SparkSession, more: Iterable[tuple[str, str]] = ()) -> DataFrame:
    return spark.createDataFrame([x[:2] for x in known_digests(more)], "digest string, license string")


def scan_licenses(docs: DataFrame, more: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """doc_id, text_license (of the whole text or null), n_lines (lines that are a notice), licenses (distinct names of
    both, sorted, comma-joined), canonical_sha256 of the whole text (null: of the empty text).

    ``more``: (name, text) of further licences; the table travels with the plan, so thousands are too many."""
    spark, more = docs.sparkSession, list(more)
    table = known_digests(more)
    known = F.create_map(*[F.lit(x) for row in table for x in row[:2]])
    lengths = F.array(*[F.lit(n) for n in sorted({row[2] for row in table})])
    rows = docs.select(F.col("doc_id").cast("bigint"), canonical_lines(F.coalesce(F.col("text"), F.lit(""))).alias("canon"))
    rows = rows.withColumn("canonical_sha256", F.sha2(F.trim(F.regexp_replace("canon", "[ \n]+", " ")), 256))
    fitting = F.filter(F.transform(F.split("canon", "\n"), lambda x: F.trim(x)), lambda x: F.array_contains(lengths, F.length(x)))
    names = F.filter(F.transform(fitting, lambda x: F.try_element_at(known, F.sha2(x, 256))), lambda x: x.isNotNull())
    rows = rows.select("doc_id", "canonical_sha256", names.alias("names"))
    whole = known_table(spark, more).withColumnsRenamed({"digest": "canonical_sha256", "license": "text_license"})
    rows = rows.join(F.broadcast(whole), "canonical_sha256", "left")  # the constant table and what the caller adds
    every = F.array_sort(F.array_distinct(F.concat("names", F.filter(F.array("text_license"), lambda x: x.isNotNull()))))
    return rows.select("doc_id", "text_license", F.size("names").cast("bigint").alias("n_lines"), F.array_join(every, ",").alias("licenses"), "canonical_sha256")


def oracle() -> str:
    """The same in DuckDB SQL, with every line digested."""
    pattern = COPYRIGHT.replace("'", "''")
    form = f"array_to_string(list_filter(string_split(text, chr(10)), lambda x: length(x) > {LINE} OR NOT regexp_matches(x, '{pattern}')), chr(10))"
    form = f"regexp_replace(translate({form}, '{UPPER}', '{UPPER.lower()}'), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
    form = f"(' ' || replace(replace({form}, ' ', '  '), chr(10), ' ' || chr(10) || ' ') || ' ')"
    for a, b in SPELLINGS:
        form = f"replace({form}, ' {a} ', ' {b} ')"
    values = ", ".join(f"('{d}', '{n}')" for d, n, _ in known_digests())
    return f"""WITH known(digest, license) AS (VALUES {values}),
    docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace({form}, ' +', ' ', 'g') AS canon FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
    lines AS (SELECT r, unnest(string_split(canon, chr(10))) AS line FROM docs),
    hits AS (SELECT r, license FROM (SELECT r, sha256(trim(line, ' ')) AS digest FROM lines) JOIN known USING (digest)),
    whole AS (SELECT r, doc_id, sha256(trim(regexp_replace(canon, '[ \\n]+', ' ', 'g'), ' ')) AS canonical_sha256 FROM docs),
    named AS (SELECT w.r, w.doc_id, w.canonical_sha256, k.license AS text_license FROM whole w LEFT JOIN known k ON k.digest = w.canonical_sha256),
    counts AS (SELECT r, count(*) AS n FROM hits GROUP BY r),
    names AS (SELECT r, string_agg(license, ',' ORDER BY license) AS licenses FROM (SELECT r, license FROM hits UNION SELECT r, text_license FROM named WHERE text_license IS NOT NULL) GROUP BY r)
    SELECT n.doc_id, n.text_license, coalesce(c.n, 0)::BIGINT AS n_lines, coalesce(x.licenses, '') AS licenses, n.canonical_sha256
    FROM named n LEFT JOIN counts c USING (r) LEFT JOIN names x USING (r)"""
