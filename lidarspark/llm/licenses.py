"""License scans by canonical digest.

A text is brought to a canonical form (case, punctuation, copyright lines and equivalent
spellings don't count), hashed, and joined to the digests of known licence texts. Whole
documents are matched with whole licences, and their lines with whole licence notices.

Short licences are kept as texts, long ones as the digests of their canonical forms; a table of
further texts can be given.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

# Equivalent spellings, as (pattern, canonical form, what both hold) on lower-cased text of single spaces.
SPELLINGS = (
    (r"\blicence", "license", "licen"),
    (r"\bfavour", "favor", "favo"),
    (r"\bwhilst\b", "while", "whil"),
    (r"\bjudgement", "judgment", "judg"),
    (r"\bper cent\b", "percent", "cent"),
    (r"\bnon commercial", "noncommercial", "commercial"),
    (r"\bsub licens", "sublicens", "licen"),
    (r"\bhttps\b", "http", "http"),
    (r"\bversion 2 0\b", "version 2", "version"),
    (r"\bversion 3 0\b", "version 3", "version"),
)

# Licence notices of one line, with their SPDX identifiers.
NOTICES = {
    "Released under the MIT License.": "MIT",
    "Licensed under the MIT License.": "MIT",
    "This project is licensed under the MIT License.": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Licensed under the Apache License, Version 2.0 (the \"License\").": "Apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only",
    "Licensed under the GNU General Public License, version 3.": "GPL-3.0-only",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Licensed under CC BY 4.0.": "CC-BY-4.0",
    "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
    "SPDX-License-Identifier: MIT": "MIT",
    "SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    "SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause",
}

# Public licence texts without their copyright lines.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_BSD_CLAUSES = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_2 = f"{_BSD_GRANT}\n\n{_BSD_CLAUSES}\n\n{_BSD_WARRANTY}"
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_3 = f"{_BSD_GRANT}\n\n{_BSD_CLAUSES}\n\n{_BSD_NAMES}\n\n{_BSD_WARRANTY}"
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <http://unlicense.org/>"""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
_GPL_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <http://www.gnu.org/licenses/>."""
LICENSES = {
    "Apache-2.0": [_APACHE_HEADER],
    "BSD-2-Clause": [_BSD_2, "BSD 2-Clause License\n\n" + _BSD_2],
    "BSD-3-Clause": [_BSD_3, "BSD 3-Clause License\n\n" + _BSD_3],
    "GPL-3.0-or-later": [_GPL_HEADER],
    "MPL-2.0": [_MPL_HEADER],
    "Unlicense": [_UNLICENSE],
    "MIT": [_MIT, "MIT License\n\n" + _MIT, "The MIT License (MIT)\n\n" + _MIT],
    "ISC": [_ISC, "ISC License\n\n" + _ISC],
    "Zlib": [_ZLIB, "zlib License\n\n" + _ZLIB],
}


#: A copyright line: one that begins with a sign, or with the word before a year, a sign or a reservation of rights.
COPYRIGHT = r"(^|\n)[ \t#/*;-]*((\(c\)|©)[^\n]*|copyright[^\n]*((19|20)[0-9][0-9]|\(c\)|©|all rights)[^\n]*)"


def canonical(text: Column) -> Column:
    """Lower case; copyright lines gone; runs of anything but a-z and 0-9 one space; one spelling."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT, "\n")
    out = F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))
    for pattern, plain, _ in SPELLINGS:
        out = F.regexp_replace(out, pattern, plain)
    return out


# SHA-256 of the canonical forms of long licence texts, as their publishers give them.
DIGESTS = {
    "7d7de032bbe86e42d75b39048ddf03bb9391b6401cf958a89abe537b350d55a6": "Apache-2.0",
    "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f": "CC0-1.0",
    "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224": "GPL-1.0-only",
    "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821": "GPL-2.0-only",
    "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a": "GPL-3.0-only",
    "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908": "LGPL-2.0-only",
    "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891": "LGPL-2.1-only",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0-only",
    "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6": "MPL-1.1",
    "4e8846f73619955307f302e00350d36240da6319b9a40e68e67486570e5a137e": "MPL-2.0",
}
#: Licence texts, and notices of one line, that may be sent to all executors.
KNOWN, KNOWN_NOTICES = 100_000, 1000


def known(spark: SparkSession, texts: DataFrame | None = None) -> DataFrame:
    """(digest, license, notice, form) of the known texts; of several licences of one digest the first by name.

    texts: further (text, license, notice boolean) rows, of which null texts and licences don't
    count, nor notices without a letter or digit; a null notice is none. The canonical form is
    given for notices.
    """
    rows = [(t, k, False) for k, ts in LICENSES.items() for t in ts] + [(t, k, True) for t, k in NOTICES.items()]
    own = spark.createDataFrame(rows, "text string, license string, notice boolean")
    if texts is not None:
        own = own.union(texts.select("text", "license", F.coalesce("notice", F.lit(False))).where("text is not null and license is not null"))
    digests = spark.createDataFrame([(d, k, False, None) for d, k in DIGESTS.items()], "digest string, license string, notice boolean, form string")
    formed = own.select(canonical(F.col("text")).alias("form"), "license", "notice").where("not notice or form <> ''")
    every = formed.select(F.sha2("form", 256).alias("digest"), "license", "notice", F.when(F.col("notice"), F.col("form")).alias("form")).union(digests)
    return every.groupBy("digest", "notice").agg(F.min("license").alias("license"), F.min("form").alias("form"))


def part_of(form: str) -> str:
    """What any line of a canonical form holds in lower case, however it is spelt and set: a part of one of its words."""
    parts = []
    for word in form.split():
        same = [kept for _, plain, kept in SPELLINGS if plain.split()[0] in word]
        parts += same or [word]
    return max(parts, key=lambda p: (p == "licen", len(p), p))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: DataFrame | None = None) -> DataFrame:
    """doc_id, digest, license, notices, n_notice_lines of every row of ``docs``; no shuffle of them.

    license: of which the whole text is a copy, else null; notices: the identifiers of the
    lines that are known notices, sorted, comma-separated, empty if none. A null text has a null
    digest and no findings; an empty text has the digest of the empty text. A null doc_id and
    repeated rows are judged like others; an empty table gives an empty result. Further known
    ``texts`` are described at :func:`known`. Other columns are not read. Only lines that hold
    a word that some notice can't be written without are brought to their canonical form.
    """
    table = cut(known(docs.sparkSession, texts))
    listed = table.where("notice").limit(KNOWN_NOTICES + 1).collect()
    wholes, notes = table.where("not notice"), {r.digest: r.license for r in listed}
    if wholes.count() > KNOWN or len(notes) > KNOWN_NOTICES:
        raise ValueError(f"over {KNOWN} known texts or {KNOWN_NOTICES} notices")
    wholes = F.broadcast(wholes.select(F.col("digest").alias("d"), "license"))
    by_digest = F.from_json(F.lit(json.dumps(notes)), "map<string,string>")
    parts = sorted({part_of(r.form) for r in listed})
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: reduce(Column.__or__, [F.lower(x).contains(p) for p in parts]))
    found = F.filter(F.transform(lines, lambda x: F.try_element_at(by_digest, F.sha2(canonical(x), 256))), lambda x: x.isNotNull())
    judged = read.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest"), F.coalesce(found, F.array().cast("array<string>")).alias("found"))
    return judged.join(wholes, F.col("digest") == F.col("d"), "left").select("doc_id", "digest", "license", F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notices"), F.size("found").cast("long").alias("n_notice_lines"))


def scan_sql() -> str:
    def quote(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def canon(x: str) -> str:
        out = f"regexp_replace(lower({x}), {quote(COPYRIGHT)}, chr(10), 'g')"
        out = f"trim(regexp_replace({out}, '[^a-z0-9]+', ' ', 'g'))"
        for pattern, plain, _ in SPELLINGS:
            out = f"regexp_replace({out}, {quote(pattern)}, {quote(plain)}, 'g')"
        return f"sha256({out})"

    values = lambda rows: ", ".join(f"({quote(t)}, {quote(k)})" for t, k in rows)
    return f"""
WITH wholes AS (SELECT digest, min(license) AS license FROM (
  SELECT {canon("t")} AS digest, license FROM (VALUES {values([(t, k) for k, ts in LICENSES.items() for t in ts])}) v(t, license)
  UNION ALL SELECT d, license FROM (VALUES {values(DIGESTS.items())}) w(d, license)) GROUP BY digest),
notes AS (SELECT DISTINCT {canon("t")} AS line, license AS id FROM (VALUES {values(NOTICES.items())}) v(t, license)),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents),
found AS (SELECT doc_id, string_agg(DISTINCT id, ',' ORDER BY id) AS notices, count(*) AS n_notice_lines
  FROM (SELECT doc_id, {canon("l")} AS line FROM lines) x JOIN notes USING (line) GROUP BY doc_id),
judged AS (SELECT doc_id, {canon("text")} AS digest FROM documents)
SELECT j.doc_id, j.digest, w.license, coalesce(f.notices, '') AS notices, coalesce(f.n_notice_lines, 0) AS n_notice_lines
FROM judged j LEFT JOIN wholes w USING (digest) LEFT JOIN found f ON j.doc_id = f.doc_id"""
