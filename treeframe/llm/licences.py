"""Licence scan by canonical digests.

A text is brought to a canonical form (lower case, words only, copyright lines gone, equivalent spellings made one)
and the digest of the whole form is hash-joined to the digests of known licences. Units are whole documents and
single lines: licence files match as documents, notices match as lines. Texts are read and normalised once; no row of
theirs is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, let, read

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_0BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""

_NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"),
    "MIT": ("MIT License", "MIT"),
    "BSD-2-Clause": ("BSD 2-Clause License", "BSD-2-Clause", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "BSD-3-Clause", "New BSD License"),
    "ISC": ("ISC License", "ISC"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL version 2", "GPL-2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL version 3", "GPL-3.0"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPL-3.0"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPL-3.0"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "MPL-2.0"),
    "CC-BY-4.0": ("CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "CC-BY-ND-4.0"),
    "CC0-1.0": ("CC0 1.0 Universal", "CC0-1.0"),
}
_FRAMES = ("{}", "The {}", "Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}", "This work is licensed under {}", "This work is licensed under the {}", "This project is licensed under the {}", "This file is licensed under the {}", "SPDX-License-Identifier: {}", "License: {}", "Distributed under the {}")

#: (licence, text) of the known licences: whole texts, with and without their titles, and one-line notices.
KNOWN: tuple[tuple[str, str], ...] = (
    *((k, f"{title}\n{body}") for k, titles, body in (
        ("MIT", ("", "MIT License", "The MIT License", "The MIT License (MIT)"), _MIT),
        ("ISC", ("", "ISC License", "The ISC License"), f"{_ISC}\n{_ISC_END}"),
        ("0BSD", ("", "BSD Zero Clause License", "Zero-Clause BSD"), f"{_0BSD}\n{_ISC_END}"),
        ("BSD-2-Clause", ("", "BSD 2-Clause License", "The 2-Clause BSD License"), f"{_BSD}\n{_BSD_END}"),
        ("BSD-3-Clause", ("", "BSD 3-Clause License", "The 3-Clause BSD License"), f"{_BSD}\n{_BSD_3}\n{_BSD_END}"),
        ("Zlib", ("", "zlib License", "The zlib/libpng License"), _ZLIB),
        ("Apache-2.0", ("",), _APACHE),
        ("GPL-3.0", ("",), _GPL),
        ("MPL-2.0", ("",), _MPL),
    ) for title in titles),
    *((k, frame.format(name)) for k, names in _NAMES.items() for name in names for frame in _FRAMES),
)

#: A line that only claims copyright: "Copyright (c) 2020 Some One", "All rights reserved."
COPYRIGHT_LINE = r"(?im)^[\x20\x09]*(?:[#/*;-]+[\x20\x09]*)?(?:(?:copyright\b|\(c\)[\x20\x09]|©)[^\n]*|all rights reserved\.?[\x20\x09]*)$"
#: Spellings that count as equal, on text that is already lower case and words only.
SPELLINGS = (
    (r"\blicence", "license"), (r"\bsub licens", "sublicens"), (r"\backnowledgement", "acknowledgment"), (r"\bauthoris", "authoriz"), (r"\borganis", "organiz"), (r"\brecognis", "recogniz"),
    (r"\bfavour", "favor"), (r"\bwhilst\b", "while"), (r"\bnon infringement\b", "noninfringement"), (r"\bnon commercial\b", "noncommercial"), (r"\bcopyright (?:owner|holder)(s?)\b", "copyright holder$1"),
    (r"\bhttps\b", "http"), (r"\bversion\b", "v"), (r"\bv ?([0-9])", "$1"),
)


ANY_SPELLING = "|".join(pattern for pattern, _ in SPELLINGS)
#: The most known licences that scan() takes: they are broadcast, with some 100 bytes each.
MOST_KNOWN = 100_000

# Licence, SHA-256 of the canonical form of its whole text as its steward publishes it, or of that up to the end of its terms.
DIGESTS: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "71264946caf93a60bb62674083c012cf4eab5157b06da8e8346ab6b7178b287f"),
    ("Apache-2.0", "e1844670195f45de50c08db83410192bf47a169fdd11a4c8f00fd51b246832e1"),
    ("Apache-2.0", "acf9a940a36ac817e2471245c4b5d58245223025092047147b8daac3f45cdfa6"),
    ("GPL-1.0", "00d0bcf4da868d5792d52300a0519c6d97d3e6d7c5456c2de304b77928c2cc89"),
    ("GPL-1.0", "c7ae631ccb47e5ecd29638c1a48131fa9f56d64abc64b45878f0fffdd6fef45e"),
    ("GPL-1.0", "287413b32d5a897a2c0d474534d228c97c0ef9f94bb659c0430a9de2fd39c458"),
    ("GPL-2.0", "90f866845992c01751059b0f542759f9d4ef4ec01c48f8602d619781c23f71b2"),
    ("GPL-2.0", "d447718335b74b0f106659ea4ba27e1aa26abfe1d50c641e3020cc8ad97ca35d"),
    ("GPL-2.0", "671e97b958adf34c49f0ddebde8976f10f4108c8b21289564ec0800c82519cc8"),
    ("GPL-3.0", "0e7cdc432e6088c9ee813dabf3e456787d276f3fb033d05ea1aa384210242b7a"),
    ("GPL-3.0", "2cff9b4acea8a772999d22c176a2f8810c33fce5bbc2830572503c83f819b748"),
    ("GPL-3.0", "87beded8e098b4a9d06f0546697fc450f2d8e7d74a53858273a60919c99a651f"),
    ("LGPL-2.0", "02bb592bdf3815a31b8d754f7e132c68a896876622f155d15d0d8790b103745e"),
    ("LGPL-2.0", "c6cac8bb45bb0e67079e69bf18cf3a26b830d7bad3fc0af0dd9833f67cc9683e"),
    ("LGPL-2.0", "537cf6d02a6d38ca9ad4666054770851584eb6eb935c1d3908879c7efc53a7de"),
    ("LGPL-2.1", "35914b6bc1b3fda346f343a0026d9edbe5fd3422c503d6a28f216749eb36861d"),
    ("LGPL-2.1", "20ff4fe5bcafb5a833658fcdfebcbb407a9e35f98ff8fc70d59eddd43b026fb5"),
    ("LGPL-2.1", "a3d9db8b55e3bca21eace455c68682a182b80fab23ddb3e280766fc7e2048064"),
    ("LGPL-3.0", "1a17309708ea02112922c07614fea775b42d64a85754a7183269667ccf32499e"),
    ("MPL-1.1", "8f0a39d062959653abddc7ba3a9943f2733ea30cdf96a5d8b77abfa0370f6ff1"),
    ("MPL-2.0", "11355ad6ccad8d3c57561c2eb8717baf11a86109ad7cd6624893047ec0fd21c1"),
    ("CC0-1.0", "1857a6817be463d903691bfa09d4f345ab7f4ed86a5db2a5966c03b160057e4a"),
    ("Artistic-1.0-Perl", "a4fed5ce5b868ffcbd8eef16f208fd74576cd05ded0ae525386caacc0dcc3abd"),
    ("GFDL-1.2", "cc8061520d671799dfc6841d1b94e6f4cd1ba77c9dc26e1f23cce35bd98a0a6d"),
    ("GFDL-1.3", "9aa52e4045eeb45ac24bb5e2d862d1998a73441dfca824a5728b2938633a570e"),
)


def _plain(text: Column) -> Column:
    """Lower case without copyright lines, all between letters and digits one space; line ends stay."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), COPYRIGHT_LINE, "")), r"[^\p{L}\p{N}\n]+", " ")


def _spelled(plain: Column) -> Column:
    """The canonical form from the plain one."""
    t = plain
    for pattern, to in SPELLINGS:
        t = F.regexp_replace(t, pattern, to)
    return F.when(plain.rlike(ANY_SPELLING), F.trim(F.regexp_replace(t, " +", " "))).otherwise(plain)


def canonical(text: Column) -> Column:
    """Lower case, without copyright lines, everything but letters and digits one space, equal spellings made one."""
    return let(F.trim(F.regexp_replace(_plain(text), "[ \n]+", " ")), _spelled)


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license) of the texts in KNOWN and of DIGESTS, or of other (licence, text) pairs."""
    texts = spark.createDataFrame(list(KNOWN if known is None else known), "license string, text string")
    rows = texts.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license")
    if known is None and DIGESTS:
        rows = rows.union(spark.createDataFrame([(d, k) for k, d in DIGESTS], "digest string, license string"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, n_lines, digest, license, line_licenses) for each row of docs.

    digest is that of the whole text's canonical form, license the known licence that has it, else null; line_licenses are
    the licences that single lines have or name, each once, in order, joined by commas ("" if none). n_lines counts lines with a
    word. known: (licence, text) pairs to look for instead of the built-in ones, MOST_KNOWN at most.

    Null and empty texts are the empty form and match nothing. Repeated rows each give a row. Other columns play no part.
    """
    if known is not None and len(known) > MOST_KNOWN:
        raise ValueError(f"{len(known)} known licences; at most {MOST_KNOWN} are looked up by broadcast")
    table = {r.digest: r.license for r in known_digests(docs.sparkSession, known).filter(F.col("digest") != F.sha2(F.lit(""), 256)).collect()}  # a row for each known text
    known_df = docs.sparkSession.createDataFrame(list(table.items()), "digest string, license string")
    names = F.create_map(*[F.lit(x) for kv in table.items() for x in kv]) if table else None
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x: x.rlike(WORD))).cast("long").alias("n_lines"), _plain(F.col(text)).alias("plain"))

    def found(plain: Column) -> Column:
        lines = F.filter(F.transform(F.split(plain, "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
        hits = F.filter(F.transform(lines, lambda x: F.sha2(_spelled(x), 256)), lambda d: d.isin(list(table)))
        return F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda d: F.element_at(names, d)))), ",")

    rows = rows.select("doc_id", "n_lines", F.sha2(_spelled(F.trim(F.regexp_replace("plain", "[ \n]+", " "))), 256).alias("digest"), (found(F.col("plain")) if table else F.lit("")).alias("line_licenses"))
    return rows.join(F.broadcast(known_df), "digest", "left").select("doc_id", "n_lines", "digest", "license", "line_licenses")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan() of all documents for the built-in licences."""
    return scan(read(spark, sf_dir, "documents"))


def _sql(text: str) -> str:
    """canonical() in the SQL of the oracle."""
    out = f"regexp_replace(lower(regexp_replace(coalesce({text}, ''), '{COPYRIGHT_LINE}', '', 'g')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')"
    out = f"trim({out})"
    for pattern, to in SPELLINGS:
        out = f"regexp_replace({out}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


OP4_SQL = rf"""
WITH known AS (SELECT digest, min(l) AS license FROM (
  SELECT sha256({_sql("t")}) AS digest, l FROM (VALUES {", ".join("('" + k + "', '" + x.replace("'", "''") + "')" for k, x in KNOWN)}) AS v(l, t)
  UNION ALL SELECT d, l FROM (VALUES {", ".join(f"('{k}', '{d}')" for k, d in DIGESTS)}) AS w(l, d)) GROUP BY digest),
d AS (SELECT row_number() OVER () AS u, doc_id, text FROM documents),
l AS (SELECT u, unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM d),
n AS (SELECT u, count(*) AS n_lines FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY u),
m AS (SELECT u, string_agg(DISTINCT license, ',' ORDER BY license) AS ll FROM l JOIN known ON sha256({_sql("x")}) = known.digest GROUP BY u)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, w.digest, license, coalesce(ll, '') AS line_licenses
FROM (SELECT u, doc_id, sha256({_sql("text")}) AS digest FROM d) w LEFT JOIN known ON w.digest = known.digest LEFT JOIN n ON w.u = n.u LEFT JOIN m ON w.u = m.u
"""
