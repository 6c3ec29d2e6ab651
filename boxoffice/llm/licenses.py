"""License scans by canonical digests.

A text is brought to a canonical form: copyright lines are dropped, case and punctuation are normalised, white space is
folded and equivalent spellings are replaced. Its digest is joined with the digests of known license texts, so an entire
text is found however it is laid out, and nothing else is. The same lookup over single lines finds license notices inside
documents. Only digests meet in the joins, never texts.

Known texts are a table (license_id, text), if one is passed. Otherwise they are ``KNOWN``, short public texts and notices, and
the complete standard texts whose digests are in ``STANDARD``.

Defined results: null and empty texts, and those of copyright lines alone, have an empty canonical form, which is no
license; known texts with the same form give the smallest id; repeated rows get equal results; other columns are ignored.
Runs jobs while it is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxoffice.llm.license_texts import STANDARD
from boxoffice.session import materialize

# Equivalent spellings in license texts, each written the first way (words of the canonical form).
SPELLINGS = (
    ("acknowledgment", "acknowledgement"), ("analog", "analogue"), ("analyze", "analyse"), ("artifact", "artefact"),
    ("authorization", "authorisation"), ("authorized", "authorised"), ("catalog", "catalogue"), ("center", "centre"),
    ("customized", "customised"), ("favorite", "favourite"), ("favor", "favour"), ("fulfill", "fulfil"), ("initialize", "initialise"),
    ("judgment", "judgement"), ("labeled", "labelled"), ("license", "licence"), ("licensed", "licenced"), ("licenses", "licences"),
    ("merchantability", "merchantibility"), ("modeled", "modelled"), ("noncommercial", "non commercial"), ("offense", "offence"),
    ("optimize", "optimise"), ("organization", "organisation"), ("organizations", "organisations"), ("percent", "per cent"),
    ("practice", "practise"), ("program", "programme"), ("realize", "realise"), ("recognize", "recognise"), ("sublicense", "sub license"),
    ("sublicense", "sublicence"), ("utilization", "utilisation"), ("while", "whilst"), ("wilful", "willful"),
    ("copyright holder", "copyright owner"), ("copyright holders", "copyright owners"), ("http", "https"),
)

# Public license texts and notices.
_AS_IS = ('THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES '
          "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
          "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
          "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
_BSD_2 = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
          "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
          "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
          "documentation and/or other materials provided with the distribution.\n")
_BSD_3 = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
          "software without specific prior written permission.\n")
_BSD_END = ('THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
            "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
            "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
            "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
            "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
            "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.")
_ISC = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies.\n")
_ZLIB = ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
         "the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it "
         "and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim "
         "that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated "
         "but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
         "3. This notice may not be removed or altered from any source distribution.")
_APACHE = ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a '
           "copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed "
           'under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for '
           "the specific language governing permissions and limitations under the License.")
KNOWN = (
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _AS_IS),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", _BSD_2 + _BSD_END),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", _BSD_2 + _BSD_3 + _BSD_END),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("ISC", _ISC + _AS_IS),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
                "You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("Zlib", _ZLIB),
)

#: Lines that claim copyright (with a mark, year or placeholder), not those that speak of "copyright notice" and the like.
COPYRIGHT_LINES = (r"(?im)^[ \t/*#;%.-]*(?:copyright[ \t:]*(?:\(c\)|©|[0-9]{4}|by[ \t]|[<\[{])[^\n]*|\(c\)[ \t]*(?:copyright|[0-9]{4})[^\n]*|©[^\n]*"
                   r"|all rights reserved[^\p{L}\p{N}\n]*)$")


VARIANT = r"\b(?:" + "|".join(v for _, v in SPELLINGS) + r")\b"


#: Spellings that join two words of a variant in one.
JOINED = tuple(s for s, v in SPELLINGS if v.count(" ") > s.count(" "))
#: Lines of so many words may be a complete standard text, of which only the digest is known.
LONG_LINE = 150
PAIRS = 100_000


def _words(text: Column, keep_lines: bool) -> Column:
    """Lower-case words, without copyright lines; with line ends if asked."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), COPYRIGHT_LINES, " ")
    return F.regexp_replace(F.lower(bare), r"[^\p{L}\p{N}\n]+" if keep_lines else r"[^\p{L}\p{N}]+", " ")


def _with_form(frame: DataFrame, words: str) -> DataFrame:
    """``frame`` with digest in place of the column ``words``, null where that is empty.

    In steps of their own, so that no form is computed twice; only texts that hold another spelling go through the
    replacements.
    """
    steps = frame.withColumn("_varied", F.col(words).rlike(VARIANT))
    replaced = F.col(words)
    for spelling, variant in SPELLINGS:
        replaced = F.regexp_replace(replaced, rf"\b{variant}\b", spelling)
    steps = steps.withColumn("_form", F.when(F.col("_varied"), replaced).otherwise(F.col(words)))
    return steps.withColumn("digest", F.when(F.col("_form") != "", F.sha2("_form", 256))).drop(words, "_varied")


def with_digest(frame: DataFrame, column: str) -> DataFrame:
    """``frame`` with digest: of the canonical form of ``column``, null if that is empty."""
    return _with_form(frame.withColumn("_words", F.trim(_words(F.col(column), keep_lines=False))), "_words").drop("_form")


def line_shapes(spark: SparkSession, known: DataFrame | None = None) -> list[str] | None:
    """Number of words and first word of every line that can have a known form, whatever its spelling; None if there are too many.

    A word joined from two may be written as two, and a first word in any of its variants.
    """
    known = known if known is not None else spark.createDataFrame(list(KNOWN), "license_id string, text string")
    forms = _with_form(known.select(F.trim(_words(F.col("text"), keep_lines=False)).alias("_words")), "_words").filter("_form != ''")
    words = F.split("_form", " ")
    others = F.create_map(*(F.lit(x) for w in sorted({s.split()[0] for s, _ in SPELLINGS}) for x in (
        w, ",".join(sorted({v.split()[0] for s, v in SPELLINGS if s.split()[0] == w})))))
    firsts = F.concat(F.array(words[0]), F.coalesce(F.split(others[words[0]], ","), F.array().cast("array<string>")))
    counts = F.sequence(F.size(words), F.size(words) + F.size(F.filter(words, lambda w: w.isin(*JOINED))))
    shapes = forms.select(F.explode(counts).alias("n"), firsts.alias("firsts")).select("n", F.explode("firsts").alias("first")).distinct()
    rows = shapes.limit(PAIRS + 1).collect()
    return [f"{r['n']} {r['first']}" for r in rows] if len(rows) <= PAIRS else None


def _possible(line: Column, shapes: list[str] | None) -> Column:
    """Whether a line of words may have a known form."""
    if shapes is None:
        return line != ""
    n = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    return (line != "") & ((n >= LONG_LINE) | F.concat_ws(" ", n.cast("string"), F.substring_index(line, " ", 1)).isin(*shapes))


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """digest, license_id: one row per canonical form."""
    known = known if known is not None else spark.createDataFrame(list(KNOWN), "license_id string, text string")
    return with_digest(known.select("license_id", "text"), "text").filter("digest is not null").groupBy("digest").agg(
        F.min("license_id").alias("license_id"))


def scan_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """``known_digests``; without a table passed, those of the complete standard texts as well."""
    table = known_digests(spark, known)
    if known is not None:
        return table
    standard = spark.createDataFrame([(d, i) for i, digests in STANDARD.items() for d in digests], "digest string, license_id string")
    return table.unionByName(standard).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def license_scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, digest, license_id (of the entire text) and notices (sorted license ids of single lines) of every row.

    Each text is brought to words once. The whole form is that of its lines put together; of the lines only those go on whose
    number of words and first word some known form has, so no line that equals one is left out.
    """
    spark = docs.sparkSession
    table, shapes = scan_digests(spark, known), line_shapes(spark, known)
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), _words(F.col("text"), keep_lines=True).alias("_words"))
    cut = keyed.withColumn("_lines", F.filter(F.transform(F.split("_words", "\n"), lambda line: F.trim(line)), lambda line: line != ""))
    cut = cut.withColumn("_words", F.array_join("_lines", " "))
    whole = materialize(_with_form(cut.withColumn("lines", F.filter("_lines", lambda line: _possible(line, shapes))), "_words").select(
        "doc_id", "row_key", "digest", "lines"), "license-forms")
    lines = _with_form(whole.select("row_key", F.explode("lines").alias("_words")), "_words")
    found = lines.join(table, "digest").groupBy("row_key").agg(F.sort_array(F.collect_set("license_id")).alias("notices"))
    return whole.drop("lines").join(table, "digest", "left").join(found, "row_key", "left").select(
        "doc_id", "digest", "license_id", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"))
