"""Licences found by the digest of a whole canonical text."""

from __future__ import annotations

import hashlib
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: texts of well-known licences and notices
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_REST = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_TOP = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_NAME = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
KNOWN = [
    ("MIT", _MIT_GRANT),
    ("MIT", "MIT License\n" + _MIT_GRANT),
    ("MIT", "The MIT License (MIT)\n" + _MIT_GRANT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_REST),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC_REST),
    ("BSD-2-Clause", _BSD_TOP + "\n" + _BSD_END),
    ("BSD-3-Clause", _BSD_TOP + "\n" + _BSD_NAME + "\n" + _BSD_END),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-3.0", "Licensed under CC BY-NC 3.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]
# fixed values: spellings that count as the same, applied in this order after punctuation has gone
SPELLINGS = [("licenc", "licens"), ("sub licens", "sublicens"), ("non infring", "noninfring"), ("acknowledgement", "acknowledgment"),
             ("favour", "favor"), ("organis", "organiz"), ("authoris", "authoriz"), ("whilst", "while"), ("per cent", "percent"),
             ("copyright owner", "copyright holder"), ("merchantibility", "merchantability")]
COPYRIGHT_LINE = r"(?m)^[ \t]*(copyright|©|\(c\))[^\n]*$"
MARKS = string.punctuation + "“”‘’–—•©"
NOTHING = hashlib.sha256(b"").hexdigest()  # a canonical text without a word is no licence


def plain_lines(text: Column) -> Column:
    """Lower case, no copyright lines, blanks for punctuation; line ends stay."""
    return F.translate(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, ""), MARKS, " " * len(MARKS))


def one_spelling(plain: Column) -> Column:
    """Single blanks and one spelling of equivalent words."""
    out = F.trim(F.regexp_replace(plain, r"[ \t\n\r]+", " "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, no punctuation, one spelling, single blanks."""
    return one_spelling(plain_lines(text))


def known_digests(spark: SparkSession) -> DataFrame:
    """``license_id, digest`` of the known texts: a fixed list of a few rows."""
    rows = spark.createDataFrame(KNOWN, "license_id string, text string")
    return rows.select("license_id", F.sha2(canonical(F.col("text")), 256).alias("digest")).distinct()


def find(docs: DataFrame, text: str = "text", key: str = "doc_id", known: DataFrame | None = None) -> DataFrame:
    """``doc_id, license_id, scope, n_places``: documents whose whole text is a known licence
    (scope ``document``), and those with a line whose whole text is one (scope ``line``).

    Texts are compared by the digest of their canonical form; there is no partial match. A text
    of one line can have both scopes. Null and empty texts match nothing. Rows of the same key
    are counted together. ``known`` (license_id, digest) may be of any size.
    """
    known = known_digests(docs.sparkSession) if known is None else known
    # all but blanks and spellings looks at one line at a time, so lines are cut after it
    parts = (docs.select(F.col(key).alias("doc_id"), plain_lines(F.col(text)).alias("plain"))
             .select("doc_id", F.explode(F.concat(
                 F.array(F.struct(F.lit("document").alias("scope"), F.col("plain").alias("part"))),
                 F.transform(F.split("plain", "\n"), lambda line: F.struct(F.lit("line").alias("scope"), line.alias("part"))))).alias("p")))
    # a digest that is never null needs no test for null, which would make every digest twice
    digest = F.coalesce(F.sha2(one_spelling(F.col("p.part")), 256), F.lit(""))
    # likewise ``when``, not a filter, which the join would repeat for the digests of the texts
    wanted = known.select("license_id", F.when(F.col("digest") != NOTHING, F.col("digest")).alias("digest"))
    hits = parts.select("doc_id", "p.scope", digest.alias("digest")).join(wanted, "digest")
    return hits.groupBy("doc_id", "license_id", "scope").agg(F.count("*").alias("n_places"))


def _canonical_sql(text: str) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"regexp_replace(lower({text}), {q(COPYRIGHT_LINE)}, '', 'g')"
    out = f"trim(regexp_replace(translate({out}, {q(MARKS)}, {q(' ' * len(MARKS))}), '[ \\t\\n\\r]+', ' ', 'g'))"
    for old, new in SPELLINGS:
        out = f"replace({out}, {q(old)}, {q(new)})"
    return out


SQL = f"""
    WITH known(license_id, text) AS (VALUES {", ".join("('" + i + "', '" + t.replace("'", "''") + "')" for i, t in KNOWN)}),
    k AS (SELECT DISTINCT license_id, {_canonical_sql("text")} AS t FROM known),
    p AS (SELECT doc_id, 'document' AS scope, text AS part FROM documents
          UNION ALL SELECT doc_id, 'line', unnest(string_split(text, chr(10))) FROM documents),
    c AS (SELECT doc_id, scope, {_canonical_sql("part")} AS t FROM p WHERE part IS NOT NULL)
    SELECT doc_id, license_id, scope, count(*) AS n_places FROM c JOIN k USING (t) WHERE t <> '' GROUP BY ALL"""
