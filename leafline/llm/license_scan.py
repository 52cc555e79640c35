"""License scans by canonical digest lookup, in DataFrame functions only.

A text and each of its blocks and lines is normalised (case, punctuation, white space, copyright lines, equivalent spellings) and
the digest of the whole normalised unit is hash-joined to the digests of known licence texts and notices. There is no partial match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, col, table

#: Licence identifiers and texts or notices that stand for them.
MIT_TEXT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD2_TEXT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD3_CLAUSE = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
BSD_DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZLIB_TEXT = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
ZERO_BSD_TEXT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
ISC_TEXT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
KNOWN = [
    ("MIT", MIT_TEXT),
    ("MIT", "MIT License\n\n" + MIT_TEXT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This work is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", ISC_TEXT),
    ("ISC", "ISC License\n\n" + ISC_TEXT),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("0BSD", ZERO_BSD_TEXT),
    ("BSD-2-Clause", BSD2_TEXT + BSD_DISCLAIMER),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + BSD2_TEXT + BSD_DISCLAIMER),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", BSD2_TEXT + BSD3_CLAUSE + BSD_DISCLAIMER),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + BSD2_TEXT + BSD3_CLAUSE + BSD_DISCLAIMER),
    ("Zlib", ZLIB_TEXT),
    ("Zlib", "zlib License\n\n" + ZLIB_TEXT),
    ("Apache-2.0", APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Released under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
]
#: Equivalent spellings, applied in this order to words.
SPELLINGS = [("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("v2", "version 2"), ("v3", "version 3"), ("v", "version"), ("merchantibility", "merchantability"), ("non infringement", "noninfringement")]
COPYRIGHT = r"(?im)^[ \t]*(?:copyright\b|\(c\)|©|all rights reserved)[^\n]*$"
#: What a unit must hold to be worth a digest; every text of KNOWN does. Texts that a caller gives are looked up without it.
HINT = r"(?i)licen[sc]e|permission|permitted"


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, punctuation and white space as one space, spellings made equal, trimmed."""
    c = F.regexp_replace(text, COPYRIGHT, " ")
    c = F.regexp_replace(ascii_lower(c), r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " ")
    c = F.concat(F.lit(" "), F.trim(c), F.lit(" "))
    for a, b in SPELLINGS:
        c = F.replace(c, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(c)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """digest and license, the first by name where texts are alike; the texts are a list on the driver, so this side is broadcast."""
    rows = spark.createDataFrame([(k, v) for k, v in known], "license string, text string")
    return rows.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license").alias("license"))


def find_licenses(docs: DataFrame, *, text_col="text", known=KNOWN, keep: list[str] | None = None) -> DataFrame:
    """row (the columns in keep, all by default), licenses (sorted distinct identifiers) and whole (the whole text is a licence).

    Units are the whole text, its blocks (parted by empty lines) and its lines; each is hash-joined by its digest to the known ones,
    which are broadcast as they are given. Only rows that hold a hint word are parted into units and grouped again, by a number of
    their own, so repeated rows stay apart; all others are passed on without a shuffle. Null and empty texts have no licence, and an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    names = docs.columns if keep is None else keep
    base = docs.select(F.struct(*[col(n) for n in names]).alias("row"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    hinted = (lambda c: c.rlike(HINT)) if known is KNOWN else (lambda c: c != "")
    units = F.array_distinct(F.concat(F.array(F.trim("text")), F.split("text", r"\n[ \t]*\n"), F.split("text", "\n")))
    digests = F.array_distinct(F.transform(F.filter(units, hinted), digest))
    each = base.filter(hinted(F.col("text"))).select(F.monotonically_increasing_id().alias("id"), "row", digest(F.col("text")).alias("whole"), digests.alias("digests"))
    each = each.select("id", "row", "whole", F.explode_outer("digests").alias("digest"))
    found = each.join(F.broadcast(known_digests(spark, known)), "digest", "left").groupBy("id").agg(
        F.first("row").alias("row"),
        F.array_sort(F.collect_set("license")).alias("licenses"),
        F.coalesce(F.max(F.col("license").isNotNull() & (F.col("digest") == F.col("whole"))), F.lit(False)).alias("whole"),
    )
    none = base.filter(~hinted(F.col("text"))).select("row", F.array().cast("array<string>").alias("licenses"), F.lit(False).alias("whole"))
    return found.drop("id").unionByName(none)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licences; nulls, empty texts and repeats as find_licenses has them."""
    found = find_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.select("row.doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses", ",").alias("licenses"), F.col("whole").alias("whole_text"))


def oracle() -> str:
    def quoted(s):
        return "'" + s.replace("'", "''") + "'"

    def sql(c):
        c = f"regexp_replace({c}, '(?im)^[ \\t]*(?:copyright\\b|\\(c\\)|©|all rights reserved)[^\\n]*$', ' ', 'g')"
        c = f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        c = f"' ' || trim(regexp_replace({c}, '[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+', ' ', 'g')) || ' '"
        for a, b in SPELLINGS:
            c = f"replace({c}, ' {a} ', ' {b} ')"
        return f"sha256(trim({c}))"

    values = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in KNOWN)
    return f"""
WITH known AS (SELECT DISTINCT {sql("text")} AS digest, license FROM (VALUES {values}) AS k(license, text)),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
units AS (
  SELECT doc_id, trim(text) AS u FROM d UNION SELECT doc_id, unnest(string_split(text, chr(10))) FROM d
  UNION SELECT doc_id, unnest(regexp_split_to_array(text, '\\n[ \\t]*\\n')) FROM d),
found AS (
  SELECT doc_id, count(*) AS n, string_agg(license, ',' ORDER BY license) AS names FROM (
    SELECT DISTINCT doc_id, license FROM (SELECT doc_id, u FROM units WHERE regexp_matches(u, '{HINT}')) JOIN known ON digest = {sql("u")}) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_licenses, coalesce(names, '') AS licenses,
  regexp_matches(text, '{HINT}') AND {sql("text")} IN (SELECT digest FROM known) AS whole_text
FROM d LEFT JOIN found USING (doc_id)
"""


QUERIES = {"op6_license_scan": op6_license_scan}
ORACLES = {"op6_license_scan": oracle()}
