"""Licence scan by canonical digests: texts that say the same get the same digest, and a hash join finds them.

DataFrame functions only; the known licences are a small fixed table, or one the caller gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.storage import cut, join_with_hot

#: Spellings that count as the second one, as whole words of lower-case text without punctuation.
EQUIVALENT = [
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("per cent", "percent"),
    ("copy right", "copyright"),
    ("organisation", "organization"),
    ("authorised", "authorized"),
    ("recognised", "recognized"),
    ("favour", "favor"),
    ("whilst", "while"),
    ("acknowledgement", "acknowledgment"),
    ("merchantibility", "merchantability"),
    ("https", "http"),
]

#: Short public licences as their stewards publish them.
MIT = """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """ISC License

Copyright (c) <year> <copyright holders>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZERO_BSD = """Copyright (C) <year> by <copyright holders>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Copyright (c) <year>, <copyright holders>
All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_2 = _BSD_HEAD + _BSD_TAIL
BSD_3 = (
    _BSD_HEAD
    + """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
    + _BSD_TAIL
)
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
#: (license_id, text): whole texts, and notices that stand for a licence in one line
KNOWN = [
    ("MIT", MIT),
    ("MIT", MIT.partition("\n\n")[2]),
    ("ISC", ISC),
    ("ISC", ISC.partition("\n\n")[2]),
    ("0BSD", ZERO_BSD),
    ("BSD-2-Clause", BSD_2),
    ("BSD-3-Clause", BSD_3),
    ("Zlib", ZLIB),
    ("BSL-1.0", BOOST),
    ("Unlicense", UNLICENSE),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
]
#: Most known texts that are broadcast; beyond it the join is shuffled, but for the digests of very many rows.
BROADCAST_KNOWN = 100_000


def canonical(text: Column) -> Column:
    """Lower case; lines that begin with a copyright mark dropped; runs of anything but letters, digits and
    line ends as one space; equivalent spellings as one. Lines stay lines, without spaces at their ends."""
    out = F.regexp_replace(F.lower(text), "(?m)^[\\x20\\x09]*(?:copyright|\\(c\\)|©)[^\n]*$", "")
    out = F.regexp_replace(out, "[^\\p{L}\\p{N}\n]+", " ")
    # every word between two spaces of its own, so that spellings are met as whole words, also side by side
    out = F.concat(F.lit(" "), F.replace(F.replace(out, F.lit(" "), F.lit("  ")), F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for one, other in EQUIVALENT:
        out = F.replace(out, F.lit(f" {one.replace(' ', '  ')} "), F.lit(f" {other} "))
    return F.regexp_replace(F.regexp_replace(out, " +", " "), "(?m)^ | $", "")


def digest(canonical_text: Column) -> Column:
    """SHA-256 of a canonical text without regard to where its lines end; null if nothing is left."""
    flat = F.trim(F.regexp_replace(canonical_text, "[\n ]+", " "))
    return F.when(flat != "", F.sha2(flat, 256))


def known_licenses(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(license_id, digest) of the given texts, by default KNOWN."""
    table = spark.createDataFrame(known or KNOWN, "license_id string, text string")
    return table.select("license_id", digest(canonical(F.col("text"))).alias("digest")).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def known_notices(spark: SparkSession, notices: list[tuple[str, str]] | None = None) -> DataFrame:
    """(license_id, digest) of the given one-line notices, by default KNOWN's; one of several lines is none."""
    lines = [(name, text) for name, text in (KNOWN if notices is None else notices) if "\n" not in text]
    table = spark.createDataFrame(lines, "license_id string, text string")
    return table.select("license_id", digest(canonical(F.col("text"))).alias("digest")).where("digest is not null").distinct()


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, id_column: str = "doc_id", text_column: str = "text", notices: list[tuple[str, str]] | None = None) -> DataFrame:
    """Per row of docs: doc_id, digest, license_id, notices.

    known: (license_id, digest), by default known_licenses(); of several ids of one digest the least counts. license_id: of the known text with the same
    digest as the row's whole text, else null. notices: the ids, sorted and comma-joined, of the given one-line notices (license_id, line), by
    default KNOWN's, that have the digest of one of the row's lines; empty if there are none. Whole texts and lines are looked up alike, in one hash join of digests.

    Null texts, and those without letters or digits, have no digest and no licence. Repeated rows come
    back as often as they are there. A very long text is canonised whole, in one task. Other columns are not used; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    whole = (known_licenses(spark) if known is None else known).where("digest is not null").groupBy("digest").agg(F.min("license_id").alias("license_id"))
    names = whole.select("digest", F.lit(False).alias("line"), F.array("license_id").alias("names"))
    of_lines = known_notices(spark, notices).groupBy("digest").agg(F.collect_set("license_id").alias("names"))
    table = names.unionByName(of_lines.select("digest", F.lit(True).alias("line"), "names")).withColumnRenamed("digest", "key")

    text = F.col(f"`{text_column}`").cast("string")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_column}`").cast("long").alias("doc_id"), canonical(text).alias("canonical"))
    lines = F.split("canonical", "\n")
    if notices is None:  # the few lines that speak of licences at all are looked up
        lines = F.filter(lines, lambda x: x.contains("license"))
    lines = F.array_distinct(F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.sha2(x, 256)))
    rows = rows.select("row", "doc_id", digest(F.col("canonical")).alias("digest"), F.coalesce(lines, F.array().cast("array<string>")).alias("lines"))
    # what no licence has stands for no digest, so that such rows don't meet in one task
    own = F.struct(F.coalesce("digest", F.concat(F.lit("-"), F.col("row").cast("string"))).alias("key"), F.lit(False).alias("line"))
    each = F.concat(F.array(own), F.transform("lines", lambda x: F.struct(x.alias("key"), F.lit(True).alias("line"))))
    keys = rows.select("row", "doc_id", "digest", F.explode(each).alias("of")).select("row", "doc_id", "digest", "of.key", "of.line")
    if known is None or known.limit(BROADCAST_KNOWN + 1).count() <= BROADCAST_KNOWN:
        met = keys.join(F.broadcast(table), ["key", "line"], "left")
    else:
        keys = cut(keys, "license-keys")
        often = keys.join(table.select("key").distinct(), "key", "left_semi").groupBy("key", "line").agg(F.count("*").alias("n"))
        met = join_with_hot(keys, table.join(often, ["key", "line"]), ["key", "line"], "n", keys.count(), "left")
    found = met.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("digest").alias("digest"), F.max(F.when(~F.col("line"), F.get("names", F.lit(0)))).alias("license_id"), F.flatten(F.collect_set(F.when(F.col("line"), F.col("names")))).alias("notices"))
    return found.select("doc_id", "digest", "license_id", F.array_join(F.array_sort(F.array_distinct("notices")), ",").alias("notices"))


def _sql_canonical(text: str) -> str:
    out = f"regexp_replace(lower({text}), '(?m)^[\\x20\\x09]*(?:copyright|\\(c\\)|©)[^\\n]*$', '', 'g')"
    out = f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
    out = f"' ' || replace(replace({out}, ' ', '  '), chr(10), ' ' || chr(10) || ' ') || ' '"
    for one, other in EQUIVALENT:
        out = f"replace({out}, ' {one.replace(' ', '  ')} ', ' {other} ')"
    return f"regexp_replace(regexp_replace({out}, ' +', ' ', 'g'), '(?m)^ | $', '', 'g')"


def _sql_digest(canonical_text: str) -> str:
    flat = f"trim(regexp_replace({canonical_text}, '[\\n ]+', ' ', 'g'))"
    return f"CASE WHEN {flat} != '' THEN sha256({flat}) END"


def oracle() -> str:
    """DuckDB SQL for scan_licenses() of documents."""
    quoted = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in KNOWN)
    return f"""
WITH given AS (SELECT license_id, {_sql_canonical("text")} AS canonical, contains(text, chr(10)) AS whole FROM (VALUES {quoted}) AS t(license_id, text)),
known AS (SELECT {_sql_digest("canonical")} AS digest, min(license_id) AS license_id FROM given GROUP BY 1),
rows AS (SELECT row_number() OVER () AS r, doc_id, {_sql_canonical("text")} AS canonical FROM documents),
line AS (SELECT DISTINCT r, unnest(string_split(canonical, chr(10))) AS line FROM rows),
found AS (SELECT r, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices FROM line JOIN (SELECT * FROM given WHERE NOT whole) g ON line = g.canonical GROUP BY r),
digests AS (SELECT r, doc_id, {_sql_digest("canonical")} AS digest FROM rows)
SELECT doc_id, d.digest, k.license_id, coalesce(f.notices, '') AS notices FROM digests d LEFT JOIN known k ON d.digest = k.digest LEFT JOIN found f ON d.r = f.r
"""
