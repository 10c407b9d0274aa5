"""Licence scan by canonical digests (Spark functions only).

A text is normalised (A-Z to lower case, copyright notices dropped, punctuation
and white space to single spaces, equivalent spellings to one) and its SHA-256
is hash-joined to the digests of known licence texts, normalised the same
way.  Entire texts are looked up twice: the whole document, and every line of
it as a text of its own, for licence notices inside documents.

The table of known texts is a parameter whose size does not depend on the
data; it is the broadcast side.  Only lines whose normalised length is that
of a known text are digested, which loses nothing.

Result, one row per row of the input: doc_id, canon_sha256 (null text: null),
license (of the whole document; null if none), n_license_lines (distinct ones), licenses
(names over whole text and lines, sorted, comma-joined; '' if none).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, keyed

# Public licence texts and notices.
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_ZERO_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."""
_ISC_NO_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_NO_WARRANTY = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
KNOWN: list[tuple[str, str]] = [
    ("MIT", _MIT_GRANT),
    ("MIT", "MIT License\n\n" + _MIT_GRANT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT_GRANT),
    ("ISC", _ISC_GRANT + "\n\n" + _ISC_NO_WARRANTY),
    ("ISC", "ISC License\n\n" + _ISC_GRANT + "\n\n" + _ISC_NO_WARRANTY),
    ("0BSD", _ZERO_GRANT + "\n\n" + _ISC_NO_WARRANTY),
    ("BSD-2-Clause", _BSD_GRANT + _BSD_NO_WARRANTY),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_GRANT + _BSD_NO_WARRANTY),
    ("BSD-3-Clause", _BSD_GRANT + _BSD_THIRD + _BSD_NO_WARRANTY),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_GRANT + _BSD_THIRD + _BSD_NO_WARRANTY),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]

# Equivalent spellings (from, to), applied in this order to normalised words.
SPELLINGS = [
    ("licenc", "licens"), ("sub licens", "sublicens"), ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"), ("acknowledgement", "acknowledgment"),
    ("copyright owner", "copyright holder"), ("organisation", "organization"), ("whilst", "while"),
    ("per cent", "percent"), ("https www ", "http www "), ("https ", "http "),
    ("public licens v", "public licens version "),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Notices only: the word followed by (c), "by" or a year, or (c) by one of them; other lines that begin with the word are text.
COPYRIGHT_LINE = (r"^[^0-9a-z\n]*(copyright[^0-9a-z\n]*(\(c\)|©|by\b|[0-9]{4}|year\b|yyyy\b)|(\(c\)|©)[^0-9a-z\n]*(copyright\b|by\b|[0-9]{4}|year\b|yyyy\b)"
                  r"|all rights reserved)[^\n]*$")
PUNCTUATION = r"[^0-9a-z\x{80}-\x{10ffff}\n]+|[\x{a0}-\x{bf}\x{2000}-\x{206f}\x{3000}-\x{3003}]+"
_KEPT = r"0-9a-z\n\x{80}-\x{9f}\x{c0}-\x{1fff}\x{2070}-\x{2fff}\x{3004}-\x{10ffff}"
#: Runs of what PUNCTUATION drops, both kinds in one pass; a space between words, the most common run, stays unmatched.
PUNCTUATION_RUN = f"[^ {_KEPT}][^{_KEPT}]*| [^{_KEPT}]+"


def lower_ascii(text: Column) -> Column:
    """A-Z to lower case; ``translate``, which makes an object of every character, only where others occur."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def canonical_lines(text: Column) -> Column:
    """Normalised text; line feeds stay."""
    c = F.regexp_replace(lower_ascii(text), "(?md)" + COPYRIGHT_LINE, "")
    c = F.regexp_replace(c, PUNCTUATION_RUN, " ")
    for a, b in SPELLINGS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def whole(lines: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(lines, F.lit("\n"), F.lit(" ")), r"  +", " "))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """(digest, license, size): a row for each distinct known text."""
    rows = F.array(*[F.struct(F.lit(n).alias("license"), F.lit(t).alias("text")) for n, t in known])
    t = spark.range(1).select(F.inline(rows)).select("license", whole(canonical_lines(F.col("text"))).alias("c"))
    t = t.select(F.sha2("c", 256).alias("digest"), "license", F.length("c").alias("size"))
    return t.groupBy("digest", "size").agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, known: list[tuple[str, str]] = KNOWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    spark = docs.sparkSession
    table = known_digests(spark, known)
    sizes = [r[0] for r in table.select("size").distinct().collect()]  # as many as known texts
    rows = keyed(docs, id_col, text_col).select("doc_id", "dk", "rk", canonical_lines(F.col("text")).alias("lines"))
    # every line of two or more is a text of its own; those of a known size are looked up
    own = F.filter(F.transform(F.split("lines", "\n"), lambda x: F.trim(x)), lambda x: F.length(x).isin(sizes))
    rows = rows.select("doc_id", "dk", "rk", F.sha2(whole(F.col("lines")), 256).alias("at"),
                       F.when(F.contains("lines", F.lit("\n")), F.array_distinct(own)).alias("own"))
    rows = Scratch(spark, "licenses").stage(rows, "digests")  # texts are normalised once
    found = rows.join(F.broadcast(table.select(F.col("digest").alias("at"), "license")), "at", "left")
    lines = rows.select("dk", "rk", F.explode("own").alias("line")).select("dk", "rk", "line", F.sha2("line", 256).alias("digest"))
    lines = lines.join(F.broadcast(table.select("digest", "license")), "digest")
    # a row a document and known licence; a repeated row's lines count once
    per = lines.groupBy("dk", "rk").agg(F.collect_set("license").alias("names"), F.count_distinct("line", "license").alias("n_license_lines"))
    names = F.array_distinct(F.concat(F.coalesce("names", F.array().cast("array<string>")),
                                      F.when(F.col("license").isNotNull(), F.array("license")).otherwise(F.array().cast("array<string>"))))
    return found.join(per, ["dk", "rk"], "left").select(
        "doc_id", F.col("at").alias("canon_sha256"), "license", F.coalesce("n_license_lines", F.lit(0)).cast("long").alias("n_license_lines"),
        F.array_join(F.array_sort(names), ",").alias("licenses"))


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canon_sql(col: str) -> str:
    c = f"translate({col}, '{_UPPER}', '{_LOWER}')"
    c = f"regexp_replace({c}, {_sql('(?m)' + COPYRIGHT_LINE)}, '', 'g')"
    c = f"regexp_replace({c}, {_sql(PUNCTUATION)}, ' ', 'g')"
    c = f"regexp_replace({c}, '  +', ' ', 'g')"
    for a, b in SPELLINGS:
        c = f"replace({c}, '{a}', '{b}')"
    return c


def oracle_sql(known: list[tuple[str, str]] = KNOWN) -> str:
    """The same result in DuckDB SQL over the view ``documents``."""
    whole_sql = r"trim(regexp_replace(regexp_replace({}, '\n+', ' ', 'g'), '  +', ' ', 'g'))".format
    values = ", ".join(f"({_sql(n)}, {_sql(t)})" for n, t in known)
    return f"""
with texts(license, text) as (values {values}),
known as (select sha256({whole_sql(_canon_sql('text'))}) as digest, min(license) as license from texts group by 1),
docs as (select doc_id, text, {_canon_sql('text')} as lines from documents),
hit as (
  select d.doc_id, d.text, k.license, x.line
  from (select doc_id, text, trim(unnest(string_split(lines, chr(10)))) as line from (select distinct doc_id, text, lines from docs where contains(lines, chr(10)))) x
  join known k on k.digest = sha256(x.line)
  join (select distinct doc_id, text from docs) d on d.doc_id is not distinct from x.doc_id and d.text = x.text),
per as (select doc_id, text, count(distinct (line, license)) as n, list(distinct license) as names from hit group by doc_id, text)
select d.doc_id, sha256({whole_sql('d.lines')}) as canon_sha256, k.license,
  coalesce(p.n, 0)::bigint as n_license_lines,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(p.names, []::varchar[]), case when k.license is null then []::varchar[] else [k.license] end))), ','), '') as licenses
from docs d
left join known k on k.digest = sha256({whole_sql('d.lines')})
left join per p on p.doc_id is not distinct from d.doc_id and p.text = d.text
"""
