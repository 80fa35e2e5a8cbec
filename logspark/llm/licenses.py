"""Licence scans by canonical digests.

Texts are brought to a canonical form (case, punctuation, white space, copyright lines and equivalent spellings no longer matter) and
hash-joined to the digests of known licences: the entire text of a document, and, for notices inside it, each of its lines.

The table of known licences is a parameter; its size bounds the broadcast, and a table above ``BROADCAST_ROWS`` is joined by shuffling.

Defined results: null and empty texts have the digest of the empty canonical text, which is no licence. Repeated rows are scanned one
by one. A digest known under several names gives the least. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 10_000
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Equivalent spellings of words in canonical text. Fixed values.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("sub license", "sublicense"),
    ("non commercial", "noncommercial"), ("organisation", "organization"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("favour", "favor"), ("labour", "labor"), ("whilst", "while"), ("fulfil", "fulfill"), ("judgement", "judgment"),
    ("merchantibility", "merchantability"), ("copyright owner", "copyright holder"), ("percent", "per cent"), ("https", "http"),
)
#: Lines left out of entire texts, in canonical form.
COPYRIGHT_LINE = "^(copyright (c )?([0-9]{4}|year|yyyy)|c [0-9]{4}|all rights reserved$)"

WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    "Software.\n\n" + WARRANTY
)
ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    'copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES '
    "WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
    "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
    "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
#: Known licences and notices: name and text. Fixed values.
KNOWN = (
    ("MIT", "MIT License\n\n" + MIT), ("MIT", MIT), ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"), ("ISC", "ISC License\n\n" + ISC), ("ISC", ISC), ("ISC", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."), ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
)


def canonical_lines(text: Column) -> Column:
    """The lines of a text, each in canonical form."""
    small = F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL)
    out = F.regexp_replace(small, "[^a-z0-9\n]+", " ")
    for word, other in SPELLINGS:
        out = F.regexp_replace(out, rf"\b{word}\b", other)
    return F.transform(F.split(out, "\n"), lambda s: F.trim(s))


def canonical_text(lines: Column) -> Column:
    kept = F.filter(lines, lambda s: (s != "") & ~s.rlike(COPYRIGHT_LINE))
    return F.array_join(kept, " ")


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """``digest, license`` of known texts; one row per digest."""
    rows = spark.createDataFrame([tuple(k) for k in known], "license string, text string")
    digest = F.md5(canonical_text(canonical_lines(F.col("text"))))
    return rows.select(digest.alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known=KNOWN) -> DataFrame:
    """``doc_id, text_digest, text_license, line_licenses, n_license_lines`` for every row of ``docs`` (``doc_id``, ``text``).

    ``line_licenses`` are the distinct licences of whole lines, in order, comma-joined ('' if none).
    """
    digests = known_digests(docs.sparkSession, known)
    small = F.broadcast if len(known) <= BROADCAST_ROWS else lambda df: df
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", canonical_lines(F.col("text")).alias("lines"))
    rows = rows.select("row", "doc_id", F.md5(canonical_text(F.col("lines"))).alias("text_digest"), F.filter("lines", lambda s: s != "").alias("lines"))
    lines = rows.select("row", "doc_id", "text_digest", F.explode_outer("lines").alias("line"))
    of_line = digests.select(F.col("digest").alias("line_digest"), F.col("license").alias("line_license"))
    found = lines.join(small(of_line), F.md5("line") == F.col("line_digest"), "left")
    per_row = found.groupBy("row", "doc_id", "text_digest").agg(
        F.array_join(F.sort_array(F.collect_set("line_license")), ",").alias("line_licenses"), F.count("line_license").alias("n_license_lines")
    )
    whole = digests.select(F.col("digest").alias("text_digest"), F.col("license").alias("text_license"))
    return per_row.join(small(whole), "text_digest", "left").select("doc_id", "text_digest", "text_license", "line_licenses", "n_license_lines")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def duckdb_sql(known=KNOWN) -> str:
    """The same result in DuckDB's SQL over the table ``documents``."""

    def lines(text: str) -> str:
        out = f"regexp_replace(translate(coalesce({text}, ''), '{CAPITALS}', '{SMALL}'), '[^a-z0-9\\n]+', ' ', 'g')"
        for word, other in SPELLINGS:
            out = f"regexp_replace({out}, '\\b{word}\\b', '{other}', 'g')"
        return f"[trim(s, ' ') for s in string_split({out}, chr(10))]"

    whole = f"array_to_string([s for s in lines if s <> '' AND NOT regexp_matches(s, '{COPYRIGHT_LINE}')], ' ')"
    values = ", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in known)
    return f"""WITH k0 AS (SELECT * FROM (VALUES {values}) AS v(license, text)),
k1 AS (SELECT license, {lines("text")} AS lines FROM k0),
known AS (SELECT md5({whole}) AS digest, min(license) AS license FROM k1 GROUP BY 1),
d0 AS (SELECT row_number() OVER () AS row, doc_id, {lines("text")} AS lines FROM documents),
d1 AS (SELECT row, doc_id, md5({whole}) AS text_digest, [s for s in lines if s <> ''] AS lines FROM d0),
l AS (SELECT row, known.license FROM (SELECT row, unnest(lines) AS line FROM d1) JOIN known ON md5(line) = known.digest),
a AS (SELECT row, array_to_string(list_sort(list_distinct(list(license))), ',') AS line_licenses, count(*) AS n FROM l GROUP BY row)
SELECT d1.doc_id, d1.text_digest, known.license AS text_license, coalesce(a.line_licenses, '') AS line_licenses, coalesce(a.n, 0) AS n_license_lines
FROM d1 LEFT JOIN a USING (row) LEFT JOIN known ON d1.text_digest = known.digest"""
