"""Licence scans by canonical digest: whole texts, normalised alike, joined by hash to known licences.

Texts of one licence differ in letter case, punctuation, layout, the holder named in copyright
lines, and a few spellings; none of that is part of the digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Lines that name a holder, by a sign, a year or a place for one after the word, or that reserve all rights; they are left out.
#: A line of the text itself that happens to begin with "copyright", or an item "(c)" of a list, has none of these.
COPYRIGHT_LINE = r"(?m)^[ \t*#/;-]*((copyright[ \t]*(\(c\)|©|[0-9]{4}|[<\[{]))|\(c\)[ \t]*([0-9]{4}|[<\[{©])|©|all rights reserved[. \t]*$)[^\n]*$"

#: Fixed value: a title in front of the text, a paragraph of one line and few words that ends with "license".
TITLE_LINE = r"^[ \t\r\n*#/;-]*(the )?([a-z0-9.+'\"-]+ ){1,5}licen[sc]e([ ]*\([a-z0-9 .+-]+\))?[ \t:]*\r?\n[ \t]*\r?\n"

#: Equivalent spellings, from the public guidelines for matching licence texts.
EQUIVALENT = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "cancelled": "canceled",
    "centre": "center",
    "copyright owner": "copyright holder",
    "favour": "favor",
    "fulfil": "fulfill",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "licence": "license",
    "modelling": "modeling",
    "non commercial": "noncommercial",
    "organisation": "organization",
    "per cent": "percent",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "sub license": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
}


#: Short licences as their stewards publish them.
LICENSES = {
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}


def known_licenses(spark: SparkSession) -> DataFrame:
    """LICENSES as a table for ``scan_licenses``: license_id and text."""
    return spark.createDataFrame(list(LICENSES.items()), "license_id string, text string")


def canonical(text: Column) -> Column:
    """Lower case, without a title, copyright lines and punctuation, in one spelling, words divided by one space; null is empty."""
    out = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    out = F.regexp_replace(out, COPYRIGHT_LINE, "")
    out = F.regexp_replace(out, TITLE_LINE, "")
    # Two spaces between words, and one at the ends: each word has its own, so that spellings are replaced as whole words.
    out = F.concat(F.lit(" "), F.regexp_replace(out, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "  "), F.lit(" "))
    for spelling, one in EQUIVALENT.items():
        out = F.replace(out, F.lit(f" {spelling} ".replace(" ", "  ")[1:-1]), F.lit(f" {one} ".replace(" ", "  ")[1:-1]))
    return F.trim(F.regexp_replace(out, " +", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def scan_licenses(docs: DataFrame, licences: DataFrame) -> DataFrame:
    """Which known licence each whole text is.

    docs: doc_id and text; licences: license_id and text; other columns are left out. Returns a row per
    row of docs: doc_id, digest and license_id, null where the text is no known licence. Licences
    that are alike after normalisation count as the first by id. Texts that are null, empty or nothing but
    punctuation and copyright lines are no licence, nor are such entries of licences.
    Only ids and digests are shuffled, and only if the known licences are too many to be broadcast by Spark's own threshold.
    """
    known = licences.select(F.col("license_id").cast("string").alias("license_id"), canonical(F.col("text").cast("string")).alias("c")).where("c <> '' and license_id is not null")
    known = known.groupBy(F.sha2("c", 256).alias("known")).agg(F.min("license_id").alias("license_id"))
    found = docs.select("doc_id", digest(F.col("text").cast("string")).alias("digest"))
    return found.join(known, found.digest == known.known, "left").select("doc_id", "digest", "license_id")
