"""Licence scans by canonical digests.

A text is brought to a canonical form: lower case, without copyright lines and the usual title of a short
licence in front, one spelling for words that licences spell in several ways, punctuation and white space as single spaces. Texts whose canonical forms'
SHA-256 equals that of a known licence are that licence, entirely; one that names its holder in a clause, or is worded otherwise, isn't. Only digests meet in the join.

Defined results: null text is an empty text; texts without a letter or digit have the digest of the empty
form and match nothing; licences with equal canonical forms are one, named by the smallest id; repeated rows
each get a row; only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import lower_ascii

# Patterns that Java's and DuckDB's engines read alike; lines end at \n alone.
COPYRIGHT_LINE = r"^[^a-z0-9\n]*(?:copyright[ \t:]*(?:\(c\)|\x{a9}|[0-9]{4}|\[yyyy\])|copyright[ \t:]+[^0-9\n]{1,80}[ \t,(][0-9]{4}[^a-z\n]*(?:all rights reserved[^\n]*)?$|\(c\)[ \t]*[0-9]{4}|\x{a9}[ \t]*[0-9]{4}|all rights reserved)[^\n]*"
MARKS = r"[\x00-/:-@\[-`{-\x7f\x{a0}\x{a9}\x{ab}\x{bb}\x{2000}-\x{206f}\x{3000}]+"
#: British and American spellings, and what licences use in place of each other; each at a word's end.
SPELLINGS = (
    (r"licenc(e|es|ed|ing|ee|ees|or|ors) ", r"licens\1 "),
    (r"is(e|es|ed|ing|ation|ations) ", r"iz\1 "),
    (r"([aeiou])ll(ed|ing) ", r"\1l\2 "),
    (r"(fav|lab|col|hon|behavi)our(s|ed|able|) ", r"\1or\2 "),
    (r" (?:whilst|while) ", r" while "),
    (r" copyright owner(s|) ", r" copyright holder\1 "),
    (r" per cent ", r" percent "),
    (r" https? ", r" http "),
    # titles, which such licences go with or without
    (r"^ (?:the )?(?:(?:mit|isc|zlib(?: libpng)?) license(?: mit| isc| zlib)?|(?:zero clause bsd|bsd zero clause|(?:(?:new|simplified|revised) )?bsd [23] clause(?: (?:new|simplified|revised))?) license|unlicense) ", r" "),
)

#: Texts of short licences, without their titles and copyright lines.
KNOWN = {
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "0BSD": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.",
    "notice-MIT": "Released under the MIT License.",
    "notice-Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "notice-CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "notice-GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
}
#: Longer ones, in files named by their ids.
KNOWN |= {f.stem: f.read_text(encoding="utf-8") for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    c = F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), f"(?md){COPYRIGHT_LINE}", "")
    c = F.concat(F.lit(" "), F.regexp_replace(c, MARKS, " "), F.lit(" "))
    for pattern, to in SPELLINGS:
        c = F.regexp_replace(c, pattern, to.replace("\\", "$"))
    return F.trim(c)


def known_licences(spark: SparkSession, texts: dict[str, str] = KNOWN) -> DataFrame:
    return spark.createDataFrame(list(texts.items()), "license_id string, text string")


def license_scan(docs: DataFrame, licences: DataFrame) -> DataFrame:
    """doc_id, canonical_sha256, license_id (null: none) for every row of docs; licences: license_id, text."""
    digest = F.sha2(canonical(F.col("text")), 256)
    known = licences.select("license_id", digest.alias("canonical_sha256"), canonical(F.col("text")).alias("c")).filter("c <> ''").groupBy("canonical_sha256").agg(F.min("license_id").alias("license_id"))
    return docs.select("doc_id", digest.alias("canonical_sha256")).join(known, "canonical_sha256", "left").select("doc_id", "canonical_sha256", "license_id")
