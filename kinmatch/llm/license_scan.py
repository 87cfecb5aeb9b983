"""Licence scans by canonical digest lookup.

A text is brought into canonical form: lower case, copyright lines and lines of
comment marks taken out, equivalent spellings unified, punctuation and white
space reduced to single spaces. The digest of the entire canonical text is then
hash-joined with the digests of known licence texts. A document is looked up as
a whole, and so is every paragraph (a run of lines without an empty line) and
every line of it, so that a licence text or notice that makes up a unit of its
own is found inside a longer document too; a unit that only contains a known
text among other words is not a licence text and doesn't match.

Everything is DataFrame code. Units are first held against the lengths of the
known texts; what is left is digested and joined.

Defined results: a null or empty text, and a text that is empty in canonical
form, matches nothing; equal known digests with several names give the smallest
name; repeated rows give repeated results; an empty table gives an empty result;
further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.llm.shared import narrowed

#: Known digests up to this many are sent to all tasks (under 150 bytes each).
BROADCAST_ROWS = 200_000
#: Units are first held against the known lengths if there are no more distinct ones than this.
MOST_LENGTHS = 2000

# Equivalent spellings in lower case, replaced in this order.
SPELLINGS = (
    ("https://", ""),
    ("http://", ""),
    ("licence", "license"),
    ("licencing", "licensing"),
    ("sub-license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("copyright owner", "copyright holder"),
    ("merchantibility", "merchantability"),
    ("whilst", "while"),
    ("per cent", "percent"),
    ("fulfilment", "fulfillment"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("&", " and "),
)

# Short notices by which works name their licence.
NOTICES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\")", "SPDX-License-Identifier: Apache-2.0", "License: Apache-2.0"),
    "BSD-2-Clause": ("SPDX-License-Identifier: BSD-2-Clause", "License: BSD-2-Clause"),
    "BSD-3-Clause": ("SPDX-License-Identifier: BSD-3-Clause", "License: BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "CC0-1.0": ("SPDX-License-Identifier: CC0-1.0", "Licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0", "Licensed under the GNU General Public License v3.0"),
    "ISC": ("SPDX-License-Identifier: ISC", "License: ISC"),
    "MIT": ("Licensed under the MIT License.", "Released under the MIT License.", "SPDX-License-Identifier: MIT", "License: MIT", "MIT License"),
    "MPL-2.0": ("SPDX-License-Identifier: MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "Unlicense": ("SPDX-License-Identifier: Unlicense",),
}

# The wording of short licences, without title and copyright line.
_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
)
_BSD_TAIL = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY "
    "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, "
    "STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEXTS = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _WARRANTY
    ),
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_WARRANTY,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_WARRANTY,
    "BSD-2-Clause": _BSD_HEAD + "\n" + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n" + _BSD_TAIL,
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\n"
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n"
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n"
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
        "3. This notice may not be removed or altered from any source distribution."
    ),
}
#: Titles that may stand above a licence text.
TITLES = {"MIT": ("", "MIT License", "The MIT License (MIT)"), "ISC": ("", "ISC License"), "0BSD": ("", "BSD Zero Clause License"), "BSD-2-Clause": ("", "BSD 2-Clause License"), "BSD-3-Clause": ("", "BSD 3-Clause License"), "Zlib": ("", "zlib License")}


def canonical_lines(text: Column) -> Column:
    """The canonical form with its line breaks; lines may have a space at their ends."""
    out = F.lower(text)
    marked = (F.instr(out, "copyright") > 0) | (F.instr(out, "(c)") > 0) | (F.instr(out, "©") > 0) | (F.instr(out, "all rights reserved") > 0)
    lines = F.regexp_replace(out, r"(?m)^[ \t/*#;%|>!-]*(?:copyright\b(?! (?:holder|notice|owner))|\(c\)|©|all rights reserved\.?[ \t]*$)[^\n]*$", " ")
    out = F.when(marked, lines).otherwise(out)
    for this, that in SPELLINGS:
        out = F.replace(out, F.lit(this), F.lit(that))
    out = F.regexp_replace(out, r"(?:[^\p{L}\p{N}.+\n]|\.(?![0-9]))+", " ")
    return F.regexp_replace(out, r"\bv(?:er|ersion)? ?(?=[0-9])", "version ")


def joined(lines: Column) -> Column:
    """Canonical lines as one line."""
    return F.trim(F.regexp_replace(lines, r"\s*\n\s*", " "))


def known_digests(spark: SparkSession, texts: DataFrame | None = None) -> DataFrame:
    """(digest, license, n) of the known texts; ``texts`` (license, text) adds to them. n is the canonical length."""
    rows = [(name, x) for name, all_ in NOTICES.items() for x in all_]
    rows += [(name, f"{title}\n\n{text}") for name, text in TEXTS.items() for title in TITLES[name]]
    known = spark.createDataFrame(rows, "license string, text string")
    if texts is not None:
        known = known.unionByName(narrowed(texts, license="license", text="text"))
    form = known.select("license", joined(canonical_lines(F.col("text"))).alias("form")).where("form <> ''")
    return form.select(F.sha2("form", 256).alias("digest"), "license", F.length("form").alias("n")).groupBy("digest").agg(F.min("license").alias("license"), F.first("n").alias("n"))


def license_scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, license, n) for every document, kind of unit (document, paragraph, line) and licence found in it."""
    known = known_digests(docs.sparkSession) if known is None else known
    lengths = [r["n"] for r in known.select("n").distinct().limit(MOST_LENGTHS + 1).collect()]
    longest = known.agg(F.max("n")).first()[0] or 0
    if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        known = F.broadcast(known.select("digest", "license"))
    docs = narrowed(docs, doc_id=id_col, text=text_col).where("text is not null")
    forms = docs.select("doc_id", canonical_lines(F.col("text")).alias("form"))
    kind = lambda name, units: F.transform(units, lambda u: F.struct(F.lit(name).alias("kind"), u.alias("unit")))
    lines = F.transform(F.split("form", "\n"), lambda u: F.trim(u))
    paragraphs = F.transform(F.filter(F.split("form", r"\n[ ]*\n"), lambda u: F.instr(u, "\n") > 0), joined)
    units = F.concat(kind("document", F.array(joined(F.col("form")))), kind("paragraph", paragraphs), kind("line", lines))
    n = lambda u: F.length(u["unit"])
    # a unit equal to a known text has its length
    likely = F.filter(units, (lambda u: n(u).isin(lengths)) if len(lengths) <= MOST_LENGTHS else lambda u: (n(u) > 0) & (n(u) <= longest))
    rows = forms.select("doc_id", F.explode(likely).alias("u")).select("doc_id", "u.kind", F.sha2("u.unit", 256).alias("digest"))
    return rows.join(known, "digest").groupBy("doc_id", "kind", "license").agg(F.count("*").alias("n"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence texts and notices in every document."""
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _lines_sql(text: str) -> str:
    """``canonical_lines`` in DuckDB SQL, whose patterns look neither ahead nor behind."""
    marks = r"^[ \t/*#;%|>!-]*"
    notice = rf"{marks}(copyright\b|\(c\)|©|all rights reserved\.?[ \t]*$)"
    out = f"array_to_string([CASE WHEN regexp_matches(x, '{notice}') AND NOT regexp_matches(x, '{marks}copyright (holder|notice|owner)') THEN ' ' ELSE x END FOR x IN string_split(lower({text}), chr(10))], chr(10))"
    for this, that in SPELLINGS:
        out = f"replace({out}, {_quoted(this)}, {_quoted(that)})"
    # a full stop before a digit stays: it is marked while the others go
    out = f"regexp_replace(replace({out}, chr(1), ' '), '\\.([0-9])', chr(1) || '\\1', 'g')"
    out = f"replace(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}+\\n\\x01]+', ' ', 'g'), chr(1), '.')"
    return f"regexp_replace({out}, '\\bv(?:er|ersion)? ?([0-9])', 'version \\1', 'g')"


def _joined_sql(lines: str) -> str:
    return f"trim(regexp_replace({lines}, '\\s*\\n\\s*', ' ', 'g'), ' ')"


def _sql() -> str:
    """The same rows in DuckDB SQL: whole canonical texts are joined, not their digests."""
    rows = [(name, x) for name, all_ in NOTICES.items() for x in all_]
    rows += [(name, f"{title}\n\n{text}") for name, text in TEXTS.items() for title in TITLES[name]]
    values = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in rows)
    return f"""WITH raw(license, text) AS (VALUES {values}),
known AS (SELECT form, min(license) AS license FROM (SELECT license, {_joined_sql(_lines_sql("text"))} AS form FROM raw) WHERE form <> '' GROUP BY form),
doc AS (SELECT doc_id, {_lines_sql("text")} AS form FROM documents WHERE text IS NOT NULL),
units AS (
  SELECT doc_id, 'document' AS kind, {_joined_sql("form")} AS unit FROM doc
  UNION ALL SELECT doc_id, 'paragraph', {_joined_sql("u")} FROM (SELECT doc_id, unnest(string_split_regex(form, '\\n[ ]*\\n')) AS u FROM doc) WHERE contains(u, chr(10))
  UNION ALL SELECT doc_id, 'line', trim(u, ' ') FROM (SELECT doc_id, unnest(string_split(form, chr(10))) AS u FROM doc)
)
SELECT doc_id, kind, license, count(*) AS n FROM units JOIN known ON unit = form GROUP BY doc_id, kind, license"""


OP8_SQL = _sql()
