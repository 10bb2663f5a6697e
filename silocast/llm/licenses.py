"""Licence scans by canonical digest lookup (operator 6), native.

A whole text is brought to a canonical form (case, punctuation, copyright
statements, equivalent spellings) with SQL functions and hashed; the digest is
joined with the digests of known licence texts. The same is done for every
line, so that a notice inside a document is found too.
"""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Usual notices and one text in a line.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
)
#: Names by which notices call a licence, without the word itself.
NAMES = (
    ("MIT", ("MIT",)),
    ("ISC", ("ISC",)),
    ("Apache-2.0", ("Apache 2.0",)),
    ("BSD-2-Clause", ("BSD 2-Clause", "2-Clause BSD", "Simplified BSD")),
    ("BSD-3-Clause", ("BSD 3-Clause", "3-Clause BSD", "New BSD", "Modified BSD")),
    ("GPL-2.0", ("GPLv2", "GPL-2.0", "GNU GPLv2", "GNU GPL v2", "GNU General Public License v2.0")),
    ("GPL-3.0", ("GPLv3", "GPL-3.0", "GNU GPLv3", "GNU GPL v3", "GNU General Public License v3.0")),
    ("LGPL-2.1", ("LGPLv2.1", "LGPL-2.1", "GNU LGPL v2.1", "GNU Lesser General Public License v2.1")),
    ("LGPL-3.0", ("LGPLv3", "LGPL-3.0", "GNU LGPL v3", "GNU Lesser General Public License v3.0")),
    ("MPL-2.0", ("MPL 2.0", "Mozilla Public License 2.0")),
    ("CC0-1.0", ("CC0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal")),
    *(
        (f"CC-{code}-{v}", (f"CC {code} {v}", f"Creative Commons {name} {v}", f"Creative Commons {name} {v} {port}"))
        for code, name in (
            ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"),
            ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
            ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
        )
        for v, port in (("4.0", "International"), ("3.0", "Unported"))
    ),
)
_LONG = (
    ("Apache-2.0", "Apache License", "2.0"), ("GPL-2.0", "GNU General Public License", "2"),
    ("GPL-3.0", "GNU General Public License", "3"), ("LGPL-2.1", "GNU Lesser General Public License", "2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License", "3"), ("MPL-2.0", "Mozilla Public License", "2.0"),
)
_SAID = (
    "Licensed under", "Released under", "This work is licensed under", "This project is licensed under",
    "This software is licensed under", "This document is licensed under",
)
_TITLES = {
    "MIT": ("", "MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("", "ISC License", "The ISC License"),
    "BSD-2-Clause": ("", "BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("", "BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License"),
}


def _notices():
    """(license, notice) of every name and wording."""
    for spdx, names in NAMES:
        spellings = (spdx, f"{spdx}-only", f"{spdx}-or-later") if "GPL" in spdx else (spdx,)
        yield from ((spdx, f"SPDX-License-Identifier: {x}") for x in spellings)
        for name in names:
            yield from ((spdx, x) for x in (f"License: {name}", f"{name} License", f"License: {name} License"))
            for said in _SAID:
                yield from ((spdx, f"{said} {x}") for x in (name, f"the {name} License", f"a {name} License"))
    for spdx, name, v in _LONG:
        for said in _SAID:
            for word in ("version ", "v"):
                yield spdx, f"{said} the {name}, {word}{v}"
                yield spdx, f"{said} the {name}, {word}{v} or later"
        yield spdx, f"{name}, version {v}"


def _texts():
    """(license, text) of the files of ``license_texts`` and of the ISC text:
    short ones with the usual titles, list numbers or none."""
    bodies = {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
    for spdx, body in (*bodies.items(), NOTICES[-1]):
        for title in _TITLES.get(spdx, ("",)):
            for rights in ("", "All rights reserved.") if spdx in _TITLES else ("",):
                for text in dict.fromkeys((body, re.sub(r"(?m)^[1-3]\. ", "* ", body)) if spdx in _TITLES else (body,)):
                    yield spdx, f"{title}\n{rights}\n{text}"


#: Licences whose notices and texts are looked up, each digest once.
KNOWN = tuple(dict.fromkeys((*NOTICES, *_notices(), *_texts())))
#: Spellings that count as equal.
SPELLINGS = (("licence", "license"), ("sublicence", "sublicense"), ("non commercial", "noncommercial"),
             ("copyright holder", "copyright owner"), ("per cent", "percent"), ("favour", "favor"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: words after "copyright" at the head of a line that is prose of a licence, not a copyright statement
PROSE = ("notice", "holder", "owner", "law", "licen", "permission", "interest", "statement", "treat", "protect", "disclaim",
         "control", "infring", "grant", "claim", "or ", "and ", "on ", "in ", "of ", "to ", "is ", "are ", "for ", "under ")


def _not(words, also: str = "") -> str:
    """A pattern of the start of a text that begins with none of ``words`` and
    no character of ``also``; RE2, which DuckDB uses, has no lookahead."""
    if "" in words:
        return r"[^\s\S]"
    heads = sorted({w[0] for w in words})
    tails = "".join(f"|{h}(?:{_not([w[1:] for w in words if w[0] == h])})" for h in heads)
    return f"[^\\n{also}{''.join(heads)}]{tails}"


STEPS = (
    (rf"(^|\n)[ \t]*(copyright[ \t]+({_not(PROSE, " ")})|copyright[ \t]*[^a-z \t\n,;.]|\(c\)|©)[^\n]*", "\n"),
    (r"[^a-z0-9\x{0080}-\x{10FFFF}]+", " "),
    *((f" {a}", f" {b}") for a, b in SPELLINGS),
)


def canonical(text: Column) -> Column:
    """The canonical form: words in lower case with one space before each."""
    out = F.translate(text, UPPER, LOWER)
    for i, (pattern, by) in enumerate(STEPS):
        out = F.regexp_replace(out, pattern, by)
        out = F.concat(F.lit(" "), out) if i == 1 else out
    return F.trim(F.regexp_replace(out, " +", " "))


def known_licenses(spark: SparkSession, known=KNOWN) -> DataFrame:
    """(digest, license): as many rows as ``known`` has, at most."""
    values = json.dumps([{"license": a, "body": b} for a, b in known])
    listed = F.from_json(F.lit(values), "array<struct<license: string, body: string>>")
    rows = spark.range(1).select(F.inline(listed))
    return rows.groupBy(F.sha2(canonical(F.col("body")), 256).alias("digest")).agg(F.min("license").alias("license"))


def license_scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, canonical_sha256, license, line_licenses) per row of ``docs``.

    license: the known licence whose canonical text the whole text has, else
    null; a very long text counts whole. line_licenses: the sorted distinct licences of its lines, joined by
    a comma, empty without any. A null or empty text has the digest of the
    empty string and no licence. Repeated rows stay; null ids stay; empty
    input gives an empty result; other columns are ignored. The known digests
    are broadcast: their number is that of the licence list, not of the data.
    """
    spark = docs.sparkSession
    known = F.broadcast(known_licenses(spark) if known is None else known)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key")
    )
    whole = rows.select("doc_id", "key", F.sha2(canonical(F.col("text")), 256).alias("canonical_sha256"))
    whole = whole.join(known, F.col("canonical_sha256") == F.col("digest"), "left").drop("digest")
    lines = rows.select("doc_id", "key", F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.select(F.col("doc_id").alias("of"), F.col("key").alias("text_key"), F.sha2(canonical(F.col("line")), 256).alias("digest"))
    lines = lines.join(known, "digest").groupBy("of", "text_key")
    lines = lines.agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("line_licenses"))
    out = whole.join(lines, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("text_key")), "left")
    return out.select("doc_id", "canonical_sha256", "license", F.coalesce("line_licenses", F.lit("")).alias("line_licenses"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _sql(known=KNOWN) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"

    def form(x: str) -> str:
        out = f"translate({x}, '{UPPER}', '{LOWER}')"
        for i, (pattern, by) in enumerate(STEPS):
            by = "chr(10)" if by == "\n" else quoted(by)
            out = f"regexp_replace({out}, {quoted(pattern)}, {by}, 'g')"
            out = f"concat(' ', {out})" if i == 1 else out
        return f"sha256(trim(regexp_replace({out}, ' +', ' ', 'g'), ' '))"

    values = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in known)
    return f"""
WITH known AS (SELECT {form("body")} AS digest, min(license) AS license FROM (VALUES {values}) k(license, body) GROUP BY 1),
docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line FROM docs),
found AS (
  SELECT l.doc_id, l.text, string_agg(DISTINCT k.license, ',' ORDER BY k.license) AS line_licenses
  FROM lines l JOIN known k ON {form("l.line")} = k.digest GROUP BY ALL)
SELECT d.doc_id, {form("d.text")} AS canonical_sha256, k.license, coalesce(f.line_licenses, '') AS line_licenses
FROM docs d LEFT JOIN known k ON {form("d.text")} = k.digest
LEFT JOIN found f ON f.doc_id = d.doc_id AND f.text = d.text
"""


QUERIES = {"op6_license_digests": op6}
ORACLES = {"op6_license_digests": _sql()}
