"""License scans: whole texts and single lines looked up by canonical digest.

Canonical form: lower case; copyright lines dropped; equivalent spellings made
one; everything but letters and digits is a single space.  A text's SHA-256 over
that form is joined with the digests of the known texts, made by the same
expression.  The known table is small by nature (the files of ``license_texts``
and the rows below, or rows given by the caller); Catalyst decides how to join it.

What follows the copyright statement of a line is looked up too: where a known
text has n words, so are the last n words of the line.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civiccases.llm.common import clean_text

# fixed values: public licence texts and the notices that stand for licences
KNOWN = [
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("LicenseRef-all-rights-reserved", "All rights reserved."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""),
]
TEXTS = Path(__file__).with_name("license_texts")
# fixed values: file of `license_texts` -> (licence, how the text begins after its title and copyright lines)
FILES = {
    "Apache-2.0": ("Apache-2.0", "TERMS AND CONDITIONS FOR USE"), "Artistic-1.0-Perl": ("Artistic-1.0-Perl", "Preamble"),
    "BSD-2-Clause": ("BSD-2-Clause", "Redistribution and use"),
    "BSD-3-Clause-UC": ("BSD-3-Clause", "Redistribution and use"), "CC0-1.0": ("CC0-1.0", "Statement of Purpose"),
    "GFDL-1.2": ("GFDL-1.2", "Everyone is permitted"), "GFDL-1.3": ("GFDL-1.3", "Everyone is permitted"),
    "GPL-1": ("GPL-1.0", "Everyone is permitted"), "GPL-2": ("GPL-2.0", "Everyone is permitted"),
    "GPL-3": ("GPL-3.0", "Everyone is permitted"), "LGPL-2": ("LGPL-2.0", "Everyone is permitted"),
    "LGPL-2.1": ("LGPL-2.1", "Everyone is permitted"), "LGPL-3": ("LGPL-3.0", "Everyone is permitted"),
    "MPL-1.1": ("MPL-1.1", "1. Definitions"), "MPL-2.0": ("MPL-2.0", "1. Definitions"),
    "Unlicense": ("Unlicense", "This is free"), "Zlib": ("Zlib", "This software is provided"),
}
# fixed values: standard notices, from their first to their last words in a file
NOTICES = [
    ("Apache-2.0", "Apache-2.0", "Licensed under the Apache License, Version 2.0 (the", "limitations under the License."),
    ("GPL-2.0-or-later", "GPL-2", "This program is free software; you can", "02110-1301 USA."),
    ("GPL-3.0-or-later", "GPL-3", "This program is free software: you can", "gnu.org/licenses/>."),
    ("LGPL-2.1-or-later", "LGPL-2.1", "This library is free software; you can", "02110-1301  USA"),
    ("MPL-2.0", "MPL-2.0", "This Source Code Form is subject to the terms", "http://mozilla.org/MPL/2.0/."),
]
# fixed values: title lines of texts that are stored without one
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"], "ISC": ["ISC License", "The ISC License"],
    "BSD-2-Clause": ["BSD 2-Clause License", 'BSD 2-Clause "Simplified" License'],
    "BSD-3-Clause": ["BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License'],
    "Zlib": ["zlib License", "The zlib License"], "Unlicense": ["The Unlicense", "Unlicense"],
}
_CLAUSE_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission.

"""
# fixed values: equivalent spellings, as whole words
SPELLINGS = [("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("licencing", "licensing"),
             ("sublicence", "sublicense"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"),
             ("authorisation", "authorization"), ("authorised", "authorized"), ("favour", "favor"),
             ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("noncommercial", "non commercial"),
             ("organisation", "organization"), ("recognise", "recognize"), ("whilst", "while"), ("v", "version"),
             ("per cent", "percent"), ("copyright owner", "copyright holder")]

# a line that only states a copyright: it begins with the word or the sign and goes on with more than punctuation
_COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n©]*(?:copyright\s*(?:\(c\)|©|[0-9])|\(c\)\s*[0-9]|©)[^\n]*$"
#: stands before a copyright line (private use; taken out of texts)
_MARK = "\ue000"
_SPELLING = r"\b(?:" + "|".join(a.replace(" ", r"\s+") for a, _ in SPELLINGS) + r")\b"


def known_texts() -> list[tuple[str, str]]:
    """(licence, text): KNOWN, the files with and without title, appendix and numbering, notices, SPDX tags."""
    def read(name: str) -> str:
        return (TEXTS / f"{name}.txt").read_text(encoding="utf-8")

    full = [(lic, text) for lic, text in KNOWN if "\n" in text]
    for name, (lic, begin) in FILES.items():
        text = read(name)
        full += [(lic, text), (lic, text[text.index(begin):])]
        if lic == "BSD-2-Clause":
            body = text[text.index(begin):]
            full.append(("BSD-3-Clause", body.replace("THIS SOFTWARE IS", _CLAUSE_3 + "THIS SOFTWARE IS", 1)))
    out = [*KNOWN, *full]
    for lic, text in full:
        for end in ("END OF TERMS AND CONDITIONS", "Exhibit A - "):
            if end in text:  # without the appendix on how to apply it
                out += [(lic, text[:text.index(end)]), (lic, text[:text.index(end)] + "END OF TERMS AND CONDITIONS")]
        # the appendix with its copyright line filled in
        out.append((lic, text.replace("Copyright [yyyy] [name of copyright owner]", "")))
        if lic.startswith("BSD"):
            plain = re.sub(r"(?m)^\s*[0-9]\. ", "", text)
            out += [(lic, f"{reserved}{x.replace('HOLDER OR', holder)}") for reserved in ("", "All rights reserved.\n")
                    for x in (text, plain) for holder in ("HOLDER OR", "HOLDERS OR")]
    out += [(lic, f"{title}\n{text}") for lic, text in out if "\n" in text for title in TITLES.get(lic, [])]
    for lic, name, begin, end in NOTICES:
        text = read(name)
        at = text.index(begin)
        out.append((lic, text[at:text.index(end, at) + len(end)]))
    ids = {lic for lic, _ in out if not lic.startswith("LicenseRef")}
    tags = {tag for lic in ids for tag in ((lic, f"{lic}-only", f"{lic}-or-later")
                                           if re.match(r"(A|L)?GPL|GFDL", lic) and "-or-" not in lic else (lic,))}
    out += [(tag, f"SPDX-License-Identifier: {tag}") for tag in tags]
    out += [(lic, text.replace("https://", "http://")) for lic, text in out if "https://" in text]
    out += [(lic, text.replace("http://", "https://")) for lic, text in out if "http://" in text]
    return sorted(set(out))


def canonical(text: Column, marked: bool = False) -> Column:
    """The canonical form; ``marked``: line breaks stay, and copyright lines stay behind a mark."""
    out, keep = F.lower(clean_text(text)), "\n" if marked else ""
    has = F.contains(out, F.lit("copyright")) | F.contains(out, F.lit("©")) | F.contains(out, F.lit("(c)"))
    new = _MARK + "$0" if marked else ""
    lines = F.regexp_replace(F.translate(out, _MARK, " "), _COPYRIGHT_LINE, new)
    out = F.when(has, F.regexp_replace(lines, rf"[^\p{{L}}\p{{N}}{_MARK}{keep}]+", " ")).otherwise(
        F.regexp_replace(out, rf"[^\p{{L}}\p{{N}}{keep}]+", " "))
    spelled = out
    for a, b in SPELLINGS:
        spelled = F.regexp_replace(spelled, rf"\b{a}\b", b)
    # the replacements run only where one of the spellings occurs
    return F.when(F.rlike(out, F.lit(_SPELLING)), spelled).otherwise(out)


def digest(canon: Column) -> Column:
    return F.sha2(F.trim(canon).cast("binary"), 256)


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license_id, words), one row a digest (the first id by name); ``known`` instead of known_texts()."""
    rows = spark.createDataFrame(known_texts() if known is None else known, "license_id string, text string")
    return (rows.select("license_id", F.trim(canonical(F.col("text"))).alias("canon")).where("canon != ''")
            .select("license_id", digest(F.col("canon")).alias("digest"), F.size(F.split("canon", " ")).alias("words"))
            .groupBy("digest").agg(F.min("license_id").alias("license_id"), F.first("words").alias("words")))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """One row for each text that is a known licence as a whole, and for each such line of any text.

    doc_id, unit ('text' or 'line'), line (null, or counted from 1 in the
    canonical lines), license_id, digest.  A text is looked up without its
    copyright lines, a copyright line by what follows the statement (or as a
    whole).  Null and empty texts, and lines without letters or digits, match
    nothing.  Repeated rows give repeated matches.  Extra columns are ignored;
    an empty table gives no rows.
    """
    sizes = sorted(r[0] for r in known.select("words").distinct().collect())
    rows = docs.select("doc_id", F.regexp_replace(clean_text("text"), "\r\n?", "\n").alias("text"))
    canon = rows.select("doc_id", canonical(F.col("text"), marked=True).alias("canon"))
    body = F.when(F.contains("canon", F.lit(_MARK)), F.regexp_replace("canon", rf"{_MARK}[^\n]*", "")).otherwise(F.col("canon"))
    whole = F.struct(F.lit("text").alias("unit"), F.lit(None).cast("int").alias("line"),
                     F.trim(F.regexp_replace(body, r"\s+", " ")).alias("body"))

    def ends(line: Column) -> Column:
        words = F.split(F.trim(F.translate(line, _MARK, " ")), " +")
        known_sizes = F.filter(F.array(*[F.lit(n) for n in sizes]), lambda n: n <= F.size(words))
        return F.transform(known_sizes, lambda n: F.array_join(F.slice(words, -n, n), " "))

    lines = F.flatten(F.transform(F.split("canon", "\n"), lambda x, i: F.transform(
        F.when(F.contains(x, F.lit(_MARK)), ends(x)).otherwise(F.array(F.trim(x))), lambda y: F.struct(
            F.lit("line").alias("unit"), (i + 1).alias("line"), y.alias("body")))))
    units = canon.select("doc_id", F.explode(F.concat(F.array(whole), lines)).alias("u")).where("u.body != ''")
    looked = units.select("doc_id", "u.unit", "u.line", F.sha2(F.col("u.body").cast("binary"), 256).alias("digest"))
    return looked.join(known.drop("words"), "digest").select("doc_id", "unit", "line", "license_id", "digest")


def license_table(docs: DataFrame, known: list[tuple[str, str]] | None = None) -> DataFrame:
    return scan(docs, known_digests(docs.sparkSession, known))
