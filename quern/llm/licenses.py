"""License scans by the digest of a canonical form.

Canonical text is lower case, without lines of copyright, of reserved rights and
of titles that aren't part of a licence, with equivalent spellings made one, and
with every run of ASCII or typographic punctuation and white space as one space.
Its SHA-256 digest is looked up among those of known licence texts,
for the whole text, and among those of known notices, for each of its lines
that speaks of a licence.

The known digests are fixed tables, computed with the same expressions and
joined by broadcast; their size doesn't depend on the data. What a text's lines
name is gathered by row from digests alone.

Cases: a null text is the empty one; an empty canonical form matches nothing;
repeated rows are alike; notices of one text are sorted by name; an empty table
gives an empty result; extra columns are ignored, whatever their names; a very
long text is read whole, a fixed number of times.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.text import whole
from quern.shared import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that is the title of a licence whose own text has none.
_TITLE = r"[\x09\x20#*=]*(?:the )?(?:(?:mit|expat|isc|zlib|zlib/libpng|bsd|new bsd|modified bsd|simplified bsd|bsd zero[ -]clause|zero[ -]clause bsd|[023]-clause bsd|bsd [023]-clause|bsd 2-clause \"simplified\"|bsd 3-clause \"(?:new|revised)\"(?: or \"revised\")?) licen[sc]e|zero[ -]clause bsd|unlicense)(?: \([a-z0-9/-]+\))?[.:*]*[\x09\x0D\x20]*"
#: A line that names a holder, without a year perhaps: no longer than eight words, for text may begin like it too.
_HOLDER = r"[\x09\x20]*(?:copyright|\(c\)|\xA9)(?:[\x09\x20]+[^\x09\x20\n]+){1,8}[\x09\x0D\x20]*"
_END = r"(?=\n|\z)"
#: Lines of holders that begin a paragraph, under a title or not; a line that begins with a copyright sign or the word and has a sign or a year (text wrapped before the word stays); a title; reserved rights.
COPYRIGHT_LINE = (
    rf"(?m)(?:\A[\x09\x0A\x0D\x20]*+|\n[\x09\x0D\x20]*+\n)(?:{_TITLE}\n)?{_HOLDER}{_END}(?:\n{_HOLDER}{_END})*+"  # possessive: Java repeats other groups by recursion, and would try each of many blanks
    r"|^[\x09\x20]*(?:copyright[\x09\x20]*(?:\(c\)|\xA9)|copyright\b[^\n]*[0-9]{4}|\(c\)[^\n]*[0-9]{4}|\xA9)[^\n]*$"
    rf"|^{_TITLE}$|^[\x09\x20]*all rights reserved[.]?[\x09\x0D\x20]*$"
)
#: ASCII but letters and digits, no-break and thin spaces, guillemets, dashes, curly quotes, bullets, dots.
PUNCTUATION = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F\xA0\xAB\xB7\xBB\u2000-\u2026\u2028\u2029\u202F\u2039\u203A\u2060\uFEFF]+"
#: Spellings that the SPDX matching guidelines hold to be equal.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"), ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"), ("licenced", "licensed"), ("maximise", "maximize"),
    ("modelled", "modeled"), ("modelling", "modeling"), ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"), ("programme", "program"),
    ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("wilfull", "willful"), ("willfull", "willful"),
    ("non commercial", "noncommercial"), ("per cent", "percent"), ("sub license", "sublicense"), ("copyright holder", "copyright owner"),
)
#: Licence texts by identifier; long ones are in ``license_texts``, which only the driver reads.
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
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>""",
}
LICENSES |= {p.stem: p.read_text("utf-8") for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
#: Names of licences as notices give them, by identifier, with or without an article before them.
NAMES = {
    "0BSD": ("0BSD", "0BSD License", "BSD Zero Clause License", "Zero-Clause BSD License"),
    "AGPL-3.0": ("AGPL 3.0", "AGPLv3", "AGPL-3.0 License", "GNU AGPL v3", "GNU Affero General Public License, version 3", "GNU Affero General Public License v3", "GNU Affero General Public License v3.0"),
    "Apache-2.0": ("Apache 2.0", "Apache 2.0 License", "Apache License 2.0", "Apache License, Version 2.0", "Apache License v2.0", 'Apache License, Version 2.0 (the "License")'),
    "Artistic-2.0": ("Artistic License 2.0", "Artistic License, Version 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause", "BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD 2-Clause Simplified License"),
    "BSD-3-Clause": ("BSD 3-Clause", "BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "BSD 3-Clause New or Revised License"),
    "BSL-1.0": ("Boost Software License 1.0", "Boost Software License, Version 1.0"),
    "CC0-1.0": ("CC0", "CC0 1.0", "CC0 1.0 Universal", "CC0 1.0 Universal License", "Creative Commons Zero v1.0 Universal", "Creative Commons CC0 1.0 Universal License"),
    "EPL-2.0": ("EPL 2.0", "Eclipse Public License 2.0", "Eclipse Public License, Version 2.0", "Eclipse Public License v2.0"),
    "EUPL-1.2": ("EUPL 1.2", "EUPL, Version 1.2", "European Union Public Licence 1.2", "European Union Public Licence v1.2"),
    "GPL-2.0": ("GPL 2.0", "GPLv2", "GPL v2", "GNU GPL v2", "GNU GPL, version 2", "GNU General Public License, version 2", "GNU General Public License v2", "GNU General Public License v2.0"),
    "GPL-3.0": ("GPL 3.0", "GPLv3", "GPL v3", "GNU GPL v3", "GNU GPL, version 3", "GNU General Public License, version 3", "GNU General Public License v3", "GNU General Public License v3.0"),
    "ISC": ("ISC", "ISC License"),
    "LGPL-2.1": ("LGPL 2.1", "LGPLv2.1", "GNU LGPL v2.1", "GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1"),
    "LGPL-3.0": ("LGPL 3.0", "LGPLv3", "GNU LGPL v3", "GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3", "GNU Lesser General Public License v3.0"),
    "MIT": ("MIT", "MIT License", "Expat License"),
    "MPL-2.0": ("MPL 2.0", "MPL-2.0 License", "Mozilla Public License 2.0", "Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License v2.0"),
    "Unlicense": ("Unlicense", "Unlicense License"),
    "Zlib": ("zlib", "zlib License"),
}
for _short, _long in (("", ""), ("-SA", "-ShareAlike"), ("-ND", "-NoDerivatives"), ("-NC", "-NonCommercial"), ("-NC-SA", "-NonCommercial-ShareAlike"), ("-NC-ND", "-NonCommercial-NoDerivatives")):
    for _v, _where in (("4.0", "International"), ("3.0", "Unported")):
        _full = f"Creative Commons Attribution{_long} {_v}"
        NAMES[f"CC-BY{_short}-{_v}"] = (f"CC BY{_short} {_v}", f"CC BY{_short} {_v} License", f"Creative Commons BY{_short} {_v} License", _full, f"{_full} License", f"{_full} {_where}", f"{_full} {_where} License")
#: What comes before the name.
LEADS = ("Licensed under", "Released under", "Distributed under", "Published under", "This work is licensed under", "This project is licensed under", "This software is licensed under", "This software is released under", "License:")
#: One-line notices by identifier.
NOTICES = {k: tuple(f"{lead} {the}{name}." for lead in LEADS for the in ("", "the ", "a ") for name in names) + tuple(f"SPDX-License-Identifier: {k}{end}" for end in (("", "-only") if "GPL" in k else ("",))) for k, names in NAMES.items()}
NOTICES |= {f"{k}-or-later": (f"SPDX-License-Identifier: {k}-or-later",) for k in NAMES if "GPL" in k}


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.translate(text, UPPER, LOWER), COPYRIGHT_LINE, "")
    # two spaces between words, so that each has its own on either side and equal neighbours are both replaced
    out = F.regexp_replace(F.concat(F.lit(" "), out, F.lit(" ")), PUNCTUATION, "  ")
    for other, one in SPELLINGS:
        out = F.replace(out, F.lit(f" {other} ".replace(" ", "  ")[1:-1]), F.lit(f" {one} ".replace(" ", "  ")[1:-1]))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark, texts: dict[str, tuple[str, ...]]) -> DataFrame:
    """``license, digest`` of a fixed table."""
    rows = [(k, t) for k, ts in texts.items() for t in ts]
    return spark.createDataFrame(rows, "license string, text string").select("license", digest(F.col("text")).alias("digest")).distinct()


def scan_licenses(docs: DataFrame, *, licenses: dict[str, str] = LICENSES, notices: dict[str, tuple[str, ...]] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, canonical_sha256, license, notices``: the licence that the whole text is, and those its lines name (sorted, comma-joined)."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "licenses")
    known = scratch.put(known_digests(spark, {k: (v,) for k, v in licenses.items()}))
    named = scratch.put(known_digests(spark, notices))
    text = whole(text_col)
    speaks = lambda x: x.rlike("(?i)licen[sc]e")
    lines = F.when(speaks(text), F.transform(F.filter(F.split(text, "\n", -1), speaks), digest)).otherwise(F.array().cast("array<string>"))
    # digests are written before the joins, so that a row's number stays its own
    rows = scratch.put(docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("doc_id"), digest(text).alias("canonical_sha256"), lines.alias("_lines")))
    told = rows.where(F.size("_lines") > 0).select("_row", F.explode("_lines").alias("digest")).join(F.broadcast(named.withColumnRenamed("license", "named")), "digest")  # fixed tables
    told = told.groupBy("_row").agg(F.array_join(F.array_sort(F.collect_set("named")), ",").alias("_named"))
    found = rows.drop("_lines").join(F.broadcast(known), F.col("canonical_sha256") == F.col("digest"), "left").join(told, "_row", "left")
    return found.select("doc_id", "canonical_sha256", "license", F.coalesce("_named", F.lit("")).alias("notices"))
