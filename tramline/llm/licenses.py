"""License scans by canonical digest: native DataFrame expressions from the text to the hash join.

A text is made canonical (lines that state a copyright dropped; lower case; equivalent spellings made one; all but
letters and digits turned into single spaces) and its SHA-256 is joined to the digests of known licences,
which are made by the same expressions. Whole documents are looked up, and so is every line by itself, as
corpora hold licence notices as lines of other texts.

The known texts are a table of `license_id, text`: by default `KNOWN` (short licences and notices), the whole
texts in `licence_texts` with and without their appendix, notices by name, and a line for each SPDX identifier. A
line with an SPDX expression counts for each identifier in it; what follows WITH is left out. A text of the GNU
family by itself counts as the version's "-only". The table is broadcast, as its size is checked; a larger one is
joined by a shuffle.

Defined results: a null or empty text, or one of copyright lines only, has the digest of the empty text and
matches nothing; repeated rows get a row each, and a notice that they share counts once for each; an empty table gives an empty result; an empty table of
licences matches nothing.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Equivalent spellings, from the guidelines for matching licence texts. The first becomes the second.
EQUIVALENT = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licences", "licenses"),
    ("sublicence", "sublicense"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("non commercial", "noncommercial"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("behaviour", "behavior"),
    ("cancelled", "canceled"),
    ("centre", "center"),
    ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("organisation", "organization"),
    ("percent", "per cent"),
    ("programme", "program"),
    ("wilful", "willful"),
    ("http www", "https www"),
    ("http opensource", "https opensource"),
)

#: Public licences and notices, shortest useful forms.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
GPL3_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
WTFPL = """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

0. You just DO WHAT THE FUCK YOU WANT TO."""

KNOWN = (
    ("MIT", MIT),
    ("MIT", "MIT License\n\n" + MIT),
    ("MIT", "The MIT License\n\n" + MIT),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", ISC),
    ("ISC", "ISC License\n\n" + ISC),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Zlib", ZLIB),
    ("Zlib", "zlib License\n\n" + ZLIB),
    ("Zlib", "SPDX-License-Identifier: Zlib"),
    ("Apache-2.0", APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MPL-2.0", MPL_NOTICE),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("GPL-3.0-or-later", GPL3_NOTICE),
    ("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("WTFPL", WTFPL),
)
#: Whole texts, a file for each identifier, and the list of SPDX identifiers.
TEXTS = Path(__file__).with_name("licence_texts")
#: Where the text proper ends; what follows are hints on how to use it.
APPENDIX = re.compile(r"\n[ \t]*(?:END OF TERMS AND CONDITIONS[ \t]*\n|Exhibit A - |EXHIBIT A -|ADDENDUM: How to use)")
TITLES = {
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", "Modified BSD License"),
    "BSL-1.0": ("Boost Software License 1.0",),
    "Unlicense": ("The Unlicense", "Unlicense"),
}
NAMES = {
    "0BSD": ("BSD Zero Clause License",),
    "AGPL-3.0-only": ("GNU Affero General Public License v3.0", "GNU Affero General Public License, version 3", "GNU AGPLv3 license"),
    "Apache-2.0": ("Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 License", "Apache-2.0 license"),
    "BSD-2-Clause": ("BSD 2-Clause License", "BSD-2-Clause license", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "BSD-3-Clause license", "New BSD License"),
    "BSL-1.0": ("Boost Software License 1.0", "Boost Software License, Version 1.0"),
    "CC0-1.0": ("CC0 1.0 Universal license", "CC0 license"),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International License", "CC BY 4.0 license"),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0 license"),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0 license"),
    "CC-BY-ND-4.0": ("Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 4.0 license"),
    "CC-BY-NC-SA-4.0": ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "CC BY-NC-SA 4.0 license"),
    "CC-BY-NC-ND-4.0": ("Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "CC BY-NC-ND 4.0 license"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v2.0"),
    "GPL-2.0-only": ("GNU General Public License v2.0", "GNU General Public License, version 2", "GPLv2 license"),
    "GPL-3.0-only": ("GNU General Public License v3.0", "GNU General Public License, version 3", "GPLv3 license"),
    "ISC": ("ISC License",),
    "LGPL-2.1-only": ("GNU Lesser General Public License v2.1", "GNU Lesser General Public License, version 2.1", "LGPLv2.1 license"),
    "LGPL-3.0-only": ("GNU Lesser General Public License v3.0", "GNU Lesser General Public License, version 3", "LGPLv3 license"),
    "MIT": ("MIT License",),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License, version 2.0"),
    "Unlicense": ("Unlicense",),
    "Zlib": ("zlib License",),
}
PHRASES = ("Licensed under the {}.", "Released under the {}.", "Distributed under the {}.", "This project is licensed under the {}.", "This software is licensed under the {}.", "This work is licensed under the {}.")
#: The notice of the GNU family by name and version.
GNU = (("GPL", "General", "1", "1.0"), ("GPL", "General", "2", "2.0"), ("GPL", "General", "3", "3.0"), ("LGPL", "Library General", "2", "2.0"), ("LGPL", "Lesser General", "2.1", "2.1"), ("LGPL", "Lesser General", "3", "3.0"), ("AGPL", "Affero General", "3", "3.0"))


def known_texts() -> list[tuple[str, str]]:
    """license_id and text of all that is known by default."""
    out = list(KNOWN)
    for path in sorted(TEXTS.glob("*.txt")):
        if path.name == "spdx_ids.txt":
            continue
        name, text = path.stem, path.read_text()
        end = APPENDIX.search(text)
        forms = [text] + ([text[: end.start()], text[: end.start()] + "\nEND OF TERMS AND CONDITIONS"] if end else [])
        if name.startswith("BSD-"):
            forms += [re.sub(r"(?m)^[123]\. ", "* ", text)]
        out += [(name, title + form) for form in forms for title in ("", *(f"{x}\n\n" for x in TITLES.get(name, ())))]
    out += [(i, phrase.format(name)) for i, names in NAMES.items() for name in names for phrase in PHRASES]
    for short, name, said, version in GNU:
        full = f"GNU {name} Public License"
        for choice, tail in (("only", f"version {said} of the License."), ("or-later", f"either version {said} of the License, or (at your option) any later version.")):
            for thing in ("program", "library"):
                for colon in (":", ";"):
                    head = f"This {thing} is free software{colon} you can redistribute it and/or modify it under the terms of the {full} as published by the Free Software Foundation"
                    body = f"This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {full} for more details."
                    last = f"You should have received a copy of the {full} along with this {thing}. If not, see <https://www.gnu.org/licenses/>."
                    out += [(f"{short}-{version}-{choice}", f"{head}{comma} {tail}\n\n{body}\n\n{last}") for comma in (",", ";")]
    for i in (TEXTS / "spdx_ids.txt").read_text().split():
        if not i.endswith("+"):
            gnu = re.fullmatch(r"(?:A|L)?GPL-[\d.]+|GFDL-[\d.]+", i)
            out.append((f"{i}-only" if gnu else i, f"SPDX-License-Identifier: {i}"))
    return sorted(set(out))


#: Up to this many digests are broadcast.
MAX_BROADCAST = 100_000

#: Of the SQL check: a line that starts, after comment signs, with "copyright", "(c)" or the sign, or says that all rights are reserved.
COPYRIGHT_LINE = r"(?md)^[ \t/*#;>-]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"
#: A line that states a copyright: "copyright" with a sign, a year, a placeholder or a holder's name after it; a sign by itself; or all rights reserved.
STATEMENT = (
    r"(?md)^[ \t/*#;>-]*(?:(?:©|&copy;)|\([cC]\)[ \t]*(?:(?i:copyright)|©|\d{4})|(?i:all rights reserved)"
    r"|(?i:copyright)[ \t]*[:,]?[ \t]*(?:\([cC]\)|©|&copy;|\d{4}|[\[<{]|(?i:yyyy|year\b))"
    r"|Copyright[ \t]+(?:by[ \t]+|the[ \t]+)?(?!(?:Licen[cs]e|Notice|Holder|Owner|Law|Act|Treaty|Office|Interest|Right|Statement|And|Or|In)s?\b)\p{Lu})[^\n]*$"
)
#: The statement at the head of the GNU texts, which runs over lines.
FOUNDATION = r"Copyright\s+\([cC]\)\s+[\d,\s-]{4,60}Free\s+Software\s+Foundation,\s+Inc\.?[^\"]{0,200}?(?=Everyone\s+is\s+permitted)"
#: A line with an SPDX expression, what stands between its identifiers, and a version with "or later" written as a plus.
SPDX = r"(?i)SPDX-License-Identifier:"
OPERATOR = r"(?i)[ \t()]+(?:AND|OR)[ \t()]+"
EXCEPTION = r"(?i)[ \t]+WITH[ \t]+[A-Za-z0-9.-]+"
PLUS = r"(?i)\b((?:A|L)?GPL-[\d.]+|GFDL-[\d.]+)\+"
#: What a line needs to be looked up, as long as every known text has it.
NOTICE = r"(?i)licen[cs]e|permission|software|SPDX"
NOT_WORD = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """The canonical form of a text; null counts as empty."""
    stated = F.regexp_replace(F.coalesce(text, F.lit("")), FOUNDATION, "")
    lower = F.lower(F.regexp_replace(stated, STATEMENT, ""))
    words = F.regexp_replace(lower, NOT_WORD, " ")
    # Two spaces between words, so that neighbours don't share the one that a spelling is found by.
    padded = F.concat(F.lit(" "), F.replace(F.trim(words), F.lit(" "), F.lit("  ")), F.lit(" "))
    for old, new in EQUIVALENT:
        padded = F.replace(padded, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new.replace(' ', '  ')} "))
    return F.trim(F.replace(padded, F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def notices(line: Column) -> Column:
    """What of a line is looked up: the line, or of an SPDX expression a line for each identifier."""
    plain = F.regexp_replace(F.regexp_replace(line, EXCEPTION, ""), PLUS, "$1-or-later")
    bare = F.regexp_replace(plain, r"(?i)^.*?SPDX-License-Identifier:[ \t(]*", "")
    ends = F.regexp_replace(bare, r"[ \t)]*(?:\*/|-->)?[ \t\r)]*$", "")
    each = F.transform(F.split(ends, OPERATOR, -1), lambda x: F.concat(F.lit("SPDX-License-Identifier: "), x))
    return F.when(line.rlike(SPDX), each).otherwise(F.array(line))


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """digest and license_id, one row a digest: of licences with one canonical text the least id. Empty texts are left out."""
    rows = spark.createDataFrame(known_texts(), "license_id string, text string") if known is None else known.select("license_id", "text")
    return rows.where(canonical(F.col("text")) != "").groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan(documents: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, digest, license_id (of the whole text, or null), n_license_lines and line_licenses (sorted, distinct) of every row."""
    spark = documents.sparkSession
    table = known_digests(spark, known)
    if table.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        table = F.broadcast(table)
    whole = documents.select("doc_id", digest(F.col("text")).alias("digest")).join(table, "digest", "left")
    # Only lines go on that a notice can be: few words name a licence, so what is exploded is small. A caller's table may know others.
    short = known is None or not known.where(~canonical(F.col("text")).rlike(NOTICE)).limit(1).count()
    every = F.split("text", "\n", -1)
    lines = F.filter(every, lambda x: x.rlike(NOTICE)) if short else every
    found = (
        documents.select("doc_id", "text")
        .where(F.col("text").rlike(NOTICE) if short else F.col("text").isNotNull())
        .select("doc_id", digest(F.col("text")).alias("whole"), F.posexplode(lines).alias("at", "line"))
        .select("doc_id", "whole", "at", F.explode(notices(F.col("line"))).alias("line"))
        .select("doc_id", "whole", "at", digest(F.col("line")).alias("digest"))
        .join(table, "digest")
        .groupBy(F.col("doc_id").alias("of"), "whole")
        .agg(F.countDistinct("at").alias("n"), F.array_sort(F.collect_set("license_id")).alias("ids"))
    )
    return whole.join(found, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("whole")), "left").select(
        "doc_id",
        "digest",
        "license_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_license_lines"),
        F.coalesce(F.array_join("ids", ","), F.lit("")).alias("line_licenses"),
    )


def oracle_sql() -> str:
    """The same in DuckDB's SQL, from the same fixed values."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"

    def canonical_sql(text: str) -> str:
        words = f"regexp_replace(regexp_replace(lower(coalesce({text}, '')), {quoted(COPYRIGHT_LINE.replace('(?md)', '(?m)'))}, '', 'g'), {quoted(NOT_WORD)}, ' ', 'g')"
        out = f"' ' || trim({words}) || ' '"
        for old, new in EQUIVALENT:
            out = f"replace({out}, ' {old} ', ' {new} ')"
        return f"trim({out})"

    values = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in KNOWN)
    return f"""
WITH known AS (SELECT sha256({canonical_sql("t")}) AS digest, min(i) AS license_id FROM (VALUES {values}) v(i, t) GROUP BY 1),
whole AS (SELECT doc_id, text, sha256({canonical_sql("text")}) AS digest FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
found AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids
          FROM (SELECT doc_id, sha256({canonical_sql("line")}) AS digest FROM lines WHERE regexp_matches(line, {quoted(NOTICE)})) x
          JOIN known USING (digest) GROUP BY doc_id)
SELECT w.doc_id, w.digest, k.license_id, CAST(coalesce(f.n, 0) AS BIGINT) AS n_license_lines, coalesce(f.ids, '') AS line_licenses
FROM whole w LEFT JOIN known k USING (digest) LEFT JOIN found f USING (doc_id)
"""
