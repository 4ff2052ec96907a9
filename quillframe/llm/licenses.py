"""Known licences by a digest of the whole normalised text, DataFrame functions only.

Normalising lower-cases, drops copyright lines, writes equivalent spellings one
way and turns every run of other characters than letters and digits into one
space. The digests of a document, as a whole and line by line (a notice is often
one line), are hash-joined to those of the known texts, which are normalised by
the same expression.

Nulls count as empty text; empty texts match nothing; texts of any length are
digested whole (units longer than every known text are left out of the join, as
they cannot match); repeated rows each get a result; rows that share an id and a
text share it; an empty table gives an empty result. Only the named columns are
read.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import text

# Texts of public licences and of their usual notices.
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BULLETS = _BSD_START.replace("1. ", "* ").replace("2. ", "* "), _BSD_THIRD.replace("3. ", "* ")


# A statement names a sign, a year or a place for one; a wrapped sentence may begin with "copyright notice".
COPYRIGHT_LINE = (
    r"(?m)^[ \t]*(copyright[^\n]*(\(c\)|©|(19|20)[0-9][0-9]|[\[<{](yyyy|year))|\(c\)[ \t]*copyright"
    r"|\(c\)[^\n]*(19|20)[0-9][0-9]|©|all rights reserved[. \t]*$)[^\n]*$"
)


def _full(name: str) -> str:
    """A stored text on one line, without its copyright lines."""
    body = (Path(__file__).parent / "licence_texts" / f"{name}.txt").read_text("utf-8")
    return " ".join(re.sub(COPYRIGHT_LINE, "", body, flags=re.IGNORECASE).split())


KNOWN: list[tuple[str, str]] = [
    ("MIT", _MIT_GRANT),
    ("MIT", "MIT License\n\n" + _MIT_GRANT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT_GRANT),
    ("ISC", _ISC_GRANT),
    ("ISC", "ISC License\n\n" + _ISC_GRANT),
    ("BSD-2-Clause", _BSD_START + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_START + _BSD_END),
    ("BSD-3-Clause", _BSD_START + _BSD_THIRD + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_START + _BSD_THIRD + _BSD_END),
    ("MIT", "MIT License"),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-only", "Licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("Apache-2.0", _full("Apache-2.0")),
    ("Apache-2.0", _full("Apache-2.0").split("APPENDIX:")[0]),
    ("GPL-2.0-only", _full("GPL-2")),
    ("GPL-3.0-only", _full("GPL-3")),
    ("LGPL-2.1-only", _full("LGPL-2.1")),
    ("GPL-2.0-only", _full("GPL-2").split("How to Apply These Terms")[0]),
    ("GPL-3.0-only", _full("GPL-3").split("How to Apply These Terms")[0]),
    ("LGPL-2.1-only", _full("LGPL-2.1").split("How to Apply These Terms")[0]),
    ("LGPL-3.0-only", _full("LGPL-3")),
    ("MPL-2.0", _full("MPL-2.0")),
    ("CC0-1.0", _full("CC0-1.0")),
    ("BSD-2-Clause", _BULLETS[0] + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BULLETS[0] + _BSD_END),
    ("BSD-3-Clause", _BULLETS[0] + _BULLETS[1] + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BULLETS[0] + _BULLETS[1] + _BSD_END),
]
# Spellings taken as equal: the first is written as the second.
SPELLINGS = [
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("sub license", "sublicense"),
    ("non-infringement", "noninfringement"),
    ("merchantibility", "merchantability"),
    ("acknowledgement", "acknowledgment"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
    ("https://", "http://"),
]
OTHER_THAN_WORDS = r"[^\p{L}\p{N}\n]+"


def normalised(column: Column) -> Column:
    """The text in its canonical spelling, line by line."""
    out = F.regexp_replace(F.lower(column), F.lit(COPYRIGHT_LINE), F.lit(""))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, F.lit(OTHER_THAN_WORDS), F.lit(" "))


def as_one(column: Column) -> Column:
    """A normalised text on one line."""
    return F.trim(F.regexp_replace(column, "[ \n]+", " "))


def scan(
    df: DataFrame,
    known: list[tuple[str, str]] = KNOWN,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, license_id, n_license_lines, line_licenses), one row per input row.

    ``license_id`` is the licence that the whole text is, else null;
    ``line_licenses`` lists the licences that single lines are, in order and
    comma-joined, else null. ``known`` is a list in code, so its broadcast is bounded.
    """
    spark = df.sparkSession
    table = (
        spark.createDataFrame(known, "license_id string, body string")
        .select("license_id", as_one(normalised(F.col("body"))).alias("body"))
        .select("license_id", F.sha2("body", 256).alias("digest"), F.length("body").alias("size"))
    )
    longest = table.agg(F.max("size")).first()[0] or 0
    table = table.groupBy("digest").agg(F.min("license_id").alias("license_id"))

    rows = df.select(F.col(f"`{id_col}`").alias("id"), text(text_col).alias("body"))
    lines = rows.select("id", F.xxhash64("body").alias("key"), normalised(F.col("body")).alias("body"))
    units = lines.select(
        "id",
        "key",
        F.posexplode(F.concat(F.array(as_one(F.col("body"))), F.split("body", "\n"))).alias("unit", "part"),
    ).select("id", "key", "unit", F.trim("part").alias("part"))
    units = units.filter((F.length("part") > 0) & (F.length("part") <= longest))
    found = (
        units.select("id", "key", "unit", F.sha2("part", 256).alias("digest"))
        .join(F.broadcast(table), "digest")
        .groupBy("id", "key")
        .agg(
            F.min(F.when(F.col("unit") == 0, F.col("license_id"))).alias("license_id"),
            F.sort_array(
                F.collect_set(F.when(F.col("unit") > 0, F.struct("unit", "license_id")))
            ).alias("lines"),
        )
        .select(
            F.col("id").alias("found_id"),
            F.col("key").alias("found_key"),
            "license_id",
            F.size("lines").cast("long").alias("n"),
            F.array_join(F.transform("lines", lambda x: x["license_id"]), ",").alias("listed"),
        )
    )
    keys = rows.select("id", F.xxhash64("body").alias("key"))
    joined = keys.join(
        found, F.col("id").eqNullSafe(F.col("found_id")) & (F.col("key") == F.col("found_key")), "left"
    )
    return joined.select(
        "id",
        "license_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_license_lines"),
        F.when(F.col("n") > 0, F.col("listed")).alias("line_licenses"),
    )
