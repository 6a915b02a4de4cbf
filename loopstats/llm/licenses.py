"""Licence scan by canonical digest: texts that only differ in form have the same digest, which is looked up.

Canonical form: lower case; lines of copyright taken out; equivalent spellings made one; punctuation to spaces; white
space to single spaces. The whole text, its paragraphs and its lines are each looked up as entire texts by a hash join
with the digests of the known licence texts and notices. DataFrame functions only.

Defined cases: null text is empty and has no licence; texts that are canonically empty match nothing; a row that repeats
an id gets the findings of all rows of that id; a null id counts as an id; an empty table gives no row.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common as C

#: Full licence texts and standard notices, one a line; a licence has a line for each common printing of it.
TEXTS = Path(__file__).with_name("license_texts.jsonl")
#: Known licence texts and notices, by SPDX identifier; more are in the file.
KNOWN = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, '
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
        '\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
        "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        'hereby granted.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO '
        "THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR "
        "BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING "
        "FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    *((x["license"], x["text"]) for x in map(json.loads, TEXTS.read_text("utf-8").splitlines())),
)
#: A line that is a copyright statement, with comment marks before it; not one that merely begins with the word.
COPYRIGHT = r"(?m)^[ \t#*/;!-]*(copyright[ \t]*(\(c\)|©|[0-9]{4}|by\b|:)|\(c\)[ \t]*[0-9]|©|all rights reserved)[^\n]*$"
#: (expression, replacement), in this order.
SPELLINGS = (
    (r"licenc", "licens"),
    (r"sub-licens", "sublicens"),
    (r"https?://", " "),
    (r"&", " and "),
    (r"non-?infringement", "noninfringement"),
    (r"\bv(ersion)?\.? ?([0-9])", r"version \2"),
    (r"isation", "ization"),
    (r"[^\p{L}\p{N}\n]+", " "),
)


def canonical(text: Column) -> Column:
    """Canonical form, its line breaks still in place."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT, "")
    for pattern, by in SPELLINGS:
        out = F.regexp_replace(out, pattern, by.replace("\\", "$"))
    return out


def _flat(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, r"[ \n]+", " "))


def known_table(spark: SparkSession, known: Sequence[tuple[str, str]] = KNOWN) -> DataFrame:
    """(license, digest); the digests are made first, so that no later plan carries the texts."""
    bodies = spark.createDataFrame(list(known), "license string, body string")
    rows = bodies.select("license", F.sha2(_flat(canonical(F.col("body"))), 256).alias("digest")).distinct().collect()
    structs = (F.struct(F.lit(r.license).alias("license"), F.lit(r.digest).alias("digest")) for r in sorted(rows))
    return spark.range(1).select(F.inline(F.array(*structs)))


def scan(docs: DataFrame, known: DataFrame, folder: str) -> DataFrame:
    """(doc_id, digest, license, licenses): the licence that the whole text is, and all that it, a paragraph or a line is.

    Texts are read and brought into form once; only their digests are kept. `known` is small if it comes from the list
    here, and is then broadcast by its measured size; a larger table of digests is joined by shuffle. Findings are
    gathered by id; texts do not move.
    """
    shaped = docs.select("doc_id", canonical(F.col("text")).alias("c")).select(
        "doc_id", _flat(F.col("c")).alias("whole"), F.split("c", r"\n *\n").alias("paragraphs"), F.split("c", "\n").alias("lines")
    )
    digest = lambda c: F.sha2(c, 256)
    pieces = F.filter(F.transform(F.concat("paragraphs", "lines"), _flat), lambda c: (c != "") & (c != F.col("whole")))
    units = F.transform(F.array_distinct(pieces), lambda c: F.unhex(digest(c)))
    rows = C.cut(shaped.select("doc_id", F.when(F.col("whole") != "", digest(F.col("whole"))).alias("digest"), units.alias("units")), folder, "digests")
    entire = rows.where("digest is not null").select("doc_id", F.unhex("digest").alias("d"), F.lit(True).alias("entire"))
    parts = rows.select("doc_id", F.explode("units").alias("d")).withColumn("entire", F.lit(False))
    listed = known.select("license", F.unhex("digest").alias("d"))
    hits = entire.union(parts).join(listed, "d").groupBy(F.col("doc_id").alias("hit_id")).agg(
        F.min(F.when(F.col("entire"), F.col("license"))).alias("license"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses")
    )
    found = rows.select("doc_id", "digest").join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")), "left")
    return found.select("doc_id", "digest", "license", "licenses")
