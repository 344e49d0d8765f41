"""Licence scans by sentence rules.

A text is cut into sentences (after ``.``, ``!``, ``?`` or ``;`` before white
space, after a colon before a list number, and at lines without a letter or
digit: blank lines, comment signs only). A sentence's lines are normalised —
lower case, everything but letters and digits one space — and from the first
line on the longest run of lines that makes up a known licence sentence gives
its identifier; a line that starts no such run is tried without its list marker,
then as a copyright line (that line only), and passed over otherwise. The
identifiers of a text, in order and without notices (copyright lines, "all
rights reserved"), form a sequence in which ordered licence rules are matched:
at each place the first rule that fits takes its identifiers. Identifiers that no
rule takes are reported as unmatched.

Sentences may have an open place for a holder's name (``OPEN``, up to 120
characters): it is filled with the usual words before the text is cut. A line with
an SPDX identifier or expression (``OR``, ``AND``, ``WITH``, brackets, ``+``) is a
sentence of its own, whose licence is the expression. A text with an unknown
condition between the conditions and the disclaimer of BSD-2 is not reported as
BSD-2. Known are: MIT, Apache-2.0, BSD-2/3, GPL-2/3, LGPL-2.1/3, AGPL-3, MPL-2.0, ISC,
CC BY, BY-SA, BY-NC and CC0, Unlicense, BSL-1.0, EPL-2.0, and any SPDX expression.

All of it is one native projection per row: no join, no shuffle, no group, so
neither a hot source nor a long text needs special care.

Defined results: null and empty texts have no sentences and no licences;
repeated licences are listed once, in order of their first place; repeated rows
give a result each; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, text_or_empty

BOUNDARY = r"[.!?;]+\s+|:\s+(?=[^\p{L}\p{N}\n]*[0-9]{1,2}[.)]\s)|\n[^\p{L}\p{N}\n]*\n"
MARKER = r"^[^\p{L}\p{N}]*(?:[0-9]{1,2}|[a-z]|[ivx]{2,4})[.)]\s"
COPYRIGHT = r"^copyright (c )?[0-9]{4}"
SPDX = (r"spdx-license-identifier:\s*(\(*[a-z0-9][a-z0-9.+-]*\)*"
        r"(?:\s+(?:or|and|with)\s+\(*[a-z0-9][a-z0-9.+-]*\)*)*)")
UNKNOWN = "?"  # stands for a sentence without an identifier

# Open places of known sentences (lower case) and what stands there in SENTENCES.
OPEN: tuple[tuple[str, str], ...] = (
    (r"neither\W+the\W+names?\W+of\W+(?s:.{1,120}?)\W+nor\W+the\W+names?\W+of\W+(?:its|their|the|any)\W+"
     r"contributors\b", "neither the name of the copyright holder nor the names of its contributors"),
    (r"this\W+software\W+is\W+provided\W+by\W+(?s:.{1,120}?)\W+as\W+is\b",
     "this software is provided by the copyright holders and contributors as is"),
)
# Identifiers and operators of SPDX expressions; what they were called before.
SPDX_NAMES = (
    "MIT Apache-2.0 BSD-2-Clause BSD-3-Clause 0BSD ISC GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later "
    "LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later MPL-2.0 CC0-1.0 "
    "CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 Unlicense BSL-1.0 EPL-1.0 EPL-2.0 Zlib Python-2.0 PSF-2.0 Artistic-2.0 "
    "WTFPL MS-PL EUPL-1.2 OFL-1.1 PostgreSQL X11 NCSA AFL-3.0 OSL-3.0 CDDL-1.0 Classpath-exception-2.0 "
    "GCC-exception-3.1 LLVM-exception Linux-syscall-note OR AND WITH").split()
SPDX_OLD = {"gpl-2.0": "GPL-2.0-only", "gpl-2.0+": "GPL-2.0-or-later", "gpl-3.0": "GPL-3.0-only",
            "gpl-3.0+": "GPL-3.0-or-later", "lgpl-2.1": "LGPL-2.1-only", "lgpl-2.1+": "LGPL-2.1-or-later",
            "lgpl-3.0": "LGPL-3.0-only", "lgpl-3.0+": "LGPL-3.0-or-later", "agpl-3.0": "AGPL-3.0-only",
            "agpl-3.0+": "AGPL-3.0-or-later"}

# Known licence sentences and their identifiers.
SENTENCES: dict[str, str] = {
    "All rights reserved.": "all-rights",
    "Released under the MIT License.": "mit-line",
    "Licensed under the MIT License.": "mit-line",
    "This project is licensed under the MIT License.": "mit-line",
    "SPDX-License-Identifier: MIT": "mit-line",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
    "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
    "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions:": "mit-grant",
    "The above copyright notice and this permission notice shall be included in all copies or substantial "
    "portions of the Software.": "mit-notice",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
    "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.":
        "mit-as-is",
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.": "mit-liability",
    "Licensed under the Apache License, Version 2.0.": "apache-line",
    "SPDX-License-Identifier: Apache-2.0": "apache-line",
    "Licensed under the Apache License, Version 2.0 (the \"License\")": "apache-grant",
    "you may not use this file except in compliance with the License.": "apache-use",
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0": "apache-copy",
    "You may obtain a copy of the License at": "apache-copy",
    "http://www.apache.org/licenses/LICENSE-2.0": "apache-copy",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is "
    "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.":
        "apache-as-is",
    "See the License for the specific language governing permissions and limitations under the License.":
        "apache-see",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met:": "bsd-use",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer.": "bsd-source",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution.":
        "bsd-binary",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
    "promote products derived from this software without specific prior written permission.": "bsd-name",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED.": "bsd-as-is",
    "SPDX-License-Identifier: BSD-3-Clause": "bsd3-line",
    "Licensed under the BSD 3-Clause License.": "bsd3-line",
    "SPDX-License-Identifier: BSD-2-Clause": "bsd2-line",
    "Licensed under the BSD 2-Clause License.": "bsd2-line",
    "This work is licensed under the GNU General Public License, version 3.": "gpl3-line",
    "SPDX-License-Identifier: GPL-3.0-only": "gpl3-line",
    "Licensed under the GNU General Public License, version 2.": "gpl2-line",
    "SPDX-License-Identifier: GPL-2.0-only": "gpl2-line",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
    "option) any later version.": "gpl3-grant",
    "This program is free software": "gpl-free",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
    "the Free Software Foundation": "gpl-terms",
    "either version 2 of the License, or (at your option) any later version.": "gpl2-version",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY": "gpl-hope",
    "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.": "gpl-implied",
    "See the GNU General Public License for more details.": "gpl-see",
    "This library is free software": "lgpl-free",
    "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
    "by the Free Software Foundation": "lgpl-terms",
    "either version 2.1 of the License, or (at your option) any later version.": "lgpl21-version",
    "either version 3 of the License, or (at your option) any later version.": "gpl3-version",
    "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY": "lgpl-hope",
    "See the GNU Lesser General Public License for more details.": "lgpl-see",
    "Licensed under the GNU Lesser General Public License, version 2.1.": "lgpl21-line",
    "Licensed under the GNU Lesser General Public License, version 3.": "lgpl3-line",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
    "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
    "your option) any later version.": "lgpl3-grant",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
    "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
    "your option) any later version.": "agpl3-grant",
    "See the GNU Affero General Public License for more details.": "agpl-see",
    "Licensed under the GNU Affero General Public License, version 3.": "agpl3-line",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v": "mpl2-grant",
    "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.":
        "mpl2-copy",
    "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.":
        "mpl2-copy",
    "Licensed under the Mozilla Public License, version 2.0.": "mpl2-line",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.": "isc-grant",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.": "isc-grant",
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
    "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.": "isc-as-is",
    "Licensed under the ISC License.": "isc-line",
    "This is free and unencumbered software released into the public domain.": "unlicense-line",
    "Distributed under the Boost Software License, Version 1.0.": "bsl-line",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
    "2.0 which is available at https://www.eclipse.org/legal/epl-2.0/": "epl2-grant",
    "Licensed under the Eclipse Public License 2.0.": "epl2-grant",
    "Licensed under CC0 1.0 Universal.": "cc0-line",
    "This work is marked with CC0 1.0 Universal.": "cc0-line",
    "The name of the author may not be used to endorse or promote products derived from this software without "
    "specific prior written permission.": "bsd-name",
    "Licensed under CC BY 4.0.": "cc-by-line",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by-line",
    "Licensed under CC BY-SA 4.0.": "cc-by-sa-line",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.":
        "cc-by-sa-line",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc-line",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.":
        "cc-by-nc-line",
}
# Rules in order, longer ones first; a licence and its identifiers.
RULES: tuple[tuple[str, str], ...] = (
    ("BSD-3-Clause", "bsd-use bsd-source bsd-binary bsd-name bsd-as-is"),
    ("BSD-2-Clause", "bsd-use bsd-source bsd-binary bsd-as-is"),
    ("MIT", "mit-grant mit-notice mit-as-is mit-liability"),
    ("MIT", "mit-grant mit-notice mit-as-is"),
    ("Apache-2.0", "apache-grant apache-use apache-copy apache-copy apache-as-is apache-see"),
    ("Apache-2.0", "apache-grant apache-use apache-copy apache-as-is apache-see"),
    ("GPL-3.0-or-later", "gpl3-grant gpl-hope gpl-implied gpl-see"),
    ("GPL-3.0-or-later", "gpl3-grant"),
    ("GPL-2.0-or-later", "gpl-free gpl-terms gpl2-version gpl-hope gpl-implied gpl-see"),
    ("GPL-2.0-or-later", "gpl-free gpl-terms gpl2-version"),
    ("LGPL-2.1-or-later", "lgpl-free lgpl-terms lgpl21-version lgpl-hope gpl-implied lgpl-see"),
    ("LGPL-2.1-or-later", "lgpl-free lgpl-terms lgpl21-version"),
    ("LGPL-3.0-or-later", "lgpl-free lgpl-terms gpl3-version lgpl-hope gpl-implied lgpl-see"),
    ("LGPL-3.0-or-later", "lgpl-free lgpl-terms gpl3-version"),
    ("LGPL-3.0-or-later", "lgpl3-grant gpl-hope gpl-implied lgpl-see"),
    ("LGPL-3.0-or-later", "lgpl3-grant"),
    ("AGPL-3.0-or-later", "agpl3-grant gpl-hope gpl-implied agpl-see"),
    ("AGPL-3.0-or-later", "agpl3-grant"),
    ("GPL-3.0-or-later", "gpl-free gpl-terms gpl3-version gpl-hope gpl-implied gpl-see"),
    ("GPL-3.0-or-later", "gpl-free gpl-terms gpl3-version"),
    ("MPL-2.0", "mpl2-grant mpl2-copy"),
    ("MPL-2.0", "mpl2-grant"),
    ("ISC", "isc-grant isc-as-is"),
    ("ISC", "isc-grant"),
    ("LGPL-2.1-only", "lgpl21-line"),
    ("LGPL-3.0-only", "lgpl3-line"),
    ("AGPL-3.0-only", "agpl3-line"),
    ("MPL-2.0", "mpl2-line"),
    ("ISC", "isc-line"),
    ("Unlicense", "unlicense-line"),
    ("BSL-1.0", "bsl-line"),
    ("EPL-2.0", "epl2-grant"),
    ("CC0-1.0", "cc0-line"),
    ("MIT", "mit-line"),
    ("Apache-2.0", "apache-line"),
    ("Apache-2.0", "apache-grant apache-use"),
    ("BSD-3-Clause", "bsd3-line"),
    ("BSD-2-Clause", "bsd2-line"),
    ("GPL-3.0-only", "gpl3-line"),
    ("GPL-2.0-only", "gpl2-line"),
    ("CC-BY-4.0", "cc-by-line"),
    ("CC-BY-SA-4.0", "cc-by-sa-line"),
    ("CC-BY-NC-4.0", "cc-by-nc-line"),
)
NOTICES = ("copyright", "all-rights")


def normal(sentence: str) -> str:
    """The normal form of a known sentence (as :func:`_normal` of a column)."""
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in sentence.lower()).split())


def _normal(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(sentence, "[^a-z0-9]+", " "))


def marked(ids: str) -> str:
    """A rule's identifiers as they stand in a sequence."""
    return "".join(f"<{i}>" for i in ids.split())


def spdx_expression(line: Column) -> Column:
    """The expression of an SPDX line in its usual spelling; empty without one."""
    spelled = {n.lower(): n for n in SPDX_NAMES} | SPDX_OLD
    names = F.create_map(*[F.lit(x) for kv in spelled.items() for x in kv])
    tokens = F.regexp_extract_all(F.regexp_extract(line, SPDX, 1), F.lit(r"[()]|[^\s()]*[^\s().]"), F.lit(0))
    said = F.array_join(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(names, t), t)), " ")
    return F.regexp_replace(F.regexp_replace(said, r"\( ", "("), r" \)", ")")


def sentence_ids(text: Column, sentences: Mapping[str, str] = SENTENCES) -> Column:
    """Identifiers of the known sentences of a text, in order; :data:`UNKNOWN` for
    every other sentence."""
    words = [normal(s).split() for s in sentences]
    most = max(map(len, words), default=1)  # lines of a run: each has a word
    starts = sorted({" ".join(w[:n]) for w in words for n in range(1, len(w) + 1)})
    known = F.create_map(*[F.lit(x) for s, i in sentences.items() for x in (normal(s), i)])
    match = "struct<at:int,next:int,id:string>"

    def lines(s: Column) -> Column:
        both = F.transform(F.split(s, "\n"), lambda y: F.struct(
            _normal(y).alias("line"), F.when(y.rlike(MARKER), _normal(F.regexp_replace(y, MARKER, ""))).alias("bare"),
            F.when(F.contains(y, F.lit("spdx-license-identifier:")), spdx_expression(y)).alias("spdx")))
        return F.filter(both, lambda y: y["line"] != "")

    def longest(b: Column, k: Column, first: Column) -> Column:
        """The longest known run of the lines ``b`` from place ``k``, its first line as ``first``."""
        runs = F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size(b) - k)), lambda n: F.struct(
            k.alias("at"), (k + n).alias("next"), F.try_element_at(known, F.concat_ws(
                " ", first, F.slice(b, k + 2, n - 1)["line"])).alias("id")).cast(match))
        return F.try_element_at(F.filter(runs, lambda m: m["id"].isNotNull()), F.lit(-1))

    def matched(b: Column, y: Column, k: Column) -> Column:
        first = F.when(y["line"].isin(starts), y["line"]).when(y["bare"].isin(starts), y["bare"])
        notice = F.when(y["line"].rlike(COPYRIGHT), F.struct(
            k.alias("at"), (k + 1).alias("next"), F.lit("copyright").alias("id")).cast(match))
        spdx = F.when(y["spdx"] != "", F.struct(k.alias("at"), (k + 1).alias("next"), F.concat(
            F.lit("spdx:"), y["spdx"]).alias("id")).cast(match))
        return F.coalesce(F.when(first.isNotNull(), longest(b, k, first)), spdx, notice)

    def of(s: Column) -> Column:
        found = let(lines(s), lambda b: F.filter(
            F.transform(b, lambda y, k: matched(b, y, k)), lambda m: m.isNotNull()))
        # runs that begin inside an earlier one go
        start = F.struct(F.lit(0).alias("next"), F.array().cast("array<string>").alias("ids"))
        return F.aggregate(found, start, lambda a, m: F.when(m["at"] >= a["next"], F.struct(
            m["next"].alias("next"), F.concat(a["ids"], F.array(m["id"])).alias("ids"))).otherwise(a),
            lambda a: F.when((F.size(a["ids"]) == 0) & s.rlike("[a-z]"), F.array(F.lit(UNKNOWN))).otherwise(a["ids"]))

    whole = F.lower(text)
    for place, words_there in OPEN:
        whole = F.regexp_replace(whole, place, words_there)
    return F.flatten(F.transform(F.split(whole, BOUNDARY), of))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  sentences: Mapping[str, str] = SENTENCES,
                  rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """``doc_id, sentence_ids, licenses, unmatched, has_notice`` per row (lists
    joined by commas)."""
    pattern = "|".join([*(marked(ids) for _, ids in rules), "<spdx:[^>]*>"])
    names = F.create_map(*[F.lit(x) for name, ids in rules for x in (marked(ids), name)])
    d = docs.select(F.col(id_col).alias("doc_id"), sentence_ids(text_or_empty(text_col), sentences).alias("all"))
    notices = F.array(*[F.lit(x) for x in NOTICES])
    sequence = F.array_join(F.transform(F.filter("all", lambda i: ~F.array_contains(notices, i)),
                                        lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")
    # an unknown condition before the disclaimer: not the licence without it
    sequence = F.regexp_replace(sequence, r"<bsd-binary>(?:<\?>)+<bsd-as-is>", "<bsd-binary><bsd-other><bsd-as-is>")
    d = d.withColumn("sequence", F.replace(sequence, F.lit(f"<{UNKNOWN}>"), F.lit(""))).withColumn(
        "ids", F.filter("all", lambda i: i != UNKNOWN))
    found = F.array_distinct(F.transform(
        F.regexp_extract_all("sequence", F.lit(pattern), F.lit(0)), lambda m: F.coalesce(
            F.try_element_at(names, m), F.regexp_extract(m, "^<spdx:(.*)>$", 1))))
    left = F.regexp_replace("sequence", pattern, "")
    return d.select(
        "doc_id", F.array_join("ids", ",").alias("sentence_ids"), F.array_join(found, ",").alias("licenses"),
        F.regexp_replace(F.regexp_replace(left, "^<|>$", ""), "><", ",").alias("unmatched"),
        F.arrays_overlap("ids", notices).alias("has_notice"))
