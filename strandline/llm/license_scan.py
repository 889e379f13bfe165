"""License scans by sentence-rule recognition. DataFrame operations only.

1. A text becomes a line of lower-cased ASCII words between three kinds of separators: a blank; a soft end, where a line
   ends or where . ! ? : ; stands before white space; a blank line, marks of comments aside. So the marks in front of
   lines, comment words among them (dnl, rem), and the places where lines are wrapped, do not matter.
2. Known licence sentences are looked for at every word, longest first, also within a run of other words; inside one, words may
   be parted by blanks or soft ends, but not by a blank line. Each is normalised and mapped to its identifier. The
   alternatives are grouped by their first word. An SPDX tag may hold several licences joined by AND or OR, and gives
   the identifier of each; a plus sign behind a version reads 'or later'.
3. The identifiers of a text, in order, are matched against ordered licence rules. A rule takes the identifiers that it
   matches, so a later rule cannot match on them again.

Both tables are parameters; the defaults follow.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import fresh

#: Sentences of public licence texts and notices, and the identifier of each. Versions that differ only in
#: case, punctuation, white space and line breaks are one sentence.
TEXTS: tuple[tuple[str, str], ...] = (
    ("apache2_line", "Licensed under the Apache License, Version 2.0."),
    ("apache2_grant", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("apache2_copy", "You may obtain a copy of the License at"),
    ("apache2_asis", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("apache2_see", "See the License for the specific language governing permissions and limitations under the License."),
    ("mit_line", "Released under the MIT License."),
    ("mit_licensed", "Licensed under the MIT License."),
    ("mit_title", "The MIT License (MIT)"),
    ("mit_grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("mit_notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit_asis", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("mit_liable", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc_grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0bsd_grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("isc_asis", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("gpl3_line", "This work is licensed under the GNU General Public License, version 3."),
    ("bsd_redistribute", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd_source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd_binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd_endorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd_asis", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("mpl2_line", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl2_copy", "If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("epl2_line", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("boost_line", "Distributed under the Boost Software License, Version 1.0."),
    ("zlib_asis", "This software is provided 'as-is', without any express or implied warranty."),
    ("zlib_grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("unlicense_free", "This is free and unencumbered software released into the public domain."),
    ("wtfpl_do", "You just DO WHAT THE FUCK YOU WANT TO."),
    ("cc0_line", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("public_domain", "This work is in the public domain."),
    ("reserved_line", "All rights reserved."),
)
#: GNU licences (SPDX stem, name, versions), whose notices differ in these only.
GNU = (("GPL", "GNU General Public License", ("2", "3")), ("LGPL", "GNU Lesser General Public License", ("2.1", "3")), ("AGPL", "GNU Affero General Public License", ("3",)))
#: Creative Commons conditions and versions, and licences whose SPDX tag is a sentence of its own.
CC_KINDS, CC_VERSIONS = ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"), ("2.0", "2.5", "3.0", "4.0")
CC_NAMES = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
TAGGED = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "MPL-2.0", "EPL-2.0", "BSL-1.0", "Zlib", "Unlicense", "CC0-1.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later")


def _spdx_version(version: str) -> str:
    return version if "." in version else f"{version}.0"


def _made() -> tuple[list[tuple[str, str]], list[tuple[str, tuple[str, ...]]]]:
    """Sentences and rules that follow from the tables of families."""
    sentences, rules = [], []
    for stem, name, versions in GNU:
        low = stem.lower()
        subject = "This program" if stem != "LGPL" else "This library"
        hope = f"{subject} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
        sentences += [(f"{low}_hope", hope)] if stem != "AGPL" else []
        for v in versions:
            spdx = f"{stem}-{_spdx_version(v)}"
            for end, tail in (("or-later", f"either version {v} of the License, or (at your option) any later version."), ("only", f"version {v} of the License.")):
                key = f"{low}{v}_{end}"
                sentences.append((key, f"{subject} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, {tail}"))
                rules += [(f"{spdx}-{end}", (key, "gpl_hope" if stem == "AGPL" else f"{low}_hope")), (f"{spdx}-{end}", (key,))]
    for kind in CC_KINDS:
        long = "-".join(CC_NAMES[x] for x in kind.split("-"))
        for v in CC_VERSIONS:
            low = f"cc_{kind.lower().replace('-', '_')}_{v}"
            sentences += [(low, f"Licensed under CC {kind} {v}."), (f"{low}_long", f"This work is licensed under a Creative Commons {long} {v} International License." if v == "4.0" else f"This work is licensed under a Creative Commons {long} {v} Unported License.")]
            rules += [(f"CC-{kind}-{v}", (low,)), (f"CC-{kind}-{v}", (f"{low}_long",))]
    for tag in TAGGED:
        sentences.append((f"spdx_{tag}", f"SPDX-License-Identifier: {tag}"))
        rules.append((tag, (f"spdx_{tag}",)))
    for stem, _, versions in GNU:  # identifiers of old: without a word behind them they mean that version only
        sentences += [(f"spdx_{stem}-{_spdx_version(v)}-only", f"SPDX-License-Identifier: {stem}-{_spdx_version(v)}") for v in versions]
    return sentences, rules


SENTENCES: tuple[tuple[str, str], ...] = (*TEXTS, *_made()[0])
#: Ordered rules (licence, identifiers that follow each other among the recognised sentences of a text): whole texts first, then parts of them.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("apache2_grant", "apache2_copy", "apache2_asis", "apache2_see")),
    ("Apache-2.0", ("apache2_grant", "apache2_copy", "apache2_asis")),
    ("Apache-2.0", ("apache2_grant",)),
    ("Apache-2.0", ("apache2_line",)),
    ("MIT", ("mit_title", "mit_grant", "mit_notice", "mit_asis", "mit_liable")),
    ("MIT", ("mit_grant", "mit_notice", "mit_asis", "mit_liable")),
    ("MIT", ("mit_grant", "mit_notice", "mit_asis")),
    ("MIT", ("mit_title",)),
    ("MIT", ("mit_line",)),
    ("MIT", ("mit_licensed",)),
    ("ISC", ("isc_grant", "isc_asis")),
    ("0BSD", ("0bsd_grant", "isc_asis")),
    ("GPL-3.0-only", ("gpl3_line",)),
    ("BSD-3-Clause", ("bsd_redistribute", "bsd_source", "bsd_binary", "bsd_endorse", "bsd_asis")),
    ("BSD-2-Clause", ("bsd_redistribute", "bsd_source", "bsd_binary", "bsd_asis")),
    ("BSD-3-Clause", ("bsd_redistribute", "bsd_endorse", "bsd_asis")),
    ("BSD-2-Clause", ("bsd_redistribute", "bsd_asis")),
    ("MPL-2.0", ("mpl2_line", "mpl2_copy")),
    ("MPL-2.0", ("mpl2_line",)),
    ("EPL-2.0", ("epl2_line",)),
    ("BSL-1.0", ("boost_line",)),
    ("Zlib", ("zlib_asis", "zlib_grant")),
    ("Unlicense", ("unlicense_free",)),
    ("WTFPL", ("wtfpl_do",)),
    ("CC0-1.0", ("cc0_line",)),
    *_made()[1],
    ("LicenseRef-public-domain", ("public_domain",)),
    ("LicenseRef-all-rights-reserved", ("reserved_line",)),
)

#: Steps that turn a text into words and ends: (pattern, what stands for it). SOFT ends a line or sentence, HARD is a blank line.
SOFT, HARD = "\u0001", "\u0002"
STEPS = (
    (r"(?m)^[^A-Za-z0-9\n]*(?:dnl|DNL|rem|Rem|REM)(?:[ \t\r]|$)", ""),
    (r"([0-9])\+", "$1 or later "),
    (r"\n[^A-Za-z0-9\n]*\n[^A-Za-z0-9]*", HARD),
    (r"\n", SOFT),
    (r"[.!?:;]([ \t\r\x01\x02]|$)", SOFT + "$1"),
    (r"[^A-Za-z0-9\x01\x02]+", " "),
)


def normalise(sentence: str) -> str:
    """Lower-case ASCII words, single blanks."""
    return re.sub(r"[^A-Za-z0-9]+", " ", sentence).strip().lower()


def known_sentences(sentences: tuple[tuple[str, str], ...] = SENTENCES) -> dict[str, str]:
    """Normalised sentence -> identifier; of equal ones the first counts."""
    out: dict[str, str] = {}
    for name, text in sentences:
        out.setdefault(normalise(text), name)
    return out


#: What parts words within a sentence, and how the tag of an SPDX expression reads.
GAP, TAG = "[ \\x01]+", normalise("SPDX-License-Identifier: ") + " "


def tagged(known: dict[str, str]) -> dict[str, str]:
    """The licences that may stand behind an SPDX tag, normalised, and the identifier of each."""
    return {n.removeprefix(TAG): name for n, name in known.items() if n.startswith(TAG)}


def _longest_first(names) -> list[str]:
    return sorted(names, key=lambda n: (-len(n), n))


def wanted(known: dict[str, str]) -> str:
    """A pattern of all known sentences by their first word, longest first, and of SPDX expressions."""
    groups: dict[str, list[str]] = {}
    for n in _longest_first(n for n in known if not n.startswith(TAG)):
        first, _, rest = n.partition(" ")
        groups.setdefault(first, []).append("".join(GAP + w for w in rest.split()))
    parts = [f"{first}(?:{'|'.join(rests)})" for first, rests in sorted(groups.items())]
    if own := "|".join(n.replace(" ", GAP) for n in _longest_first(tagged(known))):
        parts.append(f"{TAG.replace(' ', GAP)}(?:{own})\\b(?:{GAP}(?:and|or){GAP}(?:{own})\\b)*")
    return f"\\b(?:{'|'.join(parts)})\\b"


def in_tag(known: dict[str, str]) -> str:
    """A pattern of the licences of an SPDX expression whose words are parted by single blanks."""
    return f"\\b(?:{'|'.join(_longest_first(tagged(known))) or '$.'})\\b"


def expanded_rules(sentences=SENTENCES, rules=RULES) -> list[tuple[str, str]]:
    """(licence, ';a;;b;') in order; an identifier that shares its sentence with an earlier one counts as that."""
    known = known_sentences(sentences)
    name_of = {name: known[normalise(text)] for name, text in sentences}
    return [(licence, "".join(f";{name_of[n]};" for n in names)) for licence, names in rules]


def words_and_ends(text: Column) -> Column:
    """The text after STEPS, lower-cased."""
    out = text
    for pattern, sign in STEPS:
        # possessive, so that a long run without a match is passed once; lines end with \n alone
        out = F.regexp_replace(out, pattern.replace("]*", "]*+").replace("]+", "]++").replace("(?m)", "(?dm)"), sign)
    return F.lower(out)


def sentence_ids(text: Column, known: dict[str, str]) -> Column:
    """The identifiers of the known sentences of a text, in order."""
    def table(entries: dict[str, str]) -> Column:
        return F.create_map(*[F.lit(x) for kv in entries.items() for x in kv]) if entries else F.create_map().cast("map<string,string>")

    plain, tags = table(known), table(tagged(known))
    found = F.regexp_extract_all(words_and_ends(text), F.lit(wanted(known).replace("]+", "]++")), F.lit(0))
    found = F.transform(found, lambda s: F.regexp_replace(s, "[ \\x01]+", " "))

    def of(s: Column) -> Column:
        licences = F.regexp_extract_all(F.substr(s, F.lit(len(TAG))), F.lit(in_tag(known)), F.lit(0))
        return F.when(F.startswith(s, F.lit(TAG)), F.transform(licences, lambda x: F.element_at(tags, x))).otherwise(F.array(F.element_at(plain, s)))

    return F.flatten(F.transform(found, of))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences=SENTENCES, rules=RULES) -> DataFrame:
    """One row for each row of docs: id, n_sentences (recognised), sentence_ids, licenses, n_licenses.

    sentence_ids: the identifiers in order, joined by ';'. A rule matches if its identifiers follow each other in that
    order, text that is no known sentence aside. Rules are tried in the order of the table, and each takes all places
    where it matches; licenses are the distinct licences that match, in that order. Null and empty texts have no
    licence. Rows repeat as they do in docs; null ids stay null; an empty table gives an empty result; other columns
    play no part. An id column with the name of a result column is refused.
    """
    results = ("n_sentences", "sentence_ids", "licenses", "n_licenses")
    if id_col.lower() in results:
        raise ValueError(f"{id_col} is a column of the result")
    listed, taken = fresh(docs.select(id_col), "ids", "found")
    ids = docs.select(F.col(id_col), sentence_ids(F.coalesce(F.col(text_col), F.lit("")), known_sentences(sentences)).alias(listed))
    table = F.array(*[F.struct(F.lit(licence).alias("licence"), F.lit(sequence).alias("sequence")) for licence, sequence in expanded_rules(sentences, rules)])
    start = F.struct(F.array_join(F.transform(listed, lambda x: F.concat(F.lit(";"), x, F.lit(";"))), "").alias("left"), F.array().cast("array<string>").alias("found"))

    def step(acc: Column, rule: Column) -> Column:
        hit = F.contains(acc["left"], rule["sequence"])
        left = F.when(hit, F.replace(acc["left"], rule["sequence"], F.lit("#"))).otherwise(acc["left"])
        return F.struct(left.alias("left"), F.when(hit, F.array_append(acc["found"], rule["licence"])).otherwise(acc["found"]).alias("found"))

    found = F.when(F.size(listed) > 0, F.array_distinct(F.aggregate(table, start, step)["found"])).otherwise(F.array().cast("array<string>"))
    out = ids.withColumn(taken, found)
    columns = (F.size(listed).cast("long"), F.array_join(listed, ";"), F.array_join(taken, ";"), F.size(taken).cast("long"))
    return out.select(F.col(id_col), *[c.alias(name) for c, name in zip(columns, results, strict=True)])
