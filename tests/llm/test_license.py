from __future__ import annotations

import random
import re
import textwrap

import pytest

from strandline.llm import license_scan as ls

BY_NAME = dict(ls.SENTENCES)

MIT = """The MIT License (MIT)

Copyright (c) 2020 Some Author

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
APACHE = """/*
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
 */
"""
BSD3 = """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are met:
#
# 1. Redistributions of source code must retain the above copyright notice, this
#    list of conditions and the following disclaimer.
#
# 2. Redistributions in binary form must reproduce the above copyright notice,
#    this list of conditions and the following disclaimer in the documentation
#    and/or other materials provided with the distribution.
#
# 3. Neither the name of the copyright holder nor the names of its
#    contributors may be used to endorse or promote products derived from
#    this software without specific prior written permission.
#
# THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
# AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
# IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
# DISCLAIMED.
"""
GPL2 = """    This program is free software; you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation; either version 2 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""


def scan(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")
    return {r.doc_id: r for r in ls.scan_licenses(df, **options).collect()}


def words_of(sentence: str) -> tuple[str, ...]:
    return tuple(re.findall("[a-z0-9]+", sentence.lower()))


def plain_lines(text: str) -> str:
    """Without comment words in front of lines, and with plus signs behind digits read out."""
    lines = []
    for line in text.split("\n"):
        m = re.match("[^A-Za-z0-9]*([A-Za-z0-9]+)", line)
        if m and m[1] in ("dnl", "DNL", "rem", "Rem", "REM") and (m.end() == len(line) or line[m.end()] in " \t\r"):
            line = line[m.end() + 1 :]
        lines.append(line)
    return re.sub(r"(?<=[0-9])\+", " or later ", "\n".join(lines))


def brute(text: str | None, sentences=ls.SENTENCES, rules=ls.RULES) -> tuple[list[str], list[str]]:
    """Word by word: what parts two words, every known sentence tried at every word, rules on lists."""
    text = plain_lines(text or "")
    words = [(m[0].lower(), m.start(), m.end()) for m in re.finditer("[A-Za-z0-9]+", text)]
    after = []
    for i, (_, _, end) in enumerate(words):
        gap = text[end : words[i + 1][1]] if i + 1 < len(words) else "\n\n"
        after.append(2 if gap.count("\n") > 1 else 1 if "\n" in gap or re.search("[.!?:;][ \t\r]", gap) else 0)
    tables: dict[tuple, str] = {}
    for name, sentence in sentences:
        tables.setdefault(words_of(sentence), name)
    tag = words_of("SPDX-License-Identifier:")
    longest = sorted(tables, key=lambda t: -len(" ".join(t)))

    def stands(known: tuple, i: int) -> bool:
        end = i + len(known)
        return end <= len(words) and tuple(w for w, *_ in words[i:end]) == known and 2 not in after[i : end - 1]

    ids, i = [], 0
    while i < len(words):
        known = next((k for k in longest if stands(k, i)), None)
        if known is None:
            i += 1
            continue
        ids.append(tables[known])
        i += len(known)
        while known[:3] == tag and i < len(words) and words[i][0] in ("and", "or") and 2 not in after[i - 1 : i + 1]:
            more = next((k for k in longest if k[:3] == tag and stands(k[3:], i + 1)), None)
            if more is None:
                break
            ids.append(tables[more])
            i += 1 + len(more) - 3
    names = {name: tables[tuple(re.findall("[a-z0-9]+", sentence.lower()))] for name, sentence in sentences}
    left, found = list(ids), []
    for licence, sequence in rules:
        sequence = [names[n] for n in sequence]
        at = 0
        while at + len(sequence) <= len(left):
            if left[at : at + len(sequence)] == sequence:
                left[at : at + len(sequence)] = [None]
                if licence not in found:
                    found.append(licence)
            at += 1
    return ids, found


def check(spark, rows):
    got = scan(spark, rows)
    assert len(got) == len(rows)
    for i, text in rows:
        ids, found = brute(text)
        assert (got[i].sentence_ids, got[i].licenses, got[i].n_sentences, got[i].n_licenses) == (";".join(ids), ";".join(found), len(ids), len(found)), text
    return got


def test_published_texts(spark):
    texts = [MIT, APACHE, BSD3, GPL2, MIT.replace("\n", "\r\n"), MIT + "\n" + APACHE, "x = 1  // SPDX-License-Identifier: BSD-2-Clause\ny = 2", "// SPDX-License-Identifier: MIT\n", GPL2.replace("\n    ", "\n// ")]
    got = check(spark, list(enumerate(texts)))
    assert [got[i].licenses for i in range(len(texts))] == ["MIT", "Apache-2.0", "BSD-3-Clause", "GPL-2.0-or-later", "MIT", "Apache-2.0;MIT", "BSD-2-Clause", "MIT", "GPL-2.0-or-later"]


def test_published_tags_and_embedded_sentences(spark):
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/.\n"
    rows = [
        ("SPDX-License-Identifier: MIT OR Apache-2.0", "MIT;Apache-2.0"), ("/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR BSD-3-Clause */", "GPL-2.0-only"), ("# SPDX-License-Identifier: GPL-2.0\n", "GPL-2.0-only"),
        ("// SPDX-License-Identifier: GPL-2.0+", "GPL-2.0-or-later"), ("x; // SPDX-License-Identifier: LGPL-2.1+ and (MIT or ISC)", "MIT;ISC;LGPL-2.1-or-later"), ("This file is licensed under the MIT license.", "MIT"), (mpl, "MPL-2.0"),
        ("".join("dnl " + x + "\n" for x in GPL2.split("\n")), "GPL-2.0-or-later"), ("\n".join("REM" + (" " + x if x else "") for x in MIT.split("\n")), "MIT"), ("remote\nremark: all rights reserved", "LicenseRef-all-rights-reserved"),
        ("SPDX-License-Identifier: MIT\n\nOR Apache-2.0", "MIT"), ("SPDX-License-Identifier: LicenseRef-own", ""), ("notlicensed under the MIT licensee", ""), ("SPDX-License-Identifier: GPL-2.0-or-later or MIT", "MIT;GPL-2.0-or-later"),
    ]
    got = check(spark, [(i, t) for i, (t, _) in enumerate(rows)])
    assert [set(got[i].licenses.split(";")) for i in range(len(rows))] == [set(w.split(";")) for _, w in rows]


def test_id_columns_that_clash(spark):
    df = spark.createDataFrame([(7, "All rights reserved")], "a long, text string")
    for name in ("ids", "found", "licence", "Ids"):
        assert tuple(ls.scan_licenses(df.withColumnRenamed("a", name), id_col=name).first())[:2] == (7, 1)
    with pytest.raises(ValueError, match="licenses"):
        ls.scan_licenses(df.withColumnRenamed("a", "licenses"), id_col="licenses")


def test_an_earlier_rule_takes_its_sentences(spark):
    got = check(spark, [(1, MIT), (2, BSD3), (3, MIT + "\n\nThe MIT License (MIT)\n\nThe MIT License (MIT)\n")])
    rules = (("whole", ("mit_title", "mit_grant")), ("title", ("mit_title",)))
    got = scan(spark, [(1, MIT), (2, MIT + "\n" + "The MIT License (MIT)")], rules=rules)
    assert got[1].licenses == "whole" and got[2].licenses == "whole;title"


def test_rules_over_texts(spark):
    mit = "\n".join(["Some header.", BY_NAME["mit_grant"], "", BY_NAME["mit_notice"], BY_NAME["mit_asis"]])
    rows = [
        (1, mit), (3, "text. Released under  the MIT License.\nmore"), (4, BY_NAME["mit_asis"] + "\n" + BY_NAME["mit_grant"]), (5, None), (6, ""), (7, "LICENSED UNDER CC BY-NC 4.0"),
        (8, "no end Released under the MIT License."), (9, "word " * 50_000 + "\nAll rights reserved."), (10, "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.\nReleased under the MIT License."),
        (11, "Licensed under\n\nthe MIT License."), (12, "—" * 20_000 + "\n" * 3000 + "All rights\nreserved"), (13, "All rights reserved"), (14, " \n All rights reserved \n "),
    ]
    got = check(spark, rows)
    assert got[1].licenses == "MIT" and got[3].licenses == "MIT" and got[4].licenses == "" and got[7].licenses == "CC-BY-NC-4.0" and got[8].licenses == "MIT" and got[11].licenses == ""
    assert got[9].licenses == got[12].licenses == "LicenseRef-all-rights-reserved" and got[10].licenses == "Apache-2.0;MIT"


def test_random_wrapping(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(150):
        parts = [rnd.choice(["some other words", *BY_NAME.values()]) for _ in range(rnd.randint(1, 6))]
        text = rnd.choice(["\n", "\n\n", " ", ". "]).join(parts)
        mark = rnd.choice(["", "# ", " * ", "// "])
        rows.append((i, rnd.choice([str, str.upper])("\n".join(mark + x for p in text.split("\n") for x in (textwrap.wrap(p, rnd.randint(20, 90)) or [""])))))
    got = check(spark, rows)
    assert sum(r.n_licenses for r in got.values()) > 50


def test_repeated_and_empty(spark):
    df = spark.createDataFrame([(None, "All rights reserved."), (1, "x"), (1, "x")], "doc_id long, text string")
    assert ls.scan_licenses(df).count() == 3
    assert ls.scan_licenses(df.limit(0)).count() == 0
