"""Licence scans over the licences' own words, wrapped and commented as in their files."""

import textwrap

from stratalith.llm import license_scan as L

MIT = """MIT License

Copyright (c) 2021 Some Body

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
APACHE = """Copyright 2019 The Owners

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
APACHE_TEXT = """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions.

      "License" shall mean the terms and conditions for use, reproduction,
      and distribution as defined by Sections 1 through 9 of this document.

      "Licensor" shall mean the copyright owner or entity authorized by
      the copyright owner that is granting the License.
"""
BSD3 = """Copyright (c) 2010, The Regents
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS "AS IS" AND ANY
EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE REGENTS BE LIABLE FOR ANY DIRECT, INDIRECT
DAMAGES.
"""
CLAUSE = """
3. Neither the name of the University of Somewhere nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
GPL2 = """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
LGPL = GPL2.replace("program", "library").replace("General Public License\nas", "Lesser General Public License\nas").replace("version 2\n", "version 2.1\n")
GPL3_TEXT = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble

  The GNU General Public License is a free, copyleft license for
software and other kinds of works.

  The licenses for most software and other practical works are designed
to take away your freedom to share and change the works.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
ISC = """Copyright (c) 1999 Somebody

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""

TEXTS = {
    "MIT": MIT, "Apache": APACHE, "Apache (full)": APACHE_TEXT, "BSD-3-Clause": BSD3.format(CLAUSE), "BSD-2-Clause": BSD3.format(""), "GPL-3.0-or-later": GPL3, "GPL-2.0-or-later": GPL2, "LGPL-2.1-or-later": LGPL, "GPL-3.0": GPL3_TEXT,
    "MPL-2.0": MPL, "ISC": ISC, "CC-BY-NC-4.0": "Some words before\nLicensed under CC BY-NC 4.0.\nand after", "CC-BY-4.0": "This work is licensed under a Creative Commons\nAttribution 4.0 International License.",
    "GPL-2.0-only": "// SPDX-License-Identifier: GPL-2.0-only\nint main() {}", "GPL-3.0-only": "A title\nThis work is licensed under the GNU General Public License, version 3.\nMore.",
}


def ways(text):
    words = [" ".join(p.split()) for p in text.split("\n\n")]
    yield text
    yield text.replace("\n", "\r\n")
    yield "".join(f" * {line}".rstrip() + "\n" for line in text.splitlines())
    yield "".join(f"# {line}\n" for line in text.splitlines())
    yield "\n\n".join(words)  # not wrapped
    yield "Prose before. More of it!\n\n" + "\n\n".join(textwrap.fill(w, 40, break_on_hyphens=False) for w in words) + "\n\nProse after"


def test_licences_are_found_in_their_own_words(spark):
    rows = [(f"{name}/{k}", t) for name, text in TEXTS.items() for k, t in enumerate(ways(text))]
    got = {r.doc_id: list(r.licenses) for r in L.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    wrong = {i: v for i, v in got.items() if v != [i.split("/")[0].split(" ")[0]]}
    # a reference inside running text is found by its own line only: rewrapped, it is part of another sentence
    assert set(wrong) <= {"CC-BY-NC-4.0/4", "CC-BY-NC-4.0/5", "GPL-3.0-only/4", "GPL-3.0-only/5", "GPL-2.0-only/4", "GPL-2.0-only/5"}, wrong


def test_two_licences_and_what_no_rule_takes(spark):
    both = MIT + "\n" + GPL3
    got = L.scan(spark.createDataFrame([(1, both), (2, MIT.replace("copies or substantial", "copies and substantial")), (3, "MIT\n\nfound nothing")], "doc_id long, text string")).collect()
    by = {r.doc_id: (list(r.licenses), list(r.residue)) for r in got}
    assert by[1] == (["MIT", "GPL-3.0-or-later"], [])
    assert by[2] == ([], ["mit_title", "mit_grant", "as_is", "mit_liable"])  # a changed sentence is not the licence
    assert by[3] == ([], ["name_mit"])


def test_known_sentences_are_single_and_normalised_alike(spark):
    df = spark.createDataFrame([(s,) for s in L.SENTENCES], "s string")
    for s, parts, n in df.select("s", L.sentences(df.s), L.normalise(df.s)).collect():
        assert n == L.normal(s) and len(n) <= L.LONGEST
        assert len([p for p in parts if p]) == 1, s
    for n, (rule, _) in enumerate(L.RULES):  # no earlier rule takes a part of a later one
        assert set(rule) <= set(L.SENTENCES.values())
        assert not any("|".join(r) in "|".join(rule) and len(r) < len(rule) for r, _ in L.RULES[:n]), rule
    assert len({L.normal(s) for s in L.SENTENCES}) >= len(L.SENTENCES) - 60


def test_empty_table(spark):
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert L.scan(spark.createDataFrame([(1, "\n" * 500_000 + "a")], "doc_id long, text string")).first().hits == []


def test_license_edges(spark):
    rows = [(1, None), (2, ""), (3, "Released under the MIT License.\nX. Licensed under the Apache License, Version 2.0."), (None, "You may obtain a copy of the License at"), (4, "x. " * 200_000 + "\nReleased under the MIT License."), (3, "all rights reserved")]
    got = L.scan(spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, hits int, residue string")).collect()
    assert sorted((str(r.doc_id), list(r.licenses), list(r.residue)) for r in got) == [("1", [], []), ("2", [], []), ("3", [], ["all_rights"]), ("3", ["MIT", "Apache"], []), ("4", ["MIT"], []), ("None", [], ["apache_copy"])]
    seq = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\nRedistributions of source code must retain the above copyright notice\nRedistributions in binary form must reproduce the above copyright notice"
    r = L.scan(spark.createDataFrame([(1, seq)], "doc_id long, text string")).first()
    assert list(r.licenses) == ["BSD-2-Clause"] and len(r.hits) == 3
