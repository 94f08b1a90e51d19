"""Licence scans by sentence rules.

A text is cut into sentences: at sentence ends and at empty lines (lines without
letters or digits), so the lines of a wrapped paragraph are read on. Each
sentence is normalised (lower case, anything but letters and digits to one
space, years and names of holders to a mark) and looked up among known licence
sentences; a sentence that is not known is looked up line by line, for licence
lines within other text. What stays is the document's sequence of identifiers,
and ordered rules (longest first) turn runs of identifiers into licences.
Column expressions only; no shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from stratalith.llm.keys import table

#: Sentence -> identifier. Sentences are normalised as the texts are, so case, wrapping, quotes, years and holders play no part.
SENTENCES = {
    # references of a line
    "Licensed under the Apache License, Version 2.0": "apache_ref",
    'Licensed under the Apache License, Version 2.0 (the "License");': "apache_ref",
    'Licensed under the Apache License, Version 2.0 (the "License")': "apache_ref",
    "Released under the Apache License, Version 2.0": "apache_ref",
    "This project is licensed under the Apache License 2.0": "apache_ref",
    "Released under the MIT License": "mit_ref",
    "Licensed under the MIT License": "mit_ref",
    "This project is licensed under the MIT License": "mit_ref",
    "Permission is hereby granted under the MIT License": "mit_ref",
    "The MIT License (MIT)": "mit_title",
    "The MIT License": "mit_title",
    "MIT License": "mit_title",
    "This work is licensed under the GNU General Public License, version 3": "gpl3_ref",
    "This program is licensed under the GNU General Public License, version 3": "gpl3_ref",
    "Licensed under the GNU General Public License v3.0": "gpl3_ref",
    "This work is licensed under the GNU General Public License, version 2": "gpl2_ref",
    "This program is licensed under the GNU General Public License, version 2": "gpl2_ref",
    "Licensed under the GNU General Public License v2.0": "gpl2_ref",
    "Licensed under CC BY 4.0": "cc_by_ref",
    "Licensed under CC BY-SA 4.0": "cc_by_sa_ref",
    "Licensed under CC BY-NC 4.0": "cc_by_nc_ref",
    "Licensed under CC BY-ND 4.0": "cc_by_nd_ref",
    "Licensed under CC BY-NC-SA 4.0": "cc_by_nc_sa_ref",
    "Licensed under CC BY-NC-ND 4.0": "cc_by_nc_nd_ref",
    "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc_by_ref",
    "This work is licensed under the Creative Commons Attribution 4.0 International License": "cc_by_ref",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc_by_sa_ref",
    "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License": "cc_by_sa_ref",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "cc_by_nc_ref",
    "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License": "cc_by_nc_ref",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License": "cc_by_nd_ref",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License": "cc_by_nc_sa_ref",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License": "cc_by_nc_nd_ref",
    "All rights reserved": "all_rights",
    # SPDX: the key is cut off at its colon, the name is a sentence of its own
    "SPDX-License-Identifier:": "spdx",
    "MIT": "name_mit", "ISC": "name_isc", "Apache-2.0": "name_apache", "BSD-2-Clause": "name_bsd2", "BSD-3-Clause": "name_bsd3", "MPL-2.0": "name_mpl", "Unlicense": "name_unlicense", "CC0-1.0": "name_cc0",
    "GPL-2.0-only": "name_gpl2", "GPL-2.0": "name_gpl2", "GPL-2.0-or-later": "name_gpl2_later", "GPL-2.0+": "name_gpl2_later", "GPL-3.0-only": "name_gpl3", "GPL-3.0": "name_gpl3", "GPL-3.0-or-later": "name_gpl3_later",
    "LGPL-2.1-only": "name_lgpl21", "LGPL-2.1-or-later": "name_lgpl21_later", "LGPL-3.0-only": "name_lgpl3", "LGPL-3.0-or-later": "name_lgpl3_later", "AGPL-3.0-only": "name_agpl3", "AGPL-3.0-or-later": "name_agpl3_later",
    # Apache: the notice, and sentences of the full text
    "you may not use this file except in compliance with the License.": "apache_comply",
    "You may obtain a copy of the License at": "apache_copy",
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.': "apache_asis",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis": "apache_asis",
    "See the License for the specific language governing permissions and limitations under the License.": "apache_see",
    "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/": "apache_title",
    "Apache License Version 2.0, January 2004 https://www.apache.org/licenses/": "apache_title",
    "Apache License Version 2.0, January 2004": "apache_title",
    "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION": "apache_terms",
    '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.': "apache_define",
    '"Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.': "apache_licensor",
    # MIT
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:': "mit_grant",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit_grant",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.": "mit_notice",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.': "as_is",
    "The software is provided as is, without warranty of any kind, express or implied": "as_is",
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.": "mit_liable",
    # ISC and 0BSD
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "isc_grant",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "isc_grant",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.": "zero_bsd_grant",
    # BSD
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "bsd_grant",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.": "bsd_source",
    "Redistributions of source code must retain the above copyright notice": "bsd_source",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.": "bsd_binary",
    "Redistributions in binary form must reproduce the above copyright notice": "bsd_binary",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "bsd_endorse",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products": "bsd_endorse",
    "All advertising materials mentioning features or use of this software must display the following acknowledgement:": "bsd_advertise",
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.': "bsd_asis",
    # GPL, LGPL, AGPL: the notices of a file
    "you can redistribute it and/or modify": "gpl_free",
    "This program is free software;": "free_program",
    "This program is free software:": "free_program",
    "This library is free software;": "free_program",
    "This library is free software:": "free_program",
    "it under the terms of the GNU General Public License as published by the Free Software Foundation": "gpl_terms",
    "it under the terms of the GNU General Public License as published by the Free Software Foundation;": "gpl_terms",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;": "gpl_grant",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.": "gpl2_only",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 2.": "gpl2_only",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3.": "gpl3_only",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "gpl3_grant",
    "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "agpl3_grant",
    "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "lgpl3_grant",
    "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;": "lgpl_grant",
    "either version 2 of the License, or (at your option) any later version.": "version2_later",
    "either version 2.1 of the License, or (at your option) any later version.": "version21_later",
    "either version 3 of the License, or (at your option) any later version.": "version3_later",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;": "gpl_hope",
    "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;": "gpl_hope",
    "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.": "gpl_implied",
    # GPL, LGPL, AGPL: the full texts
    "GNU GENERAL PUBLIC LICENSE Version 2, June 1991": "gpl2_title",
    "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007": "gpl3_title",
    "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007": "agpl3_title",
    "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999": "lgpl21_title",
    "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007": "lgpl3_title",
    "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.": "gpl_verbatim",
    "The GNU General Public License is a free, copyleft license for software and other kinds of works.": "gpl3_preamble",
    "The licenses for most software are designed to take away your freedom to share and change it.": "gpl_preamble",
    "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.": "agpl3_preamble",
    # MPL, zlib, BSL, Unlicense, CC0, CC
    "This Source Code Form is subject to the terms of the Mozilla Public License, v.": "mpl_ref",
    "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.": "mpl_copy",
    "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.": "mpl_copy",
    "Mozilla Public License Version 2.0": "mpl_title",
    "This software is provided 'as-is', without any express or implied warranty.": "zlib_asis",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:": "zlib_grant",
    "Boost Software License - Version 1.0 - August 17th, 2003": "bsl_title",
    "Distributed under the Boost Software License, Version 1.0.": "bsl_ref",
    "This is free and unencumbered software released into the public domain.": "unlicense",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.": "unlicense_free",
    "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.": "cc0_waive",
    "CC0 1.0 Universal": "cc0_title",
    "Creative Commons Attribution 4.0 International": "cc_by_title",
    "Creative Commons Attribution-ShareAlike 4.0 International": "cc_by_sa_title",
    "Creative Commons Attribution-NonCommercial 4.0 International": "cc_by_nc_title",
    "Creative Commons Attribution 4.0 International Public License": "cc_by_text",
    "Creative Commons Attribution-ShareAlike 4.0 International Public License": "cc_by_sa_text",
    "Creative Commons Attribution-NonCommercial 4.0 International Public License": "cc_by_nc_text",
}
#: Identifier sequences -> licence, in the order in which they are tried: longer before shorter, so that no rule takes a part of a longer one.
RULES = (
    (("apache_ref", "apache_comply", "apache_copy", "apache_asis", "apache_see"), "Apache"),
    (("bsd_grant", "bsd_source", "bsd_binary", "bsd_advertise", "bsd_endorse", "bsd_asis"), "BSD-4-Clause"),
    (("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse", "bsd_asis"), "BSD-3-Clause"),
    (("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse", "as_is"), "BSD-3-Clause"),
    (("mit_title", "mit_grant", "mit_notice", "as_is", "mit_liable"), "MIT"),
    (("free_program", "lgpl_grant", "version21_later", "gpl_hope", "gpl_implied"), "LGPL-2.1-or-later"),
    (("free_program", "gpl_grant", "version2_later", "gpl_hope", "gpl_implied"), "GPL-2.0-or-later"),
    (("free_program", "gpl_grant", "version3_later", "gpl_hope", "gpl_implied"), "GPL-3.0-or-later"),
    (("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"), "BSD-3-Clause"),
    (("bsd_grant", "bsd_source", "bsd_binary", "bsd_asis"), "BSD-2-Clause"),
    (("mit_grant", "mit_notice", "as_is", "mit_liable"), "MIT"),
    (("apache_title", "apache_terms", "apache_define", "apache_licensor"), "Apache"),
    (("free_program", "gpl3_grant", "gpl_hope", "gpl_implied"), "GPL-3.0-or-later"),
    (("free_program", "gpl3_only", "gpl_hope", "gpl_implied"), "GPL-3.0-only"),
    (("free_program", "gpl2_only", "gpl_hope", "gpl_implied"), "GPL-2.0-only"),
    (("free_program", "agpl3_grant", "gpl_hope", "gpl_implied"), "AGPL-3.0-or-later"),
    (("free_program", "lgpl3_grant", "gpl_hope", "gpl_implied"), "LGPL-3.0-or-later"),
    (("free_program", "gpl_free", "gpl_terms", "version2_later"), "GPL-2.0-or-later"),
    (("free_program", "gpl_free", "gpl_terms", "version3_later"), "GPL-3.0-or-later"),
    (("free_program", "lgpl_grant", "version21_later"), "LGPL-2.1-or-later"),
    (("free_program", "gpl_grant", "version2_later"), "GPL-2.0-or-later"),
    (("free_program", "gpl_grant", "version3_later"), "GPL-3.0-or-later"),
    (("gpl2_title", "gpl_verbatim", "gpl_preamble"), "GPL-2.0"),
    (("gpl3_title", "gpl_verbatim", "gpl3_preamble"), "GPL-3.0"),
    (("agpl3_title", "gpl_verbatim", "agpl3_preamble"), "AGPL-3.0"),
    (("lgpl21_title", "gpl_verbatim", "gpl_preamble"), "LGPL-2.1"),
    (("bsd_grant", "bsd_source", "bsd_binary"), "BSD-2-Clause"),
    (("mit_grant", "mit_notice", "as_is"), "MIT"),
    (("isc_grant", "as_is"), "ISC"),
    (("mit_grant", "mit_notice"), "MIT"),
    (("free_program", "gpl3_grant"), "GPL-3.0-or-later"),
    (("free_program", "gpl3_only"), "GPL-3.0-only"),
    (("free_program", "gpl2_only"), "GPL-2.0-only"),
    (("free_program", "agpl3_grant"), "AGPL-3.0-or-later"),
    (("free_program", "lgpl3_grant"), "LGPL-3.0-or-later"),
    (("lgpl3_title", "gpl_verbatim"), "LGPL-3.0"),
    (("free_program", "gpl_free", "gpl_terms"), "GPL"),
    (("mpl_ref", "mpl_copy"), "MPL-2.0"),
    (("zlib_asis", "zlib_grant"), "Zlib"),
    (("unlicense", "unlicense_free"), "Unlicense"),
    (("cc_by_title", "cc_by_text"), "CC-BY-4.0"),
    (("cc_by_sa_title", "cc_by_sa_text"), "CC-BY-SA-4.0"),
    (("cc_by_nc_title", "cc_by_nc_text"), "CC-BY-NC-4.0"),
    *((("spdx", f"name_{name}"), licence) for name, licence in (
        ("mit", "MIT"), ("isc", "ISC"), ("apache", "Apache"), ("bsd2", "BSD-2-Clause"), ("bsd3", "BSD-3-Clause"), ("mpl", "MPL-2.0"), ("unlicense", "Unlicense"), ("cc0", "CC0-1.0"),
        ("gpl2", "GPL-2.0-only"), ("gpl2_later", "GPL-2.0-or-later"), ("gpl3", "GPL-3.0-only"), ("gpl3_later", "GPL-3.0-or-later"), ("lgpl21", "LGPL-2.1-only"), ("lgpl21_later", "LGPL-2.1-or-later"),
        ("lgpl3", "LGPL-3.0-only"), ("lgpl3_later", "LGPL-3.0-or-later"), ("agpl3", "AGPL-3.0-only"), ("agpl3_later", "AGPL-3.0-or-later"))),
    (("apache_ref",), "Apache"), (("apache_title",), "Apache"), (("gpl3_ref",), "GPL-3.0-only"), (("gpl2_ref",), "GPL-2.0-only"), (("mit_ref",), "MIT"), (("isc_grant",), "ISC"), (("zero_bsd_grant",), "0BSD"),
    (("gpl2_title",), "GPL-2.0"), (("gpl3_title",), "GPL-3.0"), (("agpl3_title",), "AGPL-3.0"), (("lgpl21_title",), "LGPL-2.1"), (("lgpl3_title",), "LGPL-3.0"),
    (("mpl_title",), "MPL-2.0"), (("zlib_grant",), "Zlib"), (("bsl_title",), "BSL-1.0"), (("bsl_ref",), "BSL-1.0"), (("unlicense",), "Unlicense"), (("cc0_waive",), "CC0-1.0"), (("cc0_title",), "CC0-1.0"),
    (("cc_by_ref",), "CC-BY-4.0"), (("cc_by_sa_ref",), "CC-BY-SA-4.0"), (("cc_by_nc_ref",), "CC-BY-NC-4.0"), (("cc_by_nd_ref",), "CC-BY-ND-4.0"), (("cc_by_nc_sa_ref",), "CC-BY-NC-SA-4.0"), (("cc_by_nc_nd_ref",), "CC-BY-NC-ND-4.0"),
)

#: Normalisation as (pattern, replacement), in this order, after lower case; Java, RE2 and Python read these alike.
STEPS = (
    ("[^a-z0-9]+", " "),
    (r"\b(19|20)[0-9][0-9]\b", "Y"),
    ("neither the name of .* nor the names of its contributors", "neither the name of H nor the names of its contributors"),
    ("this software is provided by .* as is and any express", "this software is provided by H as is and any express"),
    ("in no event shall .* be liable for any claim", "in no event shall H be liable for any claim"),
    ("possible under law .* has waived all", "possible under law H has waived all"),
)
#: A line without letters and digits ends a paragraph; . ! ? ; or : before white space ends a sentence.
PARAGRAPH, END, CUT = r"\n[^\p{L}\p{N}]*\n", r"([.!?;:])[ \t\r\n]+", "\x01"
#: Longer ones are no licence sentences.
LONGEST = 1000


def normal(sentence: str) -> str:
    """What normalise() gives, for one string."""
    s = sentence.lower()
    for pattern, to in STEPS:
        s = re.sub(pattern, to, s).strip(" ")
    return s


def sentences(text: Column) -> Column:
    t = F.regexp_replace(F.coalesce(text, F.lit("")), PARAGRAPH, CUT)
    return F.split(F.regexp_replace(t, END, "$1" + CUT), CUT)


def normalise(sentence: Column) -> Column:
    s = F.lower(sentence)
    for pattern, to in STEPS:
        s = F.trim(F.regexp_replace(s, pattern, to))
    return s


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: dict[str, str] | None = None, rules=RULES) -> DataFrame:
    """Licences of each text.

    known maps sentences, as they stand in a licence, to identifiers; rules are
    identifier sequences with their licence, in the order of trial.

    Returns doc_id, hits (array of struct(id, sentence: index from 0; a sentence
    that is read by lines counts once a line)), licenses (in text order;
    identifiers that no rule took are left out) and residue (those identifiers),
    a row for each input row.

    Null or empty text has no hits. Rows are judged one by one, so nulls, ties
    and repeats of ids play no part. Other columns are ignored. Whole texts are
    read, however long. An empty table gives an empty result.
    """
    known = {normal(s): i for s, i in (SENTENCES if known is None else known).items()}
    if not known:
        raise ValueError("no known sentences")
    lookup = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))
    shortest = min(map(len, known))
    # a raw sentence shorter than every known one cannot match, nor one of quite another length
    found = lambda s: F.when(F.length(s).between(shortest, LONGEST), lookup[normalise(s)])
    by_lines = lambda s: F.transform(F.split(s, "\n"), found)
    one = lambda s: F.when(~s.contains("\n"), F.array(found(s))).when(found(s).isNotNull(), F.array(found(s))).otherwise(by_lines(s))
    ids = F.transform(F.flatten(F.transform(sentences(F.col(f"`{text_col}`").cast("string")), one)), lambda x, i: F.struct(x.alias("id"), i.cast("int").alias("sentence")))
    df = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.filter(ids, lambda p: p["id"].isNotNull()).alias("hits"))
    seq = F.concat(F.lit("|"), F.concat_ws("", F.transform("hits", lambda p: F.concat(p["id"], F.lit("|")))))
    for rule, name in rules:
        # adjoining matches share a bar, so bars are doubled first
        seq = F.replace(F.replace(F.replace(seq, F.lit("|"), F.lit("||")), F.lit("|" + "||".join(rule) + "|"), F.lit(f"|={name}|")), F.lit("||"), F.lit("|"))
    # most texts hold no identifier: nothing to match
    taken = F.when(F.size("hits") > 0, F.filter(F.split(seq, r"\|"), lambda x: x != "")).otherwise(F.array().cast("array<string>"))
    df = df.select("doc_id", "hits", taken.alias("_taken"))
    return df.select("doc_id", "hits", F.transform(F.filter("_taken", lambda x: x.startswith("=")), lambda x: F.substring(x, F.lit(2), F.length(x))).alias("licenses"), F.filter("_taken", lambda x: ~x.startswith("=")).alias("residue"))


def query(spark, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    join = lambda c: F.concat_ws(",", c)
    return out.select(
        "doc_id", F.size("hits").cast("long").alias("n_hits"), F.concat_ws(",", F.transform("hits", lambda h: F.concat(h["sentence"].cast("string"), F.lit(":"), h["id"]))).alias("hits"), join("licenses").alias("licenses"), join("residue").alias("residue")
    )


def _sql() -> str:
    """The same by joins: sentences and lines as rows, rules as a recursion over them in their order."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    norm = "lower({})"
    for pattern, to in STEPS:
        norm = f"trim(regexp_replace({norm}, {quote(pattern)}, {quote(to)}, 'g'))"
    known = ", ".join(f"({quote(s)}, {quote(i)})" for s, i in SENTENCES.items())
    rules = ", ".join(f"({k}, {quote('|' + '||'.join(ids) + '|')}, {quote(name)})" for k, (ids, name) in enumerate(RULES, 1))
    return rf"""
WITH RECURSIVE raw(s, id) AS (VALUES {known}), k AS (SELECT DISTINCT {norm.format('s')} AS s, id FROM raw), rules(n, ids, name) AS (VALUES {rules}),
d AS (SELECT doc_id, row_number() OVER () AS r, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '\n[^\p{{L}}\p{{N}}]*\n', chr(1), 'g'), '([.!?;:])[ \t\r\n]+', '\1' || chr(1), 'g'), chr(1)) AS p FROM documents),
x AS (SELECT r, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM d),
w AS (SELECT r, i, x.s, id FROM (SELECT *, CASE WHEN length(s) <= {LONGEST} THEN {norm.format('s')} END AS z FROM x) x LEFT JOIN k ON z = k.s),
l AS (SELECT r, i, 0 AS j, id FROM w WHERE id IS NOT NULL UNION ALL
      SELECT r, i, j, id FROM (SELECT r, i, unnest(string_split(s, chr(10))) AS s, generate_subscripts(string_split(s, chr(10)), 1) AS j FROM w WHERE id IS NULL) y LEFT JOIN k ON length(y.s) <= {LONGEST} AND {norm.format('y.s')} = k.s),
h AS (SELECT * FROM (SELECT r, row_number() OVER (PARTITION BY r ORDER BY i, j) - 1 AS i, id FROM l) WHERE id IS NOT NULL),
g AS (SELECT r, count(*) AS n_hits, string_agg(i || ':' || id, ',' ORDER BY i) AS hits, '|' || string_agg(id, '|' ORDER BY i) || '|' AS q FROM h GROUP BY 1),
t AS (SELECT r, 0 AS n, q FROM g UNION ALL
      SELECT r, t.n + 1, replace(replace(replace(q, '|', '||'), rules.ids, '|=' || name || '|'), '||', '|') FROM t JOIN rules ON rules.n = t.n + 1),
o AS (SELECT r, list_filter(string_split(q, '|'), lambda v: v <> '') AS f FROM t WHERE n = (SELECT max(n) FROM rules))
SELECT doc_id, coalesce(n_hits, 0)::BIGINT AS n_hits, coalesce(hits, '') AS hits,
    coalesce(array_to_string(list_transform(list_filter(f, lambda v: v[1] = '='), lambda v: v[2:]), ','), '') AS licenses,
    coalesce(array_to_string(list_filter(f, lambda v: v[1] <> '='), ','), '') AS residue
FROM d LEFT JOIN g USING (r) LEFT JOIN o USING (r)
"""


SQL = _sql()
