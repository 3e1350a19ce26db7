"""Licence rules on the licences' own texts and notices."""

from __future__ import annotations

import time

from helpers_llm import odd_documents

from pliego.llm import licenses, queries

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
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
MIT_FILE = "MIT License\n\nCopyright (c) 2021 Jane Roe\n\n" + MIT
ISC = """Copyright 2020 J. Roe

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
ZERO_BSD = ISC.replace(" granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", " granted.")
BSD = """/*
 * Copyright (c) 1998 The Foo Project. All rights reserved.
 *
 * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met:
 * 1. Redistributions of source code must retain the above copyright
 *    notice, this list of conditions and the following disclaimer.
 * 2. Redistributions in binary form must reproduce the above copyright
 *    notice, this list of conditions and the following disclaimer in the
 *    documentation and/or other materials provided with the distribution.
{} *
 * THIS SOFTWARE IS PROVIDED BY APPLE INC. AND
 * CONTRIBUTORS "AS IS"
 * AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
 * IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
 * ARE DISCLAIMED.  IN NO EVENT SHALL APPLE INC. OR CONTRIBUTORS BE LIABLE
 * FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
 * DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
 * OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
 * HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
 * LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY
 * OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF
 * SUCH DAMAGE.
 */
"""
ADS = " * 3. All advertising materials mentioning features or use of this software\n *    must display the following acknowledgement:\n *    This product includes software developed by Foo.\n"
NAMES = " * {}. Neither the name of Google Inc. nor the names of its contributors may be\n *    used to endorse or promote products derived from this software without\n *    specific prior written permission.\n"
GNU = """// {} is free software; you can redistribute it and/or modify
// it under the terms of the GNU {} as published by
// the Free Software Foundation; either version {} of the License, or
// (at your option) any later version.
//
// {} is distributed in the hope that it will be useful,
// but WITHOUT ANY WARRANTY; without even the implied warranty of
// MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
// GNU {} for more details.
//
// You should have received a copy of the GNU {}
// along with this program; if not, write to the Free Software
// Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.
"""
GPL_CAPITAL = """    This program is free software: you can redistribute it and/or modify it under the terms of the GNU
    General Public License as published by the Free Software Foundation, either version 3 of the
    License, or (at your option) any later version."""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.

In jurisdictions that recognize copyright laws, the author or authors
of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit
of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this
software under copyright law.
"""
BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:

The copyright notices in the Software and this entire statement, including
the above license grant, this restriction and the following disclaimer,
must be included in all copies of the Software, in whole or in part, and
all derivative works of the Software, unless such copies or derivative
works are solely in the form of machine-executable object code generated by
a source language processor.
"""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""

#: text -> licences, mentioned
CASES = [
    (MIT_FILE, ["MIT"], []),
    (MIT.replace("\n", "\r\n"), ["MIT"], []),
    ("\n".join(f"# {line}" for line in MIT.split("\n")), ["MIT"], []),
    (ISC, ["ISC"], []),
    (ZERO_BSD, ["0BSD"], []),
    (BSD.format(""), ["BSD-2-Clause"], []),
    (BSD.format(NAMES.format(3)), ["BSD-3-Clause"], []),
    (BSD.format(ADS + NAMES.format(4)), ["BSD-4-Clause"], []),
    *((GNU.format("This program", full, v, "This program", full, full), [name], []) for full, v, name in (("General Public License", "2", "GPL-2.0-or-later"), ("Lesser General Public License", "2.1", "LGPL-2.1-or-later"), ("Affero General Public License", "3", "AGPL-3.0-or-later"), ("General Public License", "3", "GPL-3.0-or-later"))),
    (GPL_CAPITAL, ["GPL-3.0-or-later"], []),
    (ZLIB, ["Zlib"], []),
    (UNLICENSE, ["Unlicense"], []),
    (BOOST, ["BSL-1.0"], []),
    (MPL, ["MPL-2.0"], []),
    (APACHE, ["Apache-2.0"], []),
    ("Apache License,\nVersion 2.0", ["Apache-2.0"], []),
    ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/", ["Apache-2.0"], []),
    ("GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.", ["GPL-3.0"], []),
    ("To the extent possible under law, J. Roe has waived all copyright and related or neighboring rights to This Work.", ["CC0-1.0"], []),
    ("This Font Software is licensed under the SIL Open Font License, Version 1.1.", ["OFL-1.1"], []),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", ["CC-BY-NC-SA-4.0"], []),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", ["EPL-2.0"], []),
    ("Licensed under the EUPL, Version 1.2", ["EUPL-1.2"], []),
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"], []),
    ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"], []),
    ("Some words before. Released under the MIT Licence. Some words after.", ["MIT"], []),
    ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"], []),
    ("Distributed under the terms of the GPLv2 or any later version.", ["GPL-2.0-or-later"], []),
    ("SPDX-License-Identifier: GPL-2.0-only", ["GPL-2.0-only"], []),
    ("// SPDX-License-Identifier: MPL-2.0\ncode", ["MPL-2.0"], []),
    ("# SPDX-License-Identifier: BSD-2-Clause", ["BSD-2-Clause"], []),
    ("SPDX-License-Identifier: (MIT OR Apache-2.0) AND Zlib", ["Apache-2.0", "MIT", "Zlib"], []),
    ("SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note", ["GPL-2.0-only"], []),
    ("SPDX-License-Identifier: GPL-2.0+\nx\nSPDX-License-Identifier: LicenseRef-Own.1", ["GPL-2.0-or-later", "LicenseRef-Own.1"], []),
    ("She wondered whether the work was under the MIT license or not.", [], ["MIT"]),
    ("We compared the Apache License 2.0 with the GNU General Public License version 3 in class.", [], ["Apache-2.0", "GPL-3.0"]),
    ("The committee never said that permission is hereby granted, free of charge, to any person.", [], []),
    ("All rights reserved.", [], []),
    ("nothing here", [], []), ("", [], []), (None, [], []),
]


def scanned(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return sorted(licenses.scan(docs).collect(), key=lambda r: r["doc_id"])


def test_texts_and_notices(spark):
    found = scanned(spark, *[t for t, *_ in CASES])
    wrong = [(t, r.asDict()) for (t, granted, named), r in zip(CASES, found, strict=True) if (r["licenses"], r["mentioned"]) != (granted, named)]
    assert wrong == []


def test_nothing_of_a_whole_text_is_left(spark):
    whole = [MIT, ISC, BSD.format(NAMES.format(3)).replace(" All rights reserved.", ""), MPL, APACHE, BOOST, ZLIB]
    assert [r["unmatched"] for r in scanned(spark, *whole)] == [[], [], [], [], [], ["notice:BSL-1.0"], ["zlib-as-is", "zlib-liability", "zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice"]][:5] + [[], []]


def test_order_repeats_and_rest(spark):
    one, two, three = scanned(spark, f"All rights reserved.\n\n{MIT}\n{MIT}", "Under the MIT License. All rights reserved. Licensed under the Apache License, Version 2.0.", MIT.replace("SUBSTANTIAL", "").split("THE SOFTWARE IS")[0])
    assert one["sentence_ids"] == ["rights-reserved", *["mit-grant", "mit-notice", "mit-as-is", "mit-liability"] * 2] and one["unmatched"] == ["rights-reserved"] and one["licenses"] == ["MIT"]
    assert two["sentence_ids"] == ["notice:MIT", "rights-reserved", "notice:Apache-2.0"] and two["licenses"] == ["Apache-2.0", "MIT"]
    assert three["sentence_ids"] == ["mit-grant", "mit-notice"] and three["licenses"] == ["MIT"]


def test_paragraphs_part_sentences(spark):
    found = scanned(spark, "Mozilla Public\n\nLicense, v. 2.0", "# Mozilla Public\n#\n# License, v. 2.0", "the above copyright notice and this permission\n\nnotice shall be included in all copies or substantial portions of the Software")
    assert [(r["sentence_ids"], r["licenses"]) for r in found] == [([], [])] * 3


def test_sentences_are_hinted():
    assert all(any(h in s.lower() for h in licenses.HINTS) for s in licenses.SENTENCES.values())
    assert set(licenses.SAME.values()) <= set(licenses.SENTENCES)
    assert {i for _, sequence in licenses.RULES for i in sequence if not i.startswith("notice:")} <= set(licenses.SENTENCES)


def test_odd_documents(spark):
    docs = odd_documents(spark)
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(docs.limit(0)).columns == ["doc_id", "sentence_ids", "licenses", "mentioned", "unmatched"]


def test_time_is_linear(spark):
    texts = ["license " + part * (300_000 // len(part)) for part in (" ", "\n", ". ", "*", "\n* ", '"', ";\n", "/", "the license ", "permission is hereby granted, ", "a ", "SPDX-License-Identifier: ", "( ")]
    began = time.perf_counter()
    assert len(scanned(spark, *texts)) == len(texts) and time.perf_counter() - began < 90


def test_query_equals_sql(spark, sf):
    from helpers import oracle, same_as_oracle

    con = oracle(sf)
    for name, sql in queries.ORACLE_SQL.items():
        assert same_as_oracle(queries.QUERIES[name](spark, sf), con, sql) > 0


def test_own_texts_equal_sql(spark, tmp_path):
    """The same texts through the SQL version."""
    import duckdb

    texts = [t for t, *_ in CASES if t is None or "SPDX" not in t]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    wanted = {r[0]: r[2:] for r in con.execute(queries.ORACLE_SQL["op7_license_scan"]).fetchall()}
    got = {r["doc_id"]: tuple(r)[2:] for r in queries.op7_license_scan(spark, str(tmp_path)).collect()}
    assert got == wanted


ASF = """/*
 * Licensed to the Apache Software Foundation (ASF) under one or more
 * contributor license agreements.  See the NOTICE file distributed with
 * this work for additional information regarding copyright ownership.
 * The ASF licenses this file to You under the Apache License, Version 2.0
 * (the "License"); you may not use this file except in compliance with
 * the License.  You may obtain a copy of the License at
 *
 *    http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
 */
package org.example;
"""

#: Written by hand, not from the patterns.
GRANTS = {
    ASF: ["Apache-2.0"],
    "Licensed under either of Apache License, Version 2.0 or MIT license at your option.": ["Apache-2.0", "MIT"],
    "This crate is dual-licensed under the MIT license and the Apache License, Version 2.0.": ["Apache-2.0", "MIT"],
    "You may use it; it is released under the GNU GPL version 3 or the MIT License, at your choice.": ["GPL-3.0", "MIT"],
    "This work is licensed under a Creative Commons Attribution 3.0 Unported License.": ["CC-BY-3.0"],
    "Photos are available under the Creative Commons Attribution-NonCommercial-ShareAlike 3.0 license.": ["CC-BY-NC-SA-3.0"],
    "This module is distributed under the Artistic License 2.0.": ["Artistic-2.0"],
    "It is licensed under the Python Software Foundation License Version 2.": ["PSF-2.0"],
    "The tool is released under the GPL.": ["GPL-1.0-or-later"],
    "This library is distributed under the LGPL.": ["LGPL-2.0-or-later"],
    "# Widget\n\nA widget.\n\n## License\n\nMIT\n": ["MIT"],
    "## Licence\n\nMIT License\n\n## Thanks\n\nTo all.": ["MIT"],
    "License: ISC": ["ISC"],
    "The code is published under the [MIT](https://opensource.org/licenses/MIT) license.": ["MIT"],
    "This project is licensed under the [Apache License, Version 2.0](LICENSE).": ["Apache-2.0"],
    "Except where otherwise noted, this site is licensed under a Creative Commons Attribution 4.0 International License.": ["CC-BY-4.0"],
    "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0+ WITH Classpath-exception-2.0": ["Apache-2.0", "GPL-2.0-or-later", "MIT"],
}

NONE = [
    "This software is not licensed under the MIT License.", "This project is no longer released under the Apache License, Version 2.0.", "The library was never released under the GPL.", "It isn't licensed under the MIT License.", "We do not offer this under the terms of the GPL version 3.",
    "Neither file is distributed under the BSD 3-clause license.", "The data cannot be published under the Creative Commons Attribution 4.0 International License.", "No part of this manual is licensed under the MIT License.", "Formerly released under the Mozilla Public License 2.0.", "Previously distributed under the GPL version 2.",
    "Is it licensed under the Apache License 2.0?", "We asked whether the code is licensed under the MIT License.", "If it were licensed under the GPL, you could change it.", "This would be released under the MIT License next year.", "They aren't licensed under the LGPL.", "The fonts weren't released under the SIL Open Font License 1.1.",
    "Nothing here is new.", "The MIT License is short and permissive.", "Many people like the Apache License, Version 2.0 for its patent grant.", "I read about the GPL and the BSD license.", "The GPL has four freedoms.", "MIT is a university.", "She works at MIT in Cambridge.", "MIT", "Apache helicopters are loud.", "Apache is a web server.",
    "Zlib compresses bytes.", "Boost your confidence.", "A driving license is needed.", "His license was revoked.", "The license plate is blue.", "Permission is hereby denied.", "Permission to enter was refused.", "All warranties are void.", "There is no warranty.", "The public domain is large.", "The authors are not liable.", "Copies were sold.", "Redistribution of wealth is debated.",
    "The software is provided.", "We use software.", "Copyright 2020 Jane Roe.", "Unlicensed drivers are fined.", "Creative people share alike.", "Python is a language.", "Artistic freedom matters.", "The eclipse was public.", "Mozilla makes a browser.", "A free license costs nothing.", "Some licenses are dual.", "License agreements bore me.", "Published by a licensed dealer under the counter.",
]


def test_grants_written_by_hand(spark):
    texts = list(GRANTS)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert {texts[i]: r["licenses"] for i, r in found.items()} == GRANTS
    assert found[0]["unmatched"] == []


def test_prose_and_denials_grant_nothing(spark):
    assert len(NONE) >= 50
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(NONE)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert {NONE[i]: r["licenses"] for i, r in found.items() if r["licenses"]} == {}
    assert found[0]["mentioned"] == ["MIT"] and found[1]["mentioned"] == ["Apache-2.0"] and found[6]["mentioned"] == ["CC-BY-4.0"]


def test_hand_written_texts_equal_sql(spark, tmp_path):
    import duckdb

    rows = [(i, t) for i, t in enumerate([*GRANTS, *NONE])]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    wanted = con.execute(queries.ORACLE_SQL["op7_license_scan"])
    names = [c[0] for c in wanted.description]
    expected = sorted(wanted.fetchall())
    assert sorted(map(tuple, queries.op7_license_scan(spark, str(tmp_path)).select(*names).collect())) == expected
