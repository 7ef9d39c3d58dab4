from cuelight.llm import licenses


def test_license_scan(spark):
    mit = "MIT Licence text\nCopyright 2020 A\nPermission  is granted, to all."
    data = [
        (1, "  mit LICENSE: text;\n(c) someone\npermission is granted to all", "x"), (2, "prose\nLicensed under the Apache Licence, version 2.0!\nmore", "x"),
        (3, None, None), (4, "", ""), (5, "All Rights Reserved", ""), (5, "All Rights Reserved", ""), (None, "a\nall rights reserved.\nALL RIGHTS RESERVED", ""), (6, "word " * 50_000, ""),
    ]
    docs = spark.createDataFrame(data, "doc_id long, text string, license string")
    got = {(r.doc_id, r.license): (r.whole, r.n_lines) for r in licenses.scan(docs, (*licenses.KNOWN, ("mit-text", mit))).collect()}
    assert got == {(1, "mit-text"): (True, 0), (2, "apache-2.0"): (False, 1), (5, "all-rights-reserved"): (True, 2), (None, "all-rights-reserved"): (False, 2)}
    assert licenses.scan(docs.where("false")).count() == 0


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     https://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS.
"""
GPL = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
"""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""


def test_entire_licences_headers_and_spdx_lines(spark):
    import textwrap

    wrapped = "\n\n".join(textwrap.fill(p, 61) for p in MIT.split("\n\n"))
    data = [
        (1, "The MIT License (MIT)\n\nCopyright (c) 2019 Jane Doe\n\n" + wrapped), (2, "Copyright Acme\n\n" + MIT), (3, MIT.replace("sublicense, ", "")),
        (4, APACHE + "\nimport os\n"), (5, "/*\n * Copyright (C) 2011 A\n *\n" + GPL + " */\nint x;"), (6, "// SPDX-License-Identifier: GPL-2.0-only\nint y;\n"),
        (7, "Copyright 2001, X.\nAll rights reserved.\n\n" + BSD.format("the University of Y")), (8, GPL + "\n" + GPL), (9, "License to permit nothing."),
    ]
    got = {(r.doc_id, r.license): (r.whole, r.n_lines) for r in licenses.scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got.pop((7, "all-rights-reserved"), None)
    assert got == {
        (1, "mit"): (True, 0), (2, "mit"): (True, 0), (4, "apache-2.0"): (False, 1), (5, "gpl-3.0-or-later"): (False, 1),
        (6, "gpl-2.0-only"): (False, 1), (7, "bsd-3-clause"): (True, 0), (8, "gpl-3.0-or-later"): (False, 2),
    }


def test_long_licences(spark):
    import os

    import pytest

    top = "/usr/share/common-licenses"
    names = {"Apache-2.0": "apache-2.0", "GPL-2": "gpl-2.0", "GPL-3": "gpl-3.0", "LGPL-2.1": "lgpl-2.1", "LGPL-3": "lgpl-3.0", "MPL-2.0": "mpl-2.0", "CC0-1.0": "cc0-1.0"}
    found = [n for n in names if os.path.exists(f"{top}/{n}")]
    if not found:
        pytest.skip("no licence texts here")
    docs = spark.createDataFrame([(i, open(f"{top}/{n}").read()) for i, n in enumerate(found)], "doc_id long, text string")
    got = {r.doc_id: r.license for r in licenses.scan(docs).collect() if r.whole}
    assert got == {i: names[n] for i, n in enumerate(found)}


def test_every_header_bears_a_mark(spark):
    table = spark.createDataFrame(list(licenses.HEADERS), "license string, notice string")
    assert table.where(~table.notice.rlike(licenses.MARK)).count() == 0


def test_rights_beside_a_holder(spark):
    """A copyright clause goes, what the same line says of rights stays; in SQL as in Spark."""
    import duckdb

    data = [(1, "x\nCopyright 2024 Acme Inc. All rights reserved.\ny"), (2, "© 2020 Jane Doe, released under the MIT licence"), (3, "(c) Acme\nCopyright (c) Acme\n"), (4, "// Copyright The Authors. Licensed under CC BY 4.0."), (5, "copyright all rights reserved copyright"), (6, "We reserve all rights reserved seats.")]
    got = sorted(map(tuple, licenses.scan(spark.createDataFrame(data, "doc_id long, text string")).collect()))
    assert got == [(1, "all-rights-reserved", False, 1), (2, "mit", True, 1), (4, "cc-by-4.0", True, 1)]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", data)
    assert sorted(con.execute(licenses.oracle()).fetchall()) == got


def brute_scan(data):
    """The whole operator in plain Python: both forms of whole texts, lines and paragraphs."""
    import hashlib
    from collections import defaultdict

    import regex

    def form(text, steps):
        out = (text or "").lower()
        for pattern, to in steps:
            out = regex.sub(pattern, lambda m, to=to: to.replace("$1", (m[1] or "") if m.re.groups else "") if "$1" in to else to, out)
        return out.strip(" ")

    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    one, two = lambda t: md5(form(t, licenses.STEPS)), lambda t: md5("text " + form(t, licenses.BODY))
    known = defaultdict(set)
    for name, notice in [*licenses.KNOWN, *((x.lower(), f"SPDX-License-Identifier: {x}") for x in licenses.SPDX)]:
        known[one(notice)].add(name)
    for name, notice in licenses.HEADERS:
        known[two(notice)].add(name)
    for name, digest in licenses.DIGESTS:
        known[digest].add(name)
    out = defaultdict(lambda: [False, 0])
    for doc, text in data:
        t = text or ""
        units = [(one(t), True), *((one(x), False) for x in t.split("\n"))]
        if regex.search(licenses.MARK, t):
            units += [(two(t), True), *((two(x), False) for x in regex.split(r"\n(?:[^\p{L}\p{N}\n]*\n)+", t))]
        for digest, whole in units:
            for name in known.get(digest, ()):
                out[doc, name][0] |= whole
                out[doc, name][1] += not whole
    return {k: tuple(v) for k, v in out.items()}


def test_scan_equals_a_plain_version(spark):
    """Entire licences, headers, SPDX lines and notices, planted between other lines."""
    import random

    rng = random.Random(6)
    parts = [APACHE, GPL, MIT, BSD.format("Acme"), "SPDX-License-Identifier: MPL-2.0", "# SPDX-License-Identifier: MIT", "All rights reserved.", "Copyright 2020 A. All rights reserved.", "Licensed under CC BY-SA 4.0.", "prose of no licence at all", "permission to speak", "\n", "  \n * \n"]
    data = [(i, "\n".join(rng.choice(parts) for _ in range(rng.randrange(1, 7)))) for i in range(60)] + [(100, None), (101, ""), (102, "The MIT License\n\nCopyright (c) 2001 B\n\n" + MIT), (103, "Copyright X\n\n" + BSD.format("the University of Y") + "\n\n")]
    got = {(r.doc_id, r.license): (r.whole, r.n_lines) for r in licenses.scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == brute_scan(data) and (102, "mit") in got and got[103, "bsd-3-clause"][0]
    assert {r.digest for r in licenses.digests_of(spark.createDataFrame([("mit", MIT)], "license string, text string")).collect()} <= {d for n, d in licenses.DIGESTS if n == "mit"}
