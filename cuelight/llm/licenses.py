"""Licence scans by canonical digests.

A text is brought to a canonical form: small letters, no copyright clauses (a line
that names a holder, up to what it says of rights), one spelling of what is spelled in several ways, no punctuation, single spaces. The
md5 of the form is joined with the digests of known licences: of the entire text,
and of each of its lines, as a notice is often a line of its own. Entire licences
and headers of several lines are found by a second form, which doesn't hang on how
lines are broken or on who holds the rights: of the entire text and of each of its
paragraphs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Notices of known licences.
KNOWN = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("all-rights-reserved", "All rights reserved."),
)
#: Identifiers whose SPDX lines are notices.
SPDX = """0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0
CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CECILL-2.1 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.2 GFDL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later
ISC LGPL-2.0 LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA OFL-1.1 OpenSSL PostgreSQL Python-2.0 PSF-2.0 Unlicense UPL-1.0 WTFPL X11 Zlib""".split()
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'
_ASF = "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You under" + _APACHE[14:]
_URL = "http://www.apache.org/licenses/LICENSE-2.0"
_REST = 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
_GNU = "{} is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation"
_GNU_LICENSES = (("gpl", "General Public License", "2 3"), ("lgpl", "Lesser General Public License", "2.1 3"), ("lgpl", "Library General Public License", "2"), ("agpl", "Affero General Public License", "3"))
#: Standard headers: paragraphs of files.
HEADERS = (
    *(("apache-2.0", " ".join([a, *b])) for a in (_APACHE, _ASF) for b in ((), (_URL,), (_URL, _REST))),
    *((f"{short}-{v}{'' if '.' in v else '.0'}-{kind}", _GNU.format(what, name) + how.format(v))
      for short, name, vs in _GNU_LICENSES for v in vs.split() for what in ("This program", "This library", "This file", "This software")
      for kind, how in (("or-later", "; either version {} of the License, or (at your option) any later version."), ("only", "; version {} of the License."), ("only", ", version {}."), ("only", "; version {}."))),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("bsd-style", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("mit-style", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file or at https://opensource.org/licenses/MIT."),
)
#: Digests of entire licences in their second form: with and without titles, appendices and the like.
DIGESTS = (
    ("0bsd", "6a86dc5a4c79842bb78c3fe5f1347614"),
    ("apache-2.0", "2910a91742873a2d6e25c58dd14bacc1"), ("apache-2.0", "29277478c17f0d87d8946ef890cfa15e"), ("apache-2.0", "3b49a878e8e354e17c1efd0e539ab5f1"), ("apache-2.0", "61fe0aa1ae127e5d9772709219d7b2a6"), ("apache-2.0", "95f7d2ebda940c77c528ee29dd40632c"), ("apache-2.0", "bb5a98168da3f8e6243e34dbbb55ff2a"), ("apache-2.0", "c5c23c7bec3c5b22f8808e5c5a956ac5"), ("apache-2.0", "da4e23c12c640d6584c6904d99e02d83"),
    ("artistic-1.0-perl", "e4b29e1086155e04e1eed2db73631532"),
    ("bsd-2-clause", "eb8e86384a0e237f8258fdaf36aa12f7"),
    ("bsd-3-clause", "a872a9646aa4f48f21c3ab1a77083e44"),
    ("bsl-1.0", "97eaf89ccbc6958611c5457d4c89a563"),
    ("cc0-1.0", "bd59f8495ddaf035d4e02b89e3ad6394"),
    ("gfdl-1.2", "8714b91ebc695f80add8c3891a9ad7e1"),
    ("gfdl-1.3", "58d4e7c47d958ff137fd7291edafc69a"),
    ("gpl-1.0", "01f2dd553c34d58f4a83fad0b37b97fe"), ("gpl-1.0", "2e16bd01529c58e731f060b028d023ee"), ("gpl-1.0", "30c9942f164aca3c766953c1b682b616"),
    ("gpl-2.0", "2fa6f2f7ab60be1b120a323f164560c2"), ("gpl-2.0", "31be068530b69f44b473e93c9f2c0af2"), ("gpl-2.0", "d4e0185e195502ba09fae94e9711691c"),
    ("gpl-3.0", "1b643e4b88bae42ac53e7191981a6cdb"), ("gpl-3.0", "4494e80e829c52367adee40f244682cc"), ("gpl-3.0", "890780d58f2e2811bacb170531516bea"),
    ("isc", "93e79631461341770a00c6d7b56d1e20"),
    ("lgpl-2.0", "65d629bf85efa667e5f6540f81273d8f"), ("lgpl-2.0", "7ebadbd5478959dc6573cdde98a51539"), ("lgpl-2.0", "ce0f57716e7bc5995b2516123cc9376d"),
    ("lgpl-2.1", "14a18e973206e59fb3b0112b2693f2a4"), ("lgpl-2.1", "87106f782d94621a004799ced063ea67"), ("lgpl-2.1", "ba52ad761523aea2bd1696a1d0dede9e"),
    ("lgpl-3.0", "8e29a6ddaa1d1815a0e0eb19817fd056"),
    ("mit", "324dfff494d78dbbd2179b3915a9ac6d"),
    ("mpl-1.1", "5ddad7a154c215c78bc5e53fd30f4353"),
    ("mpl-2.0", "3fe8efa410b5d2140aa90b0f63b05c91"),
    ("unlicense", "80ab78bc4ba0a6744a5ad52db6a73ff8"),
    ("zlib", "60041f4c77adc18f900158ee65715a9d"),
)
#: Some word of every licence and header; other texts are not brought to the second form.
MARK = r"(?i)licen[cs]e|permission|redistribut|public\s+domain"
#: The second form's steps, after which punctuation and spaces are as in the first.
BODY = (
    (r"(?m)^[^\p{L}\p{N}\n]*(copyright[ :,]*(\(c\)|©|[0-9]{4}|[<\[{])|©|\(c\)[ ,]*(copyright|[0-9]{4}))[^\n]*$", " "),
    (r"(?:^|\n[^\p{L}\p{N}\n]*\n)[^\p{L}\p{N}\n]*copyright[^\n]*(?=\n[^\p{L}\p{N}\n]*\n|$)", "\n\n"),
    (r"(?m)^[^\p{L}\p{N}\n]*([0-9]{1,2}\.|\(?[0-9a-z]\))(?=[ \t])", " "),
    ("licence", "license"), ("https://", "http://"), (r"[^\p{L}\p{N}.]+", " "), (r"\.( |$)", " "), (" +", " "),
    ("all rights reserved", " "), ("everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", " "),
    (r"neither the names? of .{1,120}? nor the names? of .{1,60}? may", "neither the name of x nor the names of y may"),
    (r"provided by .{1,120}? as is", "provided by x as is"), (r"in no event shall .{1,120}? be liable", "in no event shall x be liable"),
    (" +", " "), (r"^ ?((the )?(mit|isc|(modified |new |simplified |revised )?bsd( [23] clause)?( new or revised| simplified)?|[23] clause bsd|boost software|zlib) license( mit| isc)? )?", ""),
)
#: Pattern and replacement, in order; Java and RE2 read them alike.
STEPS = (
    (r"(?m)^[^\n]*?(?:copyright|©|\(c\))[^\n]*?((?:all rights reserved|(?:licensed|released|distributed) under)[^\n]*)?$", " $1"), ("licence", "license"), ("licensed|released|distributed", "licensed"), ("https://", "http://"), (r"version +([0-9])", "v$1"),
    (r"[^\p{L}\p{N}.]+", " "), (r"\.( |$)", " "), (r"\.0\b", ""), (" +", " "),
)


def canonical(text: Column) -> Column:
    out = F.lower(F.coalesce(text, F.lit("")))
    for pattern, to in STEPS:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def body(text: Column) -> Column:
    """The second form: without copyright lines, item numbers, holders' names and titles."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for pattern, to in BODY:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def body_digest(text: Column) -> Column:
    return F.md5(F.concat(F.lit("text "), body(text)))


def scan(docs: DataFrame, known=KNOWN, headers=HEADERS, digests=DIGESTS) -> DataFrame:
    """doc_id, license, whole (the entire text is it), n_lines (lines, and
    paragraphs, that are) for every document and licence found in it.

    Null and empty texts: nothing found. Rows of one doc_id are one document.
    Empty table: no rows. Other columns are not read. The known digests are a
    fixed few hundred rows, so they are broadcast. A licence in the midst of a
    longer text is found by its notice, header or SPDX line only. Very long texts
    are read whole, in time linear in their length.
    """
    spark = docs.sparkSession
    lines = [*known, *((x.lower(), f"SPDX-License-Identifier: {x}") for x in SPDX)]
    table = spark.createDataFrame(lines, "license string, notice string").select("license", F.md5(canonical(F.col("notice"))).alias("_d"))
    table = table.unionByName(spark.createDataFrame(list(headers), "license string, notice string").select("license", body_digest(F.col("notice")).alias("_d")))
    table = table.unionByName(spark.createDataFrame(list(digests), "license string, _d string")).distinct()
    text = F.coalesce(F.col("text"), F.lit(""))
    unit = lambda t, whole: F.struct(F.md5(canonical(t)).alias("d"), F.lit(whole).alias("whole"))
    units = F.concat(F.array(unit(text, True)), F.transform(F.split(text, "\n"), lambda x: unit(x, False)))
    part = lambda t, whole: F.struct(body_digest(t).alias("d"), F.lit(whole).alias("whole"))
    parts = F.concat(F.array(part(text, True)), F.transform(F.split(text, r"\n(?:[^\p{L}\p{N}\n]*\n)+"), lambda x: part(x, False)))
    units = F.when(text.rlike(MARK), F.concat(units, parts)).otherwise(units)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(units).alias("u")).select("doc_id", "u.*")
    return rows.join(F.broadcast(table), F.col("d") == F.col("_d")).groupBy("doc_id", "license").agg(F.max("whole").alias("whole"), F.count_if(~F.col("whole")).alias("n_lines"))


def oracle(known=KNOWN) -> str:
    def form(x: str) -> str:
        out = f"lower(coalesce({x}, ''))"
        for pattern, to in STEPS:
            out = f"regexp_replace({out}, '{pattern}', '{to.replace('$1', chr(92) + '1')}', 'g')"
        return f"trim({out})"

    rows = ", ".join(f"('{n}', '{t}')" for n, t in known)
    return f"""with k as (select distinct license, md5({form('notice')}) d from (values {rows}) v(license, notice)),
u as (select doc_id, text t, true whole from documents union all select doc_id, unnest(string_split(coalesce(text, ''), chr(10))), false from documents)
select doc_id, license, bool_or(whole) whole, count(*) filter (not whole) n_lines from u join k on md5({form('t')}) = k.d group by doc_id, license"""


def digests_of(texts: DataFrame) -> DataFrame:
    """license, digest of entire licences (license, text), as DIGESTS has them."""
    return texts.select("license", body_digest(F.col("text")).alias("digest")).distinct()


if __name__ == "__main__":  # python -m cuelight.llm.licenses NAME=FILE ...: the entries of DIGESTS for these texts
    import sys
    from pathlib import Path

    from pyspark.sql import SparkSession

    named = [(name, Path(path).read_text()) for name, path in (x.split("=", 1) for x in sys.argv[1:])]
    for row in sorted(digests_of(SparkSession.builder.getOrCreate().createDataFrame(named, "license string, text string")).collect()):
        print(f'("{row.license}", "{row.digest}"),')
