from helpers import AWKWARD, documents
from pyspark.sql import functions as F

from entitynet.llm import licences, linededup


def test_lines_are_judged_within_their_site(spark):
    menu = [(i, f"home\n text {i} \n\nfooter {i % 2}", "a") for i in range(10)]
    other = [(20 + i, f"home\nother {i}", "b") for i in range(4)] + [(30 + i, "x" * i + "\nhome", None) for i in range(6)]
    docs = spark.createDataFrame(menu + other, "doc_id int, text string, host string")
    got = {r.doc_id: r for r in linededup.clean(docs, F.col("host"), F.col("text"), ratio=0.5, least=5).collect()}
    assert got[3]._text == " text 3 \n\nfooter 1" and (got[3]._lines, got[3]._dropped) == (3, 1)
    assert got[21]._text == "home\nother 1" and got[31]._text == "x" and got[30]._text == ""


def test_the_ratio_must_be_exceeded_and_copies_count_once(spark):
    rows = [(i, f"line\n{i}" if i < 5 else str(i), "a") for i in range(10)] + [(100 + i, "copied text\nagain", "a") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, host string")
    dropped = lambda ratio: {r.doc_id for r in linededup.clean(docs, F.col("host"), F.col("text"), ratio, 5).collect() if r._dropped}
    assert dropped(5 / 11) == set() and dropped(5 / 11 - 0.001) == set(range(5))


def test_documents_keep_their_columns_and_emptied_ones_go(spark):
    docs = documents(spark, [(i, "same\n" + "" * i + ("only %d" % i if i else "")) for i in range(12)] + [(50 + i, t) for i, t in enumerate(AWKWARD)])
    got = {r.doc_id: r for r in linededup.clean_documents(docs, 0.3, 3).collect()}
    assert linededup.clean_documents(docs).columns == docs.columns and 0 not in got and got[4].text == "only 4" and got[4].n_chars == 6
    assert {50 + i: t for i, t in enumerate(AWKWARD)} == {i: r.text for i, r in got.items() if i >= 50}
    assert linededup.clean_documents(docs.limit(0)).count() == 0


def test_html_lines_and_hosts(spark):
    html = "<html><title>T</title><script>if (a<b) x()</script><STYLE>p{}</STYLE><p>one <b>two</b><br>three<!-- no\n --></p> \n four"
    urls = ["http://A.Example.com:80/x", "https://u:p@b.org?q", "ftp://c#d", "no url", None]
    row = spark.createDataFrame([(html,)], "h string").select(linededup.html_lines(F.col("h")).alias("t")).first()
    assert row.t == "T\none two\nthree\nfour"
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(linededup.host(F.col("u")).alias("h")).collect()
    assert [r.h for r in got] == ["a.example.com", "b.org", "c", "", None]


MIT = [s for s, i in licences.SENTENCES.items() if i.startswith("MIT") and i != "MITname"]


def found(spark, *texts):
    return {r.doc_id: (r.licences, r.unruled) for r in licences.scan(documents(spark, texts)).collect()}


def test_rules_need_their_order_and_the_specific_rule_wins(spark):
    bsd = {i: s for s, i in licences.SENTENCES.items() if i.startswith("BSD")}
    text = lambda ids: ". ".join(bsd[i] for i in ids.split()) + "."
    got = found(spark, text("BSDpre BSDsource BSDbinary BSDendorse BSDasis"), text("BSDpre BSDsource BSDbinary BSDasis"), text("BSDsource BSDpre"),
                "* " + ".\n * ".join(s.replace(" subject", ",\n * subject") for s in MIT) + ".")
    assert got[0] == ("BSD-3-Clause", "") and got[1] == ("BSD-2-Clause", "") and got[2] == ("", "BSDpre,BSDsource") and got[3][0] == "MIT"


def test_single_lines_amid_text_and_awkward_texts(spark):
    got = found(spark, "no stop here\nLicensed under the Apache License, Version 2.0.\nmore", "All rights reserved. Released under the MIT License!",
                "the licensed under the mit license", *AWKWARD)
    assert got[0] == ("Apache-2.0", "") and got[1] == ("MIT", "") and got[2] == ("", "")
    assert all(got[3 + i] == ("", "") for i in range(len(AWKWARD)))
    assert licences.scan(documents(spark, ["x"]).limit(0)).count() == 0


def test_small_hosts_lose_the_lines_that_most_of_their_pages_show(spark):
    rows = [(i, f"page {i}\n" + ("footer" if i < 3 else "none"), "four") for i in range(4)] + [(10 + i, f"p {i}\nmenu", "two") for i in range(2)] + [(20, "alone\nonce", "one")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, host string")
    got = {r.doc_id: r._text for r in linededup.clean(docs, F.col("host"), F.col("text")).collect()}
    assert got == {0: "page 0", 1: "page 1", 2: "page 2", 3: "page 3\nnone", 10: "p 0", 11: "p 1", 20: "alone\nonce"}


def test_documents_lose_the_common_lines_of_a_large_source_and_keep_rare_ones(spark):
    texts = [f"text {i}" + ("\ncommon" if i % 20 == 0 else "") + ("\nrare" if i in (1, 2) else "") for i in range(400)]
    docs = documents(spark, texts).unionByName(documents(spark, [(1000, "shared one\nleft"), (1001, "shared one\nright"), *[(1002 + i, f"o {i}") for i in range(8)]], source="small"))
    got = {r.doc_id: r.text for r in linededup.clean_documents(docs).collect()}
    assert len(got) == 410 and not any("common" in t for t in got.values()) and "rare" in got[1] and got[1000] == "shared one\nleft"


def test_document_columns_of_any_name_are_kept(spark):
    docs = documents(spark, ["same line\nown one", "same line\nown two", "same line\nown three"]).selectExpr(
        "*", "1 AS _host", "2 AS _lines", "3 AS _kept", "4 AS _of", "5 AS _bad", "6 AS _text", "7 AS _dropped", "8 AS in0")
    got = linededup.clean_documents(docs)
    assert got.columns == docs.columns
    assert sorted(tuple(r)[5:] + (r.text, r.n_chars) for r in got.collect()) == sorted((1, 2, 3, 4, 5, 6, 7, 8, t, len(t)) for t in ("own one", "own two", "own three"))


BSD_TERMS = """Copyright (c) 1998, The Regents of the University of California
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer in the
   documentation and/or other materials provided with the distribution.
"""
BSD_ADVERT = """3. All advertising materials mentioning features or use of this software
   must display the following acknowledgement:
   This product includes software developed by the University of
   California, Berkeley and its contributors.
"""
BSD_ENDORSE = """4. Neither the name of the University nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.
"""
BSD_DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS ``AS IS'' AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED.  IN NO EVENT SHALL THE REGENTS OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY
OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF
SUCH DAMAGE.
"""
MIT_TEXT = """MIT License

Copyright (c) 2019 Jane Doe

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
APACHE_HEADER = """/*
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
GNU_HEADER = """    This {what} is free software{colon} you can redistribute it and/or modify
    it under the terms of the GNU {kind}General Public License as published by
    the Free Software Foundation{comma} either version {version} of the License, or
    (at your option) any later version.

    This {what} is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU {kind}General Public License for more details.
"""
ZLIB_TEXT = """Copyright (c) 2001 A. Author

This software is provided 'as-is', without any express or implied
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
ISC_TEXT = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND ISC DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS.
"""
BOOST_HEADER = "// Distributed under the Boost Software License, Version 1.0.\n// (See accompanying file LICENSE_1_0.txt)\n"
MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
EPL_HEADER = """This program and the accompanying materials are made available under the
terms of the Eclipse Public License {} which accompanies this distribution.
"""


def gnu(kind, version, what="program", colon=":", comma=","):
    return GNU_HEADER.format(kind=kind, version=version, what=what, colon=colon, comma=comma)


#: Texts as published, wrapped, and what a reader finds in them: the licences and the known sentences left over.
PUBLISHED = [
    (BSD_TERMS + BSD_ENDORSE + BSD_DISCLAIMER, "BSD-3-Clause", ""),
    (BSD_TERMS + BSD_DISCLAIMER, "BSD-2-Clause", ""),
    (BSD_TERMS + BSD_ADVERT + BSD_ENDORSE + BSD_DISCLAIMER, "BSD-4-Clause", ""),
    (MIT_TEXT, "MIT", ""),
    ("Some code.\n" + MIT_TEXT + "Further code. All rights reserved.\n", "MIT", ""),
    (APACHE_HEADER, "Apache-2.0", ""),
    (APACHE_HEADER.replace(" *", "#"), "Apache-2.0", ""),
    (APACHE_HEADER.replace(" *", ""), "Apache-2.0", ""),
    (gnu("", "3"), "GPL-3.0-or-later", ""),
    (gnu("", "2", colon=";", comma=";"), "GPL-2.0-or-later", ""),
    (gnu("Lesser ", "3"), "LGPL-3.0-or-later", ""),
    (gnu("Lesser ", "2.1", "library", ";", ";"), "LGPL-2.1-or-later", ""),
    (gnu("Affero ", "3"), "AGPL-3.0-or-later", ""),
    (ZLIB_TEXT, "Zlib", ""),
    (ISC_TEXT, "ISC", ""),
    (BOOST_HEADER, "BSL-1.0", ""),
    (MPL_HEADER, "MPL-2.0", ""),
    (EPL_HEADER.format("v1.0"), "EPL-1.0", ""),
    (EPL_HEADER.format("2.0"), "EPL-2.0", ""),
    ("#!/bin/sh\n# SPDX-License-Identifier: MIT\necho", "MIT", ""),
    ("/* SPDX-License-Identifier: (GPL-2.0-or-later OR BSD-2-Clause) */\nint x;", "BSD-2-Clause,GPL-2.0-or-later", ""),
    ("// SPDX-License-Identifier: GPL-2.0+\n", "GPL-2.0-or-later", ""),
    ("// SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note\n", "GPL-2.0-only", ""),
    ("// SPDX-License-Identifier: Apache-2.0 AND LicenseRef-own\n", "Apache-2.0", ""),
    ("(c) Firm Ltd. All rights reserved.", "proprietary", ""),
]


def test_published_licence_texts_are_named(spark):
    got = found(spark, *[t for t, _, _ in PUBLISHED])
    assert [got[i] for i in range(len(PUBLISHED))] == [(licences, left) for _, licences, left in PUBLISHED]


def test_a_rule_does_not_match_across_an_unknown_sentence(spark):
    odd = BSD_ENDORSE.replace("may be used to endorse", "shall ever be used to sell")
    got = found(spark, BSD_TERMS + odd + BSD_DISCLAIMER, BSD_TERMS + "3. Redistributions must be sung.\n" + BSD_DISCLAIMER)
    assert all("BSD" not in got[i][0] and "BSDasis" in got[i][1] and "BSDbinary" in got[i][1] for i in (0, 1))


def test_long_runs_of_stops_and_blanks_take_no_longer(spark):
    got = found(spark, "." * 400_000 + "x" + " " * 400_000 + "y" + "\n" * 400_000 + "Released under the MIT License" + "!" * 400_000)
    assert got[0] == ("MIT", "")


def test_licences_agree_with_their_sql(spark, tmp_path):
    import duckdb

    from entitynet.llm.checks_sql import CHECKS

    docs = documents(spark, [t for t, _, _ in PUBLISHED] + ["plain text", *AWKWARD[:5], *AWKWARD[7:]])
    con = duckdb.connect()
    frame = docs.toPandas()
    con.register("documents", frame)
    assert sorted(con.sql(CHECKS["op4_licence_sentences"]).fetchall()) == sorted(tuple(r) for r in licences.scan(docs).select(
        "doc_id", "licences", "n_sentences", "unruled").collect())
