"""Licences named in documents, by known sentences and rules over their order.

A text is split into sentences twice: with line ends as blanks, for wrapped licence
texts, and with line ends as sentence ends, for single lines. Each sentence is normalised
(lower case, only letters, digits, plus signs and inner full stops, single blanks), its variable
part (the name of an owner, the address of a licence) is replaced by a fixed one, and it is
looked up in a table of known sentences. Any other sentence is ``UNKNOWN`` and keeps its place, so a
rule cannot match across it; numbers and bullets of a list, copyright lines and addresses have no place. The
identifiers, in order, are matched against the rules from the most to the least specific; what a
rule matches is used up. An SPDX line names a licence for each part of its expression.

"All rights reserved" is proprietary only where no other rule matched: it also heads many free
licences.

Defined cases: null and empty texts name no licence; texts of any length are read whole; repeated
rows are judged each; an empty table gives an empty one; further columns, whatever their names, are
not read; ``unruled`` lists known sentences that no rule used in either way of splitting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences, normalised, with the identifiers of their meaning.
SENTENCES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MITperm",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MITcond",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MITasis",
    "in no event shall x be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "MITliab",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSDpre",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSDsource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSDbinary",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "BSDadvert",
    "this product includes software developed by x": "BSDproduct",
    "neither the name of x nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSDendorse",
    "this software is provided by x as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "BSDasis",
    "in no event shall x be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services": "BSDliab",
    "loss of use data or profits": "BSDloss",
    "or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "BSDcause",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISCperm",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISCperm",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0BSDperm",
    "the software is provided as is and x disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "ISCasis",
    "licensed under the apache license version 2.0 the license": "ApacheLic",
    "you may not use this file except in compliance with the license": "ApacheComply",
    "you may obtain a copy of the license at": "ApacheCopy",
    "you may obtain a copy of the license at x unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "ApacheCopyAsis",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "ApacheAsis",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheSee",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "GPL2plus",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPL3plus",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version": "LGPL21plus",
    "this x is free software": "FreeSoftware",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "GPLterms",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "LGPLterms",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation": "AGPLterms",
    "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "GPL2only",
    "you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation": "GPL3only",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "GPL2plus",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPL3plus",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version": "LGPL21plus",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "LGPL3plus",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "AGPL3plus",
    "either version 2 of the license or at your option any later version": "Version2plus",
    "either version 2.1 of the license or at your option any later version": "Version21plus",
    "either version 3 of the license or at your option any later version": "Version3plus",
    "version 2 of the license": "Version2",
    "version 3 of the license": "Version3",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GPLhope",
    "this x is distributed in the hope that it will be useful but without any warranty": "GPLhope",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "GPLimplied",
    "see the gnu general public license for more details": "GPLsee",
    "see the gnu lesser general public license for more details": "LGPLsee",
    "see the gnu affero general public license for more details": "AGPLsee",
    "this source code form is subject to the terms of the mozilla public license v 2.0": "MPL2",
    "this source code form is subject to the terms of the mozilla public license v": "MPLv",
    "if a copy of the mpl was not distributed with this file you can obtain one at x": "MPLcopy",
    "the eclipse public license 1.0": "EPL1",
    "the eclipse public license 2.0": "EPL2",
    "this is free and unencumbered software released into the public domain": "Unlicense",
    "this software is provided as is without any express or implied warranty": "ZlibAsis",
    "in no event will the authors be held liable for any damages arising from the use of this software": "ZlibLiab",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "ZlibPerm",
    "the origin of this software must not be misrepresented": "ZlibOrigin",
    "you must not claim that you wrote the original software": "ZlibClaim",
    "if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required": "ZlibProduct",
    "altered source versions must be plainly marked as such and must not be misrepresented as being the original software": "ZlibAltered",
    "this notice may not be removed or altered from any source distribution": "ZlibNotice",
    "distributed under the boost software license version 1.0": "BoostName",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "BoostPerm",
    "licensed under the apache license version 2.0": "ApacheName",
    "released under the mit license": "MITname",
    "licensed under the mit license": "MITname",
    "released under the bsd 3 clause license": "BSD3name",
    "this work is licensed under the gnu general public license version 2": "GPL2name",
    "this work is licensed under the gnu general public license version 3": "GPL3name",
    "licensed under cc by nc 4.0": "CCBYNC4name",
    "licensed under cc by sa 4.0": "CCBYSA4name",
    "licensed under cc by 4.0": "CCBY4name",
    "this work is licensed under a creative commons attribution 4.0 international license": "CCBY4name",
    "this work is licensed under a creative commons attribution sharealike 4.0 international license": "CCBYSA4name",
    "this work is licensed under a creative commons attribution noncommercial 4.0 international license": "CCBYNC4name",
    "this work is dedicated to the public domain under cc0 1.0": "CC0name",
    "all rights reserved": "AllRights",
}
# Variable parts. Of a sentence with this start, what the pattern matches is replaced.
EPL = "this program and the accompanying materials are made available under the terms of the eclipse public license "
MPL_COPY = "if a copy of the mpl was not distributed with this file you can obtain one at "
HOPE = "is distributed in the hope that it will be useful but without any warranty"
VARIABLE = [
    ("neither the name", "^neither the names? of .+ nor the names? of (its |their |any |the |other )*contributors may be used", "neither the name of x nor the names of its contributors may be used"),
    ("this software is provided by ", "^this software is provided by .+ as is and any express(ed)? or implied", "this software is provided by x as is and any express or implied"),
    ("in no event shall ", "^in no event shall .+ be liable for any ", "in no event shall x be liable for any "),
    ("this product includes software developed by ", "^this product includes software developed by .+$", "this product includes software developed by x"),
    ("the software is provided as is and ", "^the software is provided as is and .+ disclaims? all", "the software is provided as is and x disclaims all"),
    ("you may obtain a copy of the license at ", "^you may obtain a copy of the license at .+ unless required", "you may obtain a copy of the license at x unless required"),
    (MPL_COPY, f"^{MPL_COPY}.+$", f"{MPL_COPY}x"),
    ("this program is free", "^this program is free software$", "this x is free software"),
    ("this library is free", "^this library is free software$", "this x is free software"),
    ("this program is distributed", f"^this program {HOPE}$", f"this x {HOPE}"),
    ("this library is distributed", f"^this library {HOPE}$", f"this x {HOPE}"),
    (EPL, f"^{EPL}(v|version )?([12])[.]0.*$", "the eclipse public license $2.0"),
]
# SPDX identifiers; "-or-later" may also be written as a plus sign, "-only" may be left out.
SPDX = [
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0",
    "CC-BY-SA-4.0", "CC0-1.0", "EPL-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only",
    "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib",
]
GNU = [
    ("AGPL-3.0-or-later", "AGPL3plus", "AGPLsee"), ("AGPL-3.0-or-later", "AGPLterms Version3plus", "AGPLsee"),
    ("LGPL-3.0-or-later", "LGPL3plus", "LGPLsee"), ("LGPL-3.0-or-later", "LGPLterms Version3plus", "LGPLsee"),
    ("LGPL-2.1-or-later", "LGPL21plus", "LGPLsee"), ("LGPL-2.1-or-later", "LGPLterms Version21plus", "LGPLsee"),
    ("GPL-3.0-or-later", "GPL3plus", "GPLsee"), ("GPL-3.0-or-later", "GPLterms Version3plus", "GPLsee"),
    ("GPL-2.0-or-later", "GPL2plus", "GPLsee"), ("GPL-2.0-or-later", "GPLterms Version2plus", "GPLsee"),
    ("GPL-3.0-only", "GPL3only", "GPLsee"), ("GPL-3.0-only", "GPLterms Version3", "GPLsee"),
    ("GPL-2.0-only", "GPL2only", "GPLsee"), ("GPL-2.0-only", "GPLterms Version2", "GPLsee"),
]
ZLIB = "ZlibAsis ZlibLiab ZlibPerm ZlibOrigin ZlibClaim ZlibProduct ZlibAltered ZlibNotice"
BSD_END = "BSDasis BSDliab BSDloss BSDcause"
#: The licence of a text that reserves all rights and names no other.
RESERVED = "proprietary"
# The rules in order, each a licence and the identifiers that name it.
RULES = [
    ("MIT", "MITperm MITcond MITasis MITliab"),
    *[(licence, f"{clauses} {end}") for licence, clauses in [
        ("BSD-4-Clause", "BSDpre BSDsource BSDbinary BSDadvert BSDproduct BSDendorse"),
        ("BSD-3-Clause", "BSDpre BSDsource BSDbinary BSDendorse"),
        ("BSD-2-Clause", "BSDpre BSDsource BSDbinary")] for end in (BSD_END, "BSDasis")],
    ("Apache-2.0", "ApacheLic ApacheComply ApacheCopyAsis ApacheSee"),
    ("Apache-2.0", "ApacheLic ApacheComply ApacheCopy ApacheAsis ApacheSee"),
    ("Apache-2.0", "ApacheLic ApacheComply"),
    *[(licence, f"FreeSoftware {core} GPLhope GPLimplied {see}") for licence, core, see in GNU],
    *[(licence, f"{core} GPLhope {see}") for licence, core, see in GNU],
    *[(licence, f"FreeSoftware {core}") for licence, core, _ in GNU],
    *[(licence, core) for licence, core, _ in GNU],
    ("ISC", "ISCperm ISCasis"),
    ("ISC", "ISCperm"),
    ("0BSD", "0BSDperm ISCasis"),
    ("0BSD", "0BSDperm"),
    ("MPL-2.0", "MPLv MPLcopy"),
    ("MPL-2.0", "MPL2 MPLcopy"),
    ("MPL-2.0", "MPLv"),
    ("MPL-2.0", "MPL2"),
    ("EPL-1.0", "EPL1"),
    ("EPL-2.0", "EPL2"),
    ("Zlib", ZLIB),
    ("BSL-1.0", "BoostPerm"),
    ("BSL-1.0", "BoostName"),
    ("Unlicense", "Unlicense"),
    ("Apache-2.0", "ApacheLic"),
    ("Apache-2.0", "ApacheName"),
    ("MIT", "MITname"),
    ("BSD-3-Clause", "BSD3name"),
    ("GPL-2.0", "GPL2name"),
    ("GPL-3.0", "GPL3name"),
    ("CC-BY-NC-4.0", "CCBYNC4name"),
    ("CC-BY-SA-4.0", "CCBYSA4name"),
    ("CC-BY-4.0", "CCBY4name"),
    ("CC0-1.0", "CC0name"),
    *[(licence, f"SPDX:{licence}") for licence in SPDX],
    (RESERVED, "AllRights"),
]
#: Sentence ends: a stop before a blank, or an empty line, also one of a comment; in line mode any line end.
SENTENCE_END, LINE_END = r"[.!?;:][ \t\r\n]|\n[ \t\r*#/]*\n", r"\n|[.!?;:][ \t\r]"
NOISE = "[^a-z0-9.+]+"
#: Sentences without a place: list markers, copyright lines, addresses.
MARKER = "^([0-9.+]*|[a-z]|[ivx]+|copyright .*|https? .*)$"
SPDX_TAG, SPDX_START = "spdx-license-identifier:", "spdx license identifier "
UNKNOWN, USED = " ? ", " / "
#: Letters of a sentence's start that tell whether it can be a known one.
START = 10


def spdx_names() -> dict[str, str]:
    """The identifier of every spelling of an SPDX licence, normalised, "or later" as a plus sign."""
    names = {}
    for licence in SPDX:
        plain = licence.lower().replace("-", " ")
        names[plain.replace(" or later", "+")] = names[plain.removesuffix(" only")] = f"SPDX:{licence}"
    return names


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def marks(text: Column, end: str) -> Column:
    """For each sentence of ``text`` its identifier between blanks, ``UNKNOWN``, or nothing for one without a place."""
    known, names = _map(SENTENCES), _map(spdx_names())
    starts = sorted({s[:START] for s in [*SENTENCES, *(v[0] for v in VARIABLE), SPDX_START]})
    plain = lambda s: F.ltrim(F.btrim(F.regexp_replace(s, NOISE, " "), F.lit(" .")), F.lit("+ "))
    part = lambda p: F.concat(F.lit(" "), F.coalesce(names[F.regexp_replace(p, " with .*$", "")], F.lit("?")), F.lit(" "))

    def fixed(s: Column) -> Column:
        start, pattern, to = VARIABLE[0]
        found = F.when(s.startswith(start), F.regexp_replace(s, pattern, to))
        for start, pattern, to in VARIABLE[1:]:
            found = found.when(s.startswith(start), F.regexp_replace(s, pattern, to))
        return found.otherwise(s)

    def mark(s: Column) -> Column:
        expression = F.split(F.replace(F.substr(s, F.lit(len(SPDX_START) + 1)), F.lit(" or later"), F.lit("+")), " or | and ")
        return F.when(F.substring(s, 1, START).isin(starts), F.when(s.startswith(SPDX_START), F.array_join(F.transform(expression, part), "")).otherwise(
            F.coalesce(F.concat(F.lit(" "), known[fixed(s)], F.lit(" ")), F.lit(UNKNOWN)))).when(
            s.rlike(MARKER), "").otherwise(UNKNOWN)

    sentences = F.split(F.replace(F.lower(text), F.lit(SPDX_TAG), F.lit(SPDX_TAG[:-1])), end)
    return F.transform(F.transform(sentences, plain), mark)


def words(marked: Column) -> Column:
    """The different identifiers of a sequence."""
    return F.array_distinct(F.filter(F.split(marked, " "), lambda w: ~w.isin("", UNKNOWN.strip(), USED.strip())))


def ruled(marked: Column) -> Column:
    """Struct (n, left, used, found): known sentences, the identifiers no rule used and those some rule did, and the licences of the rules that matched."""
    known = F.size(F.filter(marked, lambda m: ~m.isin("", UNKNOWN)))
    rules = F.array(*[F.struct(F.lit(licence).alias("licence"), F.lit("".join(f" {i} " for i in ids.split())).alias("pattern"))
                      for licence, ids in RULES])
    every = F.regexp_replace(F.array_join(marked, ""), r"( \? )+", UNKNOWN)
    start = F.struct(every.alias("left"), F.array().cast("array<string>").alias("found"))
    result = F.when(known > 0, F.aggregate(rules, start, lambda s, r: F.when(F.contains(s.left, r.pattern), F.struct(
        F.replace(s.left, r.pattern, F.lit(USED)).alias("left"), F.array_append(s.found, r.licence).alias("found"))).otherwise(s),
        lambda s: F.struct(words(s.left).alias("left"), F.array_except(words(every), words(s.left)).alias("used"), s.found.alias("found"))))
    none = F.array().cast("array<string>")
    return F.struct(known.alias("n"), *[F.coalesce(result[c], none).alias(c) for c in ("left", "used", "found")])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, licences, n_sentences (known ones) and unruled of every document, licences and leftovers sorted and joined by commas."""
    by = docs.select("doc_id", marks(F.col("text"), SENTENCE_END).alias("a"), marks(F.col("text"), LINE_END).alias("b"))
    by = by.select("doc_id", ruled(F.col("a")).alias("a"), ruled(F.col("b")).alias("b"))
    found = F.array_distinct(F.concat("a.found", "b.found"))
    left = F.array_except(F.array_union("a.left", "b.left"), F.array_union("a.used", "b.used"))
    listed = lambda x: F.array_join(F.array_sort(x), ",")
    return by.select("doc_id", listed(F.filter(found, lambda x: (x != RESERVED) | (F.size(found) == 1))).alias("licences"),
                     F.coalesce(F.greatest("a.n", "b.n"), F.lit(0)).cast("long").alias("n_sentences"), listed(left).alias("unruled"))
