"""Licence scans by canonical digest lookup, on DataFrame functions.

A text's canonical form has no copyright lines, no case, no punctuation, single spaces, and one spelling of words that
licences spell in several ways. Its SHA-256 digest is looked up, by a hash join, in a table of the digests of known licence
texts and notices. Whole texts are looked up, and each of their paragraphs and lines, as notices often stand alone in one.
The known table is a fixed list in this module, so its broadcast has a proven bound. It covers the whole texts of 0BSD, Apache
2.0, Artistic, Boost, BSD (2 and 3 clauses), CC0, GFDL, GPL, ISC, LGPL, MIT, MIT-0, MPL, Unlicense and zlib, the usual
notices of these and of Creative Commons, and SPDX lines; other licences have no digest here and give null.

Defined results: null and empty texts have no licence; a text or line whose canonical form is empty is never looked up;
repeated rows are answered each; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings (fixed values): each pattern is replaced, in this order, on lower-cased words.
SPELLINGS = (("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("copyright owner", "copyright holder"), ("whilst", "while"), ("merchantibility", "merchantability"), ("judgement", "judgment"), ("per cent", "percent"), ("https", "http"), ("acknowledgement", "acknowledgment"), ("organisation", "organization"), ("recognise", "recognize"))
#: What parts paragraphs.
PARAGRAPH = r"\n[ \t]*\n"

#: Parts of the texts below (fixed values).
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'
_MIT_NOTICE = ', subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
_MIT_DISCLAIMER = ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_DISCLAIMER = ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_DISCLAIMER = ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_GNU_LATER = "This program is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation{comma} either version {version} of the License, or (at your option) any later version."

#: Headings under which a text's whole form is known too (fixed values).
HEADINGS = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", "BSD License"),
    "Zlib": ("zlib License", "The zlib License", "The zlib/libpng License"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "MIT-0": ("MIT No Attribution",),
    "Unlicense": ("The Unlicense",),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003",),
}

#: Whole licence texts (fixed values): identifier, text.
TEXTS = (
    ("MIT", _MIT + _MIT_NOTICE + _MIT_DISCLAIMER),
    ("MIT-0", _MIT + "." + _MIT_DISCLAIMER),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies." + _ISC_DISCLAIMER),
    ("0BSD", _ISC_GRANT + "." + _ISC_DISCLAIMER),
    ("BSD-2-Clause", _BSD + _BSD_DISCLAIMER),
    ("BSD-3-Clause", _BSD + _BSD_THIRD + _BSD_DISCLAIMER),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>'),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
)

#: Notices (fixed values): identifier, text.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", _GNU_LATER.format(colon=":", comma=",", kind="", version="3")),
    ("GPL-2.0", _GNU_LATER.format(colon=";", comma=";", kind="", version="2")),
    ("LGPL-3.0", _GNU_LATER.format(colon=":", comma=",", kind="Lesser ", version="3")),
    ("LGPL-2.1", _GNU_LATER.format(colon=";", comma=";", kind="Lesser ", version="2.1").replace("program", "library")),
    ("AGPL-3.0", _GNU_LATER.format(colon=":", comma=",", kind="Affero ", version="3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

#: Digests of the canonical forms of longer licences as published (fixed values): identifier, SHA-256. Where a licence ends
#: with advice on its use, the form without that is known too.
DIGESTS = (
    ("Apache-2.0", "036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b"),
    ("Apache-2.0", "f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe"),
    ("Apache-2.0", "6aa661403864282a4d084f1551e8149a5f1a7b5e8b05b6db8e1a8a28d0badc64"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-1.0", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("GPL-3.0", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.0", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
    ("MPL-2.0", "075fcdf87448c49dbad8c5f7963f0eb6907a3d8eae1b431ba2988508499ec0de"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
)

#: A line that holds nothing but a copyright statement, perhaps behind comment marks; and one that reserves all rights.
COPYRIGHT = r"^[ \t#*/;%-]*(?:(?:copyright[ \t]*(?:\(c\)|©|[0-9<\[{])|\(c\)[ \t]*[0-9]|©)[^\n]*|all[ \t]+rights[ \t]+reserved[. \t]*)(?:\n|$)"


def canonical(text: Column) -> Column:
    """Without copyright lines, case and punctuation; each word stands between spaces of its own, so that neighbours are all respelled."""
    words = F.regexp_replace(F.lower(text), f"(?md){COPYRIGHT}", "")
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(words, r"[^\p{L}\p{N}]+", "  ")), F.lit(" "))
    for old, new in SPELLINGS:
        words = F.replace(words, F.lit(f" {old} ".replace(" ", "  ")[1:-1]), F.lit(f" {new} ".replace(" ", "  ")[1:-1]))
    return F.replace(F.trim(words), F.lit("  "), F.lit(" "))


def known_texts() -> list[tuple[str, str]]:
    """(identifier, text) of all texts and notices given in full: each text also under its headings, and an SPDX line for each identifier."""
    out = [*TEXTS, *NOTICES]
    out += [(name, f"{heading}\n{text}") for name, text in TEXTS for heading in HEADINGS.get(name, ())]
    names = sorted({name for name, _ in (*TEXTS, *NOTICES, *DIGESTS)})
    return out + [(name, f"SPDX-License-Identifier: {name}{end}") for name in names for end in ("", "-only", "-or-later")]


def known(spark: SparkSession) -> DataFrame:
    """(digest, license)"""
    rows = spark.createDataFrame([(b, a) for a, b in known_texts()], "t string, license string")
    rows = rows.select(F.sha2(canonical(F.col("t")), 256).alias("digest"), "license").unionAll(spark.createDataFrame([(b, a) for a, b in DIGESTS], "digest string, license string"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' columns but the text under ``doc``, license (of the whole text, or null), lines (of licence notices), licenses (sorted; of the whole, its paragraphs and its lines)."""
    names = [c for c in docs.columns if c != text]
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.monotonically_increasing_id().alias("uid"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    unit = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("u"))
    lines = F.transform(F.split("t", "\n"), lambda x: unit("line", x))
    paragraphs = F.transform(F.filter(F.split("t", PARAGRAPH), lambda x: F.contains(x, F.lit("\n"))), lambda x: unit("paragraph", x))
    each = base.select("doc", "uid", F.explode(F.concat(F.array(unit("whole", F.col("t"))), paragraphs, lines)).alias("x")).select("doc", "uid", "x.kind", canonical(F.col("x.u")).alias("c"))
    each = each.select("doc", "uid", "kind", F.when(F.col("c") != "", F.sha2("c", 256)).alias("digest"))
    hit = each.join(F.broadcast(known(docs.sparkSession)), "digest", "left")
    out = hit.groupBy("uid").agg(
        F.first("doc").alias("doc"),
        F.max(F.when(F.col("kind") == "whole", F.col("license"))).alias("license"),
        F.count(F.when((F.col("kind") == "line") & F.col("license").isNotNull(), 1)).alias("lines"),
        F.array_sort(F.collect_set("license")).alias("licenses"),
    )
    return out.drop("uid")


def oracle() -> str:
    """The same as op8's query, in DuckDB."""

    def canon(x: str) -> str:
        x = f"regexp_replace(lower({x}), '(?m){COPYRIGHT}', '', 'g')"
        x = f"(' ' || trim(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]+', '  ', 'g')) || ' ')"
        for old, new in SPELLINGS:
            old, new = (f" {y} ".replace(" ", "  ")[1:-1] for y in (old, new))
            x = f"replace({x}, '{old}', '{new}')"
        return f"replace(trim({x}), '  ', ' ')"

    quoted = lambda v: "'" + v.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in known_texts())
    digests = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in DIGESTS)
    return f"""
WITH known AS (SELECT digest, min(license) AS license FROM (SELECT sha256({canon('t')}) AS digest, license FROM (VALUES {rows}) AS k(license, t) UNION ALL SELECT digest, license FROM (VALUES {digests}) AS g(license, digest)) GROUP BY digest),
base AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS t FROM documents),
units AS (SELECT uid, 'whole' AS kind, t AS u FROM base UNION ALL SELECT uid, 'line', unnest(string_split(t, chr(10))) FROM base
UNION ALL SELECT uid, 'paragraph', u FROM (SELECT uid, unnest(string_split_regex(t, '{PARAGRAPH}')) AS u FROM base) WHERE contains(u, chr(10))),
each_ AS (SELECT uid, kind, CASE WHEN c <> '' THEN sha256(c) END AS digest FROM (SELECT uid, kind, {canon('u')} AS c FROM units)),
found AS (SELECT uid, kind, license FROM each_ JOIN known USING (digest)),
agg AS (SELECT uid, max(license) FILTER (kind = 'whole') AS license, count(*) FILTER (kind = 'line') AS n_lines, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM found GROUP BY uid)
SELECT doc_id, license, coalesce(n_lines, 0) AS n_lines, coalesce(licenses, '') AS licenses FROM base LEFT JOIN agg USING (uid)"""
