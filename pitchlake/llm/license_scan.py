"""Licence scan: canonical digests of entire texts, hash-joined to the digests of known licences.

The canonical form lower-cases, drops copyright lines, respells equivalent words, and reduces everything that is neither
letter nor digit to one space; its SHA-256 is looked up. No prefix, no similarity: a text matches in full or not at all.
Besides the whole text, each of its lines is looked up the same way, which finds the one-line notices.

Defined results: null text counts as empty; an empty canonical form never matches; every input row gives one output row,
repeated rows and null ids included; an empty table gives an empty table; other columns pass through untouched and may
bear any name. The table of known digests is a constant of this module, so broadcasting it is bounded by its length.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings that licence texts use for one another.
EQUIVALENT = [
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("organisation", "organization"),
    ("merchantibility", "merchantability"),
    ("noninfringement", "non infringement"),
    ("authorisation", "authorization"),
    ("favour", "favor"),
    ("programme", "program"),
    ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("artefact", "artifact"),
    ("behaviour", "behavior"),
    ("centre", "center"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("judgement", "judgment"),
    ("labelled", "labeled"),
    ("organise", "organize"),
    ("practise", "practice"),
    ("recognise", "recognize"),
    ("sub license", "sublicense"),
    ("sub licence", "sublicense"),
    ("third parties", "third party"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("per cent", "percent"),
    ("e mail", "email"),
]

# Texts of known licences and their standard notices.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
ZERO_BSD = ISC.replace(
    ", provided that the above copyright notice and this permission notice appear in all copies", ""
)
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""

BSL_1 = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and
the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of
the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by
a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT
HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as
a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all
present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
WTFPL = """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it
is allowed as long as the name is changed.

DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

0. You just DO WHAT THE FUCK YOU WANT TO."""
MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
GNU_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as
published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty
of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.

You should have received a copy of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>."""
GNU = [
    ("GPL-2.0-or-later", "General Public License", 2),
    ("GPL-3.0-or-later", "General Public License", 3),
    ("LGPL-2.1-or-later", "Lesser General Public License", 2.1),
    ("LGPL-3.0-or-later", "Lesser General Public License", 3),
    ("AGPL-3.0-or-later", "Affero General Public License", 3),
]

KNOWN_TEXTS = [
    ("MIT", MIT),
    ("MIT", "The MIT License\n\n" + MIT),
    ("MIT", "MIT License\n\n" + MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", ISC),
    ("ISC", "ISC License\n\n" + ISC),
    ("0BSD", ZERO_BSD),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("Zlib", ZLIB),
    ("Apache-2.0", APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("BSL-1.0", BSL_1),
    ("BSL-1.0", BSL_1.split("\n\n", 1)[1]),
    ("Unlicense", UNLICENSE),
    ("Unlicense", UNLICENSE.replace("https", "http")),
    ("WTFPL", WTFPL),
    ("MIT-0", MIT.split("Software is furnished to do so")[0].rstrip() + " Software is furnished to do so." + MIT.split("portions of the\nSoftware.")[1]),
    ("MPL-2.0", MPL_NOTICE),
    ("MPL-2.0", MPL_NOTICE.replace("https", "http")),
    *[(spdx, GNU_NOTICE.format(name=name, version=version)) for spdx, name, version in GNU],
    *[(spdx, GNU_NOTICE.format(name=name, version=version).replace("https", "http")) for spdx, name, version in GNU],
]

#: A line that is a copyright notice and nothing else. The same pattern is valid for Java, RE2 and Python.
COPYRIGHT_LINE = r"(?m)^[ \t]*((copyright|©)[^\n]*([0-9]{4}|\(c\)|©)[^\n]*|\(c\)[^\n]*[0-9]{4}[^\n]*|all rights reserved\.?[ \t]*)$"
NOT_WORD = r"[^\p{L}\p{N}]+"


def _spaced(words: str) -> str:
    return words.replace(" ", "  ")


def canonical(text: Column) -> Column:
    """The canonical form of a text, as a column."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    # Every word between two blanks of its own, so that neighbours can both be respelt.
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, NOT_WORD, "  ")), F.lit(" "))
    for found, kept in EQUIVALENT:
        out = F.replace(out, F.lit(f" {_spaced(found)} "), F.lit(f" {_spaced(kept)} "))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def canonical_py(text: str) -> str:
    """The same on the driver, for the few known texts."""
    out = re.sub(COPYRIGHT_LINE, "", text.lower())
    out = " " + re.sub(r"[\W_]+", "  ", out).strip() + " "  # in these texts, what is neither a letter nor a digit
    for found, kept in EQUIVALENT:
        out = out.replace(f" {_spaced(found)} ", f" {_spaced(kept)} ")
    return out.strip().replace("  ", " ")


def known_digests(known=tuple(KNOWN_TEXTS)) -> list[tuple[str, str]]:
    """(digest, licence id) of each known text, one licence per digest."""
    return sorted({hashlib.sha256(canonical_py(text).encode()).hexdigest(): name for name, text in known}.items())


def scan_licenses(df: DataFrame, text_col: str = "text", known=tuple(KNOWN_TEXTS)) -> DataFrame:
    """``df`` with canonical_sha256, license_id (of the entire text, or null) and notice_ids (of its lines, sorted)."""
    pairs = known_digests(known)
    table = df.sparkSession.createDataFrame(pairs, "known_digest string, known_license string")
    by_digest = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    digest = F.sha2(canonical(df[text_col]), 256)
    notices = F.transform(
        F.split(F.coalesce(df[text_col], F.lit("")), "\n"), lambda line: by_digest[F.sha2(canonical(line), 256)]
    )
    scanned = df.select(
        F.struct(*df.columns).alias("row"),
        digest.alias("digest"),
        F.array_sort(F.array_distinct(F.filter(notices, lambda x: x.isNotNull()))).alias("notice_ids"),
    )
    return scanned.join(F.broadcast(table), F.col("digest") == F.col("known_digest"), "left").select(
        "row.*",
        F.col("digest").alias("canonical_sha256"),
        F.col("known_license").alias("license_id"),
        "notice_ids",
    )
