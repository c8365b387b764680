"""Licence scan by canonical digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_rows, write_table

# Spellings that count as the same, as (pattern, canonical) over lower-case text. Each is applied
# to the whole text in this order.
EQUIVALENTS = [
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authorise", "authorize"),
    ("behaviour", "behavior"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("copyright owner", "copyright holder"),
    ("favour", "favor"),
    ("fulfil ", "fulfill "),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("non-commercial", "noncommercial"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("per cent", "percent"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("sub-license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("https://", "http://"),
    ("&", " and "),
]
#: A line that only states a copyright: dropped before a text is compared.
COPYRIGHT_LINE = r"(^|\n)[ \t]*(copyright|\(c\)|©|all rights reserved)[^\n]*"
PUNCTUATION = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_PERMISSION = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
    "to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
    "of the Software.\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted"
)
_ISC_REST = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING '
    "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
    "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
    "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION "
    "WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)

_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution.\n"
)
_ENDORSEMENT = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission.\n"
)
_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
    "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
    "liable for any damages arising from the use of this software.\n"
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
    "alter it and redistribute it freely, subject to the following restrictions:\n"
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
    "software. If you use this software in a product, an acknowledgment in the product documentation would be "
    "appreciated but is not required.\n"
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
    "software.\n"
    "3. This notice may not be removed or altered from any source distribution."
)

# Licences whose SPDX line is known.
SPDX = [
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0",
    "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later",
    "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Zlib",
]

# Known licence texts and the notices by which they are declared. A caller can pass a table of
# their own, of any size.
KNOWN = [
    ("MIT", "MIT License\n" + _PERMISSION),
    ("MIT", "The MIT License (MIT)\n" + _PERMISSION),
    ("MIT", _PERMISSION),
    ("ISC", "ISC License\n" + _ISC_GRANT + ", provided that the above copyright notice and this permission notice "
     "appear in all copies.\n" + _ISC_REST),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all "
     "copies.\n" + _ISC_REST),
    ("0BSD", _ISC_GRANT + ".\n" + _ISC_REST),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-2-Clause", _CONDITIONS + _AS_IS),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _CONDITIONS + _AS_IS),
    ("BSD-3-Clause", _CONDITIONS + _ENDORSEMENT + _AS_IS),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _CONDITIONS + _ENDORSEMENT + _AS_IS),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n" + _ZLIB),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International "
     "License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "Released under CC0 1.0."),
    *((name.removesuffix("-only").removesuffix("-or-later"), f"SPDX-License-Identifier: {name}") for name in SPDX),
]
# Digests of the canonical texts of longer licences, as their stewards publish them: whole, and without
# what follows the terms (how to apply them).
KNOWN_DIGESTS = [
    ("Apache-2.0", "ebc600199db9838b4fc2d5288a12598c2702142177a89b3443f5cc87b137d94b"),
    ("Apache-2.0", "98378616989e23431b15181388a001fdeac0999db741918e302c5162392bcfbd"),
    ("Apache-2.0", "23c0498e738b86da84fa1ffb1ff43f4ef103f365367077ada18cd1db1813d6da"),
    ("Apache-2.0", "6092c7c8afe217acb35bf73416fffc63308d11173b3ef1d695cb1c4dc9d1ded8"),
    ("Apache-2.0", "137663f93a0eefa39616703c871039d27448aa9da51ae2df76c0102640064a87"),
    ("Apache-2.0", "fc13f66a190c50c72fbc1fde44154c736d2feb9a957228239fe368ebb2b2e431"),
    ("GPL-1.0", "98db0b473e0a45a62b04a39b6b864b4e079a58d513e2196f94fe7252fa8574a6"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-1.0", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),
    ("GPL-2.0", "ceb13cdc7143ca5f58fb64136b9b542b00470d4db4dbcee1328c6250bf845b08"),
    ("GPL-2.0", "e4d14510e41435c3eb12c255b72546a3cb9943f06f209c72bc30a19095b08999"),
    ("GPL-2.0", "a1e7ba14d8d85807f384435b77f91e925decc43da128311c991c4f2337e44017"),
    ("GPL-3.0", "e25d282dcbebde028b149807716ab40a33db5f0c8ac5270f7a09a926f7b8b527"),
    ("GPL-3.0", "3dcf77ad8c25248618918aaff1de8a2cb80cea6ca922ef4a7a389cca96a7560b"),
    ("GPL-3.0", "3d4de016a08e1d98b27dec755cdf4530b92807d97aaa185b32e12d52942b1943"),
    ("LGPL-2.0", "cc8e7fa9f9cf8315fef32bddbc9aa00edea19a8d4cc8a8b79af8595808ca4b16"),
    ("LGPL-2.0", "ff773d8d898dfc51ae2dbf3baa20700673e8ceb153b13d26c525af34a59adf0c"),
    ("LGPL-2.0", "e0de5033b5ad2a24c0a1a8b04f09e33038ffa62d2bef7178de2a3c6f5d56f499"),
    ("LGPL-2.1", "38b2435f8cf1a11a2bdcba9a05f347cf9063612b86eec3d468355f817be85a84"),
    ("LGPL-2.1", "963f79d48038eed98d8341c84d8d3b765e99508a738d00654c0112f70a7c370c"),
    ("LGPL-2.1", "9bf9c99aeafbdbccd7456a00d574699e3deb41868375496cacbf170be719bebd"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6"),
    ("MPL-2.0", "9e79a7d513376f6fa1500e4df4f6276c6e7e61c5c3e28dcdb1acee24033acc56"),
    ("MPL-2.0", "2cec6f733aa157c2d0b72e9669f75ca354f332218fcb5a3a885931f385272a04"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
]


def respelled(text: Column) -> Column:
    """Lower case, spellings made equal. No spelling holds a line feed, so lines may be taken apart after it."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for old, new in EQUIVALENTS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def bare(text: Column) -> Column:
    """A respelled text without copyright lines, its punctuation and white space as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, COPYRIGHT_LINE, "\n"), PUNCTUATION, " "))


def canonical(text: Column) -> Column:
    """Lower case, without copyright lines, spellings made equal, punctuation and white space as one space."""
    return bare(respelled(text))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """licence, digest: one row per name and canonical text."""
    rows = spark.createDataFrame(known or KNOWN, "licence string, licence_text string")
    rows = rows.select("licence", F.sha2(canonical(F.col("licence_text")), 256).alias("digest"))
    if not known:
        rows = rows.unionByName(spark.createDataFrame(KNOWN_DIGESTS, "licence string, digest string"))
    return rows.distinct()


def scan_licences(
    docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, whole_text_licence, n_notices, licences, canonical_sha256.

    A text is a known licence when its canonical form has a known digest. That is asked of the whole document
    (whole_text_licence) and of each of its lines (n_notices of them are licence texts of one line); licences
    has all that were found, sorted and comma-joined, empty if none. A digest known by several names has all of them,
    comma-joined. known (licence, digest) is joined by hash: broadcast if its counted size is within bounds, and
    shuffled otherwise.

    Nulls: a null text is empty; an empty text, or one of punctuation alone, is no licence. A null doc_id is
    returned as such. Repeated rows give repeated rows. Very long texts are read whole. An empty table gives an
    empty result. Other columns are neither read nor returned.
    """
    known = known if known is not None else known_digests(docs.sparkSession)
    known = known.filter((F.col("digest") != F.sha2(F.lit(""), 256)) & F.col("licence").isNotNull())
    names = F.array_sort(F.collect_set("licence")).alias("_names")
    known = write_table(known.groupBy(F.unhex("digest").alias("_digest")).agg(names), "known-licences")
    row = F.monotonically_increasing_id()
    units = docs.select(F.col(id_col).alias("doc_id"), row.alias("_row"), respelled(F.col(text_col)).alias("_text"))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.length(x) > 0)
    units = units.select(
        "doc_id",
        "_row",
        F.unhex(F.sha2(bare(F.col("_text")), 256)).alias("_digest"),
        F.transform(lines, lambda x: F.unhex(F.sha2(bare(x), 256))).alias("_lines"),
    )
    units = write_table(units, "licence-units")
    found = (
        join_rows(units.select("_row", F.explode("_lines").alias("_digest")), known, "_digest", F.size("_names") * 32)
        .groupBy("_row")
        .agg(F.count(F.lit(1)).alias("_n"), F.array_distinct(F.flatten(F.collect_set("_names"))).alias("_set"))
    )
    found = write_table(found, "licence-notices")  # at most one of each licence
    whole = known.withColumnRenamed("_names", "_whole")
    none = F.array().cast("array<string>")
    placed = join_rows(units.drop("_lines"), whole, "_digest", F.size("_whole") * 32, "left")
    return join_rows(placed, found, "_row", F.size("_set") * 32, "left").select(
        "doc_id",
        F.array_join("_whole", ",").alias("whole_text_licence"),
        F.coalesce("_n", F.lit(0)).cast("long").alias("n_notices"),
        F.array_join(
            F.array_sort(F.array_union(F.coalesce("_set", none), F.coalesce("_whole", none))), ","
        ).alias("licences"),
        F.lower(F.hex("_digest")).alias("canonical_sha256"),
    )
