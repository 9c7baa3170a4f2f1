"""Licence scan by canonical digests.

A text is brought to a canonical form: lower case, copyright lines removed,
punctuation and white space reduced to single spaces, equivalent spellings made
one. The digest of the whole form is looked up in a table of known digests by a
hash join. Units that are looked up are the whole document and, since licences are
mostly stated by notices inside a document, each of its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.llm.common import Scratch

# Short texts by which licences are stated, with SPDX names.
NOTICES = (
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
             "fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES "
             "WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO "
             "EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
             "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
             "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
             "THIS SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions: The above copyright notice and this permission notice shall be "
            "included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", "
            "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
            "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
            "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
            "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
            "IN THE SOFTWARE."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("ISC", "Released under the ISC License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
# Digests of the canonical forms of whole licence files, with the lengths of the forms. Taken
# with this module from the files that operating systems and packages ship; of the short ones also with
# the usual headings, and with or without "All rights reserved."
WHOLE_TEXTS = (
    ("Apache-2.0", 491, "6cfdade2caae842316e3c56b0ec3b3197b848179b1321d7d5c1089c85036da8a"),
    ("Apache-2.0", 8749, "739bd118841493507474f60aa8cd7a63e1e43c3870b8622160bf1c28fb98112e"),
    ("Apache-2.0", 8777, "39d3cebb303ecb7efb48f8b5df3d40093718086b1c914f6f211aedafcc4770e1"),
    ("Apache-2.0", 9820, "acc33e0f83f95729ef3d4518b64844d3fc913f3d3ceac41fd4f03aa68e4a384f"),
    ("Apache-2.0", 9822, "cfb1438f8ef19995ae1e7ee7a922108b4731b8b6ad3b1e7cf4442541e4af19ad"),
    ("Artistic-1.0-Perl", 5832, "ade62ba54e2d661153d09b4e9e151760d8cfc75e7b115c00c26771506e0f91b2"),
    ("BSD-2-Clause", 1197, "a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30"),
    ("BSD-2-Clause", 1208, "a8110b9eede55e89796600001c61e08dce90e7ba2e65c65e03c798bc2a6dd255"),
    ("BSD-2-Clause", 1217, "eda2ad636e738f6a26a2fea902bb734ee48c789a5b40035b8db3659bd951e5bc"),
    ("BSD-2-Clause", 1217, "fa4bafc626e551c9694a56c03366c519473a3e528f64e1d7e226da2f2581d952"),
    ("BSD-2-Clause", 1221, "e26abb5c41cfcbf2b3ad104474bfe0277459fd3cb8960481123215888995377c"),
    ("BSD-2-Clause", 1228, "cce5bdd33e957cc2448e211bc25263adf7ec0f20082c01fd618ca59644d3ae24"),
    ("BSD-2-Clause", 1237, "7b583771b35489f4f506d806dc370f122a90ebecf03206b35f6113e41bd1512d"),
    ("BSD-2-Clause", 1241, "d8654e704fb064f3b8216806e3fb2d87e848b27e6fecaaf2bed768405a361737"),
    ("BSD-3-Clause", 1386, "9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2"),
    ("BSD-3-Clause", 1397, "a5ccc0236dbb077f279df9c933f1ec9837dba2cae3d89e5cae41b6727a26fbab"),
    ("BSD-3-Clause", 1406, "041c487e30a67fa38d63065a50a09e6f68d72c05dca08c50300db462e1686737"),
    ("BSD-3-Clause", 1406, "eabe215ff5a2cf5b1c090915b7cabdf511f70fc79fb8fde85247ebe3038a9658"),
    ("BSD-3-Clause", 1410, "04155820f4fe5ab1a11ecd4a35dff60a1331c52854e6b18762ad5e492c9252d1"),
    ("BSD-3-Clause", 1417, "1d92bc04e14a57ad35c1e6496f5cbfe5b6a78e5f47b3a28b4388e11ad40505b9"),
    ("BSD-3-Clause", 1426, "201d45da1d4895001d800aa38dd9c5a66401e273c71f8fdc11f2f22910c6b1bf"),
    ("BSD-3-Clause", 1430, "095465db8f0dd43c033162b281b7f485cbab808d6c763e810ffc64fa9a29a34b"),
    ("CC0-1.0", 6684, "3f908c74eb4f9678f1a7892cb8666603430b760f353241e8c8fa80640a2a98cd"),
    ("GFDL-1.2-only", 19517, "e5ba011540faced8633b28cd430ae69406a51b0229ef5d2cc6391b9a82ae3574"),
    ("GFDL-1.3-only", 21942, "b7ea7af693a70fbed5d04878c49064d4559f13f19bfd6ba09ee213cf6e8c465e"),
    ("GPL-1.0-only", 11736, "d8a0c8c032c7430e7206a8c1021fa4942b16dab069eaddea1c1e5d66d321bab6"),
    ("GPL-2.0-only", 17063, "0fe6b8d79f73e26253088770c50a4004b8e46b4269a5e0ac41cafbdc2b6a75fc"),
    ("GPL-3.0-only", 33295, "87feb7299a4e3bac64a4e336aabac78c4a6b7744dd8c23a6362034a02e55104f"),
    ("ISC", 676, "280d76b420aeff51730e96577a2466120c91213f03dd50d60107078c498c5b29"),
    ("ISC", 679, "217da0747cec63a2e734185db11cbaa819bcd9e5b83cd12f812128fffe66e26a"),
    ("ISC", 687, "2bea222318a9f1f27497604294a7fd1234b8d34c3b7c21c33f1a42bed31039a4"),
    ("ISC", 690, "4a83f2c4b79966047df04c6d5bef9fe070c9b4234dfb9c183dea3af8520c8940"),
    ("ISC", 691, "47f417b28fab5f74c337acb981cde4ee0fee2135cae96b7e1ae36d5283d649a6"),
    ("ISC", 694, "8dc3dd3203a73f6721d46a171df7f482bb06d35460cfb7b5c8016d6ce141459f"),
    ("LGPL-2.0-only", 24055, "e3c339bdad933c9822c76d78c208bea83c2e23b367ed9e9f75abb5374162902b"),
    ("LGPL-2.1-only", 25135, "b57d39e52177f47030df309f6c9e220111bf970712630f90af7bb11c55f5d306"),
    ("LGPL-3.0-only", 7079, "aeffe4908c9f28414711c86486393581a53a1818e43bf3b88dc5446064aec8f9"),
    ("MIT", 999, "13e8e02c810bcde20149c70779c9ede5a84a899128da488960bfce28697098a7"),
    ("MIT", 1003, "f5683da7b721d0f0cae4db025cf00d50ca179fd28a164a40aa217ebd72b1dcdc"),
    ("MIT", 1007, "d12df00c106a38fceeae32151a5a56f10bb209aefefe70fb50f738c0d28d1277"),
    ("MPL-1.1", 22253, "be8b50c6dfbd105a7a3afd1f05babf56beb96d12286e3d007d8e3665f4940784"),
    ("MPL-2.0", 14189, "69c91cb4d5aa2e0085dd01e98674edb1ae4d90517a98d082f88d1d6e47267d64"),
)
# Spellings that mean the same. Words of a canonical form stand between single blanks of their own.
SPELLINGS = (
    (" licen[cs]e?([sd]?) ", " licens$1 "), (" merchantibility ", " merchantability "),
    (" organisation ", " organization "), (" v([0-9]+) ", " version  $1 "),
)
SPLIT_SPELLINGS = ((" sub  licens", " sublicens"), (" non  infringement ", " noninfringement "))
# A line with a sign or a year; the bare word may begin any line of a licence.
COPYRIGHT = r"(?m)^[^\p{L}\p{N}\n]*(copyright[^\n]*([0-9]{4}|\(c\)|©)|\(c\)|©)[^\n]*$"
PUNCTUATION = r"[^\p{L}\p{N}\n]+"


def _respelt(form: Column, spellings: tuple[tuple[str, str], ...]) -> Column:
    for spelling, one in spellings:
        form = F.regexp_replace(form, spelling, one)
    return form


def _forms(text: Column) -> Column:
    """Canonical lines, still separated by line breaks, each word between two blanks."""
    form = F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT, " "), PUNCTUATION, "  ")
    form = F.concat(F.lit(" "), F.regexp_replace(form, r"\n", " \n "), F.lit(" "))
    return _respelt(form, SPELLINGS + SPLIT_SPELLINGS)


def _one_line(forms: Column) -> Column:
    joined = F.concat(F.lit(" "), F.trim(F.regexp_replace(forms, r"[ \n]+", "  ")), F.lit(" "))
    return F.trim(F.regexp_replace(_respelt(joined, SPLIT_SPELLINGS), " +", " "))


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    return _one_line(_forms(text))


def known_digests(spark: SparkSession, texts: DataFrame | None = None) -> DataFrame:
    """(digest, license, size) of known texts: a table (license, text), or NOTICES and WHOLE_TEXTS."""
    whole = None
    if texts is None:
        texts = spark.createDataFrame(list(NOTICES), "license string, text string")
        whole = spark.createDataFrame(list(WHOLE_TEXTS), "license string, size int, digest string")
    form = texts.where("text is not null").select("license", canonical(F.col("text")).alias("form")).where("form <> ''")
    found = form.select(F.sha2("form", 256).alias("digest"), "license", F.length("form").alias("size"))
    found = found if whole is None else found.unionByName(whole)
    return found.groupBy("digest").agg(F.min("license").alias("license"), F.min("size").alias("size"))


def scan(docs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """One row for each row of ``docs``.

    Columns: doc_id, digest (of the whole canonical form), license (of the whole
    text, or null), notices (sorted names of licences that lines state, joined by
    commas; empty if none), n_notices (lines that state one).

    A null text counts as empty, an empty canonical form is never a licence.
    Repeated rows stay; other columns are ignored. Known texts with one canonical
    form count as the first licence by name. Only lines whose canonical form is as
    long as a known one are looked up. Spark decides by size whether the table of
    digests is broadcast; where it is not, adaptive execution splits a hot digest.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "licenses")
    known = scratch.table(known_digests(spark, texts), "known")
    sizes = [r[0] for r in known.select("size").distinct().collect()]  # at most one for each known text
    text = F.coalesce("text", F.lit(""))
    formed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("body"), _forms(text).alias("forms"))
    line = lambda x, i: F.struct(i.alias("line"), F.regexp_replace(F.trim(x), " +", " ").alias("form"))
    lines = F.filter(F.transform(F.split("forms", "\n"), line), lambda x: F.length(x["form"]).isin(sizes))
    units = scratch.table(formed.select(
        "doc_id", "body", F.sha2(_one_line(F.col("forms")), 256).alias("digest"),
        F.transform(lines, lambda x: F.struct(x["line"], F.sha2(x["form"], 256).alias("digest"))).alias("lines"),
    ), "units")
    stated = units.select("doc_id", "body", F.explode("lines").alias("unit")).select("doc_id", "body", "unit.*")
    stated = stated.join(known, "digest").groupBy("doc_id", "body").agg(
        F.collect_set(F.struct("line", "license")).alias("found")
    ).select(F.col("doc_id").alias("_id"), F.col("body").alias("_body"), "found")
    whole = units.drop("lines").join(known.select("digest", "license"), "digest", "left")
    whole = whole.join(stated, whole.doc_id.eqNullSafe(stated._id) & (whole.body == stated._body), "left")
    names = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["license"])))
    return whole.select(
        "doc_id", "digest", "license", F.coalesce(F.array_join(names, ","), F.lit("")).alias("notices"),
        F.coalesce(F.size("found"), F.lit(0)).cast("bigint").alias("n_notices"),
    )
