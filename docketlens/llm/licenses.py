"""License scan in DataFrame operations: TF-IDF cosine to templates, then inheritance by path.

A file states a license in four ways: by a sentence with a cue word, wherever it
stands, once as the lines have it and once with comment marks stripped and the
lines of a paragraph joined, so that wrapped headers are whole; by its header, the
comment lines that it begins with, as one statement; by its whole text, if it is
named as a license file; and by an SPDX tag, of which the first identifier counts.
Terms are weighted by count and by their rarity among all statements of the
corpus; a statement names the license whose template has the greatest cosine, if
that reaches ``SIMILARITY``.  Tags count before headers and whole texts, these
before sentences, and then the greatest cosine decides.  Files without a license
inherit from the license file in the nearest directory above them that has one
with a license.

Statements are told apart by a hash of their text and then numbered, so a term
carries along neither text nor hash; terms are counted by combining aggregates.  The template table is a constant
of the code; longer license texts may be given as ``templates``.  A file meets its few ancestors in an
equi-join on the directory, dealt over ``SALTS`` copies of the directory row so
that a directory with a third of all files stays divisible.

Defined cases: null text has no statement; a null path has no directory and
inherits nothing; repeated rows are labelled each; of equal cosines the first
license by name counts; several license files in a directory give the best
cosine's license; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

SIMILARITY = 0.6
SALTS = 16

#: Notices, headers, titles and short texts of public licenses: fixed values.
_GNU = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published "
        "by the Free Software Foundation, either version {} of the License, or (at your option) any later version.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. {}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE "
        "ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
        "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
        "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
        "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_ENDORSE = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
            "products derived from this software without specific prior written permission. ")
_MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
        "this permission notice shall be included in all copies or substantial portions of the Software. ")
_AS_IS = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
          "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
          "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
          "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
TEMPLATES = [
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("Apache-2.0", "licensed under the Apache License, Version 2.0"),
    ("BSD-2-Clause", "licensed under the BSD 2-Clause License"),
    ("BSD-3-Clause", "licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY-4.0", "licensed under CC BY 4.0"),
    ("CC-BY-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "dedicated to the public domain under CC0 1.0"),
    ("GPL-2.0", "this work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "this work is licensed under the GNU General Public License, version 3"),
    ("ISC", "permission to use, copy, modify, and/or distribute this software for any purpose is hereby granted"),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "released under the MIT License"),
    ("MIT", "permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "subject to the terms of the Mozilla Public License, version 2.0"),
    ("Unlicense", "this is free and unencumbered software released into the public domain"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("AGPL-3.0", _GNU.format("Affero General Public License", 3)),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
     "with the License."),
    ("BSD-2-Clause", _BSD.format("")),
    ("BSD-3-Clause", _BSD.format(_ENDORSE)),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-2.0", _GNU.format("General Public License", 2)),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-3.0", _GNU.format("General Public License", 3)),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
     "provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-2.1", _GNU.format("Lesser General Public License", 2.1)),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("LGPL-3.0", _GNU.format("Lesser General Public License", 3)),
    ("MIT", _MIT + _AS_IS),
    ("MIT", "The MIT License (MIT)"),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v."),
]
CUE = r"(?i)licen[sc]e|redistribution|permission|public domain|creative commons|\bCC0\b"
#: Sentences end at a line's end, or at a stop before white space.
SENTENCE = r"(?<=[.!?])\s+|\n"
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
FILE_NAME = r"(?i)^(licen[sc]e|copying|notice)(\.[a-z]+)?$"
#: Comment marks at the beginning of a line, the end of a paragraph, and the beginning of the first line
#: that is neither blank nor a comment.
MARK = r"(^|\n)[ \t]*(?://+!?|/\*+|\*+/?|#+|--+|;+|<!--|%+)"
PARAGRAPH = r"\n[ \t\r\n]*\n"
NO_COMMENT = r"(^|\n)[ \t\r]*[^ \t\r\n#/*;%<-]"
TAG = r"SPDX-License-Identifier:[ \t]*\(?([A-Za-z0-9.+-]+)"
#: What of an identifier does not name the license, and what it is written with.
TAG_NOISE = r"-only$|-or-later$|[.+-]"
SENTENCES, WHOLE, TAGS = 0, 1, 2


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _joined(text: Column) -> Column:
    """The text without comment marks, a paragraph to a line's length; paragraphs end in a stop."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, MARK, "$1"), PARAGRAPH, ". "), "\n", " ")


def _tag(identifier: Column) -> Column:
    return F.concat(F.lit("spdx "), F.regexp_replace(F.lower(identifier), TAG_NOISE, ""))


def _of_kind(kind: int, found: Column) -> Column:
    return F.transform(found, lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("statement")))


def _statements(name: Column, text: Column) -> Column:
    """The distinct (kind, statement) of a file."""
    said = F.filter(F.array_union(F.split(text, SENTENCE), F.split(_joined(text), SENTENCE)), lambda s: s.rlike(CUE))
    header = F.split(text, NO_COMMENT, 2)[0]
    whole = F.filter(F.array_distinct(F.array(
        F.when(name.rlike(FILE_NAME), _joined(text)), F.when(header.rlike(CUE), _joined(header)))), lambda s: s.isNotNull())
    tags = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TAG), F.lit(1)), _tag))
    return F.concat(_of_kind(SENTENCES, said), _of_kind(WHOLE, whole), _of_kind(TAGS, tags))


def scan_licenses(files: DataFrame, path_column: str = "path", text_column: str = "text",
                  similarity: float = SIMILARITY, keep: list[str] | None = None,
                  templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """(file, path, *keep, own_license, own_similarity) of every row of files; file numbers the rows.

    templates are (license, text), a table that the driver holds; TEMPLATES where none is given.
    """
    keep = keep or []
    bodies = list(TEMPLATES if templates is None else templates)
    licenses = sorted({t[0] for t in bodies})
    spark = files.sparkSession
    rows = files.select(F.col(path_column).alias("path"), F.col(text_column).alias("text"), *keep)
    name = F.coalesce(F.element_at(F.split("path", "/"), -1), F.lit(""))
    states = F.col("text").rlike(CUE) | name.rlike(FILE_NAME)
    # The text goes no further than this scan; what is stored is a path and few sentences, or a license file.
    found = staged(rows.select("path", *keep, F.when(states, _statements(name, F.col("text"))).alias("statements"))
                   .withColumn("file", F.monotonically_increasing_id()), "license-statements")
    # Equal statements are weighed once.
    said = found.select("file", F.inline("statements")).withColumn("key", F.unhex(F.sha2("statement", 256)))
    statements = staged(said.groupBy("key").agg(F.count("*").alias("times"), F.any_value("statement").alias("statement"))
                        .select("key", "times", _terms(F.col("statement")).alias("terms"),
                                F.monotonically_increasing_id().alias("number")), "license-sentences")
    total = statements.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("n"))
    rarity = (statements.select("times", F.explode(F.array_distinct("terms")).alias("term"))
              .groupBy("term").agg(F.sum("times").alias("df")))
    n = total.first()["n"]
    rarity = rarity.select("term", (F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    rarest = F.lit(float(n)) + 1

    named = [(i, x, b) for i, (x, b) in enumerate(bodies)]
    tags = spark.createDataFrame([(len(bodies) + i, x, x) for i, x in enumerate(licenses)], "template int, license string, body string")
    table = spark.createDataFrame(named, "template int, license string, body string").unionByName(
        tags.withColumn("body", _tag(F.col("body"))))

    def weighed(frame: DataFrame, key: list[str]) -> DataFrame:
        counts = frame.select(*key, F.explode("terms").alias("term")).groupBy(*key, "term").agg(F.count("*").alias("tf"))
        w = F.col("tf") * F.coalesce("idf", F.log(rarest) + 1)
        return counts.join(rarity, "term", "left").select(*key, "term", w.alias("w"))

    said_terms = weighed(statements.select("number", "terms"), ["number"])
    template_terms = weighed(table.select("template", _terms(F.col("body")).alias("terms")), ["template"])
    said_size = said_terms.groupBy("number").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    template_size = template_terms.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("template_size"))
    # At most one row per statement and template: the templates are a constant.
    dots = (said_terms.join(template_terms.withColumnRenamed("w", "v"), "term")
            .groupBy("number", "template").agg(F.sum(F.col("w") * F.col("v")).alias("dot")))
    cosines = (dots.join(said_size, "number").join(template_size, "template").join(table.select("template", "license"), "template")
               .select("number", "license", F.round(F.col("dot") / (F.col("size") * F.col("template_size")), 6).alias("cosine")))
    order = spark.createDataFrame([(x, i) for i, x in enumerate(licenses)], "license string, order int")
    last = F.negative(F.col("order")).alias("o")
    named = staged(cosines.filter(F.col("cosine") >= similarity).join(order, "license")
                   .groupBy("number").agg(F.max_by(F.struct("license", "cosine"), F.struct("cosine", last)).alias("best"))
                   .join(statements.select("number", "key"), "number").select("key", "best"), "license-names")
    own = (said.join(named, "key").select("file", "kind", F.col("best.license").alias("license"), F.col("best.cosine").alias("cosine"))
           .join(order, "license").groupBy("file")
           .agg(F.max_by(F.struct("license", "cosine"), F.struct("kind", "cosine", last)).alias("best")))
    return found.select("file", "path", *keep).join(own, "file", "left").select(
        "file", "path", *keep, F.col("best.license").alias("own_license"), F.col("best.cosine").alias("own_similarity"))


def inherit_licenses(scanned: DataFrame, file_name: str = FILE_NAME, salts: int = SALTS) -> DataFrame:
    """Adds license, via ('own', 'inherited' or null) and license_dir to the rows of scan_licenses."""
    columns = scanned.columns
    scanned = staged(scanned, "license-scan")
    parts = F.split("path", "/")
    directory = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    name = F.element_at(parts, -1)
    granting = (scanned.filter(name.rlike(file_name) & F.col("own_license").isNotNull())
                .groupBy(directory.alias("dir"))
                .agg(F.max_by("own_license", F.struct("own_similarity", "own_license")).alias("dir_license")))
    granting = granting.select("dir", "dir_license", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    bare = scanned.filter("own_license is null and path is not null")
    # Every directory above: the first k parts, for k from none to all but the name.
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.struct(
        k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("dir")))
    met = (bare.select("file", F.pmod("file", F.lit(salts)).cast("int").alias("salt"), F.inline(above))
           .join(granting, ["dir", "salt"])
           .groupBy("file").agg(F.max_by(F.struct("dir_license", "dir"), "depth").alias("near")))
    near = F.col("near.dir_license")
    return scanned.join(met, "file", "left").select(
        *columns, F.coalesce("own_license", near).alias("license"),
        F.when(F.col("own_license").isNotNull(), "own").when(near.isNotNull(), "inherited").alias("via"),
        F.when(F.col("own_license").isNull(), F.col("near.dir")).alias("license_dir"))
