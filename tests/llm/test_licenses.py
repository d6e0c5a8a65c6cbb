import textwrap

from docketlens.llm import licenses as L
from docketlens.llm import queries

FILES = "path string, text string, file long, license string, `dir` string"


def scan(spark, rows):
    files = spark.createDataFrame([(*r, 1, "l", "d") for r in rows], FILES)
    return {(r["path"], r["license"], r["via"], r["license_dir"]) for r in L.inherit_licenses(L.scan_licenses(files)).collect()}


def test_own_and_inherited(spark):
    found = scan(spark, [
        ("a/LICENSE", "Released under the MIT License."), ("a/x.py", "code"), ("a/b/y.py", "code. More code\nLicensed under the Apache License, Version 2.0."),
        ("a/b/c/z.py", None), ("a/b/LICENSE.txt", "This work is licensed under the GNU General Public License, version 3."),
        ("a/b/c/d/e.py", ""), ("other/f.py", "no word of it"), ("LICENSEE/g.py", "x"), (None, "Licensed under CC BY-NC 4.0."),
        ("a/b/c/d/e.py", "")])
    assert found == {
        ("a/LICENSE", "MIT", "own", None), ("a/x.py", "MIT", "inherited", "a"), ("a/b/y.py", "Apache-2.0", "own", None),
        ("a/b/c/z.py", "GPL-3.0", "inherited", "a/b"), ("a/b/LICENSE.txt", "GPL-3.0", "own", None),
        ("a/b/c/d/e.py", "GPL-3.0", "inherited", "a/b"), ("other/f.py", None, None, None), ("LICENSEE/g.py", None, None, None),
        (None, "CC-BY-NC-4.0", "own", None)}


def test_root_license_and_far_statements(spark):
    filler = "some words of filler here. " * 3000
    found = scan(spark, [("LICENSE", filler + "Licensed under CC BY 4.0. " + filler), ("deep/er/file", "x"),
                         ("near/file", "We issue no license fee for your driving permission.")])
    assert found == {("LICENSE", "CC-BY-4.0", "own", None), ("deep/er/file", "CC-BY-4.0", "inherited", ""),
                     ("near/file", "CC-BY-4.0", "inherited", "")}


GPL = """{} Copyright (C) 2019 Some One
{}
{} This program is free software: you can redistribute it and/or modify
{} it under the terms of the GNU General Public License as published by
{} the Free Software Foundation, either version VERSION of the License, or
{} (at your option) any later version.
{}
{} This program is distributed in the hope that it will be useful,
{} but WITHOUT ANY WARRANTY; without even the implied warranty of
{} MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */

int main(void) { return 0; }
"""
APACHE = """#!/usr/bin/env python
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#     http://www.apache.org/licenses/LICENSE-2.0
import os
"""


def wrapped(text, width=70, mark=""):
    return "\n".join(mark + line for line in textwrap.wrap(text, width)) + "\n"


def test_wrapped_headers_tags_and_whole_files(spark):
    code = "\n\nint f(int a) { return a - 1; }\n"
    texts = {
        "gpl3.py": (GPL.replace("{}", "#").replace("VERSION", "3") + "\nimport os\n", "GPL-3.0"),
        "gpl2.c": ("/*\n" + GPL.replace("{}", " *").replace("VERSION", "2") + " */" + code, "GPL-2.0"),
        "lgpl.c": (GPL.replace("{}", "//").replace("VERSION", "2.1").replace("GNU General", "GNU Lesser General") + code, "LGPL-2.1"),
        "agpl.sql": (GPL.replace("{}", "--").replace("VERSION", "3").replace("GNU General", "GNU Affero General") + "select 1;", "AGPL-3.0"),
        "mpl.c": (MPL, "MPL-2.0"), "apache.py": (APACHE, "Apache-2.0"),
        "bsd3.c": ("/*\n * Copyright 2001 X.\n *\n" + wrapped(L._BSD.format(L._ENDORSE), mark=" * ") + " */" + code, "BSD-3-Clause"),
        "bsd2.c": ("// Copyright 2001 X.\n//\n" + wrapped(L._BSD.format(""), mark="// ") + code, "BSD-2-Clause"),
        "t1.c": ("// SPDX-License-Identifier: MIT" + code, "MIT"),
        "t2.c": ("/* SPDX-License-Identifier: Apache-2.0 */" + code, "Apache-2.0"),
        "t3.c": ("// SPDX-License-Identifier: GPL-2.0-or-later\n" + code, "GPL-2.0"),
        "t4.c": ("// SPDX-License-Identifier: (BSD-3-Clause OR GPL-2.0+)\n" + code, "BSD-3-Clause"),
        "t5.c": ("// SPDX-License-Identifier: Zlib\n" + code, None), "t6.c": ("// SPDX-License-Identifier: LGPL-2.0-only" + code, None),
        "plain.c": ("/* Adds one and\n * takes it away. */" + code, None),
        "p/COPYING": ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n"
                      " Everyone is permitted to copy this.\n", "GPL-3.0"),
        "q/LICENSE": ("Copyright (c) 2011 X\n\n" + wrapped(L._MIT) + "\n" + wrapped(L._AS_IS), "MIT"),
        "r/LICENSE.txt": ("Copyright 2011, X\nAll rights reserved.\n\n" + wrapped(L._BSD.format("")), "BSD-2-Clause"),
        "s/LICENSE.md": ("                                 Apache License\n                           Version 2.0, January 2004\n"
                         "                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS\n", "Apache-2.0"),
        "t/LICENSE": ("All of this is ours.\n" * 50, None)}
    files = spark.createDataFrame([(p, t, 1, "l", "d") for p, (t, _) in texts.items()], FILES)
    found = {r["path"]: r["own_license"] for r in L.scan_licenses(files).collect()}
    assert found == {p: x for p, (_, x) in texts.items()}


def test_given_templates(spark):
    files = spark.createDataFrame([("a", "Use is free for all members. A license for members only.", 1, "l", "d"),
                                   ("b", "Released under the MIT License.", 1, "l", "d")], FILES)
    found = L.scan_licenses(files, templates=[("Club-1.0", "a license for members only")]).collect()
    assert {(r["path"], r["own_license"]) for r in found} == {("a", "Club-1.0"), ("b", None)}


def test_empty_and_repeated(spark):
    files = spark.createDataFrame([("a/b", "Released under the MIT License.", 1, "l", "d")] * 3, FILES)
    assert L.inherit_licenses(L.scan_licenses(files)).filter("license = 'MIT'").count() == 3
    assert L.inherit_licenses(L.scan_licenses(files.limit(0))).count() == 0


def test_plan_has_no_python(spark, sf_dir):
    plan = queries.QUERIES["op8_license_scan"](spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
