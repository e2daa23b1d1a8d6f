from larkspur.llm import licenses as c

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions. The above copyright notice and this
permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS
IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
ROWS = [
    (1, "Some text.\nReleased under the MIT License.\nMore."),
    (2, "Licensed under the Apache License, Version 2.0."),
    (3, "licensed UNDER the   Apache License,\tversion 2.0"),
    (4, "This work is licensed under the GNU General Public License, version 3. Licensed under CC BY-NC 4.0."),
    (5, MIT),
    (6, "He said the license was released under the mit license terms of old."),
    (7, None),
    (8, ""),
    (9, "word " * 40_000 + ". All rights reserved."),
    (9, "Licensed under CC BY-NC 4.0"),
    (10, "Version 2.0 of the licensed thing."),
    (None, "SPDX-License-Identifier: MIT"),
]


def test_rules(docs):
    rows = c.license_scan(docs(ROWS)).collect()
    got = {(r.doc_id, r.n_licenses): r for r in rows}
    named = {k: (r.licenses, r.matches) for k, r in got.items()}
    assert len(rows) == len(ROWS)
    assert named[1, 1] == (["MIT"], ["MIT:notice:0"])
    assert named[2, 1] == named[3, 1] == (["Apache-2.0"], ["Apache-2.0:notice:0"])
    assert named[4, 2][0] == ["CC-BY-NC-4.0", "GPL-3.0"] and got[4, 2].sentence_ids == ["gpl-3-notice", "cc-by-nc-4-notice"]
    assert named[5, 1] == (["MIT"], ["MIT:full-text:0"])
    assert sorted(r.licenses for r in rows if r.doc_id == 9) == [["CC-BY-NC-4.0"], ["Proprietary"]] and named[None, 1][0] == ["MIT"]
    assert all((k, 0) in named for k in (6, 7, 8, 10))


def test_order_matters(docs):
    rules = (("AB", "pair", ("a", "b")),)
    known = {"first sentence": "a", "second sentence": "b"}
    rows = [(1, "First sentence. Second sentence."), (2, "Second sentence. First sentence."), (3, "First sentence. Other. Second sentence. First sentence! second sentence")]
    got = {r.doc_id: r.matches for r in c.license_scan(docs(rows), known, rules).collect()}
    assert got == {1: ["AB:pair:0"], 2: [], 3: ["AB:pair:0", "AB:pair:2"]}


def test_planted_lines_are_found(spark, sf_dir):
    found = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r.licenses for r in c.license_scan(found).collect()}
    lines = {"Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "version 3.": "GPL-3.0"}
    for r in found.collect():
        wanted = {v for k, v in lines.items() if k in r.text}
        assert wanted <= set(got[r.doc_id])
        assert wanted or "icense" in r.text or "rights reserved" in r.text.lower() or not got[r.doc_id]


def test_native_and_empty(docs):
    out = c.license_scan(docs([]))
    assert out.count() == 0
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


MIT_FILE = """MIT License

Copyright (c) 2020 Some Body

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
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY."""
GPL_HEADER = """# Copyright (C) 2020 Some Body
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""


def test_unaltered_files(docs):
    """With headings, copyright lines and colons, wrapped or on one line."""
    rows = [(1, MIT_FILE), (2, " ".join(MIT_FILE.split("\n")[4:])), (3, GPL_HEADER)]
    got = {r.doc_id: r for r in c.license_scan(docs(rows)).collect()}
    assert got[1].matches == got[2].matches == ["MIT:full-text:0"]
    assert got[3].sentence_ids == ["gpl-3-grant", "gpl-warranty"] and got[3].licenses == ["GPL-3.0"]


def test_a_notice_line_and_a_wrapped_text_are_both_found(docs):
    bsd = """Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution."""
    notices = ("SPDX-License-Identifier: MIT", "Released under the MIT License")
    got = {r.doc_id: r for r in c.license_scan(docs([(i, f"{n}\n{bsd}") for i, n in enumerate(notices)])).collect()}
    for r in got.values():
        assert r.sentence_ids == ["mit-notice", "bsd-source", "bsd-binary"] and r.licenses == ["BSD-2-Clause", "MIT"]


APACHE = """# Copyright 2020 Some Body
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
LESSER = """ * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.
 *
 * This library is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
 * Lesser General Public License for more details."""
MOZILLA = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"""
BSD = """BSD 3-Clause License

Copyright (c) 2020, Some Body

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
ISC = """ISC License

Copyright (c) 2020 Some Body

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES."""
GPL_TITLE = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>"""


def test_more_unaltered_files(docs):
    texts = {"Apache-2.0:header": APACHE, "LGPL-2.1:header": LESSER, "MPL-2.0:header": MOZILLA, "BSD-3-Clause:full-text": BSD, "ISC:full-text": ISC, "GPL-3.0:title": GPL_TITLE}
    got = {r.doc_id: r.matches for r in c.license_scan(docs(list(enumerate(texts.values())))).collect()}
    for i, wanted in enumerate(texts):
        assert any(m.startswith(wanted + ":") for m in got[i]), (wanted, got[i])
        assert {m.split(":")[0] for m in got[i]} <= {wanted.split(":")[0], "BSD-2-Clause"}


def test_expressions_of_spdx_lines(docs):
    rows = [
        (1, "# SPDX-License-Identifier: MIT OR Apache-2.0"),
        (2, "// SPDX-License-Identifier: (BSD-3-Clause AND LGPL-2.1-or-later) OR MPL-2.0\nint x;"),
        (3, "/* SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note */"),
        (4, "SPDX-License-Identifier: Unheard-1.0 OR ISC\nthis or that"),
        (5, "MIT OR Apache-2.0"),
    ]
    got = {r.doc_id: r.licenses for r in c.license_scan(docs(rows)).collect()}
    assert got == {1: ["Apache-2.0", "MIT"], 2: ["BSD-3-Clause", "LGPL-2.1", "MPL-2.0"], 3: ["GPL-2.0"], 4: ["ISC"], 5: []}


def test_many_lines(docs):
    """A text of 200,000 lines with a licence in its middle."""
    text = "some line of text\n" * 100_000 + MIT_FILE + "\nanother line" * 100_000
    assert [r.licenses for r in c.license_scan(docs([(1, text)])).collect()] == [["MIT"]]
