"""Licences as they are published, line by line, against the scan and its SQL."""

import duckdb
import pytest
from test_llm import docs

from inkstrata.llm import licenses

MIT = """The MIT License (MIT)

Copyright (c) 2011 Some Body and others

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
ISC = """Copyright (c) 2004-2010 by Some Consortium, Inc. ("ISC")

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND ISC DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL ISC BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
"""
BSD = """Copyright (c) 1998, Some Holder
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

{0}1{1} Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

{0}2{1} Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{2}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
NAMES = """
3. Neither the name of {0} nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
AUTHOR = """
3. The name of the author may not be used to endorse or promote products
   derived from this software without specific prior written permission.
"""
UNLICENSE = """This is free and unencumbered software released into the public
domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this
software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software.
"""
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
APACHE = """   Copyright [yyyy] [name of copyright owner]

   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
"""
MPL = """ * This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
CASES = [
    (MIT, "MIT"), (ISC, "ISC"), (ISC.replace("ISC DISCLAIMS", "THE AUTHOR DISCLAIMS").replace("and/or distribute", "and distribute"), "ISC"), (BSD.format("", ".", ""), "BSD-2-Clause"), (BSD.format("(", ")", ""), "BSD-2-Clause"),
    (BSD.format("", ".", NAMES.format("the copyright holder")), "BSD-3-Clause"), (BSD.format("", ".", NAMES.format("the University")), "BSD-3-Clause"), (BSD.format("", ".", NAMES.format("Some Body, Inc.")), "BSD-3-Clause"),
    (BSD.format("", ".", AUTHOR), "BSD-3-Clause"), (UNLICENSE, "Unlicense"), (ZLIB, "Zlib"), (GPL, "GPL-3.0-or-later"), (APACHE, "Apache-2.0"), (MPL, "MPL-2.0"), (MIT + BSD.format("", ".", ""), "BSD-2-Clause;MIT"),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", "Apache-2.0;MIT"), ("x\n# SPDX-License-Identifier: GPL-2.0-only\ny", "GPL-2.0-only"), ("// SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR BSD-3-Clause", "BSD-3-Clause;GPL-2.0-only"),
    ("SPDX-License-Identifier: MITX", ""), ("SPDX-License-Identifier:\nMIT", ""), ("Some words about the University and its license.", ""), (None, ""), ("", ""),
]


@pytest.fixture(scope="module")
def table(spark):
    return docs(spark, [text for text, _ in CASES] + [(x or "").replace("\n", "\r\n") for x, _ in CASES])


def test_published_texts(table):
    got = [r["licenses"] for r in licenses.scan_licenses(table).orderBy("doc_id").collect()]
    assert got == [name for _, name in CASES] * 2


def test_sql_says_the_same(table):
    documents = table.toPandas()  # noqa: F841
    want = duckdb.sql(licenses.sql()).fetchall()
    got = licenses.scan_licenses(table).select("doc_id", "n_known", "sentence_ids", "licenses").collect()
    assert sorted(want) == sorted(tuple(r) for r in got)
