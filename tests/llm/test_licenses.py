"""Licence texts, wrapped and behind comment leaders, by both engines."""

from __future__ import annotations

import textwrap

import duckdb
import pytest

from wrenfold.llm import licenses

MIT = """MIT License

Copyright (c) 2021 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

{}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
GPL = """This {what} is free software{a} you can redistribute it and/or modify it under the terms of the GNU {name} General Public License as published by the Free Software Foundation{b} either version {v} of the License, or (at your option) any later version.

This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} General Public License for more details.

You should have received a copy of the GNU {name} General Public License along with this {what}. If not, see <https://www.gnu.org/licenses/>."""
TEXTS = {
    "mit": (MIT, "MIT"),
    "bsd2": (BSD.format(""), "BSD-2-Clause"),
    "bsd3": (BSD.format("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"), "BSD-3-Clause"),
    "gpl3": (GPL.format(what="program", name="", a=":", b=",", v="3"), "GPL-3.0-or-later"),
    "gpl2": (GPL.format(what="program", name="", a=";", b=";", v="2"), "GPL-2.0-or-later"),
    "lgpl21": (GPL.format(what="library", name="Lesser", a=";", b=";", v="2.1"), "LGPL-2.1-or-later"),
    "agpl3": (GPL.format(what="program", name="Affero", a=":", b=",", v="3"), "AGPL-3.0-or-later"),
    "apache": ("""Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""", "Apache-2.0"),
    "isc": ("""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""", "ISC"),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "MPL-2.0"),
    "unlicense": ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "Unlicense"),
    "cc0": ("To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.", "CC0-1.0"),
    "zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", "Zlib"),
    "ccby": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0"),
    "ref": ("This project is licensed under the GNU General Public License, version 3.", "GPL-3.0-only"),
}


def wrapped(text: str, width: int, leader: str) -> str:
    lines = [line for p in text.split("\n\n") for line in [*textwrap.wrap(p, width, break_long_words=False, break_on_hyphens=False), ""]]
    return "\n".join(f"{leader}{x}".rstrip() for x in lines)


def both(spark, rows: list[tuple]) -> dict:  # noqa: ANN001
    """What both engines say, which must be the same."""
    got = licenses.recognise(spark.createDataFrame(rows, "doc_id long, text string"))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    found = con.execute(licenses.oracle_sql())
    names = [c[0] for c in found.description]
    said = {tuple(r[c] for c in names) for r in got.collect()}
    assert said == set(found.fetchall())
    return {r[0]: dict(zip(names, r, strict=True)) for r in said}


@pytest.mark.parametrize("leader", ["", "# ", "// ", " * ", "-- "])
def test_wrapped(spark, leader):  # noqa: ANN001, ANN201
    cases = [(name, width) for name in TEXTS for width in (40, 55, 60, 65, 70, 72, 75, 80, 100, 120)]
    got = both(spark, [(k, wrapped(TEXTS[name][0], width, leader)) for k, (name, width) in enumerate(cases)])
    for k, (name, width) in enumerate(cases):
        assert (got[k]["licences"], got[k]["left_over"]) == (TEXTS[name][1], ""), (name, width)


def test_lines(spark):  # noqa: ANN001, ANN201
    rows = [
        ("# SPDX-License-Identifier: Apache-2.0\nimport os", "Apache-2.0"), ("// SPDX-License-Identifier: MIT\n// Copyright", "MIT"), ("/* spdx-license-identifier: GPL-2.0+ */\nint x;", "GPL-2.0-or-later"), ("SPDX-License-Identifier: MIT OR Apache-2.0", "MIT OR Apache-2.0"),
        ("<!-- SPDX-License-Identifier: CC-BY-SA-4.0 -->\r\n<p>", "CC-BY-SA-4.0"), ("x\nReleased under the MIT License.\nLicensed under the Apache License, Version 2.0.", "Apache-2.0,MIT"), ("MIT License\nCopyright (c) 2020 X\n" + wrapped(MIT, 70, "").split("\n\n", 2)[2], "MIT"),
        ("This is not about licences, nor software.", ""), ("released under\nthe MIT License", "MIT"), ("one\ntwo\nLicensed under\nCC BY-NC 4.0", "CC-BY-NC-4.0"), ("permission is hereby granted", ""), ("", ""), ("GPL-3.0 SPDX-License-Identifier: nothing-known", ""),
        ("license\n" * 3000 + "Released under the MIT License.\n" + "software\n" * 3000, "MIT"), ("License " * 5000, ""),
    ]
    got = both(spark, [(k, t) for k, (t, _) in enumerate(rows)])
    assert [got[k]["licences"] for k in range(len(rows))] == [w for _, w in rows]
    assert got[9]["restricted"]


def test_more_than_twenty_licences():  # noqa: ANN201
    assert len({name for name, _ in licenses.RULES}) >= 40
    assert {"LGPL-3.0-or-later", "AGPL-3.0-only", "ISC", "CC0-1.0", "Unlicense", "BSD-3-Clause", "GPL-3.0-or-later"} <= {name for name, _ in licenses.RULES}
    assert len({s for s in licenses.SENTENCES}) == len(licenses.SENTENCES)
