"""Licence recognition on headers and texts as they stand in files."""

import textwrap

import pytest

from bidframe.llm import licences

SCHEMA = "doc_id long, text string, rule int, licence string, ids string, m string, line string"

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
BSD = """Copyright (c) 2011, Some Owner Ltd. All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
NAMES = """

3. Neither the name of Some Owner Ltd nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""


def gnu(name, program, version, mark=":", later=True):
    tail = f"either version {version} of the License, or (at your option) any later version." if later else f"version {version} of the License."
    return (
        f"This {program} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{';' if mark == ';' else ','} {tail}\n\n"
        f"This {program} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
    )


TEXTS = {
    "MIT": MIT,
    "Apache-2.0": APACHE,
    "BSD-2-Clause": BSD,
    "BSD-3-Clause": BSD + NAMES,
    "GPL-2.0-or-later": gnu("General Public License", "program", "2", ";"),
    "GPL-3.0-or-later": gnu("General Public License", "program", "3"),
    "GPL-2.0-only": gnu("General Public License", "program", "2", ";", later=False).replace("Foundation;", "Foundation,"),
    "LGPL-2.1-or-later": gnu("Lesser General Public License", "library", "2.1", ";"),
    "LGPL-3.0-or-later": gnu("Lesser General Public License", "library", "3"),
    "AGPL-3.0-or-later": gnu("Affero General Public License", "program", "3"),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def wrap(text, mark="", width=72):
    return "\n".join(f"{mark}{line}".rstrip() if mark else line for part in text.split("\n\n") for line in [*textwrap.wrap(part, width), ""])


def wrappings(text):
    c = "/*\n" + wrap(text, " * ") + "\n */\nint main() { return 0; }"
    return [text, wrap(text), wrap(text, width=40), wrap(text, "# ") + "\nimport os", wrap(text, "// "), c, wrap(text, ";; "), wrap(text).replace("\n", "\r\n"), "<!--\n" + wrap(text) + "-->\n<p>x</p>"]


@pytest.fixture(scope="module")
def scan(spark):
    def run(texts):
        rows = [(k, t, 1, "a", "b", "c", "d") for k, t in enumerate(texts)]
        got = licences.licence_scan(spark.createDataFrame(rows, SCHEMA).repartition(8)).collect()
        return [r.licence for r in sorted(got, key=lambda r: r.doc_id)]

    return run


def test_texts_in_every_wrapping(scan):
    texts = [(name, w) for name, t in TEXTS.items() for w in wrappings(t)]
    assert list(zip([n for n, _ in texts], scan([w for _, w in texts]))) == [(n, n) for n, _ in texts]


def test_several_licences(scan):
    mixed = [wrap(MIT) + "\n\n" + wrap(APACHE), wrap(BSD + NAMES, "# ") + "\n\n" + wrap(TEXTS["GPL-3.0-or-later"], "# "), "Released under the MIT License. Parts are licensed under CC BY-NC 4.0.", wrap(BSD) + "\n\n" + wrap(BSD + NAMES)]
    assert [set(x.split(" AND ")) for x in scan(mixed)] == [{"MIT", "Apache-2.0"}, {"BSD-3-Clause", "GPL-3.0-or-later"}, {"MIT", "CC-BY-NC-4.0"}, {"BSD-2-Clause", "BSD-3-Clause"}]


@pytest.mark.parametrize("known", [True])
def test_titles_tags_and_names(scan, known):
    lines = {
        "GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.": "GPL-3.0",
        "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991": "GPL-2.0",
        "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999": "LGPL-2.1",
        "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007": "AGPL-3.0",
        "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/": "Apache-2.0",
        "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions": "MPL-2.0",
        "// SPDX-License-Identifier: GPL-2.0-or-later\n#include <x.h>": "GPL-2.0-or-later",
        "# SPDX-License-Identifier: (MIT OR Apache-2.0)": "Apache-2.0 AND MIT",
        "# SPDX-License-Identifier: LGPL-2.1": "LGPL-2.1-only",
        "some words\nThis work is licensed under the GNU General Public License, version 3.\nmore words": "GPL-3.0-only",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "This library is distributed under the terms of the GNU LGPL v2.1 or later.": "LGPL-2.1-or-later",
        "mylib is released under the 3-clause BSD license": "BSD-3-Clause",
        "MIT License\n\nCopyright (c) 2020 Someone": "MIT",
        "Text. All rights reserved.": "proprietary",
        "no such thing": None,
        "a driving license is required. The software is permitted to run": None,
        "": None,
    }
    assert dict(zip(lines, scan(list(lines)))) == lines


def test_long_text_is_read_whole(scan):
    assert scan(["word " * 200_000 + ".\n\n" + wrap(MIT), "x" * 500_000 + " license\n" * 2000]) == ["MIT", None]
