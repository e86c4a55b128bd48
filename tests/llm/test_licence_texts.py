"""Every licence rule on its canonical wording, wrapped and unwrapped, plain and as a comment."""

import textwrap

import pytest

from quillspan.llm import licenses

MIT = [
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
]
APACHE = [
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "http://www.apache.org/licenses/LICENSE-2.0",
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
]
WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
GPL3 = [
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    WARRANTY,
    "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
]
GPL2 = [
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    WARRANTY,
    "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
]
BSD = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
]
CASES = [
    ("MIT", 4, MIT), ("MIT", 3, [*MIT[:2], MIT[2].split(" IN NO EVENT")[0]]), ("MIT", 2, MIT[:2]),
    ("Apache-2.0", 4, APACHE), ("Apache-2.0", 3, APACHE[:2]), ("Apache-2.0", 2, [APACHE[0].split("; ")[1].capitalize(), APACHE[1].replace("http:", "https:")]),
    ("GPL-3.0", 4, GPL3), ("GPL-2.0", 4, GPL2), ("GPL-3.0", 1, GPL3[:1]), ("GPL-2.0", 1, GPL2[:1]),
    ("BSD-3-Clause", 7, BSD), ("BSD-2-Clause", 5, BSD[:3]),
    ("ISC", 1, ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."]),
    ("MPL-2.0", 1, ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."]),
    ("Unlicense", 1, ["This is free and unencumbered software released into the public domain."]),
    ("Proprietary", 1, ["All rights reserved."]),
]


def found(text):
    cut = licenses.sentences(text)
    ids = [(i, name) for i, (_, _, key) in enumerate(cut) if (name := licenses.known_sentences().get(key))]
    return [(n, b - a + 1) for n, a, b in licenses.match_rules(ids, licenses.ordered_rules())]


@pytest.mark.parametrize("mark", ["", "# ", " * "])
@pytest.mark.parametrize("width", [0, 30, 47, 60, 72, 80])
@pytest.mark.parametrize("name, size, paragraphs", CASES)
def test_rules_on_canonical_texts(name, size, paragraphs, width, mark):
    lines = [x for p in ["Copyright 2020 Someone", *paragraphs, "Some other text"] for x in (*(textwrap.wrap(p, width, break_long_words=False) if width else [p]), "")]
    assert found("\n".join(mark + x for x in lines)) == [(name, size)]
    assert found("\r\n".join(mark + x for x in lines)) == [(name, size)]


def test_every_known_sentence_can_be_reached():
    for key in licenses.known_sentences():
        assert [k for _, _, k in licenses.sentences(key)] == [key]


@pytest.mark.parametrize("licence", licenses.LICENCE_NAMES)
def test_spdx_tags(licence):
    assert found(f"int x;\n// SPDX-License-Identifier: {licence}\nint y;") == [(licence, 1)]


def test_unknown_lines_leave_notices_alone():
    assert found("a line without a stop\nReleased under the MIT License.\nanother") == [("MIT", 1)]
    assert found("the MIT license is mentioned\nhere") == []
    assert licenses.sentences("one two\nthree. Four\n\nfive") == [(0, 14, "one two three"), (14, 21, "four"), (21, 25, "five")]
