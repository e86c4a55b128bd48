"""Further licences, expressions in tags, reserved rights, and the matching of rules against its definition."""

import random

import pytest

from quillspan.llm import licenses

from .helpers import frame
from .test_licence_texts import BSD


def found(text):
    cut = licenses.sentences(text)
    ids = [(i, name) for i, (_, _, key) in enumerate(cut) for name in licenses.identifiers(key)]
    return [n for n, _, _ in licenses.match_rules(ids, licenses.ordered_rules())]


FREE = "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version.\n\nThis {} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU {} Public License for more details.\n\nYou should have received a copy of the GNU {} Public License along with this {}; if not, write to us."
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""


@pytest.mark.parametrize(("licence", "family", "version"), [("LGPL-2.1", "Lesser General", "2.1"), ("LGPL-3.0", "Lesser General", "3"), ("AGPL-3.0", "Affero General", "3"), ("GPL-2.0", "General", "2")])
@pytest.mark.parametrize("thing", ["program", "library"])
def test_free_software_notices(licence, family, version, thing):
    assert found(FREE.format(thing, family, version, thing, family, family, thing)) == [licence]


def test_zlib_boost_and_names():
    assert found("zlib.h\n\n" + ZLIB) == ["Zlib"]
    assert found("Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt)") == ["BSL-1.0"]
    assert found("Released under the GPL v3. Licensed under the Apache 2.0 license.") == ["GPL-3.0", "Apache-2.0"]


@pytest.mark.parametrize(
    ("tag", "want"),
    [
        ("MIT OR Apache-2.0", ["MIT", "Apache-2.0"]), ("(MIT OR Apache-2.0) AND BSD-3-Clause", ["MIT", "Apache-2.0", "BSD-3-Clause"]), ("GPL-2.0-only WITH Classpath-exception-2.0 OR MIT", ["GPL-2.0", "MIT"]),
        ("GPL-3.0-or-later", ["GPL-3.0"]), ("LGPL-2.1-or-later AND MIT */", ["LGPL-2.1", "MIT"]), ("MIT MIT", ["MIT"]), ("MIT OR LicenseRef-own", ["MIT"]), ("LicenseRef-own", []), ("", []), ("Zlib", ["Zlib"]), ("BSL-1.0", ["BSL-1.0"]),
    ],
)
def test_tags(tag, want):
    assert found(f"// SPDX-License-Identifier: {tag}\nint x;") == want


def test_reserved_rights():
    assert found("Copyright (c) 2020, Someone.\nAll rights reserved.\n\n" + "\n\n".join(BSD)) == ["BSD-3-Clause"]
    assert found("All rights reserved.") == ["Proprietary"]
    far = "A sentence of its own. " * 20
    assert found("All rights reserved. " + far + "Released under the MIT License.") == ["Proprietary", "MIT"]
    assert found("Released under the MIT License. All rights reserved. " + far + "All rights reserved.") == ["MIT", "Proprietary"]


def by_definition(sentences, rules, gap):
    """Sentences from the left; the first rule in order of which every sentence follows, with at most ``gap`` unknown ones between two."""
    out, at = [], 0
    while at < len(sentences):
        for licence, sequence in rules:
            where, last = at, at
            for k, want in enumerate(sequence):
                if k:
                    where = next((j for j in range(last + 1, len(sentences)) if sentences[j] is not None), len(sentences))
                if where >= len(sentences) or sentences[where] != want or where - last > gap + 1:
                    break
                last = where
            else:
                out.append((licence, at, last))
                at = last
                break
        at += 1
    return out


def test_rules_against_their_definition():
    rng = random.Random(4)
    for _ in range(4000):
        names = "abcd"
        rules = sorted([(f"L{k}", tuple(rng.choice(names) for _ in range(rng.randrange(1, 5)))) for k in range(rng.randrange(1, 6))], key=lambda r: -len(r[1]))
        text = [rng.choice([None, *names]) for _ in range(rng.randrange(0, 14))]
        gap = rng.randrange(3)
        assert licenses.match_rules([(i, x) for i, x in enumerate(text) if x], rules, gap) == by_definition(text, rules, gap)


def test_spans_of_a_tag(spark):
    text = "x\n# SPDX-License-Identifier: MIT OR Apache-2.0\ny"
    r = licenses.scan_licences(frame(spark, [text])).first()
    assert [(s["licence"], text[s["start"] : s["end"]].strip()) for s in r["spans"]] == [(x, "# SPDX-License-Identifier: MIT OR Apache-2.0") for x in ("MIT", "Apache-2.0")] and r["n_known"] == 1
