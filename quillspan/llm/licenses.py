"""Licence recognition by sentence rules.

Texts are cut into pieces (line ends and punctuation before white space), each
normalised to lower-case words of ASCII letters and digits.  Pieces in a row
whose words make up a known sentence are that sentence, the longest first, so
neither wrapped lines nor a colon or semicolon within it matter.  Other pieces
join up to the next full stop, exclamation or question mark, blank line or known
sentence.  Sentences that are known map to identifiers; the sequence of identifiers of a
document is matched against ordered rules, longest first.  Unknown sentences
may stand between the sentences of a rule, at most ``GAP`` in a row.  An SPDX
tag may hold an expression; each licence in it is a reference.  That all rights
are reserved speaks for no licence only where none is named nearby: headers of
free licences say it too.

The tables are fixed and small (a few hundred entries, made by rule from the
lists below), so they travel with the task.  Null and empty texts have no
sentences and no licences.  Repeated rows repeat their results.
"""

from __future__ import annotations

import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.workspace import table

GAP = 1

# --- fixed values: licences by identifier and the names that notices use ---------------
LICENCE_NAMES = {
    "MIT": "mit license",
    "Apache-2.0": "apache license version 2 0",
    "GPL-2.0": "gnu general public license version 2",
    "GPL-3.0": "gnu general public license version 3",
    "LGPL-2.1": "gnu lesser general public license version 2 1",
    "LGPL-3.0": "gnu lesser general public license version 3",
    "AGPL-3.0": "gnu affero general public license version 3",
    "MPL-2.0": "mozilla public license version 2 0",
    "EPL-2.0": "eclipse public license version 2 0",
    "BSD-2-Clause": "bsd 2 clause license",
    "BSD-3-Clause": "bsd 3 clause license",
    "ISC": "isc license",
    "Unlicense": "unlicense",
    "Zlib": "zlib license",
    "BSL-1.0": "boost software license version 1 0",
    "Artistic-2.0": "artistic license 2 0",
    "CDDL-1.0": "common development and distribution license version 1 0",
    "EUPL-1.2": "european union public licence version 1 2",
    "OFL-1.1": "sil open font license version 1 1",
    "PostgreSQL": "postgresql license",
    "Python-2.0": "python software foundation license version 2",
    "0BSD": "zero clause bsd license",
    "WTFPL": "do what the fuck you want to public license version 2",
    "CC0-1.0": "cc0 1 0",
    "CC-BY-4.0": "cc by 4 0",
    "CC-BY-SA-4.0": "cc by sa 4 0",
    "CC-BY-NC-4.0": "cc by nc 4 0",
    "CC-BY-ND-4.0": "cc by nd 4 0",
    "CC-BY-NC-SA-4.0": "cc by nc sa 4 0",
    "CC-BY-NC-ND-4.0": "cc by nc nd 4 0",
}
# --- fixed values: other names of these ------------------------------------------------
OTHER_NAMES = {
    "apache license 2 0": "Apache-2.0",
    "apache 2 0": "Apache-2.0",
    "apache 2": "Apache-2.0",
    "gpl version 2": "GPL-2.0",
    "gpl v2": "GPL-2.0",
    "gplv2": "GPL-2.0",
    "gpl version 3": "GPL-3.0",
    "gpl v3": "GPL-3.0",
    "gplv3": "GPL-3.0",
    "gnu gpl v2": "GPL-2.0",
    "gnu gpl v3": "GPL-3.0",
    "lgpl v2 1": "LGPL-2.1",
    "lgplv2 1": "LGPL-2.1",
    "lgpl v3": "LGPL-3.0",
    "lgplv3": "LGPL-3.0",
    "agpl v3": "AGPL-3.0",
    "agplv3": "AGPL-3.0",
    "mozilla public license 2 0": "MPL-2.0",
    "eclipse public license v 2 0": "EPL-2.0",
    "simplified bsd license": "BSD-2-Clause",
    "freebsd license": "BSD-2-Clause",
    "new bsd license": "BSD-3-Clause",
    "revised bsd license": "BSD-3-Clause",
    "boost software license": "BSL-1.0",
    "sil open font license": "OFL-1.1",
    "creative commons attribution 4 0 international": "CC-BY-4.0",
    "creative commons attribution sharealike 4 0 international": "CC-BY-SA-4.0",
    "creative commons attribution noncommercial 4 0 international": "CC-BY-NC-4.0",
    "creative commons attribution noderivatives 4 0 international": "CC-BY-ND-4.0",
    "creative commons zero v1 0 universal": "CC0-1.0",
}
# --- fixed values: how notices begin ---------------------------------------------------
OPENINGS = (
    "licensed under", "released under", "distributed under", "available under", "published under",
    "this work is licensed under", "this file is licensed under", "this software is licensed under",
    "this document is licensed under", "this project is licensed under", "this program is licensed under",
)
# --- fixed values: sentences of full licence texts and notices --------------------------
TEXT_SENTENCES = {
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-warranty": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "public-domain": "this is free and unencumbered software released into the public domain",
    "zlib-warranty": "this software is provided as is without any express or implied warranty",
    "zlib-liability": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib-origin": "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    "zlib-altered": "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
    "zlib-notice": "this notice may not be removed or altered from any source distribution",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "boost-notice": "the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor",
    "rights": "all rights reserved",
}
# --- fixed values: the family of one free software foundation, (licence, name, version) ---
FAMILY = (
    ("GPL-2.0", "general", "2"),
    ("GPL-3.0", "general", "3"),
    ("LGPL-2.1", "lesser general", "2 1"),
    ("LGPL-3.0", "lesser general", "3"),
    ("AGPL-3.0", "affero general", "3"),
)
SUBJECTS = ("program", "library", "software", "file")
LATER = (" or at your option any later version", "")
# --- fixed values: other wordings of these ------------------------------------------------
VARIANTS = {
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "apache-copy",
}
# --- fixed values: what may follow the name in a notice, and the identifier in a tag ------
TAILS = ("", " the license")
SPDX_TAILS = ("", " only", " or later")
# --- fixed values: ordered rules, (licence, sentences in order) -------------------------
TEXT_RULES = (
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("Apache-2.0", ("ref:Apache-2.0", "apache-use", "apache-copy", "apache-warranty")),
    ("Apache-2.0", ("ref:Apache-2.0", "apache-use", "apache-copy")),
    ("Apache-2.0", ("apache-use", "apache-copy")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    *((licence, (f"free:{licence}", "warranty", "copy")) for licence, _, _ in FAMILY),
    *((licence, (f"free:{licence}", "warranty")) for licence, _, _ in FAMILY),
    *((licence, (f"free:{licence}",)) for licence, _, _ in FAMILY),
    ("Zlib", ("zlib-warranty", "zlib-liability", "zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice")),
    ("Zlib", ("zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice")),
    ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("boost-grant", "boost-notice")),
    ("BSL-1.0", ("boost-grant",)),
    ("ISC", ("isc-grant",)),
    ("MPL-2.0", ("mpl-notice",)),
    ("Unlicense", ("public-domain",)),
    ("Proprietary", ("rights",)),
)

#: The licence of reserved rights.
RESERVED = "Proprietary"

_BREAK = re.compile(r"[.!?;:]+(?=\s|$)|[\r\n]+")
_OTHER = re.compile(r"[^a-z0-9]+")
_CLOSING = re.compile(r"[.!?]|\n[^\n]*\n|\r[^\r\n]*\r")
_ENUMERATION = re.compile(r"^(?:[0-9]{1,2}|[a-h]) (?=[a-z]{3})")


def normalise(sentence: str) -> str:
    """Lower-case ASCII words; a list number or letter in front goes."""
    return _ENUMERATION.sub("", _words(sentence))


def _words(piece: str) -> str:
    return _OTHER.sub(" ", piece.lower()).strip()


#: Sentences within which another licence takes the reserved rights away.
NEAR = 5
_TAG = "spdx license identifier"


@cache
def known_sentences() -> dict[str, str]:
    """Normalised sentence to identifier; notices are made from openings, an optional article and names."""
    out = {text: name for name, text in TEXT_SENTENCES.items()} | VARIANTS
    for thing in SUBJECTS:
        out[f"this {thing} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"] = "warranty"
        for licence, family, version in FAMILY:
            out[f"you should have received a copy of the gnu {family} public license along with this {thing}"] = "copy"
            for later in LATER:
                out[f"this {thing} is free software you can redistribute it and or modify it under the terms of the gnu {family} public license as published by the free software foundation either version {version} of the license{later}"] = f"free:{licence}"
                out[f"this {thing} is free software you can redistribute it and or modify it under the terms of the gnu {family} public license version {version} as published by the free software foundation{later}"] = f"free:{licence}"
    for opening in OPENINGS:
        for licence, name in [*LICENCE_NAMES.items(), *((v, k) for k, v in OTHER_NAMES.items())]:
            for article in ("", "the ", "the terms of the ", "a "):
                for tail in TAILS if "licen" in name else (*TAILS, " license", " licence"):
                    out[f"{opening} {article}{name}{tail}"] = f"ref:{licence}"
    for licence in LICENCE_NAMES:
        for tail in SPDX_TAILS if "GPL" in licence else ("",):
            out[f"{_TAG} " + _OTHER.sub(" ", licence.lower()) + tail] = f"ref:{licence}"
    return out


@cache
def _tag_ids() -> dict[str, str]:
    return {_OTHER.sub(" ", licence.lower()): licence for licence in LICENCE_NAMES}


def tagged(words: str) -> list[str]:
    """Licences of an SPDX expression in normalised words, in order; none if it does not begin with one.

    Licences are joined by "and" and "or" and may be followed by "only", "or
    later" and "with" an exception; what comes after the expression is left out.
    """
    left, out = words.split(), []
    while left:
        size = next((k for k in range(min(5, len(left)), 0, -1) if " ".join(left[:k]) in _tag_ids()), 0)
        if not size:
            break
        out.append(_tag_ids()[" ".join(left[:size])])
        left = left[size:]
        if left[:1] == ["only"]:
            left = left[1:]
        elif left[:2] == ["or", "later"]:
            left = left[2:]
        if left[:1] == ["with"]:
            end = next((k for k, w in enumerate(left) if w in ("and", "or")), len(left))
            left = left[end:]
        if left[:1] not in (["and"], ["or"]):
            break
        left = left[1:]
    return list(dict.fromkeys(out))


def identifiers(sentence: str) -> list[str]:
    """Identifiers of a normalised sentence: one if it is known, several for a tag that names several licences."""
    if name := known_sentences().get(sentence):
        return [name]
    return [f"ref:{x}" for x in tagged(sentence.removeprefix(_TAG + " "))] if sentence.startswith(_TAG + " ") else []


@cache
def known_beginnings() -> frozenset[str]:
    """The first words of each known sentence, one more at a time."""
    return frozenset(" ".join(words[:k]) for words in map(str.split, known_sentences()) for k in range(1, len(words) + 1))


def ordered_rules() -> list[tuple[str, tuple[str, ...]]]:
    """Longest first, then in the order given; a single reference to a licence comes last."""
    rules = [*TEXT_RULES, *((name, (f"ref:{name}",)) for name in LICENCE_NAMES)]
    return sorted(rules, key=lambda r: -len(r[1]))


def _pieces(text: str) -> list[list]:
    """[start, end, words, whether a sentence ends here] of each piece that has a word; code points."""
    out, at, after = [], 0, ""
    for m in _BREAK.finditer(text):
        own = m[0]
        if words := _words(text[at : m.start()]):
            out.append([at, m.end(), words, bool(_CLOSING.search(own))])
        elif out and _CLOSING.search(after + own):
            out[-1][3] = True
        after = "\n" if own[-1] in "\r\n" else ""
        at = m.end()
    if words := _words(text[at:]):
        out.append([at, len(text), words, True])
    return out


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, normalised) of each sentence that has a word; code points."""
    known, beginnings = known_sentences(), known_beginnings()
    pieces, out, unknown, k = _pieces(text), [], [], 0

    def close():
        if unknown:
            out.append((unknown[0][0], unknown[-1][1], normalise(" ".join(p[2] for p in unknown))))
            unknown.clear()

    while k < len(pieces):
        key, found, last = _ENUMERATION.sub("", pieces[k][2]), None, k
        if key == _TAG and k + 1 < len(pieces) and tagged(pieces[k + 1][2]):
            close()
            out.append((pieces[k][0], pieces[k + 1][1], f"{key} {pieces[k + 1][2]}"))
            k += 2
            continue
        while key in beginnings:
            if key in known:
                found = (last, key)
            last += 1
            if last == len(pieces):
                break
            key += " " + pieces[last][2]
        if found:
            close()
            out.append((pieces[k][0], pieces[found[0]][1], found[1]))
            k = found[0] + 1
            continue
        unknown.append(pieces[k])
        if pieces[k][3]:
            close()
        k += 1
    close()
    return out


def match_rules(ids: list[tuple[int, str]], rules, gap: int = GAP) -> list[tuple[str, int, int]]:
    """(licence, first, last) over (sentence number, identifier); every sentence serves one match."""
    by_first: dict[str, list] = {}
    for licence, sequence in rules:
        by_first.setdefault(sequence[0], []).append((licence, sequence))
    out, at = [], 0
    while at < len(ids):
        for licence, sequence in by_first.get(ids[at][1], ()):
            last = at
            for want in sequence[1:]:
                nxt = last + 1
                if nxt >= len(ids) or ids[nxt][1] != want or ids[nxt][0] - ids[last][0] > gap + 1:
                    break
                last = nxt
            else:
                out.append((licence, ids[at][0], ids[last][0]))
                at = last
                break
        at += 1
    near = lambda a, b: any(x[0] != RESERVED and x[1] - NEAR <= b and x[2] + NEAR >= a for x in out)
    return [x for x in out if x[0] != RESERVED or not near(x[1], x[2])]


SPAN_TYPE = "array<struct<licence:string,start:int,end:int,sentences:int>>"


def _finder(gap: int):
    def run(batches):
        rules = ordered_rules()
        kind = pa.list_(pa.struct([("licence", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("sentences", pa.int32())]))
        for batch in batches:
            counts, hits, spans = [], [], []
            for text in batch.column(1).to_pylist():
                cut = sentences(text) if text else []
                ids = [(i, name) for i, (_, _, key) in enumerate(cut) for name in identifiers(key)]
                counts.append(len(cut)), hits.append(len({i for i, _ in ids}))
                spans.append([{"licence": n, "start": cut[a][0], "end": cut[b][1], "sentences": b - a + 1} for n, a, b in match_rules(ids, rules, gap)] if ids else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), pa.array(spans, kind)], names=["doc_id", "n_sentences", "n_known", "spans"])

    return run


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gap: int = GAP) -> DataFrame:
    """(doc_id, n_sentences, n_known, spans) for each document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_finder(gap), f"doc_id long, n_sentences long, n_known long, spans {SPAN_TYPE}")


def op9_licenses(spark, sf_dir: str) -> DataFrame:
    found = scan_licences(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_sentences", "n_known", F.array_join(F.array_sort(F.array_distinct("spans.licence")), ",").alias("licences"), F.size("spans").cast("long").alias("n_matches"))
