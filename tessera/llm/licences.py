"""Licence scans by sentence rules.

A text's words are normalised (lower case, punctuation gone) with marks where a
sentence or line begins. Known licence sentences are found where such marks
stand at both ends, whatever line breaks lie inside, and give a sequence of
identifiers. Rules are ordered, the more specific before the less: each is a
sequence of identifiers that must follow one another with at most ``MAX_GAP``
other sentences between; a sentence that one rule took serves no later one.

Cases: a null or empty text has no licence. A licence stated twice is reported
at each place. Very long texts are taken whole. Repeated rows are scanned once
each. Other columns are ignored, whatever their names. An empty table gives no
rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded, in_batches, table

MAX_GAP = 2

# Normalised licence sentences with their identifiers, and the rules over these.
SENTENCES = {
    "all-rights": "all rights reserved",
    "mit-named": "released under the mit license",
    "mit-named-2": "this project is licensed under the mit license",
    "mit-named-3": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability-named": "in no event shall * be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "apache-named": "licensed under the apache license version 2 0",
    "apache-header": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-unless": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl3-named": "this work is licensed under the gnu general public license version 3",
    "gpl3-named-2": "licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-endorse-named": "neither the name of * nor the names of * may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-endorse-alone": "the name of * may not be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-advertise": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "lgpl21-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "epl2-terms": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "mpl2-form": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc-by-nc-long": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by-long": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-long": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
}
RULES = (
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertise", "bsd-endorse")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertise", "bsd-endorse-named")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertise")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse-named")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse-alone")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability-named")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("ISC", ("isc-grant",)),
    ("Apache-2.0", ("apache-header", "apache-comply", "apache-copy", "apache-unless", "apache-see")),
    ("Apache-2.0", ("apache-header", "apache-comply", "apache-copy")),
    ("Apache-2.0", ("apache-header",)),
    ("Apache-2.0", ("apache-named",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-see")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope", "gpl-see")),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("LGPL-2.1-or-later", ("lgpl21-free",)),
    ("LGPL-3.0-or-later", ("lgpl3-free",)),
    ("AGPL-3.0-or-later", ("agpl3-free",)),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("Zlib", ("zlib-grant",)),
    ("EPL-2.0", ("epl2-terms",)),
    ("GPL-3.0-only", ("gpl3-named",)),
    ("GPL-3.0-only", ("gpl3-named-2",)),
    ("MPL-2.0", ("mpl2-form", "mpl2-copy")),
    ("MPL-2.0", ("mpl2-form",)),
    ("MIT", ("mit-named",)),
    ("MIT", ("mit-named-2",)),
    ("MIT", ("mit-named-3",)),
    ("Unlicense", ("unlicense",)),
    ("CC0-1.0", ("cc0",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-long",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-long",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC-BY-4.0", ("cc-by-long",)),
    ("all-rights-reserved", ("all-rights",)),
)
# How licences are called, after "the", and the statements that name one.
CALLED = {
    "MIT": ("mit license",), "ISC": ("isc license",), "Zlib": ("zlib license",), "Unlicense": ("unlicense",), "BSL-1.0": ("boost software license version 1 0",), "Artistic-2.0": ("artistic license 2 0",),
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0"), "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license 2 0"), "EPL-2.0": ("eclipse public license version 2 0", "eclipse public license 2 0"),
    "BSD-2-Clause": ("bsd 2 clause license", "2 clause bsd license"), "BSD-3-Clause": ("bsd 3 clause license", "3 clause bsd license"),
    "GPL-2.0-only": ("gnu general public license version 2",), "GPL-3.0-only": ("gnu general public license version 3",), "LGPL-2.1-only": ("gnu lesser general public license version 2 1",),
    "LGPL-3.0-only": ("gnu lesser general public license version 3",), "AGPL-3.0-only": ("gnu affero general public license version 3",),
}
NAMING = ("licensed under", "released under", "distributed under", "this project is licensed under", "this work is licensed under", "this software is licensed under", "this code is released under")
COMMONS = {"by": "attribution", "sa": "sharealike", "nc": "noncommercial", "nd": "noderivatives"}
COMMONS_KINDS = (("by",), ("by", "sa"), ("by", "nd"), ("by", "nc"), ("by", "nc", "sa"), ("by", "nc", "nd"))
COMMONS_VERSIONS = {"2.0": "generic", "2.5": "generic", "3.0": "unported", "4.0": "international"}


def _named() -> dict[str, str]:
    """Sentence to licence: each statement with each name, SPDX tags, and the Creative Commons family in short and long form."""
    out = {f"{start} the {name}": licence for start in NAMING for licence, names in CALLED.items() for name in names}
    tags = [*CALLED, *(x.replace("-only", "-or-later") for x in CALLED if x.endswith("-only"))]
    for kind in COMMONS_KINDS:
        for version, region in COMMONS_VERSIONS.items():
            licence, number = f"CC-{'-'.join(kind).upper()}-{version}", version.replace(".", " ")
            tags.append(licence)
            out |= {f"{start} cc {' '.join(kind)} {number}": licence for start in NAMING if "licen" in start}
            out[f"this work is licensed under a creative commons {' '.join(COMMONS[k] for k in kind)} {number} {region} license"] = licence
    return out | {f"spdx license identifier {re.sub('[^a-z0-9]+', ' ', t.lower())}": t for t in [*tags, "CC0-1.0"]}


# After the sentences above, so that these keep their names; a rule for each.
_KNOWN = set(SENTENCES.values())
_NAMED = {f"named {text}".replace(" ", "-"): (text, licence) for text, licence in _named().items() if text not in _KNOWN}
SENTENCES |= {name: text for name, (text, _) in _NAMED.items()}
RULES += tuple((licence, (name,)) for name, (_, licence) in _NAMED.items())
#: Every known sentence has one of these, so a text without any needs no further look.
#: Each is part of one word, as line breaks may stand between words.
ANCHORS = ("licen", "copyright", "reserved", "permission", "redistribut", "warrant", "mozilla", "domain", "mpl", "advertis", "liable")

#: A slot of a sentence, for the name of a holder or project, and the most words that it takes.
SLOT, MOST_WORDS = "*", 16
#: Licences that a further numbered clause makes another one, and how such a clause begins.
WHOLE = frozenset({"BSD-2-Clause", "BSD-3-Clause"})
_CLAUSE = re.compile(r"[3-5]\b")

_STRONG = re.compile(r"[.!?;:…]+(?=\s|$)|\n\s*")
_WORD = re.compile(r"[^\W_]+")


def words_and_marks(text: str) -> tuple[list[str], list[int], list[bool]]:
    """Normalised words, their offsets, and whether a sentence or line begins before each (and at the end)."""
    words, offsets, marks, at = [], [], [], 0
    cuts = [m.start() for m in _STRONG.finditer(text)]
    i, fresh = 0, True
    for m in _WORD.finditer(text):
        while i < len(cuts) and cuts[i] < m.start():
            fresh, i = fresh or cuts[i] >= at, i + 1
        words.append(m[0].lower())
        offsets.append(m.start())
        marks.append(fresh)
        fresh, at = False, m.end()
    return words, offsets, [*marks, True]


def anchors_of(sentences: dict[str, str]) -> tuple[str, ...]:
    """Parts of single words, one of which every text with any of the normalised sentences has."""
    out = set()
    for text in sentences.values():
        words = [w for w in text.split() if w.isascii()]
        known = [a for a in ANCHORS if any(a in w for w in words)]
        out.add(known[0] if known else max(words, key=len, default=""))
    return tuple(sorted(out))


def end_of(words: list[str], at: int, known: list[str]) -> int | None:
    """Where a known sentence that begins at ``at`` ends, slots taking as few words as they can; None where it isn't there."""
    ends = {at}
    for part, slot in _parts(known):
        if slot:
            ends = {j for e in ends for j in range(e + 1, min(e + MOST_WORDS, len(words)) + 1)}
        ends = {e + len(part) for e in ends if words[e : e + len(part)] == part}
        if not ends:
            return None
    return min(ends)


def _parts(known: list[str]) -> Iterator[tuple[list[str], bool]]:
    """The runs of words between a sentence's slots, and whether a slot stands before each."""
    run, slot = [], False
    for w in [*known, None]:
        if w is None or w == SLOT:
            yield run, slot
            run, slot = [], True
        else:
            run.append(w)


class Knowledge:
    """Sentences by their first words (slots come later), and ordered rules."""

    def __init__(self, sentences: dict[str, str] = SENTENCES, rules: tuple = RULES, max_gap: int = MAX_GAP):
        self.rules, self.max_gap = rules, max_gap
        self.first: dict[tuple[str, ...], list[tuple[list[str], str]]] = {}
        for name, text in sentences.items():
            words = text.split()
            self.first.setdefault(tuple(words[:3]), []).append((words, name))
        for known in self.first.values():
            known.sort(key=lambda k: -len(k[0]))

    def sentences(self, text: str) -> list[tuple[str | None, int]]:
        """(identifier, or None where unknown; offset) of each sentence in order; known ones may span lines."""
        words, offsets, marks = words_and_marks(text)
        out, i = [], 0
        while i < len(words):
            if marks[i]:
                ends = ((end_of(words, i, k), name) for k, name in self.first.get(tuple(words[i : i + 3]), ()))
                hit = next(((end, name) for end, name in ends if end is not None and marks[end]), None)
                out.append((hit[1] if hit else None, offsets[i]))
                if hit:
                    i = hit[0]
                    continue
            i += 1
        return out

    def licences(self, found: list[tuple[str | None, int]], text: str = "") -> list[tuple[str, int]]:
        """(licence, offset) of every match of a rule, by offset; rules are tried in order. With the ``text``, a rule of
        ``WHOLE`` is refused where a numbered clause that it does not have goes on after it."""

        def goes_on(last: int) -> bool:
            after = found[last + 1 : last + 3]
            return len(after) == 2 and after[0][0] is None and bool(_CLAUSE.match(text, after[0][1]))

        places: dict[str, list[int]] = {}
        for i, (name, _) in enumerate(found):
            if name:
                places.setdefault(name, []).append(i)
        taken, out = set(), []
        for licence, sequence in self.rules:
            for start in places.get(sequence[0], ()):
                run = [start]
                for name in sequence[1:]:
                    near = next((j for j in range(run[-1] + 1, min(len(found), run[-1] + 2 + self.max_gap)) if found[j][0] == name and j not in taken), None)
                    if near is None:
                        break
                    run.append(near)
                if len(run) == len(sequence) and not taken & set(run) and not (licence in WHOLE and goes_on(run[-1])):
                    taken |= set(run)
                    out.append((licence, found[start][1]))
        return sorted(out, key=lambda x: x[1])


@in_batches
def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] = SENTENCES, rules: tuple = RULES, anchors: tuple | None = None) -> DataFrame:
    """(doc_id, licences array<struct<name, start>>, sentence_ids array<string>); no shuffle.

    Texts without any of ``anchors``, by default those of ``sentences``, are not looked at."""
    anchors = anchors_of(sentences) if anchors is None else anchors
    kind = pa.list_(pa.struct([("name", pa.string()), ("start", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Knowledge(sentences, rules)
        for batch in bounded(batches, "text"):
            names, ids = [], []
            for text in batch.column("text").to_pylist():
                low = (text or "").lower()
                found = known.sentences(text) if text and any(a in low for a in anchors) else []
                names.append([{"name": n, "start": s} for n, s in known.licences(found, text or "")])
                ids.append([n for n, _ in found if n])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, kind), pa.array(ids, pa.list_(pa.string()))], names=["doc_id", "licences", "sentence_ids"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id long, licences array<struct<name:string,start:long>>, sentence_ids array<string>")


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licences with their places, and its known sentences in order."""
    found = scan(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("licences", lambda x: F.concat_ws(":", x["name"], x["start"].cast("string"))), ",")
    return found.select("doc_id", spans.alias("licences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.size("licences").cast("long").alias("n_licences"))
