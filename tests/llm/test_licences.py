import re

import pytest

from tessera.llm import licences as L

K = L.Knowledge()
MIT = """Copyright (c) 2020 Someone

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
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. More words follow here."""


def names(text):
    return [n for n, _ in K.licences(K.sentences(text))]


def test_whole_licence_across_lines():
    assert names(MIT) == ["MIT"]
    assert [n for n, _ in K.sentences(MIT) if n] == ["mit-grant", "mit-notice", "mit-warranty"]
    assert names("Some heading\nReleased under the MIT License.\nand more") == ["MIT"]


def test_families_of_names():
    assert names("SPDX-License-Identifier: LGPL-2.1-or-later\n") == ["LGPL-2.1-or-later"] and names("// SPDX-License-Identifier: MIT") == ["MIT"]
    assert names("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License.") == ["CC-BY-NC-SA-3.0"]
    assert names("Distributed under the Boost Software License, Version 1.0.\nThis code is released under the GNU Affero General Public License, version 3.") == ["BSL-1.0", "AGPL-3.0-only"]
    assert names("Licensed under CC BY-ND 2.5. Licensed under CC BY 2.5.") == ["CC-BY-ND-2.5", "CC-BY-2.5"]
    assert names("This software is provided 'as-is', without any express or implied\nwarranty. In no event so. Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:") == ["Zlib"]
    assert len(set(L.SENTENCES.values())) == len(L.SENTENCES) > 250


def test_rules_are_ordered_and_need_their_order():
    bsd = [L.SENTENCES[k].capitalize() + "." for k in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")]
    assert names(" ".join(bsd)) == ["BSD-3-Clause"]
    assert names(" ".join(bsd[:3])) == ["BSD-2-Clause"]
    assert names(" ".join(bsd[::-1])) == []
    assert names(" ".join([bsd[0], "One. Two.", *bsd[1:3]])) == ["BSD-2-Clause"]
    assert names(" ".join([bsd[0], "One. Two. Three.", *bsd[1:3]])) == []
    assert names("Licensed under CC BY 4.0. Licensed under CC BY-NC 4.0. Licensed under CC BY 4.0.") == ["CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-4.0"]


def test_only_whole_sentences_count():
    assert names("We are not released under the MIT License.") == []
    assert names("Released under the MIT License terms.") == []
    assert names("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.") == ["Apache-2.0"]
    assert names("") == [] and names("...\n\n") == []


def test_anchors_cover_every_sentence():
    assert all(any(a in s for a in L.ANCHORS) or k.startswith("cc") for k, s in L.SENTENCES.items())
    assert all(any(a in s for a in L.ANCHORS) for s in L.SENTENCES.values())
    assert {i for _, seq in L.RULES for i in seq} == set(L.SENTENCES)


def test_anchors_hold_across_line_breaks_and_for_other_sentences(docs):
    """Each sentence alone, wrapped at every word in several ways."""
    names = list(L.SENTENCES)
    for gap in ("\n", "  ", "\n\t", " - "):
        rows = {r.doc_id: r.sentence_ids for r in L.scan(docs(["Text. " + gap.join(L.SENTENCES[k].replace("*", "x corp").upper().split()) + "." for k in names])).collect()}
        assert [rows[i] for i in range(len(names))] == [[k] for k in names]
    assert L.scan(docs(["All rights\nreserved."])).first().licences[0].name == "all-rights-reserved"
    own, rules = {"own": "use it as you like", "greek": "ελεύθερη χρήση"}, (("Own", ("own",)), ("Greek", ("greek",)))
    rows = {r.doc_id: [x.name for x in r.licences] for r in L.scan(docs(["Use it\nas you LIKE!", "Ελεύθερη\nχρήση", None, "x"]), sentences=own, rules=rules).collect()}
    assert rows == {0: ["Own"], 1: ["Greek"], 2: [], 3: []}


def test_query_against_brute_force(spark, sf):
    """Short licence sentences of the documents are single lines."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    single = {seq[0]: n for n, seq in L.RULES if len(seq) == 1}
    rows = L.op7_licences(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want, at = [], 0
        for line in texts[r.doc_id].split("\n"):
            flat = " ".join(re.findall(r"[^\W_]+", line.lower()))
            want += [f"{single[k]}:{at + len(line) - len(line.lstrip())}" for k, s in L.SENTENCES.items() if s == flat and k in single]
            at += len(line) + 1
        assert r.licences == ",".join(want), r.doc_id
    assert sum(r.n_licences for r in rows) > 0


def test_odd_rows(docs):
    texts = [None, "", MIT * 3, "x " * 100_000 + "\nAll rights reserved.", "All rights reserved.", "All rights reserved."]
    rows = {r.doc_id: r for r in L.scan(docs(texts)).collect()}
    assert [[x.name for x in rows[i].licences] for i in range(6)] == [[], [], ["MIT"] * 3, ["all-rights-reserved"], ["all-rights-reserved"], ["all-rights-reserved"]]
    assert rows[3].licences[0].start == 200_001 and L.scan(docs(["a"]).where("false")).count() == 0


BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
)
ENDORSE = "may be used to endorse or promote products derived from this software without specific prior written permission.\n"


def _of(text):
    known = L.Knowledge()
    return [n for n, _ in known.licences(known.sentences(text), text)]


@pytest.mark.parametrize(
    ("third", "licence"),
    [
        ("", ["BSD-2-Clause"]),
        ("THIS SOFTWARE IS PROVIDED BY SOMEONE AS IS.\n", ["BSD-2-Clause"]),
        ("3. Neither the name of the copyright holder nor the names of its contributors " + ENDORSE, ["BSD-3-Clause"]),
        ("3. Neither the name of Example Inc. nor the names of its contributors " + ENDORSE, ["BSD-3-Clause"]),
        ("* Neither the name of the University of Example,\n  Department of Names, nor the names of other contributors " + ENDORSE, ["BSD-3-Clause"]),
        ("3. The name of J. Doe may not" + ENDORSE[3:], ["BSD-3-Clause"]),
        ("3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software.\n4. Neither the name of Ex nor the names of its contributors " + ENDORSE, ["BSD-4-Clause"]),
        ("3. You must send us a postcard.\n", []),
        ("3. Neither the name of Example Inc. nor the names of its contributors " + ENDORSE + "4. You must send us a postcard.\n", []),
    ],
)
def test_clauses_after_the_second(third, licence):
    assert _of(BSD + third) == licence


def test_slots_take_names_and_no_more():
    words = "neither the name of a b c nor the names of d may be x".split()
    known = "neither the name of * nor the names of * may be x".split()
    assert L.end_of(words, 0, known) == len(words)
    assert L.end_of(words, 0, known[:-1] + ["y"]) is None and L.end_of(words[:4] + words[7:], 0, known) is None
    assert L.end_of("a b c".split() + ["z"] * 17 + ["d"], 0, "a b c * d".split()) is None
