"""Canonical licence texts as they stand in files: wrapped, commented, numbered."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from barlake.llm import licenses

MIT = """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE FOR ANY CLAIM."""
BSD_3 = """Copyright (c) 2020, Somebody

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER BE LIABLE."""
BSD_2 = re.sub(r"3\. Neither.*?permission\.\n\n", "", BSD_3, flags=re.S)
GPL_3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0"""
CANONICAL = {"MIT": MIT, "BSD-3-Clause": BSD_3, "BSD-2-Clause": BSD_2, "GPL-3.0-or-later": GPL_3, "Apache-2.0": APACHE}


def commented(sign):
    return lambda text: "\n".join(f"{sign} {line}".rstrip() for line in text.split("\n"))


FORMS = {
    "wrapped": lambda text: text,
    "crlf": lambda text: text.replace("\n", "\r\n"),
    "unwrapped": lambda text: re.sub(r"(?<!\n)\n *(?!\n)", " ", text),
    "narrow": lambda text: re.sub(r"(?<=\w) (?=\w{4})", "\n", text),
    "bulleted": lambda text: re.sub(r"(?m)^\d\. ", "* ", text),
    "lettered": lambda text: re.sub(r"(?m)^(\d)\. ", lambda m: f"({'abc'[int(m[1]) - 1]}) ", text),
    "block comment": lambda text: "/*\n" + commented(" *")(text) + "\n */",
    **{sign: commented(sign) for sign in ("#", "//", "--", ";;", "!", "%", "REM")},
}


@pytest.mark.parametrize("form", FORMS)
def test_canonical_texts(make_docs, form):
    names = sorted(CANONICAL)
    docs = make_docs([(k, f"Some words before.\n\n{FORMS[form](CANONICAL[n])}\n\nAnd after.") for k, n in enumerate(names)])
    assert {names[r.doc_id]: r.licenses for r in licenses.scan(docs).collect()} == {n: n for n in names}


def test_full_rules(make_docs):
    docs = make_docs([(k, t) for k, t in enumerate((BSD_3, GPL_3, APACHE))])
    ids = {r.doc_id: r.sentence_ids for r in licenses.scan(docs).collect()}
    assert "<bsd_source><bsd_binary><bsd_names><bsd_as_is>" in ids[0]
    assert ids[1] == "<gpl3_grant><gpl_warranty><gpl_details>"
    assert ids[2].startswith("<apache2_notice><apache_comply><apache_copy>")


def test_sentences_that_do_not_join(make_docs):
    texts = [
        "The\nMIT License\nAll rights\nreserved.\nEnd",  # notices on lines of their own, one of them wrapped
        "MIT\n\nLicense",  # an empty line parts
        "MIT.\nLicense",  # so does the end of a sentence
        "1. First\n2. MIT Licensed",  # markers of unknown sentences stay, whole words only
        "~MIT License% x",
        "MIT License\n% MIT License.% MIT License",
        "MIT\nLicense MIT",
        "A.\nAll rights reserved.",  # a line of its own is no marker
        "A. All rights reserved.",
    ]
    found = {r.doc_id: tuple(r)[1:] for r in licenses.scan(make_docs(list(enumerate(texts)))).collect()}
    assert found == {
        0: (4, 2, "|<mit_title><all_rights>|", "MIT,All-Rights-Reserved"),
        1: (2, 0, "|", ""),
        2: (2, 0, "|", ""),
        3: (4, 0, "|", ""),
        4: (1, 0, "|", ""),
        5: (2, 1, "<mit_title>|", "MIT"),
        6: (2, 0, "|", ""),
        7: (2, 1, "|<all_rights>", "All-Rights-Reserved"),
        8: (1, 1, "<all_rights>", "All-Rights-Reserved"),
    }


def test_long_runs_and_lines(make_docs):
    """Long runs without words and long texts without sentence ends take linear time."""
    runs = [" " * 200_000, "-.;)" * 50_000, "\n" * 200_000, "; " * 100_000, "中" * 200_000, "mit\n" * 50_000, "a " * 100_000]
    docs = make_docs([(k, f"MIT License\n{r}\nMIT License") for k, r in enumerate(runs)])
    assert [r.licenses for r in licenses.scan(docs).collect()] == ["MIT"] * len(runs)


# Ends, markers and signs in all orders; the words are in no known sentence.
COUNTED = [
    "One. Two! Three? Four; five.six", "a.\tb;\tc", "a;b", "1. one\n2. two", "A. b", "# 1. x; y", "(a) z. ; . q", "rem a\nrem b",
    "a\r\nb\rc\n\n\nd", "...\n . ; ! ", "", " ", None, "1. . ! a. ", ". a", "\u2028a\u2028b", "\u4e2d\u6587. \u4e2d", "x. \u4e2d. y",
    "%~&. a%b~c&d", "ii. x\n- iii. y", "q.\u00a0r. ", "12345. x", "1.\tx. 2.\ty", "a!? b", "; a", "a ;", "\u212aeep. \u0130n", "a;\r\n;b",
]


def test_texts_without_words_of_licences_are_only_counted(make_docs, monkeypatch):
    """Same rows as by the steps for all texts, which such a text does not reach."""
    rows = list(enumerate(COUNTED + ["License", "MIT LICENSE", "All rights\nReserved", "January. " * 3]))
    found = lambda: [tuple(r) for r in licenses.scan(make_docs(rows)).orderBy("doc_id").collect()]
    short = found()
    monkeypatch.setattr(licenses, "_anchors", lambda known: [""])
    assert short == found()
    assert [r[4] for r in short[len(COUNTED) :]] == ["", "MIT", "All-Rights-Reserved", ""]
    monkeypatch.undo()
    monkeypatch.setattr(licenses, "sentences", lambda text: F.raise_error(text).cast("string"))
    plain = licenses.scan(make_docs(list(enumerate(COUNTED))))
    assert [tuple(r) for r in plain.orderBy("doc_id").collect()] == short[: len(COUNTED)]


def test_every_known_sentence_holds_an_anchor():
    chosen = licenses._anchors(licenses.SENTENCES)
    assert len(chosen) < 8 and min(map(len, chosen)) > 6
    assert all(any(w in s for w in chosen) for s in licenses.SENTENCES)
