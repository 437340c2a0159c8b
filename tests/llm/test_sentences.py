"""Passages inside longer lines: sentences against a plain search."""

from __future__ import annotations

import hashlib
import random
import re

from barlake.llm import paragraphs


def plain_sentences(text):
    """(start, end, words) of sentences of five words or more in lines with 60 blanks or more, by characters."""
    out, at = [], 0
    for line in re.split("[\r\n]", text):
        if line.count(" ") >= 60:
            start = 0
            for i in range(len(line)):
                last = i == len(line) - 1
                if last or (line[i] in " \t" and i and line[i - 1] in ".!?"):
                    words = line[start : i + 1].lower().split()
                    if len(words) >= 5:
                        out.append((at + start, at + i + 1, tuple(words)))
                    start = i + 1
        at += len(line) + 1
    return out


def made_texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefg", k=6))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(2, 14))) + rng.choice(".!?")
    passage = " ".join(sentence() for _ in range(9))
    texts = []
    for i in range(12):
        lines = [" ".join(sentence() for _ in range(12)) for _ in range(3)]
        if i % 2:
            lines[i % 3] += (" " + passage.upper() if i == 5 else " " + passage) + " " + sentence()
        texts.append((i, "\n".join(lines)))
    return texts, passage


def test_copied_passages_go_but_for_the_first_document(spark, make_docs):
    texts, passage = made_texts()
    found = {r.doc_id: r for r in paragraphs.remove_near_duplicates(make_docs(texts)).collect()}
    first = {}
    for i, text in texts:
        for _, _, words in plain_sentences(text):
            first.setdefault(words, i)
    for i, text in texts:
        kept, at, spans = "", 0, 0
        for start, end, words in plain_sentences(text):
            if first[words] < i:
                spans += start > at or not at
                kept, at = kept + text[at:start], end
        kept += text[at:]
        r = found[i]
        assert (r.text, r.n_removed, r.n_spans) == (kept, len(text) - len(kept), spans)
        assert r.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    # The first copy stays; of each other one most of the passage goes.
    assert found[1].n_removed == 0 and all(found[i].n_removed > 0.8 * len(passage) for i in (3, 5, 7, 9, 11))
    assert all(found[i].n_removed == 0 for i in range(0, 12, 2))


def test_ids_that_are_null_or_equal(spark, make_docs):
    """Null ids come last; rows with equal ids never cut each other's sentences."""
    text = " ".join(f"w{i}" for i in range(70)) + ". A sentence that all of them hold in the end. Tail {}."
    lines = [text.replace("w", c).format(c) for c in "abcd"]
    rows = [(None, lines[0]), (7, lines[1]), (7, lines[2]), (None, lines[3]), (8, None)]
    found = paragraphs.remove_near_duplicates(make_docs(rows)).collect()
    size = len("A sentence that all of them hold in the end. ")
    assert sorted((r.doc_id or 0, r.n_removed, r.kept_in) for r in found) == [
        (0, size, [7]), (0, size, [7]), (7, 0, []), (7, 0, []), (8, 0, []),
    ]
