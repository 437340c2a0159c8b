"""Alignment of two token streams against a plain walk over the bytes."""

from __future__ import annotations

import hashlib
from collections import Counter
from functools import cache

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barlake.llm import alignment, vocabularies

PATHS = public_tokenizers.path(alignment.A_VOCABULARY), public_tokenizers.path(alignment.B_VOCABULARY)
ODD = [
    None, "", " ", "a", "  two  blanks ", "<|endoftext|> </s> <unk> <0x41>", "naïve café 你好 \U0001f600 é ﬁ", "tab\tand\n\nlines \r\n",
    "x" * 3000, "a▁b", "　wide", "zero​width", "0123 4567", "don't we'll",
]


@cache
def libraries():
    own = Tokenizer.from_file(PATHS[0])
    own.encode_special_tokens = True
    letters = vocabularies.byte_letters()
    names = {v: bytes(letters[c] for c in k) for k, v in own.get_vocab().items() if set(k) <= set(letters)}
    pieces = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    return own, names, pieces


def plain(text):
    """Ids of both sides, groups and links by walking over spans."""
    own, names, pieces = libraries()
    if not text:
        return [], [], [], []
    a, b = own.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
    a_raw = [names[i] for i in a]
    b_raw = [
        bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b
    ]
    if not b"".join(a_raw) == b"".join(b_raw) == (" " + text).encode():
        return [], [], [], []
    spans = [(lambda e: list(zip([0, *e[:-1]], e, strict=True)))(np.cumsum([len(r) for r in raw]).tolist()) for raw in (a_raw, b_raw)]
    links, first = [], 0
    for i, (start, end) in enumerate(spans[0]):
        while spans[1][first][1] <= start:
            first += 1
        j = first
        while j < len(b) and spans[1][j][0] < end:
            links.append((a[i], b[j]))
            j += 1
    groups, at = [], [0, 0]
    for end in sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}):
        sides = []
        for k, ids in enumerate((a, b)):
            stop = at[k]
            while stop < len(ids) and spans[k][stop][1] <= end:
                stop += 1
            sides.append(ids[at[k] : stop])
            at[k] = stop
        groups.append(tuple(sides))
    return a, b, groups, links


def expected(texts):
    made = [(i, *plain(t)) for i, t in texts]
    counts = Counter(link for *_, links in made for link in links)
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    rows = []
    for doc_id, a, b, groups, links in made:
        line = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        digest = hashlib.sha256(line.encode()).hexdigest() if a else ""
        best = sum(counts[link] == top[link[1]] for link in links)
        rows.append((doc_id, len(a), len(b), len(groups), len(links), best, sum(counts[link] for link in links), digest))
    return rows


def listed(df):
    key = lambda t: tuple((x is None, x) for x in t)
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=key)


def same(df, texts):
    key = lambda t: tuple((x is None, x) for x in t)
    assert listed(df) == sorted(expected(texts), key=key)


def test_odd_texts(spark, make_docs):
    texts = [*enumerate(ODD), (3, "a"), (3, "a"), (None, "no id"), (None, None)]
    docs = make_docs(texts).withColumns({c: F.lit(1) for c in ("unit", "pair", "n_a", "place")})
    same(alignment.align(docs, *PATHS), texts)
    assert alignment.align(make_docs([]), *PATHS).count() == 0


def test_small_steps_units_and_parts(spark, make_docs, monkeypatch):
    """Parts of some characters, steps and units of some bytes: the rows stay the same."""
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 6000")
    texts = [*enumerate(ODD), *[(100 + r.doc_id, r.text) for r in documents.limit(60).collect()]]
    monkeypatch.setattr(alignment, "PART", 40)
    monkeypatch.setattr(alignment, "STEP_BYTES", 700)
    monkeypatch.setattr(alignment, "UNIT_BYTES", 5000)
    same(alignment.align(make_docs(texts).repartition(3), *PATHS), texts)


@pytest.mark.parametrize("text", ["one two  three   four", "x " * 50, " lead and trail ", "a\nb c\td e", "déjà vu 你 好 吗"])
def test_parts_are_encoded_like_the_whole(text, monkeypatch):
    whole = plain(text)
    monkeypatch.setattr(alignment, "PART", 3)
    a, b = alignment.tokens_of(text, *PATHS)
    assert (a.tolist(), b.tolist()) == (whole[0], whole[1])


def test_groups(spark, make_docs):
    texts = list(enumerate(ODD))
    got = {r.doc_id: [(g.a, g.b) for g in r.groups] for r in alignment.groups(make_docs(texts), *PATHS).collect()}
    assert got == {i: [(list(a), list(b)) for a, b in plain(t)[2]] for i, t in texts}


def test_registered_query(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    same(entry.queries()["op12_cross_tokenizer_alignment"](spark, sf), texts)
