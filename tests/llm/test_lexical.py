"""Ranked search against scoring every document for every item."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from barlake.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def plain(texts, items, top=50):
    """Item by item, document by document."""
    counted = [(i, Counter(terms(t))) for i, t in texts]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for doc_id, c in counted:
            m = 100 - 50 + (50 * c.total() * n_docs) // n_terms
            total = 0
            for term in set(terms(text)) & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                total += w * ((1000000000 * c[term]) // (1000 * c[term] + 20 * m))
            if total > 0:
                scores.append((-total, doc_id is not None, doc_id or 0))
        out += [(item, r, d if known else None, -s) for r, (s, known, d) in enumerate(sorted(scores)[:top], 1)]
    return out


def same(found, want):
    key = lambda t: tuple((x is None, x) for x in t)
    assert sorted(map(tuple, found.select("item_id", "rank", "doc_id", "score").collect()), key=key) == sorted(want, key=key)


WORDS = ["alpha", "Beta", "gamma", "DELTA", "éclair", "中文", "x1", "42", "the", "of", "rare-one", "straße", "İstanbul"]


def made_texts(n):
    import random

    rng = random.Random(n)
    weights = [1 / (k + 1) for k in range(len(WORDS))]
    texts = [(i, " ".join(rng.choices(WORDS, weights, k=rng.randint(1, 60)))) for i in range(n)]
    # Copies tie; a hot text makes up a third of all rows.
    return texts + [(n + i, texts[0][1]) for i in range(n // 3)] + [(2 * n + i, texts[i][1] + " zebra") for i in range(5)]


@pytest.mark.parametrize("top", [3, 50])
def test_equals_scoring_everything(spark, make_docs, monkeypatch, top):
    """Small units, bundles, passes and stages at every share of documents."""
    monkeypatch.setattr(lexical, "UNIT_ROWS", 17)
    texts = made_texts(150)
    items = [(1, "alpha beta rare one"), (2, "ÉCLAIR 中文 中文"), (3, "nothing known"), (4, "the of of THE"), (5, "zebra straße x1 42"), (6, "İstanbul")]
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    same(lexical.search(make_docs(texts).repartition(4), asked, top, bundle=2, terms=4), plain(texts, items, top))


def test_pruning_takes_place_and_changes_nothing(spark, make_docs, monkeypatch):
    """With stages that split the terms, tables of later stages hold fewer documents than match."""
    monkeypatch.setattr(lexical, "SHARES", (0.05, 0.2, 0.5))
    texts = made_texts(300)
    items = [(1, "zebra the of alpha beta gamma"), (2, "rare one the alpha")]
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    same(lexical.search(make_docs(texts), asked, 2), plain(texts, items, 2))


def test_odd_rows(spark, make_docs):
    texts = [
        (1, None), (2, ""), (3, " .,;- "), (4, "one two"), (4, "one two"), (4, "two two"), (None, "one"), (None, None), (-1, "one"),
        (5, "long " * 200000 + "one"), (6, "ONE\x7fone\x00one"),
    ]
    items = [(7, "one two"), (7, "one two"), (7, "two"), (None, "one"), (8, None), (9, ""), (10, "long")]
    docs = make_docs(texts).withColumns({c: F.lit("x") for c in ("unit", "term", "score", "rank", "item", "bundle")})
    asked = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(3))
    same(lexical.search(docs, asked), plain(texts, items))


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "one")], "item_id bigint, text string")
    assert lexical.search(make_docs([]), some).count() == 0
    assert lexical.search(make_docs([(1, "one")]), none).count() == 0
    assert lexical.search(make_docs([(1, None)]), some).count() == 0


def test_registered_query(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    read = lambda name, *c: [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(*c).collect()]
    want = plain(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"))
    same(entry.queries()["op13_ranked_lexical_search"](spark, sf), want)
