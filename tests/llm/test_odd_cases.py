"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pytest
import zstandard as zstd
from pyspark.sql import functions as F

from barlake.llm import bpe, decontaminate, licenses, paragraphs, resample, simhash, suffixes, topk, toxicity, warc
from barlake.llm.components import components
from barlake.llm.shared import Scratch

LONG = " ".join(f"word{i % 977} other{i % 1013}" for i in range(120_000))
SHARED = "the quick brown fox jumps over the lazy dog and runs away from the hunters in the wood"
ROWS = [
    (1, SHARED + " first"), (2, SHARED + " first"), (2, SHARED + " first"), (3, None), (4, ""), (None, SHARED),
    (None, None), (5, LONG), (6, "x" * 49), (7, "Ünïcode é " * 20), (8, " \t\n "),
]
PATH = public_tokenizers.path(bpe.RANKS)


@pytest.fixture()
def odd(make_docs):
    return make_docs(ROWS, "concat('key ', lang) AS row_key").selectExpr("*", "1L AS fp", "2L AS n_bytes")


@pytest.fixture()
def none(make_docs):
    return make_docs([])


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 3), (None, 1), (5, 4), (7, 3)], "a bigint, b bigint")
    found = components(links, Scratch(spark, "t"))
    assert sorted_rows(found) == [(3, 3), (4, 3), (5, 3), (7, 3), (8, 8), (9, 8)]
    chain = spark.range(200).selectExpr("id AS a", "id + 1 AS b")
    assert components(chain, Scratch(spark, "t")).select(F.countDistinct("root"), F.count("*")).first()[:] == (1, 201)


def test_licenses(spark, make_docs, odd, none):
    mit = (
        "MIT License\n\nThe above copyright notice and this permission notice shall be included in all copies or"
        " substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS"
        " OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE"
        " AND NONINFRINGEMENT."
    )
    docs = make_docs([(1, mit), (2, "Some text. Released under the MIT License. Licensed under CC BY-NC 4.0."), (3, None)])
    found = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert (found[1].licenses, found[1].sentence_ids) == ("MIT", "<mit_title><mit_notice_kept><mit_as_is>")
    assert found[2].licenses == "CC-BY-NC-4.0,MIT"
    assert (found[3].licenses, found[3].n_sentences) == ("", 0)
    assert licenses.scan(odd).count() == len(ROWS) and licenses.scan(none).count() == 0
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_paragraphs(odd, none):
    found = paragraphs.remove_near_duplicates(odd).collect()
    assert len(found) == len(ROWS)
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    assert by_id[1].n_removed == 0 and by_id[2].text == "" and by_id[2].kept_in == [1]
    assert [r.n_removed_paragraphs for r in found if r.doc_id is None] in ([0, 1], [1, 0])
    assert by_id[5].n_removed == 0 and by_id[3].n_bytes == 0
    assert paragraphs.remove_near_duplicates(none).count() == 0


def test_large_buckets_are_split(spark, monkeypatch):
    """A hot bucket in blocks finds the same links as one group."""
    monkeypatch.setattr(paragraphs, "GROUP", 8)
    base = [f"w{i}" for i in range(40)]
    texts = [" ".join([*base, *(f"x{n}" for n in range(k % 7)), f"end{k}"]) for k in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    found = paragraphs.remove_near_duplicates(docs).collect()
    assert sum(r.n_removed_paragraphs for r in found) == 49


def test_resampling(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (None, 1, 1), (4, None, 0)], "doc_id bigint, quality int, toxic int")
    assert resample.resampled(odd, labels, 0.5).count() == len(ROWS)
    assert resample.resampled(none, labels).count() == 0
    every = resample.resampled(odd, labels.limit(0))
    assert [r.selected for r in every.collect()] == [True] * len(ROWS)
    values = spark.createDataFrame([(float(v),) for v in [3, 3, 3, 1, 2, -5, 1e9]], "key double")
    assert [resample.kth_largest(values, k) for k in (1, 2, 4, 5, 6, 7)] == [1e9, 3, 3, 2, 1, -5]


def test_top_k(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in range(60)] + [(100, None), (101, [None, 1.0]), (102, [float("nan"), 1.0])]
    rows += [(None, [1.0, 1.0]), (103, [1.0]), (104, [float("inf"), 1.0]), (7, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    found = topk.top_k(vectors, vectors.where("vec_id IN (1, 2, 103)"), 3).collect()
    by_query = {q: [(r.rank, r.vec_id, r.score) for r in found if r.query_id == q] for q in (1, 2, 103)}
    best = 64 * 64 * 2 + 64 * 64
    assert sorted(by_query[1]) == [(1, 2, best), (2, 5, best), (3, 8, best)]
    assert [v for _, v, _ in sorted(by_query[2])] == [5, 8, 11] and by_query[103] == []
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_top_k_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "VECTOR_BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(1)
    data = rng.normal(size=(500, 40)).astype("float32")
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id bigint, embedding array<float>")
    found = topk.top_k(vectors, vectors.where("vec_id % 20 = 0")).collect()
    whole = np.floor(64 * data.astype(float)).astype(int)
    for q in range(0, 500, 20):
        scores = whole @ whole[q]
        order = [i for i in sorted(range(500), key=lambda i: (-scores[i], i)) if i != q][:20]
        own = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        assert own == [(k + 1, i, scores[i]) for k, i in enumerate(order)]


def test_toxicity(spark, odd, none, make_docs):
    labels = spark.createDataFrame([(1, 1, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(odd, labels)
    assert model.prior == 0.0 and {r.score for r in toxicity.scored(odd, model).collect()} == {0.0}
    assert toxicity.scored(none, model).count() == 0
    rows = [(i, f"plain word{i % 50} some text {i} " + ("you stupidhead " * 3 if i % 2 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(400)], "doc_id bigint, quality int, toxic int")
    docs = make_docs(rows)
    model = toxicity.fit(docs, labels)
    assert all(r.predicted == r.doc_id % 2 for r in toxicity.scored(docs, model).collect())
    assert toxicity.accepted(odd, model).columns == odd.columns
    assert len(toxicity.scored(odd, model).collect()) == len(ROWS)


def test_bpe(odd, none):
    found = {r.doc_id: r for r in bpe.round_trip(odd, PATH).collect()}
    assert found[3].n_tokens == found[4].n_tokens == 0
    assert found[5].decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
    assert bpe.round_trip(none, PATH).count() == 0


@pytest.mark.parametrize("text", [LONG, "a" * 200_000, " \n" * 90_000 + "b", "don't 've " * 20_000, "é　 1a\x1c b" * 15_000])
def test_bpe_pieces_encode_like_the_whole(text):
    own = bpe.encoding(PATH, public_tokenizers.PATTERN)
    assert "".join(bpe.pieces(text)) == text
    assert np.frombuffer(bpe.encode_text(text, PATH, public_tokenizers.PATTERN), "<u4").tolist() == own.encode_ordinary(text)


def test_warc(spark, tmp_path):
    big = "payload " * 200
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, big), (4, "u\r\nX: y", None), (5, "http://c", "small"),
            (6, "http://d", "small"), (None, "http://e", big), (3, None, big)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' AS digest")
    (tmp_path / "b").mkdir()
    index = warc.write(pages.coalesce(1), f"file://{tmp_path}/b")
    index.write.parquet(f"{tmp_path}/index")
    found = warc.read(spark.read.parquet(f"{tmp_path}/index")).collect()
    assert len(found) == len(rows)
    assert {(r.page_id, r.record_type, r.refers_to) for r in found} == {
        (1, "revisit", 3), (2, "revisit", 3), (3, "response", None), (4, "response", None), (5, "response", None),
        (6, "response", None), (None, "response", None),
    }
    assert {r.payload_bytes for r in found} == {0, 5, 1600}
    # The bundles are plain Zstandard files: other readers skip the seek table.
    files = sorted((tmp_path / "b").iterdir())
    plain = b"".join(zstd.ZstdDecompressor().stream_reader(f.open("rb"), read_across_frames=True).read() for f in files)
    assert plain.count(b"WARC/1.1") == len(rows)
    (tmp_path / "c").mkdir()
    assert warc.write(pages.limit(0), f"file://{tmp_path}/c").count() == 0


def test_suffixes(odd, none):
    found = suffixes.remove_repeats(odd).collect()
    assert len(found) == len(ROWS) and len(found[0]) == len(odd.columns) + 4
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, []).append(r)
    assert [r.n_removed for r in by_id[2]] == [len(SHARED + " first")] * 2
    assert sorted(r.n_removed for r in by_id[None]) == [0, len(SHARED)]
    assert by_id[5][0].kept_bytes == LONG.encode() and by_id[6][0].n_removed == 0
    assert suffixes.remove_repeats(none).count() == 0


def test_repeats_across_slices(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SLICE", 100)
    monkeypatch.setattr(suffixes, "UNIT_BYTES", 600)
    rng = np.random.default_rng(3)
    pool = ["".join(rng.choice(list("abcd"), 70)) for _ in range(12)]
    texts = ["".join(pool[j] for j in rng.integers(0, 12, 5)) + "".join(rng.choice(list("xyz"), 30)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    seen, found = {}, {r.doc_id: r for r in suffixes.remove_repeats(docs).collect()}
    for d, t in enumerate(texts):
        gone = [False] * len(t)
        for p in range(len(t) - 49):
            if seen.setdefault(t[p : p + 50], d) < d:
                gone[p : p + 50] = [True] * 50
        assert found[d].text == "".join(c for c, g in zip(t, gone, strict=True) if not g)


def test_decontamination(spark, odd, none, make_docs):
    items = spark.createDataFrame(
        [(1, SHARED), (1, SHARED), (2, None), (3, ""), (4, "word5 other5"), (None, "quick brown")], "item_id bigint, text string"
    )
    found = decontaminate.contamination(odd, items)
    rows = {r.doc_id: r for r in found.collect()}
    assert found.count() == len(ROWS)
    assert (rows[1].n_words, rows[1].n_hit, rows[1].item_ids, rows[1].contaminated) == (19, 18, ["1"], True)
    assert rows[5].item_ids == ["4"] and not rows[5].contaminated and rows[3].n_words == 0
    assert decontaminate.contamination(none, items).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(odd, items.limit(0)).collect()} == {0}
    kept = decontaminate.clean(odd, items)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {3, 4, None, 5, 6, 7, 8}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_simhash(odd, none):
    found = simhash.near_duplicates(odd).collect()
    assert len(found) == len(ROWS)
    assert {r.component_id for r in found if r.doc_id in (1, 2)} == {1}
    empty = {(r.doc_id, r.fp, r.component_id) for r in found if r.doc_id in (3, 4, 8)}
    assert empty == {(3, 0, 3), (4, 0, 3), (8, 0, 3)}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) in ([-1, 1, 3, 5, 6, 7], [1, 3, 5, 6, 7])
    assert simhash.near_duplicates(none).count() == 0


def test_large_cells_keep_their_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LAG_CELL", 4)
    rng = np.random.default_rng(5)
    base = int(rng.integers(1 << 62))
    fps = {base ^ int(sum(1 << int(b) for b in rng.integers(0, 63, n % 5))) for n in range(400)} | {
        int(x) for x in rng.integers(1 << 62, size=200)
    }
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    roots = {r.node: r.root for r in components(simhash.linked(df), Scratch(spark, "t")).collect()}
    order = sorted(fps)
    near = {f: [g for g in order if (f ^ g).bit_count() <= 3] for f in order}
    for f in order:
        reach, queue = {f}, [f]
        while queue:
            new = set(near[queue.pop()]) - reach
            reach |= new
            queue += new
        assert roots.get(f, f) == min(reach)
