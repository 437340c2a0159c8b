"""Every registered corpus query beside its SQL or a brute-force version."""

from __future__ import annotations

import collections
import hashlib
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash

import __spark_entry__ as entry
import check
import corpus_pipeline
from barlake.llm import bpe, paragraphs, registry, toxicity
from barlake.llm.shared import ASCII_LOWER

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


def rows_of(spark, name, sf=SF):
    return {r[0]: r for r in entry.queries()[name](spark, sf).collect()}


def roots(n, links):
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, name):
    assert re.match(r"ok \d+", check.compare(spark, check.duck(SF), SF, name, entry.queries()[name], registry.SQL[name]))


def test_names():
    have = sorted(int(re.match(r"op(\d+)_", n).group(1)) for n in registry.QUERIES if n != "pipeline")
    assert have == list(range(1, 14)) and "pipeline" in registry.QUERIES
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "byte_level_bpe",
    ]


def test_paragraphs(spark, texts):
    found = rows_of(spark, "op2_paragraph_minhash_dedup")
    items = []
    for d in sorted(texts):
        for _, _, w in paragraphs.paragraphs(texts[d].encode()):
            items.append((d, frozenset(b" ".join(w[k : k + 5]) for k in range(len(w) - 4))))
    links = [
        (i, j)
        for j in range(len(items))
        for i in range(j)
        if 5 * len(items[i][1] & items[j][1]) >= 4 * len(items[i][1] | items[j][1])
    ]
    gone = collections.Counter(items[j][0] for j, r in enumerate(roots(len(items), links)) if r != j)
    assert {d: r.n_removed_paragraphs for d, r in found.items()} == {d: gone[d] for d in texts}


def test_resampling(spark, texts):
    found = rows_of(spark, "op3_importance_resampling")
    assert set(found) == set(texts)
    quality = duckdb.sql(f"SELECT quality FROM '{SF}/labels.parquet'").fetchall()
    k = round(sum(q for (q,) in quality) / len(quality) * len(texts))
    cut = sorted((r.key for r in found.values()), reverse=True)[k - 1]
    assert all(r.selected == (r.key >= cut) for r in found.values())


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    found = rows_of(spark, "op5_toxicity", sf)
    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet'").fetchall())
    held = [(found[d].score, t) for d, t in labels.items() if d in found and found[d].held_out]
    order = np.argsort([s for s, _ in held])
    toxic = np.array([t for _, t in held])[order]
    rank = np.flatnonzero(toxic == 1)
    auc = (rank.sum() - len(rank) * (len(rank) - 1) / 2) / (len(rank) * (len(toxic) - len(rank)))
    assert auc > 0.93
    predicted = np.array([found[d].predicted for d in labels if d in found and found[d].held_out])
    truth = np.array([t for _, t in held])
    assert predicted[truth == 1].mean() > 0.75 and predicted[truth == 0].mean() < 0.02
    assert all(r.predicted == (r.score >= toxicity.THRESHOLD) and 0 <= r.score <= 1 for r in found.values())


def test_bpe(spark, texts):
    own = bpe.encoding(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
    for d, r in rows_of(spark, "op6_byte_level_bpe").items():
        ids = own.encode_ordinary(texts[d])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[d].encode()).hexdigest()


def plain_repeats(texts):
    """Per document the bytes that repeat a document with a smaller id, and what is left."""
    seen: dict[bytes, int] = {}
    for d in sorted(texts):
        raw = (texts[d] or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if seen.setdefault(raw[p : p + 50], d) < d:
                gone[p : p + 50] = b"\1" * 50
        yield d, gone, bytes(b for b, g in zip(raw, gone, strict=True) if not g)


def test_suffixes(spark, texts):
    found = rows_of(spark, "op8_suffix_array_dedup")
    for d, gone, kept in plain_repeats(texts):
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        assert tuple(found[d]) == (d, len(gone), sum(gone), spans, hashlib.sha256(kept).hexdigest())


def plain_contaminated(texts, items):
    """Documents of which benchmark windows of 13 words (or whole shorter items) hit a twentieth of the words."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(fold))
    windows = set()
    for item in items:
        w = words(item)
        windows |= {tuple(w[i : i + 13]) for i in range(max(len(w) - 12, 1))} if w else set()
    sizes, out = {len(w) for w in windows}, set()
    for d, text in texts.items():
        w = words(text)
        hit = bytearray(len(w))
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit[i : i + n] = b"\1" * n
        if sum(hit) and 20 * sum(hit) >= len(w):
            out.add(d)
    return out


def plain_fingerprint(text: str) -> int:
    w = text.encode().translate(ASCII_LOWER).split()
    parts = [b" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, texts):
    ids = sorted(texts)
    fps = [plain_fingerprint(texts[d]) for d in ids]
    links = [(i, j) for j in range(len(ids)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= 3]
    expected = {d: (f"{f:016x}", ids[r]) for d, f, r in zip(ids, fps, roots(len(ids), links), strict=True)}
    found = rows_of(spark, "op10_simhash_near_dedup")
    assert {d: (r.fingerprint, r.component_id) for d, r in found.items()} == expected


def test_pipeline_takes_effect(spark, tmp_path):
    """Every stage on what the one before has kept, beside plain versions of the stages."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scores = rows_of(spark, "op5_toxicity")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        before_rows = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        after_ids = {r.doc_id for r in after.select("doc_id").collect()}
        if name != "byte_level_bpe":
            assert after.columns == docs.columns
        if name == "toxicity":
            assert after_ids == {d for d, r in scores.items() if not r.predicted}
        if name == "simhash_near_dedup":
            ids = sorted(before_rows)
            fps = [plain_fingerprint(before_rows[d]) for d in ids]
            links = [(i, j) for j in range(len(ids)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= 3]
            assert after_ids == {ids[r] for r in roots(len(ids), links)}
        if name == "suffix_array_dedup":
            left = {d: kept.decode("utf-8", "ignore") for d, _, kept in plain_repeats(before_rows)}
            assert {r.doc_id: r.text for r in after.select("doc_id", "text").collect()} == left
        if name == "benchmark_decontamination":
            items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
            assert after_ids == set(before_rows) - plain_contaminated(before_rows, items)
            assert {r.doc_id: r.text for r in after.select("doc_id", "text").collect()} == {d: before_rows[d] for d in after_ids}
        if name == "byte_level_bpe":
            own = bpe.encoding(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
            digest = lambda raw: hashlib.sha256(raw).hexdigest()
            want = set()
            for d, text in before_rows.items():
                ids = own.encode_ordinary(text or "")
                want.add((d, len(ids), digest(np.array(ids, "<u4").tobytes()), digest((text or "").encode())))
            assert {tuple(r) for r in after.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()} == want
        docs = after
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, docs.collect()))


def test_pipeline_with_odd_rows(spark, tmp_path):
    """Nulls in any column, empty texts, repeated rows, null ids and more columns pass all stages; empty tables give none."""
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint, unit string, score double"
    long = "fair weather and calm seas are with all who sail today along the coast "
    rows = [(1, None, None, None, None, None, None), (2, "", "en", "s", 0, "u", 1.0), (None, None, None, None, None, None, None)]
    rows += [(3, long * 3, "en", "s", 1, "u", 0.5)] * 2 + [(4, long * 2000, None, None, 1, None, None)]
    folder = f"{tmp_path}/sf"
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    for k, table in enumerate((rows, [])):
        docs = spark.createDataFrame(table, kind)
        for j, (name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}-{j}")
            after = spark.read.parquet(f"{tmp_path}/{k}-{j}")
            if name != "byte_level_bpe":
                assert after.columns == docs.columns
            docs = after
        # Of the empty rows and of the equal texts one each stays (their fingerprints agree).
        left = [r.doc_id for r in docs.collect()]
        assert set(left) <= {1, 2, 3, 4, None} and (2 <= len(left) <= 3 if table else not left)
