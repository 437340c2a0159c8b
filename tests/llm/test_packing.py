"""Packing: ids and cuts of the tokenizers library, bounds of exhaustive search, whole and gapless sequences."""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barlake.llm import packing, vocabularies

PATH = public_tokenizers.path(packing.VOCABULARY)
ODD = [
    None, "", " ", "a", "<|endoftext|>", "x <|endoftext|> y", "naïve café 你好 \U0001f600", "tab\tand\n\nlines  \r\n ", "'s't 're", "<s></s>",
    "word " * 3000, "x" * 5000, " " * 3000, "1234567890 " * 700, "é" * 4000,
]


@cache
def library():
    return Tokenizer.from_file(PATH)


def plain_ids(text):
    return np.array([*library().encode(text or "", add_special_tokens=False).ids, 2], "<u4")


@pytest.mark.parametrize("text", ODD)
def test_ids_equal_the_library(text):
    assert packing.document_ids(text, PATH).tolist() == plain_ids(text).tolist()


def test_ids_of_characters_of_every_block():
    for start in range(0, 0x30000, 0x400):
        text = "".join(f"a{chr(c)}b {chr(c)}1" for c in range(start, start + 0x400, 37) if not 0xD800 <= c <= 0xDFFF)
        assert packing.document_ids(text, PATH).tolist() == plain_ids(text).tolist()


def test_vocabularies_that_are_no_plain_byte_level_bpe_are_refused():
    with pytest.raises((ValueError, KeyError, TypeError)):
        vocabularies.json_encoding(public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.PATTERN)


@pytest.mark.parametrize(("n", "bounds"), [(1, [0, 1]), (9, [0, 9]), (10, [0, 10]), (11, [0, 1, 11]), (20, [0, 10, 20]), (25, [0, 5, 15, 25])])
def test_cuts(n, bounds):
    assert packing.cuts(n, 10) == bounds


def least_bins(sizes, room):
    """Exhaustive: the least number of bins."""

    @cache
    def fits(rest, bins):
        if not rest:
            return True
        tried = set()
        for i, left in enumerate(bins):
            if left >= rest[0] and left not in tried:
                tried.add(left)
                if fits(rest[1:], tuple(sorted([*bins[:i], left - rest[0], *bins[i + 1 :]]))):
                    return True
        return False

    rest = tuple(sorted(sizes, reverse=True))
    return next(n for n in range(len(sizes) + 1) if fits(rest, (room,) * n))


@pytest.mark.parametrize("seed", range(40))
def test_bounds_are_never_above_the_best_packing(seed):
    rng = np.random.default_rng(seed)
    room = int(rng.integers(6, 25))
    sizes = rng.integers(1, room + 1, rng.integers(1, 9))
    best = least_bins(sizes.tolist(), room)
    bound = packing.lower_bound(sizes, room)
    where, _, _ = packing.best_fit_decreasing(sizes, room)
    assert -(-int(sizes.sum()) // room) <= bound <= best <= len(set(where.tolist()))


def test_dual_feasible_functions_never_overfill():
    """Of each function: no set of sizes that fits a sequence has shares above 1 (a knapsack over all sets)."""
    room = 24
    values, full = packing.dual_feasible(room)
    for row, whole in zip(values, full, strict=True):
        best = np.zeros(room + 1, np.int64)
        for size in range(1, room + 1):
            best[size] = max(best[size], best[size - 1])
            for part in range(1, size + 1):
                best[size] = max(best[size], best[size - part] + row[part])
        assert best[room] <= whole


def plain_best_fit(sizes, room):
    bins, out = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        open_ = [(left, -k) for k, left in enumerate(bins) if left >= sizes[i]]
        left, k = min(open_, default=(room, 1))
        if k == 1:
            bins.append(room)
            k = 1 - len(bins)
        out[i] = room - bins[-k]
        bins[-k] -= sizes[i]
    return sorted(bins), len(bins)


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_equals_a_plain_search(seed):
    sizes = np.random.default_rng(seed).integers(1, 100, 400)
    _, _, room = packing.best_fit_decreasing(sizes, 100)
    assert (sorted(room.tolist()), len(room)) == plain_best_fit(sizes.tolist(), 100)


def check_whole(rows, texts, sequence=1024):
    """Every piece of every row once, digests of its ids, sequences gapless and not overfull."""
    want = []
    for doc_id, text in texts:
        ids = plain_ids(text)
        cut = packing.cuts(len(ids), sequence)
        want += [(doc_id, p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))]
    key = lambda t: tuple((x is None, x) for x in t)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= sequence
    return len(by)


def test_odd_documents(spark, make_docs):
    texts = [*enumerate(ODD), (3, "a"), (3, "a"), (None, "no id"), (None, None)]
    docs = make_docs(texts).withColumns({c: F.lit(1) for c in ("uid", "part", "length", "sequence_id")})
    check_whole(packing.pack(docs, PATH).collect(), texts)
    assert packing.pack(make_docs([]), PATH).count() == 0
    assert packing.certificate(packing.pack(make_docs([]), PATH)) == (0, 0)


def test_exchange_between_groups_comes_near_the_bound(spark, make_docs):
    """Small groups, several rounds: near to one best-fit over everything, which single groups are not."""
    rng = np.random.default_rng(1)
    texts = [(i, "word " * int(n)) for i, n in enumerate(rng.integers(1, 900, 1500))]
    packed = packing.pack(make_docs(texts).repartition(5), PATH, group=300).persist()
    used = check_whole(packed.collect(), texts)
    sizes = np.array([len(plain_ids(t)) for _, t in texts])
    assert packing.certificate(packed) == (used, packing.lower_bound(sizes))
    assert used <= 1.03 * len(packing.best_fit_decreasing(sizes)[2])


def test_registered_query(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    rows = entry.queries()["op11_best_fit_packing"](spark, sf).collect()
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    used = check_whole(rows, texts)
    sizes = np.array([r.length for r in rows])
    assert used <= packing.lower_bound(sizes) + 1
