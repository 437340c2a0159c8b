"""The phases of the exact top-k search: what the threshold leaves open, and odd queries."""

from __future__ import annotations

import numpy as np
import pytest

from barlake.llm import topk


@pytest.mark.parametrize("size", [40, 5_000, 1 << 24, 1 << 28])
@pytest.mark.parametrize("dims", [1, 16, 50])
def test_threshold_keeps_all_that_reach_the_cutoff(size, dims):
    rng = np.random.default_rng(dims)
    q, v = rng.integers(-size, size, (6, dims)), rng.integers(-size, size, (400, dims))
    scores = q @ v.T
    for rank in (1, 20, 390):
        cut = np.sort(scores, axis=1)[:, -rank].copy()
        cut[0] = topk._OPEN
        left = topk.sufficient(q, v, cut)
        assert left[0].all()
        assert left[1:][scores[1:] >= cut[1:, None]].all()


def test_few_whole_scores_are_worked_out():
    rng = np.random.default_rng(7)
    near = rng.integers(-20, 20, (8, 64))
    v = np.concatenate([np.repeat(near * 3, 30, axis=0), rng.integers(-20, 20, (4000, 64))])
    scores = near @ v.T
    cut = np.sort(scores, axis=1)[:, -20]
    left = topk.sufficient(near, v, cut)
    assert left[scores >= cut[:, None]].all()
    assert left.sum() < left.size / 10


def test_query_rows_with_one_id_and_clashing_columns(spark):
    rows = [(1, [0.5, 0.0], 9, 1), (1, [0.0, 0.5], 9, 2), (2, [1.0, 0.0], 9, 3), (3, [0.0, 2.0], 9, 4)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, rank int, score bigint")
    found = [tuple(r) for r in topk.top_k(vectors, vectors.where("vec_id = 1"), 5).collect()]
    # [0, 32] is the smaller of the two vectors with id 1; rows of the query's own id are no candidates.
    assert sorted(found) == [(1, 1, 3, 32 * 128), (1, 2, 2, 0)]
