"""Tree candidates against plain recursive versions, and at their full size."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from barlake.learners import growth, trees
from barlake.operators.features import FEATURES
from barlake.plans import forecasting

SF = "/root/testdata/sf0.001"
WIDTH = len(FEATURES)


def plain_tree(x, g, h, depth, leaf, ridge=0.0, columns=None):
    """Nested dicts; every split of every column is tried, the first best one wins."""
    value = g.sum() / (h.sum() + ridge)
    best = None
    for c in range(x.shape[1]) if depth else ():
        if columns is not None and not columns[c]:
            continue
        for a, b in zip(*(lambda u: (u[:-1], u[1:]))(np.unique(x[:, c])), strict=True):
            low = x[:, c] <= a
            if min(low.sum(), (~low).sum()) < leaf:
                continue
            gain = sum(g[s].sum() ** 2 / (h[s].sum() + ridge) for s in (low, ~low)) - g.sum() ** 2 / (h.sum() + ridge)
            if gain > 1e-9 and (best is None or gain > best[0] * (1 + 1e-12)):
                best = gain, c, (a + b) / 2, low
    if best is None:
        return {"value": value}
    _, c, cut, low = best
    sides = [plain_tree(x[s], g[s], h[s], depth - 1, leaf, ridge, columns) for s in (low, ~low)]
    return {"value": value, "column": c, "cut": cut, "sides": sides}


def plain_value(tree, row):
    while "sides" in tree:
        tree = tree["sides"][int(row[tree["column"]] > tree["cut"])]
    return tree["value"]


def series(n, seed, integer=True):
    """Whole numbers keep sums exact, so equally good splits tie in both versions."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, WIDTH))
    x[:, -3], x[:, -2] = rng.integers(0, 5, n), rng.integers(1, 4, n)
    y = x[:, 0] * 20 + np.where(x[:, 1] > 0, 30, 0) + rng.normal(size=n) * 5
    return x, np.round(y) if integer else y


@pytest.mark.parametrize(("depth", "leaf", "ridge"), [(4, 1, 0.0), (10, 3, 0.0), (5, 1, 1.0), (3, 20, 0.5)])
def test_splits_equal_a_plain_tree(depth, leaf, ridge):
    x, y = series(90, depth)
    data = growth.Columns.of(x)
    for seed in range(3):
        weight = growth.bootstrap(growth.noise(7, seed), len(y)).astype(float)
        rows = weight > 0
        got = growth.grow(data, y * weight, weight, depth, leaf, ridge, rows=rows)
        plain = plain_tree(x[rows], (y * weight)[rows], weight[rows], depth, leaf, ridge)
        np.testing.assert_allclose(got.each(x)[:, 0], [plain_value(plain, r) for r in x], rtol=1e-9)


def test_prefix_columns_and_column_samples():
    x, y = series(120, 3)
    data = growth.Columns.of(x).first(70)
    columns = np.arange(WIDTH) % 2 == 0
    got = growth.grow(data, y[:70], None, 4, ridge=1.0, columns=columns)
    assert set(got.feature[got.feature >= 0]) <= set(np.flatnonzero(columns))
    plain = plain_tree(x[:70], y[:70], np.ones(70), 4, 1, 1.0, columns)
    np.testing.assert_allclose(got.each(x)[:, 0], [plain_value(plain, r) for r in x], rtol=1e-9)


def test_constant_target_and_equal_features_make_one_leaf():
    x, _ = series(30, 1)
    one = growth.grow(growth.Columns.of(x), np.full(30, 2.0), None, 5)
    assert len(one.feature) == 1 and one.value[0] == 2.0
    flat = growth.grow(growth.Columns.of(np.ones((30, WIDTH))), np.arange(30.0), None, 5)
    assert len(flat.feature) == 1 and flat.value[0] == 14.5


def test_boosting_equals_plain_rounds():
    x, y = series(80, 5)
    base, rate, fitted = trees.gradient_boosting(6).fit(growth.Columns.of(x), y, growth.noise(1), range(6))
    pred, plain = np.full(len(y), y.mean()), []
    for _ in range(6):
        tree = plain_tree(x, y - pred, np.ones(len(y)), 3, 1)
        pred = pred + 0.1 * np.array([plain_value(tree, r) for r in x])
        plain.append(tree)
    np.testing.assert_allclose(base + rate * fitted.total(x), pred, rtol=1e-6)


def test_second_order_boosting_equals_plain_rounds():
    # Large nodes: in small ones several columns make the same split and rounding picks one of them.
    x, y = series(200, 6, integer=False)
    seed = growth.noise(1)
    candidate = trees.second_order_boosting(8, depth=2)
    base, rate, fitted = candidate.fit(growth.Columns.of(x), y, seed, range(8))
    pred = np.full(len(y), y.mean())
    seen = []
    for number in range(8):
        own = growth.noise(42, int(seed), number)
        rows = growth.draws(own, len(y)) < np.uint64(int(0.9 * (2**64 - 1)))
        columns = np.zeros(WIDTH, bool)
        columns[np.argsort(growth.draws(growth.noise(int(own), 1), WIDTH))[:17]] = True
        tree = plain_tree(x[rows], (y - pred)[rows], np.ones(rows.sum()), 2, 1, 1.0, columns)
        pred = pred + 0.03 * np.array([plain_value(tree, r) for r in x])
        seen.append(rows.mean())
    np.testing.assert_allclose(base + rate * fitted.total(x), pred, rtol=1e-6)
    assert 0.8 < np.mean(seen) < 1


def small_frame(spark, symbols=2, n=300):
    frames = []
    for s in range(symbols):
        x, y = series(n, 10 + s)
        dates = pd.date_range("2020-01-01", periods=n).date
        segment = np.minimum(np.maximum((np.arange(n) - n // 6) // (n // 6) + 1, 0), 5).astype("int32")
        frames.append(pd.DataFrame(x, columns=list(FEATURES)).assign(symbol=f"S{s}", date=dates, segment=segment, target=y))
    kinds = ", ".join(f"{n} double" for n in FEATURES)
    return pd.concat(frames), lambda: spark.createDataFrame(pd.concat(frames), f"{kinds}, symbol string, date date, segment int, target double")


def test_forest_rows_equal_a_plain_forest_whatever_the_batches(spark, monkeypatch):
    """Bootstrap draws, fold prefixes, batches and sums: prediction of every test row worked out again."""
    table, make = small_frame(spark)
    # Large leaves: in small nodes several columns make the same split and rounding picks one of them.
    candidate = trees.random_forest(40, 4, leaf=15)
    results = []
    for per_core in (1, 4):
        monkeypatch.setattr(trees, "ITEMS_PER_CORE", per_core)
        rows = trees.out_of_fold(trees.training_frame(make()), candidate).collect()
        results.append({(r.symbol, r.date): (r.fold, r.pred) for r in rows})
    assert results[0].keys() == results[1].keys()
    for key, (fold, pred) in results[0].items():
        assert results[1][key][0] == fold and results[1][key][1] == pytest.approx(pred, rel=1e-12)
    import zlib

    part = table[table.symbol == "S1"].reset_index(drop=True)
    train, test = part[part.segment < 2], part[part.segment == 2]
    x, y = train[list(FEATURES)].to_numpy(), train.target.to_numpy()
    own = growth.noise(zlib.crc32(b"S1"), 2)
    total = np.zeros(len(test))
    for number in range(40):
        weight = growth.bootstrap(growth.noise(42, int(own), number), len(y)).astype(float)
        rows = weight > 0
        tree = plain_tree(x[rows], ((y - y.mean()) * weight)[rows], weight[rows], 4, 15)
        total += y.mean() + np.array([plain_value(tree, r) for r in test[list(FEATURES)].to_numpy()])
    got = [results[0][("S1", d)][1] for d in test.date]
    np.testing.assert_allclose(got, total / 40, rtol=1e-9)


def test_refit_predicts_by_symbol_and_survives_batches(spark):
    table, make = small_frame(spark)
    frame = trees.training_frame(make())
    models = trees.final_fit(frame, trees.random_forest(40, 4))
    assert models.groupBy("symbol").agg(F.sum(F.size("roots")).alias("n")).where("n = 40").count() == 2
    rows = frame.where("segment = 5").unionByName(frame.where("segment = 5").limit(1).withColumn("symbol", F.lit("NONE")))
    got = trees.predict_rows(models, rows).collect()
    assert [r.pred for r in got if r.symbol == "NONE"] == [None]
    known = [r for r in got if r.symbol != "NONE"]
    errors = np.array([r.target - r.pred for r in known])
    assert len(known) == 100 and np.abs(errors).mean() < 0.5 * table.target.std()


@pytest.mark.parametrize(
    ("name", "models"),
    [
        ("g3_random_forest", {"random_forest"}),
        ("g4_gradient_boosting", {"gradient_boosting"}),
        ("g5_second_order_boosting", {"second_order_boosting"}),
    ],
)
def test_registered_query_fits_the_full_candidate(spark, name, models):
    rows = entry.queries()[name](spark, SF).collect()
    assert {r.model for r in rows} == models
    assert {(r.symbol, r.fold) for r in rows} == {(s, f) for s in {r.symbol for r in rows} for f in range(1, 6)}
    error = np.mean([abs(r.residual) for r in rows])
    spread = np.mean([abs(r.y - np.mean([q.y for q in rows])) for r in rows])
    assert error < 1.5 * spread


def test_full_sizes():
    sizes = {c.name: c.trees for c in forecasting.default_trees()}
    assert sizes == {"random_forest": 500, "gradient_boosting": 100, "second_order_boosting": 600}
