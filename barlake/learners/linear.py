"""Linear candidates: elastic net from co-moments, and one-feature least squares.

A fit is one row: symbol, model, model_order, fit, train_rows, intercept, coef (one per feature).
Fits 1..5 are the folds, 6 is the final one. Fold training sets are prefixes of segments, so co-moments
per (symbol, segment) hold all six fits and the price rows are scanned once.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from barlake.operators.features import FEATURES
from barlake.operators.splits import FINAL_FIT, FOLDS

# Elastic-net penalty, mix, sweep limit and tolerance.
ALPHA = 0.001
L1_RATIO = 0.2
MAX_SWEEPS = 5000
TOLERANCE = 1e-4

FIT_SCHEMA = (
    "symbol string, model string, model_order int, fit int, train_rows bigint, intercept double, coef array<double>"
)
_WIDTH = len(FEATURES)
_PAIRS = list(combinations_with_replacement(range(_WIDTH + 1), 2))
_ROWS_AT, _COLS_AT = np.array(_PAIRS).T
_SLICE = 256

# The solver travels to the workers as code, so they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def single_feature_fits(segmented: DataFrame, candidates: dict[str, str]) -> DataFrame:
    """Least squares of the target on one feature each, per symbol and fit, in one pass.

    ``candidates`` maps model names to features, in order of preference. Each row is repeated for
    the fits that train on it, inside the symbol's own partition.
    """
    used = sorted(set(candidates.values()))
    fit = F.explode(F.sequence(F.col("segment") + 1, F.lit(FINAL_FIT))).alias("fit")
    solved = segmented.select("symbol", "target", *used, fit).groupBy("symbol", "fit").agg(
        F.count(F.lit(1)).alias("train_rows"),
        # A constant feature has no slope: the mean of the target is the fit.
        *[F.coalesce(F.regr_intercept("target", x), F.avg("target")).alias(f"a_{x}") for x in used],
        *[F.coalesce(F.regr_slope("target", x), F.lit(0.0)).alias(f"b_{x}") for x in used],
    )
    models = [
        F.struct(
            F.lit(model).alias("model"),
            F.lit(order).alias("model_order"),
            F.col(f"a_{x}").alias("intercept"),
            F.array(*[F.col(f"b_{x}") if name == x else F.lit(0.0) for name in FEATURES]).alias("coef"),
        )
        for order, (model, x) in enumerate(candidates.items(), start=1)
    ]
    return solved.select(
        "symbol", F.col("fit").cast("int").alias("fit"), "train_rows", F.inline(F.array(*models))
    ).select("symbol", "model", "model_order", "fit", "train_rows", "intercept", "coef")


def co_moments(rows: DataFrame, *keys: str) -> DataFrame:
    """Per group: number of rows, means of the features and the target, and their co-moments (upper triangle).

    Co-moments are sums of products of distances from the group's own means, so price levels cost no digits, and
    groups merge without their rows (``merged``). A group is one symbol's rows or a part of them, which the calendar
    bounds; rows that are partitioned by symbol already are not shuffled.
    """
    columns = [*FEATURES, "target"]
    names = [*keys, "n", "mean", "moment"]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        x = np.column_stack([table.column(c).to_numpy().astype(float) for c in columns])
        mean = x.mean(axis=0)
        moment = (x - mean).T @ (x - mean)
        packed = [pa.array([len(x)]), pa.array([mean]), pa.array([moment[_ROWS_AT, _COLS_AT]])]
        return pa.table([*[pa.array([k.as_py()], k.type) for k in key], *packed], names=names)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "n bigint", "mean array<double>", "moment array<double>"])
    return rows.select(*keys, *columns).groupBy(*keys).applyInArrow(run, schema)


def merged(a: tuple, b: tuple) -> tuple:
    """(n, mean, co-moment matrix) of two disjoint sets of rows together; leading axes are many pairs at once."""
    (na, ma, ca), (nb, mb, cb) = a, b
    n, step = na + nb, mb - ma
    share = (nb / n)[..., None]
    return n, ma + step * share, ca + cb + step[..., :, None] * step[..., None, :] * (na * nb / n)[..., None, None]


def merge_moments(parts: DataFrame, *keys: str) -> DataFrame:
    """Adds up co-moments of disjoint rows, as of earlier bars (stored) and new ones: no row is read again."""
    kinds = {f.name: f.dataType.simpleString() for f in parts.schema}
    names = [*keys, "n", "mean", "moment"]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        # A fixed order of the parts, so that repeated tasks agree to the last digit.
        rows = sorted(table.to_pylist(), key=lambda r: (r["n"], r["mean"], r["moment"]))
        total = None
        for r in rows:
            one = np.array([r["n"]], float), np.array([r["mean"]]), _square(np.array([r["moment"]]))
            total = one if total is None else merged(total, one)
        n, mean, moment = total
        packed = [pa.array([int(n[0])]), pa.array([mean[0]]), pa.array([moment[0][_ROWS_AT, _COLS_AT]])]
        return pa.table([*[pa.array([k.as_py()], k.type) for k in key], *packed], names=names)

    schema = ", ".join(f"{n} {kinds[n]}" for n in names)
    return parts.select(names).groupBy(*keys).applyInArrow(run, schema)


def _square(triangle: np.ndarray) -> np.ndarray:
    out = np.empty((*triangle.shape[:-1], _WIDTH + 1, _WIDTH + 1))
    out[..., _ROWS_AT, _COLS_AT] = triangle
    out[..., _COLS_AT, _ROWS_AT] = triangle
    return out


def packed_moments(segmented: DataFrame) -> DataFrame:
    """One row per symbol: the co-moments of its six segments, in order."""
    parts = co_moments(segmented, "symbol", "segment")
    ordered = F.array_sort(F.collect_list(F.struct("segment", "n", "mean", "moment")))
    return parts.groupBy("symbol").agg(ordered.alias("segments"))


def descend(
    gram: np.ndarray, xy: np.ndarray, yy: np.ndarray, rows: np.ndarray, alpha: float, l1_ratio: float,
    max_sweeps: int = MAX_SWEEPS, tolerance: float = TOLERANCE,
) -> np.ndarray:
    """Cyclic coordinate descent on many centred problems at once; returns the weights.

    Minimises |y - Xw|^2 / 2n + alpha * l1_ratio * |w|_1 + alpha * (1 - l1_ratio) / 2 * |w|^2. A
    problem stops when its largest step is small and its duality gap is below tolerance * |y|^2.
    """
    weights = np.zeros_like(xy)
    l1, l2 = alpha * l1_ratio * rows, alpha * (1 - l1_ratio) * rows
    open_ = np.arange(len(rows))
    for _ in range(max_sweeps):
        if not len(open_):
            break
        g, b, w = gram[open_], xy[open_], weights[open_]
        before = w.copy()
        for j in range(w.shape[1]):
            diag = g[:, j, j]
            rho = b[:, j] - np.einsum("bk,bk->b", g[:, j, :], w) + diag * w[:, j]
            step = np.sign(rho) * np.maximum(np.abs(rho) - l1[open_], 0.0)
            w[:, j] = np.where(diag > 0, step / np.where(diag > 0, diag + l2[open_], 1.0), 0.0)
        weights[open_] = w
        largest, change = np.abs(w).max(axis=1), np.abs(w - before).max(axis=1)
        settled = (largest == 0) | (change < tolerance * np.where(largest > 0, largest, 1.0))
        if settled.any():
            at = open_[settled]
            gap = _duality_gap(gram[at], xy[at], yy[at], weights[at], l1[at], l2[at])
            done = at[gap <= tolerance * yy[at]]
            open_ = np.setdiff1d(open_, done, assume_unique=True)
    return weights


def _duality_gap(g, b, yy, w, l1, l2):
    gw = np.einsum("bij,bj->bi", g, w)
    fit = np.einsum("bi,bi->b", b, w)
    residual = yy - 2 * fit + np.einsum("bi,bi->b", gw, w)
    squares = np.einsum("bi,bi->b", w, w)
    dual = np.abs(b - gw - l2[:, None] * w).max(axis=1)
    scale = np.where(dual > l1, l1 / np.where(dual > 0, dual, 1.0), 1.0)
    return (
        0.5 * residual * (1 + scale**2) + l1 * np.abs(w).sum(axis=1) - scale * (yy - fit)
        + 0.5 * l2 * (1 + scale**2) * squares
    )


def _solve(frames: Iterator[pd.DataFrame], alpha: float, l1_ratio: float, model: str, order: int):
    for frame in frames:
        for lo in range(0, len(frame), _SLICE):
            part = frame.iloc[lo : lo + _SLICE]
            listed = [[s for s in segments] for segments in part["segments"]]
            n, mean, moment = (
                np.array([[s[name] for s in segments] for segments in listed], float) for name in ("n", "mean", "moment")
            )
            moment = _square(moment)
            # Training sets are prefixes of the segments.
            fits = [(n[:, 0], mean[:, 0], moment[:, 0])]
            for k in range(1, FOLDS + 1):
                fits.append(merged(fits[-1], (n[:, k], mean[:, k], moment[:, k])))
            n, mean, moment = (np.stack(x, axis=1) for x in zip(*fits, strict=True))
            flat = moment.reshape(-1, _WIDTH + 1, _WIDTH + 1)
            w = descend(
                flat[:, :_WIDTH, :_WIDTH], flat[:, :_WIDTH, _WIDTH], flat[:, _WIDTH, _WIDTH], n.reshape(-1), alpha, l1_ratio
            ).reshape(len(part), FOLDS + 1, _WIDTH)
            intercept = mean[..., _WIDTH] - np.einsum("sfk,sfk->sf", w, mean[..., :_WIDTH])
            yield pd.DataFrame(
                {
                    "symbol": np.repeat(part["symbol"].to_numpy(), FOLDS + 1),
                    "model": model,
                    "model_order": order,
                    "fit": np.tile(np.arange(1, FINAL_FIT + 1), len(part)),
                    "train_rows": n.reshape(-1).astype("int64"),
                    "intercept": intercept.reshape(-1),
                    "coef": list(w.reshape(-1, _WIDTH)),
                }
            )


def elastic_net_fits(
    segmented: DataFrame, alpha: float = ALPHA, l1_ratio: float = L1_RATIO, model: str = "elastic_net", order: int = 1
) -> DataFrame:
    """Elastic net of the target on all features, per symbol and fit.

    The rows of a segment become co-moments; what is solved are 19 x 19 systems, one row per symbol.
    """

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _solve(frames, alpha, l1_ratio, model, order)

    return packed_moments(segmented).mapInPandas(solve, FIT_SCHEMA)


def linear_value(intercept: Column, coef: Column, values: list[Column]) -> Column:
    total = intercept
    for i, value in enumerate(values):
        total = total + coef[i] * value
    return total


def packed_fits(fits: DataFrame) -> DataFrame:
    """All fits of a symbol in one row (six per candidate), so that joins are on symbol alone and
    keep the symbol partitioning of the price rows."""
    fit = F.struct("fit", "model", "model_order", "train_rows", "intercept", "coef")
    return fits.groupBy("symbol").agg(F.collect_list(fit).alias("fits"))


def out_of_fold(segmented: DataFrame, packed: DataFrame) -> DataFrame:
    """Predictions of every linear candidate on the test blocks."""
    tested = segmented.filter("segment >= 1").join(packed, "symbol")
    mine = F.filter("fits", lambda f: f["fit"] == F.col("segment"))
    rows = tested.select("symbol", "segment", "date", "target", *FEATURES, F.inline(mine))
    pred = linear_value(F.col("intercept"), F.col("coef"), [F.col(n) for n in FEATURES])
    return oof_rows(rows.withColumn("pred", pred).withColumn("fold", F.col("segment")))


def chosen_final_fits(packed: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen rows of linear winners with the refit: plus train_rows, intercept, coef."""
    final = F.filter("fits", lambda f: (f["fit"] == FINAL_FIT) & (f["model"] == F.col("winner")))
    wanted = packed.join(chosen.withColumnRenamed("model", "winner").drop("model_order"), "symbol")
    kept = [c for c in wanted.columns if c not in ("fits", "winner")]
    return wanted.select(*kept, F.inline(final)).drop("fit", "model_order")


def oof_rows(predicted: DataFrame) -> DataFrame:
    return predicted.select(
        "symbol",
        "model",
        "model_order",
        "fold",
        "date",
        F.col("target").alias("y"),
        "pred",
        (F.col("target") - F.col("pred")).alias("residual"),
    )
