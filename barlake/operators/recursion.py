"""Recursive multi-step forecasts from one small state row per symbol.

State: symbol, hist (the last 51 adjusted closes, oldest first), volume, last_date, dates (the
coming sessions) and known (features and price of the newest complete bar). Each step predicts from the newest
complete bar, floors the result and appends it as the next bar, so a step costs the same however long the history is.
"""

from __future__ import annotations

import sys
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from barlake.learners.linear import linear_value
from barlake.learners.trees import predictor
from barlake.operators.calendar import HORIZON, with_sessions
from barlake.operators.features import FEATURES, LAGS, RETURNS, WIDTHS, WITNESSES, feature_matrix

# What runs in tasks travels to the workers as code, so they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values.
PRICE_FLOOR = 0.01

DEPTH = max(WIDTHS) + 1
# What a path row takes along from the choice, so that no join is needed after the recursion.
CARRIED = ("cv_mae", "q_low", "q_high", "train_rows")


def start_states(daily: DataFrame, closed: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """State rows of the symbols with a complete bar, from daily bars.

    The windows have the order of the feature matrix, so they share the shuffle that the training rows need.
    """
    newest = Window.partitionBy("symbol").orderBy(F.col("date").desc())
    matrix = feature_matrix(daily).withColumn("rn", F.row_number().over(newest))
    complete = reduce(lambda a, b: a & b, [F.col(name).isNotNull() for name in WITNESSES])
    bars = F.array_sort(F.collect_list(F.when(F.col("rn") <= DEPTH, F.struct("date", "adj_close", "volume"))))
    known = F.min_by(F.array(*FEATURES, "adj_close"), F.when(complete, F.col("rn")))
    gathered = matrix.groupBy("symbol").agg(bars.alias("bars"), known.alias("known")).filter(F.col("known").isNotNull())
    states = gathered.select(
        "symbol",
        F.col("bars.adj_close").alias("hist"),
        F.element_at("bars", -1)["volume"].cast("double").alias("volume"),
        F.element_at("bars", -1)["date"].alias("last_date"),
        "known",
    )
    return with_sessions(states, closed, horizon)


def latest_features(hist: Column, date: Column, volume: Column) -> list[Column]:
    """The 19 features of the newest bar, in order, from its price window."""
    now = hist[DEPTH - 1]

    def back(k: int) -> Column:
        return hist[DEPTH - 1 - k]

    made = {f"lag_close_{k}": back(k) for k in LAGS}
    made |= {f"ret_{k}": F.try_divide(now, back(k)) - 1 for k in RETURNS}
    for w in WIDTHS:
        before = F.slice(hist, DEPTH - w, w)
        made[f"roll_mean_{w}"] = _total(before) / w
        made[f"roll_std_{w}"] = F.sqrt(_square_spread(before, _total(before) / w) / (w - 1))
    made |= {
        "dow": F.weekday(date).cast("double"),
        "month": F.month(date).cast("double"),
        "log_volume": F.log1p(volume),
    }
    return [made[name] for name in FEATURES]


def _newest_complete(hist: Column, date: Column, volume: Column, known: Column) -> Column:
    """Features and price of the newest bar if all are there, else of the newest bar that had them."""
    now = F.array(*latest_features(hist, date, volume), hist[DEPTH - 1])
    # The one-element array lets the features be worked out once.
    return F.transform(
        F.array(now), lambda v: F.when(F.forall(v, lambda x: x.isNotNull()), v).otherwise(known)
    )[0]


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _square_spread(values: Column, mean: Column) -> Column:
    """Sum of squared distances; the one-element array lets the mean be worked out once."""

    def around(m: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - m) * (x - m))

    return F.transform(F.array(mean), around)[0]


def _appended(hist: Column, pred: Column) -> Column:
    return F.slice(F.concat(hist, F.array(pred)), 2, DEPTH)


def _floored(pred: Column) -> Column:
    """A price is at least the floor; a missing prediction stays missing. The prediction is worked out once."""
    return F.get(F.transform(F.array(pred), lambda p: F.when(p.isNotNull(), F.greatest(p, F.lit(PRICE_FLOOR)))), F.lit(0))


def _carried(df: DataFrame) -> list[str]:
    return [c for c in CARRIED if c in df.columns]


def linear_paths(states: DataFrame, final_fits: DataFrame) -> DataFrame:
    """symbol, model, dates, preds: the whole recursion inside one projection per symbol."""
    ready = states.join(final_fits, "symbol")
    feature_dates = F.concat(F.array("last_date"), F.col("dates"))
    no_preds = F.array().cast("array<double>")

    def step(acc: Column, i: Column) -> Column:
        date = F.get(F.col("feature_dates"), i - 1)
        known = _newest_complete(acc["hist"], date, F.col("volume"), acc["known"])

        def grown(values: Column) -> Column:
            pred = _floored(linear_value(F.col("intercept"), F.col("coef"), [values[j] for j in range(len(FEATURES))]))
            return F.transform(
                F.array(pred),
                lambda p: F.struct(
                    _appended(acc["hist"], p).alias("hist"),
                    F.concat(acc["preds"], F.array(p)).alias("preds"),
                    values.alias("known"),
                ),
            )[0]

        return F.transform(F.array(known), grown)[0]

    start = F.struct(F.col("hist").alias("hist"), no_preds.alias("preds"), F.col("known").alias("known"))
    steps = F.sequence(F.lit(1), F.size("dates"))
    return (
        ready.filter(F.size("dates") > 0)
        .withColumn("feature_dates", feature_dates)
        .withColumn("preds", F.aggregate(steps, start, step, lambda acc: acc["preds"]))
        .select("symbol", "model", "dates", "preds", *_carried(ready))
    )


def _row_of_features(hist: np.ndarray, date, volume: float) -> np.ndarray:
    """``latest_features`` for one price window, plus the price itself."""
    now = hist[-1]
    made = {f"lag_close_{k}": hist[-1 - k] for k in LAGS}
    made |= {f"ret_{k}": now / hist[-1 - k] - 1 if hist[-1 - k] else np.nan for k in RETURNS}
    for w in WIDTHS:
        before = hist[-1 - w : -1]
        made[f"roll_mean_{w}"] = before.sum() / w
        made[f"roll_std_{w}"] = np.sqrt(((before - before.sum() / w) ** 2).sum() / (w - 1))
    made |= {"dow": date.weekday(), "month": date.month, "log_volume": np.log1p(volume)}
    return np.array([made[name] for name in FEATURES] + [now], float)


def _walk(predict, state: dict) -> list[float | None]:
    """All steps of one symbol; a step without a prediction leaves a gap that the next windows see."""
    hist = np.array([np.nan if v is None else v for v in state["hist"]], float)
    known = np.array([np.nan if v is None else v for v in state["known"]], float)
    volume = np.nan if state["volume"] is None else state["volume"]
    preds = []
    for date in [state["last_date"], *state["dates"]][: len(state["dates"])]:
        now = _row_of_features(hist, date, volume)
        known = now if np.isfinite(now).all() else known
        pred = predict(known[None, : len(FEATURES)])[0]
        pred = max(pred, PRICE_FLOOR) if np.isfinite(pred) else np.nan
        hist = np.append(hist, pred)[-DEPTH:]
        preds.append(None if np.isnan(pred) else float(pred))
    return preds


def tree_paths(states: DataFrame, models: DataFrame, name: str) -> DataFrame:
    """The same for fitted trees: a symbol's state meets its node arrays once and takes all steps there.

    Symbols without a model have no path.
    """
    carried = _carried(states)
    wanted = states.select("symbol", "hist", "volume", "last_date", "dates", "known", *carried)
    types = {f.name: f.dataType.simpleString() for f in wanted.schema}
    schema = ", ".join(["preds array<double>", "dates array<date>", "symbol string", *[f"{c} {types[c]}" for c in carried]])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left if len(right) else left.slice(0, 0)
        predict = predictor(right) if len(rows) else None
        listed = rows.to_pylist()
        preds = [_walk(predict, s) for s in listed]
        columns = [pa.array(preds, pa.list_(pa.float64())), pa.array([s["dates"] for s in listed], pa.list_(pa.date32()))]
        return pa.table([*columns, *[rows.column(c) for c in ("symbol", *carried)]], names=["preds", "dates", "symbol", *carried])

    walked = wanted.groupBy("symbol").cogroup(models.groupBy("symbol")).applyInArrow(run, schema)
    return walked.filter(F.size("dates") > 0).select("symbol", F.lit(name).alias("model"), "dates", "preds", *carried)


def all_paths(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def path_rows(paths: DataFrame) -> DataFrame:
    """One row per step: symbol, model, step, date, pred and what the path carried along."""
    zipped = F.arrays_zip(F.col("dates").alias("date"), F.col("preds").alias("pred"))
    carried = _carried(paths)
    return paths.select("symbol", "model", *carried, F.posexplode(zipped).alias("pos", "bar")).select(
        "symbol", "model", *carried, (F.col("pos") + 1).alias("step"), "bar.date", "bar.pred"
    )


def path_spread(preds: Column) -> Column:
    """Sample standard deviation of a path; NULL for a single step."""
    n = F.size(preds)
    return F.when(n > 1, F.sqrt(_square_spread(preds, _total(preds) / n) / (n - 1)))
