"""Features, folds, candidates, recursion, calendar against pandas, numpy and counting by hand."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlake.learners import linear, trees
from barlake.operators import calendar, features, forecast as FC, increments, recursion, selection, splits
from barlake.plans import forecasting
from oracles.common import holidays as listed_holidays

START = dt.date(2020, 1, 1)


def price_frame(symbol: str, n: int, seed: int = 0, split_at: int | None = None) -> pd.DataFrame:
    """A random walk on consecutive days; before ``split_at`` the unadjusted close is ten times higher."""
    rng = np.random.default_rng(seed)
    price = 100 + rng.normal(0, 1, n).cumsum()
    adj = pd.Series(price)
    close = adj.copy()
    if split_at is not None:
        close[:split_at] *= 10
    return pd.DataFrame(
        {
            "symbol": symbol, "date": [START + dt.timedelta(i) for i in range(n)], "close": close, "adj_close": adj,
            "volume": rng.integers(0, 1000, n),
        }
    )


def daily(spark, *frames):
    return spark.createDataFrame(pd.concat(frames), "symbol string, date date, close double, adj_close double, volume bigint")


def by_pandas(frame: pd.DataFrame) -> pd.DataFrame:
    x = frame.reset_index(drop=True).copy()
    p = x["adj_close"].fillna(x["close"])
    out = {f"lag_close_{k}": p.shift(k) for k in features.LAGS}
    out |= {f"ret_{k}": p / p.shift(k) - 1 for k in features.RETURNS}
    for w in features.WIDTHS:
        out[f"roll_mean_{w}"] = p.shift(1).rolling(w).mean()
        out[f"roll_std_{w}"] = p.shift(1).rolling(w).std()
    dates = pd.to_datetime(x["date"])
    out |= {"dow": dates.dt.dayofweek, "month": dates.dt.month, "log_volume": np.log(1 + x["volume"])}
    made = pd.DataFrame(out)[list(features.FEATURES)].astype(float)
    return made.assign(target=x["close"].shift(-1), date=x["date"])


def test_matrix_equals_pandas(spark):
    frames = [price_frame(f"S{n}", n, n) for n in (49, 50, 51, 52, 301)]
    frames += [price_frame("SPLIT", 120, 7, 60), price_frame("GAPS", 120, 8).assign(adj_close=lambda d: d["adj_close"].where(d.index % 3 > 0))]
    frames.append(price_frame("BARE", 90, 9).assign(adj_close=np.nan))
    made = features.feature_matrix(daily(spark, *frames).select("symbol", "date", "close", F.nanvl("adj_close", F.lit(None)).alias("adj_close"), "volume"))
    got = made.toPandas()
    for frame in frames:
        symbol = frame["symbol"].iloc[0]
        mine = got[got["symbol"] == symbol].sort_values("date").reset_index(drop=True)
        theirs = by_pandas(frame)
        for name in (*features.FEATURES, "target"):
            np.testing.assert_allclose(mine[name].astype(float), theirs[name], rtol=1e-9, atol=1e-9, err_msg=f"{symbol} {name}")


def test_complete_rows_equal_dropna_on_all_columns(spark):
    frame = price_frame("A", 150)
    frame.loc[[60, 90], "adj_close"] = 0.0
    matrix = features.feature_matrix(daily(spark, frame, price_frame("B", 50), price_frame("C", 52)))
    every = matrix.dropna(subset=[*features.FEATURES, "target"]).select("symbol", "date").collect()
    assert sorted(every) == sorted(features.training_rows(matrix).select("symbol", "date").collect())
    full = matrix.dropna(subset=list(features.FEATURES)).groupBy("symbol").agg(F.max("date")).collect()
    assert sorted(full) == sorted(features.scoring_rows(matrix).select("symbol", "date").collect())


def test_minimum_history(spark):
    matrix = features.feature_matrix(daily(spark, price_frame("SHORT", 300), price_frame("LONG", 301), price_frame("TINY", 3)))
    assert {r.symbol: (r.train_rows, r.reason) for r in features.history_check(matrix).collect()} == {
        "SHORT": (249, "insufficient_history"), "LONG": (250, None), "TINY": (0, "insufficient_history"),
    }
    train = features.training_rows(matrix)
    assert {r.symbol for r in features.enough_history(train).select("symbol").distinct().collect()} == {"LONG"}
    with pytest.raises(ValueError, match="SHORT"):
        features.enough_history(train.filter("symbol = 'SHORT'"), strict=True)
    with pytest.raises(ValueError):
        features.enough_history(train.filter("symbol = 'NONE'"), strict=True)


@pytest.mark.parametrize("n", [250, 251, 255, 256, 299])
def test_folds(spark, n):
    segmented = splits.with_segments(spark.range(n).select(F.lit("A").alias("symbol"), F.col("id").alias("date")))
    got = dict(segmented.groupBy("segment").agg(F.struct(F.min("pos"), F.max("pos"))).collect())
    size = n // 6
    expected = {i: (n - 5 * size + (i - 1) * size, n - 5 * size + i * size - 1) for i in range(1, 6)}
    assert {k: tuple(v) for k, v in got.items()} == {0: (0, n - 5 * size - 1), **expected}


def test_no_fold_trains_on_its_future(spark):
    bounds = splits.fold_bounds(forecasting.segmented_rows(daily(spark, price_frame("A", 400), price_frame("B", 333, 2)))).collect()
    assert len(bounds) == 10
    assert all(b.train_end < b.test_start <= b.test_end for b in bounds)


def sequential_net(x, y, alpha, l1_ratio, sweeps=5000, tol=1e-4):
    """Plain coordinate descent on the residual, one problem, row by row."""
    n, k = x.shape
    xm, ym = x.mean(0), y.mean()
    x, y = x - xm, y - ym
    w, r = np.zeros(k), y.copy()
    l1, l2 = alpha * l1_ratio * n, alpha * (1 - l1_ratio) * n
    for _ in range(sweeps):
        widest = biggest = 0.0
        for j in range(k):
            old, norm = w[j], x[:, j] @ x[:, j]
            if norm == 0:
                continue
            rho = x[:, j] @ r + norm * old
            w[j] = np.sign(rho) * max(abs(rho) - l1, 0) / (norm + l2)
            r += x[:, j] * (old - w[j])
            widest, biggest = max(widest, abs(w[j] - old)), max(biggest, abs(w[j]))
        if biggest == 0 or widest / biggest < tol:
            dual = np.abs(x.T @ r - l2 * w).max()
            c = l1 / dual if dual > l1 else 1.0
            gap = 0.5 * (1 + c * c) * (r @ r + l2 * (w @ w)) + l1 * np.abs(w).sum() - c * (r @ y)
            if gap <= tol * (y @ y):
                break
    return w, ym - w @ xm


def test_elastic_net_equals_plain_descent(spark):
    frames = [price_frame("A", 330, 1), price_frame("B", 400, 2, 200)]
    segmented = forecasting.segmented_rows(daily(spark, *frames)).checkpoint()
    rows = segmented.toPandas().sort_values(["symbol", "date"])
    for fit in linear.elastic_net_fits(segmented).collect():
        part = rows[(rows["symbol"] == fit.symbol) & (rows["segment"] < fit.fit)]
        w, b = sequential_net(part[list(features.FEATURES)].to_numpy(), part["target"].to_numpy(), linear.ALPHA, linear.L1_RATIO)
        assert fit.train_rows == len(part)
        mine = part[list(features.FEATURES)].to_numpy() @ np.array(fit.coef) + fit.intercept
        theirs = part[list(features.FEATURES)].to_numpy() @ w + b
        np.testing.assert_allclose(mine, theirs, rtol=2e-5)


def test_solver_needs_no_package_on_the_workers():
    """Unpickling it in a Python that cannot see this repository works."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    code = "import sys, pickle; f = pickle.load(sys.stdin.buffer); print(f.__name__, 'barlake' in sys.modules)"
    out = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(linear._solve), cwd="/", capture_output=True, check=True)
    assert out.stdout.decode().split() == ["_solve", "False"]


def walk_by_pandas(frame, sessions, predict):
    """Rebuilds every feature over the whole history at each step."""
    history, preds = frame.copy(), []
    for day in sessions:
        made = by_pandas(history).replace([np.inf, -np.inf], np.nan).dropna(subset=list(features.FEATURES))
        pred = max(float(predict(made.iloc[[-1]][list(features.FEATURES)], history)), 0.01)
        preds.append(pred)
        bar = {"symbol": "A", "date": day, "close": pred, "adj_close": pred, "volume": history["volume"].iloc[-1]}
        history = pd.concat([history, pd.DataFrame([bar])], ignore_index=True)
    return preds


def test_linear_recursion_equals_rebuilding_features(spark):
    frame = price_frame("A", 320, 3)
    coef = np.random.default_rng(5).normal(0, 0.05, len(features.FEATURES))
    coef[0] = 0.9
    states = recursion.start_states(daily(spark, frame), calendar.holidays(spark, 1990, 2060), 12)
    fits = spark.createDataFrame([("A", "m", 1.5, coef.tolist())], "symbol string, model string, intercept double, coef array<double>")
    path = recursion.linear_paths(states, fits).first()
    expected = walk_by_pandas(frame, path.dates, lambda x, _: x.to_numpy()[0] @ coef + 1.5)
    np.testing.assert_allclose(path.preds, expected, rtol=1e-9)


@pytest.mark.parametrize("back, column, value", [(1, "adj_close", 0.0), (5, "adj_close", 0.0), (0, "volume", None), (30, "adj_close", 0.0)])
def test_recursion_starts_from_the_newest_complete_bar(spark, back, column, value):
    frame = price_frame("A", 320, 3)
    frame[column] = frame[column].astype(object)
    frame.loc[len(frame) - 1 - back, column] = value
    coef = np.random.default_rng(5).normal(0, 0.05, len(features.FEATURES))
    coef[0] = 0.9
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in frame.itertuples(index=False)]
    bars = spark.createDataFrame(rows, "symbol string, date date, close double, adj_close double, volume bigint")
    states = recursion.start_states(bars, calendar.holidays(spark, 1990, 2060), 8)
    fits = spark.createDataFrame([("A", "m", 1.5, coef.tolist())], "symbol string, model string, intercept double, coef array<double>")
    path = recursion.linear_paths(states, fits).first()
    plain = frame.astype({"adj_close": float, "volume": float})
    expected = walk_by_pandas(plain, path.dates, lambda x, _: x.to_numpy()[0] @ coef + 1.5)
    np.testing.assert_allclose(path.preds, expected, rtol=1e-9)


def test_matrix_by_loads_equals_the_whole_one(spark):
    """Loads of unequal length, corrections inside the overlap, a symbol that joins late, an empty load."""
    frames = [price_frame("A", 200, 1, 90), price_frame("B", 70, 2), price_frame("C", 130, 3)]
    frames[2]["date"] = [d + dt.timedelta(75) for d in frames[2]["date"]]
    whole = pd.concat(frames, ignore_index=True)
    wrong = whole.assign(close=whole["close"] + 1, adj_close=whole["adj_close"] + 1)
    state, closed, since = spark.createDataFrame([], increments.STATE_DDL), [], START
    for days in (30, 95, 96, 97, 160, 160, 300):
        until = START + dt.timedelta(days)
        # The newest bar of a load is wrong at first; the next load brings it again, corrected.
        part = pd.concat([whole[(whole.date >= since) & (whole.date < until)], wrong[wrong.date == until]])
        done = increments.step(state, daily(spark, part))
        assert done.late.count() == 0
        closed += done.closed.collect()
        state, since = done.state.checkpoint(), until - dt.timedelta(6)
    assert state.groupBy("symbol").count().agg(F.max("count")).first()[0] <= increments.DEPTH + 8
    rows = closed + increments.open_rows(state).select(done.closed.columns).collect()
    names = done.closed.columns
    want = features.feature_matrix(daily(spark, whole)).select(names).collect()
    key = lambda r: (r.symbol, r.date)
    assert sorted(rows, key=key) == sorted(want, key=key)
    late = increments.step(state, daily(spark, frames[0][:5]))
    assert late.late.count() == 5 and late.closed.count() == 0


def test_co_moments_merge_like_one_pass(spark):
    """Stored sums plus those of new bars are the sums of all bars, also at high price levels."""
    frames = [price_frame(s, 200, i) for i, s in enumerate("AB")]
    frames[1][["close", "adj_close"]] += 1e7
    rows = features.training_rows(features.feature_matrix(daily(spark, *frames)))
    cut = F.col("date") < F.lit(START + dt.timedelta(120))
    parts = linear.co_moments(rows.where(cut), "symbol").unionByName(linear.co_moments(rows.where(~cut), "symbol"))
    got = {r.symbol: r for r in linear.merge_moments(parts, "symbol").collect()}
    for symbol, part in rows.toPandas().groupby("symbol"):
        x = part[[*features.FEATURES, "target"]].to_numpy(float)
        upper = np.triu_indices(x.shape[1])
        np.testing.assert_allclose(got[symbol].mean, x.mean(axis=0), rtol=1e-12)
        scale = np.sqrt(np.outer(x.var(axis=0), x.var(axis=0)))[upper] * len(x) + 1e-9
        off = (np.array(got[symbol].moment) - (np.cov(x.T, ddof=0) * len(x))[upper]) / scale
        assert got[symbol].n == len(x) and np.abs(off).max() < 1e-6


def test_price_floor(spark):
    states = recursion.start_states(daily(spark, price_frame("A", 320)), calendar.holidays(spark, 1990, 2060), 3)
    fits = spark.createDataFrame([("A", "m", -5.0, [0.0] * 19)], "symbol string, model string, intercept double, coef array<double>")
    assert recursion.linear_paths(states, fits).first().preds == [0.01] * 3


@pytest.mark.parametrize("candidate", [trees.random_forest(20, 4), trees.gradient_boosting(5)])
def test_tree_recursion_equals_rebuilding_features(spark, candidate):
    frame = price_frame("A", 320, 4)
    bars = daily(spark, frame)
    segmented = forecasting.segmented_rows(bars)
    models = trees.final_fit(trees.training_frame(segmented), candidate).checkpoint()
    path = recursion.tree_paths(recursion.start_states(bars, calendar.holidays(spark, 1990, 2060), 3), models, candidate.name).first()

    def predict(x, history):
        row = spark.createDataFrame(x.assign(adj_close=history["adj_close"].iloc[-1]))
        return trees.predict_rows(models, row.withColumn("symbol", F.lit("A"))).first().pred

    np.testing.assert_allclose(path.preds, walk_by_pandas(frame, path.dates, predict), rtol=1e-9)


def test_full_run(spark):
    bars = daily(spark, price_frame("A", 330, 1), price_frame("B", 330, 2), price_frame("SHORT", 100, 3))
    run = forecasting.FullRun(bars, [trees.random_forest(20, 4), trees.gradient_boosting(2)], 77, horizon=6)
    oof = run.oof.groupBy("symbol", "model", "fold").count().collect()
    assert len(oof) == 2 * 3 * 5 and {r["count"] for r in oof} == {279 // 6}
    rows = run.forecast.orderBy("symbol", "horizon_day").collect()
    assert [(r.symbol, r.horizon_day) for r in rows] == [(s, h) for s in "AB" for h in range(1, 7)]
    closed = set(listed_holidays())
    for r in rows:
        assert r.pred_low_80 <= r.pred_high_80 and r.pred_close >= 0.01 and r.pipeline_run_id == "77"
        assert r.forecast_date.weekday() < 5 and r.forecast_date.date() not in closed
    best = {r.symbol: r for r in run.scored.groupBy("symbol").agg(F.min("cv_mae").alias("m")).collect()}
    for m in run.metrics.collect():
        assert m.best_cv_mae == best[m.symbol].m and m.train_rows == 279
    assert run.record.filter("kind = 'metric' AND key LIKE 'cv_mae_%'").count() == 6


def test_excluded_symbols(spark):
    """Every symbol without a published forecast has its reason; none of them is in the forecast."""
    flat = price_frame("FLAT", 330, 4)
    flat[["close", "adj_close"]] = 50.0
    zero, hole, sold = (price_frame(s, 330, i) for i, s in enumerate(("ZERO", "HOLE", "SOLD"), 5))
    zero.loc[100, "close"] = 0.0
    sold.loc[7, "volume"] = -1
    hole = hole.astype({"volume": object})
    hole.loc[9, "volume"] = None
    frames = pd.concat([price_frame("GOOD", 330, 1), price_frame("SHORT", 100, 2), flat, zero, sold, hole])
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in frames.itertuples(index=False)]
    bars = spark.createDataFrame(rows, "symbol string, date date, close double, adj_close double, volume bigint")
    run = forecasting.CheckRun(bars, horizon=5)
    assert dict(run.excluded.collect()) == {
        "SHORT": "insufficient_history", "FLAT": "flat_forecast", "ZERO": "close_not_positive", "SOLD": "volume_negative",
        "HOLE": "null_values",
    }
    assert {r.symbol for r in run.forecast.collect()} == {r.symbol for r in run.metrics.collect()} == {"GOOD"}


def test_one_symbol(spark):
    run = forecasting.FullRun(daily(spark, price_frame("A", 310, 1)), [trees.gradient_boosting(2)], horizon=2)
    assert run.forecast.count() == 2 and run.forecast.first().pipeline_run_id == "interactive"


def oof_frame(spark, rows):
    return spark.createDataFrame(rows, "symbol string, model string, model_order int, fold int, residual double")


def test_scores_use_the_mean_of_fold_errors(spark):
    rows = [("A", "m", 1, 1, 1.0)] * 3 + [("A", "m", 1, 2, -5.0)]
    scored = selection.residual_bounds(oof_frame(spark, rows)).first()
    assert (scored.cv_mae, scored.q_low, scored.q_high, scored.residual_rows) == (3.0, -3.0, 3.0, 4)
    assert selection.cv_mae(selection.fold_mae(oof_frame(spark, rows))).first().cv_mae == 3.0


@pytest.mark.parametrize("n", [29, 30])
def test_band_from_quantiles_needs_thirty_residuals(spark, n):
    residuals = [float(i * i) for i in range(n)]
    scored = selection.residual_bounds(oof_frame(spark, [("A", "m", 1, 1 + i % 5, r) for i, r in enumerate(residuals)])).first()
    expected = np.quantile(residuals, [0.1, 0.9]) if n >= 30 else (-scored.cv_mae, scored.cv_mae)
    np.testing.assert_allclose([scored.q_low, scored.q_high], expected)


def test_earlier_candidate_wins_a_tie(spark):
    rows = [("A", "late", 2, 1, 1.0), ("A", "early", 1, 1, -1.0), ("B", "late", 2, 1, 0.5), ("B", "early", 1, 1, 1.0)]
    chosen = selection.choose_model(selection.residual_bounds(oof_frame(spark, rows)))
    assert {r.symbol: r.model for r in chosen.collect()} == {"A": "early", "B": "late"}


def test_band_is_put_in_order(spark):
    made = selection.band(F.lit(10.0), F.lit(2.0), F.lit(-1.0))
    row = spark.range(1).select(*[c.alias(n) for n, c in made.items()]).first()
    assert (row.pred_low_80, row.pred_high_80) == (9.0, 12.0)


def test_flat_guard(spark):
    rows = [("FLAT", 5.0), ("FLAT", 5.0), ("ONE", 5.0), ("MOVES", 5.0), ("MOVES", 6.0)]
    forecast = spark.createDataFrame(rows, "symbol string, pred_close double")
    assert {r.symbol: r.is_flat for r in FC.flat_check(forecast).collect()} == {"FLAT": True, "ONE": False, "MOVES": False}
    with pytest.raises(FC.FlatForecast, match="FLAT"):
        FC.require_moving(forecast)
    assert FC.require_moving(forecast.filter("symbol <> 'FLAT'")).count() == 3


def test_holidays_equal_the_listed_ones(spark):
    got = {r.date for r in calendar.holidays(spark, 1994, 2030).collect()}
    assert got == set(listed_holidays(1994, 2030))


def test_sessions(spark):
    last = spark.createDataFrame(
        [("FRI", dt.date(2024, 3, 28)), ("XMAS", dt.date(2024, 12, 24)), ("PLAIN", dt.date(2024, 6, 3))], "symbol string, last_date date"
    )
    got = calendar.sessions_after(last, calendar.holidays(spark, 1990, 2060), 2).collect()
    assert {(r.symbol, r.step): r.date for r in got} == {
        ("FRI", 1): dt.date(2024, 4, 1), ("FRI", 2): dt.date(2024, 4, 2),
        ("XMAS", 1): dt.date(2024, 12, 26), ("XMAS", 2): dt.date(2024, 12, 27),
        ("PLAIN", 1): dt.date(2024, 6, 4), ("PLAIN", 2): dt.date(2024, 6, 5),
    }
    cut = calendar.sessions_after(last.filter("symbol = 'PLAIN'"), calendar.holidays(spark, 1990, 2060), 30, search_days=10).count()
    assert cut == 8


def test_run_id():
    assert (FC.resolve_run_id(), FC.resolve_run_id(5)) == ("interactive", "5")
