"""Signals, ranking, series, runs, serving: the odd cases, on small tables."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barlake.functions.times import freshness_text, iso_from_millis
from barlake.operators import ranking, runs, series, serving, signals

T = dt.datetime(2024, 1, 10)
LATEST = ("symbol string, next_trading_day date, predicted_close double, predicted_low_80 double, predicted_high_80 double,"
          " model_name string, cv_mae double, exposed_ts timestamp")
HISTORY = ("symbol string, forecast_date timestamp, horizon_day bigint, pred_close double, pred_low_80 double,"
           " pred_high_80 double, model_name string, cv_mae double, forecast_ts timestamp")
METRICS = ("symbol string, selected_model string, best_cv_mae double, pred_std double, train_rows bigint,"
           " pipeline_run_id string, loaded_ts timestamp")


def latest(spark, *rows):
    return spark.createDataFrame([(s, T.date(), c, lo, hi, "m", e, T) for s, c, lo, hi, e in rows], LATEST)


def history(spark, *rows):
    """(symbol, horizon, price[, run offset in days])"""
    full = [(r[0], T, r[1], r[2], None if r[2] is None else r[2] - 1, None if r[2] is None else r[2] + 1, "m", 1.0,
             T + dt.timedelta(r[3] if len(r) > 3 else 0)) for r in rows]
    return spark.createDataFrame(full, HISTORY)


def metrics(spark, *rows):
    return spark.createDataFrame([(s, m, e, sd, 300, f"run-{i}", T + dt.timedelta(hours=i)) for i, (s, m, e, sd) in enumerate(rows)], METRICS)


def test_trend_compares_the_listed_order(spark):
    rows = history(
        spark, ("UP", 1, 11.0), ("UP", 2, 10.0), ("DOWN", 1, 9.0), ("DOWN", 2, 10.0), ("ONE", 1, 5.0),
        ("NULLS", 1, None), ("NULLS", 2, -1.0), ("RUNS", 1, 1.0), ("RUNS", 2, 2.0), ("RUNS", 1, 8.0, 1), ("RUNS", 2, 3.0, 1),
        ("EVEN", 1, 4.0), ("EVEN", 2, 4.0),
    )
    got = {r.symbol: r.trend for r in signals.trend(signals.leading_rows(rows)).collect()}
    assert got == {"UP": "up", "DOWN": "down", "ONE": "flat", "NULLS": "up", "RUNS": "up", "EVEN": "flat"}


def test_scorecard_without_data_scores_two(spark):
    state = signals.symbol_state(latest(spark, ("A", None, None, None, None)), history(spark, ("B", 1, 10.0)), metrics(spark, ("C", "m", 2.0, 9.0)))
    card = {r.symbol: r for r in signals.decision(signals.scorecard(state)).collect()}
    a, b, c = card["A"], card["B"], card["C"]
    assert (a.close, a.range_pct, a.tight_range, a.low_error, a.healthy_volatility, a.score) == (0.0, None, False, True, True, 2)
    assert (a.decision, a.confidence, a.has_band, a.has_metrics) == ("HOLD", 72, False, False)
    # A price without a band has a band of nothing, which counts as tight.
    assert (b.close, b.range_pct, b.tight_range, b.score, b.decision, b.confidence) == (10.0, 0.0, True, 3, "BUY", 84)
    assert (c.score, c.decision, c.confidence, c.has_metrics) == (0, "AVOID", 48, True)


def test_best_score(spark):
    state = signals.symbol_state(
        latest(spark, ("A", 100.0, 99.5, 100.5, 0.5)), history(spark, ("A", 1, 11.0), ("A", 2, 10.0)), metrics(spark, ("A", "m", 0.5, 1.0))
    )
    row = signals.decision(signals.scorecard(state)).first()
    assert (row.score, row.decision, row.confidence, row.range_pct) == (4, "BUY", 92, 1.0)
    assert signals.latest_close(state).first().latest_close == 11.0


def test_alerts_in_order_and_at_most_three(spark):
    state = signals.symbol_state(
        latest(spark, ("A", 100.0, 98.0, 102.0, 0.5), ("Q", 100.0, 99.25, 100.75, 0.5)),
        history(spark, ("A", 1, 9.0), ("A", 2, 10.0)), metrics(spark, ("A", "m", 1.23456, 1.0), ("Q", "m", 1.0, 1.0)),
    )
    states = spark.createDataFrame([("A", "TERMINATED / FAILED"), ("Q", "TERMINATED / FAILED")], "symbol string, run_state string")
    got = [tuple(r) for r in signals.alerts(signals.scorecard(state), states).orderBy("symbol", "position").collect()]
    assert [(g[0], g[1], g[2]) for g in got] == [("A", 1, "warn"), ("A", 2, "warn"), ("A", 3, "danger"), ("Q", 1, "danger")]
    assert got[1][4].startswith("80% band width is 4.0%,") and "MAE is 1.2346." in got[2][4]
    assert got[3][3] == "Latest pipeline run failed"


def lists(spark, *rows):
    return spark.createDataFrame(list(rows), "owner bigint, selected string, saved array<string>").select(
        "owner", "selected", ranking.clean_watchlist(F.col("saved")).alias("watchlist")
    )


def test_watchlists(spark):
    many = [f"s{i}" for i in range(20)]
    got = {r.owner: r for r in lists(spark, (1, "A", []), (2, "A", None), (3, "A", [" a!", None, "##", "a", "abcdefghijklm"]), (4, "A", many)).collect()}
    assert got[1].watchlist == got[2].watchlist == ["NVDA"]
    assert got[3].watchlist == ["A", "A", "ABCDEFGHIJ"]
    assert got[4].watchlist == [f"S{i}" for i in range(12)]


def test_toggle(spark):
    rows = lists(spark, (1, "A", ["a"]), (2, "B", ["a"]), (3, "A", ["a", "b", "a"]), (4, "Z", [f"s{i}" for i in range(12)]))
    got = {r[0]: r[1] for r in rows.select("owner", ranking.toggle_symbol(F.col("watchlist"), F.col("selected"))).collect()}
    assert got[1] == ["NVDA"] and got[2] == ["B", "A"] and got[3] == ["B"]
    assert got[4] == ["Z", *[f"S{i}" for i in range(11)]]


def test_comparison_symbols(spark):
    got = {}
    for r in ranking.comparison_items(lists(spark, (1, "A", ["b", "a", "b"]), (2, "", ["x"]), (3, "NVDA", []))).collect():
        got.setdefault(r.owner, {})[r.position] = r.symbol
    assert got[1] == {1: "A", 2: "B", 3: "NVDA", 4: "MSFT"}
    assert got[2] == {1: "X", 2: "NVDA", 3: "MSFT", 4: "AAPL"}
    assert got[3] == {1: "NVDA", 2: "MSFT", 3: "AAPL", 4: "AMD"}


def compared(spark, selected="A", weights=ranking.Weights()):
    rows = latest(spark, ("A", 100.0, 99.0, 101.0, 0.5), ("B", 110.0, 105.0, 115.0, None), ("N", None, 1.0, 2.0, 0.1))
    items = ranking.lookup_latest(ranking.comparison_items(lists(spark, (1, selected, ["b", "n", "x"]))), rows)
    valued = ranking.with_delta(ranking.with_risk(ranking.anchor_by_owner(items)))
    return {r.symbol: r for r in ranking.ranked(ranking.with_signal(valued, weights)).collect()}


def test_comparison_maths(spark):
    got = compared(spark)
    a, b, n, x = got["A"], got["B"], got["N"], got["X"]
    assert (a.delta, a.delta_pct, a.delta_tone, a.risk_index, a.signal_score) == (0.0, 0.0, "flat", 8.0, -4.0)
    assert (b.delta, b.delta_pct, b.delta_tone) == (10.0, 10.0, "up")
    assert b.risk_index == pytest.approx(100 * 10 / 110) and b.cv_error == 0.0
    # A missing price inside a row is 0 (and has no band); a missing row has no price at all.
    assert (n.close, n.delta, n.delta_tone, n.risk_index) == (0.0, -100.0, "down", pytest.approx(1.2))
    assert (x.close, x.cv_error, x.delta, x.delta_pct, x.delta_tone, x.risk_index, x.has_row) == (None, None, 0.0, 0.0, "flat", 0.0, False)
    assert [got[s].price_rank for s in "BANX"] == [1, 2, 3, 4]
    assert [got[s].symbol_rank for s in "ABNX"] == [1, 2, 3, 4]
    assert [got[s].risk_rank for s in "XNAB"] == [1, 2, 3, 4]
    assert [got[s].signal_rank for s in "BXAN"] == [1, 2, 3, 4]


def test_missing_or_zero_anchor(spark):
    for r in compared(spark, "GONE").values():
        assert (r.delta, r.delta_pct, r.delta_tone, r.anchor_close) == (0.0, 0.0, "flat", None)
    zero = compared(spark, "N")
    assert (zero["B"].delta, zero["B"].delta_pct, zero["B"].delta_tone) == (110.0, 0.0, "up")


def test_one_anchor_for_all(spark):
    rows = latest(spark, ("A", 100.0, 99.0, 101.0, 0.5), ("B", 110.0, 105.0, 115.0, None))
    assert {r.anchor_close for r in ranking.anchor_for_all(rows, "A").collect()} == {100.0}
    assert {r.anchor_close for r in ranking.anchor_for_all(rows, "GONE").collect()} == {None}
    plan = ranking.anchor_for_all(rows, "A")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize(
    "saved, expected",
    [
        (None, (1.0, 0.25, 0.4)), ({"delta": 0, "risk": 5, "mae": -1}, (1.0, 2.0, 0.4)),
        ({"delta": "0.5", "risk": "x", "mae": float("nan")}, (0.5, 0.25, 0.4)),
    ],
)
def test_saved_weights(saved, expected):
    w = ranking.weights_from_saved(saved)
    assert (w.delta, w.risk, w.mae) == expected


def test_direct_weights_only_clamp():
    w = ranking.Weights(0.0, 3.0, -1.0)
    assert (w.delta, w.risk, w.mae) == (0.0, 2.0, 0.0)


def test_orders_of_all_rows(spark):
    rows = spark.createDataFrame(
        [("A", 1.0, 3.0, 5.0), ("B", 2.0, 1.0, None), ("C", 2.0, 2.0, 9.0)], "symbol string, signal_score double, risk_index double, close double"
    )
    order = lambda name: "".join(r.symbol for r in ranking.sorted_by(rows, name).collect())
    assert [order(n) for n in ("signal", "risk", "price_desc", "symbol", "?")] == ["BCA", "BCA", "CAB", "ABC", "BCA"]


def test_series_and_insights(spark):
    listed = serving.forecast_history(history(spark, *[("A", h, float(h) if h != 2 else None) for h in range(1, 11)]))
    cut = series.range_cut(listed, 7)
    line = [(r.position, r.label, r.value) for r in series.trajectory(cut).orderBy("position").collect()]
    assert line[0] == (1, "D1", 7.0) and line[-1] == (7, "D7", 1.0) and line[5] == (6, "D6", 0.0)
    assert series.range_cut(listed, 0).count() == 10
    bands = series.band_width(listed)
    assert bands.count() == 8 and {r.value for r in bands.collect()} == {0.0, 2.0}
    errors = series.model_error(serving.metrics_history(metrics(spark, *[("A", None, float(i), 1.0) for i in range(7)])))
    assert {r.label for r in errors.collect()} == {"model"}
    symbols = spark.createDataFrame([("A",), ("Z",)], "symbol string")
    got = {(r.symbol, r.series): (r.latest, r.lowest, r.highest) for r in series.insights(symbols, series.trajectory(cut), bands, errors).collect()}
    assert got[("A", "forecast")] == (1.0, 0.0, 7.0)
    assert got[("A", "metrics")] == (2.0, 2.0, 6.0)
    assert got[("Z", "forecast")] == got[("Z", "range")] == got[("Z", "metrics")] == (None, None, None)
    summary = series.forecast_summary(listed).first()
    assert (summary.avg_forecast, summary.max_forecast) == (5.3, 10.0)


def test_limits():
    assert serving.checked_limit(None, serving.HISTORY_LIMIT) == 60
    for n, bounds in ((0, serving.RUNS_LIMIT), (101, serving.RUNS_LIMIT), (501, serving.HISTORY_LIMIT), (201, serving.METRICS_LIMIT)):
        with pytest.raises(ValueError):
            serving.checked_limit(n, bounds)


def test_publish_and_read_back(spark, namespace):
    forecast = spark.createDataFrame(
        [("A", T, 1, 5.0, 4.0, 6.0, "m", 0.5, "r"), ("A", T + dt.timedelta(1), 2, 5.5, 4.0, 6.0, "m", 0.5, "r")],
        "symbol string, forecast_date timestamp, horizon_day bigint, pred_close double, pred_low_80 double, pred_high_80 double,"
        " model_name string, cv_mae double, pipeline_run_id string",
    )
    done = spark.createDataFrame([("A", "m", 0.5, 0.3, 250, "r")], "symbol string, selected_model string, best_cv_mae double, pred_std double, train_rows bigint, pipeline_run_id string")
    for hour in (1, 2, 2):
        serving.publish(forecast, done, namespace, T + dt.timedelta(hours=hour))
    assert spark.table(f"{namespace}.forecast_history").count() == 4
    assert spark.table(f"{namespace}.forecast_metrics").count() == 2
    assert serving.metrics_history(spark.table(f"{namespace}.forecast_metrics"), 1).first().loaded_ts == T + dt.timedelta(hours=2)
    row = serving.latest_forecast(spark.table(f"{namespace}.forecast_latest"), "A").first()
    assert (row.predicted_close, row.next_trading_day, row.exposed_ts) == (5.0, T.date(), T + dt.timedelta(hours=2))
    first = serving.forecast_history(spark.table(f"{namespace}.forecast_history"), 2, "A").orderBy("rn").collect()
    assert [(r.horizon_day, r.forecast_ts.hour) for r in first] == [(1, 2), (2, 2)]


@pytest.mark.parametrize("ms", [None, 0, 1704067200000, 1704067200250, 1704067200001, -1500, 253402300799000])
def test_iso_text_equals_python(spark, ms):
    got = spark.createDataFrame([(ms,)], "ms bigint").select(iso_from_millis(F.col("ms"))).first()[0]
    epoch = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    assert got == (None if ms in (None, 0) else (epoch + dt.timedelta(milliseconds=ms)).isoformat())


def test_iso_text_in_another_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = spark.createDataFrame([("1704067200250",), ("soon",)], "ms string").select(iso_from_millis(F.col("ms"))).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [r[0] for r in rows] == ["2024-01-01T00:00:00.250000+00:00", None]


@pytest.mark.parametrize(
    "seconds, text",
    [(-5, "just now"), (59, "just now"), (60, "1 minute ago"), (119, "1 minute ago"), (3599, "59 minutes ago"),
     (3600, "1 hour ago"), (7199, "1 hour ago"), (7200, "2 hours ago"), (360000, "100 hours ago")],
)
def test_freshness(spark, seconds, text):
    row = spark.range(1).select(freshness_text(F.lit(T), F.lit(T + dt.timedelta(seconds=seconds)))).first()
    assert row[0] == f"Updated {text}"


def test_never_updated(spark):
    assert spark.range(1).select(freshness_text(F.lit(None).cast("timestamp"), F.lit(T))).first()[0] == "No updates yet"


def test_runs(spark):
    jobs = spark.createDataFrame([(1, ("Nightly LOAD",)), (2, (None,)), (3, ("other",))], "job_id bigint, settings struct<name string>")
    assert {r.job_id for r in runs.search_jobs(jobs, " load ").collect()} == {1}
    assert runs.search_jobs(jobs, "  ").count() == 3
    assert runs.job_by_id(jobs, 2).first().settings.name is None
    state = "struct<life_cycle_state string, result_state string>"
    rows = spark.createDataFrame(
        [(1, 10, 1000, None, ("TERMINATED", "FAILED")), (1, 11, 2000, 2500, ("RUNNING", None)), (1, 12, None, None, None), (2, 13, None, None, None)],
        f"job_id bigint, run_id bigint, start_time bigint, end_time bigint, state {state}",
    )
    got = {r.job_id: (r.run_id, r.run_state) for r in runs.latest_run_state(jobs, rows).collect()}
    assert got == {1: (11, "RUNNING / IN_PROGRESS"), 2: (13, "UNKNOWN / IN_PROGRESS"), 3: (None, "NO DATA")}
    assert [r.run_id for r in runs.recent_runs(rows, 2, 1).orderBy(F.desc_nulls_last("start_time")).collect()] == [11, 10]
    table = {r.run_id: (r.life_cycle, r.result) for r in runs.run_table(rows).collect()}
    assert table[12] == ("-", "IN_PROGRESS") and table[10] == ("TERMINATED", "FAILED")
    tails = spark.createDataFrame([("abcdefghijkl",), ("x",), (None,), ("",)], "id string").select(runs.id_tail(F.col("id"))).collect()
    assert [t[0] for t in tails] == ["cdefghijkl", "x", "-", "-"]


def test_ingestion_status(spark):
    raw = spark.createDataFrame(
        [("A", T, T), ("A", T, T + dt.timedelta(1)), ("A", None, None), ("B", T, T)], "source_symbol string, date timestamp, ingestion_ts timestamp"
    )
    a = serving.ingestion_status(raw, "A").first()
    assert (a.last_price_date, a.last_ingestion_ts, a.unique_trading_days) == (T, T + dt.timedelta(1), 1)
    assert serving.ingestion_status(raw).count() == 2
