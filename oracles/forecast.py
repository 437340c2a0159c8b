"""SQL checks for folds, selection, forecasts and the run record."""

from __future__ import annotations

from oracles.common import HORIZON, LEARNERS, RUN_ID, day, parts, rd, ts, with_parts

_RAW = {"raw": parts()["raw_supplier"]}
_SLOPE = "b"
_FORECAST = (
    f"symbol, {ts('forecast_date')} AS forecast_date, horizon_day, {rd('pred_close', 4)} AS pred_close,"
    f" {rd('pred_low_80', 4)} AS pred_low_80, {rd('pred_high_80', 4)} AS pred_high_80, model_name,"
    f" {rd('cv_mae', 4)} AS cv_mae"
)
_METRICS = (
    f"symbol, selected_model, {rd('best_cv_mae', 4)} AS best_cv_mae, {rd('pred_std', 4)} AS pred_std,"
    " train_rows, pipeline_run_id"
)
_SCORED = f"{rd('cv_mae', 4)} AS cv_mae, residual_rows::BIGINT AS residual_rows, {rd('q_low', 4)} AS q_low, {rd('q_high', 4)} AS q_high"
_PUBLISHED = "'2024-02-01 06:00:00'"


def _record() -> str:
    def row(kind: str, key: str, number: str = "NULL", text: str = "NULL") -> str:
        return (
            f"SELECT symbol, '{kind}' AS kind, '{key}' AS key, {number}::DOUBLE AS number, {text}::VARCHAR AS text FROM joined"
        )

    rows = [
        row("param", "symbol", text="symbol"),
        row("param", "forecast_horizon", str(HORIZON)),
        row("param", "min_std_threshold", "0.0001"),
        row("param", "pipeline_run_id", text=f"'{RUN_ID}'"),
        row("param", "train_rows", "train_rows"),
        row("param", "feature_count", "19"),
        row("metric", "best_cv_mae", "best_cv_mae"),
        row("metric", "pred_std", "pred_std"),
        row("metric", "forecast_rows", "forecast_rows"),
        row("tag", "selected_model", text="selected_model"),
        "SELECT symbol, 'metric', 'cv_mae_' || model, cv_mae, NULL FROM bands",
    ]
    return with_parts(
        f"SELECT '{RUN_ID}' AS run_id, symbol, kind, key, {rd('number', 4)} AS number, text FROM ({' UNION ALL '.join(rows)})",
        "joined", "bands",
        joined=("SELECT m.*, f.forecast_rows FROM metrics m JOIN (SELECT symbol, count(*) AS forecast_rows"
                " FROM forecast GROUP BY symbol) f USING (symbol)", ("metrics", "forecast")),
    )


SQL: dict[str, str] = {
    "c4_enough_history": with_parts(
        f"SELECT symbol, {day('date')} AS date, {rd('target', 6)} AS target, train_rows FROM sized", "sized", **_RAW),
    "c5_flat_guard": with_parts(
        f"SELECT symbol, {rd('s', 4)} AS pred_std, n AS forecast_rows, coalesce(s < 100.0, FALSE) AS is_flat FROM"
        " (SELECT symbol, stddev_samp(pred_close) AS s, count(*) AS n FROM forecast GROUP BY symbol)", "forecast"),
    "c5_moving_forecast": with_parts(
        f"SELECT symbol, horizon_day, {rd('pred_close', 4)} AS pred_close FROM forecast SEMI JOIN (SELECT symbol FROM forecast"
        " GROUP BY symbol HAVING NOT coalesce(stddev_samp(pred_close) < 100.0, FALSE)) USING (symbol)", "forecast"),
    "f2_fold_mae": with_parts(
        f"SELECT symbol, model, model_order, fold::INTEGER AS fold, {rd('mae', 4)} AS mae, n AS row_count FROM fold_mae", "fold_mae"),
    "f3_cv_mae": with_parts(
        f"SELECT symbol, model, model_order, {rd('cv_mae', 4)} AS cv_mae, residual_rows::BIGINT AS residual_rows FROM cv", "cv"),
    "f4_residual_bounds": with_parts(f"SELECT symbol, model, model_order, {_SCORED} FROM bands", "bands"),
    "f5_dispersion": with_parts(
        f"SELECT symbol, {rd('stddev_samp(pred_close)', 4)} AS pred_std, count(*) AS forecast_rows FROM forecast GROUP BY symbol",
        "forecast"),
    "g1_time_folds": with_parts(
        f"SELECT symbol, {day('date')} AS date, pos::INTEGER AS pos, train_rows, segment::INTEGER AS segment FROM blocks", "blocks"),
    "g1_fold_bounds": with_parts(f"""
SELECT b.symbol, f.fold::INTEGER AS fold, count(*) FILTER (pos < n - (6 - f.fold) * (n // 6)) AS train_rows,
  count(*) FILTER (pos >= n - (6 - f.fold) * (n // 6)) AS test_rows,
  {day('max(date) FILTER (pos < n - (6 - f.fold) * (n // 6))')} AS train_end,
  {day('min(date) FILTER (pos >= n - (6 - f.fold) * (n // 6))')} AS test_start,
  {day('max(date)')} AS test_end
FROM (SELECT *, train_rows AS n FROM blocks) b JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS fold) f
  ON b.pos < n - (5 - f.fold) * (n // 6)
GROUP BY b.symbol, f.fold""", "blocks"),
    "g2_check_fits": with_parts(
        f"SELECT symbol, model, fit, n AS train_rows, {rd('b', 6)} AS slope, {rd('a', 4)} AS intercept FROM coefs", "coefs"),
    "g5_candidate_roster": with_parts("""
SELECT symbol, model, model_order, train_rows, 6 AS fit_count
FROM (SELECT symbol, count(*) AS train_rows FROM sized GROUP BY symbol)
CROSS JOIN (VALUES ('elastic_net', 1), ('random_forest', 2), ('gradient_boosting', 3),
  ('second_order_boosting', 4)) m(model, model_order)""", "sized"),
    "g6_out_of_fold": with_parts(
        f"SELECT symbol, model, model_order, fold::INTEGER AS fold, {day('date')} AS date, {rd('y', 4)} AS y, {rd('pred', 4)} AS pred,"
        f" {rd('residual', 4)} AS residual FROM oof", "oof"),
    "g7_model_choice": with_parts(f"SELECT symbol, model, model_order, {_SCORED} FROM chosen", "chosen"),
    "g8_refit": with_parts(
        f"SELECT symbol, model, n AS train_rows, {rd('b', 6)} AS slope, {rd('a', 4)} AS intercept FROM coefs"
        " SEMI JOIN chosen USING (symbol, model) WHERE fit = 6", "coefs", "chosen"),
    "g9_band": with_parts(
        f"SELECT o.symbol, {day('o.date')} AS date, {rd('least(o.pred + c.q_low, o.pred + c.q_high)', 4)} AS pred_low_80,"
        f" {rd('greatest(o.pred + c.q_low, o.pred + c.q_high)', 4)} AS pred_high_80"
        " FROM oof o JOIN chosen c ON c.symbol = o.symbol AND c.model = o.model", "oof", "chosen"),
    "g10_recursive_path": with_parts(
        f"SELECT symbol, model_name, horizon_day, {rd('pred_close', 4)} AS pred_close FROM forecast", "forecast"),
    "g11_sessions": with_parts(f"SELECT symbol, {day('date')} AS date, step::INTEGER AS step FROM sessions", "sessions", **_RAW),
    "g12_forecast_rows": with_parts(f"SELECT {_FORECAST}, pipeline_run_id FROM forecast", "forecast"),
    "g13_metrics_rows": with_parts(f"SELECT {_METRICS} FROM metrics", "metrics"),
    "g14_experiment_record": _record(),
    "g15_run_id": with_parts(
        "SELECT symbol, model AS selected_model, run AS pipeline_run_id FROM chosen"
        " CROSS JOIN (VALUES ('interactive'), ('90125')) r(run)", "chosen"),
    "h5_publish_latest": with_parts(
        f"SELECT symbol, {day('forecast_date')} AS next_trading_day, {rd('pred_close', 4)} AS predicted_close,"
        f" {rd('pred_low_80', 4)} AS predicted_low_80, {rd('pred_high_80', 4)} AS predicted_high_80, model_name,"
        f" {rd('cv_mae', 4)} AS cv_mae, {_PUBLISHED} AS exposed_ts FROM forecast WHERE horizon_day = 1", "forecast"),
    "h5_publish_history": with_parts(f"SELECT {_FORECAST}, {_PUBLISHED} AS forecast_ts FROM forecast", "forecast"),
    "h5_publish_metrics": with_parts(f"SELECT {_METRICS}, {_PUBLISHED} AS loaded_ts FROM metrics", "metrics"),
}

SQL |= {f"h5_published_{part}": SQL[f"h5_publish_{part}"] for part in ("latest", "history", "metrics")}

_NAMES = [
    *[f"lag_close_{k}" for k in (1, 2, 3, 5, 10, 20)], "ret_1", "ret_5",
    *[f"roll_{kind}_{w}" for w in (5, 10, 20, 50) for kind in ("mean", "std")], "dow", "month", "log_volume", "target",
]
SQL["g2_co_moments"] = with_parts(
    " UNION ALL ".join(
        f"SELECT symbol, segment::INTEGER AS segment, n AS row_count, '{a}' AS feature_a, '{b}' AS feature_b,"
        f" {rd(f'mean_{a}', 4)} AS mean_a, {rd(f'corr_{a}_{b}', 6)} AS correlation FROM wide"
        for i, a in enumerate(_NAMES) for b in _NAMES[i + 1 :]
    ),
    "wide",
    wide=(
        "SELECT symbol, segment, count(*) AS n, "
        + ", ".join(f"avg({a}) AS mean_{a}" for a in _NAMES)
        + ", "
        + ", ".join(f"corr({a}, {b}) AS corr_{a}_{b}" for i, a in enumerate(_NAMES) for b in _NAMES[i + 1 :])
        + " FROM blocks GROUP BY symbol, segment",
        ("blocks",),
    ),
)
