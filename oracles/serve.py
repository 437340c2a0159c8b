"""SQL checks for serving reads, job runs, signals, ranking, series and the stream."""

from __future__ import annotations

from oracles.common import day, parts, rd, ts, with_parts
from oracles.load import CLEAN

_RAW = {"raw": parts()["raw_supplier"]}

_JOBS = """
SELECT c_custkey AS job_id, CASE WHEN c_custkey % 10 <> 0 THEN c_mktsegment || ' ' || c_name END AS name FROM customer"""
_RUNS = """
SELECT job_id, run_id, start_time, CASE WHEN o_orderstatus <> 'P' THEN started + 3600000 END AS end_time, trigger,
  CASE WHEN run_id % 61 <> 0 THEN CASE WHEN o_orderstatus = 'P' THEN 'RUNNING'
       WHEN trigger <> '5-LOW' THEN 'TERMINATED' END END AS life,
  CASE WHEN run_id % 61 <> 0 THEN CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'FAILED' END END AS result
FROM (SELECT o_custkey - o_custkey % 2 AS job_id, o_orderkey AS run_id, o_orderstatus, o_orderpriority AS trigger,
        epoch_ms(o_orderdate) + (o_orderkey % 7) * 250 AS started,
        CASE WHEN o_orderkey % 53 = 0 THEN 0 WHEN o_orderkey % 59 <> 0
             THEN epoch_ms(o_orderdate) + (o_orderkey % 7) * 250 END AS start_time
      FROM orders)"""
_HISTORY = """
SELECT 'U' || user_id::VARCHAR AS symbol, ts AS forecast_date, (hour(ts) + 1)::BIGINT AS horizon_day,
  CASE WHEN event_id % 17 <> 0 THEN value END AS pred_close,
  value - value * (event_id % 5) * 0.004::DOUBLE AS pred_low_80, value + value * (event_id % 7) * 0.002::DOUBLE AS pred_high_80,
  event_type AS model_name, (event_id % 11) * 0.15::DOUBLE AS cv_mae, date_trunc('day', ts) AS forecast_ts
FROM events"""
_LATEST = """
SELECT CASE WHEN user_id % 41 = 0 THEN 'L' ELSE 'U' END || user_id::VARCHAR AS symbol, ts::DATE AS next_trading_day,
  CASE WHEN event_id % 19 <> 0 THEN value END AS predicted_close,
  CASE WHEN event_id % 23 <> 0 THEN value - value * (event_id % 5) * 0.004::DOUBLE END AS predicted_low_80,
  CASE WHEN event_id % 23 <> 0 THEN value + value * (event_id % 7) * 0.002::DOUBLE END AS predicted_high_80,
  event_type AS model_name, CASE WHEN event_id % 13 <> 0 THEN (event_id % 11) * 0.15::DOUBLE END AS cv_mae, ts AS exposed_ts
FROM events"""
_METRICS = """
SELECT CASE WHEN user_id % 41 = 0 THEN 'M' ELSE 'U' END || user_id::VARCHAR AS symbol, CASE WHEN event_id % 29 <> 0 THEN event_type END AS selected_model,
  CASE WHEN event_id % 31 <> 0 THEN (event_id % 11) * 0.15::DOUBLE END AS best_cv_mae,
  (event_id % 13) * 0.6::DOUBLE AS pred_std, event_id % 1000 AS train_rows,
  'run-' || (event_id + 1000000000)::VARCHAR AS pipeline_run_id, ts AS loaded_ts
FROM events"""
_ORDER = "forecast_ts DESC, horizon_day, forecast_date"

_WATCH = """
SELECT o_orderkey AS owner, 'U' || (o_custkey % 150)::VARCHAR AS selected,
  CASE o_orderstatus
    WHEN 'P' THEN list_transform(generate_series(1, 14), lambda i: 'u' || ((o_orderkey + i * 7) % 120)::VARCHAR)
    WHEN 'O' THEN [' u' || (o_custkey % 100)::VARCHAR, lower(o_orderpriority), '##', 'U' || (o_orderkey % 100)::VARCHAR, NULL]
    ELSE ['!!'] END AS saved
FROM orders"""
_CLEANED = """
SELECT owner, selected, CASE WHEN len(kept) > 0 THEN kept ELSE ['NVDA'] END AS watchlist FROM (
  SELECT owner, selected, list_filter(list_transform(saved,
      lambda s: left(regexp_replace(upper(coalesce(s, '')), '[^A-Z0-9._-]', '', 'g'), 10)), lambda s: s <> '')[1:12] AS kept
  FROM watch)"""
# First places in the merged list, by row rather than by list functions.
_ITEMS = """
SELECT owner, selected, symbol, row_number() OVER (PARTITION BY owner ORDER BY place)::INTEGER AS position FROM (
  SELECT owner, selected, symbol, min(place) AS place FROM (
    SELECT owner, selected, unnest(merged) AS symbol, generate_subscripts(merged, 1) AS place FROM (
      SELECT owner, selected, list_concat([selected], watchlist, ['NVDA', 'MSFT', 'AAPL', 'AMD', 'TSLA']) AS merged
      FROM cleaned))
  GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY owner ORDER BY place) <= 4"""
_COMPARED = """
SELECT i.*, l.symbol IS NOT NULL AS has_row, l.predicted_close, l.model_name,
  a.anchor AS anchor_close,
  CASE WHEN l.symbol IS NOT NULL THEN coalesce(l.predicted_close, 0) END AS close,
  CASE WHEN l.symbol IS NOT NULL THEN coalesce(l.cv_mae, 0) END AS cv_error,
  CASE WHEN l.symbol IS NOT NULL THEN coalesce(l.predicted_high_80, 0) - coalesce(l.predicted_low_80, 0) END AS band
FROM items i LEFT JOIN newest l ON l.symbol = i.symbol
LEFT JOIN (SELECT symbol, coalesce(predicted_close, 0) AS anchor FROM newest) a ON a.symbol = i.selected"""
_VALUED = """
SELECT *, greatest(0, CASE WHEN close <> 0 THEN band / close * 100 ELSE 0 END + coalesce(cv_error * 12, 0)) AS risk_index,
  coalesce(close - anchor_close, 0) AS delta,
  CASE WHEN anchor_close <> 0 THEN coalesce(close - anchor_close, 0) / anchor_close * 100 ELSE 0 END AS delta_pct,
  CASE WHEN close > anchor_close THEN 'up' WHEN close < anchor_close THEN 'down' ELSE 'flat' END AS delta_tone
FROM compared"""
_SIGNAL = "SELECT *, delta_pct * 1.5 - risk_index * 0.25 - coalesce(cv_error * 10, 0) * 0.4 AS signal_score FROM valued"

_PARTS = {
    "jobs": (_JOBS, ()),
    "runs": (_RUNS, ()),
    "history": (_HISTORY, ()),
    "exposed": (_LATEST, ()),
    "scores": (_METRICS, ()),
    "listed": (f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY {_ORDER}) AS rn FROM history)"
               " WHERE rn <= 60", ("history",)),
    "newest": ("SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY exposed_ts DESC)"
               " AS rn FROM exposed) WHERE rn = 1", ("exposed",)),
    "measured": ("SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY loaded_ts DESC) AS rn FROM scores"
                 " QUALIFY rn <= 20", ("scores",)),
    "first_two": ("""
SELECT symbol, max(pred_close) FILTER (rn = 1) AS first_close, max(pred_close) FILTER (rn = 2) AS second_close,
  count(*) AS listed_rows,
  CASE WHEN count(*) < 2 THEN 'flat'
       WHEN coalesce(max(pred_close) FILTER (rn = 1), 0) > coalesce(max(pred_close) FILTER (rn = 2), 0) THEN 'up'
       WHEN coalesce(max(pred_close) FILTER (rn = 1), 0) < coalesce(max(pred_close) FILTER (rn = 2), 0) THEN 'down'
       ELSE 'flat' END AS trend
FROM listed WHERE rn <= 2 GROUP BY symbol""", ("listed",)),
    "state": ("""
SELECT s.symbol, h.first_close, coalesce(h.trend, 'flat') AS trend, n.symbol IS NOT NULL AS in_latest, n.predicted_close,
  n.predicted_low_80, n.predicted_high_80, m.symbol IS NOT NULL AS has_metrics, m.best_cv_mae, m.pred_std
FROM (SELECT symbol FROM first_two UNION SELECT symbol FROM newest UNION SELECT symbol FROM measured) s
LEFT JOIN first_two h ON h.symbol = s.symbol LEFT JOIN newest n ON n.symbol = s.symbol
LEFT JOIN measured m ON m.symbol = s.symbol AND m.rn = 1""", ("first_two", "newest", "measured")),
    "card": ("""
SELECT *, trend = 'up' AS trend_up, coalesce(range_pct < 1.2, FALSE) AS tight_range, cv_mae < 1 AS low_error,
  pred_std < 5 AS healthy_volatility,
  (trend = 'up')::INT + coalesce(range_pct < 1.2, FALSE)::INT + (cv_mae < 1)::INT + (pred_std < 5)::INT AS score
FROM (SELECT *, high - low AS range, CASE WHEN close <> 0 THEN (high - low) / close * 100 END AS range_pct FROM (
  SELECT symbol, trend, CASE WHEN coalesce(predicted_close, 0) <> 0 THEN predicted_close ELSE coalesce(first_close, 0) END AS close,
    coalesce(predicted_low_80, 0) AS low, coalesce(predicted_high_80, 0) AS high, coalesce(best_cv_mae, 0) AS cv_mae,
    coalesce(pred_std, 0) AS pred_std, predicted_low_80 IS NOT NULL AND predicted_high_80 IS NOT NULL AS has_band, has_metrics
  FROM state))""", ("state",)),
    "run_states": ("""
SELECT j.job_id, r.run_id, CASE WHEN r.run_id IS NULL THEN 'NO DATA'
  ELSE coalesce(r.life, 'UNKNOWN') || ' / ' || coalesce(r.result, 'IN_PROGRESS') END AS run_state
FROM jobs j LEFT JOIN (SELECT * FROM runs QUALIFY
  row_number() OVER (PARTITION BY job_id ORDER BY start_time DESC NULLS LAST, run_id DESC) = 1) r USING (job_id)""",
                   ("jobs", "runs")),
    "alerts": ("""
SELECT c.symbol, 1 AS place, 'warn' AS tone, 'Short-term trend turned bearish' AS title,
  'Recent forecast points are moving down. Consider waiting for trend stabilization.' AS description
FROM card c WHERE trend = 'down'
UNION ALL SELECT symbol, 2, 'warn', 'Forecast uncertainty increased',
  '80% band width is ' || printf('%.1f', range_pct) || '%, which indicates wider variance than usual.'
FROM card WHERE range_pct > 1.8
UNION ALL SELECT symbol, 3, 'danger', 'Model error is elevated', 'Cross-validation MAE is ' || printf('%.4f', cv_mae)
  || '. Review the selected model and recent pipeline runs.' FROM card WHERE cv_mae > 1.0
UNION ALL SELECT c.symbol, 4, 'danger', 'Latest pipeline run failed',
  'The job did not complete successfully. Forecast freshness may be impacted.'
FROM card c JOIN run_states r ON 'U' || r.job_id::VARCHAR = c.symbol WHERE contains(r.run_state, 'FAILED')""",
               ("card", "run_states")),
    "watch": (_WATCH, ()),
    "cleaned": (_CLEANED, ("watch",)),
    "items": (_ITEMS, ("cleaned",)),
    "compared": (_COMPARED, ("items", "newest")),
    "valued": (_VALUED, ("compared",)),
    "signalled": (_SIGNAL, ("valued",)),
    "universe": ("""
SELECT *, delta_pct * 1.5 - risk_index * 0.25 - cv_error * 10 * 0.4 AS signal_score FROM (
  SELECT symbol, cv_error, CASE WHEN anchor <> 0 THEN (close - anchor) / anchor * 100 ELSE 0 END AS delta_pct,
    greatest(0, CASE WHEN close <> 0 THEN band / close * 100 ELSE 0 END + cv_error * 12) AS risk_index
  FROM (SELECT symbol, coalesce(predicted_close, 0) AS close, coalesce(cv_mae, 0) AS cv_error,
          coalesce(predicted_high_80, 0) - coalesce(predicted_low_80, 0) AS band,
          (SELECT coalesce(predicted_close, 0) FROM newest WHERE symbol = 'U1') AS anchor FROM newest))""", ("newest",)),
    "points": ("""
SELECT symbol, 'forecast' AS series, row_number() OVER (PARTITION BY symbol ORDER BY rn DESC)::INTEGER AS position,
  coalesce(pred_close, 0) AS value, 'D' || row_number() OVER (PARTITION BY symbol ORDER BY rn DESC)::VARCHAR AS label
FROM listed WHERE rn <= 30
UNION ALL SELECT symbol, 'range', rn::INTEGER, greatest(coalesce(pred_high_80, 0) - coalesce(pred_low_80, 0), 0),
  'D' || CASE WHEN coalesce(horizon_day, 0) = 0 THEN '-' ELSE horizon_day::VARCHAR END FROM listed WHERE rn <= 8
UNION ALL SELECT symbol, 'metrics', rn::INTEGER, coalesce(best_cv_mae, 0), coalesce(selected_model, 'model')
FROM measured WHERE rn <= 5""", ("listed", "measured")),
}


def _sql(body: str, *needed: str) -> str:
    return with_parts(body, *needed, **_PARTS)


def _iso(ms: str) -> str:
    whole = f"strftime(make_timestamp({ms} * 1000), '%Y-%m-%dT%H:%M:%S')"
    fraction = f"CASE WHEN {ms} % 1000 <> 0 THEN strftime(make_timestamp({ms} * 1000), '.%f') ELSE '' END"
    return f"CASE WHEN {ms} <> 0 THEN {whole} || {fraction} || '+00:00' END"


def _fresh(updated: str, now: str) -> str:
    m = f"floor((epoch_ms({now}) - epoch_ms({updated})) / 60000)::BIGINT"
    return (
        f"CASE WHEN {updated} IS NULL THEN 'No updates yet' WHEN {m} <= 0 THEN 'Updated just now'"
        f" WHEN {m} = 1 THEN 'Updated 1 minute ago' WHEN {m} < 60 THEN 'Updated ' || {m}::VARCHAR || ' minutes ago'"
        f" WHEN {m} // 60 = 1 THEN 'Updated 1 hour ago' ELSE 'Updated ' || ({m} // 60)::VARCHAR || ' hours ago' END"
    )


def _series(name: str) -> str:
    return _sql(
        f"SELECT symbol, series, position, label, {rd('value', 6)} AS value FROM points WHERE series = '{name}'", "points"
    )


_STATUS = (
    f"SELECT source_symbol, {ts('max(date)')} AS last_price_date, {ts('max(ingestion_ts)')} AS last_ingestion_ts,"
    " count(DISTINCT date) AS unique_trading_days FROM raw{} GROUP BY source_symbol"
)
_HISTORY_OUT = (
    f"symbol, {ts('forecast_date')} AS forecast_date, horizon_day, {rd('pred_close', 6)} AS pred_close,"
    f" {rd('pred_low_80', 6)} AS pred_low_80, {rd('pred_high_80', 6)} AS pred_high_80, model_name,"
    f" {rd('cv_mae', 6)} AS cv_mae, {ts('forecast_ts')} AS forecast_ts, rn::INTEGER AS rn"
)
_RANKED = ", ".join(
    f"row_number() OVER (PARTITION BY owner ORDER BY {order}symbol)::INTEGER AS {name}"
    for name, order in (
        ("signal_rank", "round(signal_score, 9) DESC NULLS LAST, "),
        ("risk_rank", "round(risk_index, 9) NULLS LAST, "),
        ("price_rank", "round(close, 9) DESC NULLS LAST, "),
        ("symbol_rank", ""),
    )
)

SQL: dict[str, str] = {
    "f1_ingestion_status": with_parts(_STATUS.format(""), "raw", **_RAW),
    "f6_forecast_summary": _sql(
        f"SELECT symbol, {rd('avg(coalesce(pred_close, 0))', 6)} AS avg_forecast,"
        f" {rd('max(coalesce(pred_close, 0))', 6)} AS max_forecast FROM listed GROUP BY symbol", "listed"),
    "f7_result_counts": _sql("SELECT symbol, count(*) AS row_count FROM listed GROUP BY symbol", "listed"),
    "h1_latest_forecast": _sql(
        f"SELECT symbol, {day('next_trading_day')} AS next_trading_day, {rd('predicted_close', 6)} AS predicted_close,"
        f" {rd('predicted_low_80', 6)} AS predicted_low_80, {rd('predicted_high_80', 6)} AS predicted_high_80, model_name,"
        f" {rd('cv_mae', 6)} AS cv_mae, {ts('exposed_ts')} AS exposed_ts FROM newest", "newest"),
    "h2_forecast_history": _sql(f"SELECT {_HISTORY_OUT} FROM listed", "listed"),
    "h3_metrics_history": _sql(
        f"SELECT symbol, selected_model, {rd('best_cv_mae', 6)} AS best_cv_mae, {rd('pred_std', 6)} AS pred_std, train_rows,"
        f" pipeline_run_id, {ts('loaded_ts')} AS loaded_ts, rn::INTEGER AS rn FROM measured", "measured"),
    "h4_symbol_status": with_parts(_STATUS.format(" WHERE source_symbol = 'S7'"), "raw", **_RAW),
    "i1_job_search": _sql(
        "SELECT job_id, name FROM jobs WHERE contains(lower(coalesce(name, '')), 'building customer')", "jobs"),
    "i1_job_list": _sql("SELECT job_id, name FROM jobs", "jobs"),
    "i2_job_lookup": _sql("SELECT job_id, name FROM jobs WHERE job_id = 42", "jobs"),
    "i3_recent_runs": _sql(
        f"SELECT job_id, run_id, trigger, {_iso('start_time')} AS start_time_iso, {_iso('end_time')} AS end_time_iso"
        " FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY start_time DESC NULLS LAST, run_id DESC) AS rn"
        " FROM runs) WHERE rn <= 20", "runs"),
    "i4_latest_run_state": _sql("SELECT job_id, run_id, run_state FROM run_states", "run_states"),
    "i5_run_table": _sql(
        "SELECT job_id, run_id, coalesce(life, '-') AS life_cycle, coalesce(result, 'IN_PROGRESS') AS result, start_time,"
        " end_time FROM runs", "runs"),
    "i5_run_id_tail": _sql("SELECT symbol, pipeline_run_id, right(pipeline_run_id, 10) AS run_id_tail FROM scores", "scores"),
    "j1_trend": _sql(
        f"SELECT symbol, {rd('first_close', 6)} AS first_close, {rd('second_close', 6)} AS second_close, listed_rows, trend"
        " FROM first_two", "first_two"),
    "j2_latest_close": _sql(
        "SELECT symbol, " + rd("CASE WHEN coalesce(first_close, 0) <> 0 THEN first_close ELSE coalesce(predicted_close, 0) END", 6)
        + " AS latest_close FROM state", "state"),
    "j3_scorecard": _sql(
        f"SELECT symbol, trend, {rd('close', 6)} AS close, {rd('low', 6)} AS low, {rd('high', 6)} AS high,"
        f" {rd('cv_mae', 6)} AS cv_mae, {rd('pred_std', 6)} AS pred_std, has_band, has_metrics, {rd('range', 6)} AS range,"
        f" {rd('range_pct', 6)} AS range_pct, trend_up, tight_range, low_error, healthy_volatility, score FROM card", "card"),
    "j4_decision": _sql(
        "SELECT symbol, score, CASE WHEN score >= 3 THEN 'BUY' WHEN score = 2 THEN 'HOLD' ELSE 'AVOID' END AS decision,"
        " least(92, greatest(40, 48 + 12 * score))::INTEGER AS confidence FROM card", "card"),
    "j5_alerts": _sql(
        "SELECT symbol, position, tone, title, description FROM (SELECT *, row_number() OVER (PARTITION BY symbol"
        " ORDER BY place)::INTEGER AS position FROM alerts) WHERE position <= 3", "alerts"),
    "d4_lookup_join": _sql(
        f"SELECT owner, position, symbol, has_row, {rd('predicted_close', 6)} AS predicted_close, model_name FROM compared",
        "compared"),
    "d5_anchor_join": _sql(
        f"SELECT symbol, {rd('predicted_close', 6)} AS predicted_close, (SELECT {rd('coalesce(predicted_close, 0)', 6)}"
        " FROM newest WHERE symbol = 'U1') AS anchor_close FROM newest", "newest"),
    "d5_anchor_by_owner": _sql(
        f"SELECT owner, symbol, {rd('predicted_close', 6)} AS predicted_close, {rd('anchor_close', 6)} AS anchor_close"
        " FROM compared", "compared"),
    "j6_comparison_symbols": _sql("SELECT owner, selected, position, symbol FROM items", "items"),
    "j7_watchlist": _sql("SELECT owner, array_to_string(watchlist, ',') AS watchlist FROM cleaned", "cleaned"),
    "j7_watchlist_toggle": _sql("""
SELECT owner, array_to_string(CASE WHEN list_contains(watchlist, selected)
    THEN CASE WHEN len(list_filter(watchlist, lambda s: s <> selected)) > 0
              THEN list_filter(watchlist, lambda s: s <> selected) ELSE ['NVDA'] END
    ELSE list_prepend(selected, watchlist)[1:12] END, ',') AS watchlist FROM cleaned""", "cleaned"),
    "j8_risk_index": _sql(
        f"SELECT owner, symbol, {rd('close', 6)} AS close, {rd('risk_index', 6)} AS risk_index FROM valued", "valued"),
    "j9_delta": _sql(
        f"SELECT owner, symbol, {rd('delta', 6)} AS delta, {rd('delta_pct', 6)} AS delta_pct, delta_tone FROM valued", "valued"),
    "j10_signal_score": _sql(
        f"SELECT symbol, {rd('delta_pct', 6)} AS delta_pct, {rd('risk_index', 6)} AS risk_index,"
        f" {rd('signal_score', 6)} AS signal_score FROM universe", "universe"),
    "j11_ranking": _sql(f"SELECT owner, symbol, {_RANKED} FROM signalled", "signalled"),
    "j12_range_cut": _sql(
        f"SELECT s.size, l.symbol, l.rn::INTEGER AS rn, {rd('l.pred_close', 6)} AS pred_close FROM listed l"
        " JOIN (VALUES (7), (30), (60), (0)) s(size) ON s.size = 0 OR l.rn <= s.size", "listed"),
    "j13_trajectory": _series("forecast"),
    "j14_band_width": _series("range"),
    "j15_model_error": _series("metrics"),
    "j16_insights": _sql(f"""
SELECT s.symbol, n.series, {rd('p.latest', 6)} AS latest, {rd('p.lowest', 6)} AS lowest, {rd('p.highest', 6)} AS highest
FROM (SELECT DISTINCT symbol FROM history) s CROSS JOIN (VALUES ('forecast'), ('range'), ('metrics')) n(series)
LEFT JOIN (SELECT symbol, series, arg_max(value, position) AS latest, min(value) AS lowest, max(value) AS highest
           FROM points GROUP BY ALL) p ON p.symbol = s.symbol AND p.series = n.series""", "history", "points"),
    "j17_freshness": _sql(
        f"SELECT s.symbol, {_fresh('u.updated', chr(39).join(('TIMESTAMP ', '2024-01-31', '')))} AS freshness FROM"
        " (SELECT DISTINCT symbol FROM history) s"
        " LEFT JOIN (SELECT symbol, max(exposed_ts) AS updated FROM exposed GROUP BY symbol) u ON u.symbol = s.symbol",
        "history", "exposed"),
    "j17_freshness_minutes": _sql(
        "SELECT symbol, freshness, count(*) AS row_count FROM (SELECT symbol, "
        + _fresh("forecast_date", "(date_trunc('hour', forecast_date) + INTERVAL 61 MINUTES)")
        + " AS freshness FROM history) GROUP BY ALL", "history"),
    "l1_upsert_stream": with_parts(f"SELECT {CLEAN} FROM clean", "clean"),
    "l1_stream_rejects": with_parts(
        f"SELECT {day('ingestion_date')} AS ingestion_date, quality_issue, count(*) AS reject_rows"
        " FROM (SELECT DISTINCT * FROM labelled WHERE NOT is_valid) r GROUP BY r.ingestion_date, quality_issue", "labelled"),
}

SQL |= {
    "f1_status_from_summaries": SQL["f1_ingestion_status"],
    "h4_status_from_summaries": SQL["h4_symbol_status"],
    "l1_keyed_stream": SQL["l1_upsert_stream"],
}
