"""SQL checks for load, quality, dedup, upsert and feature queries."""

from __future__ import annotations

from oracles.common import FEATURE_NAMES, VERSION_ORDER, day, holidays, newest_version, parts, rd, ts, with_parts


def _r(names, digits=6) -> str:
    return ", ".join(f"{rd(n, digits)} AS {n}" for n in names)


PRICES = ("open", "high", "low", "close", "adj_close")
CLEAN = (
    f"symbol, {day('date')} AS date, {_r(PRICES)}, volume, source_system, source_interval,"
    f" {ts('ingestion_ts')} AS ingestion_ts, {day('ingestion_date')} AS ingestion_date, ingestion_run_id"
)
DAILY = f"symbol, {day('date')} AS date, {_r(('close', 'adj_close'))}, volume"
_RAW = {"raw": parts()["raw_supplier"]}

# Row-level answers keep NaN out: the raw side shows NaN as the text 'NaN' on both engines otherwise.
_TEXT_BAR = ", ".join(f"CASE WHEN isnan({c}) THEN NULL ELSE {rd(c, 6)} END AS {c}" for c in (*PRICES, "volume"))


def _matrix(name: str, **extra) -> str:
    special = {"ret_1": None, "ret_5": None, **{f"roll_std_{w}": 4 for w in (5, 10, 20, 50)}}
    cols = ", ".join(f"{rd(n, special.get(n, 6))} AS {n}" for n in ("close", "adj_close", *FEATURE_NAMES, "target"))
    return with_parts(f"SELECT symbol, {day('date')} AS date, volume, {cols} FROM {name}", name, **extra)


def _feature(names, digits=6) -> str:
    return with_parts(f"SELECT symbol, {day('date')} AS date, {_r(names, digits)} FROM matrix", "matrix")


_UPSERT = {
    "stored": (newest_version("(SELECT * FROM valid WHERE ingestion_run_id <> 'run-2')"), ("valid",)),
    "fresh": (newest_version("(SELECT * FROM valid WHERE ingestion_run_id = 'run-2')"), ("valid",)),
    "merged": ("""
SELECT t.* FROM stored t LEFT JOIN fresh s ON t.symbol = s.symbol AND t.date = s.date
WHERE NOT coalesce(s.ingestion_ts >= t.ingestion_ts, FALSE)
UNION ALL
SELECT s.* FROM fresh s LEFT JOIN stored t ON t.symbol = s.symbol AND t.date = s.date
WHERE t.symbol IS NULL OR coalesce(s.ingestion_ts >= t.ingestion_ts, FALSE)""", ("stored", "fresh")),
}

_STAMPED = (
    f"SELECT source_symbol, {ts('date')} AS date, {_r(('open', 'high', 'low'))},"
    f" {rd('close', 6)} AS close, {rd('adj_close', 6)} AS adj_close, {rd('volume', 6)} AS volume"
)

SQL: dict[str, str] = {
    "a1_price_source": with_parts(
        f"{_STAMPED}, {ts('ingestion_ts')} AS ingestion_ts FROM raw"
        " WHERE source_symbol IN ('AF', 'NO', 'RF') AND date >= TIMESTAMP '1998-01-01'", "raw"),
    "a2_plain_headers": with_parts(f"SELECT source_symbol, {ts('date')} AS date, {_TEXT_BAR} FROM raw", "raw"),
    "a3_lineage_stamp": with_parts(
        f"{_STAMPED}, 'files' AS source_system, '1d' AS source_interval, 'run-42' AS ingestion_run_id,"
        " '2024-01-31 18:30:00' AS ingestion_ts, '2024-01-31' AS ingestion_date FROM raw", "raw"),
    "a4_append_sink": with_parts(
        "SELECT strftime(DATE '2024-01-31' + k, '%Y-%m-%d') AS ingestion_date, 'load-' || k::VARCHAR AS ingestion_run_id,"
        f" row_count, top_high FROM (SELECT right(ingestion_run_id, 1)::INTEGER AS k, count(*) AS row_count,"
        f" {rd('max(high)', 6)} AS top_high FROM raw GROUP BY 1)", "raw"),
    "a5_incremental_start": with_parts(
        "SELECT r.symbol, strftime(coalesce(m.mark, DATE '1999-01-01'), '%Y-%m-%d') AS fetch_start FROM"
        " (SELECT 'S' || s_suppkey::VARCHAR AS symbol FROM supplier UNION ALL SELECT 'NVDA' UNION ALL SELECT 'MSFT') r"
        " LEFT JOIN (SELECT source_symbol AS symbol, (max(date)::DATE - 7)::DATE AS mark FROM raw GROUP BY 1) m"
        " ON m.symbol = r.symbol", "raw", **_RAW),
    "a5_incremental_start_whole_table": with_parts(
        "SELECT s.symbol, (SELECT strftime((max(date)::DATE - 7)::DATE, '%Y-%m-%d') FROM raw) AS fetch_start"
        " FROM (VALUES ('S1'), ('NVDA')) s(symbol)", "raw", **_RAW),
    "a6_fixed_tables": with_parts(
        f"SELECT symbol, count(*) AS row_count, {day('max(date)')} AS last_date FROM clean GROUP BY symbol", "clean"),
    "a7_clustered_write": with_parts(
        f"SELECT quality_issue, count(*) AS row_count, {day('min(ingestion_date)')} AS first_date,"
        f" {day('max(ingestion_date)')} AS last_date FROM labelled WHERE NOT is_valid GROUP BY 1", "labelled"),
    "a8_reject_append": with_parts(
        f"SELECT symbol, {day('date')} AS date, {ts('ingestion_ts')} AS ingestion_ts, ingestion_run_id, quality_issue"
        " FROM labelled WHERE NOT is_valid", "labelled"),
    "a8_reject_append_parts": with_parts(
        "SELECT quality_issue, count(*) AS reject_rows FROM (SELECT DISTINCT * FROM labelled WHERE NOT is_valid)"
        " GROUP BY quality_issue", "labelled"),
    "a9_snapshot_overwrite": with_parts(f"SELECT {DAILY} FROM daily", "daily"),
    "a10_named_view": with_parts(
        f"SELECT symbol, year(date)::INTEGER AS year, count(*) AS bar_count, {rd('max(high)', 6)} AS top_high"
        " FROM clean GROUP BY 1, 2", "clean"),
    "a11_newest_raw": with_parts(
        f"SELECT source_symbol, {ts('ingestion_ts')} AS ingestion_ts, {_r(('open', 'high'))} FROM (SELECT * FROM raw ORDER BY "
        + ", ".join(f"{c} DESC NULLS LAST" for c in ("ingestion_ts", "source_symbol", "open", "high", "low", "volume"))
        + " LIMIT 20)", "raw"),
    "a11_newest_clean": with_parts(
        f"SELECT symbol, {day('date')} AS date, {rd('close', 6)} AS close, volume"
        " FROM (SELECT * FROM clean ORDER BY date DESC, symbol LIMIT 20)", "clean"),
    "a12_load_counts": with_parts(
        "SELECT count(*) AS total_rows, count(*) FILTER (is_valid) AS valid_rows,"
        " count(*) FILTER (NOT is_valid) AS rejected_rows FROM labelled", "labelled"),
    "b1_column_pick": with_parts(
        f"SELECT source_symbol, {ts('date')} AS picked_date, {rd('adj_close', 6)} AS picked_adj_close,"
        " NULL::VARCHAR AS picked_dividend FROM raw", "raw"),
    "b2_conform": with_parts(f"SELECT {CLEAN} FROM conformed", "conformed"),
    "b2_conform_plain_headers": with_parts(f"SELECT {CLEAN} FROM conformed", "conformed"),
    "b3_to_date": with_parts(
        f"SELECT {day('date::DATE')} AS price_date, count(*) AS row_count FROM raw GROUP BY date::DATE", "raw"),
    "b4_of_symbol": with_parts(f"SELECT {DAILY} FROM daily WHERE symbol = 'RF'", "daily"),
    "b5_check_symbols": """
SELECT o_orderkey, symbol, regexp_full_match(symbol, '[A-Z0-9._-]{1,10}') AS is_valid FROM (
  SELECT o_orderkey, upper(regexp_replace(CASE o_orderkey % 4
    WHEN 0 THEN ' ' || chr(9) || lower(o_orderpriority) || chr(10)
    WHEN 1 THEN 'u' || o_custkey::VARCHAR || ' '
    WHEN 2 THEN 'brk.b_' || o_orderkey::VARCHAR
    ELSE 'a b' || o_orderstatus END, '^\\s+|\\s+$', '', 'g')) AS symbol FROM orders)""",
    "b6_lenient_symbols": """
SELECT * FROM (SELECT p_partkey,
  left(regexp_replace(upper(' ' || p_brand || '~' || p_name), '[^A-Z0-9._-]', '', 'g'), 10) AS symbol,
  left(regexp_replace(upper(CASE WHEN p_size > 25 THEN '#! ' ELSE p_name END), '[^A-Z0-9._-]', '', 'g'), 10) AS short
  FROM part) WHERE short <> ''""",
    "b7_adjusted_prices": with_parts(
        f"SELECT symbol, {day('date')} AS date, {rd('close', 6)} AS close,"
        f" {rd('coalesce(adj_close, close)', 6)} AS adj_close, volume FROM daily", "daily"),
    "b7_adjusted_report": with_parts(
        "SELECT symbol, count(*) AS row_count, count(*) FILTER (adj_close IS NULL) AS filled_rows,"
        " bool_and(adj_close IS NULL) AS all_missing FROM daily GROUP BY symbol", "daily"),
    "b8_bounded_limit": with_parts(
        f"SELECT symbol, {day('date')} AS date, {rd('close', 6)} AS close FROM (SELECT *, row_number() OVER"
        " (PARTITION BY symbol ORDER BY date DESC) AS rn FROM daily) WHERE rn <= 100", "daily", **_RAW),
    "c1_quality_label": with_parts(
        f"SELECT symbol, {day('date')} AS date, {ts('ingestion_ts')} AS ingestion_ts, {_r(('high', 'low'))}, volume,"
        " quality_issue, is_valid FROM labelled", "labelled"),
    "c2_valid_rows": with_parts(f"SELECT {CLEAN} FROM valid", "valid"),
    "c2_rejected_rows": with_parts(f"SELECT {CLEAN}, quality_issue, is_valid FROM labelled WHERE NOT is_valid", "labelled"),
    "c3_series_checks": with_parts("""
SELECT *, null_date + null_close + null_adj_close + null_volume + close_not_positive + volume_negative = 0 AS is_usable
FROM (SELECT symbol, count(*) AS row_count, count(*) FILTER (date IS NULL) AS null_date,
  count(*) FILTER (close IS NULL) AS null_close,
  count(*) FILTER (coalesce(adj_close, close) IS NULL) AS null_adj_close,
  count(*) FILTER (volume IS NULL) AS null_volume, count(*) FILTER (close <= 0) AS close_not_positive,
  count(*) FILTER (volume < 0) AS volume_negative FROM conformed GROUP BY symbol)""", "conformed", **_RAW),
    "c3_excluded_symbols": with_parts("""
SELECT s.symbol, CASE WHEN nulls > 0 THEN 'null_values' WHEN low > 0 THEN 'close_not_positive'
    WHEN negative > 0 THEN 'volume_negative' ELSE 'insufficient_history' END AS reason
FROM (SELECT symbol, count(*) FILTER (close IS NULL OR volume IS NULL OR coalesce(adj_close, close) IS NULL) AS nulls,
             count(*) FILTER (close <= 0) AS low, count(*) FILTER (volume < 0) AS negative
      FROM clean GROUP BY symbol) s
LEFT JOIN (SELECT symbol, count(*) AS n FROM train GROUP BY symbol) t USING (symbol)
WHERE nulls + low + negative > 0 OR coalesce(n, 0) < 250""", "clean", "train", **_RAW,
        clean=(newest_version("conformed WHERE symbol IS NOT NULL AND date IS NOT NULL"), ("conformed",)),
        # The logarithm of a negative volume is an error here; such symbols are left out for that volume anyway.
        daily=("SELECT symbol, date, close, adj_close, CASE WHEN volume < 0 THEN 0 ELSE volume END AS volume FROM clean",
               ("clean",))),
    "c4_history_check": with_parts("""
SELECT s.symbol, coalesce(t.n, 0) AS train_rows,
       CASE WHEN coalesce(t.n, 0) < 250 THEN 'insufficient_history' END AS reason
FROM (SELECT DISTINCT symbol FROM matrix) s LEFT JOIN (SELECT symbol, count(*) AS n FROM train GROUP BY symbol) t
ON t.symbol = s.symbol""", "matrix", "train", **_RAW),
    "c6_reject_summary": with_parts(
        f"SELECT quality_issue, {day('ingestion_date')} AS ingestion_date, count(*) AS row_count"
        " FROM labelled WHERE NOT is_valid GROUP BY quality_issue, labelled.ingestion_date", "labelled"),
    "d1_latest_version": with_parts(f"SELECT {CLEAN} FROM clean", "clean"),
    "d2_last_per_date": with_parts(
        f"SELECT {DAILY} FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY volume DESC,"
        " close DESC, adj_close DESC NULLS LAST) AS rn FROM valid) WHERE rn = 1", "valid"),
    "d2_last_loaded": with_parts(
        f"SELECT {DAILY} FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY ingestion_ts DESC NULLS LAST,"
        " volume DESC, close DESC, adj_close DESC NULLS LAST) AS rn FROM valid) WHERE rn = 1", "valid"),
    "d3_conditional_upsert": with_parts(f"SELECT {CLEAN} FROM merged", "merged", **_UPSERT),
    "d3_upsert_table": with_parts(f"SELECT {CLEAN} FROM merged", "merged", **_UPSERT),
    "d6_without_holidays": with_parts(
        f"SELECT DISTINCT symbol, {day('date')} AS date FROM daily WHERE date NOT IN (SELECT date FROM holidays)",
        "daily", "holidays"),
    "e1_target": _feature(["target"]),
    "e2_lags": _feature([f"lag_close_{k}" for k in (1, 2, 3, 5, 10, 20)]),
    "e3_returns": _feature(["ret_1", "ret_5"], None),
    "e4_roll_mean": _feature([f"roll_mean_{w}" for w in (5, 10, 20, 50)]),
    "e5_roll_std": _feature([f"roll_std_{w}" for w in (5, 10, 20, 50)], 4),
    "e6_calendar_parts": with_parts(
        f"SELECT symbol, {day('date')} AS date, dow::INTEGER AS dow, month::INTEGER AS month FROM matrix", "matrix"),
    "e7_log_volume": _feature(["log_volume"]),
    "e8_feature_matrix": _matrix("matrix"),
    "e8_feature_matrix_suppliers": _matrix("matrix", **_RAW),
    "e9_training_rows": _matrix("train"),
    "e10_scoring_rows": _matrix("newest_full", newest_full=(
        "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn"
        " FROM matrix WHERE roll_std_50 IS NOT NULL) WHERE rn = 1", ("matrix",))),
}

SQL |= {
    "a5_start_from_summaries": SQL["a5_incremental_start"],
    "a7_space_filling": with_parts(
        f"SELECT {day('ingestion_date')} AS ingestion_date, quality_issue, count(*) AS row_count FROM labelled"
        " WHERE NOT is_valid GROUP BY 1, 2", "labelled"),
    "a12_one_pass_load": SQL["a12_load_counts"],
    "e8_incremental_matrix": SQL["e8_feature_matrix"],
}
