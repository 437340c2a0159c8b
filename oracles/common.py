"""Shared WITH parts of the SQL checks. Each part names the parts it reads."""

from __future__ import annotations

import datetime as dt


def rd(expr: str, digits: int | None) -> str:
    """Rounded, with minus zero written as zero; as it is without digits."""
    if digits is None:
        return expr
    return f"(CASE WHEN round({expr}, {digits}) = 0 THEN 0.0::DOUBLE ELSE round({expr}, {digits}) END)"


def ts(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def day(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d')"


def _raw(symbol: str) -> str:
    return f"""
SELECT CASE WHEN l_orderkey % 211 <> 0 THEN {symbol} END AS source_symbol,
       CASE WHEN l_orderkey % 199 <> 0 THEN l_shipdate END AS date,
       CASE WHEN l_orderkey % 97 <> 0 THEN l_extendedprice * (1.0::DOUBLE - l_discount) END AS open,
       CASE WHEN l_orderkey % 101 = 0 THEN l_extendedprice * (0.9::DOUBLE - l_discount)
            ELSE l_extendedprice * (1.1::DOUBLE + l_tax) END AS high,
       CASE WHEN l_orderkey % 101 = 0 THEN l_extendedprice * (1.1::DOUBLE + l_tax)
            ELSE l_extendedprice * (0.9::DOUBLE - l_discount) END AS low,
       CASE WHEN l_orderkey % 113 = 0 THEN 'nan'::DOUBLE ELSE l_extendedprice END AS close,
       CASE WHEN l_orderkey % 7 = 0 OR (l_returnflag = 'N' AND l_linestatus = 'F') THEN NULL
            WHEN l_shipdate < TIMESTAMP '1998-07-01' THEN l_extendedprice * 0.5::DOUBLE
            ELSE l_extendedprice END AS adj_close,
       CASE WHEN l_orderkey % 107 = 0 THEN 'nan'::DOUBLE
            WHEN l_orderkey % 103 = 0 THEN -l_quantity ELSE l_quantity END AS volume,
       'tpch_lineitem' AS source_system, '1d' AS source_interval,
       'run-' || (l_orderkey % 3)::VARCHAR AS ingestion_run_id,
       CASE WHEN l_orderkey % 223 <> 0
            THEN l_shipdate + to_minutes((l_linenumber * 60 + l_orderkey % 60)::BIGINT) END AS ingestion_ts,
       l_shipdate::DATE AS ingestion_date
FROM lineitem"""


CONFORM = """
SELECT source_symbol AS symbol, date::DATE AS date,
       CASE WHEN isnan(open) THEN NULL ELSE open END AS open,
       CASE WHEN isnan(high) THEN NULL ELSE high END AS high,
       CASE WHEN isnan(low) THEN NULL ELSE low END AS low,
       CASE WHEN isnan(close) THEN NULL ELSE close END AS close,
       CASE WHEN isnan(adj_close) THEN NULL ELSE adj_close END AS adj_close,
       CASE WHEN isnan(volume) THEN NULL ELSE volume::BIGINT END AS volume,
       source_system, source_interval, ingestion_ts, ingestion_date, ingestion_run_id
FROM raw"""

LABELLED = """
SELECT *, quality_issue IS NULL AS is_valid FROM (
  SELECT *, CASE WHEN symbol IS NULL THEN 'symbol_null' WHEN date IS NULL THEN 'date_null'
    WHEN open IS NULL THEN 'open_null' WHEN high IS NULL THEN 'high_null' WHEN low IS NULL THEN 'low_null'
    WHEN close IS NULL THEN 'close_null' WHEN volume IS NULL THEN 'volume_null'
    WHEN high < low THEN 'high_lt_low' WHEN volume < 0 THEN 'volume_negative' END AS quality_issue
  FROM conformed)"""

VERSION_ORDER = ", ".join(
    f"{c} DESC NULLS LAST"
    for c in ("ingestion_ts", "ingestion_run_id", "open", "high", "low", "close", "adj_close", "volume")
)


def newest_version(source: str) -> str:
    return f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY {VERSION_ORDER}) AS rn FROM {source})
WHERE rn = 1"""


DAILY = "SELECT symbol, date, close, adj_close, volume FROM clean"


def _features(source: str) -> str:
    w = "PARTITION BY symbol ORDER BY date"
    cols = [f"lag(p, {k}) OVER ({w}) AS lag_close_{k}" for k in (1, 2, 3, 5, 10, 20)]
    cols += [f"p / nullif(lag(p, {k}) OVER ({w}), 0) - 1 AS ret_{k}" for k in (1, 5)]
    for n in (5, 10, 20, 50):
        f = f"({w} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        cols.append(f"CASE WHEN count(p) OVER {f} = {n} THEN avg(p) OVER {f} END AS roll_mean_{n}")
        cols.append(f"CASE WHEN count(p) OVER {f} = {n} THEN stddev_samp(p) OVER {f} END AS roll_std_{n}")
    cols += ["(isodow(date) - 1)::DOUBLE AS dow", "month(date)::DOUBLE AS month", "ln(1 + volume::DOUBLE) AS log_volume"]
    return f"""
SELECT symbol, date, close, p AS adj_close, volume, {', '.join(cols)}, lead(close) OVER ({w}) AS target
FROM (SELECT symbol, date, close, coalesce(adj_close, close) AS p, volume FROM {source})"""


FEATURE_NAMES = (
    [f"lag_close_{k}" for k in (1, 2, 3, 5, 10, 20)]
    + ["ret_1", "ret_5"]
    + [f"roll_{s}_{w}" for w in (5, 10, 20, 50) for s in ("mean", "std")]
    + ["dow", "month", "log_volume"]
)
_FULL = " AND ".join(f"{n} IS NOT NULL" for n in FEATURE_NAMES)

# The two check learners: one feature each.
LEARNERS = (("ols_lag_1", 1, "lag_close_1"), ("ols_mean_5", 2, "roll_mean_5"))


def _oof() -> str:
    parts = []
    for name, order, feature in LEARNERS:
        parts.append(f"""
SELECT b.symbol, '{name}' AS model, {order} AS model_order, b.segment AS fold, b.date, b.target AS y,
       c.a + c.b * b.{feature} AS pred
FROM blocks b JOIN coefs c ON c.symbol = b.symbol AND c.fit = b.segment AND c.model = '{name}'""")
    return f"SELECT *, y - pred AS residual FROM ({' UNION ALL '.join(parts)})"


def _coefs() -> str:
    parts = []
    for name, _, feature in LEARNERS:
        parts.append(f"""
SELECT b.symbol, '{name}' AS model, f.fit, count(*) AS n, regr_slope(b.target, b.{feature}) AS b,
       regr_intercept(b.target, b.{feature}) AS a
FROM blocks b JOIN (SELECT unnest([1, 2, 3, 4, 5, 6]) AS fit) f ON b.segment < f.fit GROUP BY b.symbol, f.fit""")
    return " UNION ALL ".join(parts)


def holidays(first: int = 1994, last: int = 2030) -> list[dt.date]:
    """Exchange holidays worked out day by day (apart from the Spark rules)."""
    out = []
    for y in range(first, last + 1):
        def nth(month: int, weekday: int, n: int) -> dt.date:
            days = [dt.date(y, month, d) for d in range(1, 32) if _exists(y, month, d)]
            hits = [d for d in days if d.weekday() == weekday]
            return hits[n]

        def observed(month: int, dom: int, saturday_moves: bool = True) -> list[dt.date]:
            d = dt.date(y, month, dom)
            if d.weekday() == 5:
                return [d - dt.timedelta(1)] if saturday_moves else []
            return [d + dt.timedelta(1)] if d.weekday() == 6 else [d]

        out += observed(1, 1, saturday_moves=False)
        if y >= 1998:
            out.append(nth(1, 0, 2))
        out += [nth(2, 0, 2), _easter(y) - dt.timedelta(2), nth(5, 0, -1)]
        if y >= 2022:
            out += observed(6, 19)
        out += observed(7, 4) + [nth(9, 0, 0), nth(11, 3, 3)] + observed(12, 25)
    closures = ["2001-09-11", "2001-09-12", "2001-09-13", "2001-09-14", "2004-06-11", "2007-01-02",
                "2012-10-29", "2012-10-30", "2018-12-05", "2025-01-09", "1994-04-27"]
    return sorted(set(out) | {dt.date.fromisoformat(c) for c in closures})


def _exists(y: int, m: int, d: int) -> bool:
    try:
        dt.date(y, m, d)
    except ValueError:
        return False
    return True


def _easter(y: int) -> dt.date:
    """First Sunday after the paschal full moon, by the tabular (Gauss) rule."""
    century = y // 100
    moon = (15 + century - century // 4 - (13 + 8 * century) // 25) % 30
    sunday = (4 + century - century // 4) % 7
    a = (19 * (y % 19) + moon) % 30
    b = (2 * (y % 4) + 4 * (y % 7) + 6 * a + sunday) % 7
    if a == 29 and b == 6:
        a -= 7
    if a == 28 and b == 6 and (11 * moon + 11) % 30 < 19:
        a -= 7
    return dt.date(y, 3, 22) + dt.timedelta(a + b)


HORIZON = 30
RUN_ID = "interactive"


def _recursion() -> str:
    """Step by step: state = the last five adjusted prices before the latest bar, and the latest."""
    return f"""
SELECT * FROM (
WITH RECURSIVE walk AS (
  SELECT s.symbol, s.model, 0 AS step, s.recent AS recent, NULL::DOUBLE AS pred FROM start s
  UNION ALL
  SELECT w.symbol, w.model, w.step + 1,
         list_append(w.recent[2:6], n.pred), n.pred
  FROM walk w JOIN coefs c ON c.symbol = w.symbol AND c.model = w.model AND c.fit = 6,
       LATERAL (SELECT greatest(c.a + c.b * CASE WHEN w.model = 'ols_lag_1' THEN w.recent[5]
                ELSE (w.recent[1] + w.recent[2] + w.recent[3] + w.recent[4] + w.recent[5]) / 5 END, 0.01) AS pred) n
  WHERE w.step < {HORIZON})
SELECT symbol, model, step, pred FROM walk WHERE step > 0)"""


def parts() -> dict[str, tuple[str, tuple[str, ...]]]:
    """name -> (SQL, names it reads)."""
    holiday_rows = ", ".join(f"(DATE '{d}')" for d in holidays())
    return {
        "raw": (_raw("l_returnflag || l_linestatus"), ()),
        "raw_supplier": (
            _raw("'S' || l_suppkey::VARCHAR || CASE WHEN l_quantity < 10 THEN '.ODD' ELSE '' END"), ()),
        "conformed": (CONFORM, ("raw",)),
        "labelled": (LABELLED, ("conformed",)),
        "valid": ("SELECT * EXCLUDE (quality_issue, is_valid) FROM labelled WHERE is_valid", ("labelled",)),
        "clean": (newest_version("valid"), ("valid",)),
        "daily": (DAILY, ("clean",)),
        "matrix": (_features("daily"), ("daily",)),
        "train": (f"SELECT * FROM matrix WHERE {_FULL} AND target IS NOT NULL", ("matrix",)),
        "sized": ("SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS train_rows FROM train)"
                  " WHERE train_rows >= 250", ("train",)),
        "blocks": ("""
SELECT *, CASE WHEN pos < train_rows - 5 * size THEN 0 ELSE 1 + (pos - (train_rows - 5 * size)) // size END AS segment
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS pos, train_rows // 6 AS size
      FROM sized)""", ("sized",)),
        "coefs": (_coefs(), ("blocks",)),
        "oof": (_oof(), ("blocks", "coefs")),
        "fold_mae": ("SELECT symbol, model, model_order, fold, avg(abs(residual)) AS mae, count(*) AS n"
                     " FROM oof GROUP BY ALL", ("oof",)),
        "cv": ("SELECT symbol, model, model_order, avg(mae) AS cv_mae, sum(n) AS residual_rows"
               " FROM fold_mae GROUP BY ALL", ("fold_mae",)),
        "bands": ("""
SELECT c.symbol, c.model, c.model_order, c.cv_mae, c.residual_rows,
       CASE WHEN c.residual_rows >= 30 THEN q.lo ELSE -c.cv_mae END AS q_low,
       CASE WHEN c.residual_rows >= 30 THEN q.hi ELSE c.cv_mae END AS q_high
FROM cv c JOIN (SELECT symbol, model, quantile_cont(residual, 0.1) AS lo, quantile_cont(residual, 0.9) AS hi
                FROM oof GROUP BY ALL) q USING (symbol, model)""", ("cv", "oof")),
        "chosen": ("SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY symbol"
                   " ORDER BY cv_mae, model_order) AS rn FROM bands) WHERE rn = 1", ("bands",)),
        "holidays": (f"SELECT * FROM (VALUES {holiday_rows}) h(date)", ()),
        "last_bar": ("SELECT symbol, max(date) AS last_date FROM daily GROUP BY symbol", ("daily",)),
        "sessions": (f"""
SELECT symbol, date, step FROM (
  SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date) AS step FROM (
    SELECT symbol, (last_date + k::INTEGER)::DATE AS date
    FROM last_bar CROSS JOIN (SELECT unnest(generate_series(1, 120)) AS k))
  WHERE isodow(date) <= 5 AND date NOT IN (SELECT date FROM holidays))
WHERE step <= {HORIZON}""", ("last_bar", "holidays")),
        "start": ("""
SELECT m.symbol, c.model, m.recent FROM (
  SELECT symbol, list(adj_close ORDER BY date) FILTER (WHERE back BETWEEN 1 AND 6) AS recent
  FROM (SELECT symbol, date, adj_close, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back
        FROM matrix) GROUP BY symbol) m JOIN chosen c USING (symbol)""", ("matrix", "chosen")),
        "walk_steps": (_recursion(), ("start", "coefs")),
        "forecast": (f"""
SELECT w.symbol, s.date::TIMESTAMP AS forecast_date, w.step::BIGINT AS horizon_day, w.pred AS pred_close,
       least(w.pred + c.q_low, w.pred + c.q_high) AS pred_low_80,
       greatest(w.pred + c.q_low, w.pred + c.q_high) AS pred_high_80,
       c.model AS model_name, c.cv_mae, '{RUN_ID}' AS pipeline_run_id
FROM walk_steps w JOIN sessions s ON s.symbol = w.symbol AND s.step = w.step
JOIN chosen c ON c.symbol = w.symbol""", ("walk_steps", "sessions", "chosen")),
        "metrics": (f"""
SELECT c.symbol, c.model AS selected_model, c.cv_mae AS best_cv_mae, f.pred_std,
       t.train_rows::BIGINT AS train_rows, '{RUN_ID}' AS pipeline_run_id
FROM chosen c JOIN (SELECT symbol, stddev_samp(pred_close) AS pred_std FROM forecast GROUP BY symbol) f USING (symbol)
JOIN (SELECT symbol, count(*) AS train_rows FROM sized GROUP BY symbol) t USING (symbol)""",
                    ("chosen", "forecast", "sized")),
    }


def with_parts(body: str, *needed: str, **extra: tuple[str, tuple[str, ...]]) -> str:
    """``body`` behind the parts it needs, each once and after what it reads."""
    known = {**parts(), **extra}
    done: list[str] = []

    def visit(name: str) -> None:
        if name not in done:
            for dep in known[name][1]:
                visit(dep)
            done.append(name)

    for name in needed:
        visit(name)
    # A part read more than once is kept as a table for the run of the statement.
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({known[n][0]})" for n in done) + "\n" + body
