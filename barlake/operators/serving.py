"""Published tables and the reads over them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlake.sources.tables import overwrite_snapshot

# Fixed values: (default, largest) rows per read.
RUNS_LIMIT = (20, 100)
HISTORY_LIMIT = (60, 500)
METRICS_LIMIT = (20, 200)


def checked_limit(n: int | None, bounds: tuple[int, int]) -> int:
    default, largest = bounds
    n = default if n is None else n
    if not 1 <= n <= largest:
        raise ValueError(f"limit must be between 1 and {largest}, got {n}")
    return n


def top_per(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int | None, bounds: tuple[int, int]
) -> DataFrame:
    """The first n rows per key, numbered in ``rn``.

    Every limit is below Spark's window-group-limit threshold, so map tasks pass on at most n rows
    per key and a hot key never meets in one task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(window)).filter(F.col("rn") <= checked_limit(n, bounds))


def listed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many rows each list holds."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))


def latest_from_forecast(forecast: DataFrame, exposed_ts: dt.datetime | None = None) -> DataFrame:
    """Next-day rows under their serving names."""
    return forecast.filter(F.col("horizon_day") == 1).select(
        "symbol",
        F.to_date("forecast_date").alias("next_trading_day"),
        F.col("pred_close").alias("predicted_close"),
        F.col("pred_low_80").alias("predicted_low_80"),
        F.col("pred_high_80").alias("predicted_high_80"),
        "model_name",
        "cv_mae",
        _stamp(exposed_ts).alias("exposed_ts"),
    )


def history_from_forecast(forecast: DataFrame, forecast_ts: dt.datetime | None = None) -> DataFrame:
    """All forecast rows of a run under one publication time, for the append-only history."""
    return forecast.drop("pipeline_run_id").withColumn("forecast_ts", _stamp(forecast_ts))


def metrics_from_run(metrics: DataFrame, loaded_ts: dt.datetime | None = None) -> DataFrame:
    return metrics.withColumn("loaded_ts", _stamp(loaded_ts))


def _stamp(at: dt.datetime | None) -> Column:
    return F.current_timestamp() if at is None else F.lit(at)


def publish(outcome_forecast: DataFrame, outcome_metrics: DataFrame, namespace: str, at: dt.datetime | None = None) -> None:
    """Appends history and metrics, replaces the exposed next-day rows, all under one publication time.

    Publishing again under the same time adds nothing, so a repeated job passes the time of its first try.
    """
    if at is None:
        at = outcome_forecast.sparkSession.range(1).select(F.current_timestamp()).first()[0]
    _append_once(history_from_forecast(outcome_forecast, at), f"{namespace}.forecast_history", "forecast_ts", at)
    _append_once(metrics_from_run(outcome_metrics, at), f"{namespace}.forecast_metrics", "loaded_ts", at)
    overwrite_snapshot(latest_from_forecast(outcome_forecast, at), f"{namespace}.forecast_latest")


def _append_once(rows: DataFrame, table: str, stamp: str, at: dt.datetime) -> None:
    """Appends the rows of symbols that the table does not hold under this time yet."""
    spark = rows.sparkSession
    if spark.catalog.tableExists(table):
        spark.catalog.refreshTable(table)
        stored = spark.table(table).filter(F.col(stamp) == F.lit(at)).select("symbol").distinct()
        rows = rows.join(stored, "symbol", "left_anti")
    rows.write.mode("append").saveAsTable(table)


def latest_forecast(latest: DataFrame, symbol: str | None = None) -> DataFrame:
    """The most recently exposed row per symbol."""
    rows = latest if symbol is None else latest.filter(F.col("symbol") == symbol)
    order = [F.desc("exposed_ts"), F.desc("next_trading_day")]
    return top_per(rows, ["symbol"], order, 1, (1, 1)).drop("rn")


def history_order() -> list[Column]:
    """Newest run first, then by horizon; the session date settles equal horizons."""
    return [F.desc("forecast_ts"), F.asc("horizon_day"), F.asc("forecast_date")]


def forecast_history(history: DataFrame, n: int | None = None, symbol: str | None = None) -> DataFrame:
    """The first n rows per symbol, numbered in ``rn``."""
    rows = history if symbol is None else history.filter(F.col("symbol") == symbol)
    return top_per(rows, ["symbol"], history_order(), n, HISTORY_LIMIT)


def metrics_history(metrics: DataFrame, n: int | None = None, symbol: str | None = None) -> DataFrame:
    rows = metrics if symbol is None else metrics.filter(F.col("symbol") == symbol)
    return top_per(rows, ["symbol"], [F.desc("loaded_ts"), F.desc("pipeline_run_id")], n, METRICS_LIMIT)


def ingestion_status(raw: DataFrame, symbol: str | None = None) -> DataFrame:
    """Newest price date, newest load and number of distinct days per symbol.

    Spark first groups by (symbol, date), so the distinct count of a hot symbol is spread out.
    """
    rows = raw if symbol is None else raw.filter(F.col("source_symbol") == symbol)
    return rows.groupBy("source_symbol").agg(
        F.max("date").alias("last_price_date"),
        F.max("ingestion_ts").alias("last_ingestion_ts"),
        F.count_distinct("date").alias("unique_trading_days"),
    )
